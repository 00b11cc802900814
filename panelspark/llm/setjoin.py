"""Exact Jaccard join of word n-gram sets, made light by relations between sets.

1. A set that can't link is recognised by its unique shingles: what no other
   document holds is in no intersection.  A third of all shingles (by hash) is
   enough to count a lower bound of the unique ones, so texts that share little
   drop out exactly, without a candidate.
2. Equal sets become one class; only classes go on.
3. Tokens are ordered by document frequency, rarest first.  Two sets that link
   share a token of their prefixes; positions in the order bound the overlap.
4. Answers come from answers.  Each list's members are compared with its leader,
   and what becomes connected is one component, whose inner pairs need no
   comparison.  Of two members whose overlaps with the leader are known, these
   bound the overlap of both: many pairs are decided by that alone, either way.
   Then every list is searched for pairs across components; blocks of a list,
   sorted by what remains after the token, are skipped whole when their lengths
   and positions rule a link out or all lie in the probe's own component.  Long
   lists are cut into pieces by size; only members outside the list's largest
   component visit other pieces, and only those whose sizes allow a link.
5. Candidates are verified on the sets, and components are joined.

No link between different sets is lost, and no group is ever paired off.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import bytetext as B
from panelspark.llm.common import buckets, cut, row_key, table, text_bytes
from panelspark.llm.components import components
from panelspark.llm.exchange import ASK, COUNT, ECHO, Outbox, block_schema, bucket_of, deal, opened, received, reply, runs, spread, unpack
from panelspark.llm.substrings import dealt, meet

BUCKET_BYTES = 16 << 20
SAMPLE = 3
#: Members of one piece of a list.
LIST_MEMBERS = 1024
SKIP_BLOCK = 64
TOKEN_BYTES = 6

_SEEN = {"fp": "u4", "state": "u1"}
_COUNT = {"n": "i4"}


def shingle_sets(t: B.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the text of each."""
    w = B.words(t, lower=True)
    start, (h,) = B.windows(w, size, (1,))
    owner = np.searchsorted(w.offsets, start, "right") - 1
    length = np.diff(w.offsets)
    short = np.flatnonzero((length > 0) & (length < size))
    if len(short):
        whole = B.span_hash(B.prefix_hash(B.mix(w.hash, 101)), w.offsets[short], w.offsets[short + 1], 1)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def dump_set(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash: two sets meet by chance in one of 2**48 values."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def load_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def _settle(n_buckets: int):
    """Equal shingles of one flush are settled; the bucket gets one entry that counts as two."""

    def run(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        both = (e["bucket"].astype(np.uint64) << np.uint64(32)) | e["fp"]
        order = np.argsort(both, kind="stable")
        first = runs(both[order])
        length = np.diff(np.append(first, len(order)))
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(length > 1, length)
        mark = order[first[length > 1]]
        marks = {c: v[mark] for c, v in e.items()}
        marks["state"] = np.full(len(mark), COUNT, np.uint8)
        e["state"] = np.where(again, np.uint8(ECHO), e["state"])
        e["bucket"] = np.where(again, spread(e["owner"], e["fp"], n_buckets), e["bucket"])
        return {c: np.concatenate([v, marks[c]]) for c, v in e.items()}

    return run


def send_sampled(n_buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(_SEEN, combine=_settle(n_buckets))
        for batch in batches:
            keys = batch["key"].to_numpy(zero_copy_only=False)
            for t in B.texts(batch["text"]):
                h, owner = shingle_sets(t, size)
                pick = h % np.uint64(SAMPLE) == 0
                h, owner = h[pick], owner[pick]
                h = B.mix(h, 71)
                yield from box.add(bucket=bucket_of(h, n_buckets), owner=keys[t.first + owner], fp=h >> np.uint64(32), state=np.full(len(h), ASK))
        yield from box.flush()

    return run


def answer_seen(homes: int):
    """How many sampled shingles of each text occur elsewhere, to the homes of the texts."""

    def run(_: tuple, blocks: pa.Table) -> pa.Table:
        e = unpack(blocks, _SEEN)
        counted = np.flatnonzero(e["state"] != ECHO)
        _, inverse = np.unique(e["fp"][counted], return_inverse=True)
        total = np.bincount(inverse, weights=np.where(e["state"][counted] == COUNT, 2, 1))
        yes = e["state"] == ECHO
        yes[counted] = (total[inverse] > 1) & (e["state"][counted] == ASK)
        owner = np.sort(e["owner"][yes])
        first = runs(owner)
        return reply(owner[first], homes, _COUNT, n=np.diff(np.append(first, len(owner))))

    return run


def judge(size: int, percent: int, kind: pa.DataType):
    """Rows with the size of their set; those that may link also with the set and its class."""

    def run(_: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        row, x = received(replies, docs["_ps_key"].to_numpy(), _COUNT)
        repeated = np.bincount(row, x["n"], docs.num_rows).astype(np.int64)
        sizes, classes, sets, given = [], [], [], set()
        for t in B.texts(docs["text"]):
            h, owner = shingle_sets(t, size)
            n = np.bincount(owner, minlength=len(t))
            sampled = np.bincount(owner[h % np.uint64(SAMPLE) == 0], minlength=len(t))
            unique = sampled - repeated[t.first : t.first + len(t)]
            first = np.concatenate([[0], np.cumsum(n)])
            may = (n > 0) & (100 * (n - unique) >= percent * n)
            sizes.append(n)
            for i in range(len(t)):
                if not may[i]:
                    classes.append(None)
                    sets.append(None)
                    continue
                data = dump_set(h[first[i] : first[i + 1]])
                name = hashlib.md5(data, usedforsecurity=False).digest()
                classes.append(name)
                sets.append(None if name in given else data)  # one copy from each home
                given.add(name)
        n = np.concatenate([np.zeros(0, np.int64), *sizes])
        return pa.table([docs["_ps_id"].cast(kind), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["id", "n", "class", "set"])

    return run


def ask_frequency(n_buckets: int):
    """A home's distinct tokens and in how many of its sets each occurs, one entry each."""

    def run(key: tuple, sets: pa.Table) -> pa.Table:
        token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(load_set, sets["set"].to_pylist())]), return_counts=True)
        out = deal(bucket_of(B.mix(token, 72), n_buckets), "bucket", token=token, n=n.astype(np.uint32))
        return out.append_column("home", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

    return run


def answer_frequency(_: tuple, asks: pa.Table) -> pa.Table:
    """In how many sets each token occurs, where more than one, to the homes that asked."""
    e = opened(asks, "home", token="u8", n="u4")
    _, inverse = np.unique(e["token"], return_inverse=True)
    df = np.bincount(inverse, e["n"]).astype(np.int32)[inverse]
    yes = df > 1
    return deal(e["home"][yes], "bucket", token=e["token"][yes], df=df[yes])


def index_sets(percent: int):
    """Sets that may still link, with the tokens of their prefixes that others hold: positions and frequencies."""
    schema = pa.schema([("key", pa.int64()), ("class", pa.binary()), ("n", pa.int64()), ("set", pa.binary()), ("unique", pa.int64()), ("token", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("df", pa.list_(pa.int32()))])

    def run(_: tuple, sets: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        known = opened(replies, "bucket", token="u8", df="i4")
        by_token = np.argsort(known["token"])
        token, frequency = known["token"][by_token], known["df"][by_token]
        for key, name, n, data in zip(*(sets[c].to_pylist() for c in ("_ps_key", "class", "n", "set")), strict=True):
            h, df = load_set(data), np.ones(n, np.int32)
            if len(token):
                at = np.searchsorted(token, h)
                at[at == len(token)] = 0
                df = np.where(token[at] == h, frequency[at], 1)
            unique = int((df == 1).sum())
            if 100 * (n - unique) < percent * n:
                continue
            order = np.lexsort((h, df))
            prefix = n - (percent * n + 99) // 100 + 1
            place = np.arange(unique, max(unique, prefix))  # the unique ones stand first
            pick = order[place]
            out.append((key, name, n, data, unique, B.signed(h[pick]).tolist(), place.tolist(), df[pick].tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 8, schema, strict=True)], schema=schema)

    return run


def search_lists(percent: int):
    """Pairs across components that share a list's token and may link, and whether what is known of the leader makes that sure.

    Rows are members of a piece of a list, or probes, or both; ``shared`` is
    their overlap with the list's leader (null if unknown).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        whole = lambda c: rows[c].fill_null(-1).to_numpy().astype(np.int64)
        token, piece, key, component, n, at, shared, leader_n = map(whole, ("token", "piece", "key", "component", "n", "at", "shared", "leader_n"))
        probe, member = (rows[c].to_numpy(zero_copy_only=False) for c in ("probe", "member"))
        rest = n - at
        order = np.lexsort((key, -rest, piece, token))
        token, piece, key, component, n, rest, shared, leader_n, probe, member = (v[order] for v in (token, piece, key, component, n, rest, shared, leader_n, probe, member))
        start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (piece[1:] != piece[:-1])))) if len(token) else np.zeros(0, np.int64)
        a_out, b_out, sure_out = [], [], []
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(token)], strict=True):
            if (component[lo:hi] == component[lo]).all():
                continue
            there = lo + np.flatnonzero(member[lo:hi])
            if not len(there):
                continue
            c, ns, rs, ks, os, ps = (v[there] for v in (component, n, rest, key, shared, probe))
            edge = np.arange(0, len(there), SKIP_BLOCK)
            least_n, most_n = np.minimum.reduceat(ns, edge), np.maximum.reduceat(ns, edge)
            most_rest = np.maximum.reduceat(rs, edge)
            same = np.minimum.reduceat(c, edge) == np.maximum.reduceat(c, edge)
            size = np.diff(np.append(edge, len(there)))
            for i in (lo + np.flatnonzero(probe[lo:hi])).tolist():
                m = n[i]
                # overlap <= what remains, and a link asks that (100 + percent) * overlap >= percent * (n + m)
                may = (100 * least_n <= (100 * m * 100) // percent) & (100 * most_n >= percent * m)
                may &= (100 + percent) * np.minimum(most_rest, rest[i]) >= percent * (least_n + m)
                may &= ~(same & (c[edge] == component[i]))
                if not may.any():
                    continue
                j = np.flatnonzero(np.repeat(may, size))
                # of two probes in one piece, the one with the smaller key asks
                good = (c[j] != component[i]) & (100 * np.minimum(ns[j], m) >= percent * np.maximum(ns[j], m)) & ((ks[j] > key[i]) | ~(ps[j] & member[i]))
                good &= (100 + percent) * np.minimum(rs[j], rest[i]) >= percent * (ns[j] + m)
                j = j[good]
                need, o = percent * (ns[j] + m), shared[i]
                known = (os[j] >= 0) & (o >= 0)
                most = np.minimum(os[j], o) + np.minimum(ns[j] - os[j], m - o)
                maybe = ~known | ((100 + percent) * most >= need)
                sure = known & ((100 + percent) * (os[j] + o - leader_n[i]) >= need)
                j, sure = j[maybe], sure[maybe]
                a_out.append(np.minimum(ks[j], key[i]))
                b_out.append(np.maximum(ks[j], key[i]))
                sure_out.append(sure)
        cat = lambda xs, d: np.concatenate([np.zeros(0, d), *xs])
        pair = np.unique(np.stack([cat(a_out, np.int64), cat(b_out, np.int64), cat(sure_out, bool).astype(np.int64)], axis=1), axis=0)
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(pair[:, 2] > 0)], schema=schema)

    return run


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets and of the intersection."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("shared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True):
                p, q = load_set(x), load_set(y)
                both = np.sort(np.concatenate([p, q]))
                sizes.append((len(p), len(q), int((both[1:] == both[:-1]).sum())))
            n = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *(pa.array(n[:, i]) for i in range(3))], schema=schema)

    one = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, n long, m long, shared long")


def parts_of(df: Column) -> Column:
    """Over how many parts the members of a list are dealt."""
    return F.ceil(df / LIST_MEMBERS).cast("int")


def on_lists(members: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Members (key, df) joined with what is known of their lists (df too), so that a long list meets in parts, not in one task."""
    part = F.pmod(F.xxhash64("key"), parts_of(F.col("df"))).cast("int")
    copies = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), parts_of(F.col("df")) - 1))).drop("df")
    return members.withColumn("_part", part).join(copies, [*keys, "_part"]).drop("_part")


def pieces(listed: DataFrame, percent: int) -> DataFrame:
    """Members and probes of the pieces of all lists; listed has df and component of each member."""
    short = listed.filter(F.col("df") <= LIST_MEMBERS).withColumns({"class": F.lit(0), "salt": F.lit(0), "member": F.lit(True), "probe": F.lit(True)})
    # sets that may link lie in one class of sizes or in neighbouring ones
    grain = math.log(max(100 / percent, 1.000001))
    long = listed.filter(F.col("df") > LIST_MEMBERS).withColumn("class", F.floor(F.log("n") / grain).cast("int"))
    sizes = long.groupBy("token", "class").agg(parts_of(F.count("*")).alias("salts"), F.max("df").alias("df"))
    largest = long.groupBy("token", "component").agg(F.count("*").alias("n"), F.max("df").alias("df")).groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("df").alias("df"))
    members = on_lists(long, sizes, ["token", "class"]).withColumns({"salt": F.pmod(F.xxhash64("key"), "salts").cast("int"), "member": F.lit(True), "probe": F.lit(False)}).drop("salts")
    outside = on_lists(long, largest, ["token"]).filter(F.col("component") != F.col("largest")).drop("largest")
    near = outside.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    probes = on_lists(near, sizes, ["token", "class"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumns({"member": F.lit(False), "probe": F.lit(True)})
    return short.unionByName(members).unionByName(probes).withColumn("piece", F.xxhash64("class", "salt"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A text's set holds its distinct shingles of ``size`` words (A-Z lower-cased),
    or its whole word sequence if it has fewer; two texts link when
    ``100 * intersection >= percent * union``; component_id is the smallest id
    reachable by links.  Null, empty and wordless texts have no set and link
    with nothing: they keep their own id.  Rows with a null id take part; they
    count as larger than every id.  Repeated rows are in one component; extra
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = buckets(spark, text_bytes(docs, text_column), BUCKET_BYTES)
    plain = docs.select(F.col(id_column).cast("long").alias("_ps_id"), F.col(text_column).alias("text"))
    keyed = plain.select(row_key("_ps_id", "text").alias("key"), "text")
    seen = keyed.mapInArrow(send_sampled(n, size), block_schema(_SEEN)).groupBy("bucket").applyInArrow(answer_seen(n), block_schema(_COUNT))
    judged = cut(meet(dealt(plain, n, "_ps_id", "text", ()), seen, judge(size, percent, pa.int64()), "id long, n long, class binary, set binary"))

    classes = judged.filter("set is not null").groupBy("class").agg(F.first("set").alias("set"), F.first("n").alias("n"))
    homes = max(1, n // 4)  # sets that may link are a part of the texts
    sets = classes.select("class", "n", "set", F.xxhash64("class").alias("_ps_key")).withColumn("_ps_home", F.pmod("_ps_key", F.lit(homes)).cast("int")).repartition("_ps_home")
    asked = sets.groupBy("_ps_home").applyInArrow(ask_frequency(homes), "bucket int, token binary, n binary, home int")
    frequent = asked.groupBy("bucket").applyInArrow(answer_frequency, "bucket int, token binary, df binary")
    index = cut(meet(sets, frequent, index_sets(percent), "key long, class binary, n long, set binary, unique long, token array<long>, at array<int>, df array<int>"))

    linking = (100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("m"))
    listed = index.select("key", "n", "unique", F.explode(F.arrays_zip("token", "at", "df")).alias("x")).select("key", F.col("n").cast("int").alias("n"), "unique", F.col("x.token").alias("token"), F.col("x.at").alias("at"), F.col("x.df").alias("df"))
    leaders = listed.groupBy("token").agg(F.min(F.struct("unique", "key", "n")).alias("leader"), F.max("df").alias("df"))
    led = on_lists(listed.drop("unique"), leaders, ["token"]).select("*", F.col("leader.n").alias("leader_n"), F.least("key", "leader.key").alias("a"), F.greatest("key", "leader.key").alias("b")).drop("leader")
    stars = led.filter((F.col("a") != F.col("b")) & (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")))
    compared = cut(overlaps(stars.select("a", "b").distinct(), index))
    linked = components(compared.filter(linking), "a", "b")

    shared = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.col("shared"))
    known = led.join(compared.select("a", "b", "shared"), ["a", "b"], "left").withColumn("shared", shared).drop("a", "b")
    known = known.join(linked.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = pieces(known, percent).withColumn("bucket", F.pmod(F.xxhash64("token", "piece"), F.lit(4 * n)).cast("int"))
    across = cut(placed.groupBy("bucket").applyInArrow(search_lists(percent), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")))
    checked = overlaps(across.filter(~F.col("sure")).select("a", "b"), index).filter(linking)
    joined = checked.select("a", "b").unionByName(across.filter("sure").select("a", "b"))
    of_a, of_b = (linked.select(F.col("node").alias(k), F.col("component").alias(f"component_{k}")) for k in ("a", "b"))
    contracted = joined.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    upper = components(contracted, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("top"))
    final = linked.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("top")).unionByName(upper.select(F.col("component").alias("node"), "top"))
    final = final.groupBy("node").agg(F.min("top").alias("top"))

    named = judged.select("id", "n", "class", F.xxhash64("class").alias("node"))
    grouped = named.filter("class is not null").groupBy("class", "node").agg(F.min("id").alias("least")).join(final, "node", "left").withColumn("top", F.coalesce("top", "node"))
    tops = grouped.groupBy("top").agg(F.min("least").alias("component_id"))
    ids = grouped.join(tops, "top").select(F.col("class").alias("_class"), "component_id")
    return named.join(ids, F.col("class") == F.col("_class"), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i+3], ' ') as g from (
    select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id, doc_id as root from documents union select r.doc_id, e.b from r join e on r.root = e.a)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.root) as component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.doc_id = d.doc_id group by d.doc_id
"""
