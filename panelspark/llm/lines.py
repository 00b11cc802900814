"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is two 62-bit fingerprints of its stripped, lower-cased bytes, each
modulo a prime at bases of its own.  The exact table counts for each key the
documents that hold it.  Keys that reached the threshold are dealt into shards of
bounded size; a shard is a cuckoo filter plus its sorted exact keys, so a filter
hit is always confirmed.  Documents can be added and deleted again
(:class:`LineIndex`): counts move both ways, and keys that cross the threshold
enter or leave the filters.

Texts are dealt into homes; a home asks the shards for each of its distinct keys
once, so a line that all documents hold costs its shard one entry per home.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import buckets, cut, forget, shared_folder, table, text_bytes
from panelspark.llm.exchange import deal, opened
from panelspark.llm.substrings import add_columns, cat, dealt, meet, offsets_of, plain_columns, schema_with

#: Keys in one shard, at most about.
SHARD_KEYS = 1 << 15
SLOTS = 4
#: Bytes of text that make one home.
HOME_BYTES = 16 << 20


def line_spans(t: B.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and the text it belongs to; an empty text is one empty line."""
    feeds = np.flatnonzero(t.data == 0x0A)
    owner = np.concatenate([np.arange(len(t)), np.searchsorted(t.offsets, feeds, "right") - 1])
    # lines follow each other, so each of the three only rises
    return np.sort(np.concatenate([t.offsets[:-1], feeds + 1])), np.sort(np.concatenate([t.offsets[1:], feeds])), np.sort(owner)


def line_keys(t: B.Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of each line's key, and its length in code points after stripping."""
    data = B._LOWER[t.data]
    solid = np.flatnonzero(~B._SEPARATOR[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    s, e = np.zeros_like(start), np.zeros_like(end)
    s[some], e[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return B.span_hash(B.prefix_hash(B._BYTE_VALUE[data]), s, e, 5), B.span_hash(B.prefix_hash(B._BYTE_VALUE[data], True), s, e, 6), points[e] - points[s]


def _distinct(t: B.Texts, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi, lo and text of the distinct keys of each text, in the order of the texts."""
    start, end, owner = line_spans(t)
    hi, lo, points = line_keys(t, start, end)
    keep = points >= min_points
    hi, lo, owner = hi[keep], lo[keep], owner[keep]
    order = np.lexsort((lo, hi, owner))
    hi, lo, owner = hi[order], lo[order], owner[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (owner[1:] != owner[:-1])
    return hi[new], lo[new], owner[new]


def distinct_pairs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hi, lo), rising, and how often each occurs."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(hi)), bool), (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[new], lo[new], np.diff(np.append(new, len(hi)))


def is_among(hi: np.ndarray, lo: np.ndarray, known_hi: np.ndarray, known_lo: np.ndarray) -> np.ndarray:
    """Which pairs are among the known ones (rising by known_hi); equal high halves are few, so the loop is short."""
    place, found = np.searchsorted(known_hi, hi), np.zeros(len(hi), bool)
    while True:
        inside = place < len(known_hi)
        inside[inside] = known_hi[place[inside]] == hi[inside]
        if not inside.any():
            return found
        found[inside] |= known_lo[place[inside]] == lo[inside]
        place = np.where(inside, place + 1, len(known_hi))


def line_counts(docs: DataFrame, min_points: int = 1, text_column: str = "text") -> DataFrame:
    """The exact table: key_hi, key_lo, refs = documents (rows) that hold a line of that key."""
    schema = pa.schema([("key_hi", pa.int64()), ("key_lo", pa.int64()), ("refs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in B.texts(batch["text"]):
                hi, lo, _ = _distinct(t, min_points)
                hi, lo, refs = distinct_pairs(hi, lo)
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(hi)), pa.array(B.signed(lo)), pa.array(refs.astype(np.int64))], schema=schema)

    counts = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "key_hi long, key_lo long, refs long")
    return counts.groupBy("key_hi", "key_lo").agg(F.sum("refs").alias("refs"))


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each key in one of two buckets; supports deletion."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
            table = np.zeros((n, SLOTS), np.uint16)
        self.table, self.mask = table, len(table) - 1

    @staticmethod
    def load(data: bytes) -> CuckooFilter:
        return CuckooFilter(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((hi >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = (hi & np.uint64(self.mask)).astype(np.int64)
        return fp, one, one ^ self.other(fp)

    def other(self, fp: np.ndarray) -> np.ndarray:
        return (B.mix(fp.astype(np.uint64), 9) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, hi: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(hi)
        return (self.table[one] == fp[:, None]).any(axis=1) | (self.table[two] == fp[:, None]).any(axis=1)

    def insert(self, hi: np.ndarray) -> CuckooFilter:
        """The filter with these keys; one of twice the size is built anew by the caller if it overflows."""
        fp, one, two = self.places(hi)
        for f, i, j in zip(fp.tolist(), one.tolist(), two.tolist(), strict=True):
            at = i
            for b in (i, j):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = f
                    break
            else:
                for kick in range(500):
                    slot = kick % SLOTS
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at ^= int(self.other(np.array([f], np.uint16))[0])
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = f
                        break
                else:
                    raise OverflowError("cuckoo filter is full")
        return self

    def delete(self, hi: np.ndarray) -> None:
        fp, one, two = self.places(hi)
        for f, i, j in zip(fp.tolist(), one.tolist(), two.tolist(), strict=True):
            for b in (i, j):
                at = np.flatnonzero(self.table[b] == f)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def build_filter(hi: np.ndarray) -> CuckooFilter:
    size = max(1, len(hi))
    while True:
        try:
            return CuckooFilter(size).insert(hi)
        except OverflowError:
            size *= 2


def build_shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """shard, filter, hi, lo: a cuckoo filter and the sorted exact keys of each shard."""
    schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        hi, lo = (rows[c].to_numpy().view(np.uint64) for c in ("key_hi", "key_lo"))
        order = np.lexsort((lo, hi))
        return pa.table([[key[0].as_py()], [build_filter(hi).dump()], [hi[order].tobytes()], [lo[order].tobytes()]], schema=schema)

    dealt = keys.select(F.pmod("key_lo", F.lit(n_shards)).cast("int").alias("shard"), "key_hi", "key_lo")
    return dealt.groupBy("shard").applyInArrow(run, "shard int, filter binary, hi binary, lo binary")


def change_shards(shards: DataFrame, changed: DataFrame, n_shards: int) -> DataFrame:
    """The shards in which some keys came or went (changed: key_hi, key_lo, hot), as they are now; one that is empty now has no row."""
    schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])

    def run(key: tuple, old: pa.Table, rows: pa.Table) -> pa.Table:
        change = np.stack([rows[c].to_numpy().view(np.uint64) for c in ("key_hi", "key_lo")], axis=1)
        hot = rows["hot"].to_numpy()
        if old.num_rows:
            keys = np.stack([np.frombuffer(old[c][0].as_py(), np.uint64) for c in ("hi", "lo")], axis=1)
        else:
            keys = np.zeros((0, 2), np.uint64)
        gone = set(map(tuple, change[~hot].tolist()))
        stays = np.array([k not in gone for k in map(tuple, keys.tolist())], bool)
        keys = np.concatenate([keys[stays], change[hot]])
        if not len(keys):
            return schema.empty_table()
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        try:
            if not old.num_rows:
                raise OverflowError("no filter yet")
            cuckoo = CuckooFilter.load(old["filter"][0].as_py())
            cuckoo.delete(change[~hot, 0])
            cuckoo.insert(change[hot, 0])
        except OverflowError:
            cuckoo = build_filter(keys[:, 0])
        return pa.table([[key[0].as_py()], [cuckoo.dump()], [keys[:, 0].tobytes()], [keys[:, 1].tobytes()]], schema=schema)

    dealt = changed.select(F.pmod("key_lo", F.lit(n_shards)).cast("int").alias("shard"), "key_hi", "key_lo", "hot")
    met = shards.groupBy("shard").cogroup(dealt.withColumnRenamed("shard", "_shard").groupBy("_shard"))
    return met.applyInArrow(run, "shard int, filter binary, hi binary, lo binary")


def salts_of(docs: DataFrame, n_shards: int, text_column: str = "text") -> int:
    """Over how many groups each shard's look-ups are dealt, by the bytes of text."""
    return -(-buckets(docs.sparkSession, text_bytes(docs, text_column), 64 << 20) // n_shards)


def probe(texts: DataFrame, shards: DataFrame, n_shards: int, salts: int, min_points: int = 1, text_column: str = "text") -> DataFrame:
    """For each home its keys that the shards hold, as blocks (bucket is the home).  Keys are dealt over the salts of their shard."""

    def ask(key: tuple, docs: pa.Table) -> pa.Table:
        held = [_distinct(t, min_points)[:2] for t in B.texts(docs[text_column])]
        hi, lo, _ = distinct_pairs(*map(np.concatenate, zip((np.zeros(0, np.uint64),) * 2, *held, strict=True)))
        group = B.signed(lo) % n_shards * salts + (B.mix(hi, 7) % np.uint64(salts)).astype(np.int64)
        out = deal(group, "bucket", hi=hi, lo=lo)
        return out.append_column("home", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

    def look(_: tuple, asks: pa.Table, shard: pa.Table) -> pa.Table:
        e = opened(asks, "home", hi="u8", lo="u8")
        if shard.num_rows:
            maybe = np.flatnonzero(CuckooFilter.load(shard["filter"][0].as_py()).contains(e["hi"]))
            hi, lo = (np.frombuffer(shard[c][0].as_py(), np.uint64) for c in ("hi", "lo"))
            at = maybe[is_among(e["hi"][maybe], e["lo"][maybe], hi, lo)]
        else:
            at = np.zeros(0, np.int64)
        return deal(e["home"][at], "bucket", hi=e["hi"][at], lo=e["lo"][at])

    # all columns, so that both uses of the texts share one exchange
    asked = texts.groupBy("_ps_home").applyInArrow(ask, "bucket int, hi binary, lo binary, home int")
    places = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda x: (F.col("shard") * salts + x).cast("int"))
    copies = shards.select(F.explode(places).alias("group"), "filter", "hi", "lo")
    return asked.groupBy("bucket").cogroup(copies.groupBy("group")).applyInArrow(look, "bucket int, hi binary, lo binary")


def strip_lines(docs: DataFrame, shards: DataFrame, n_shards: int, min_points: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs without the lines whose keys the shards hold, plus n_lines and n_dropped."""

    def run(_: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        hot = opened(replies, "bucket", hi="u8", lo="u8")
        order = np.argsort(hot["hi"])
        data, sizes, n_lines, n_dropped = [], [], [], []
        for t in B.texts(rows[text_column]):
            start, end, own = line_spans(t)
            hi, lo, points = line_keys(t, start, end)
            gone = (points >= min_points) & is_among(hi, lo, hot["hi"][order], hot["lo"][order])
            total, dropped = np.bincount(own, minlength=len(t)), np.bincount(own[gone], minlength=len(t))
            piece, offsets = B.join_pieces(t.data, start[~gone], end[~gone], total - dropped, 0x0A)
            data.append(piece)
            sizes.append(np.diff(offsets))
            n_lines.append(total)
            n_dropped.append(dropped)
        kept = pa.LargeStringArray.from_buffers(rows.num_rows, pa.py_buffer(offsets_of(sizes)), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *data])))
        rest = plain_columns(rows)
        at = rest.schema.get_field_index(text_column)
        kept = pc.if_else(pc.is_null(rest[text_column]), pa.scalar(None, pa.large_string()), kept)
        rest = rest.set_column(at, text_column, kept.cast(rest.schema.field(at).type))
        return add_columns(rest, n_lines=cat(n_lines), n_dropped=cat(n_dropped))

    added = {"n_lines": T.LongType(), "n_dropped": T.LongType()}
    homes = buckets(docs.sparkSession, text_bytes(docs, text_column), HOME_BYTES)
    texts = dealt(docs, homes, id_column, text_column, tuple(added))
    hits = probe(texts, shards, n_shards, salts_of(docs, n_shards, text_column), min_points, text_column)
    return meet(texts, hits, run, schema_with(docs, **added))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the lines whose key at least ``min_docs`` documents hold, plus n_lines and n_dropped.

    Every row is a document, so repeated rows count each; a null or empty text
    is one empty line and stays as it is; a line without a key (nothing but
    separators) always stays.  Null ids and extra columns pass through (n_lines and n_dropped replace
    columns of these names); an empty table stays empty.
    """
    hot = cut(line_counts(docs, min_points, text_column).filter(F.col("refs") >= min_docs))
    n_shards = hot.count() // SHARD_KEYS + 1
    return strip_lines(docs, build_shards(hot, n_shards), n_shards, min_points, id_column, text_column)


_COUNTS = "key_hi long, key_lo long, refs long, part int"
_SHARDS = "shard int, filter binary, hi binary, lo binary"


class LineIndex:
    """An incremental index in a shared folder: insert and delete documents, then strip any documents by it.

    The exact counts lie in parts and the keys at the threshold in shards, each
    by a hash of the key.  A change writes the parts and shards that it touches
    under the next version's number, and at last a state that says in which
    version each part and shard lies; a job that fails half-way leaves the last
    state in force.  Any session opens the index by its folder and goes on from
    the last state.  Deleting what was inserted gives the former answers; a
    deletion of lines that the index doesn't hold is refused and changes nothing.
    What a change replaced stays for one more change, for readers under way.
    ``parts`` is fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_points: int = 1, folder: str | None = None, parts: int = 64):
        self.spark, self.folder = spark, folder or shared_folder(spark)
        made = {"version": 0, "min_docs": min_docs, "min_points": min_points, "parts": parts, "n_shards": 1, "counts": {}, "shards": {}, "replaced": []}
        self.state = self._last_state() or made
        if (min_docs, min_points) != (self.state["min_docs"], self.state["min_points"]):
            raise ValueError(f"the index in {self.folder} was made with min_docs {self.state['min_docs']} and min_points {self.state['min_points']}")
        self.min_docs, self.min_points = min_docs, min_points

    @property
    def n_shards(self) -> int:
        return self.state["n_shards"]

    def _names(self, path: str) -> list[str]:
        """What a folder holds; nothing if it isn't there."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []

    def _drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _last_state(self) -> dict | None:
        """The newest state that was written to its end."""
        for version in sorted((int(n[1:]) for n in self._names(f"{self.folder}/state")), reverse=True):
            path = f"{self.folder}/state/v{version}"
            if "_SUCCESS" in self._names(path):
                return json.loads(self.spark.read.text(path).first()["value"])
        return None

    def _table(self, name: str, column: str, schema: str, only: set[int] | None = None) -> DataFrame:
        """The parts or shards of the state, or some of them."""
        paths = [f"{self.folder}/{name}/v{v}/{column}={k}" for k, v in self.state[name].items() if only is None or int(k) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        plain = ", ".join(c for c in schema.split(", ") if c.split()[0] != column)
        kept = self.spark.read.schema(plain).parquet(*paths)
        number = F.regexp_extract(F.input_file_name(), f"/{column}=(\\d+)/", 1).cast("int")
        return kept.withColumn(column, number)

    def counts(self) -> DataFrame:
        return self._table("counts", "part", _COUNTS).select("key_hi", "key_lo", "refs")

    def shards(self, only: set[int] | None = None) -> DataFrame:
        return self._table("shards", "shard", _SHARDS, only).select("shard", "filter", "hi", "lo")

    def _write(self, df: DataFrame, name: str, column: str, version: int, touched: set[int] | None, held: dict) -> dict:
        """held after the touched parts (None: all) are df's; those without a row are gone."""
        path = f"{self.folder}/{name}/v{version}"
        df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)
        new = {n.split("=")[1]: version for n in self._names(path) if n.startswith(f"{column}=")}
        return {k: v for k, v in held.items() if touched is not None and int(k) not in touched} | new

    def _change(self, docs: DataFrame, sign: int) -> None:
        before = self.state = self._last_state() or self.state  # another session may have gone on
        version = before["version"] + 1
        part = F.pmod("key_hi", F.lit(before["parts"])).cast("int").alias("part")
        delta = cut(line_counts(docs, self.min_points).select("key_hi", "key_lo", F.col("refs") * sign, part).toDF("key_hi", "key_lo", "change", "part"))
        touched = {r["part"] for r in delta.select("part").distinct().collect()}
        key = ["key_hi", "key_lo", "part"]
        old = self._table("counts", "part", _COUNTS, touched)
        both = cut(old.join(delta, key, "full").select(*key, F.coalesce("refs", F.lit(0)).alias("old"), (F.coalesce("refs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("refs"), F.col("change").isNotNull().alias("met")))
        if not both.filter("refs < 0").isEmpty():
            forget(delta), forget(both)
            raise ValueError("a deletion takes lines from the index that it doesn't hold so often")
        counts = self._write(both.filter("refs <> 0").select("key_hi", "key_lo", "refs", "part"), "counts", "part", version, touched, before["counts"])
        changed = cut(both.filter(f"met and (old >= {self.min_docs}) <> (refs >= {self.min_docs})").select("key_hi", "key_lo", (F.col("refs") >= self.min_docs).alias("hot")))
        n_hot = before.get("n_hot", 0) + (changed.agg(F.sum(F.when(F.col("hot"), 1).otherwise(-1)).alias("n")).first()["n"] or 0)
        n_shards, held = n_hot // SHARD_KEYS + 1, before["shards"]
        if not held or n_shards > before["n_shards"]:
            self.state = before | {"counts": counts}
            hot, touched_shards = self.counts().filter(F.col("refs") >= self.min_docs), None
            new = build_shards(hot, n_shards)
        else:
            n_shards = before["n_shards"]
            touched_shards = {r["shard"] for r in changed.select(F.pmod("key_lo", F.lit(n_shards)).cast("int").alias("shard")).distinct().collect()}
            new = change_shards(self.shards(touched_shards), changed, n_shards) if touched_shards else None
        shards = held if new is None else self._write(new, "shards", "shard", version, touched_shards, held)
        replaced = [f"{name}/v{v}/{column}={k}" for name, column, now in (("counts", "part", counts), ("shards", "shard", shards)) for k, v in before[name].items() if now.get(k) != v]
        after = before | {"version": version, "n_shards": n_shards, "n_hot": n_hot, "counts": counts, "shards": shards, "replaced": replaced}
        self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state/v{version}")
        self.state = after
        for path in before["replaced"]:  # what the change before this one replaced
            self._drop(f"{self.folder}/{path}")
        self._drop(f"{self.folder}/state/v{version - 2}")
        for written in (delta, both, changed):
            forget(written)

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        self._change(docs, -1)

    def strip(self, docs: DataFrame) -> DataFrame:
        self.state = self._last_state() or self.state
        return strip_lines(docs, self.shards(), self.n_shards, self.min_points)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), 10, 1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, i, line, lower_ascii as key from (
    select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line,
           translate(trim(unnest(ls), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
hot as (select key from l where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (h.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (h.key is null), '')) as kept_sha256
from l left join hot h on l.key = h.key group by doc_id
"""
