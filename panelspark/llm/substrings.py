"""Repeated word windows, found through difference-cover anchors.

D is a perfect difference cover modulo v: for any two positions there is one k
in [0, v) that moves both onto D.  Hence two equal windows of v + w - 1 words
share an aligned anchor, w words that start at cover positions of both texts,
and only |D| / v of all anchors need to be dealt out.

1. Every text sends the hashes of its anchors; buckets answer which repeat.
2. Windows that hold a repeated anchor are extended to full length: their hashes
   go out with (doc_id, start), and buckets answer which have an earlier equal.
3. The answers meet the texts, and the words they cover go.

Groups are never paired off: a window of m copies costs m entries.  A task
settles what repeats within its own flush, so a hot window costs a bucket one
entry per flush.  Texts are shuffled once; both joins read that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import buckets, row_key, table, text_bytes
from panelspark.llm.exchange import ASK, COUNT, ECHO, Outbox, arrow_schema, block_schema, bucket_of, received, reply, runs, spread, unpack

WINDOW = 20
#: Perfect difference sets by modulus; their windows are WINDOW + 1 - modulus words.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Bytes of text whose entries make one bucket.
BUCKET_BYTES = 16 << 20

_ANCHOR = {"fp": "u4", "at": "i4", "state": "u1"}
_WINDOW = {"fp": "u8", "at": "i4", "state": "u1"}
_ORDER = {"doc": "i8"}
_ANSWER = {"at": "i4"}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """The largest modulus whose anchors keep at least two fifths of the window: v, D, w."""
    v = max((m for m in COVERS if window + 1 - m >= 0.4 * window), default=1)
    return v, COVERS.get(v, (0,)), window + 1 - v


def combine_repeats(n_buckets: int):
    """Of equal anchors in one flush all are settled; the bucket gets one entry that counts as two."""

    def run(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        both = (e["bucket"].astype(np.uint64) << np.uint64(32)) | e["fp"]
        order = np.argsort(both, kind="stable")
        first = runs(both[order])
        many = np.diff(np.append(first, len(order))) > 1
        again = np.repeat(many, np.diff(np.append(first, len(order))))
        settled = np.zeros(len(order), bool)
        settled[order] = again
        mark = order[first[many]]
        marks = {c: v[mark] for c, v in e.items()}
        marks["state"] = np.full(len(mark), COUNT, np.uint8)
        e["state"] = np.where(settled, np.uint8(ECHO), e["state"])
        e["bucket"] = np.where(settled, spread(e["owner"], e["at"], n_buckets), e["bucket"])
        return {c: np.concatenate([v, marks[c]]) for c, v in e.items()}

    return run


def answer_repeats(homes: int):
    """The anchors that occur more than once, to the homes of their texts."""

    def run(_: tuple, blocks: pa.Table) -> pa.Table:
        e = unpack(blocks, _ANCHOR)
        counted = e["state"] != ECHO
        _, inverse = np.unique(e["fp"][counted], return_inverse=True)
        total = np.bincount(inverse, weights=np.where(e["state"][counted] == COUNT, 2, 1))
        yes = e["state"] == ECHO
        yes[np.flatnonzero(counted)] = (total[inverse] > 1) & (e["state"][counted] == ASK)
        return reply(e["owner"][yes], homes, _ANSWER, at=e["at"][yes])

    return run


def combine_firsts(n_buckets: int):
    """Of equal windows in one flush only the first in (doc, start) order asks; later ones are settled."""

    def run(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        later = _later(e)
        e["state"] = np.where(later, np.uint8(ECHO), e["state"])
        e["bucket"] = np.where(later, spread(e["owner"], e["at"], n_buckets), e["bucket"])
        return e

    return run


def _later(e: dict[str, np.ndarray]) -> np.ndarray:
    order = np.lexsort((e["at"], e["doc"], e["fp"]))
    first = runs(e["fp"][order])
    head = np.repeat(order[first], np.diff(np.append(first, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = (e["doc"][order] != e["doc"][head]) | (e["at"][order] != e["at"][head])
    return out


def answer_firsts(homes: int):
    """The windows that have an equal one earlier, to the homes of their texts."""

    def run(_: tuple, blocks: pa.Table) -> pa.Table:
        e = unpack(blocks, _WINDOW, _ORDER)
        asks = np.flatnonzero(e["state"] == ASK)
        yes = e["state"] == ECHO
        yes[asks] = _later({c: v[asks] for c, v in e.items()})
        return reply(e["owner"][yes], homes, _ANSWER, at=e["at"][yes])

    return run


def send_anchors(n_buckets: int, window: int):
    v, cover, size = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(_ANCHOR, combine=combine_repeats(n_buckets))
        on_cover = np.zeros(v, bool)
        on_cover[list(cover)] = True
        for batch in batches:
            keys = batch["key"].to_numpy(zero_copy_only=False)
            for t in B.texts(batch["text"]):
                w = B.words(t)
                start, (h,) = B.windows(w, size, (1,))
                text = np.searchsorted(w.offsets, start, "right") - 1
                at = start - w.offsets[text]
                pick = on_cover[at % v]
                # texts shorter than a window can't hold one
                pick &= np.diff(w.offsets)[text] >= window
                h, at, text = h[pick], at[pick], text[pick]
                yield from box.add(bucket=bucket_of(h, n_buckets), owner=keys[t.first + text], fp=h >> np.uint64(32), at=at, state=np.full(len(h), ASK))
        yield from box.flush()

    return run


def send_windows(n_buckets: int, window: int, text_column: str):
    v, _, size = cover_for(window)

    def run(_: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        box, out = Outbox(_WINDOW, _ORDER, combine_firsts(n_buckets)), []
        if docs.num_rows and replies.num_rows:
            keys, order = docs["_ps_key"].to_numpy(), docs["_ps_order"].to_numpy()
            row, answers = received(replies, keys, _ANSWER)
            for t in B.texts(docs[text_column]):
                w = B.words(t)
                a, b = np.searchsorted(row, (t.first, t.first + len(t)))
                hit = np.zeros(len(w) + 1, np.int64)
                hit[w.offsets[row[a:b] - t.first] + answers["at"][a:b]] = 1
                before = np.concatenate([[0], np.cumsum(hit)])
                start, (h, h2) = B.windows(w, window, (1, 2))
                near = before[start + v] > before[start]
                start, h, h2 = start[near], h[near], h2[near]
                text = np.searchsorted(w.offsets, start, "right") - 1
                out += box.add(bucket=bucket_of(h2, n_buckets), owner=keys[t.first + text], doc=order[t.first + text], fp=h, at=start - w.offsets[text], state=np.full(len(h), ASK))
            out += box.flush()
        return pa.Table.from_batches(out, schema=arrow_schema(_WINDOW, _ORDER))

    return run


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def join_words(w: B.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one space, as bytes and offsets."""
    count = np.diff(np.concatenate([[0], np.cumsum(keep)])[w.offsets])
    return B.join_pieces(w.data, w.start[keep], w.end[keep], count, 0x20)


def lists_of(values: list[np.ndarray], offsets: np.ndarray, names: tuple[str, ...]) -> pa.Array:
    """array<struct> from parallel arrays and the offsets of the rows."""
    kind = pa.struct([(n, pa.int64()) for n in names])
    flat = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def spans_of(gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of gone inside each text: starts and ends relative to their texts, and how many a text has."""
    first = np.zeros(len(gone) + 1, bool)
    first[offsets] = True
    was, now = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
    start = np.flatnonzero(now & (~was | first))
    end = np.flatnonzero(was & (~now | first))
    text = np.searchsorted(offsets, start, "right") - 1
    return start - offsets[text], end - offsets[text], np.bincount(text, minlength=len(offsets) - 1)


def remove_words(text_column: str, window: int):
    def run(_: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        row, answers = received(replies, docs["_ps_key"].to_numpy(), _ANSWER)
        data, sizes, n_words, n_removed, starts, ends, counts = [], [], [], [], [], [], []
        for t in B.texts(docs[text_column]):
            w = B.words(t)
            a, b = np.searchsorted(row, (t.first, t.first + len(t)))
            start = w.offsets[row[a:b] - t.first] + answers["at"][a:b]
            gone = covered(len(w), start, start + window)
            out, offsets = join_words(w, ~gone)
            data.append(out)
            sizes.append(np.diff(offsets))
            n_words.append(np.diff(w.offsets))
            n_removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[w.offsets]))
            for to, x in zip((starts, ends, counts), spans_of(gone, w.offsets), strict=True):
                to.append(x)
        joined, offsets = np.concatenate([np.zeros(0, np.uint8), *data]), offsets_of(sizes)
        kept = pa.LargeStringArray.from_buffers(docs.num_rows, pa.py_buffer(offsets), pa.py_buffer(joined))
        rest = plain_columns(docs)
        i = rest.schema.get_field_index(text_column)
        rest = rest.set_column(i, text_column, kept.cast(rest.schema.field(i).type))
        spans = lists_of([cat(starts), cat(ends)], offsets_of(counts), ("start", "end"))
        return add_columns(rest, n_words=cat(n_words), n_removed=cat(n_removed), removed=spans)

    return run


def cat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)


def offsets_of(sizes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(cat(sizes))]).astype(np.int64)


def plain_columns(docs: pa.Table) -> pa.Table:
    return docs.select([c for c in docs.column_names if not c.startswith("_ps_")])


def add_columns(docs: pa.Table, **columns) -> pa.Table:
    for name, values in columns.items():
        docs = docs.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return docs


def meet(docs: DataFrame, replies: DataFrame, run, schema) -> DataFrame:
    """Each home's texts with the answers sent there."""
    return docs.groupBy("_ps_home").cogroup(replies.groupBy("bucket")).applyInArrow(run, schema)


def dealt(docs: DataFrame, homes: int, id_column: str, text_column: str, drop: tuple[str, ...]) -> DataFrame:
    """The one exchange of the texts: rows by home, with their key and their place in the order beside all columns.

    Empty texts, which may all repeat one row, are dealt out evenly: nothing is ever sent to them.
    """
    order = F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1))
    keyed = docs.drop(*drop).select("*", row_key(id_column, text_column).alias("_ps_key"), order.alias("_ps_order"))
    place = F.when(F.octet_length(F.col(text_column).cast("string")) > 0, F.col("_ps_key")).otherwise(F.monotonically_increasing_id())
    return keyed.withColumn("_ps_home", F.pmod(place, F.lit(homes)).cast("int")).repartition("_ps_home")


def schema_with(docs: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in docs.schema.fields if f.name not in added), *(T.StructField(c, k) for c, k in added.items())])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def dedup_windows(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with every word gone that an earlier-seen window of ``window`` words covers.

    The text becomes the kept words joined by one space; n_words, n_removed and
    removed (word spans) are added, replacing columns of these names.  "Earlier"
    is a smaller id (null ids last) or, in one document, an earlier start; rows
    that repeat the same id and text get the same result, and equal windows at
    the same start of rows with the same id don't remove each other.  Null and
    empty texts have no words; an empty table stays empty.
    """
    n = buckets(docs.sparkSession, text_bytes(docs, text_column), BUCKET_BYTES)
    keyed = docs.select(row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    answer = block_schema(_ANSWER)
    anchors = keyed.mapInArrow(send_anchors(n, window), block_schema(_ANCHOR)).groupBy("bucket").applyInArrow(answer_repeats(n), answer)
    added = {"n_words": T.LongType(), "n_removed": T.LongType(), "removed": SPANS}
    texts = dealt(docs, n, id_column, text_column, tuple(added))
    asked = meet(texts, anchors, send_windows(n, window, text_column), block_schema(_WINDOW, _ORDER))
    firsts = asked.groupBy("bucket").applyInArrow(answer_firsts(n), answer)
    return meet(texts, firsts, remove_words(text_column, window), schema_with(docs, **added))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with w as (
  select doc_id, i, ws[i] as word, len(ws) as n,
         case when i + 19 <= len(ws) then md5(array_to_string(ws[i:i+19], chr(32))) end as win
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents))),
f as (select doc_id, i, word, n, win is not null
        and row_number() over (partition by win order by doc_id, i) > 1 as dup from w),
c as (select doc_id, i, word, n, bool_or(dup) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from f)
select d.doc_id, coalesce(max(n), 0) as n_words, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept_sha256
from documents d left join c on d.doc_id = c.doc_id group by d.doc_id
"""
