"""Repeated byte strings by a depth-limited most-significant-digit sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes, digit by digit,
and a group of one is dropped at each pass.  Two passes go before the bytes, to
keep one suffix per byte of text out of the shuffle:

1. the minimiser of the window, a gram of ``depth - reach + 1`` bytes.  Windows
   with the same minimiser at the same place follow each other, so a whole run
   of suffixes is one entry, and a run whose gram occurs once is dropped;
2. the run's bytes and place.  A run that occurs twice is settled as a whole;
   only runs that share their gram but not their bytes go on, with one
   representative of each settled run of that gram.

What is left is radix-sorted where its text lies, by the suffixes' bytes, eight
to a digit, from the most significant one to ``depth``: the groups left after
the last pass are exactly the windows repeated there.  One suffix of each
distinct window then meets those of other places in the bucket of its window, by
two fingerprints modulo a prime, at bases of their own.

A task settles what repeats in its own flush, and a gram that it meets with
different runs costs the gram's bucket two entries, however many runs there are.
Texts are shuffled once.
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
from panelspark.llm.exchange import ASK, COUNT, ECHO, FLUSH_ENTRIES, Outbox, arrow_schema, block_schema, bucket_of, pack, received, reply, runs, spread, unpack
from panelspark.llm.substrings import SPANS, add_columns, cat, covered, dealt, lists_of, meet, offsets_of, plain_columns, schema_with, spans_of

DEPTH = 400
BUCKET_BYTES = 16 << 20

_RUN = {"gram": "u4", "run": "u8", "at": "i4", "size": "i4", "state": "u1"}
_SUFFIX = {"fp": "u8", "at": "i4", "state": "u1"}
#: What becomes of a run: it repeats as a whole, its suffixes are sorted, or both (a representative of settled runs).
_SETTLED, _SORT, _BOTH = 1, 2, 3
#: States beyond those of the exchange: a gram with different runs in one flush; and echoes of decisions but _SETTLED.
MARK, ECHO_SORT, ECHO_BOTH = 3, 4, 5
_DIGIT_BYTES = 8
#: First suffix, number of suffixes, and what to do with them.
_ANSWER = {"at": "i4", "size": "i4", "what": "u1"}


def reach_of(depth: int) -> int:
    """Grams that compete for a window's minimiser: a sixth of the depth."""
    return max(1, depth // 6)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : n + width - 1])


def suffix_runs(t: B.Texts, depth: int) -> tuple[np.ndarray, ...]:
    """gram hash, run hash, first suffix, number of suffixes and text of each run."""
    reach = reach_of(depth)
    size = depth - reach + 1
    n = len(t.data)
    count = np.maximum(np.diff(t.offsets) - depth + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = B.prefix_hash(B._BYTE_VALUE[t.data])
    place = np.arange(n - size + 1)
    grams = B.span_hash(prefix, slice(0, n - size + 1), slice(size, n + 1))
    # 32 bits of the gram, then the place: the leftmost of equal grams
    least = sliding_min((grams & ~np.uint64(0xFFFFFFFF)) | place.astype(np.uint64), reach) & np.uint64(0xFFFFFFFF)
    text = np.repeat(np.arange(len(t)), count)
    start = np.repeat(t.offsets[:-1] - np.cumsum(count) + count, count) + np.arange(total)
    own = least[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
    length = np.diff(np.append(first, total))
    s, p, text = start[first], own[first], text[first]
    run = B.mix(B.span_hash(B.prefix_hash(B._BYTE_VALUE[t.data], True), s, s + length - 1 + depth, 2) ^ B.mix((p - s).astype(np.uint64), 11), 12)
    return grams[p], run, s - t.offsets[text], length, text


def combine_runs(n_buckets: int):
    """Settles what one flush can.

    Equal runs are settled, and the first of them asks for all and counts as
    two.  Where a gram has different runs, all are to be sorted whatever others
    hold, so they need no answer: two marks tell the gram's bucket.
    """

    def step(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        gram = (e["bucket"].astype(np.uint64) << np.uint64(32)) | e["gram"]
        order = np.lexsort((e["run"], gram))
        gram, run = gram[order], e["run"][order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (gram[1:] != gram[:-1]) | (run[1:] != run[:-1]))))
        length = np.diff(np.append(first, len(order)))
        of_gram = runs(gram[first])
        kinds = np.diff(np.append(of_gram, len(first)))
        mixed = np.repeat(kinds, kinds) > 1
        state = np.full(len(order), ECHO, np.uint8)
        state[first] = np.where(mixed, np.where(length > 1, ECHO_BOTH, ECHO_SORT), np.where(length > 1, COUNT, ASK))
        e["state"][order] = state
        two = of_gram[kinds > 1]
        mark = order[first[np.concatenate([two, two + 1])]]
        marks = {c: v[mark] for c, v in e.items()}
        marks["state"] = np.full(len(mark), MARK, np.uint8)
        echo = ~np.isin(e["state"], (ASK, COUNT))
        e["bucket"] = np.where(echo, spread(e["owner"], e["at"], n_buckets), e["bucket"])
        return {c: np.concatenate([v, marks[c]]) for c, v in e.items()}

    return step


def answer_runs(homes: int):
    """Runs that may repeat, to the homes of their texts."""

    def step(_: tuple, blocks: pa.Table) -> pa.Table:
        e = unpack(blocks, _RUN)
        what = judge_runs(e)
        yes = what > 0
        return reply(e["owner"][yes], homes, _ANSWER, at=e["at"][yes], size=e["size"][yes], what=what[yes])

    return step


def judge_runs(e: dict[str, np.ndarray]) -> np.ndarray:
    """What to do with each run: nothing (it is unique, or a mark), or one of the three above."""
    what = np.select([e["state"] == s for s in (ECHO, ECHO_SORT, ECHO_BOTH)], [_SETTLED, _SORT, _BOTH], 0)
    asks = np.flatnonzero(np.isin(e["state"], (ASK, COUNT, MARK)))
    order = asks[np.lexsort((e["state"][asks] == MARK, e["run"][asks], e["gram"][asks]))]  # marks last among equal runs
    gram, run, asked = e["gram"][order], e["run"][order], e["state"][order] != MARK
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (gram[1:] != gram[:-1]) | (run[1:] != run[:-1]))))
    length = np.diff(np.append(new, len(order)))
    many = np.add.reduceat(asked.astype(np.int64), new) > 1 if len(new) else np.zeros(0, bool)
    many |= e["state"][order[new]] == COUNT
    kinds = np.diff(np.append(runs(gram[new]), len(new)))
    mixed = np.repeat(kinds, kinds) > 1
    what[order] = np.where(asked, np.repeat(np.where(many, _SETTLED, np.where(mixed, _SORT, 0)), length), 0)
    both = order[new[many & mixed]]
    what[both] = _BOTH
    return what


def send_runs(n_buckets: int, depth: int, flush_entries: int = FLUSH_ENTRIES):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(_RUN, combine=combine_runs(n_buckets), flush_entries=flush_entries)
        for batch in batches:
            keys = batch["key"].to_numpy(zero_copy_only=False)
            for t in B.texts(batch["text"]):
                gram, run, at, size, text = suffix_runs(t, depth)
                yield from box.add(bucket=bucket_of(gram, n_buckets), owner=keys[t.first + text], gram=B.mix(gram, 13) >> np.uint64(32), run=run, at=at, size=size, state=np.full(len(at), ASK))
        yield from box.flush()

    return step


def radix_groups(data: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """The number of each suffix's group among those that share its first ``depth`` bytes; -1 for one alone.

    Sorts by most significant digits, and goes on only with groups of two or more.
    """
    padded = np.concatenate([data, np.zeros(_DIGIT_BYTES, np.uint8)])
    label = np.full(len(start), -1)
    alive, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for at in range(0, depth, _DIGIT_BYTES):
        digit = padded[(start[alive] + at)[:, None] + np.arange(_DIGIT_BYTES)].view(">u8").ravel().astype(np.uint64)
        digit >>= np.uint64(8 * max(0, at + _DIGIT_BYTES - depth))
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(alive)))
        keep = np.repeat(length > 1, length)
        alive, group = alive[keep], np.repeat(np.arange(len(first)), length)[keep]
        if not len(alive):
            break
    label[alive] = group
    return label


def combine_suffixes(n_buckets: int, label: np.ndarray):
    """Suffixes in one group of the sort are settled; the bucket gets one entry of them that counts as two."""

    def step(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.argsort(label, kind="stable")
        first = runs(label[order])
        first = first[label[order[first]] >= 0]
        mark = order[first]
        marks = {c: v[mark] for c, v in e.items()}
        marks["state"] = np.full(len(mark), 2 * COUNT, np.uint8)
        again = label >= 0
        keep = ~(again & (e["state"] == COUNT))
        echo = again & (e["state"] == ASK)
        e["state"] = np.where(echo, np.uint8(ECHO), e["state"])
        e["bucket"] = np.where(echo, spread(e["owner"], e["at"], n_buckets), e["bucket"])
        return {c: np.concatenate([v[keep], marks[c]]) for c, v in e.items()}

    return step


def answer_suffixes(homes: int):
    """Suffixes that share their first ``depth`` bytes with another, to the homes of their texts."""

    def step(_: tuple, blocks: pa.Table) -> pa.Table:
        e = unpack(blocks, _SUFFIX)
        counted = np.flatnonzero(e["state"] != ECHO)
        _, inverse = np.unique(e["fp"][counted], return_inverse=True)
        total = np.bincount(inverse, weights=np.where(e["state"][counted] == 2 * COUNT, 2, 1))
        yes = e["state"] == ECHO
        yes[counted] = (total[inverse] > 1) & (e["state"][counted] == ASK)
        n = int(yes.sum())
        return reply(e["owner"][yes], homes, _ANSWER, at=e["at"][yes], size=np.ones(n), what=np.full(n, _SETTLED))

    return step


def send_suffixes(n_buckets: int, depth: int, text_column: str, flush_entries: int = FLUSH_ENTRIES):
    """Radix-sorts the suffixes that are left in a home, some texts at a time, and sends one of each window."""

    def step(_: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        out, held, data, size = [], [], [], 0

        def flush() -> None:
            if held:
                e = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                label = radix_groups(np.concatenate(data), e.pop("place"), depth)
                out.append(pack(combine_suffixes(n_buckets, label)(e), _SUFFIX))
                held.clear()
                data.clear()

        if docs.num_rows and replies.num_rows:
            keys = docs["_ps_key"].to_numpy()
            row, x = received(replies, keys, _ANSWER)
            keep = x["what"] != _SETTLED
            row, first, count, what = row[keep], *(x[c][keep].astype(np.int64) for c in ("at", "size", "what"))
            for t in B.texts(docs[text_column]):
                a, b = np.searchsorted(row, (t.first, t.first + len(t)))
                if a == b:
                    continue
                n = count[a:b]
                text = np.repeat(row[a:b] - t.first, n)
                at = np.repeat(first[a:b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                # a representative of settled runs needs no answer
                state = np.repeat(np.where(what[a:b] == _BOTH, COUNT, ASK), n).astype(np.uint8)
                start = t.offsets[text] + at
                one, two = (B.span_hash(B.prefix_hash(B._BYTE_VALUE[t.data], other), start, start + depth, 3) for other in (False, True))
                held.append({"bucket": bucket_of(one, n_buckets), "owner": keys[t.first + text], "fp": two, "at": at.astype(np.int32), "state": state, "place": start + sum(map(len, data))})
                data.append(t.data)
                size += len(start)
                if size >= flush_entries:
                    flush()
                    size = 0
            flush()
        return pa.Table.from_batches(out, schema=arrow_schema(_SUFFIX))

    return step


def remove_bytes(depth: int, text_column: str):
    def step(_: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        row, x = received(replies, docs["_ps_key"].to_numpy(), _ANSWER)
        keep = x["what"] != _SORT
        row, first, count = row[keep], x["at"][keep].astype(np.int64), x["size"][keep].astype(np.int64)
        data, sizes, n_bytes, n_removed, starts, ends, counts = [], [], [], [], [], [], []
        for t in B.texts(docs[text_column]):
            a, b = np.searchsorted(row, (t.first, t.first + len(t)))
            start = t.offsets[row[a:b] - t.first] + first[a:b]
            gone = covered(len(t.data), start, start + count[a:b] - 1 + depth)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[t.offsets])
            data.append(t.data[~gone])
            n_bytes.append(np.diff(t.offsets))
            n_removed.append(removed)
            sizes.append(np.diff(t.offsets) - removed)
            for to, v in zip((starts, ends, counts), spans_of(gone, t.offsets), strict=True):
                to.append(v)
        joined = np.concatenate([np.zeros(0, np.uint8), *data])
        kept = pa.Array.from_buffers(pa.large_binary(), docs.num_rows, [None, pa.py_buffer(offsets_of(sizes)), pa.py_buffer(joined)]).cast(pa.binary())
        spans = lists_of([cat(starts), cat(ends)], offsets_of(counts), ("start", "end"))
        return add_columns(plain_columns(docs), kept=kept, n_bytes=cat(n_bytes), n_removed=cat(n_removed), n_spans=cat(counts), removed=spans)

    return step


def dedup_bytes(docs: DataFrame, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text", flush_entries: int = FLUSH_ENTRIES) -> DataFrame:
    """docs plus the bytes left once every ``depth``-byte string that also starts elsewhere is gone.

    Adds kept (binary), n_bytes, n_removed, n_spans (maximal removed runs) and
    removed (byte spans), replacing columns of these names.  All texts are
    judged as given, with rows as documents; matches never cross documents,
    overlapping ones count, and null and empty texts hold nothing.  Repeated
    rows repeat each other.  An empty table stays empty.
    """
    n = buckets(docs.sparkSession, text_bytes(docs, text_column), BUCKET_BYTES)
    keyed = docs.select(row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    answer = block_schema(_ANSWER)
    candidates = keyed.mapInArrow(send_runs(n, depth, flush_entries), block_schema(_RUN)).groupBy("bucket").applyInArrow(answer_runs(n), answer)
    added = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "removed": SPANS}
    texts = dealt(docs, n, id_column, text_column, tuple(added))
    asked = meet(texts, candidates, send_suffixes(n, depth, text_column, flush_entries), block_schema(_SUFFIX))
    repeated = asked.groupBy("bucket").applyInArrow(answer_suffixes(n), answer)
    return meet(texts, candidates.unionByName(repeated), remove_bytes(depth, text_column), schema_with(docs, **added))


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
with b as (select doc_id, x, octet_length(x) as n from (select doc_id, encode(coalesce(text, '')) as x from documents) a),
p as (select doc_id, i, md5(array_slice(x, i, i + 399)) as w, i + 399 <= n as whole, hex(array_slice(x, i, i)) as byte from (select *, unnest(range(1, n + 1)) as i from b) c),
r as (select doc_id, i, byte, whole and count(*) filter (whole) over (partition by w) > 1 as again from p),
g as (select doc_id, i, byte, bool_or(again) over (partition by doc_id order by i rows between 399 preceding and current row) as gone from r),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as first from g)
select b.doc_id, b.n as n_bytes, count(*) filter (gone) as n_removed, count(*) filter (first) as n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (not gone), ''))) as kept_sha256
from b left join s on s.doc_id = b.doc_id group by b.doc_id, b.n
"""
