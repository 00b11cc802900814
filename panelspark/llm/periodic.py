"""Periodic runs of words, found by suffix trees and Lyndon roots.

A run is a maximal stretch of words with smallest period q and a length of at
least max(MIN_WORDS, MIN_TIMES * q).  Each document is handled in its own task by
itself:

1. Ukkonen's suffix trees of the document and of its reversal are built, and an
   Euler tour of each turns the longest common extension of two places, forwards
   or backwards, into a range minimum, answered in constant time.
2. The order of the suffixes gives at each place the longest Lyndon word that
   starts there, for the order of symbols and for its reverse.  Each run holds
   such a root at one of its places, so these at most two candidates a place
   are extended both ways, and those that reach the length are the runs.

Words that no run can touch don't enter the trees: inside a run of at least six
words and four periods every sequence of three words occurs at least three times,
so a document is cut where one doesn't, until nothing changes, and each piece cut
out stands in the trees as one symbol of its own.  No run crosses a cut, so the
runs are those of the whole document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import table

MIN_WORDS, MIN_TIMES = 6, 4
_BLOCK = 16
_RUN = ("start", "length", "period")


class RangeMinimum:
    """Minima of ranges in constant time: a sparse table over blocks, and running minima inside them."""

    def __init__(self, values: np.ndarray):
        self.blocks = np.full((len(values) // _BLOCK + 1, _BLOCK), np.iinfo(np.int32).max, np.int32)
        self.blocks.reshape(-1)[: len(values)] = values
        self.left = np.minimum.accumulate(self.blocks, axis=1).reshape(-1)
        self.right = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [self.blocks.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= len(self.blocks):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value from a to b, both included."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.right[a], self.left[b])
        same = np.flatnonzero(first == last)
        if len(same):
            place = np.arange(_BLOCK)
            inside = (place >= (a[same] % _BLOCK)[:, None]) & (place <= (b[same] % _BLOCK)[:, None])
            out[same] = np.where(inside, self.blocks[first[same]], np.iinfo(np.int32).max).min(axis=1)
        width = last - first - 1
        for k, level in enumerate(self.levels):
            at = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
            if len(at):
                out[at] = np.minimum(out[at], np.minimum(level[first[at] + 1], level[last[at] - (1 << k)]))
        return out


class SuffixTree:
    """Ukkonen's tree of a sequence whose last symbol occurs nowhere else."""

    def __init__(self, s: list[int]):
        self.n = len(s)
        self._grow(s)
        self._tour()

    def _grow(self, s: list[int]) -> None:
        n = self.n
        start, end, link, children = [0], [0], [0], [{}]  # the root; a leaf has no children and ends with the sequence
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            waits = 0  # the node whose suffix link is the next one made or met
            while rest:
                if not length:
                    edge = i
                here = children[node]
                child = here.get(s[edge])
                if child is None:
                    here[s[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    children.append(None)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    low = start[child]
                    size = end[child] - low
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[low + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    split, leaf = len(start), len(start) + 1
                    here[s[edge]] = split
                    start[child] = low + length
                    start += (low, i)
                    end += (low + length, n)
                    link += (0, 0)
                    children += ({c: leaf, s[low + length]: child}, None)
                    if waits:
                        link[waits] = split
                    waits = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.start, self.end, self.children = start, end, children

    def _tour(self) -> None:
        """The Euler tour as depths in symbols, the place of each suffix in it, and the suffixes in order."""
        start, end, children, n = self.start, self.end, self.children, self.n
        depth, tour, order, place = [0] * len(start), [], [], [0] * n
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:  # back at a node of that depth
                tour.append(~node)
                continue
            below = children[node]
            d = depth[node]
            if below is None:
                order.append(n - d)
                place[n - d] = len(tour)
                tour.append(d)
                continue
            tour.append(d)
            for symbol in sorted(below, reverse=True):
                child = below[symbol]
                depth[child] = d + end[child] - start[child]
                stack += (~d, child)
        self.order, self.place, self.minima = order, np.array(place), RangeMinimum(np.array(tour, np.int32))
        del self.start, self.end, self.children

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols agree from places a and b on (two different places)."""
        return self.minima.least(self.place[a], self.place[b])


def next_lower(rank: list[int]) -> list[int]:
    """For each place the next one of lower rank; the number of places where there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(symbols: list[int], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; min_times is 2 at least, symbols aren't negative."""
    n = len(symbols)
    if n < min_words:
        return np.zeros((0, 3), np.int64)
    forward, backward = SuffixTree([*symbols, -1]), SuffixTree([*symbols[::-1], -1])
    rank = np.zeros(n + 1, np.int64)
    rank[forward.order] = np.arange(n + 1)
    i = np.tile(np.arange(n), 2)
    j = np.array(next_lower(rank.tolist())[:n] + next_lower((-rank).tolist())[:n])
    root = (j <= n) & ((j - i) * min_times <= n)
    i, j = i[root], j[root]
    ahead, back = forward.common(i, j), backward.common(n - i, n - j)
    start, period = i - back, j - i
    length = j + ahead - start
    found = length >= np.maximum(min_words, min_times * period)
    return np.unique(np.stack([start, period, length], axis=1)[found], axis=0)[:, [0, 2, 1]]


def fit_for_runs(h: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """Places, rising, of the words that a run can touch (h: hash of each word, owner: its text)."""
    least = max(1, min(max(min_words, min_times) - 2, min_times - 1))  # of period 1, and of longer ones
    at, piece = np.arange(len(h)), owner.astype(np.uint64)
    while len(at) >= min_words:
        x = h[at]
        first = np.flatnonzero((piece[2:] == piece[:-2]) & (at[2:] == at[:-2] + 2))
        key = B.mix(B.mix(x[first] + B.mix(x[first + 1] + B.mix(x[first + 2], 31), 32), 33) + piece[first], 34)
        order = np.argsort(key)
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), np.diff(key[order]) > 0]))
        times = np.diff(np.append(new, len(key)))
        often = first[order[np.repeat(times >= least, times)]]
        covered = np.zeros(len(at), bool)
        for k in range(3):
            covered[often + k] = True
        kept = np.flatnonzero(covered)
        where, whose = at[kept], piece[kept]
        begins = np.concatenate([np.ones(min(1, len(kept)), bool), (np.diff(where) > 1) | (whose[1:] != whose[:-1])])
        number = np.cumsum(begins) - 1
        enough = (np.bincount(number) >= min_words)[number] if len(number) else np.zeros(0, bool)
        if enough.sum() == len(at):
            return at
        at, piece = where[enough], number[enough].astype(np.uint64)
    return at[:0]


def runs_by_text(w: B.Words, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> Iterator[tuple[int, np.ndarray]]:
    """The texts that have runs, and their runs."""
    owner = w.owner()
    at = fit_for_runs(w.hash, owner, min_words, min_times)
    if not len(at):
        return
    _, symbol = np.unique(w.hash[at], return_inverse=True)
    own = owner[at]
    bounds = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(at))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        here = at[a:b]
        cut = np.flatnonzero(np.diff(here) > 1) + 1  # before these words something was cut out
        symbols = np.insert(symbol[a:b], cut, len(at) + np.arange(len(cut)))
        place = np.insert(here, cut, -1)
        found = runs_of(symbols.tolist(), min_words, min_times)
        if len(found):
            text = int(own[a])
            found[:, 0] = place[found[:, 0]] - w.offsets[text]
            yield text, found


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed, the words left joined by one space.

    A word is left out if a run holds it after that run's first period.  A null,
    empty or wordless text has no words, no runs and an empty collapsed text.
    Rows that repeat each other get the same result, ids may be null, other
    columns are not looked at, and an empty table gives no rows.  Time and memory
    grow with a text's length only, whatever repeats in it.
    """
    if min_times < 2 or min_words < 3:
        raise ValueError("a run must hold its period twice, and three words, at least")
    kind = docs.select(F.col(id_column).alias("doc_id")).schema["doc_id"]
    run_type = pa.struct([(c, pa.int64()) for c in _RUN])
    runs = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _RUN]))
    schema = T.StructType([kind, T.StructField("n_words", T.LongType()), T.StructField("runs", runs), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in B.texts(batch["text"]):
                w = B.words(t)
                kept = np.ones(len(w), bool)
                found: list[list] = [[] for _ in range(len(t))]
                for text, rows in runs_by_text(w, min_words, min_times):
                    found[text] = [dict(zip(_RUN, r, strict=True)) for r in rows.tolist()]
                    first = int(w.offsets[text])
                    edges = np.zeros(int(w.offsets[text + 1]) - first + 1, np.int64)
                    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
                    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
                    kept[first : first + len(edges) - 1] = np.cumsum(edges)[:-1] == 0
                n_kept = np.diff(np.concatenate([[0], np.cumsum(kept)])[w.offsets])
                data, offsets = B.join_pieces(t.data, w.start[kept], w.end[kept], n_kept, 0x20)
                collapsed = pa.LargeStringArray.from_buffers(len(t), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                columns = [batch["doc_id"].slice(t.first, len(t)), pa.array(np.diff(w.offsets)), pa.array(found, pa.list_(run_type)), collapsed]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten (by a hash of its id) ends in repetitions, as op12's contract sets them.

    The words of a text come out joined by one space.  A null id leaves a text as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in B.texts(batch["text"]):
                own, w = batch["doc_id"].slice(t.first, len(t)), B.words(t)
                source = np.arange(len(w))
                for i, first, end in zip(own.to_pylist(), w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
                    h = 1 if i is None else zlib.crc32(str(i).encode())
                    if h % 10 == 0 and end > first:
                        g, n = h // 10, end - first
                        a = g % n
                        source[first + a : end] = first + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
                data, offsets = B.join_pieces(t.data, w.start[source], w.end[source], np.diff(w.offsets), 0x20)
                text = pa.LargeStringArray.from_buffers(len(t), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([own, text], names=["doc_id", "text"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, plain.schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_ends(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 bit by bit; runs as stretches where sequences of three words agree q words apart, the smallest q of each.
ORACLE = r"""
with d as (select doc_id, cast(doc_id as varchar) as s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
h as (select doc_id, w, len(w) as n, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), range(8 * len(s))), lambda c, k:
        xor((case when k % 8 = 0 then xor(c, ascii(s[k // 8 + 1])) else c end) >> 1,
            case when (case when k % 8 = 0 then xor(c, ascii(s[k // 8 + 1])) else c end) % 2 = 1 then 3988292384 else 0 end))) as h from d),
g as (select *, case when n > 0 then (h // 10) % n end as a, 3 + (h // 10) % 8 as m from h),
t as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // m) end]) else w end as w from g),
k as (select doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as three from (select *, unnest(range(n - 2)) as i from t)),
o as (select doc_id, n, list(i) as places from k group by doc_id, n, three having count(*) >= 3),
e as (select doc_id, i, j - i as q from (select doc_id, n, i, unnest(places) as j from (select *, unnest(places) as i from o)) where j > i and 4 * (j - i) <= n),
f as (select doc_id, q, min(i) as start, count(*) + 2 + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from e) group by doc_id, q, island),
r as (select doc_id, start, length, min(q) as period from f where length >= greatest(6, 4 * q) group by doc_id, start, length),
b as (select doc_id, count(*) as n_runs, first(struct_pack(start := start, length := length, period := period) order by length desc, start, period) as best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from r group by doc_id),
x as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
c as (select v.doc_id, string_agg(v.word, ' ' order by v.i) as kept from (select doc_id, unnest(range(n)) as i, unnest(w) as word from t) v anti join x using (doc_id, i) group by v.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli,
       sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join b using (doc_id) left join c using (doc_id)
"""
