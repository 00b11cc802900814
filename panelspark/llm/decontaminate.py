"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts become words (runs of letters and digits, A-Z lower-cased).  The CGK
random walk reads a window of words: at each step it writes the word under it
and moves on or stays, as a random bit of (step, word) says.  Two windows that
differ by a few insertions, deletions or replacements soon walk in step again,
so their walks differ in few places (edit distance becomes Hamming distance).
Each repetition walks with its own random bits and samples some steps as its
key; the repetitions together reach the target recall.

Keys of the benchmark are indexed at the starts of an item.  An item of twenty
words or more has many of them, so documents look up every ``stride``-th start
for these; items of twelve words or more are looked up at every start, by walks
that fit their length.  The settings of each length aim at 99 % of the passages
with exactly as many edits as the similarity allows.  Shorter items have an exact
way instead: of e + 1 parts of an item, e edits leave one whole, so its words
stand in the document as they are.
A look-up proposes an alignment of the whole item with the document, and the
exact edit distance of the item, whole however long, against that item-sized
window decides.

The benchmark goes to the tasks in blocks bounded by items and bytes, one pass
over the documents per block; nothing that grows with the documents is sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import table

#: Items sent to the tasks at once, and bytes of their texts (about; an item is never cut).
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
STEPS = 16
SAMPLED = 7
REPETITIONS = 8
#: Steps, sampled steps, repetitions and stride for items of SHORT_WORDS to LONG_WORDS words.
SHORT_WORDS, LONG_WORDS = 12, 20
MIDDLE = (12, 5, 6, 1)
#: Alignments proposed at once, and cells of a whole table of edits; larger ones are worked through in bands.
PROPOSALS, CELLS = 1 << 18, 1 << 20
STRIDE = 2
#: Words of at most so many items count as rare.
RARE_ITEMS = 3
SIMILARITY = 0.8

#: One random odd factor per step (steps are at most 16, one random bit each).
_STEP_VALUE = B.mix(np.arange(16, dtype=np.uint64), 31) | np.uint64(1)
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[0x30:0x3A] = _NOT_WORD[0x41:0x5B] = _NOT_WORD[0x61:0x7B] = False
_NOT_WORD[0x80:] = False


def normal_words(t: B.Texts) -> B.Words:
    return B.words(t, lower=True, separator=_NOT_WORD)


def walk_keys(h: np.ndarray, start: np.ndarray, steps: int = STEPS, sampled: int = SAMPLED, repetitions: int = REPETITIONS) -> np.ndarray:
    """Keys (repetition by start) of the walks from each start over word hashes h; past the end lie blanks."""
    h = np.append(h, np.zeros(steps + 1, np.uint64))
    out = np.zeros((repetitions, len(start)), np.uint64)
    for r in range(repetitions):
        if r % 4 == 0:
            word = B.mix(h, 200 + r)
            word[-steps - 1 :] = 0
        bits = (word >> np.uint64(16 * (r % 4))).astype(np.uint16)
        picks = set(np.random.default_rng(r).choice(steps, sampled, replace=False).tolist())
        place, key = start.copy(), np.zeros(len(start), np.uint64)
        for step in range(max(picks) + 1):
            if step in picks:
                key += h[place] * _STEP_VALUE[step]
            place += (bits[place] >> np.uint16(step)) & np.uint16(1)
        out[r] = key
    return out


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn item into a stretch of window: the edits, and that stretch's start and end."""
    n = len(window)
    place = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), place.copy()
    for i, word in enumerate(item):
        # (cost, origin) of each place: replace or keep, leave the item's word out, or take in window words
        put, left_out = cost[:-1] + (window != word), cost + 1
        new = left_out.copy()
        came = origin.copy()
        better = put < new[1:]
        new[1:] = np.where(better, put, new[1:])
        came[1:] = np.where(better, origin[:-1], came[1:])
        reach = np.minimum.accumulate(new - place) + place
        longer = reach < new
        if longer.any():
            source = np.maximum.accumulate(np.where(longer, 0, place))
            came = came[source]
        cost, origin = reach, came
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def banded_distance(item: np.ndarray, window: np.ndarray, begin: int, allowed: int) -> tuple[int, int, int]:
    """As edit_distance, for long items that begin near ``begin``: in bands of diagonals that widen until allowed edits are enough, or all are tried."""
    never = len(item) + 1
    width = 32
    while True:
        low, m = begin - width, 2 * width + 1
        padded = np.concatenate([np.zeros(max(0, -low), np.uint64), window, np.zeros(max(0, low + m + len(item) - len(window)), np.uint64)])
        at, place = low + max(0, -low), np.arange(m)
        diagonal = low + place
        inside = lambda i, d=diagonal: (d + i >= 0) & (d + i <= len(window))
        cost, origin = np.where(inside(0), 0, never), diagonal.copy()
        for i, word in enumerate(item):
            put = np.where(inside(i) & (diagonal + i < len(window)), cost + (padded[at + i : at + i + m] != word), never)
            left_out = np.append(cost[1:] + 1, never)
            better = left_out < put
            new, came = np.where(better, left_out, put), np.where(better, np.append(origin[1:], 0), origin)
            new = np.where(inside(i + 1), new, never)
            reach = np.minimum.accumulate(new - place) + place
            longer = reach < new
            if longer.any():
                came = came[np.maximum.accumulate(np.where(longer, 0, place))]
            cost, origin = np.where(inside(i + 1), np.minimum(reach, never), never), came
        best = int(np.argmin(cost))
        if cost[best] <= allowed or width >= begin + len(window):
            return int(cost[best]), int(origin[best]), int(diagonal[best]) + len(item)
        width *= 4


class Lookup:
    """Distinct items of one class of lengths, and sorted tables of keys with the item and the place in it of each, behind bitmaps."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        ids: dict[bytes, list[int]] = {}
        for i, h in items:
            ids.setdefault(h.tobytes(), []).append(i)
        self.ids, self.hashes = list(ids.values()), [np.frombuffer(h, np.uint64) for h in ids]
        self.length = np.array([len(h) for h in self.hashes], np.int64)
        self.flat = np.concatenate(self.hashes)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        # words of few items, and how many stand in each item: an edit each, but for those that a window holds as many of
        owner = np.repeat(np.arange(len(self.length)), self.length)
        word, inverse = np.unique(self.flat, return_inverse=True)
        in_items = np.bincount(np.unique(np.stack([inverse, owner], axis=1), axis=0)[:, 0], minlength=len(word))
        self.rare_words = word[in_items <= RARE_ITEMS]
        self.rare = np.bincount(owner, weights=in_items[inverse] <= RARE_ITEMS, minlength=len(self.length)).astype(np.int64)
        self.tables: list[tuple] = []

    def add_table(self, key: np.ndarray, item: np.ndarray, start: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        shift = np.uint64(64 - max(16, int(np.ceil(np.log2(32 * len(key))))))
        known = np.zeros(1 << (64 - int(shift)), bool)
        known[key >> shift] = True
        self.tables.append((shift, known, key[order], item[order], start[order]))

    def look_up(self, table: tuple, key: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, the places where they would begin, and the place each came from, for the keys found at ``at``."""
        shift, bitmap, known, item, start = table
        hit = np.flatnonzero(bitmap[key >> shift])
        a = np.searchsorted(known, key[hit], "left")
        n = np.searchsorted(known, key[hit], "right") - a
        for part in np.split(np.arange(len(hit)), np.searchsorted(np.cumsum(n), np.arange(PROPOSALS, int(n.sum()), PROPOSALS))):
            count = n[part]
            where = np.repeat(a[part] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            source = np.repeat(at[hit[part]], count)
            yield item[where], source - start[where], source

    def propose(self, w: B.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raise NotImplementedError

    def words_within(self, item: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the item's words occur among h[lo:hi], for each pair."""
        size, length = np.maximum(hi - lo, 0), self.length[item]
        pair = B.mix(np.arange(len(item), dtype=np.uint64), 41)
        there = h[_ranges(lo, size)] ^ np.repeat(pair, size)
        wanted = self.flat[_ranges(self.first[item], length)] ^ np.repeat(pair, length)
        return np.bincount(np.repeat(np.arange(len(item)), length), weights=B.among(wanted, np.sort(there)), minlength=len(item)).astype(np.int64)


class Walks(Lookup):
    """Items looked up by sampled steps of CGK walks."""

    def __init__(self, items: list[tuple[int, np.ndarray]], steps: int, sampled: int, repetitions: int, stride: int):
        super().__init__(items)
        self.walk, self.stride = {"steps": steps, "sampled": sampled, "repetitions": repetitions}, stride
        # starts whose walk would mostly leave the item aren't indexed, but for the first
        starts = [np.arange(max(1, len(h) - steps // 2)) for h in self.hashes]
        keys = np.concatenate([walk_keys(h, s, **self.walk) for h, s in zip(self.hashes, starts, strict=True)], axis=1)
        item, start = np.repeat(np.arange(len(starts)), list(map(len, starts))), np.concatenate(starts)
        for k in keys:
            self.add_table(k, item, start)

    def propose(self, w: B.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        place = np.arange(len(w))
        at = place[(place - np.repeat(w.offsets[:-1], np.diff(w.offsets))) % self.stride == 0]
        for table, key in zip(self.tables, walk_keys(w.hash, at, **self.walk), strict=True):
            yield from self.look_up(table, key, at)


class Parts(Lookup):
    """Short items, looked up by parts of which the edits allowed leave one whole."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float):
        super().__init__(items)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (h, n) in enumerate(zip(self.hashes, self.length.tolist(), strict=True)):
            parts = int((1 - similarity) * n + 1e-9) + 1
            prefix = B.prefix_hash(h)
            for k in range(parts):
                a, b = k * n // parts, (k + 1) * n // parts
                found.setdefault(b - a, []).append((int(B.span_hash(prefix, np.array([a]), np.array([b]))[0]), i, a))
        self.sizes = sorted(found)
        for size in self.sizes:
            key, item, start = zip(*found[size], strict=True)
            self.add_table(np.array(key, np.uint64), np.array(item), np.array(start))

    def propose(self, w: B.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        prefix = B.prefix_hash(w.hash)
        left = np.repeat(w.offsets[1:], np.diff(w.offsets)) - np.arange(len(w))
        for size, table in zip(self.sizes, self.tables, strict=True):
            at = np.flatnonzero(left >= size)
            yield from self.look_up(table, B.span_hash(prefix, at, at + size), at)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def build_indexes(items: list[tuple[int, str]], stride: int = STRIDE, similarity: float = SIMILARITY) -> list[Lookup]:
    """One index for each class of lengths: LONG_WORDS or more, SHORT_WORDS or more, and fewer."""
    long, middle, short = [], [], []
    for t in B.texts(pa.array([text for _, text in items], pa.large_string())):
        w = normal_words(t)
        for i in range(len(t)):
            h = w.hash[w.offsets[i] : w.offsets[i + 1]]
            if len(h):
                (long if len(h) >= LONG_WORDS else middle if len(h) >= SHORT_WORDS else short).append((items[t.first + i][0], h))
    out: list[Lookup] = [Walks(some, *settings) for some, settings in ((long, (STEPS, SAMPLED, REPETITIONS, stride)), (middle, MIDDLE)) if some]
    return out + ([Parts(short, similarity)] if short else [])


_built: dict[str, list[Lookup]] = {}


def indexes_of(name: str, items: list[tuple[int, str]], stride: int, similarity: float) -> list[Lookup]:
    """The indexes of a block, built once for all tasks that a worker process runs in a row."""
    if name not in _built:
        _built.clear()
        _built[name] = build_indexes(items, stride, similarity)
    return _built[name]


def find_in(t: B.Texts, indexes: list[Lookup], similarity: float) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item_id, start, end, edits, item's words) of the best alignment of each item found in each text."""
    w = normal_words(t)
    out = []
    for index in indexes:
        best: dict[tuple[int, int], tuple] = {}
        rare = np.concatenate([[0], np.cumsum(B.among(w.hash, index.rare_words))])  # before each place
        held, size = [], 0
        for proposed in index.propose(w):
            held.append(proposed)
            size += len(proposed[0])
            if size >= PROPOSALS:
                check(w, index, similarity, rare, *map(np.concatenate, zip(*held, strict=True)), best)
                held, size = [], 0
        if size:
            check(w, index, similarity, rare, *map(np.concatenate, zip(*held, strict=True)), best)
        out += [(text, item_id, *found) for (text, item), found in best.items() for item_id in index.ids[item]]
    return out


def check(w: B.Words, index: Lookup, similarity: float, rare: np.ndarray, item: np.ndarray, begin: np.ndarray, source: np.ndarray, best: dict[tuple[int, int], tuple]) -> None:
    """Enters the proposals that hold into best: by text and item, (start, end, edits, item's words)."""
    text = np.searchsorted(w.offsets, source, "right") - 1
    allowed = ((1 - similarity) * index.length[item] + 1e-9).astype(np.int64)

    def window() -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(w.offsets[text], begin - allowed), np.minimum(w.offsets[text + 1], begin + index.length[item] + 2 * allowed + 1)

    lo, hi = window()
    may = np.flatnonzero((hi > lo) & (index.rare[item] - (rare[hi] - rare[lo]) <= allowed))
    text, item, begin, allowed = text[may], item[may], begin[may], allowed[may]
    order = np.lexsort((begin, item, text))
    text, item, begin, allowed = text[order], item[order], begin[order], allowed[order]
    keep, seen, upto = [], None, 0
    for o, k in enumerate(zip(text.tolist(), item.tolist(), strict=True)):
        if k != seen or begin[o] > upto:  # else within the edits allowed of one that is checked
            keep.append(o)
            seen, upto = k, int(begin[o] + allowed[o])
    text, item, begin, allowed = text[keep], item[keep], begin[keep], allowed[keep]
    lo, hi = window()
    shared = index.words_within(item, w.hash, lo, hi)
    # each word of the item that the window lacks is an edit
    for o in np.flatnonzero(index.length[item] - shared <= allowed).tolist():
        k, first, h = (int(text[o]), int(item[o])), int(w.offsets[text[o]]), w.hash[lo[o] : hi[o]]
        if k in best and best[k][2] == 0:
            continue
        mine = index.hashes[k[1]]
        edits, s, e = edit_distance(mine, h) if len(mine) * len(h) <= CELLS else banded_distance(mine, h, int(begin[o] - lo[o]), int(allowed[o]))
        if edits <= allowed[o] and (k not in best or edits < best[k][2]):
            best[k] = (int(lo[o]) + s - first, int(lo[o]) + e - first, edits, len(mine))


_FOUND = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
_FOUND_ARROW = pa.struct([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32()) for f in _FOUND.fields])


def with_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stride: int = STRIDE, block_items: int = BLOCK_ITEMS, text_column: str = "text") -> DataFrame:
    """docs plus passages (replacing a column of that name): what each row's text holds of benchmark items.

    A passage is item_id, start_word, end_word (of runs of letters and digits),
    edits, item_words; there is one for each item found.  An item of n
    words is found when at most ``(1 - similarity) * n`` word edits turn it, as a
    whole, into a stretch of the document; the exact check admits no false match
    (words are compared by 62-bit hashes).  Of several stretches the one with the
    fewest edits among those proposed is given; for long items (over CELLS cells)
    the one nearest to the proposal.  Items of the same text are all reported.
    Null or wordless texts and items match nothing; items with a null id are
    ignored.  Rows that repeat are searched each; other columns and null ids
    pass through; either table may be empty.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-(size["b"] or 0) // BLOCK_BYTES))
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    out = docs.drop("passages").withColumn("passages", F.array().cast(T.ArrayType(_FOUND)))
    for block in range(n_blocks):
        held = [(r["item_id"], r["text"]) for r in blocks.filter(F.col("block") == block).collect()]
        if not held:
            continue
        sent, name = spark.sparkContext.broadcast(held), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            indexes = indexes_of(name, sent.value, stride, similarity)
            for batch in batches:
                found = batch["passages"].to_pylist()
                for t in B.texts(batch[text_column]):
                    for x, *rest in find_in(t, indexes, similarity):
                        found[t.first + x].append(dict(zip(_FOUND.names, rest, strict=True)))
                at = batch.schema.get_field_index("passages")
                yield batch.set_column(at, "passages", pa.array(found, pa.list_(_FOUND_ARROW)))

        out = out.mapInArrow(run, out.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stride: int = STRIDE, block_items: int = BLOCK_ITEMS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The passages of :func:`with_passages`, a row for each: the document's id and the passage's fields."""
    plain = docs.select(F.col(id_column).alias(id_column), F.col(text_column).alias("text"))
    found = with_passages(plain, benchmark, similarity, stride, block_items)
    return found.select(id_column, F.explode("passages").alias("p")).select(id_column, "p.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "end_word", "edits", "item_words")
