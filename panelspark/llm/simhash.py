"""SimHash near duplicates through an inverted index of byte positions.

A fingerprint of 64 bits is eight bytes at eight positions.  Two fingerprints
that differ in at most k bits agree in at least 8 - k of these bytes.

1. Equal fingerprints are counted as one before anything is compared.
2. Of the first 3 + k positions such a pair shares at least three, so a list of
   the index holds all fingerprints with the same bytes at three of them.
3. A list that has grown long is dealt out anew by 8 - k positions, its own three
   among them: such a list holds at most 256 ** k fingerprints, whatever the
   input, and no key becomes hot.
4. In a list the positions that a pair shares are tallied; pairs that reach the
   guaranteed 8 - k are verified by their differing bits.  In the few lists of
   the second kind that are long still, every member looks up its neighbours, of
   which there is a fixed number.

A list reports its links as a star for each of its connected sets, never as all
pairs, and stars of all lists are joined to components in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import bytetext as B
from panelspark.llm.common import cut, forget, table
from panelspark.llm.components import components
from panelspark.llm.exchange import runs

WORDS, MAX_BITS, SEED = 3, 2, 42
#: Positions that make a list's key, and members from which a list is dealt out anew.
KEYED, LONG = 3, 512
_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text (count hashes each, in their order) the bits that over half of its hashes hold; none of no hashes."""
    some = np.flatnonzero(count)
    out = np.zeros(len(count), np.uint64)
    if not len(some):
        return out
    n = count[some]
    blocks = -(-n // 255)  # eight counters of one byte each hold 255 hashes
    of_text = np.cumsum(blocks) - blocks
    start = np.repeat(np.cumsum(n) - n, blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(of_text, blocks))
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, start)
        held = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        most = (2 * held > n[:, None]).astype(np.uint8)
        out[some] |= np.ascontiguousarray(most).view(np.uint64).reshape(-1) << np.uint64(bit)
    return out


def shingle_hashes(t: B.Texts, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of all texts, repeats included, and how many each text has."""
    w = B.words(t, lower=True)
    n = np.diff(w.offsets)
    joined, _ = B.join_pieces(w.data, w.start, w.end, n, 0x20)
    length = w.end - w.start
    start = np.cumsum(length + 1) - length - 1 - (np.cumsum(n > 0) - 1)[w.owner()]  # of texts, only the last word has no byte after it
    end = start + length
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.repeat(w.offsets[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    last = np.minimum(first + size, np.repeat(w.offsets[1:], count)) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first)), count


def fingerprints(docs: DataFrame, size: int = WORDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every row; a text without words has the fingerprint zero."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in B.texts(batch["text"]):
                prints = majority(*shingle_hashes(t, size, seed))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(t.first, len(t)), pa.array(B.signed(prints))], names=["doc_id", "fingerprint"])

    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def mask_of(positions: tuple[int, ...]) -> int:
    """The bits of these byte positions, as a signed long."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def index_entry(kind: int, positions: tuple[int, ...]) -> Column:
    """The list of one kind (a set of positions) in which a fingerprint stands."""
    return F.struct(F.lit(kind).cast("int").alias("kind"), F.col("fingerprint").bitwiseAND(F.lit(mask_of(positions))).alias("bytes"))


def inverted_index(prints: DataFrame, max_bits: int = MAX_BITS, long: int = LONG) -> DataFrame:
    """kind, bytes, fingerprint: a row for each list in which a fingerprint stands.

    Kinds below the number of short sets of positions are lists of three shared
    bytes; the others are those of 8 - max_bits, for the members of lists with
    more than ``long`` of them.
    """
    short = list(combinations(range(KEYED + max_bits), KEYED))
    deep = list(combinations(range(8), 8 - max_bits))
    entries = prints.select("fingerprint", F.explode(F.array(*(index_entry(k, p) for k, p in enumerate(short)))).alias("list")).select("fingerprint", "list.*")
    grown = entries.groupBy("kind", "bytes").agg(F.count("*").alias("n")).filter(F.col("n") > long).select("kind", "bytes", F.lit(True).alias("grown"))
    anew = F.array(F.struct("kind", "bytes"))
    for k, p in enumerate(short):
        within = F.array(*(index_entry(len(short) + d, q) for d, q in enumerate(deep) if set(p) <= set(q)))
        anew = F.when(F.col("grown") & (F.col("kind") == k), within).otherwise(anew)
    placed = entries.join(grown, ["kind", "bytes"], "left").withColumn("grown", F.coalesce("grown", F.lit(False)))
    return placed.select("fingerprint", F.explode(anew).alias("list")).select("list.*", "fingerprint")


def tallied_pairs(x: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within max_bits of each other, of members that share a group (groups stand together)."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = runs(group)
    behind = np.repeat(np.append(first, len(x))[1:], np.diff(np.append(first, len(x)))) - np.arange(len(x)) - 1  # members after each one
    at, apart = np.flatnonzero(behind > 0), 1
    while len(at):
        differ = x[at] ^ x[at + apart]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        enough = np.flatnonzero(shared >= 8 - max_bits)
        near = at[enough[np.bitwise_count(differ[enough]) <= max_bits]]
        left.append(near)
        right.append(near + apart)
        apart += 1
        at = at[behind[at] >= apart]
    return np.concatenate(left), np.concatenate(right)


def looked_up_pairs(x: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long list (rising) whose members differ in max_bits bytes at most: all their neighbours are looked up."""
    differ = np.bitwise_or.reduce(x ^ x[0])
    bits = [1 << b for b in range(64) if int(differ) >> b & 1]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some in range(1, max_bits + 1):
        for flips in combinations(bits, some):
            other = x ^ np.uint64(sum(flips))
            place = np.minimum(np.searchsorted(x, other), len(x) - 1)
            at = np.flatnonzero((x[place] == other) & (x < other))
            left.append(at)
            right.append(place[at])
    return np.concatenate(left), np.concatenate(right)


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place to which each of n places is linked, itself without links."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        while (low[low] != low).any():
            low = low[low]
        if (low[label] == label).all():
            return label
        label = low[label]


def links(index: DataFrame, max_bits: int = MAX_BITS, long: int = LONG) -> DataFrame:
    """a, b: links that join all fingerprints of a list that chains of near ones connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(kind: np.ndarray, key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (np.diff(kind) != 0) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(first, len(key)))
        group = np.repeat(np.arange(len(first)), size)
        a, b = [], []
        for one in first[size > long].tolist():
            many = x[one : one + int(size[group[one]])]
            order = np.argsort(many)
            left, right = looked_up_pairs(many[order], max_bits)
            a.append(one + order[left])
            b.append(one + order[right])
        few = np.flatnonzero((size[group] > 1) & (size[group] <= long))
        left, right = tallied_pairs(x[few], group[few], max_bits)
        label = stars(np.concatenate([*a, few[left]]), np.concatenate([*b, few[right]]), len(x))
        at = np.flatnonzero(label != np.arange(len(x)))
        return pa.RecordBatch.from_arrays([pa.array(B.signed(x[at])), pa.array(B.signed(x[label[at]]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists come one after another; the last one of a batch may go on in the next."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, key, x = (batch[c].to_numpy(zero_copy_only=False) for c in ("kind", "bytes", "fingerprint"))
            begins = np.flatnonzero((np.diff(kind) != 0) | (np.diff(key) != 0)) + 1
            if held and (held[-1][0][-1], held[-1][1][-1]) != (kind[0], key[0]):
                yield found(*joined(held))
                held = []
            if len(begins):
                yield found(*joined([*held, tuple(c[: begins[-1]] for c in (kind, key, x))]))
                held = [tuple(c[begins[-1] :] for c in (kind, key, x))]
            else:
                held.append((kind, key, x))
        if held:
            yield found(*joined(held))

    def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind, key, x = map(np.concatenate, zip(*parts, strict=True))
        new = np.concatenate([[True], (np.diff(kind) != 0) | (key[1:] != key[:-1]) | (x[1:] != x[:-1])])  # several grown lists deal a member to the same one
        return kind[new], key[new], x[new].view(np.uint64)

    ordered = index.repartition("kind", "bytes").sortWithinPartitions("kind", "bytes", "fingerprint")
    return ordered.select("kind", "bytes", "fingerprint").mapInArrow(run, "a long, b long")


def near_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, long: int = LONG) -> DataFrame:
    """prints (doc_id, fingerprint) and each row's component_id, the smallest id that chains of links reach."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    joined = components(links(inverted_index(classes.select("fingerprint"), max_bits, long), max_bits, long), "a", "b")
    placed = classes.join(joined.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left").withColumn("top", F.coalesce("component", "fingerprint"))
    tops = placed.groupBy("top").agg(F.min("least").alias("component_id"))
    named = placed.select("fingerprint", "top").join(tops, "top").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, size: int = WORDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row.

    Two rows are linked if their fingerprints differ in at most max_bits bits.  A
    null, empty or wordless text has the fingerprint zero and is linked like any
    other; a text of fewer than ``size`` words is one shingle.  Rows that repeat
    each other are in one component.  Null ids pass through and never name a
    component, but for one without any other id.  Other columns are not looked
    at, and an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, size, seed, id_column, text_column))
    found = near_fingerprints(prints, max_bits)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
