"""Packing documents into sequences by bounded-space online best-fit.

Tokenising yields pieces of at most ``capacity`` ids.  Pieces are dealt by hash
into groups of bounded size; within a group they arrive one by one.  The packer
keeps a fixed number of open bins in a bitset keyed by free space: the lowest
set bit at or above a piece's length is the best fit.  When no open bin fits and
all are taken, the fullest is closed.  Memory per task is the open bins alone.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import row_key, table, text_bytes

CAPACITY = 2048
OPEN_BINS = 1024
#: Bytes of text in one packing group.
GROUP_BYTES = 64 << 20

_encoders: dict[tuple[str, str], object] = {}


class Encoder:
    """Ids of ``tokenizers`` for a byte-level BPE vocabulary.

    The same vocabulary as ranks gives the same ids several times faster (a
    test compares both); a text that the fast path refuses goes to
    ``tokenizers`` itself.  Special tokens' strings in a text are read as
    ``tokenizers`` reads them by default.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.vocabulary, self.plain = vocabulary, None
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={"<|endoftext|>": len(merges)})

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  the library's panics are not Exceptions
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.vocabulary)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    import public_tokenizers

    key = (vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of each document's ids, one end id 0 included: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"], strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), 0).astype("<u4")
                out += [(doc, key, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            names = ["doc_id", "key", "piece", "start", "length", "ids_crc32"]
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("doc_id"), row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, key long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins by free space; bit f of ``bits`` is set while a bin with f free is open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.next = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        at = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return at

    def _put(self, at: int, free: int) -> None:
        if free:
            self.bins[free].append(at)
            self.bits |= 1 << free
            self.open += 1

    def add(self, length: int) -> tuple[int, int]:
        """The bin for a piece, and its place there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.next, self.capacity
            self.next += 1
        self._put(at, free - length)
        return at, self.capacity - free


def best_fit(items: DataFrame, n_groups: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, key: str = "key", length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows of at most ``capacity`` each; n_groups tasks pack apart from each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, BestFit(capacity, open_bins)
        for batch in batches:
            seq, off = [], []
            for g, n in zip(batch["pack_group"].to_pylist(), batch[length].to_pylist(), strict=True):
                if g != group:
                    group, packer = g, BestFit(capacity, open_bins)
                at, place = packer.add(n)
                seq.append((g << 40) | at)
                off.append(place)
            kept = batch.drop_columns(["pack_group"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*kept.schema.names, "sequence_id", "offset"])

    # the row's number too, so that rows that repeat each other are dealt out as evenly
    dealt = items.withColumn("pack_group", F.pmod(F.xxhash64(key, "piece", F.monotonically_increasing_id(), F.lit(11)), F.lit(n_groups)).cast("int"))
    order = [c for c in dealt.columns if c != "pack_group"]
    dealt = dealt.repartition("pack_group").sortWithinPartitions("pack_group", F.xxhash64(key, "piece"), *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "sequence_id long", "offset long"])
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_bytes: int = GROUP_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed once
    each; rows with a null id are packed as well.  Only documents of more than
    ``capacity`` ids are cut.  An empty table gives no rows.
    """
    n = max(1, text_bytes(docs, text_column) // group_bytes + 1)
    return best_fit(pieces(docs, capacity, id_column=id_column, text_column=text_column), n, capacity, open_bins).drop("key")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
