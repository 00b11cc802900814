"""Packed blocks: many small fingerprints travel through one shuffle row.

A map task collects entries (a bucket, the key of the row that owns the entry,
and some numbers) and emits one row per bucket, holding the entries as packed
arrays.  Spark deals the rows out by bucket; a reducer unpacks its bucket with
numpy.  Answers travel back the same way: rows have a home (their key modulo the
number of homes), and a reducer sends one row of answers to each home.  Blocks
thus number buckets times homes or tasks, whatever the rows.  Entries that a task has already combined travel once, so a value that
occurs in a third of all rows costs one entry per flush, not one per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from panelspark.llm.bytetext import mix

#: Entries that a task holds before it emits its blocks.
FLUSH_ENTRIES = 1 << 20


#: What an entry wants: an answer, only to be echoed (its task decided already), or only to be counted.
ASK, ECHO, COUNT = 0, 1, 2


def block_schema(columns: dict[str, str], per_owner: dict[str, str] | None = None) -> T.StructType:
    return T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("owner", "entries", *(per_owner or {}), *columns))])


class Outbox:
    """Collects one task's entries; ``combine`` may decide some of them before they are sent."""

    def __init__(self, columns: dict[str, str], per_owner: dict[str, str] | None = None, combine=None, flush_entries: int = FLUSH_ENTRIES):
        self.columns, self.per_owner, self.combine, self.flush_entries = columns, per_owner or {}, combine, flush_entries
        self.fields = ["bucket", "owner", *self.per_owner, *columns]
        self.dtypes = {"bucket": "i4", "owner": "i8", **self.per_owner, **columns}
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries in the order of their owners; owner holds each entry's 64-bit row key."""
        self.parts.append([values[c].astype(self.dtypes[c], copy=False) for c in self.fields])
        self.size += len(values["bucket"])
        if self.size >= self.flush_entries:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        e = dict(zip(self.fields, map(np.concatenate, zip(*self.parts, strict=True)), strict=True))
        self.parts, self.size = [], 0
        if self.combine:
            e = self.combine(e)
        yield pack(e, self.columns, self.per_owner)


def pack(e: dict[str, np.ndarray], columns: dict[str, str], per_owner: dict[str, str] | None = None) -> pa.RecordBatch:
    """Entries as blocks, one row per bucket."""
    fields = block_schema(columns, per_owner).names
    order = np.argsort(e["bucket"], kind="stable")
    e = {c: v[order] for c, v in e.items()}
    cut = np.flatnonzero(np.diff(e["bucket"])) + 1
    rows: dict[str, list] = {c: [] for c in fields}
    for a, b in zip([0, *cut], [*cut, len(order)], strict=True):
        if a == b:
            continue
        own = e["owner"][a:b]
        first = runs(own)
        rows["bucket"].append(int(e["bucket"][a]))
        rows["owner"].append(own[first].tobytes())
        rows["entries"].append(np.diff(np.append(first, b - a)).astype(np.uint32).tobytes())
        for c in per_owner or {}:
            rows[c].append(e[c][a:b][first].tobytes())
        for c, d in columns.items():
            rows[c].append(e[c][a:b].astype(d, copy=False).tobytes())
    return pa.RecordBatch.from_pydict(rows, schema=arrow_schema(columns, per_owner))


def arrow_schema(columns: dict[str, str], per_owner: dict[str, str] | None = None) -> pa.Schema:
    return pa.schema([(f.name, pa.int32() if f.name == "bucket" else pa.binary()) for f in block_schema(columns, per_owner).fields])


def reply(owner: np.ndarray, homes: int, columns: dict[str, str], **values: np.ndarray) -> pa.Table:
    """Answers as blocks for the homes of their owners."""
    home = np.mod(owner, homes)
    order = np.lexsort((owner, home))
    e = {"bucket": home[order].astype(np.int32), "owner": owner[order], **{c: v[order] for c, v in values.items()}}
    return pa.Table.from_batches([pack(e, columns)])


def received(replies: pa.Table, keys: np.ndarray, columns: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each answer, rising, and the answers' values; rows that share a key all get its answers."""
    if not replies.num_rows:
        return np.zeros(0, np.int64), {c: np.zeros(0, d) for c, d in columns.items()}
    e = unpack(replies, columns)
    by_key = np.argsort(keys, kind="stable")
    a, b = (np.searchsorted(keys[by_key], e["owner"], side) for side in ("left", "right"))
    n = b - a
    row = by_key[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    order = np.argsort(row, kind="stable")
    return row[order], {c: np.repeat(e[c], n)[order] for c in columns}


def unpack(table: pa.Table, columns: dict[str, str], per_owner: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """All entries of the blocks: their owners and their values."""
    get = lambda c, d: np.frombuffer(b"".join(table[c].to_pylist()), d)
    entries = get("entries", np.uint32)
    return {c: get(c, d) for c, d in columns.items()} | {c: np.repeat(get(c, d), entries) for c, d in {"owner": "i8", **(per_owner or {})}.items()}


def spread(owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Any bucket, evenly: for entries that are only echoed."""
    return bucket_of(mix(owner.view(np.uint64) + mix(at.astype(np.uint64), 21), 22), n)


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values in a sorted array starts."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int32)


def deal(to: np.ndarray, column: str, **values: np.ndarray) -> pa.Table:
    """Numbers as blocks, one row per addressee: the column that names it, and the packed arrays."""
    order = np.argsort(to, kind="stable")
    first = runs(to[order])
    ends = np.append(first, len(order))[1:].tolist()
    packed = {c: pa.array([v[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()) for c, v in ((c, v[order]) for c, v in values.items())}
    return pa.table({column: pa.array(to[order[first]].astype(np.int32)), **packed})


def opened(blocks: pa.Table, column: str, **dtypes: str) -> dict[str, np.ndarray]:
    """The numbers of all blocks, and beside them the value of ``column`` of each one's block."""
    out = {c: np.frombuffer(b"".join(blocks[c].to_pylist()), d) for c, d in dtypes.items()}
    name, dtype = next(iter(dtypes.items()))
    sizes = np.array([len(x) for x in blocks[name].to_pylist()], np.int64) // np.dtype(dtype).itemsize
    return out | {column: np.repeat(blocks[column].to_numpy(), sizes)}


def total_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of n over each."""
    order = np.argsort(key, kind="stable")
    first = runs(key[order])
    sums = np.concatenate([[0], np.cumsum(n[order], dtype=np.int64)])
    return key[order[first]], sums[np.append(first, len(order))[1:]] - sums[first]
