"""Nearest neighbours by a block matrix join over int8 product tiles.

Queries and candidates are dealt into blocks bounded by rows and bytes.  Each
(query block, candidate block) tile is one task-sized unit, to which only int8
codes, scales and quantisation errors travel: the codes are multiplied as a
matrix, which with the errors gives a lower and an upper bound of every distance.
A candidate whose lower bound exceeds the k-th smallest upper bound of its query
cannot be among the k nearest; that is decided in the tile, and again over all
tiles of a query.  Of equal vectors, which no bound tells apart, the k smallest ids
are left, so copies of a vector don't multiply the pairs.  The pairs left fetch their original vectors, are recomputed in
double precision and merged by heaps.  The bounds are strict, so the result is
exact and no recall is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, table
from panelspark.llm.exchange import runs

QUERY_ROWS = 4096
CANDIDATE_ROWS = 32768
#: Bytes of codes in a block; longer vectors make blocks of fewer rows.
BLOCK_BYTES = 16 << 20
#: Distances bounded at once in a tile.
CELLS = 8 << 20
FAN_IN = 32


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0)
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, one scale per vector, and the Euclidean norm of each quantisation error."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    part = x / scale[:, None]
    codes = np.rint(part).astype(np.int8)
    # in units of the scale, whose square may be no double; the division rounds as well
    return codes, scale, scale * (np.sqrt(((part - codes) ** 2).sum(axis=1)) + 1e-12 * np.sqrt(x.shape[1]))


def code_bounds(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances: that of the decoded vectors, less and plus both errors."""
    (qc, qs, qe), (cc, cs, ce) = q, c
    unit = max(qs.max(), cs.max())  # squares of large and small scales stay doubles
    qs, cs = qs / unit, cs / unit
    products = np.zeros((len(qc), len(cc)))
    for at in range(0, qc.shape[1], 1024):  # every sum of as many products of codes is a whole number below 2**24: exact in float32
        products += qc[:, at : at + 1024].astype(np.float32) @ cc[:, at : at + 1024].astype(np.float32).T
    qn = (qs * qs) * (qc.astype(np.int64) ** 2).sum(axis=1)
    cn = (cs * cs) * (cc.astype(np.int64) ** 2).sum(axis=1)
    total = qn[:, None] + cn[None, :]
    d = np.sqrt(np.maximum(total - 2 * qs[:, None] * cs[None, :] * products, 0))
    slack = qe[:, None] / unit + ce[None, :] / unit + 1e-7 * np.sqrt(total) + 1e-150  # rounding in double is far below
    with np.errstate(over="ignore"):
        return (d - slack) * unit, (d + slack) * unit


def bounds(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code_bounds(quantise(q), quantise(c))


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of vectors pair by pair; where squares leave the range of doubles, in units of the largest difference."""
    with np.errstate(over="ignore", under="ignore"):
        diff = (c.astype(np.float64) - q.astype(np.float64)).T
        out = np.add.reduce(diff * diff, axis=0)
        odd = np.flatnonzero(~((out > 1e-280) & (out < np.inf)))
        out = np.sqrt(out)
        unit = np.abs(diff[:, odd]).max(axis=0) if len(diff) else np.zeros(0)
        some = (unit > 0) & (unit < np.inf)
        out[odd[some]] = unit[some] * np.sqrt(np.add.reduce((diff[:, odd[some]] / unit[some]) ** 2, axis=0))
    return out


def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number of their own, and their codes."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        length = batch["length"].to_numpy()
        codes, scale, error, twin = [b""] * len(length), np.zeros(len(length)), np.zeros(len(length)), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            x = _matrix(pa.chunked_array([batch["vector"].take(pa.array(mine))])).astype(np.float64) + 0.0  # one zero
            c, s, e = quantise(x)
            scale[mine], error[mine] = s, e
            twin[mine] = np.array([xxhash.xxh3_64_intdigest(v) for v in map(np.ndarray.tobytes, x)], np.uint64).view(np.int64)
            for i, x in zip(mine.tolist(), c, strict=True):
                codes[i] = x.tobytes()
        rows = at + np.arange(len(length))
        at += len(length)
        columns = [pa.array(rows), batch["id"], batch["is_query"], batch["length"], batch["vector"], pa.array(codes, pa.binary()), pa.array(scale), pa.array(error), pa.array(twin)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "is_query", "length", "vector", "codes", "scale", "error", "twin"])


def _codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.int8)
    return flat.reshape(rows.num_rows, -1), rows["scale"].to_numpy(), rows["error"].to_numpy()


_PAIRS = "query_block int, stripe int, query_row long, row long, vec long, twin long, low double, high double"
_PAIR = {"query_row": np.int64, "row": np.int64, "vec": np.int64, "twin": np.int64, "low": np.float64, "high": np.float64}


def _pairs(block: int, stripe: int, k: int, *columns: np.ndarray) -> pa.Table:
    """Pairs of a query and a candidate; of equal candidates of a query the k that come first by id."""
    query, row, vec, twin, low, _ = columns
    order = np.lexsort((row, vec, low, twin, query))
    q, t, d = query[order], twin[order], low[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(q)), bool), (q[1:] != q[:-1]) | (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    kept = order[place < k]
    numbers = {"query_block": np.full(len(kept), block, np.int32), "stripe": np.full(len(kept), stripe, np.int32)}
    return pa.table({c: pa.array(v) for c, v in (numbers | {c: v[kept] for c, v in zip(_PAIR, columns, strict=True)}).items()})


def _tile(k: int):
    """The pairs of a tile whose bounds leave them in question."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [tuple(np.zeros(0, d) for d in _PAIR.values())]
        if left.num_rows and right.num_rows:
            q, c = _codes(left), _codes(right)
            qi, ci, qr, cr = left["id"].to_numpy(), right["id"].to_numpy(), left["row"].to_numpy(), right["row"].to_numpy()
            twin = right["twin"].to_numpy()
            step = max(1, CELLS // len(ci))
            for at in range(0, len(qi), step):
                low, high = code_bounds(tuple(x[at : at + step] for x in q), c)
                same = qi[at : at + step, None] == ci[None, :]
                reach = np.where(same | np.isnan(high), np.inf, high)
                limit = np.partition(reach, k - 1, axis=1)[:, k - 1] if len(ci) > k else np.full(len(low), np.inf)
                # a bound that is no number decides nothing
                i, j = np.nonzero(~(low > limit[:, None]) & ~same)
                out.append((qr[at + i], cr[j], ci[j], twin[j], low[i, j], high[i, j]))
        return _pairs(key[0].as_py(), key[1].as_py() // FAN_IN, k, *map(np.concatenate, zip(*out, strict=True)))

    return run


def _narrow(k: int):
    """Of the pairs of several tiles those that the k-th smallest upper bound of their query leaves in question."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        columns = [rows[c].to_numpy() for c in _PAIR]
        reach = np.where(np.isnan(columns[-1]), np.inf, columns[-1])
        order = np.lexsort((reach, columns[0]))
        columns, reach = [v[order] for v in columns], reach[order]
        query, low = columns[0], columns[-2]
        first = runs(query)
        n = np.diff(np.append(first, len(query)))
        limit = np.where(n > k, reach[np.minimum(first + k - 1, first + n - 1)], np.inf) if len(first) else np.zeros(0)
        keep = ~(low > np.repeat(limit, n))
        return _pairs(key[0].as_py(), key[1].as_py() // FAN_IN, k, *(v[keep] for v in columns))

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, score = batch["length"].to_numpy(), np.zeros(batch.num_rows)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            q, c = (_matrix(pa.chunked_array([batch[v].take(pa.array(mine))])) for v in ("query_vector", "vector"))
            score[mine] = distances(q, c)
        yield pa.RecordBatch.from_arrays([batch["query_row"], batch["query_id"], batch["id"], pa.array(score)], names=["query_row", "query_id", "vec_id", "score"])


def _merge(k: int):
    """The k nearest of each query row, off a heap of (score, id)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for r, q, i, s in zip(*(rows[c].to_pylist() for c in ("query_row", "query_id", "vec_id", "score")), strict=True):
            by.setdefault((r, q), []).append((s, i))
        best = [(q, rank + 1, i, s) for (_, q), near in by.items() for rank, (s, i) in enumerate(heapq.nsmallest(k, near))]
        columns = list(zip(*best, strict=True)) or [()] * 4
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("query_id", "rank", "vec_id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)})

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_rows: int = QUERY_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """The k nearest other vectors of each query by Euclidean distance: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do rows with a null id; vectors are only compared with
    vectors of the same length.  Repeated vectors tie and go to the smaller id;
    rows with a query's own id are never its neighbours; an id that occurs on
    several rows is listed once per such row, and asks once per such row.  Other
    columns are ignored.  A query without candidates has no rows; an empty table
    gives an empty result.
    """
    v = F.col(vector_column).cast("array<double>")
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"), usable(v).alias("_ok")).filter("_ok and id is not null").drop("_ok")
    kind = plain.schema["vector"].dataType.simpleString()
    schema = f"row long, id long, is_query boolean, length int, vector {kind}, codes binary, scale double, error double, twin long"
    coded = cut(plain.withColumn("length", F.size("vector")).select("id", "is_query", "length", "vector").mapInArrow(add_codes, schema))
    sizes = coded.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max("length").alias("d")).first()
    fit = max(1, BLOCK_BYTES // (sizes["d"] or 1))
    n_c, n_q = -(-sizes["n"] // min(candidate_rows, fit)) or 1, -(-sizes["q"] // min(query_rows, fit)) or 1
    mixed = F.xxhash64("row", F.lit(7))
    code = [F.col(x).alias(x) for x in ("length", "id", "row", "codes", "scale", "error", "twin")]  # a cogroup's sides share no column
    # the length is a part of both block keys, so that a tile holds vectors of one length
    q = coded.filter("is_query").select(F.pmod(mixed, F.lit(n_q)).cast("int").alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("block"), *code)
    c = coded.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("query_block"), F.pmod(mixed, F.lit(n_c)).cast("int").alias("block"), *code)
    keys = ["query_block", "block", "length"]
    pairs = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_tile(k), _PAIRS)
    stripes = -(-n_c // FAN_IN)
    while True:
        pairs = pairs.groupBy("query_block", "stripe").applyInArrow(_narrow(k), _PAIRS)
        if stripes <= 1:
            break
        stripes = -(-stripes // FAN_IN)
    ours = coded.filter("is_query").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "length")
    met = pairs.select("query_row", "row").join(coded.select("row", "id", "vector"), "row").join(ours, "query_row").select("query_row", "query_id", "id", "length", "query_vector", "vector")
    scored = met.mapInArrow(_exact, "query_row long, query_id long, vec_id long, score double")
    return scored.withColumn("part", F.pmod("query_row", F.lit(n_q * 8))).groupBy("part").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, F.col("vec_id") % 100 == 0, 10)


ORACLE = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (
  select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10
"""
