"""Equal vectors: exact answers, and pairs that don't grow with the copies."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import knn


def plain(rows, is_query, k):
    out = []
    for i, q in rows:
        if is_query(i):
            near = sorted((float(np.sqrt(((np.array(c) - np.array(q)) ** 2).sum())), j) for j, c in rows if j != i)[:k]
            out += [(i, rank + 1, j, round(d, 9)) for rank, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 32768), (5, 17)])
def test_copies_go_by_id(spark, blocks):
    """A third of all rows are one vector, some are its near copies, ids repeat, and -0.0 is 0.0."""
    rnd = random.Random(2)
    one = [1.0, 0.0, 2.0]
    rows = [(i, one if i % 3 == 0 else [1.0, -0.0, 2.0] if i % 7 == 0 else [rnd.choice([1.0, 1.0 + 1e-9]), 0.0, rnd.choice([2.0, 3.0])]) for i in range(150)]
    rows += [(6, one), (6, one), (9, [0.5, 0.0, 2.0])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.nearest(df, F.col("vec_id") % 10 == 0, 7, query_rows=blocks[0], candidate_rows=blocks[1])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0, 7)


def test_pairs_do_not_grow_with_copies(spark):
    """5,000 equal vectors and 200 others: a query keeps k of the copies a tile, not all of them."""
    rnd = np.random.default_rng(3)
    rows = [(i, [0.25, 0.5, 0.75, 1.0]) for i in range(5_000)] + [(5_000 + i, rnd.normal(size=4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    coded = df.select(F.col("vec_id").alias("id"), F.lit(True).alias("is_query"), F.size("embedding").alias("length"), F.col("embedding").alias("vector")).mapInArrow(knn.add_codes, "row long, id long, is_query boolean, length int, vector array<double>, codes binary, scale double, error double, twin long")
    table = coded.filter("id % 100 = 0").toArrow(), coded.toArrow()
    pairs = knn._tile(10)((pa.scalar(0), pa.scalar(0), pa.scalar(4)), *table)
    copies = [q for q, v in zip(pairs["query_row"].to_pylist(), pairs["vec"].to_pylist(), strict=True) if v < 5_000]
    assert max(copies.count(q) for q in set(copies)) <= 10
    got = knn.nearest(df, F.col("vec_id") == 100, 10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10))
