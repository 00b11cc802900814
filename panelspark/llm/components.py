"""Connected components by alternating large and small stars.

Each round points every node's neighbours at the smallest node near it; rounds
are few (logarithmic in the longest path).  Edges live in tables of the shared
folder, nothing is collected, and a hub's edges are handled by joins that Spark
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, after one round of stars."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    near = around.join(least, F.col("u") == F.col("_u"))
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge; nodes without edges have no row."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    mark = None
    while True:
        count = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (count["n"], count["s"]) == mark or not count["n"]:
            break
        mark = (count["n"], count["s"])
        before, now = now, cut(_star(_star(now, True), False))
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
