"""Exact quantiles of latencies, against DuckDB, over more distinct values than a sketch keeps."""

import duckdb
import pytest
from helpers import row_set
from pyspark.sql import functions as F

from panelspark.operators import monitor as G

SQL = """
select run_id, count(*) as n, round(avg(attempt), 6) as avg_attempt, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95, max(latency_ms) as max_ms
from calls group by run_id"""


@pytest.fixture(scope="module")
def calls(spark):
    """300,000 calls, most latencies their own; runs of 1 to 120 calls, of unknown latencies only, of an unknown id, and some below zero."""
    many = spark.range(300_000).selectExpr("concat('big', id % 2) as run_id", "cast(1 + id % 4 as int) as attempt", "cast(abs(xxhash64(id)) % 2000000000 as int) as latency_ms")
    small = spark.range(1, 121).selectExpr("id as k", "explode(sequence(1, id)) as i").selectExpr("concat('small', k) as run_id", "cast(1 + i % 3 as int) as attempt", "cast(if(i % 11 = 5, null, (i * 37) % 101 - 20) as int) as latency_ms")
    odd = spark.sql("select * from values ('none', 1, cast(null as int)), ('none', null, null), (null, 1, 5), (null, 2, 7), ('tries', null, 3) as t(run_id, attempt, latency_ms)")
    return many.unionByName(small).unionByName(odd).localCheckpoint()


def test_profile_is_exact(spark, calls, tmp_path):
    calls.write.parquet(f"{tmp_path}/calls")
    con = duckdb.connect()
    con.execute(f"create view calls as select * from read_parquet('{tmp_path}/calls/*.parquet')")
    want = row_set(con.execute(SQL).df())
    assert row_set(G.latency_profile(calls).toPandas()) == want
    assert row_set(G.latency_profile(calls, 7_000_000).toPandas()) == want


def test_profile_of_no_calls(calls):
    assert G.latency_profile(calls.filter(F.lit(False))).count() == 0
