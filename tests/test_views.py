"""Every order is an answer, also of a customer who holds a third of all orders."""

import pytest

from panelspark.sources.views import VIEWS, view, with_views


@pytest.fixture(scope="module")
def hot(spark, sf, tmp_path_factory):
    """The orders of sf0.001 and half as many again of one customer, over several parts of the order keys."""
    folder = tmp_path_factory.mktemp("hot")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    n, most = orders.count(), orders.agg({"o_orderkey": "max"}).first()[0]
    more = spark.range(n // 2).selectExpr(f"{most} + 1 + id * 700 as o_orderkey", "cast(7 as bigint) as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice", "timestamp'2024-01-01' as o_orderdate", "'3-MEDIUM' as o_orderpriority")
    orders.unionByName(more.select([more[c].cast(orders.schema[c].dataType) for c in orders.columns])).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{sf}/{t}.parquet").coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder), n + n // 2


def test_every_order_is_one_answer_with_its_own_key(spark, hot):
    folder, n = hot
    raw = view(spark, folder, "responses_raw").cache()
    assert raw.count() == n
    assert raw.select("survey_id", "persona_uuid", "stimulus_id", "question_id").distinct().count() == n


def test_surveys_are_filled_in_order(spark, hot):
    """Replies to one unit are numbered by order key without gaps, also across parts of the keys."""
    folder, _ = hot
    rows = view(spark, folder, "replies").filter("o_custkey = 7 and unit = 4").orderBy("o_orderkey").collect()
    assert len({r["o_orderkey"] // 100_000 for r in rows}) > 3
    assert [r["wave"] for r in rows] == list(range(1, len(rows) + 1))


def test_panels_hold_all_who_answered(spark, hot):
    folder, _ = hot
    raw, panel = view(spark, folder, "responses_raw"), view(spark, folder, "panel")
    key = ["survey_id", "persona_uuid"]
    assert raw.join(panel, key, "left_anti").count() == 0
    assert panel.groupBy(*key).count().filter("count > 1").count() == 0


def test_views_agree_between_engines(spark, hot):
    import duckdb
    from helpers import row_set

    folder, _ = hot
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    for name in ("responses_raw", "panel", "fielded"):
        assert name in VIEWS
        ours = view(spark, folder, name)
        ours = ours.withColumn("weight", ours["weight"].cast("double")) if name == "panel" else ours
        assert row_set(ours.toPandas()) == row_set(con.execute(with_views(name) + f"select * from {name}").df())
