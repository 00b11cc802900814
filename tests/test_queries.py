"""Every registered query against its DuckDB counterpart."""

import pytest
from helpers import row_set

from panelspark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    assert row_set(got) == row_set(duck.execute(ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["panel_draw", "panel_draw_overlap", "crosstab_long", "screen_finalize", "failure_breach", "straightline"])
def test_results_do_not_depend_on_partitions(name, spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(row_set(QUERIES[name](spark, sf).toPandas()))
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
