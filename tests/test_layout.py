"""Joins that need no shuffle, a census of any size, and sketches that can be merged."""

import uuid

import pytest
from helpers import row_set

from panelspark.operators import crosstab as X
from panelspark.operators import monitor as G
from panelspark.operators import quotas as Q
from panelspark.operators import workplan as W
from panelspark.operators.draw import lookup
from panelspark.plans import config as C
from panelspark.sources.tables import colocated, merged, write_bucketed


@pytest.fixture(scope="module")
def tables(spark):
    """Responses, panel and persons of two surveys, in eight buckets by person each."""
    persons = spark.range(3_000).selectExpr("concat('u', id) as uuid", "if(id % 2 = 0, '男', '女') as sex", "cast(18 + id % 60 as int) as age", "'east' as area", "'hs' as education_level", "'single' as marital_status")
    panel = persons.selectExpr("explode(array('s1', 's2')) as survey_id", "uuid as persona_uuid", "'c' as cell_id", "if(age % 7 = 0, 'reserve', 'main') as role", "1.0D as weight")
    responses = panel.selectExpr("survey_id", "persona_uuid", "'c1' as stimulus_id", "explode(array('q_intent_s1', 'q_multi_s1')) as question_id", "array(1, 2) as answer_codes", "cast(null as string) as answer_text", "array(1,2,3,4,5) as options_order", "cast(array() as array<string>) as flags")
    names = {}
    for name, df, key in (("responses", responses, "persona_uuid"), ("panel", panel, "persona_uuid"), ("persons", persons, "uuid")):
        names[name] = f"{name}_{uuid.uuid4().hex}"
        write_bucketed(df, names[name], key, 8)
    yield {c: spark.table(n) for c, n in names.items()}
    for n in names.values():
        spark.sql(f"drop table {n}")


@pytest.fixture
def no_small_tables(spark):
    """Nothing is small enough for Spark to broadcast it by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frame_over_bucketed_tables_shuffles_nothing(spark, tables, no_small_tables):
    questions = C.questions(spark.sql("select explode(array('s1', 's2')) as survey_id"))
    columns = C.PERSON_COLUMNS
    with colocated(spark):
        frame = X.answer_frame(tables["responses"], tables["panel"], tables["persons"], X.F.broadcast(questions), columns)
        plan = plan_of(frame)
        n = frame.count()
    assert "Exchange hashpartitioning" not in plan and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 2
    loose = {c: t.repartition(3) for c, t in tables.items()}
    assert n == X.answer_frame(loose["responses"], loose["panel"], loose["persons"], questions, columns).count() > 0


def test_lookup_and_upsert_shuffle_the_new_rows_only(spark, tables, no_small_tables):
    with colocated(spark):
        found, _ = lookup(tables["persons"], tables["panel"].selectExpr("persona_uuid as uuid"), ["sex"])
        assert "Exchange hashpartitioning" not in plan_of(found)
        new = spark.createDataFrame([("s1", "u1", "c1", "q_intent_s1")], "survey_id string, persona_uuid string, stimulus_id string, question_id string")
        new = new.repartition(8, "persona_uuid")
        after = merged(tables["responses"].select(new.columns), new, new.columns)
        plan = plan_of(after)
        assert plan.count("Exchange hashpartitioning") == plan.count("hashpartitioning(persona_uuid") and "Scan" in plan
        assert after.count() == tables["responses"].count()


def test_setting_is_put_back(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), colocated(spark):
        assert spark.conf.get(name) == "false"
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before


CELLS = "survey_id string, cell_id string, sex string, age_min int, age_max int, ord int, town string"


def test_census_by_town(spark):
    cells = spark.createDataFrame([("s", "a", "男", 20, 29, 1, "x"), ("s", "b", "女", 18, 33, 2, "x"), ("t", "c", "男", 20, 24, 1, "y"), ("t", "d", "男", 25, 39, 2, "y")], CELLS)
    census = [(town, sex, a, a + 4, (10 if town == "x" else 1) * a) for town in "xy" for sex in "男女" for a in range(0, 100, 5)]
    got = Q.population_shares(cells, spark.createDataFrame(census, "town string, sex string, age_min int, age_max int, population int"), ["town"])
    got = {r["cell_id"]: (r["population"], round(r["proportion"], 6)) for r in got.collect()}
    # bands count where they lie inside a cell: of 18 to 33 those of 20 and 25 alone
    assert got == {"a": (450, 0.5), "b": (450, 0.5), "c": (20, round(20 / 110, 6)), "d": (90, round(90 / 110, 6))}


def test_cell_without_population_is_an_error(spark):
    cells = spark.createDataFrame([("s", "a", "男", 20, 29, 1, "x")], CELLS)
    census = spark.createDataFrame([("x", "男", 18, 31, 5), ("y", "男", 20, 24, 5)], "town string, sex string, age_min int, age_max int, population int")
    with pytest.raises(Exception, match="no population"):
        Q.population_shares(cells, census, ["town"]).collect()


def test_large_census_needs_no_nested_loop(spark):
    cells = spark.range(100_000).selectExpr("concat('s', id) as survey_id", "'a' as cell_id", "'男' as sex", "20 as age_min", "29 as age_max", "1 as ord", "concat('t', id % 50000) as town")
    census = spark.range(3_000_000).selectExpr("concat('t', id % 50000) as town", "if(id % 2 = 0, '男', '女') as sex", "cast(5 * (id % 20) as int) as age_min", "cast(5 * (id % 20) + 4 as int) as age_max", "1 as population")
    plan = plan_of(Q.population_shares(cells, census, ["town"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" not in plan


def test_sketches_merge_to_the_profile_of_all_calls(spark):
    calls = spark.range(200_000).selectExpr("concat('r', id % 3) as run_id", "id % 150000 as call_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id / 10) as ts", "cast(1 + id % 4 as int) as attempt", "cast(pow(xxhash64(id) % 1000, 2) as int) as latency_ms")
    sketches = G.call_sketches(calls)
    assert sketches.count() == 3 * 6  # a row per run and hour
    exact = {r["run_id"]: r for r in G.latency_profile(calls, 100_000).collect()}
    ranks = {r["run_id"]: sorted(r["x"]) for r in calls.groupBy("run_id").agg(X.F.collect_list("latency_ms").alias("x")).collect()}
    distinct = {r["run_id"]: r["n"] for r in calls.groupBy("run_id").agg(X.F.count_distinct("call_id").alias("n")).collect()}
    # merged at once, and of two tables that were appended to each other
    halves = [G.call_sketches(calls.filter(f"hour(ts) % 2 = {i}")) for i in (0, 1)]
    for merged_rows in (G.merged_profile(sketches), G.merged_profile(halves[0].unionByName(halves[1]))):
        for r in merged_rows.collect():
            run = r["run_id"]
            assert all(r[c] == exact[run][c] for c in ("n", "avg_attempt", "max_ms"))
            for c, p in (("p50", 0.5), ("p95", 0.95)):
                assert abs(sum(x <= r[c] for x in ranks[run]) / len(ranks[run]) - p) < 0.02
            assert abs(r["calls"] / distinct[run] - 1) < 0.05


def test_sketches_of_no_calls(spark):
    calls = spark.createDataFrame([], "run_id string, call_id long, ts timestamp, attempt int, latency_ms int")
    assert row_set(G.merged_profile(G.call_sketches(calls)).toPandas())[1] == []


def test_groups_take_the_same_jobs_for_any_chain(spark):
    """Chains of 3 and of 300 questions, stars, and questions by themselves, in many surveys at once."""
    jobs = {}
    for n in (3, 300):
        rows, edges = [], []
        for s in range(20):
            rows += [(f"s{s}", f"q{i}", i) for i in range(n + 5)]
            edges += [(f"s{s}", f"q{i}", f"q{i - 1}", i - 1) for i in range(2, n)] if s % 2 else [(f"s{s}", f"q{i}", "q1", 1) for i in range(2, n)]
        q = spark.createDataFrame(rows, "survey_id string, question_id string, ask_pos int")
        e = spark.createDataFrame(edges, "survey_id string, question_id string, remembered string, remembered_pos int")
        spark.sparkContext.setJobGroup(f"groups{n}", "groups")
        got = {(r["survey_id"], r["question_id"]): r["group_pos"] for r in W.session_groups(q, e).collect()}
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups{n}"))
        assert got == {(s, x): 1 if 1 <= i < n else i for s, x, i in rows}
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[3] == jobs[300]


def test_groups_without_edges_or_questions(spark):
    q = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "survey_id string, question_id string, ask_pos int")
    e = spark.createDataFrame([], "survey_id string, question_id string, remembered string, remembered_pos int")
    assert sorted(map(tuple, W.session_groups(q, e).collect())) == [("s", "a", 0), ("s", "b", 1)]
    assert W.session_groups(q.limit(0), e).count() == 0
