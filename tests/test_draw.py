"""The draw: by histogram below the shuffle, and overlapping cells in rounds, against the draw cell by cell."""

import hashlib
import random

import pytest

from panelspark.operators import draw as D

SCHEMA = "uuid string, sex string, age int, area string, marital_status string, education_level string, prefecture string, region string"


def people_of(n, seed=1):
    rnd = random.Random(seed)
    return [(f"u{i}", rnd.choice("男女"), rnd.randrange(18, 90), rnd.choice(["east", "west", None]), rnd.choice(["single", "", None]), None, None, None) for i in range(n)]


def matching(p, c):
    _, sex, age, area, status, *_ = p
    return c.get("sex") in (None, sex) and c.get("age_min", 0) <= age <= c.get("age_max", 999) and (not c.get("area") or area in c["area"]) and (not c.get("marital_status") or status in c["marital_status"])


def in_turn(people, cells, seed):
    """The draw as defined: cell by cell, who was taken is gone."""
    taken, out = set(), []
    for c in cells:
        keys = sorted((hashlib.sha256(f"{p[0]}|{seed}|{c['cell_id']}".encode()).hexdigest(), p[0]) for p in people if p[0] not in taken and matching(p, c))
        for i, (_, u) in enumerate(keys[: c["n"]]):
            out.append((u, c["cell_id"], i))
            taken.add(u)
    return sorted(out)


EVERYBODY = [{"cell_id": f"c{i}", "n": 25} for i in range(6)]
CASES = {
    "apart": [{"cell_id": "m", "sex": "男", "n": 30}, {"cell_id": "f1", "sex": "女", "age_max": 40, "n": 20}, {"cell_id": "f2", "sex": "女", "age_min": 41, "n": 500}],
    "one cell": [{"cell_id": "x", "n": 7}],
    "nobody": [{"cell_id": "x", "age_min": 200, "n": 7}, {"cell_id": "y", "n": 3}, {"cell_id": "z", "n": 0}],
    "everybody in all": EVERYBODY,
    "more than there are": [c | {"n": 90} for c in EVERYBODY],
    "nested": [{"cell_id": "a", "age_min": 60, "n": 40}, {"cell_id": "b", "age_min": 50, "n": 60}, {"cell_id": "c", "age_min": 40, "n": 60}, {"cell_id": "d", "n": 80}],
    "lists": [{"cell_id": "e", "area": ["east"], "n": 60}, {"cell_id": "s", "marital_status": ["single"], "n": 60}, {"cell_id": "w", "area": ["west"], "sex": "女", "n": 20}, {"cell_id": "o", "age_max": 50, "n": 40}],
}


@pytest.mark.parametrize("case", CASES)
def test_draw_equals_the_draw_in_turn(spark, case):
    people = people_of(400)
    df = spark.createDataFrame(people, SCHEMA).repartition(3)
    got = sorted(map(tuple, D.draw(df, CASES[case], 5).collect()))
    assert got == in_turn(people, CASES[case], 5)


def test_chains_of_displaced_persons(spark):
    """Small cells over the same few persons: nearly every pick displaces another."""
    for seed in range(3):
        rnd = random.Random(seed)
        people = people_of(40, seed)
        cells = [{"cell_id": f"c{i}", "age_min": rnd.randrange(18, 60), "n": rnd.randrange(1, 9)} for i in range(6)]
        got = sorted(map(tuple, D.draw(spark.createDataFrame(people, SCHEMA), cells, seed).collect()))
        assert got == in_turn(people, cells, seed)


def test_everyone_narrows_all_cells(spark):
    people = people_of(300)
    got = sorted(map(tuple, D.draw(spark.createDataFrame(people, SCHEMA), EVERYBODY[:2], 5, {"sex": "女"}).collect()))
    assert got == in_turn([p for p in people if p[1] == "女"], EVERYBODY[:2], 5)


def test_only_what_the_quota_reaches_is_shuffled(spark):
    """Of 60,000 persons at most n and one bucket a cell pass the filter, in the only exchange of the plan."""
    df = spark.range(60_000).selectExpr("concat('u', id) as uuid", "if(id % 2 = 0, '男', '女') as sex", "cast(18 + id % 60 as int) as age", *(f"cast(null as string) as {c}" for c in ("area", "marital_status", "education_level", "prefecture", "region")))
    cells = [{"cell_id": "m", "sex": "男", "n": 100}, {"cell_id": "f", "sex": "女", "n": 300}]
    found = D.matches(df, cells, 1)
    touched = D.histogram(found, cells, [100, 300])
    passed = D.within(found, touched).count()
    largest = found.selectExpr("explode(choices) as c").groupBy("c.cell_ord", D.F.substring("c.key", 1, D.BUCKET_DIGITS)).count().agg({"count": "max"}).first()[0]
    assert 400 <= passed <= 400 + 2 * largest
    drawn = D.draw(df, cells, 1)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # plans are written from the top
    assert drawn.count() == 400


def test_stages_do_not_grow_with_the_cells(spark):
    people = spark.createDataFrame(people_of(3_000), SCHEMA).cache()
    people.count()
    stages = {}
    for n in (2, 4, 8, 16):
        cells = [{"cell_id": f"c{i}", "age_min": 18 + i, "n": 1} for i in range(n)]
        spark.sparkContext.setJobGroup(f"stages{n}", "draw")
        D.draw(people, cells, 1).count()
        tracker = spark.sparkContext.statusTracker()
        stages[n] = len({s for j in tracker.getJobIdsForGroup(f"stages{n}") for s in tracker.getJobInfo(j).stageIds})
    spark.sparkContext.setJobGroup("other", "other")
    assert max(stages.values()) <= min(stages.values()) + 6  # at most one round more


@pytest.mark.parametrize("case", CASES)
def test_a_larger_draw_in_steps(spark, case):
    """Rows of each step are those that the larger draw has beyond the smaller one."""
    people = people_of(400)
    df = spark.createDataFrame(people, SCHEMA)
    cells = [c | {"n": c["n"] // 5} for c in CASES[case]]
    at = {k: set(in_turn(people, [c | {"n": c["n"] * k} for c in cells], 5)) for k in (1, 2, 4)} | {0: set()}
    for old, new in ((0, 1), (1, 2), (2, 4)):
        if old and not D.all_apart(cells):
            with pytest.raises(ValueError, match="share persons"):
                D.draw_beyond(df, cells, 5, old, new)
            continue
        assert set(map(tuple, D.draw_beyond(df, cells, 5, old, new).collect())) == at[new] - at[old]


def test_a_step_shuffles_its_own_ranks_only(spark):
    df = spark.range(100_000).selectExpr("concat('u', id) as uuid", "'男' as sex", "30 as age", *(f"cast(null as string) as {c}" for c in ("area", "marital_status", "education_level", "prefecture", "region")))
    cell = [{"cell_id": "m", "sex": "男", "n": 10_000}]
    touched = D.histogram(D.matches(df, cell, 1), cell, [20_000])
    pool = D.ranked_candidates(df, [cell[0] | {"n": 20_000}], 1, None, [10_000])
    buckets = pool.select(D.F.substring("rank_key", 1, D.BUCKET_DIGITS)).distinct().count()
    assert pool.count() == 10_000 and pool.agg({"rank": "min"}).first()[0] == 10_001
    assert buckets <= len(touched[0]) / 2 + 2


def test_screening_writes_new_rows_only(spark, monkeypatch):
    """Rounds of a screening over a real draw: each writes its own candidates and verdicts, the panel comes last."""
    from panelspark.operators import screening as E

    people = people_of(900)
    df = spark.createDataFrame(people, SCHEMA)
    cells = [{"cell_id": "m", "sex": "男", "n": 12}, {"cell_id": "f", "sex": "女", "n": 12}]
    table = spark.createDataFrame([("s", c["cell_id"], c["n"], 24, None) for c in cells], "survey_id string, cell_id string, n int, size int, proportion double")
    sizes = []
    real = E.cut

    def counted(rows):
        out = real(rows)
        sizes.append(out.count())
        return out

    def judge(todo):
        codes = D.F.when(D.F.substring("persona_uuid", 2, 9).cast("int") % 3 == 0, D.F.array(D.F.lit(1))).otherwise(D.F.array().cast("array<int>"))
        return todo.select("survey_id", "persona_uuid", codes.alias("answer_codes"), D.F.array(D.F.lit(1)).alias("options_order"), D.F.array(D.F.lit("inferred")).alias("flags"), D.F.lit("now").alias("config_hash"))

    more = lambda old, new: D.draw_beyond(df, cells, 5, old, new).select(D.F.lit("s").alias("survey_id"), D.F.col("uuid").alias("persona_uuid"), "cell_id", "cell_rank")
    none = judge(more(0, 1).limit(0))
    monkeypatch.setattr(E, "cut", counted)
    panel, log = E.screen(more, judge, none, table, "now", 1)
    assert [x["decision"] for x in log][-1] == "complete" and len(log) >= 2
    new = [24 * (x["factor"] - (log[i - 1]["factor"] if i else 0)) for i, x in enumerate(log)]
    assert sizes == [n for k in new for n in (k, k)] + [panel.count()]
    roles = {(r["cell_id"], r["role"]): r["count"] for r in panel.groupBy("cell_id", "role").count().collect()}
    assert roles["m", "main"] == roles["f", "main"] == 12


def test_screening_of_overlapping_cells_draws_anew(spark):
    """No candidate is in two cells, whatever a smaller draw had given to a later one."""
    from panelspark.operators import screening as E

    people = people_of(600)
    df = spark.createDataFrame(people, SCHEMA)
    cells = [{"cell_id": "old", "age_min": 40, "n": 10}, {"cell_id": "all", "n": 10}]
    table = spark.createDataFrame([("s", c["cell_id"], c["n"], 20, None) for c in cells], "survey_id string, cell_id string, n int, size int, proportion double")

    def judge(todo):
        codes = D.F.when(D.F.substring("persona_uuid", 2, 9).cast("int") % 2 == 0, D.F.array(D.F.lit(1))).otherwise(D.F.array().cast("array<int>"))
        return todo.select("survey_id", "persona_uuid", codes.alias("answer_codes"), D.F.array(D.F.lit(1)).alias("options_order"), D.F.array(D.F.lit("inferred")).alias("flags"), D.F.lit("now").alias("config_hash"))

    more = lambda old, new: D.draw_beyond(df, cells, 5, old, new).select(D.F.lit("s").alias("survey_id"), D.F.col("uuid").alias("persona_uuid"), "cell_id", "cell_rank")
    panel, log = E.screen(more, judge, judge(more(0, 1).limit(0)), table, "now", 1, extends=False)
    last = log[-1]["factor"]
    rows = [(r["persona_uuid"], r["cell_id"]) for r in panel.collect()]
    assert len(log) >= 2 and sorted(rows) == sorted((u, c) for u, c, _ in in_turn(people, [c | {"n": 10 * last} for c in cells], 5))
