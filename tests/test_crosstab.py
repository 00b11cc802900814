"""One-pass tables against the same figures one by one, and what stands below a table."""

import random

import pytest
from helpers import row_set

from panelspark.operators import crosstab as X

SCHEMA = "survey_id string, measure string, stimulus_id string, type string, n_options int, sex string, area string, flagged boolean, weight double, codes array<int>, answer_text string"
AXES = ["total", "sex", "sex_x_area", "area"]


def answers(n=600, seed=1):
    rnd = random.Random(seed)
    kinds = {"q1": ("single", 5), "q2": ("multi", 4), "q3": ("numeric", 0), "q4": ("scale", 7), "q5": ("open", 0)}
    out = []
    for _ in range(n):
        m = rnd.choice(list(kinds))
        kind, k = kinds[m]
        codes = [rnd.randrange(0, 9) for _ in range(rnd.randrange(4))] if k else []
        text = rnd.choice(["1,200", "7", "many", None, "-3.5", ""]) if kind == "numeric" else None
        weight = 0.0 if m == "q4" and rnd.random() < 0.5 else rnd.choice([0.5, 1.0, 1.25])
        out.append((rnd.choice(["s1", "s2"]), m, rnd.choice(["c1", "c2"]), kind, k, rnd.choice(["男", "女", "", None]), rnd.choice(["east", None]), rnd.random() < 0.2, weight, codes, text))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(answers(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def measures(spark):
    rows = [(s, m, top, top != [] or m == "q4") for s in ("s1", "s2") for m, top in (("q1", [1, 2]), ("q2", []), ("q3", []), ("q4", [7]), ("q5", []))]
    return spark.createDataFrame(rows, "survey_id string, measure string, top_box array<int>, ordinal boolean")


def test_one_pass_equals_the_parts(frame, measures):
    one = X.stacked_metrics(frame, AXES, measures, 8)
    parts = X.metric_table(X.crosstab(frame, AXES), measures, X.mean_scores(frame, AXES, measures.filter("ordinal")), 8, X.numeric_metrics(frame, AXES))
    assert row_set(one.toPandas()) == row_set(parts.select(one.columns).toPandas())


def test_two_exchanges_after_the_frame(frame, measures):
    """The grain and the grouping sets; the definitions of measures join at most both sides once more."""
    plan = X.stacked_metrics(frame, AXES, measures, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    assert plan.count("Expand") == 1


def test_sums_can_be_merged(frame):
    """Sums of two halves add up to the sums of all, group by group."""
    halves = [frame.filter(f"xxhash64(*) % 2 {op} 0") for op in ("=", "<>")]
    key = ["survey_id", "measure", "stimulus_id", "type", "n_options", "axis", "segment"]
    figures = ["n", "n_unflagged", "w", "w_1", "score", "score_w", "number"]
    parts = X.segment_sums(halves[0], AXES, 8).unionByName(X.segment_sums(halves[1], AXES, 8))
    merged = parts.groupBy(*key).agg(*(X.F.sum(c).alias(c) for c in figures))
    assert row_set(merged.toPandas()) == row_set(X.segment_sums(frame, AXES, 8).select(*key, *figures).toPandas())


def test_no_answers_no_rows(frame, measures):
    assert X.stacked_metrics(frame.filter("false"), AXES, measures, 5).count() == 0


def test_unanswered_concepts_keep_a_row(spark, frame, measures):
    stimuli = spark.createDataFrame([(s, c, n) for s in ("s1", "s2") for c, n in (("c1", "One"), ("c2", "Two"), ("c3", "Three"))], "survey_id string, stimulus_id string, name string")
    two = measures.filter("measure in ('q1', 'q3')")
    table = X.with_unanswered(X.stacked_metrics(frame, ["total"], two, 5), stimuli, two)
    empty = {(r["survey_id"], r["measure"], r["stimulus_id"]): r for r in table.filter("axis is null").collect()}
    assert set(empty) == {(s, m, "c3") for s in ("s1", "s2") for m in ("q1", "q3")}
    assert all(r["n"] == 0 and r["n_unflagged"] == 0 and r["option_1"] is None for r in empty.values())
    notes = {r["survey_id"]: r["note"] for r in X.unanswered_note(table, stimuli).collect()}
    assert notes["s1"] == "回答が1件も無いため n=0 で出している: Three / q1・Three / q3"


def test_legend(spark):
    rows = [("s", 2, "m2", "numeric", "How much?", []), ("s", 0, "m1", "single", "Which?", ["a", "b"]), ("s", 1, "m1", "single", "Which again?", ["a", "b"]), ("s", 3, "m3", "open", "Why?", [])]
    got = X.legend(spark.createDataFrame(rows, "survey_id string, ord int, measure string, type string, text string, options array<string>")).orderBy("ord", "line").collect()
    assert [r["note"] for r in got] == ["m1: Which?", "m1 の選択肢: 1. a / 2. b", "m2: How much?"]
