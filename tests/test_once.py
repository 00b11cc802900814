"""Steps that are done once: replies computed, answers parsed, and turns put together before they meet persons."""

import re

import pytest
from helpers import row_set

from panelspark.operators import answers as O
from panelspark.operators import crosstab as X
from panelspark.operators import prompts as M
from panelspark.operators import workplan as W
from panelspark.plans import config as C
from panelspark.plans.registry import QUERIES
from panelspark.sources.views import view


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["message_rows", "message_images", "answer_frame", "answer_frame_colocated"])
def test_orders_are_read_before_and_not_again(name, spark, sf):
    """The orders stand in the written replies, which the plan reads instead."""
    assert "o_orderkey" not in plan_of(QUERIES[name](spark, sf))


def test_messages_multiply_no_rows(spark, sf):
    """Neither a window nor a grouping of turns or units is left: what is grouped are the answers of a person."""
    plan = plan_of(QUERIES["message_rows"](spark, sf))
    assert not [w for w in re.findall(r"Window \[.*", plan) if "pos" in w]
    grouped = [g for g in re.findall(r"Aggregate \[(.*?)\]", plan) if "question_id" in g]
    assert not grouped, grouped


def test_answers_are_parsed_once(spark, sf):
    raw, q = view(spark, sf, "responses_raw").localCheckpoint(), C.questions(view(spark, sf, "fielded")).localCheckpoint()
    marked = O.mark_straightlining(O.parse_answers(raw, q), q)
    reads = plan_of(marked).count("from_json")
    assert reads == plan_of(O.parse_answers(raw, q)).count("from_json") > 0


def test_straightlining_by_survey_and_known_person(spark):
    """Places count for coded single and scale answers only; answers of nobody, or without codes, mark nothing."""
    rows = [("s", "a", f"q{i}", [2, 9], None) for i in range(3)] + [("s", "a", "m", [1], ["retried"]), ("s", "a", "other", None, None)]
    rows += [("s", None, f"q{i}", [2], ["straightline"]) for i in range(3)] + [(None, "a", f"q{i}", [2], None) for i in range(3)]
    rows += [("s", "b", f"q{i}", [2] if i else [], None) for i in range(3)] + [("t", "a", "q0", [2], ["straightline"])]
    df = spark.createDataFrame(rows, "survey_id string, persona_uuid string, question_id string, answer_codes array<int>, flags array<string>")
    q = spark.createDataFrame([(s, f"q{i}", "single") for s in ("s", "t") for i in range(3)] * 2 + [("s", "m", "multi")], "survey_id string, question_id string, type string")
    got = sorted(((r["survey_id"], r["persona_uuid"], r["question_id"], r["flags"]) for r in O.mark_straightlining(df, q).collect()), key=repr)
    want = sorted(((s, p, x, (["retried"] if x == "m" else []) + (["straightline"] if (s, p) == ("s", "a") else [])) for s, p, x, *_ in rows), key=repr)
    assert got == want


def test_given_answers_are_those_of_the_answers_table(spark):
    """Units that carry their person's answers lead to the same messages, with and without a text for missing ones."""
    units = spark.createDataFrame([("s", p, q, "c", i, f"card {p}") for p in "ab" for i, q in enumerate("xyz")] + [("s", None, "x", "c", 0, None)], "survey_id string, persona_uuid string, question_id string, stimulus_id string, ask_pos int, profile string")
    edges = spark.createDataFrame([("s", "y", "x", 0), ("s", "z", "x", 0), ("s", "z", "y", 1)], "survey_id string, question_id string, remembered string, remembered_pos int")
    blocks = spark.createDataFrame([("s", q, f"block {q}", "concept" if q < "z" else None, f"sys {q}", 1 if q < "z" else 2, []) for q in "xyz"], "survey_id string, question_id string, block string, stimulus_block string, system string, slot int, images array<string>")
    answers = spark.createDataFrame([("s", "a", "x", "1"), ("s", "a", "y", None), ("s", "b", "x", "2"), ("s", "b", "y", "3"), ("t", "a", "y", "4")], "survey_id string, persona_uuid string, question_id string, answer string")
    said = lambda df: row_set(df.select("survey_id", "persona_uuid", "question_id", M.F.transform("messages", lambda m: M.F.concat(m["role"], M.F.lit(":"), M.content_text(m["content"]))).cast("string").alias("m"), M.F.col("missing").cast("string").alias("missing")).toPandas())
    carried = units.join(M.replies_by_person(answers), ["survey_id", "persona_uuid"], "left")
    for missing, n in ((None, 6), ("(none)", 7)):
        got = said(M.message_rows(units, edges, blocks, answers, missing))
        assert got == said(M.message_rows(carried, edges, blocks, None, missing)) and len(got[1]) == n
    columns, rows = got
    last = next(dict(zip(columns, r, strict=True)) for r in rows if "'a'" in r and "'z'" in r)
    assert last["m"] == repr("[system:sys z, user:■あなたのプロフィール\ncard a\n\nconcept\n\nblock x, assistant:1, user:block y, assistant:(none), user:block z]") and last["missing"] == repr("[y]")


def test_units_carry_columns_of_the_panel(spark):
    panel = spark.sql("select 's' as survey_id, 'p' as persona_uuid, 'main' as role, array('c1') as assigned_stimuli, 'card' as profile")
    q = spark.sql("select 's' as survey_id, 'q' as question_id, 1 as slot, 0 as ask_pos")
    assert W.plan_work(panel, q, ["profile"]).first()["profile"] == "card" and "profile" not in W.plan_work(panel, q).columns


def test_frame_deals_answers_by_survey_and_person_only(spark):
    """Attributes join the panel, not the answers."""
    r = spark.createDataFrame([("s", "p", "q", [1], [1], None), ("s", "x", "q", [1], [1], None)], "survey_id string, persona_uuid string, question_id string, answer_codes array<int>, options_order array<int>, flags array<string>")
    panel = spark.createDataFrame([("s", "p", "c", None, "main"), ("s", "x", "c", 2.0, "main")], "survey_id string, persona_uuid string, cell_id string, weight double, role string")
    persons = spark.createDataFrame([("p", 5)], "uuid string, age int")
    q = spark.createDataFrame([("s", "q", "m", "single", 5)], "survey_id string, question_id string, measure string, type string, n_options int")
    got = sorted((f["persona_uuid"], f["weight"], f["age"]) for f in X.answer_frame(r, panel, persons, q, ["age"]).collect())
    assert got == [("p", 1.0, 5), ("x", 2.0, None)]


def test_image_parts_are_made_once_a_question(spark):
    """Parts made beforehand give the same contents, and a text is written as JSON a single time."""
    df = spark.createDataFrame([('a "b"', ["u/1.png", None, "", 'x"y']), ("c\n", [""]), (None, None)], "text string, uris array<string>")
    got = df.select(M.content_of(M.F.col("text"), M.F.col("uris")).alias("a"), M.content_with(M.F.col("text"), M.image_parts(M.F.col("uris"))).alias("b"), M.with_images(M.F.col("text"), M.F.col("uris")).alias("c")).select(M.F.to_json("a").alias("a"), M.F.to_json("b").alias("b"), "c").collect()
    assert all(r["a"] == r["b"] for r in got) and got[1]["c"] == got[1]["a"] == '"c\\n"'
    assert got[0]["c"] == '[{"type":"text","text":"a \\"b\\""},{"type":"image_url","image_url":{"url":"u/1.png"}},{"type":"image_url","image_url":{"url":"x\\"y"}}]'
    listed = plan_of(df.select(M.listed(M.F.col("text"), M.F.lit("{}")).alias("x")))
    assert len(re.findall(r"to_json|StructsToJson", listed)) <= 1
