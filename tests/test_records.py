"""Messages with images, run records as variants, the persons table's columns, composition reports, and schemas beside tables."""

import json

import pytest

from panelspark.functions import persons as P
from panelspark.operators import draw as D
from panelspark.operators import history as I
from panelspark.operators import prompts as M
from panelspark.sources.tables import keep_schema, kept_schema, merge_upsert, read_table, write_table


@pytest.fixture(scope="module")
def parts(spark):
    """One person, two concepts of two questions each; the later question of a concept replays all before it."""
    units = spark.createDataFrame([("s", "p", q, f"c{q[1]}", i, "card") for i, q in enumerate(("q1a", "q1b", "q2a", "q2b"))], "survey_id string, persona_uuid string, question_id string, stimulus_id string, ask_pos int, profile string")
    edges = spark.createDataFrame([("s", "q1b", "q1a", 0), ("s", "q2b", "q1a", 0), ("s", "q2b", "q2a", 2)], "survey_id string, question_id string, remembered string, remembered_pos int")
    images = {"1": [], "2": ["u/2.png", None, "", "u/b.png"]}
    blocks = spark.createDataFrame([("s", q, f"block {q}", f"concept {q[1]}", "sys", int(q[1]), images[q[1]]) for q in ("q1a", "q1b", "q2a", "q2b")], "survey_id string, question_id string, block string, stimulus_block string, system string, slot int, images array<string>")
    answers = spark.createDataFrame([("s", "p", q, f"answer {q}") for q in ("q1a", "q2a")], "survey_id string, persona_uuid string, question_id string, answer string")
    return units, edges, blocks, answers


def contents(rows):
    return {r["question_id"]: [(m["role"], json.loads(m["content"].toJson())) for m in r["messages"]] for r in rows.collect()}


def test_images_come_with_the_concept_and_only_once(parts):
    got = contents(M.message_rows(*parts))
    assert got["q1b"] == [("system", "sys"), ("user", "■あなたのプロフィール\ncard\n\nconcept 1\n\nblock q1a"), ("assistant", "answer q1a"), ("user", "block q1b")]
    shown = [{"type": "text", "text": "concept 2\n\nblock q2a"}, {"type": "image_url", "image_url": {"url": "u/2.png"}}, {"type": "image_url", "image_url": {"url": "u/b.png"}}]
    assert got["q2b"][3] == ("user", shown) and got["q2b"][4:] == [("assistant", "answer q2a"), ("user", "block q2b")]
    assert got["q2a"][1][1][0]["text"].endswith("concept 2\n\nblock q2a") and len(got["q2a"][1][1]) == 3


def test_without_images_contents_are_strings(parts):
    units, edges, blocks, answers = parts
    got = contents(M.message_rows(units, edges, blocks.drop("images"), answers))
    assert all(isinstance(c, str) for turns in got.values() for _, c in turns)


def test_text_of_contents(parts):
    df = M.message_rows(*parts).filter("question_id = 'q2b'").select(M.F.transform("messages", lambda m: M.content_text(m["content"])).alias("said"))
    assert df.first()["said"][-3:] == ["concept 2\n\nblock q2a", "answer q2a", "block q2b"]


def test_sample_is_the_first_person(spark, parts):
    units, *rest = parts
    two = units.unionByName(units.withColumn("persona_uuid", M.F.lit("a")))
    got = M.message_rows(M.prompt_sample(two), *rest, "(none)").collect()
    assert {r["persona_uuid"] for r in got} == {"a"} and [r["missing"] for r in sorted(got, key=lambda r: r["question_id"])][1] == ["q1a"]


def test_metadata_by_path(spark):
    rows = [("a", '{"survey": {"id": "s1", "size": 5, "cells": [{"n": 2}, {"n": 3}]}}'), ("b", '{"survey": {"size": "many"}}'), ("c", "{broken"), ("d", None)]
    df = I.with_metadata(spark.createDataFrame(rows, "run_id string, metadata_json string"))
    got = {r["run_id"]: tuple(r)[1:] for r in df.select("run_id", I.field_of("$.survey.size", "int"), I.field_of("$.survey.id", "string"), I.field_of("$.survey.cells[1].n", "int")).collect()}
    assert got == {"a": (5, "s1", 3), "b": (None, None, None), "c": (None, None, None), "d": (None, None, None)}


def test_persons_have_their_columns_in_order(spark):
    raw = spark.createDataFrame([("x", "u", "男", 34, "会社員 大手 経営")], "extra string, uuid string, sex string, age int, occupation string")
    with pytest.raises(ValueError, match="persons lack .*prefecture.*career_goals"):
        P.normalise(raw, "v2")
    made = P.normalise(raw.withColumns({c: P.F.lit(None).cast("string") for c in P.COLUMNS if c not in raw.columns and not c.startswith(("occupation", "age_band", "employment", "source"))}), "v2")
    assert made.columns == list(P.COLUMNS) and len(made.columns) == 26
    row = made.first()
    assert (row["age_band_5"], row["occupation_raw"], row["occupation_scale"], row["source_version"]) == ("30-34", "会社員 大手 経営", "大手", "v2")


def test_composition_report_has_weights_and_a_total(spark):
    report = spark.createDataFrame([("a", 50, 30, 90, 20), ("b", 50, 10, 10, 40), ("c", 0, 0, 0, 0)], "cell_id string, requested long, achieved long, candidates long, shortfall long")
    got = {r["cell_id"]: (r["requested"], r["achieved"], r["candidates"], r["weight"]) for r in D.composition_report(report).collect()}
    assert got == {"a": (50, 30, 90, pytest.approx(0.5 / 0.75)), "b": (50, 10, 10, pytest.approx(2.0)), "c": (0, 0, 0, 0.0), None: (100, 40, None, None)}


def test_tables_keep_their_schema_beside_their_files(spark, tmp_path):
    """A table's columns are known without a footer, and still are all columns after rows of another schema."""
    where = str(tmp_path / "t")
    write_table(spark.createDataFrame([("s1", 1)], "survey_id string, a int"), where)
    assert kept_schema(spark, where).fieldNames() == ["survey_id", "a"]
    write_table(spark.createDataFrame([("s2", 2, "x")], "survey_id string, a int, b string"), where, "append")
    got = sorted((r["survey_id"], r["a"], r["b"]) for r in read_table(spark, where).collect())
    assert got == [("s1", 1, None), ("s2", 2, "x")]
    merge_upsert(spark, spark.createDataFrame([("s2", 2, 0.5)], "survey_id string, a int, c double"), where, ["survey_id", "a"], evolve_schema=True)
    assert sorted(read_table(spark, where).columns) == ["a", "b", "c", "survey_id"]
    assert sorted(((r["survey_id"], r["c"]) for r in read_table(spark, where).collect()), key=repr) == [("s1", None), ("s2", 0.5)]
    write_table(spark.createDataFrame([("s9", 9)], "survey_id string, z int"), where)
    assert sorted(read_table(spark, where).columns) == ["survey_id", "z"]


def test_foreign_tables_are_read_as_they_are(spark, tmp_path):
    where = str(tmp_path / "foreign")
    spark.range(3).write.parquet(where)
    spark.range(3).selectExpr("id", "id as more").write.mode("append").parquet(where)
    assert kept_schema(spark, where) is None
    assert read_table(spark, where, merge=True).columns == ["id", "more"] and read_table(spark, where).count() == 6
    keep_schema(spark, where, spark.range(1).selectExpr("id", "id as more").schema)
    assert read_table(spark, where).columns == ["id", "more"]
