"""Small hand-made cases of the survey operators."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.functions import answers as A
from panelspark.functions import persons as P
from panelspark.operators import answers as O
from panelspark.operators import crosstab as X
from panelspark.operators import draw as D
from panelspark.operators import history as I
from panelspark.operators import monitor as G
from panelspark.operators import prompts as M
from panelspark.operators import quotas as Q
from panelspark.operators import screening as E
from panelspark.operators import workplan as W
from panelspark.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["3", "３", "3.", "「3」", "答え: 3", '{"answer": 3}', "3番", '{"answer": "3"}', '{"answer": 3.7}', 'text {"answer": 3} more'])
def test_single_code(spark, raw):
    assert one(spark, A.single_code(F.lit(raw))) == 3


@pytest.mark.parametrize("raw,codes", [("1,3", [1, 3]), ("1、3", [1, 3]), ("1 と 3", [1, 3]), ('{"answers": [3, 1, 3]}', [1, 3]), ('{"answers": []} 2', [2]), ("", []), ("99999999999", [A.BEYOND])])
def test_multi_codes(spark, raw, codes):
    assert one(spark, A.multi_codes(F.lit(raw))) == codes


@pytest.mark.parametrize("raw,code", [('{"answer": -2}', -2), ("-2", 2), ('{"answer": true}', 1), ("なし", None), ('{"other": 4}', 4), ("12345678901234", A.BEYOND)])
def test_single_code_corners(spark, raw, code):
    assert one(spark, A.single_code(F.lit(raw))) == code


@pytest.mark.parametrize("raw,text", [("1,200円", "1,200"), ("-3.5 度", "-3.5"), ("なし", None), ("１２", "12")])
def test_numeric_text(spark, raw, text):
    assert one(spark, A.numeric_text(F.lit(raw))) == text


def test_reason_is_no_refusal(spark):
    raw, reason = F.lit('{"answer": 2, "reasoning": "わかりません \\" と言う"}'), F.lit('わかりません " と言う')
    assert not one(spark, A.is_refusal(raw, reason))
    assert one(spark, A.is_refusal(F.lit("お答えできません 3")))


@pytest.mark.parametrize("codes,order,out", [([2], [3, 1, 2], [1]), ([9], [3, 1, 2], [9]), (None, None, []), ([0, -1], [1], [0, -1])])
def test_defined_codes(spark, codes, order, out):
    df = spark.createDataFrame([(codes, order)], "c array<int>, o array<int>")
    assert df.select(A.defined_codes(F.col("c"), F.col("o")).alias("x")).first()["x"] == out


@pytest.mark.parametrize("raw,parts", [("小売業 中小 経営 (現在は引退)", ("小売業", "中小", "経営", "引退")), ("小売業", ("小売業", None, None, "就業中")), (None, ("", None, None, "就業中")), ("大手", ("大手", None, None, "就業中"))])
def test_occupation(spark, raw, parts):
    c = P.occupation(F.lit(raw).cast("string"))
    assert tuple(spark.range(1).select(*c.values()).first()) == parts


@pytest.mark.parametrize("age,five,ten", [(18, "15-19", "10代"), (29, "25-29", "20代"), (100, "100歳以上", "100歳以上")])
def test_bands(spark, age, five, ten):
    assert (one(spark, P.age_band_5(F.lit(age))), one(spark, P.age_band_10(F.lit(age)))) == (five, ten)


def test_uneven_range_is_an_error(spark):
    ranges = spark.createDataFrame([("s", 10, "男", 1, 20, 34, 10, 4)], "survey_id string, size int, sex string, sex_ord int, lo int, hi int, band int, factor int")
    with pytest.raises(Exception, match="multiple of its band"):
        Q.generate_cells(ranges).collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 500))
def test_apportion_is_largest_remainders(spark, weights, size):
    p = [w / sum(weights) for w in weights]
    df = spark.createDataFrame([("s", f"c{i}", size, x) for i, x in enumerate(p)], "survey_id string, cell_id string, size int, proportion double")
    got = {r["cell_id"]: r["n"] for r in Q.apportion(df).collect()}
    exact = {f"c{i}": x * size for i, x in enumerate(p)}
    want = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - want[k]), k))[: max(0, size - sum(want.values()))]:
        want[k] += 1
    assert got == want


def test_weights(spark):
    cells = spark.createDataFrame([("s", "a", 50, 100, None), ("s", "b", 50, 100, None), ("s", "c", 0, 100, 0.0)], "survey_id string, cell_id string, n int, size int, proportion double")
    got = spark.createDataFrame([("s", "a", 30), ("s", "b", 10)], "survey_id string, cell_id string, achieved long")
    w = {r["cell_id"]: r["weight"] for r in Q.cell_weights(cells, got).collect()}
    assert w["a"] == pytest.approx(0.5 / 0.75) and w["b"] == pytest.approx(2.0) and w["c"] == 0.0


def sequential_draw(people, cells, seed, match):
    taken, out = set(), []
    for c in cells:
        pool = sorted((hashlib.sha256(f"{p['uuid']}|{seed}|{c['cell_id']}".encode()).hexdigest(), p["uuid"]) for p in people if match(p, c) and p["uuid"] not in taken)
        for i, (_, u) in enumerate(pool[: c["n"]]):
            out.append((u, c["cell_id"], i))
            taken.add(u)
    return sorted(out)


def test_overlapping_draw_equals_sequential(spark):
    people = [{"uuid": f"u{i}", "sex": "男" if i % 2 else "女", "age": 18 + i % 60, "area": None, "marital_status": None, "education_level": None, "prefecture": None, "region": None} for i in range(400)]
    cells = [{"cell_id": "a", "sex": "男", "n": 40}, {"cell_id": "b", "age_min": 20, "age_max": 40, "n": 60}, {"cell_id": "c", "n": 300}]
    match = lambda p, c: (c.get("sex") in (None, p["sex"])) and c.get("age_min", 0) <= p["age"] <= c.get("age_max", 999)
    schema = "uuid string, sex string, age int, area string, marital_status string, education_level string, prefecture string, region string"
    df = spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in people], schema)
    assert sorted(map(tuple, D.draw(df, cells, 3).collect())) == sequential_draw(people, cells, 3, match)


def test_larger_draw_extends_a_smaller_one(spark):
    df = spark.range(300).select(F.concat(F.lit("u"), "id").alias("uuid"), F.lit("男").alias("sex"), F.lit(30).alias("age"))
    small, large = (sorted(map(tuple, D.draw(df, [{"cell_id": "x", "sex": "男", "n": n}], 1).collect()), key=lambda r: r[2]) for n in (20, 50))
    assert large[:20] == small


def test_fingerprint_of_settings():
    a = E.settings_fingerprint({"model": "m", "batch_size": 10, "concurrency": 4})
    assert a == E.settings_fingerprint({"batch_size": 10, "model": "m", "concurrency": 9, "oversample_factor": 2}) and len(a) == 16
    assert a != E.settings_fingerprint({"batch_size": 11, "model": "m"})


@pytest.mark.parametrize("args,out", [((0, 0, 0, True, 4, 0), ("complete", 4)), ((1, 1, 0, True, 4, 0), ("unreachable", 4)), ((1, 0, 2, True, 4, 0), ("judge_again", 4)), ((1, 0, 0, True, 4, 0), ("extend", 8)), ((1, 0, 0, True, 4, 3), ("exhausted", 4)), ((1, 0, 0, False, 4, 1), ("exhausted", 4))])
def test_next_round(args, out):
    assert E.next_round(*args) == out


def test_incidence_is_null_without_screening(spark):
    panel = spark.createDataFrame([("s", "a", "main"), ("s", "b", "main")], "survey_id string, cell_id string, role string")
    assert {r["incidence"] for r in E.incidence(panel).collect()} == {None}


def test_crosstab_by_hand(spark):
    rows = [("p1", [1], 3.0), ("p2", [5], 1.0), ("p3", [9], 2.0)]
    df = spark.createDataFrame([("s", "m", "c1", "single", 5, p, c, w, False) for p, c, w in rows], "survey_id string, measure string, stimulus_id string, type string, n_options int, persona_uuid string, codes array<int>, weight double, flagged boolean")
    t = {r["code"]: r for r in X.crosstab(df, ["total"]).collect()}
    assert t[1]["n"] == 2 and t[1]["share"] == 0.75 and t[5]["share"] == 0.25 and t[2]["share"] == 0.0
    ordinal = spark.createDataFrame([("s", "m")], "survey_id string, measure string")
    assert X.mean_scores(df, ["total"], ordinal).first()["mean_score"] == 4.0


def test_answers_are_parsed_by_their_own_survey(spark):
    raw = spark.createDataFrame([("s", "q", "3", 1), ("t", "q", "3", 1)], "survey_id string, question_id string, answer_raw string, attempt int")
    q = spark.createDataFrame([("s", "q", "single", 5, False), ("t", "q", "single", 2, False)], "survey_id string, question_id string, type string, n_options int, with_reason boolean")
    got = {r["survey_id"]: r["flags"] for r in O.parse_answers(raw, q).collect()}
    assert got == {"s": [], "t": ["out_of_range"]}


def test_straightline_is_set_and_cleared(spark):
    rows = [("s", "a", f"q{i}", [2], ["refusal"]) for i in range(3)] + [("s", "b", f"q{i}", [i + 1], ["straightline"]) for i in range(3)]
    df = spark.createDataFrame(rows, "survey_id string, persona_uuid string, question_id string, answer_codes array<int>, flags array<string>")
    # the same question ids in another survey are other questions
    q = spark.createDataFrame([("s", f"q{i}", "single") for i in range(3)] + [("t", f"q{i}", "open") for i in range(3)], "survey_id string, question_id string, type string")
    got = {(r["persona_uuid"], tuple(r["flags"])) for r in O.mark_straightlining(df, q).collect()}
    assert got == {("a", ("refusal", "straightline")), ("b", ())}


def test_breach_across_pieces_of_a_run(spark):
    rows = [("r", i, 1_000_000 + i, 1500 <= i < 1520) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, call_id long, t long, failed boolean").withColumn("ts", F.timestamp_seconds("t"))
    assert tuple(G.first_breach(df).first()) == ("r", 1519, "consecutive")


def test_forward_reference_is_an_error(spark):
    q = spark.createDataFrame([("s", "a", 0, 1, "list", ["b"]), ("s", "b", 1, 1, "none", [])], "survey_id string, question_id string, ord int, slot int, remember string, refs array<string>")
    with pytest.raises(Exception, match="isn't asked before"):
        W.memory_edges(W.asking_order(q)).collect()


def test_upsert_replace_delete(spark, tmp_path):
    where = f"{tmp_path}/responses"
    first = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 3)], "survey_id string, k string, v int")
    T.merge_upsert(spark, first, where, ["survey_id", "k"])
    T.merge_upsert(spark, spark.createDataFrame([("s1", "b", 20, "x"), ("s1", "c", 30, "y")], "survey_id string, k string, v int, extra string"), where, ["survey_id", "k"], evolve_schema=True)
    got = lambda: sorted((r["survey_id"], r["k"], r["v"]) for r in spark.read.option("mergeSchema", True).parquet(where).collect())
    assert got() == [("s1", "a", 1), ("s1", "b", 20), ("s1", "c", 30), ("s2", "a", 3)]
    with pytest.raises(ValueError, match="lacks"):
        T.merged(first, first.withColumn("new", F.lit(1)), ["survey_id", "k"])
    with pytest.raises(Exception, match="duplicate key"):
        T.merge_upsert(spark, first.unionAll(first), where, ["survey_id", "k"])
    T.replace_survey(spark, first.filter("false"), where, ["s1"])
    assert got() == [("s2", "a", 3)]
    assert T.table_exists(spark, where) and not T.table_exists(spark, f"{tmp_path}/none")


def test_census_and_csv(spark, tmp_path):
    assert T.read_census(spark, f"{tmp_path}/none.csv") is None
    (tmp_path / "c.csv").write_text("sex,age_min,age_max,population\n男,20,24,100\n女,20,24,\n")
    with pytest.raises(ValueError, match="blank"):
        T.read_census(spark, f"{tmp_path}/c.csv")
    (tmp_path / "d.csv").write_text("sex,age_min,age_max,population\n男,20,24,100\n")
    assert T.read_census(spark, f"{tmp_path}/d.csv").count() == 1
    df = spark.createDataFrame([("b", [1, 2]), ("a", [])], "k string, codes array<int>")
    assert [tuple(r) for r in T.flat_for_csv(df, ["k"]).collect()] == [("a", ""), ("b", "1|2")]
    T.write_csv(T.flat_for_csv(df, ["k"]), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert T.fingerprint(df).first() == T.fingerprint(df.repartition(7).orderBy(F.desc("id"))).first()


def test_fingerprint_tells_nulls_and_columns_apart(spark):
    schema = "a int, b int, c string"
    rows = [(None, 5, "x"), (5, None, "x"), (5, 5, None), (5, 5, "null"), (55, None, "x"), (5, 5, "")]
    assert len({T.fingerprint(spark.createDataFrame([r], schema)).first()["content"] for r in rows}) == len(rows)


def test_finalised_panel(spark):
    """Reserves and screened-out rows have no rank, no concept and weight 1; main members are ranked anew."""
    people = [("s", f"p{i}", "a" if i < 6 else "b", i) for i in range(9)] + [("s", "p9", "gone", 0)]
    candidates = spark.createDataFrame(people, "survey_id string, persona_uuid string, cell_id string, cell_rank int")
    verdicts = spark.createDataFrame([("s", f"p{i}", i not in (0, 3)) for i in range(10) if i != 5], "survey_id string, persona_uuid string, passed boolean")
    cells = spark.createDataFrame([("s", "a", 2, 4, None), ("s", "b", 2, 4, None)], "survey_id string, cell_id string, n int, size int, proportion double")
    got = {r["persona_uuid"]: (r["role"], r["cell_rank"], r["assigned_stimuli"], r["weight"], r["untested"]) for r in E.finalise(candidates, verdicts, cells, ["c1", "c2"]).collect()}
    assert got["p1"] == ("main", 0, ["c1", "c2"], 1.0, False) and got["p2"] == ("main", 1, ["c1", "c2"], 1.0, False)
    assert got["p4"] == ("reserve", None, [], 1.0, False) == got["p9"] and got["p0"] == ("screened_out", None, [], 1.0, False)
    assert got["p5"] == ("screened_out", None, [], 1.0, True) and got["p6"][1] == 0 and got["p7"][1] == 1 and got["p8"][0] == "reserve"
    final = E.finalise(candidates, verdicts, cells)
    assert E.refuse_short(final, cells) is final
    more = cells.withColumn("n", F.lit(4))
    with pytest.raises(ValueError, match="s/a by 1, s/b by 1"):
        E.refuse_short(E.finalise(candidates, verdicts, more), more)


def test_cells_apart_by_definition():
    assert D.apart({"sex": "男"}, {"sex": "女"}) and not D.apart({"sex": "男"}, {"age_min": 20})
    assert D.apart({"age_max": 39}, {"age_min": 40}) and not D.apart({"age_max": 40}, {"age_min": 40})
    assert D.apart({"area": ["east"]}, {"area": ["west"]}) and not D.apart({"area": ["east", "west"]}, {"area": ["west"]})


def test_overlapping_cells_never_share_a_person(spark):
    df = spark.createDataFrame([(f"u{i}", "男", 20 + i % 30) for i in range(60)], "uuid string, sex string, age int")
    got = D.draw(df, [{"cell_id": "a", "sex": "男", "n": 40}, {"cell_id": "b", "age_min": 25, "n": 40}], 1).collect()
    assert len({r["uuid"] for r in got}) == len(got) <= 60 and sum(r["cell_id"] == "a" for r in got) == 40
    report = D.draw_report(spark.createDataFrame(got), spark.createDataFrame([("a", 60), ("b", 50)], "cell_id string, candidates long"), [{"cell_id": "a", "n": 40}, {"cell_id": "b", "n": 40}])
    with pytest.raises(ValueError, match="b .* of 40"):
        D.require_full(report)


def test_screening_rounds(spark):
    """Every third candidate passes: draws grow until both cells are full, and no verdict is asked for twice."""
    cells = spark.createDataFrame([("s", "a", 4, 8, None), ("s", "b", 4, 8, None)], "survey_id string, cell_id string, n int, size int, proportion double")
    people = spark.createDataFrame([("s", f"{c}{i:03d}", c, i) for c in "ab" for i in range(60)], "survey_id string, persona_uuid string, cell_id string, cell_rank int")
    asked = []

    def judge(todo):
        asked.extend(r["persona_uuid"] for r in todo.collect())
        number = F.substring("persona_uuid", 2, 3).cast("int")
        codes = F.when(number % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
        return todo.select("survey_id", "persona_uuid", codes.alias("answer_codes"), F.array(F.lit(1)).alias("options_order"), F.array(F.lit("inferred")).alias("flags"), F.lit("now").alias("config_hash"))

    stored = judge(people.limit(0))
    given = []

    def more(old, new):
        given.append((old, new))
        return people.filter((F.col("cell_rank") >= 4 * old) & (F.col("cell_rank") < 4 * new))

    final, log = E.screen(more, judge, stored, cells, "now", 1, ["c1"])
    assert given == [(0, 1), (1, 2), (2, 4)] and [x["candidates"] for x in log] == [8, 16, 32]
    assert [x["decision"] for x in log] == ["extend", "extend", "complete"] and [x["factor"] for x in log] == [1, 2, 4]
    assert len(asked) == len(set(asked)) == 32
    roles = {(r["cell_id"], r["role"]): r["count"] for r in final.groupBy("cell_id", "role").count().collect()}
    assert roles["a", "main"] == roles["b", "main"] == 4
    with pytest.raises(ValueError, match="short"):
        E.screen(lambda old, new: people.filter(F.col("cell_rank") < (2 if not old else 0)), judge, stored, cells, "now", 1)


def test_judge_prompts_and_batches(spark):
    rows = [("s", f"p{i}", "ab"[i % 2], i // 2, f"card {i}") for i in range(7)]
    df = E.judge_batches(spark.createDataFrame(rows, "survey_id string, persona_uuid string, cell_id string, cell_rank int, card string"), 4)
    got = {r["batch"]: (r["cards"], r["members"]) for r in M.judge_prompts(df).collect()}
    assert got == {0: ("1. card 0\n2. card 2\n3. card 4\n4. card 6", 4), 1: ("1. card 1\n2. card 3\n3. card 5", 3)}
    todo = spark.createDataFrame([("s", "p0")], "survey_id string, persona_uuid string")
    assert W.skipped_calls(df, todo, 4).first()["skipped"] == 2


def test_image_parts(spark):
    df = spark.createDataFrame([('a "b"\n', ["u/1.png", "", None, "u/2.png"]), ("plain", []), ("none", None)], "t string, u array<string>")
    got = [json.loads(r[0]) for r in df.select(M.with_images(F.col("t"), F.col("u"))).collect()]
    assert got[0] == [{"type": "text", "text": 'a "b"\n'}, {"type": "image_url", "image_url": {"url": "u/1.png"}}, {"type": "image_url", "image_url": {"url": "u/2.png"}}]
    assert got[1:] == ["plain", "none"]


def test_submission_orders(spark):
    units = spark.createDataFrame([("s", f"p{i % 5}", f"c{i % 3}", f"q{i % 4}", i) for i in range(60)], "survey_id string, persona_uuid string, stimulus_id string, question_id string, ask_pos int")
    one = [(r["stimulus_id"], r["question_id"], r["persona_uuid"]) for r in W.submission_order(units, True).collect()]
    many = [(r["persona_uuid"], r["ask_pos"]) for r in W.submission_order(units, False).collect()]
    assert one == sorted(one) and many == sorted(many)
    first = M.prompt_sample(units).collect()
    assert {r["persona_uuid"] for r in first} == {"p0"} and [r["ask_pos"] for r in first] == sorted(r["ask_pos"] for r in first)


def test_history_helpers(spark):
    df = spark.createDataFrame([("[1, 2]",), ("broken",), (None,), ("[]",)], "t string")
    assert [r[0] for r in df.select(I.array_of_json(F.col("t"), "int")).collect()] == [[1, 2], [], [], []]
    panel = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "survey_id string, x int")
    assert [r["x"] for r in I.panel_rows(panel, "b").collect()] == [2]
    runs = spark.createDataFrame([("a", "main", "r1", 1), ("a", "main", "r2", 3), ("b", "main", "r3", 2), ("b", "screening", "r4", 9)], "survey_id string, survey_type string, run_id string, finished_at int")
    assert [r["run_id"] for r in I.latest_runs(runs, "main").collect()] == ["r2", "r3"]


def test_run_records(spark):
    own = "survey_id string, survey_name string, survey_type string, run_id string, started_at int, finished_at int, sessions_total int, sessions_ok int, sessions_failed int, sessions_skipped int, aborted_reason string, tokens int"
    got = T.run_record(spark.createDataFrame([("s", "n", "main", "r", 1, 2, 3, 2, 1, 0, None, 7)], own), tokens=F.col("tokens"), model="m").first()
    assert json.loads(got["metadata_json"]) == {"run_id": "r", "tokens": 7, "model": "m"} and "tokens" not in got.asDict()


def test_catalog_tables_are_upserted_and_evolve(spark, tmp_path):
    spark.sql(f"create table kept_answers (k string, v int, survey_id string) using parquet partitioned by (survey_id) location '{tmp_path}/kept'")
    try:
        T.write_table(spark.createDataFrame([("a", 1, "s1"), ("b", 2, "s2")], "k string, v int, survey_id string"), "kept_answers", "append")
        T.merge_upsert(spark, spark.createDataFrame([("a", 9, "s1", "x"), ("c", 3, "s3", None)], "k string, v int, survey_id string, more string"), "kept_answers", ["survey_id", "k"], evolve_schema=True)
        got = sorted((r["k"], r["v"], r["survey_id"], r["more"]) for r in T.read_table(spark, "kept_answers").collect())
        assert got == [("a", 9, "s1", "x"), ("b", 2, "s2", None), ("c", 3, "s3", None)]
        T.delete_survey(spark, "kept_answers", "s1")
        T.replace_survey(spark, spark.createDataFrame([("d", 4, "s2", "y")], "k string, v int, survey_id string, more string"), "kept_answers", ["s2", "s3"])
        assert [tuple(r[c] for c in ("k", "v", "survey_id", "more")) for r in T.read_table(spark, "kept_answers").collect()] == [("d", 4, "s2", "y")]
    finally:
        spark.sql("drop table kept_answers")
    path = f"{tmp_path}/files"
    T.merge_upsert(spark, spark.createDataFrame([("a", 1, "s1"), ("b", 2, "s2")], "k string, v int, survey_id string"), path, ["survey_id", "k"])
    T.merge_upsert(spark, spark.createDataFrame([("b", 3, "s2", "z")], "k string, v int, survey_id string, more string"), path, ["survey_id", "k"], evolve_schema=True)
    assert sorted((r["k"], r["more"]) for r in T.read_table(spark, path).collect()) == [("a", None), ("b", "z")]


def test_no_answers_is_an_error(spark):
    with pytest.raises(ValueError, match="answered"):
        X.require_answers(spark.range(0))
    df = spark.range(1)
    assert X.require_answers(df) is df


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    from panelspark.sources.views import view
    from panelspark.streaming.monitor import failure_windows

    calls = view(spark, sf, "call_log").select("run_id", "ts", "failed")
    calls.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/calls")
    stream = failure_windows(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/calls"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = (sorted(map(tuple, df.collect())) for df in (spark.table("windows"), failure_windows(calls)))
    assert got and set(got) <= set(want)  # the newest windows may still be open
    assert max(want)[1] is not None


def test_outputs_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("s1", "m1", 1), ("s1", "m2", 2)], "survey_id string, measure string, n int")
    T.write_outputs(f"{tmp_path}/out", df, df, df, df, df)
    assert {r["measure"] for r in spark.read.option("header", True).csv(f"{tmp_path}/out/by_measure").collect()} == {"m1", "m2"}
    for _ in range(2):
        T.append_run(spark, f"{tmp_path}/runs", df)
    assert T.read_table(spark, f"{tmp_path}/runs").count() == 4
    persons = T.read_persons(spark, [f"{tmp_path}/runs"], "v2")
    assert {r["source_version"] for r in persons.collect()} == {"v2"}
