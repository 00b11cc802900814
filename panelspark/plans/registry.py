"""Registered queries over the benchmark tables, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
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
from panelspark.plans import config as C
from panelspark.plans import oracles as S
from panelspark.sources.tables import colocated, cut, fingerprint, merged, write_bucketed
from panelspark.sources.views import base, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = dict(S.ORACLES)


def number() -> Column:
    return F.substring("persona_uuid", 2, 8).cast("int")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def text_of(c: str | Column) -> Column:
    """An array as text, so that any two engines compare it alike."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# persons


@query
def occupation_split(spark, sf):
    return view(spark, sf, "persons").select("uuid", *(c.alias(n) for n, c in P.occupation(F.col("occupation")).items()))


@query
def age_bands(spark, sf):
    return view(spark, sf, "persons").select("uuid", P.age_band_5(F.col("age")).alias("age_band_5"), P.age_band_10(F.col("age")).alias("age_band_10"))


@query
def normalize_persons(spark, sf):
    persons = view(spark, sf, "persons")
    texts = {c: F.concat_ws(" ", F.lit(c), "uuid") for c in P.COLUMNS if c.endswith(("persona", "background", "expertise", "interests", "ambitions"))}
    return P.normalise(persons.withColumns(texts), "v1")


# quotas


def _cells(spark, sf):
    return Q.generate_cells(view(spark, sf, "ranges"))


def _shares(spark, sf):
    # the census has persons of 18 and more; cells start at 20
    return Q.population_shares(_cells(spark, sf), view(spark, sf, "census"))


@query
def cells_even(spark, sf):
    return rounded(Q.equal_shares(_cells(spark, sf)), "proportion").select("survey_id", "cell_id", "sex", "age_min", "age_max", "ord", "proportion")


@query
def cells_population(spark, sf):
    return rounded(_shares(spark, sf), "proportion").select("survey_id", "cell_id", "population", "proportion")


@query
def cells_population_regional(spark, sf):
    """Each survey's cells by the population of its own region."""
    regions = base(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("_r"), F.col("r_name").alias("region"))
    cells = _cells(spark, sf).withColumn("_r", F.col("size") % 5).join(regions, "_r").drop("_r")
    shares = Q.population_shares(cells, view(spark, sf, "regional_census"), ["region"])
    return rounded(shares, "proportion").select("survey_id", "cell_id", "region", "population", "proportion")


@query
def apportion(spark, sf):
    return Q.apportion(Q.equal_shares(_cells(spark, sf))).select("survey_id", "cell_id", "size", "n")


@query
def cell_filter_match(spark, sf):
    return Q.match_counts(view(spark, sf, "persons"), C.OVERLAPPING, {"age_min": 20})


@query
def cell_weights(spark, sf):
    cells = Q.candidate_sizes(Q.apportion(Q.equal_shares(_cells(spark, sf))))
    # persons by sex and age first: a few hundred rows, whatever their number
    persons = view(spark, sf, "persons").groupBy("sex", "age").agg(F.count("*").alias("people"))
    got = cells.join(persons, "sex").filter(F.col("age").between(F.col("age_min"), F.col("age_max"))).groupBy("survey_id", "cell_id").agg(F.sum("people").alias("achieved"))
    return rounded(Q.cell_weights(cells, got), "weight").select("survey_id", "cell_id", "candidates", "achieved", "weight")


@query
def quota_audit(spark, sf):
    return Q.quota_audit(view(spark, sf, "typed_cells"))


@query
def target_summary(spark, sf):
    summary = Q.target_summary(view(spark, sf, "typed_cells"))
    return summary.unionByName(Q.safety_filter(view(spark, sf, "ranges")).withColumn("ord", F.lit(-1)))


# draw


def _sized(spark, sf, times: int = 1) -> list[dict]:
    """The cells with quotas that grow with the persons: one in twenty, and no fewer than defined."""
    counts = {r["cell_id"]: r["candidates"] for r in Q.match_counts(view(spark, sf, "persons"), C.CELLS).collect()}  # a row per cell
    return [c | {"n": max(c["n"], counts[c["cell_id"]] // C.PERSONS_PER_QUOTA) * times} for c in C.CELLS]


def _drawn(spark, sf, times: int = 1):
    return D.draw(view(spark, sf, "persons"), _sized(spark, sf, times), C.SEED)


def _candidates(spark, sf):
    """Written once, as candidates are before they are judged."""
    return cut(_drawn(spark, sf, 4)).select(F.lit("s1").alias("survey_id"), F.col("uuid").alias("persona_uuid"), "cell_id", "cell_rank")


@query
def panel_draw(spark, sf):
    return _drawn(spark, sf)


@query
def panel_draw_overlap(spark, sf):
    return D.draw(view(spark, sf, "persons"), C.OVERLAPPING, C.SEED)


@query
def panel_shortfall(spark, sf):
    cells = _sized(spark, sf, 6)
    persons = view(spark, sf, "persons")
    return D.draw_report(D.draw(persons, cells, C.SEED), Q.match_counts(persons, cells), cells)


@query
def panel_report(spark, sf):
    cells = _sized(spark, sf, 6)
    persons = view(spark, sf, "persons")
    report = D.draw_report(D.draw(persons, cells, C.SEED), Q.match_counts(persons, cells), cells)
    return rounded(D.composition_report(report), "weight")


@query
def panel_build(spark, sf):
    panel = D.build_panel(_drawn(spark, sf), C.cells(spark, _sized(spark, sf)), "s1", C.STIMULI, screening=False)
    return rounded(panel, "weight").withColumn("assigned_stimuli", text_of("assigned_stimuli"))


@query
def person_lookup_missing(spark, sf):
    orders = base(spark, sf, "orders").select(F.concat(F.lit("u"), F.lpad((F.col("o_custkey") * 2).cast("string"), 8, "0")).alias("uuid"))
    found, missing = D.lookup(view(spark, sf, "persons"), orders, ["sex", "age"])
    return found.withColumn("missing", F.lit(False)).unionByName(missing.withColumn("missing", F.lit(True)), allowMissingColumns=True)


# screening


def _screener(c):
    codes = F.when(number() % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    flags = F.when(number() % 5 == 0, None).otherwise(F.when(number() % 17 == 0, F.array(F.lit("inferred"), F.lit("judge_error"))).otherwise(F.array(F.lit("inferred"))))
    return c.filter(number() % 7 != 0).select("survey_id", "persona_uuid", codes.alias("answer_codes"), F.array(F.lit(1)).alias("options_order"), flags.alias("flags"), F.when(number() % 19 == 0, "old").otherwise("now").alias("config_hash"))


def _verdicts(candidates):
    return E.valid_verdicts(_screener(candidates), "now")


@query
def screen_todo(spark, sf):
    candidates = _candidates(spark, sf)
    return E.still_to_judge(candidates, _verdicts(candidates))


@query
def screen_batches(spark, sf):
    return E.judge_batches(_candidates(spark, sf), 10)


@query
def screen_verdicts(spark, sf):
    batches = E.judge_batches(_candidates(spark, sf), 10)
    named = F.array_join(F.array_sort(F.collect_list(F.when(number() % 3 == 0, F.col("position")))), "、")
    replies = batches.groupBy("survey_id", "batch").agg(F.concat(F.lit("["), named, F.when(F.col("batch") % 7 == 3, "、99").otherwise(""), F.lit("]")).alias("reply"), (F.col("batch") % 5 == 4).alias("failed"))
    out = E.spread_replies(batches, replies)
    return out.select("survey_id", "persona_uuid", "cell_id", "batch", "position", text_of("answer_codes").alias("codes"), text_of("flags").alias("flags"))


@query
def screen_finalize(spark, sf):
    cells, candidates = C.cells(spark, _sized(spark, sf)), _candidates(spark, sf)
    final = E.finalise(candidates, _verdicts(candidates), cells, C.STIMULI)
    short = E.shortfalls(final, cells).select("survey_id", "cell_id", F.col("short").cast("long"))
    return rounded(final.join(F.broadcast(short), ["survey_id", "cell_id"]), "weight").withColumn("assigned_stimuli", text_of("assigned_stimuli"))


@query
def judge_totals(spark, sf):
    calls = view(spark, sf, "call_log").select(F.col("run_id").alias("survey_id"), F.col("call_id").alias("batch"), "failed", "input_tokens", "output_tokens", "latency_ms", "escalated", "exhausted")
    # the verdict rows of a batch all carry its call's figures
    rows = calls.withColumn("position", F.explode(F.sequence(F.lit(1), (1 + F.col("batch") % 10).cast("int"))))
    return E.judge_totals(rows, ["survey_id", "batch"])


@query
def incidence(spark, sf):
    panel = view(spark, sf, "panel")
    return E.incidence(panel).join(E.is_finalised(panel), "survey_id")


@query
def screen_unreachable(spark, sf):
    return E.unreachable(view(spark, sf, "cell_report"), 4, 1)


@query
def premises(spark, sf):
    candidates = _candidates(spark, sf)
    return E.with_premise(candidates, _verdicts(candidates), C.PREMISE).select("survey_id", "persona_uuid", "premise")


# work plan


def _written(spark, sf):
    """All replies and the surveys fielded, computed and written once, for queries that read them several times."""
    raw = cut(view(spark, sf, "responses_raw"))
    return _with_surveys(spark, sf, {"responses_raw": raw})


def _with_surveys(spark, sf, written):
    return written | {"fielded": cut(view(spark, sf, "fielded", written))}


def _questions(spark, sf, written=None):
    return C.questions(view(spark, sf, "fielded", written))


def _stimuli(spark, sf):
    return C.stimuli(view(spark, sf, "fielded"))


def _refs(df):
    return df.withColumn("refs", F.filter(F.array("ref_a", "ref_b"), lambda x: x.isNotNull()))


def _panel(spark, sf, written=None):
    return view(spark, sf, "panel", written).withColumn("assigned_stimuli", F.array(*map(F.lit, C.STIMULI)))


def _plan(spark, sf):
    plan = W.plan_work(_panel(spark, sf), W.asking_order(_questions(spark, sf)))
    return plan.withColumn("group_pos", F.col("sequence"))


@query
def slot_expand(spark, sf):
    q = view(spark, sf, "clean_questions").select("survey_id", "question_id", "type", "ord")
    return W.expand_slots(q, q.groupBy("survey_id").agg((F.max("ord") + 1).alias("concepts")))


@query
def work_plan(spark, sf):
    return W.plan_work(_panel(spark, sf), W.asking_order(_questions(spark, sf)))


@query
def work_volume(spark, sf):
    return W.work_volume(_plan(spark, sf), _candidates(spark, sf), 10, C.RATES, _questions(spark, sf).select("survey_id", "question_id", "measure"))


@query
def question_audit(spark, sf):
    q = view(spark, sf, "typed_questions").withColumn("refs", F.array("ref_a", "ref_b")).withColumn("top_box", F.array(F.lit(1), "top"))
    return W.question_audit(q, 3)


@query
def memory_edges(spark, sf):
    return W.memory_edges(W.asking_order(_refs(view(spark, sf, "clean_questions"))))


@query
def session_groups(spark, sf):
    q = W.asking_order(_refs(view(spark, sf, "clean_questions")))
    return W.session_groups(q, W.memory_edges(q))


def _parsed(spark, sf):
    q = _questions(spark, sf)
    return O.parse_answers(view(spark, sf, "responses_raw"), q).join(q.select("survey_id", "question_id", "measure", "type"), ["survey_id", "question_id"])


@query
def pending_sessions(spark, sf):
    left = W.pending(_plan(spark, sf), _parsed(spark, sf))
    return W.submission_order(left, False).select("survey_id", "persona_uuid", "stimulus_id", "question_id", "group_pos")


@query
def option_order(spark, sf):
    order = A.presented_order(C.SEED, F.col("uuid"), F.lit("q_intent_s1"), F.lit(5), F.col("age") % 2 == 0)
    return view(spark, sf, "persons").select("uuid", text_of(order).alias("options_order"))


def _parse(spark, sf, measure):
    return _parsed(spark, sf).filter(F.col("measure") == measure).select("persona_uuid", "question_id", text_of("answer_codes").alias("codes"), "answer_text")


@query
def parse_single(spark, sf):
    return _parse(spark, sf, "q_intent").drop("answer_text")


@query
def parse_multi(spark, sf):
    return _parse(spark, sf, "q_multi").drop("answer_text")


@query
def parse_numeric(spark, sf):
    return _parse(spark, sf, "q_price").drop("codes")


@query
def parse_reasoning(spark, sf):
    # each raw answer in a reply of its own shape: quoted as the reason, as plain text, or without a reason
    said = F.replace(F.col("answer_raw"), F.lit('"'), F.lit("'"))
    raw = F.when(F.col("attempt") % 3 == 1, F.concat(F.lit('{"answer": 2, "reasoning": " わかりません \\"'), said, F.lit('\\" "}'))).when(F.col("attempt") % 3 == 2, F.concat(F.lit("わかりません 3 "), said)).otherwise(F.concat(F.lit('{"answer": '), F.length(said).cast("string"), F.lit(', "reasoning": ""}')))
    q = _questions(spark, sf).withColumn("with_reason", F.lit(True))
    out = O.parse_answers(view(spark, sf, "responses_raw").withColumn("answer_raw", raw).filter("question_id like 'q_intent%'"), q)
    return out.select("persona_uuid", "question_id", text_of("answer_codes").alias("codes"), "answer_reasoning", text_of("flags").alias("flags"))


@query
def refusal(spark, sf):
    return view(spark, sf, "responses_raw").select("persona_uuid", "question_id", A.is_refusal(F.col("answer_raw")).alias("refusal"))


@query
def row_flags(spark, sf):
    return _parsed(spark, sf).select("persona_uuid", "question_id", text_of("flags").alias("flags"))


def _responses(spark, sf, written=None):
    """Parsed, straightlining marked, with the options' order."""
    order = F.when(number() % 2 == 0, F.array(*map(F.lit, [3, 1, 2, 5, 4]))).otherwise(F.array(*map(F.lit, [1, 2, 3, 4, 5])))
    written = written or _written(spark, sf)
    q = _questions(spark, sf, written)
    parsed = O.parse_answers(view(spark, sf, "responses_raw", written), q)
    return O.mark_straightlining(parsed, q).withColumn("options_order", order)


@query
def straightline(spark, sf):
    return _responses(spark, sf).select("persona_uuid", "question_id", text_of("flags").alias("flags"))


@query
def upsert_responses(spark, sf):
    raw = view(spark, sf, "responses_raw").select("survey_id", "persona_uuid", "stimulus_id", "question_id", "sequence", "answer_raw")
    new = raw.filter("sequence >= 2").withColumn("answer_raw", F.concat("answer_raw", F.lit("!"))).withColumn("revised", F.lit(True))
    return merged(raw.filter("sequence <= 2"), new, ["survey_id", "persona_uuid", "stimulus_id", "question_id"], evolve_schema=True)


# prompts


@query
def person_cards(spark, sf):
    premise = F.when(F.col("age") >= 60, F.lit(C.PREMISE))
    return view(spark, sf, "persons").select("uuid", M.person_card(C.ATTRIBUTES, "region", C.FIELDS, premise).alias("card"), M.judge_card(C.ATTRIBUTES, "region", C.FIELDS).alias("judge_card"))


@query
def question_blocks(spark, sf):
    q = view(spark, sf, "typed_questions")
    options = F.transform(F.sequence(F.lit(1), "n_options"), lambda i: F.concat(F.lit("opt"), i.cast("string")))
    block = M.question_block(F.concat(F.lit("Question "), "question_id"), F.col("type"), options, C.RULES, C.REASON_RULES, F.col("shuffled"), F.when(F.col("ord") % 2 == 0, 100), F.lit(80))
    return q.select("survey_id", "ord", block.alias("block"))


def _messages(spark, sf, missing=None, sample=False, images=False):
    written = _written(spark, sf)
    q = W.asking_order(_questions(spark, sf, written))
    ids = F.filter(F.array(*(F.lit(x) for x, *_ in C.QUESTIONS)), lambda x: F.substring_index(x, "_s", -1) == F.col("slot").cast("string"))
    q = q.withColumn("remember", F.lit("list")).withColumn("refs", F.slice(ids, 1, F.col("ord")))
    edges = W.memory_edges(q)
    options = F.transform(F.sequence(F.lit(1), F.greatest("n_options", F.lit(1))), lambda i: F.concat(F.lit("opt"), i.cast("string")))
    blocks = q.select("survey_id", "question_id", "slot", M.question_block(F.concat(F.lit("Question "), "question_id"), F.col("type"), options, C.RULES, C.REASON_RULES, F.lit(False), F.lit(None), F.lit(None)).alias("block"), F.concat(F.lit(M.HEADINGS["stimulus"] + "\nConcept "), F.col("slot").cast("string")).alias("stimulus_block"), F.concat(F.lit("system "), "measure").alias("system"))
    answers = view(spark, sf, "responses_raw", written).select("survey_id", "persona_uuid", "question_id", F.col("answer_raw").alias("answer"))
    profile = view(spark, sf, "persons").select(F.col("uuid").alias("persona_uuid"), M.person_card(C.ATTRIBUTES, None, C.FIELDS).alias("profile"))
    panel = _panel(spark, sf, written)
    if sample:
        units = M.prompt_sample(W.plan_work(panel, q)).join(profile, "persona_uuid")
    else:  # profiles and answers meet panel rows, not the units of their questions
        panel = panel.join(profile, "persona_uuid").join(M.replies_by_person(answers), ["survey_id", "persona_uuid"], "left")
        units, answers = W.plan_work(panel, q, ["profile", "given"]), None
    if images:  # of the second concept one, of the third one that is no image and one that is
        blocks = blocks.withColumn("images", F.when(F.col("slot") == 2, F.array(F.lit("img/2.png"))).when(F.col("slot") == 3, F.array(F.lit(""), F.lit('img/"3".png'))))
    out = M.message_rows(units, edges, blocks, answers, missing)
    return out.select("survey_id", "persona_uuid", "question_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.to_json(m["content"]) if images else M.content_text(m["content"]))), "\n---\n").alias("messages"), text_of("missing").alias("missing"))


@query
def message_rows(spark, sf):
    return _messages(spark, sf).drop("missing")


@query
def message_images(spark, sf):
    """The contents as JSON: strings, and lists of parts where a concept with images first appears."""
    return _messages(spark, sf, images=True).drop("missing")


@query
def prompt_sample(spark, sf):
    return _messages(spark, sf, missing="(no answer)", sample=True)


# monitoring


@query
def flag_rates(spark, sf):
    return G.flag_rates(_responses(spark, sf))


@query
def failure_breach(spark, sf):
    return G.first_breach(view(spark, sf, "call_log"), in_a_row=4, window=20, share=0.4)


@query
def run_totals(spark, sf):
    calls = view(spark, sf, "call_log")
    planned = calls.groupBy("run_id").agg((F.count("*") + 50).alias("total")).withColumn("skipped", F.lit(5).cast("long"))
    return G.run_totals(calls, planned).join(G.token_totals(calls), "run_id")


@query
def retry_stats(spark, sf):
    return G.retry_stats(view(spark, sf, "call_log"))


@query
def latency_profile(spark, sf):
    return G.latency_profile(view(spark, sf, "call_log"))


@query
def latency_sketches(spark, sf):
    """Profiles merged from hourly sketches: what is exact, and whether the rest is as near as stated."""
    calls = view(spark, sf, "call_log")
    merged = G.merged_profile(G.call_sketches(calls))
    # the share of latencies below and up to a quantile must hold the rank asked for
    below = lambda c, or_at: F.avg((F.col("latency_ms") <= F.col(c) if or_at else F.col("latency_ms") < F.col(c)).cast("double"))
    near = lambda c, p: ((below(c, False) <= p + 0.02) & (below(c, True) >= p - 0.02)).alias(f"{c}_near")
    ranks = calls.join(merged.select("run_id", "p50", "p95"), "run_id").groupBy("run_id").agg(near("p50", 0.5), near("p95", 0.95))
    out = merged.join(ranks, "run_id")
    return out.select("run_id", "n", "avg_attempt", "max_ms", "p50_near", "p95_near", (F.abs(F.col("calls") / F.col("n") - 1) <= 0.05).alias("calls_near"))


@query
def panel_summary(spark, sf):
    panel = view(spark, sf, "panel")
    summary = G.panel_summary(view(spark, sf, "panel_cells"), E.incidence(panel))
    return summary.join(G.role_counts(panel).groupBy("survey_id").agg(F.count("*").alias("roles"), F.sum("people").alias("people")), "survey_id")


# aggregation


def _frame(spark, sf):
    written = _written(spark, sf)
    return X.answer_frame(_responses(spark, sf, written), view(spark, sf, "panel", written), view(spark, sf, "persons"), _questions(spark, sf, written), C.PERSON_COLUMNS)


@query
def code_remap(spark, sf):
    r = _responses(spark, sf)
    return r.select("persona_uuid", "question_id", text_of(A.defined_codes(F.col("answer_codes"), F.col("options_order"))).alias("codes"))


@query
def answer_frame(spark, sf):
    return _frame(spark, sf).select("survey_id", "persona_uuid", "question_id", "measure", "stimulus_id", "cell_id", "weight", *C.PERSON_COLUMNS, text_of("codes").alias("codes"), "flagged")


@query
def answer_frame_colocated(spark, sf):
    """The frame over responses, panel and persons that are dealt alike by person: parsed and joined without a shuffle of any of them."""
    names = {c: f"panelspark_{c}_{uuid.uuid4().hex}" for c in ("responses", "panel", "persons")}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        write_bucketed(view(spark, sf, "responses_raw"), names["responses"], "persona_uuid", n)
        written = _with_surveys(spark, sf, {"responses_raw": spark.table(names["responses"])})
        write_bucketed(view(spark, sf, "panel", written), names["panel"], "persona_uuid", n)
        write_bucketed(view(spark, sf, "persons"), names["persons"], "uuid", n)
        with colocated(spark):
            frame = cut(X.answer_frame(_responses(spark, sf, written), spark.table(names["panel"]), spark.table(names["persons"]), _questions(spark, sf, written), C.PERSON_COLUMNS))
    finally:
        for name in names.values():
            spark.sql(f"drop table if exists {name}")
    return frame.select("survey_id", "persona_uuid", "question_id", "measure", "stimulus_id", "cell_id", "weight", *C.PERSON_COLUMNS, text_of("codes").alias("codes"), "flagged")


@query
def segment_rows(spark, sf):
    return X.segment_rows(_frame(spark, sf), C.AXES).select("persona_uuid", "question_id", "axis", "segment")


@query
def crosstab_long(spark, sf):
    return rounded(X.crosstab(_frame(spark, sf), C.AXES), "share").drop("type", "n_options")


@query
def top_box(spark, sf):
    boxes = _questions(spark, sf).filter("slot = 1").select("survey_id", "measure", "top_box")
    return rounded(X.top_box(X.crosstab(_frame(spark, sf), C.AXES), boxes), "top_box_share")


@query
def mean_score(spark, sf):
    ordinal = _questions(spark, sf).filter("type = 'scale' or size(top_box) > 0").select("survey_id", "measure").distinct()
    return rounded(X.mean_scores(_frame(spark, sf), C.AXES, ordinal), "mean_score")


@query
def numeric_metric(spark, sf):
    return rounded(X.numeric_metrics(_frame(spark, sf), C.AXES), "mean")


@query
def quality_split(spark, sf):
    return X.quality_split(_frame(spark, sf))


@query
def concept_complete(spark, sf):
    more = view(spark, sf, "fielded").select("survey_id", F.lit("c9").alias("stimulus_id"))
    stimuli = _stimuli(spark, sf).select("survey_id", "stimulus_id").unionByName(more)
    measures = _questions(spark, sf).filter("slot = 1 and n_options > 0").select("survey_id", "measure", "n_options")
    return rounded(X.complete_concepts(X.crosstab(_frame(spark, sf), ["total"]), stimuli, measures), "share")


def _measures(spark, sf):
    return _questions(spark, sf).groupBy("survey_id", "measure").agg(F.min_by("top_box", "slot").alias("top_box"), F.bool_or((F.col("type") == "scale") | (F.size("top_box") > 0)).alias("ordinal"))


def _metrics(spark, sf, frame):
    table = X.stacked_metrics(frame, C.AXES, _measures(spark, sf), 6)
    return rounded(table, *(f"option_{k}" for k in range(1, 7)), "top_box_share", "mean_score")


@query
def crosstab_measure(spark, sf):
    one = _metrics(spark, sf, _frame(spark, sf)).filter("measure = 'q_intent'")
    return X.labelled_options(one, [f"opt{k}" for k in range(1, 6)])


@query
def crosstab_stacked(spark, sf):
    return X.display(_metrics(spark, sf, _frame(spark, sf)), [*(f"option_{k}" for k in range(1, 7)), "top_box_share"], ["mean_score"])


@query
def crosstab_legend(spark, sf):
    q = view(spark, sf, "typed_questions").withColumn("text", F.concat(F.lit("Question "), "question_id"))
    options = F.when(F.col("type").isin("single", "multi", "scale"), F.transform(F.sequence(F.lit(1), "n_options"), lambda k: F.concat(F.lit("opt"), k.cast("string"))))
    return X.legend(q.withColumn("options", F.coalesce(options, F.array().cast("array<string>")))).drop("ord")


@query
def crosstab_unanswered(spark, sf):
    """Concepts that were in the field and got no answer keep a row, and are named."""
    surveys = view(spark, sf, "fielded")
    more = [surveys.select("survey_id", F.lit(f"c{i}").alias("stimulus_id"), F.lit(f"Concept {i}").alias("name")) for i in (8, 9)]
    stimuli = _stimuli(spark, sf).unionByName(more[0]).unionByName(more[1])
    table = X.with_unanswered(_metrics(spark, sf, _frame(spark, sf)), stimuli, _measures(spark, sf))
    rows = table.filter("axis is null").select("survey_id", "measure", "stimulus_id", "n", "n_unflagged", "option_1", "mean_score")
    return rows.join(X.unanswered_note(table, stimuli), "survey_id")


@query
def off_target(spark, sf):
    return X.off_target(_frame(spark, sf), view(spark, sf, "panel_cells"))


@query
def panel_composition(spark, sf):
    return X.composition(view(spark, sf, "panel"), view(spark, sf, "panel_cells"))


@query
def open_ends(spark, sf):
    q = _questions(spark, sf).withColumn("type", F.when(F.col("measure") == "q_price", "open").otherwise(F.col("type")))
    r = O.parse_answers(view(spark, sf, "responses_raw"), q).withColumn("options_order", F.array().cast("array<int>"))
    frame = X.answer_frame(r, view(spark, sf, "panel"), view(spark, sf, "persons"), q, C.PERSON_COLUMNS)
    return X.open_ends(frame, C.PERSON_COLUMNS)


@query
def labelled_raw(spark, sf):
    options = _questions(spark, sf).filter("n_options > 0").select("survey_id", "question_id", F.transform(F.sequence(F.lit(1), "n_options"), lambda i: F.concat(F.lit("opt"), i.cast("string"))).alias("options"))
    return X.labelled(_frame(spark, sf), _stimuli(spark, sf), options).select("persona_uuid", "stimulus_id", "name", "question_id", "labels")


# history


@query
def latest_runs(spark, sf):
    return I.latest_runs(view(spark, sf, "runs"), "main").select("survey_id", "run_id")


@query
def latest_definition(spark, sf):
    d = I.latest_definition(view(spark, sf, "runs"))
    return d.select("survey_id", F.get_json_object("definition", "$.size").cast("int").alias("size"))


@query
def run_metadata(spark, sf):
    """Sizes out of every run's record; one in seven of them is broken, one in eleven has a size that is no number."""
    runs = view(spark, sf, "runs")
    broken = F.when(F.substring("run_id", 2, 20).cast("long") % 7 == 0, F.substring("metadata_json", 1, 20)).when(F.substring("run_id", 2, 20).cast("long") % 11 == 0, F.regexp_replace("metadata_json", r'"size": \d+', '"size": "many"')).otherwise(F.col("metadata_json"))
    read = I.with_metadata(runs.withColumn("metadata_json", broken))
    return read.select("run_id", I.field_of("$.survey.id", "string").alias("id"), I.field_of("$.survey.size", "int").alias("size"), F.col("metadata").isNull().alias("broken"))


@query
def table_fingerprint(spark, sf):
    return fingerprint(view(spark, sf, "responses_raw"))
