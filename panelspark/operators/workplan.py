"""Work plans: slots, memory of earlier questions, session groups, pending work, volumes, audits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_slots(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Every base question once per concept of its survey: id {id}_s{slot}, measure = the base id.

    concepts: survey_id, concepts.
    """
    df = questions.join(concepts, "survey_id")
    df = df.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("concepts").cast("int")))).drop("concepts")
    return df.withColumn("measure", F.col("question_id")).withColumn("question_id", F.concat("question_id", F.lit("_s"), F.col("slot").cast("string")))


def asking_order(questions: DataFrame) -> DataFrame:
    """ask_pos from 0 within a survey: by slot, then as defined."""
    return questions.withColumn("ask_pos", (F.row_number().over(Window.partitionBy("survey_id").orderBy("slot", "ord")) - 1).cast("int"))


def plan_work(panel: DataFrame, questions: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """A unit per main panel row and question, with the concept its slot names; a slot without a concept is an error.

    Columns of the panel named in ``carried`` come along.
    """
    main = panel.filter(F.col("role") == "main").select("survey_id", "persona_uuid", "assigned_stimuli", *carried)
    units = main.join(questions.select("survey_id", "question_id", "slot", "ask_pos"), "survey_id")
    units = units.withColumn("stimulus_id", F.try_element_at("assigned_stimuli", F.col("slot")))
    fine = F.assert_true(F.col("stimulus_id").isNotNull(), "a slot has no assigned concept")
    return units.filter(fine.isNull()).select("survey_id", "persona_uuid", "question_id", "stimulus_id", F.col("slot").alias("sequence"), "ask_pos", *carried)


def memory_edges(questions: DataFrame) -> DataFrame:
    """survey_id, question_id, remembered: the earlier questions replayed before each, in asking order.

    questions: survey_id, question_id, ask_pos, remember (none, all, list) and
    refs (array).  A list is not transitive; a reference forward, to itself or
    to nothing is an error.
    """
    q = questions.select("survey_id", "question_id", "ask_pos", "remember", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    earlier = questions.select("survey_id", F.col("question_id").alias("remembered"), F.col("ask_pos").alias("pos"))
    pairs = q.join(earlier, "survey_id")
    keep = (F.col("pos") < F.col("ask_pos")) & ((F.col("remember") == "all") | ((F.col("remember") == "list") & F.array_contains("refs", F.col("remembered"))))
    edges = pairs.filter(keep)
    found = edges.filter("remember = 'list'").groupBy("survey_id", "question_id").agg(F.count_distinct("remembered").alias("found"))
    wanted = q.filter("remember = 'list'").join(found, ["survey_id", "question_id"], "left")
    fine = F.assert_true(F.coalesce("found", F.lit(0)) == F.size(F.array_distinct("refs")), "a question remembers one that isn't asked before it")
    checked = wanted.filter(fine.isNull()).select("survey_id", "question_id")
    listed = edges.filter("remember = 'list'").join(checked, ["survey_id", "question_id"], "left_semi")
    return edges.filter("remember = 'all'").unionByName(listed).select("survey_id", "question_id", "remembered", F.col("pos").alias("remembered_pos"))


#: Questions of one block of surveys, about.
BLOCK_QUESTIONS = 200_000


def least_reachable(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the least label of all nodes that edges a - b connect it with."""
    top = np.arange(len(label))  # of each node's set so far, the node that stands for it
    while True:
        low = top.copy()
        np.minimum.at(low, top[a], top[b])
        np.minimum.at(low, top[b], top[a])
        while (low[low] != low).any():
            low = low[low]
        if (low[top] == top).all():
            break
        top = low[top]
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, top, label)
    return least[top]


def session_groups(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """survey_id, question_id, group_pos: connected questions share the asking position of the first of them.

    Surveys are dealt into blocks of about as many questions each, and each block
    finds its connected sets in one pass, so the jobs are the same for chains of
    any length.  A survey's own questions meet in one block.
    """
    blocks = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), questions.count() // BLOCK_QUESTIONS + 1)
    kind = {f.name: f.dataType.simpleString() for f in questions.schema}
    block = F.pmod(F.xxhash64("survey_id"), F.lit(blocks))

    def run(_: tuple, asked: pa.Table, remembered: pa.Table) -> pa.Table:
        def key(t: pa.Table, survey: str, c: str) -> pa.ChunkedArray:
            return pc.binary_join_element_wise(t[survey].cast(pa.large_string()), t[c].cast(pa.large_string()), pa.scalar("\0", pa.large_string()))

        parts = [key(asked, "survey_id", "question_id"), key(remembered, "_survey", "_a"), key(remembered, "_survey", "_b")]
        codes = pa.chunked_array([c for p in parts for c in p.chunks], pa.large_string()).combine_chunks().dictionary_encode().indices.to_numpy()
        own, a, b = np.split(codes, np.cumsum([len(p) for p in parts])[:-1])
        label = np.full(int(codes.max()) + 1 if len(codes) else 0, np.iinfo(np.int64).max)
        np.minimum.at(label, own, asked["ask_pos"].to_numpy().astype(np.int64))
        group = pa.array(least_reachable(label, a, b)[own]).cast(asked.schema.field("ask_pos").type)
        return pa.table({"survey_id": asked["survey_id"], "question_id": asked["question_id"], "group_pos": group})

    asked = questions.select("survey_id", "question_id", "ask_pos", block.alias("_block"))
    remembered = edges.select(F.col("survey_id").alias("_survey"), F.col("question_id").alias("_a"), F.col("remembered").alias("_b"), block.alias("_of"))
    return asked.groupBy("_block").cogroup(remembered.groupBy("_of")).applyInArrow(run, f"survey_id {kind['survey_id']}, question_id {kind['question_id']}, group_pos {kind['ask_pos']}")


def pending(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """Units of sessions that aren't wholly done.  A unit is done by a row without parse_error; null flags aren't done.

    plan: survey_id, persona_uuid, question_id, stimulus_id, group_pos.
    """
    key = ["survey_id", "persona_uuid", "stimulus_id", "question_id"]
    done = responses.filter(~F.array_contains("flags", "parse_error")).select(*key).distinct().withColumn("_done", F.lit(True))
    df = plan.join(done, key, "left")
    whole = F.bool_and(F.coalesce("_done", F.lit(False))).over(Window.partitionBy("survey_id", "persona_uuid", "group_pos"))
    return df.withColumn("_whole", whole).filter("not _whole").drop("_done", "_whole")


def submission_order(units: DataFrame, single_units: bool) -> DataFrame:
    """Partitions in an order that keeps shared prefixes together: concept, question, person; or person and asking order."""
    keys = ["stimulus_id", "question_id", "persona_uuid"] if single_units else ["survey_id", "persona_uuid", "ask_pos"]
    return units.repartitionByRange(*keys).sortWithinPartitions(*keys)


def work_volume(plan: DataFrame, candidates: DataFrame, batch_size: int, rates: dict[str, float], measures: DataFrame | None = None) -> DataFrame:
    """Answers, sessions, people, concepts, judge calls, what they take at the given rates, and a budget, per survey.

    plan: units with group_pos.  candidates: survey_id, persona_uuid.  measures:
    survey_id, question_id, measure, for the number of measures asked.
    n_per_concept_min and _max are the people of the least and the most asked concept.
    """
    work = plan.groupBy("survey_id").agg(F.count("*").alias("answers"), F.count_distinct("persona_uuid").alias("people"), F.count_distinct("persona_uuid", "group_pos").alias("sessions"), F.count_distinct("stimulus_id").alias("concepts"))
    per = plan.groupBy("survey_id", "stimulus_id").agg(F.count_distinct("persona_uuid").alias("n")).groupBy("survey_id").agg(F.min("n").alias("n_per_concept_min"), F.max("n").alias("n_per_concept_max"))
    work = work.join(per, "survey_id")
    if measures is not None:
        asked = plan.select("survey_id", "question_id").distinct().join(measures, ["survey_id", "question_id"]).groupBy("survey_id").agg(F.count_distinct("measure").alias("measures"))
        work = work.join(asked, "survey_id", "left")
    calls = candidates.groupBy("survey_id").agg(F.ceil(F.count("*") / batch_size).alias("judge_calls"))
    df = work.join(calls, "survey_id", "left").withColumn("judge_calls", F.coalesce("judge_calls", F.lit(0)))
    tokens = lambda kind: (F.col("answers") * rates[f"{kind}_tokens"] + F.col("judge_calls") * rates[f"judge_{kind}_tokens"]).cast("long").alias(f"{kind}_tokens")
    minutes = F.col("answers") / rates["answers_per_minute"] + F.col("judge_calls") / rates["judge_calls_per_minute"]
    usd = (F.col("input_tokens") * rates["input_usd_per_million"] + F.col("output_tokens") * rates["output_usd_per_million"]) / 1_000_000
    return df.select("*", tokens("input"), tokens("output"), F.round(minutes, 6).alias("minutes")).withColumn("budget_jpy", F.round(usd * rates["jpy_per_usd"] * rates["budget_margin"], 4))


def skipped_calls(candidates: DataFrame, todo: DataFrame, batch_size: int) -> DataFrame:
    """survey_id, skipped: candidates that needn't be judged again, in batches, the unit of all calls."""
    left = todo.groupBy("survey_id").agg(F.count("*").alias("_todo"))
    df = candidates.groupBy("survey_id").agg(F.count("*").alias("_all")).join(left, "survey_id", "left")
    return df.select("survey_id", F.ceil((F.col("_all") - F.coalesce("_todo", F.lit(0))) / batch_size).alias("skipped"))


def question_audit(questions: DataFrame, concepts: int) -> DataFrame:
    """survey_id, question_id, issue: every issue of every definition.

    questions: survey_id, question_id, ord, slot, type, measure, n_options,
    top_box (array), shuffled, remember, refs (array).
    """
    issue = lambda df, name: df.select("survey_id", "question_id", F.lit(name).alias("issue")).distinct()
    q = asking_order(questions)
    choice = F.col("type").isin("single", "multi", "scale")
    out = [issue(q.groupBy("survey_id", "question_id").agg(F.count("*").alias("k")).filter("k > 1"), "duplicate_id")]
    out.append(issue(q.filter(choice & (F.col("n_options") < 2)), "too_few_options"))
    out.append(issue(q.filter(choice & F.exists(F.coalesce("top_box", F.array().cast("array<int>")), lambda i: (i < 1) | (i > F.col("n_options")))), "top_box_out_of_range"))
    out.append(issue(q.filter((F.col("type") == "scale") & F.col("shuffled")), "shuffled_scale"))
    slots = q.select("survey_id").distinct().select("survey_id", F.explode(F.sequence(F.lit(1), F.lit(concepts))).alias("slot"))
    uncovered = slots.join(q.select("survey_id", "slot"), ["survey_id", "slot"], "left_anti").select("survey_id", F.lit(None).cast("string").alias("question_id"))
    out.append(issue(uncovered, "slot_uncovered"))
    shape = F.struct("type", "n_options", "top_box")
    clash = q.groupBy("survey_id", "measure").agg(F.min(shape).alias("a"), F.max(shape).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
    out.append(issue(clash.withColumn("question_id", F.col("measure")), "measure_mismatch"))
    refs = q.filter("remember = 'list'").select("survey_id", "question_id", "ask_pos", F.explode("refs").alias("ref"))
    known = q.groupBy("survey_id", F.col("question_id").alias("ref")).agg(F.min("ask_pos").alias("ref_pos"))
    seen = refs.join(known, ["survey_id", "ref"], "left")
    out.append(issue(seen.filter("ref = question_id"), "remembers_itself"))
    out.append(issue(seen.filter("ref <> question_id and ref_pos is null"), "remembers_unknown"))
    out.append(issue(seen.filter("ref <> question_id and ref_pos >= ask_pos"), "remembers_later"))
    all_issues = out[0]
    for df in out[1:]:
        all_issues = all_issues.unionByName(df)
    return all_issues
