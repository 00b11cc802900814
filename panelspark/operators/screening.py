"""Screening: verdict rows in, panel roles out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.answers import defined_codes, digit_runs, integers_of
from panelspark.operators.draw import dense_number
from panelspark.operators.quotas import cell_weights
from panelspark.sources.tables import cut, forget

RANK_BUCKET = 100_000


def settings_fingerprint(settings: dict) -> str:
    """Sixteen hex digits that change with any judging setting, whatever the order of its keys."""
    import hashlib
    import json

    left_out = {"oversample_factor", "concurrency"}
    text = json.dumps({k: v for k, v in settings.items() if k not in left_out}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def valid_verdicts(responses: DataFrame, config_hash: str) -> DataFrame:
    """Verdicts of these settings that aren't judge errors, codes in definition order; null flags are kept."""
    ok = ~F.coalesce(F.array_contains("flags", "judge_error"), F.lit(False))
    return responses.filter((F.col("config_hash") == config_hash) & ok).withColumn("codes", defined_codes(F.col("answer_codes"), F.col("options_order"))).withColumn("passed", F.size("codes") > 0)


def still_to_judge(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    return candidates.join(verdicts.select("survey_id", "persona_uuid"), ["survey_id", "persona_uuid"], "left_anti")


def judge_batches(candidates: DataFrame, size: int) -> DataFrame:
    """batch and position (from 1) of each candidate: a survey's whole list in cell and draw order, cut every ``size``; stable when run again."""
    place = F.struct("cell_id", F.floor(F.col("cell_rank") / RANK_BUCKET))
    df = dense_number(candidates, ["survey_id"], place, ["cell_rank", "persona_uuid"], "_at")
    at = F.col("_at") - 1
    return df.withColumn("batch", F.floor(at / size).cast("int")).withColumn("position", (at % size + 1).cast("int")).drop("_at")


def spread_replies(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """One verdict per candidate from one reply per batch.

    replies: survey_id, batch, reply, failed.  Named positions pass
    with [1]; a position that the batch lacks flags the whole batch; a failed
    batch has no verdict and judge_error; every row is inferred.
    """
    key = ["survey_id", "batch"]
    sizes = batches.groupBy(*key).agg(F.max("position").alias("members"))
    named = integers_of(digit_runs(F.col("reply")))
    judged = replies.join(sizes, key).select(*key, "failed", named.alias("_named"), F.exists(named, lambda x: (x < 1) | (x > F.col("members"))).alias("_outside"))
    df = batches.join(judged, key)
    codes = F.when(~F.col("failed") & F.array_contains("_named", F.col("position").cast("long")), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    flags = F.filter(F.array(F.lit("inferred"), F.when(F.col("failed"), "judge_error"), F.when(~F.col("failed") & F.col("_outside"), "out_of_range")), lambda x: x.isNotNull())
    return df.select(*(c for c in batches.columns), codes.alias("answer_codes"), flags.alias("flags"))


def finalise(candidates: DataFrame, verdicts: DataFrame, cells: DataFrame, stimuli: Sequence[str] = ()) -> DataFrame:
    """Panel rows: of each cell's passers in draw order the first n are main, later ones reserve, the rest screened_out.

    Main members are ranked anew from 0, with the concepts and the cell's
    weight; the others have no rank, no concept and weight 1.
    cells: survey_id, cell_id, n, size, proportion; a candidate in another cell
    is needed nowhere.
    """
    df = candidates.join(verdicts.select("survey_id", "persona_uuid", F.col("passed").alias("_passed"), F.lit(True).alias("_tested")), ["survey_id", "persona_uuid"], "left")
    df = df.join(cells.select("survey_id", "cell_id", F.col("n").alias("_n")), ["survey_id", "cell_id"], "left")
    df = df.withColumn("_passed", F.coalesce("_passed", F.lit(False)))
    ranked = dense_number(df, ["survey_id", "cell_id", "_passed"], F.floor(F.col("cell_rank") / RANK_BUCKET), ["cell_rank", "persona_uuid"], "_at")
    main = F.col("_passed") & (F.col("_at") <= F.coalesce("_n", F.lit(0)))
    role = F.when(main, "main").when(F.col("_passed"), "reserve").otherwise("screened_out")
    roles = ranked.select("survey_id", "persona_uuid", "cell_id", role.alias("role"), F.when(main, F.col("_at") - 1).cast("int").alias("cell_rank"), F.col("_tested").isNull().alias("untested"))
    # a cell's main members number its passers, up to n
    achieved = df.filter("_passed").groupBy("survey_id", "cell_id").agg(F.least(F.count("*"), F.coalesce(F.max("_n"), F.lit(0))).alias("achieved"))
    weights = cell_weights(cells, achieved).select("survey_id", "cell_id", F.col("weight").alias("_weight"))
    none = F.array().cast("array<string>")
    is_main = F.col("role") == "main"
    concepts = F.when(is_main, F.array(*map(F.lit, stimuli)) if stimuli else none).otherwise(none)
    return roles.join(weights, ["survey_id", "cell_id"], "left").withColumns({"assigned_stimuli": concepts, "weight": F.when(is_main, F.col("_weight")).otherwise(1.0)}).drop("_weight")


def refuse_short(final: DataFrame, cells: DataFrame) -> DataFrame:
    """final, but an error that names the short cells if there are any: such a panel must not be written."""
    short = shortfalls(final, cells).filter("short > 0").orderBy("survey_id", "cell_id").limit(20).collect()
    if short:
        raise ValueError("cells are short: " + ", ".join(f"{r['survey_id']}/{r['cell_id']} by {r['short']}" for r in short))
    return final


def judge_totals(rows: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Calls, tokens, latency and output-budget counts of a survey's judging, once per batch.

    rows: verdict rows, each with its batch's figures (failed, input_tokens,
    output_tokens, latency_ms, escalated, exhausted); summing rows would count a
    call as often as it has candidates.
    """
    figures = ("failed", "input_tokens", "output_tokens", "latency_ms", "escalated", "exhausted")
    calls = rows.groupBy(*batch).agg(*(F.max(c).alias(c) for c in figures))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return calls.groupBy("survey_id").agg(
        F.count("*").alias("batches_total"), F.count_if(~F.col("failed")).alias("batches_ok"), F.count_if("failed").alias("batches_failed"),
        total("input_tokens"), total("output_tokens"), total("latency_ms"), F.count_if("escalated").alias("budget_escalated"), F.count_if("exhausted").alias("budget_exhausted"),
    )


def shortfalls(final: DataFrame, cells: DataFrame) -> DataFrame:
    """cells: survey_id, cell_id, n.  Gives survey_id, cell_id, needed, achieved, short of every cell, those without a candidate included."""
    got = final.groupBy("survey_id", "cell_id").agg(F.count_if(F.col("role") == "main").alias("achieved"))
    df = cells.join(got, ["survey_id", "cell_id"], "full").select("survey_id", "cell_id", F.coalesce("n", F.lit(0)).alias("needed"), F.coalesce("achieved", F.lit(0)).alias("achieved"))
    return df.withColumn("short", F.greatest(F.col("needed") - F.col("achieved"), F.lit(0)))


def incidence(panel: DataFrame) -> DataFrame:
    """Roles and incidence by cell and in total (cell_id null), over tested rows; null if nothing was screened."""
    passed, out = F.count_if(F.col("role").isin("main", "reserve")), F.count_if(F.col("role") == "screened_out")
    df = panel.rollup("survey_id", "cell_id").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("main", "reserve", "screened_out", "candidate")), passed.alias("_p"), out.alias("_o"), F.grouping("cell_id").alias("_total")).filter("survey_id is not null")
    screened = F.max(F.when(F.col("_total") == 1, F.col("_o") + F.col("reserve"))).over(Window.partitionBy("survey_id")) > 0
    rate = F.when(screened & (F.col("_p") + F.col("_o") > 0), F.round(F.col("_p") / (F.col("_p") + F.col("_o")), 6))
    return df.select("survey_id", "cell_id", "main", "reserve", "screened_out", "candidate", rate.alias("incidence"))


def is_finalised(panel: DataFrame) -> DataFrame:
    return panel.groupBy("survey_id").agg((F.count_if(F.col("role") == "candidate") == 0).alias("finalised"))


def unreachable(report: DataFrame, factor: int | Column, attempts_left: int) -> DataFrame:
    """Short cells that no allowed oversampling can fill, with the candidates they would take (null if none passes).

    report: survey_id, cell_id, needed, achieved, reserve, screened_out.
    """
    most = (F.lit(factor) if isinstance(factor, int) else factor) * 2**attempts_left
    passed = F.col("achieved") + F.col("reserve")
    rate = passed / F.nullif(passed + F.col("screened_out"), F.lit(0))
    df = report.filter((F.col("achieved") < F.col("needed")) & (F.col("needed") > 0)).withColumn("rate", rate).filter(rate * most < 1)
    return df.select("survey_id", "cell_id", "needed", F.round("rate", 6).alias("rate"), F.when(passed > 0, F.ceil(F.col("needed") / F.col("rate"))).alias("candidates_needed"))


def next_round(n_short: int, n_unreachable: int, n_untested: int, grew: bool, factor: int, doubled: int, most: int = 3) -> tuple[str, int]:
    """What to do after a round, from its few totals: the decision, and the next oversampling factor."""
    if not n_short:
        return "complete", factor
    if n_unreachable:
        return "unreachable", factor
    if n_untested:
        return "judge_again", factor
    if not grew or doubled >= most:
        return "exhausted", factor
    return "extend", factor * 2


def screen(more: Callable[[int, int], DataFrame], judge: Callable[[DataFrame], DataFrame], stored: DataFrame, cells: DataFrame, config_hash: str, factor: int, stimuli: Sequence[str] = (), most: int = 3, extends: bool = True) -> tuple[DataFrame, list[dict]]:
    """Rounds of screening until every cell is full: the final panel rows, and a log of the rounds.

    more(old, new) gives the candidates (survey_id, persona_uuid, cell_id,
    cell_rank) that an oversampling factor of ``new`` has beyond those of ``old``
    (0: none yet), such as :func:`panelspark.operators.draw.draw_beyond`.
    judge(todo) gives verdict rows of those candidates; verdicts of these
    settings, those in ``stored`` included, are never asked for again.  A round
    writes its new candidates and their verdicts and nothing else; the panel is
    written once, at the end.  Ends with an error that names the short cells if
    none of the rounds allowed can fill them.  What comes to the driver is a few
    totals a round.  Where cells can share persons (``extends`` false) a larger
    draw doesn't extend a smaller one; more is then asked for all candidates, and
    these replace those of the round before.
    """
    candidates, verdicts, log, written, old = None, stored, [], [], 0
    for attempt in range(most + 1):
        grew = False
        if factor > old:
            new = cut(more(old if extends else 0, factor))
            written.append(new)
            grew = not new.isEmpty() if extends else candidates is None or new.count() > candidates.count()
            candidates = candidates.unionByName(new) if extends and candidates is not None else new
        judged = cut(judge(still_to_judge(candidates, valid_verdicts(verdicts, config_hash))))
        written.append(judged)
        verdicts = verdicts.unionByName(judged)
        final = finalise(candidates, valid_verdicts(verdicts, config_hash), cells, stimuli)
        report = composition(final, cells)
        rate = unreachable(report, factor, most - attempt)
        totals = report.agg(F.count_if(F.col("achieved") < F.col("needed")).alias("short")).first()
        seen = final.agg(F.count("*").alias("n"), F.count_if("untested").alias("untested")).first()
        out = rate.count() if totals["short"] else 0
        what, next_factor = next_round(totals["short"], out, seen["untested"], grew, factor, attempt, most)
        log.append({"attempt": attempt + 1, "factor": factor, "candidates": seen["n"], "short": totals["short"], "untested": seen["untested"], "decision": what})
        if what == "complete":
            panel = cut(final)
            for table in written:
                forget(table)
            return panel, log
        if what in ("unreachable", "exhausted") or attempt == most:
            refuse_short(final, cells)
        old, factor = factor, next_factor
    raise AssertionError("the last round either fills the cells or refuses")


def composition(final: DataFrame, cells: DataFrame) -> DataFrame:
    """survey_id, cell_id, needed, achieved, reserve, screened_out of every cell of the definition."""
    got = final.groupBy("survey_id", "cell_id").agg(*(F.count_if(F.col("role") == r).alias(n) for r, n in (("main", "achieved"), ("reserve", "reserve"), ("screened_out", "screened_out"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cells.select("survey_id", "cell_id", F.col("n").alias("needed")).join(got, ["survey_id", "cell_id"], "left").select("survey_id", "cell_id", "needed", zero("achieved"), zero("reserve"), zero("screened_out"))


def with_premise(people: DataFrame, verdicts: DataFrame, premise: str) -> DataFrame:
    """The premise text for persons who passed; null for everyone else."""
    passed = verdicts.filter("passed").select("survey_id", "persona_uuid").distinct().withColumn("premise", F.lit(premise))
    return people.join(passed, ["survey_id", "persona_uuid"], "left")
