"""Run monitoring from responses and call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.answers import ALL_FLAGS

WARN_RATE = 0.05
#: Size of quantile sketches; their ranks are off by about 2.4 / SKETCH_K ** 0.94 at most.
SKETCH_K = 400


def flag_rates(responses: DataFrame) -> DataFrame:
    """survey_id, flag, n, rate and whether the rate of parse_error or refusal calls for a warning."""
    one = responses.groupBy("survey_id").agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(F.array_contains("flags", f), F.lit(False))).alias(f) for f in ALL_FLAGS))
    long = one.unpivot(["survey_id", "total"], list(ALL_FLAGS), "flag", "n")
    rate = F.col("n") / F.col("total")
    return long.select("survey_id", "flag", "n", F.round(rate, 6).alias("rate"), (F.col("flag").isin("parse_error", "refusal") & (rate > WARN_RATE)).alias("warn"))


def token_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id").agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.array_join(F.array_sort(F.collect_set("model_version")), ",").alias("models"))


def first_breach(calls: DataFrame, in_a_row: int = 20, window: int = 100, share: float = 0.5, chunk_seconds: int = 3600) -> DataFrame:
    """run_id, call_id, reason of each run's first breach: failures in a row, or over ``share`` of the last ``window``.

    A run is cut into pieces of its time, numbered first; each piece takes the
    last ``window`` - 1 calls before it along, so no task sorts a whole run.
    """
    from panelspark.operators.draw import dense_number

    piece = F.floor(F.unix_timestamp("ts") / chunk_seconds)
    numbered = dense_number(calls.select("run_id", "call_id", "ts", "failed"), ["run_id"], piece, ["ts", "call_id"], "at")
    width = max(window, in_a_row)
    own = F.floor((F.col("at") - 1) / (10 * width))
    carried = numbered.select("*", F.explode(F.array_distinct(F.array(own, F.floor((F.col("at") - 2 + width) / (10 * width))))).alias("part"))
    order = Window.partitionBy("run_id", "part").orderBy("at")
    recent = order.rowsBetween(-(window - 1), 0)
    streak = order.rowsBetween(-(in_a_row - 1), 0)
    failed = F.col("failed").cast("int")
    df = carried.withColumn("_fails", F.sum(failed).over(recent)).withColumn("_seen", F.count("*").over(recent)).withColumn("_streak", F.sum(failed).over(streak))
    df = df.filter(F.col("part") == own)
    why = F.when(F.col("_streak") >= in_a_row, "consecutive").when((F.col("_seen") >= window) & (F.col("_fails") > share * window), "share")
    return df.withColumn("reason", why).filter("reason is not null").groupBy("run_id").agg(F.min_by(F.struct("call_id", "reason"), "at").alias("x")).select("run_id", "x.call_id", "x.reason")


def run_totals(calls: DataFrame, planned: DataFrame) -> DataFrame:
    """Outcomes and progress of runs.  planned: run_id, total, skipped.  An empty run is complete."""
    seen = calls.groupBy("run_id").agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("failed"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    df = planned.join(seen, "run_id", "left").select("run_id", "total", "skipped", F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("failed", F.lit(0)).alias("failed"), "t0", "t1")
    done = F.col("ok") + F.col("failed") + F.col("skipped")
    minutes = (F.unix_timestamp("t1") - F.unix_timestamp("t0")) / 60
    per_minute = (F.col("ok") + F.col("failed")) / F.nullif(minutes, F.lit(0.0))
    return df.select("run_id", "total", "ok", "failed", "skipped", F.round(F.when(F.col("total") == 0, 1.0).otherwise(done / F.nullif("total", F.lit(0))), 6).alias("progress"), F.round(per_minute, 6).alias("per_minute"), F.round(F.greatest(F.col("total") - done, F.lit(0)) / per_minute, 6).alias("minutes_left"))


def retry_stats(calls: DataFrame) -> DataFrame:
    """Calls, retried calls, retries, back-off, reasons and output-budget counts of each run, with their warnings."""
    df = calls.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("retries") > 0).alias("retried"), F.sum("retries").alias("retries"), F.round(F.sum("backoff_seconds"), 6).alias("backoff_seconds"),
        F.count_if("escalated").alias("escalated"), F.count_if("exhausted").alias("exhausted"),
    )
    by = calls.filter("reason is not null").groupBy("run_id", "reason").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))).alias("r"))
    df = df.join(by, "run_id", "left")
    return df.select("run_id", "calls", "retried", "retries", "backoff_seconds", "escalated", "exhausted", F.coalesce(F.array_join("r", ","), F.lit("")).alias("reasons"), (F.col("retried") / F.col("calls") > WARN_RATE).alias("warn_retries"), (F.col("escalated") + F.col("exhausted") > 0).alias("warn_budget"))


def latency_profile(calls: DataFrame, step: int = 1_000) -> DataFrame:
    """run_id, n, avg_attempt, p50, p95 and max_ms of each run, all exact.

    A quantile is the least latency that as large a share of the run's known
    latencies doesn't exceed.  Calls are counted by latency; the latencies that
    fall into one ``step`` of milliseconds are summed up first, and only the steps
    that hold a rank asked for are ordered by value.
    """
    run = F.col("run_id").eqNullSafe(F.col("_run"))
    values = calls.groupBy("run_id", "latency_ms").agg(F.count("*").alias("rows"), F.sum("attempt").alias("attempts"), F.count("attempt").alias("tries"))
    totals = values.groupBy("run_id").agg(F.sum("rows").alias("n"), F.round(F.sum("attempts") / F.nullif(F.sum("tries"), F.lit(0)), 6).alias("avg_attempt"), F.max("latency_ms").alias("max_ms"), F.coalesce(F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("rows"))), F.lit(0)).alias("_known"))
    known = values.filter("latency_ms is not null").select("run_id", "latency_ms", "rows", F.floor(F.col("latency_ms") / step).alias("_step"))
    rank = lambda percent: F.col("_known") - F.floor(F.col("_known") * (100 - percent) / 100)
    ranks = totals.select(F.col("run_id").alias("_run"), F.explode(F.array(*(F.struct(F.lit(c).alias("of"), rank(p).alias("rank")) for c, p in (("p50", 50), ("p95", 95))))).alias("_asked")).select("_run", "_asked.*")
    steps = known.groupBy("run_id", "_step").agg(F.sum("rows").alias("_n"))
    steps = steps.withColumn("_upto", F.sum("_n").over(Window.partitionBy("run_id").orderBy("_step")))
    near = steps.join(ranks, run & (F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n"))).select("_run", F.col("_step").alias("_at"), "of", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    held = known.join(near, run & (F.col("_step") == F.col("_at")))
    held = held.withColumn("_upto", F.sum("rows").over(Window.partitionBy("run_id", "of").orderBy("latency_ms")))
    least = lambda c: F.min(F.when((F.col("of") == c) & (F.col("_upto") >= F.col("_rank")), F.col("latency_ms"))).alias(c)
    found = held.groupBy(F.col("run_id").alias("_run")).agg(least("p50"), least("p95"))
    return totals.join(found, run, "left").select("run_id", "n", "avg_attempt", "p50", "p95", "max_ms")


def call_sketches(calls: DataFrame, unit: str = "hour", k: int = SKETCH_K) -> DataFrame:
    """run_id, since (the start of an hour), n, attempts, max_ms, latency and ids: what a profile needs of the calls of that hour.

    latency is a quantile sketch of latency_ms and ids a distinct-count sketch of
    call_id, a few kilobytes each whatever the calls; rows of new hours can be
    appended to a table, and :func:`merged_profile` rereads no call.
    """
    hours = calls.groupBy("run_id", F.date_trunc(unit, "ts").alias("since"))
    return hours.agg(F.count("*").alias("n"), F.sum("attempt").alias("attempts"), F.max("latency_ms").alias("max_ms"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("long"), k).alias("latency"), F.hll_sketch_agg(F.col("call_id").cast("long")).alias("ids"))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """run_id, n, avg_attempt, p50, p95, max_ms and calls (distinct call ids) of each run.

    p50 and p95 are latencies whose rank is within 0.01 of the one asked for (99
    times in a hundred, at the default size of sketches), calls is within some
    3 percent; n, avg_attempt and max_ms are exact.
    """
    df = sketches.groupBy("run_id").agg(F.sum("n").alias("n"), F.sum("attempts").alias("attempts"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_bigint("latency").alias("latency"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("calls"))
    quantile = lambda p: F.kll_sketch_get_quantile_bigint("latency", F.lit(p))
    return df.select("run_id", "n", F.round(F.col("attempts") / F.col("n"), 6).alias("avg_attempt"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), "max_ms", "calls")


def role_counts(panel: DataFrame, by: Column | str = "role") -> DataFrame:
    return panel.groupBy("survey_id", by).agg(F.count("*").alias("n"), F.count_distinct("persona_uuid").alias("people"))


def panel_summary(cells: DataFrame, rates: DataFrame) -> DataFrame:
    """Requested, achieved, incidence and judged / size of each survey.

    cells: survey_id, cell_id, n, size.  rates: the totals of screening.incidence.
    """
    asked = cells.groupBy("survey_id").agg(F.sum("n").alias("requested"), F.max("size").alias("size"))
    total = rates.filter("cell_id is null")
    judged = F.col("main") + F.col("reserve") + F.col("screened_out")
    return asked.join(total, "survey_id").select("survey_id", "requested", F.col("main").alias("achieved"), "incidence", F.round(judged / F.col("size"), 6).alias("oversample_actual"))
