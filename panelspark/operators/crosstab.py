"""Weighted cross-tabulations over concepts, measures and segment axes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.answers import defined_codes, has_quality_flag

# fixed values: texts of tables
UNKNOWN = "(不明)"
LEGEND = " の選択肢: "
UNANSWERED = "回答が1件も無いため n=0 で出している: "
GROUP = ["survey_id", "measure", "stimulus_id", "axis", "segment"]


def answer_frame(responses: DataFrame, panel: DataFrame, persons: DataFrame, questions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Answers of main panel members with their weight (1 if null), attributes (null if unknown), and definition codes.

    questions: survey_id, question_id, measure, type, n_options.  Answers to
    other questions are dropped.
    """
    main = panel.filter(F.col("role") == "main").select("survey_id", "persona_uuid", "cell_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    who = persons.select(F.col("uuid").alias("persona_uuid"), *columns)
    df = responses.join(questions.select("survey_id", "question_id", "measure", "type", "n_options"), ["survey_id", "question_id"])
    df = df.join(main.join(who, "persona_uuid", "left"), ["survey_id", "persona_uuid"])
    return df.withColumn("codes", defined_codes(F.col("answer_codes"), F.col("options_order"))).withColumn("flagged", has_quality_flag(F.col("flags")))


def known(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(UNKNOWN))


def axis_values(axes: Sequence[str]) -> Column:
    """(axis, segment) of a row on each axis: total, a column, or columns joined by _x_; total always comes first."""
    names = [a for a in axes if a != "total"]
    values = [F.struct(F.lit("total").alias("axis"), F.lit("total").alias("segment"))]
    values += [F.struct(F.lit(a).alias("axis"), F.concat_ws(" × ", *(known(c) for c in a.split("_x_"))).alias("segment")) for a in names]
    return F.array(*values)


def segment_rows(answers: DataFrame, axes: Sequence[str]) -> DataFrame:
    return answers.select("*", F.explode(axis_values(axes)).alias("_x")).select("*", "_x.axis", "_x.segment").drop("_x")


def pre_aggregated(answers: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Answers summed at the finest grain of the axes and codes, then put on the axes: axes multiply groups, not rows."""
    columns = sorted({c for a in axes if a != "total" for c in a.split("_x_")})
    inside = F.array_distinct(F.filter("codes", lambda c: (c >= 1) & (c <= F.col("n_options"))))
    grain = answers.withColumn("codes", inside).groupBy("survey_id", "measure", "stimulus_id", "type", "n_options", *columns, "codes", "flagged").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))
    return segment_rows(grain, axes)


def crosstab(answers: DataFrame, axes: Sequence[str]) -> DataFrame:
    """A row per group and option: n, n_unflagged, share (weighted; options nobody chose are 0, as is a weight of 0).

    n counts rows with a code inside the options.  Totals and options come from
    one pass over the grain: code 0 stands for the whole row.
    """
    rows = pre_aggregated(answers.filter(F.col("type").isin("single", "multi", "scale")), axes)
    valid = F.size("codes") > 0
    unflagged = F.when(F.col("flagged"), 0).otherwise(F.col("rows"))
    each = rows.select(*GROUP, "type", "n_options", F.when(valid, F.col("rows")).otherwise(0).alias("rows"), F.when(valid, unflagged).otherwise(0).alias("unflagged"), F.when(valid, F.col("weight")).otherwise(0.0).alias("weight"), F.explode(F.array_append("codes", F.lit(0))).alias("code"))
    sums = each.groupBy(*GROUP, "type", "n_options", "code").agg(F.sum("rows").alias("n"), F.sum("unflagged").alias("n_unflagged"), F.sum("weight").alias("w"))
    whole = F.col("code") == 0
    one = sums.groupBy(*GROUP, "type", "n_options").agg(F.max(F.when(whole, F.col("n"))).alias("n"), F.max(F.when(whole, F.col("n_unflagged"))).alias("n_unflagged"), F.max(F.when(whole, F.col("w"))).alias("total"), F.map_from_entries(F.collect_list(F.struct("code", "w"))).alias("by_code"))  # a group has as many codes as options
    dense = one.select("*", F.explode(F.sequence(F.lit(1), F.col("n_options").cast("int"))).alias("code"))
    share = F.when(F.col("total") > 0, F.coalesce(F.try_element_at("by_code", F.col("code")), F.lit(0.0)) / F.col("total")).otherwise(0.0)
    return dense.select(*GROUP, "type", "n_options", "code", "n", "n_unflagged", share.alias("share"))


def top_box(table: DataFrame, boxes: DataFrame) -> DataFrame:
    """Sum of the shares of a measure's top options; null where the measure has none.  boxes: survey_id, measure, top_box."""
    df = table.join(boxes, ["survey_id", "measure"])
    share = F.sum(F.when(F.array_contains("top_box", F.col("code")), F.col("share")).otherwise(0.0))
    return df.groupBy(*GROUP).agg(F.when(F.bool_or(F.coalesce(F.size("top_box"), F.lit(0)) > 0), share).alias("top_box_share"))


def mean_scores(answers: DataFrame, axes: Sequence[str], ordinal: DataFrame) -> DataFrame:
    """Weighted mean of K + 1 - code, by the first code inside the options, for ordinal measures.  ordinal: survey_id, measure."""
    df = answers.join(ordinal, ["survey_id", "measure"], "left_semi").filter(F.col("type") != "multi")
    first = F.get(F.filter("codes", lambda c: (c >= 1) & (c <= F.col("n_options"))), F.lit(0))
    df = df.withColumn("code", first).filter("code is not null").groupBy("survey_id", "measure", "stimulus_id", "n_options", *_columns(axes), "code").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))
    df = segment_rows(df, axes)
    return df.groupBy(*GROUP).agg(F.sum("rows").alias("n"), (F.sum(F.col("weight") * (F.col("n_options") + 1 - F.col("code"))) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean_score"))


def _columns(axes: Sequence[str]) -> list[str]:
    return sorted({c for a in axes if a != "total" for c in a.split("_x_")})


def numeric_metrics(answers: DataFrame, axes: Sequence[str]) -> DataFrame:
    """n and weighted mean of the numbers in numeric answers, commas left out."""
    number = F.replace("answer_text", F.lit(","), F.lit("")).try_cast("double")
    df = segment_rows(answers.filter(F.col("type") == "numeric").withColumn("number", number).filter("number is not null"), axes)
    return df.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count_if(~F.col("flagged")).alias("n_unflagged"), (F.sum(F.col("weight") * F.col("number")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean"))


def quality_split(answers: DataFrame) -> DataFrame:
    """Answers and flagged answers of a survey, and whether their share calls for a note."""
    df = answers.groupBy("survey_id").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))
    return df.select("*", F.round(F.col("n_flagged") / F.col("n"), 6).alias("share"), (F.col("n_flagged") / F.col("n") > 0.05).alias("note"))


def complete_concepts(table: DataFrame, stimuli: DataFrame, measures: DataFrame) -> DataFrame:
    """Totals of every concept and measure of the definition; without an answer n is 0 and shares are null."""
    total = table.filter("axis = 'total'").select("survey_id", "measure", "stimulus_id", "code", "n", "share")
    grid = stimuli.join(measures, "survey_id").select("survey_id", "stimulus_id", "measure", F.explode(F.sequence(F.lit(1), F.col("n_options").cast("int"))).alias("code"))
    return grid.join(total, ["survey_id", "measure", "stimulus_id", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def measure_table(table: DataFrame, most_options: int) -> DataFrame:
    """Options as columns option_1, option_2, ...; an option that a measure lacks is null."""
    wide = table.groupBy(*GROUP, "n", "n_unflagged").pivot("code", list(range(1, most_options + 1))).agg(F.first("share"))
    return wide.select(*GROUP, "n", "n_unflagged", *(F.col(f"`{k}`").alias(f"option_{k}") for k in range(1, most_options + 1)))


def metric_table(table: DataFrame, boxes: DataFrame, means: DataFrame, most_options: int, numeric: DataFrame | None = None) -> DataFrame:
    """measure_table with top_box_share and mean_score (null where a measure has none); numeric measures have their mean only."""
    wide = measure_table(table, most_options).join(top_box(table, boxes), GROUP, "left").join(means.select(*GROUP, "mean_score"), GROUP, "left")
    if numeric is None:
        return wide
    return wide.unionByName(numeric.select(*GROUP, "n", "n_unflagged", F.col("mean").alias("mean_score")), allowMissingColumns=True)


def segment_sums(answers: DataFrame, axes: Sequence[str], most_options: int) -> DataFrame:
    """One row of sums per group of every axis, from one pass over the answers: rows, weights, weights by option, scores and numbers.

    Answers are summed at the finest grain of the axes first; grouping sets then
    add up the grain once for each axis.  All sums can be merged with those of
    other answers.
    """
    columns = _columns(axes)
    choice = F.col("type").isin("single", "multi", "scale")
    inside = F.filter("codes", lambda c: (c >= 1) & (c <= F.col("n_options")))
    number = F.when(F.col("type") == "numeric", F.replace("answer_text", F.lit(","), F.lit("")).try_cast("double"))
    plain = answers.select("survey_id", "measure", "stimulus_id", "type", "n_options", *(known(c).alias(c) for c in columns), "flagged", "weight", F.when(choice, F.array_distinct(inside)).alias("codes"), F.when(choice & (F.col("type") != "multi"), F.get(inside, F.lit(0))).alias("first"), number.alias("number"))
    what = ["survey_id", "measure", "stimulus_id", "type", "n_options"]
    grain = plain.filter("codes is not null or number is not null").groupBy(*what, *columns, "codes", "first", "flagged").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("number")).alias("number"))
    sets = {"total": [], **{a: a.split("_x_") for a in axes if a != "total"}}
    counted = (F.size("codes") > 0) | F.col("codes").isNull()
    weight = F.when(counted, F.col("weight"))
    score = F.col("n_options") + 1 - F.col("first")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = grain.groupingSets([[*what, *(c for c in columns if c in s)] for s in sets.values()], *what, *columns).agg(
        zero(F.when(counted, F.col("rows"))).alias("n"), zero(F.when(counted & ~F.col("flagged"), F.col("rows"))).alias("n_unflagged"), zero(weight).alias("w"),
        *(zero(F.when(F.array_contains("codes", k), F.col("weight"))).alias(f"w_{k}") for k in range(1, most_options + 1)),
        F.sum(F.when(F.col("first").isNotNull(), F.col("weight"))).alias("score_w"), F.sum(F.col("weight") * score).alias("score"), F.sum("number").alias("number"),
        *(F.grouping(c).alias(f"without_{c}") for c in columns),
    )
    is_set = lambda s: reduce(Column.__and__, (F.col(f"without_{c}") == int(c not in s) for c in columns), F.lit(True))
    name = F.coalesce(*(F.when(is_set(s), a) for a, s in sets.items()))
    segment = F.coalesce(*(F.when(is_set(s), F.concat_ws(" × ", *s) if s else F.lit("total")) for s in sets.values()))
    return sums.select(*what, name.alias("axis"), segment.alias("segment"), "n", "n_unflagged", "w", *(f"w_{k}" for k in range(1, most_options + 1)), "score_w", "score", "number")


def stacked_metrics(answers: DataFrame, axes: Sequence[str], measures: DataFrame, most_options: int) -> DataFrame:
    """Every measure, concept and segment in one table: n, n_unflagged, option_1 ..., top_box_share, mean_score.

    Shares of the options that a measure has (0 if their weights are), the share
    of its top box if it has one, and the mean score of an ordinal measure or the
    mean of a numeric one; anything else is null.
    measures: survey_id, measure, top_box (array), ordinal.
    """
    sums = segment_sums(answers, axes, most_options).join(measures.select("survey_id", "measure", "top_box", "ordinal"), ["survey_id", "measure"])
    numeric = F.col("type") == "numeric"
    share = lambda k: F.when(~numeric & (F.col("n_options") >= k), F.when(F.col("w") > 0, F.col(f"w_{k}") / F.col("w")).otherwise(0.0))
    options = {f"option_{k}": share(k) for k in range(1, most_options + 1)}
    top = reduce(Column.__add__, (F.when(F.array_contains("top_box", k), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for k, c in enumerate(options.values(), 1)), F.lit(0.0))
    mean = F.when(numeric, F.col("number") / F.nullif("w", F.lit(0.0))).when(F.col("ordinal"), F.col("score") / F.nullif("score_w", F.lit(0.0)))
    return sums.select(*GROUP, "n", "n_unflagged", *(c.alias(n) for n, c in options.items()), F.when(~numeric & (F.size("top_box") > 0), top).alias("top_box_share"), mean.alias("mean_score"))


def with_unanswered(table: DataFrame, stimuli: DataFrame, measures: DataFrame) -> DataFrame:
    """The stacked table with a row of n = 0, and nothing else, for each concept and measure of the definition without one."""
    grid = stimuli.select("survey_id", "stimulus_id").join(measures.select("survey_id", "measure"), "survey_id")
    empty = grid.join(table.select("survey_id", "measure", "stimulus_id").distinct(), ["survey_id", "measure", "stimulus_id"], "left_anti")
    zero = F.lit(0).cast("long")
    return table.unionByName(empty.select("survey_id", "measure", "stimulus_id", zero.alias("n"), zero.alias("n_unflagged")), allowMissingColumns=True)


def legend(questions: DataFrame) -> DataFrame:
    """survey_id, ord, measure, note: what stands below a stacked table, whose option columns have numbers only.

    For each measure, in the order in which measures first occur, its question
    and, if it has options, their labels.  Open questions aren't tabulated.
    questions: survey_id, ord, measure, type, text, options (array).
    """
    first = questions.filter("type <> 'open'").groupBy("survey_id", "measure").agg(F.min_by(F.struct("ord", "text", "options"), "ord").alias("q")).select("survey_id", "measure", "q.*")
    labels = F.array_join(F.transform("options", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), " / ")
    notes = F.array(F.concat("measure", F.lit(": "), "text"), F.when(F.size("options") > 0, F.concat("measure", F.lit(LEGEND), labels)))
    return first.select("survey_id", "measure", "ord", F.posexplode(F.filter(notes, lambda x: x.isNotNull())).alias("line", "note")).select("survey_id", "ord", "line", "measure", "note")


def unanswered_note(table: DataFrame, stimuli: DataFrame) -> DataFrame:
    """survey_id, note: one line that names the concepts and measures of n = 0 rows; surveys without any have none.

    stimuli: survey_id, stimulus_id, name, of which a survey has few.
    """
    empty = table.filter("axis is null").join(stimuli, ["survey_id", "stimulus_id"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("measure", "stimulus_id", "name"))), lambda x: F.concat(x["name"], F.lit(" / "), x["measure"]))
    return empty.groupBy("survey_id").agg(F.concat(F.lit(UNANSWERED), F.array_join(names, "・")).alias("note"))


def labelled_options(wide: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The table of one measure with its options' columns named '1. label', and no others."""
    names = {f"option_{k}": f"{k}. {label}" for k, label in enumerate(labels, 1)}
    return wide.select(*(F.col(c).alias(names.get(c, c)) for c in wide.columns if c in names or not c.startswith("option_")))


def require_answers(answers: DataFrame) -> DataFrame:
    """The answer frame, but an error if nobody has answered: there is nothing to aggregate."""
    if answers.isEmpty():
        raise ValueError("no main panel member has answered")
    return answers


def display(wide: DataFrame, shares: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """Shares as 12.3%, means as 3.21, nulls as -."""
    text = lambda c, form, scale, places: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(form, F.round(F.col(c) * scale, places))).alias(c)
    return wide.select(*(text(c, "%.1f%%", 100, 1) if c in shares else text(c, "%.2f", 1, 2) if c in means else F.col(c) for c in wide.columns))


def off_target(answers: DataFrame, cells: DataFrame) -> DataFrame:
    """survey_id, kind, value: sexes and cells among the answers that no cell of the definition names.

    Sexes are left out where some cell takes any sex; null and empty values don't count.
    """
    seen = answers.select("survey_id", F.explode(F.array(F.struct(F.lit("sex").alias("kind"), F.col("sex").alias("value")), F.struct(F.lit("cell_id").alias("kind"), F.col("cell_id").alias("value")))).alias("x")).select("survey_id", "x.*").filter("value is not null and value <> ''").distinct()
    named = cells.select("survey_id", F.explode(F.array(F.struct(F.lit("sex").alias("kind"), F.col("sex").alias("value")), F.struct(F.lit("cell_id").alias("kind"), F.col("cell_id").alias("value")))).alias("x")).select("survey_id", "x.*")
    open_sex = named.filter("kind = 'sex' and value is null").select("survey_id", "kind").distinct()
    return seen.join(open_sex, ["survey_id", "kind"], "left_anti").join(named.distinct(), ["survey_id", "kind", "value"], "left_anti")


def composition(panel: DataFrame, cells: DataFrame) -> DataFrame:
    """Target, roles, incidence and weight (4 places, 1 by default) of each cell, in definition order ord.

    A survey in which nobody is reserve or screened out wasn't screened and has no incidence.
    """
    got = panel.groupBy("survey_id", "cell_id").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("main", "reserve", "screened_out", "candidate")), F.max(F.when(F.col("role") == "main", F.col("weight"))).alias("weight"))
    screened = F.max(F.col("reserve") + F.col("screened_out")).over(Window.partitionBy("survey_id")) > 0  # of all cells, those that the definition lacks included
    df = cells.join(got.withColumn("_screened", screened), ["survey_id", "cell_id"], "left")
    passed, out = F.coalesce(F.col("main") + F.col("reserve"), F.lit(0)), F.coalesce("screened_out", F.lit(0))
    return df.select("survey_id", "cell_id", "ord", F.col("n").alias("target"), *(F.coalesce(r, F.lit(0)).alias(r) for r in ("main", "reserve", "screened_out", "candidate")), F.when(F.col("_screened") & (passed + out > 0), F.round(passed / (passed + out), 6)).alias("incidence"), F.round(F.coalesce("weight", F.lit(1.0)), 4).alias("weight"))


def open_ends(answers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Answers to open questions, in key order within and across partitions."""
    keys = ["survey_id", "stimulus_id", "question_id", "persona_uuid"]
    return answers.filter(F.col("type") == "open").select("survey_id", "stimulus_id", "question_id", "persona_uuid", *columns, "answer_text").repartitionByRange(*keys).sortWithinPartitions(*keys)


def labelled(answers: DataFrame, stimuli: DataFrame, options: DataFrame) -> DataFrame:
    """Raw rows with the concept's name and labels 'n. text' joined by |, in definition order; no label for texts.

    stimuli: survey_id, stimulus_id, name.  options: survey_id, question_id, options (array).
    """
    df = answers.join(stimuli, ["survey_id", "stimulus_id"], "left").join(options, ["survey_id", "question_id"], "left")
    none = F.array().cast("array<string>")
    label = lambda c: F.concat(c.cast("string"), F.lit(". "), F.coalesce(F.when(c >= 1, F.get(F.coalesce("options", none), c - 1)), F.lit(UNKNOWN)))
    return df.withColumn("labels", F.when(F.col("type").isin("open", "numeric"), "").otherwise(F.array_join(F.transform(F.array_sort("codes"), label), "|"))).drop("options")
