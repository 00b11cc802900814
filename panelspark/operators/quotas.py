"""Quota cells of any number of surveys: generation, shares, apportionment, weights, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEX_LETTERS = {"男": "M", "女": "F"}
#: Years of a bin in which cells and census bands meet.
CENSUS_YEARS = 5
IN_LISTS = ("prefecture", "region", "area", "marital_status", "education_level")


def generate_cells(ranges: DataFrame) -> DataFrame:
    """Equal age bands of each (survey, sex, lo, hi, band): cell_id like M_20_29, in definition order ord.

    A range that isn't a multiple of its band is an error, never a short band.
    """
    even = F.assert_true((F.col("hi") - F.col("lo") + 1) % F.col("band") == 0, "an age range is not a multiple of its band")
    letter = F.coalesce(F.create_map(*(F.lit(x) for kv in SEX_LETTERS.items() for x in kv))[F.col("sex")], F.col("sex"))
    starts = ranges.filter(even.isNull()).select("*", F.explode(F.sequence("lo", F.col("hi") - F.col("band") + 1, "band")).alias("age_min"))
    cells = starts.withColumn("age_max", (F.col("age_min") + F.col("band") - 1).cast("int"))
    order = F.row_number().over(Window.partitionBy("survey_id").orderBy("sex_ord", "age_min")).cast("int")
    return cells.select("survey_id", "size", F.concat_ws("_", letter, "age_min", "age_max").alias("cell_id"), "sex", "age_min", "age_max", "factor", order.alias("ord"))


def equal_shares(cells: DataFrame) -> DataFrame:
    return cells.withColumn("proportion", 1.0 / F.count("*").over(Window.partitionBy("survey_id")))


def population_shares(cells: DataFrame, census: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares by population inside the requested ranges; the rounding residue goes to the last cell.

    Census bands count where they lie inside a cell; a cell without population is an error.
    ``by`` names further columns that a cell and a census band share, such as the
    region.  A cell is cut into bins of five years and meets the bands that start
    in one of them, so this is an equality join, of a census of any size.
    """
    key = ["sex", *by, "_bin"]
    bin_of = lambda age: F.floor(F.col(age) / CENSUS_YEARS)
    rows = census.select("sex", *by, bin_of("age_min").alias("_bin"), F.col("age_min").alias("_lo"), F.col("age_max").alias("_hi"), "population")
    spread = cells.withColumn("_bin", F.explode_outer(F.sequence(bin_of("age_min"), bin_of("age_max"))))
    within = (F.col("age_min") <= F.col("_lo")) & (F.col("_hi") <= F.col("age_max"))
    people = spread.join(rows, key, "left").groupBy(*cells.columns).agg(F.sum(F.when(within, F.col("population"))).alias("population"))
    people = people.filter(F.assert_true(F.coalesce(F.col("population"), F.lit(0)) > 0, "a cell has no population").isNull())
    per = Window.partitionBy("survey_id")
    return last_takes_rest(people.withColumn("proportion", F.col("population") / F.sum("population").over(per)))


def last_takes_rest(cells: DataFrame) -> DataFrame:
    """Proportions that sum to one: the last cell (by ord) is one minus the others."""
    per = Window.partitionBy("survey_id")
    others = F.coalesce(F.sum("proportion").over(per.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return cells.withColumn("proportion", F.when(F.col("ord") == F.max("ord").over(per), 1.0 - others).otherwise(F.col("proportion")))


def apportion(cells: DataFrame) -> DataFrame:
    """n persons a cell by largest remainders: floors first, then one each by remainder, ties by cell_id.

    A given n (count mode) passes through.  Columns: survey_id, cell_id, size, proportion and maybe n.
    """
    exact = F.col("proportion") * F.col("size")
    floor = F.floor(exact)
    per = Window.partitionBy("survey_id")
    given = F.col("n") if "n" in cells.columns else F.lit(None)
    df = cells.withColumn("_floor", floor).withColumn("_rest", F.greatest(F.col("size") - F.sum("_floor").over(per), F.lit(0)))
    place = F.row_number().over(per.orderBy((exact - F.col("_floor")).desc(), "cell_id"))
    n = F.col("_floor") + F.when(place <= F.col("_rest"), 1).otherwise(0)
    return df.withColumn("n", F.coalesce(given, n).cast("int")).drop("_floor", "_rest")


def candidate_sizes(cells: DataFrame) -> DataFrame:
    return cells.withColumn("candidates", (F.col("n") * F.col("factor")).cast("int"))


def cell_weights(cells: DataFrame, achieved: DataFrame) -> DataFrame:
    """weight = target share / achieved share; an empty cell and an empty survey weigh 0.

    The target is the proportion where there is one, else n / size.
    achieved: survey_id, cell_id, achieved.
    """
    df = cells.join(achieved, ["survey_id", "cell_id"], "left").withColumn("achieved", F.coalesce("achieved", F.lit(0)))
    total = F.sum("achieved").over(Window.partitionBy("survey_id"))
    target = F.coalesce(F.col("proportion"), F.col("n") / F.col("size"))
    return df.withColumn("weight", F.when(F.col("achieved") == 0, 0.0).otherwise(target / (F.col("achieved") / total)))


def cell_condition(cell: dict) -> Column:
    """One filter of a definition as a predicate; a missing field sets no condition, no field is always true."""
    parts = []
    if cell.get("sex") is not None:
        parts.append(F.col("sex") == cell["sex"])
    if cell.get("age_min") is not None:
        parts.append(F.col("age") >= cell["age_min"])
    if cell.get("age_max") is not None:
        parts.append(F.col("age") <= cell["age_max"])
    parts += [F.col(c).isin(list(cell[c])) for c in IN_LISTS if cell.get(c)]
    return reduce(Column.__and__, parts, F.lit(True))


def match_counts(persons: DataFrame, cells: list[dict], everyone: dict | None = None) -> DataFrame:
    """cell_id, candidates, and overlapping (persons in more than one cell), in one pass over the persons."""
    keep = cell_condition(everyone or {})
    hits = [F.coalesce(keep & cell_condition(c), F.lit(False)) for c in cells]
    several = reduce(Column.__add__, [h.cast("int") for h in hits]) > 1
    one = persons.agg(F.count_if(several).alias("overlapping"), *(F.count_if(h).alias(f"_{i}") for i, h in enumerate(hits)))
    rows = F.explode(F.array(*(F.struct(F.lit(c["cell_id"]).alias("cell_id"), F.col(f"_{i}").alias("candidates")) for i, c in enumerate(cells))))
    return one.select(rows.alias("x"), "overlapping").select("x.cell_id", "x.candidates", "overlapping")


def safety_filter(ranges: DataFrame) -> DataFrame:
    """One filter around all ranges of a survey: its sex if there is only one, and the age envelope."""
    return ranges.groupBy("survey_id").agg(F.when(F.count_distinct("sex") == 1, F.min("sex")).alias("sex"), F.min("lo").alias("age_min"), F.max("hi").alias("age_max"))


def target_summary(cells: DataFrame) -> DataFrame:
    """Per survey and sex the age range, open where any cell is open, in definition order."""
    open_or = lambda c, f: F.when(F.count_if(F.col(c).isNull()) > 0, None).otherwise(f(c))
    return cells.groupBy("survey_id", "sex").agg(open_or("age_min", F.min).alias("age_min"), open_or("age_max", F.max).alias("age_max"), F.min("ord").alias("ord"))


def quota_audit(cells: DataFrame) -> DataFrame:
    """survey_id, cell_id, issue: every issue of every definition.

    duplicate_cell, bad_n, bad_proportion by cell; bad_size, n_not_size, proportion_not_one by survey (cell_id null).
    """
    twice = cells.groupBy("survey_id", "cell_id").agg(F.count("*").alias("k")).filter("k > 1").select("survey_id", "cell_id", F.lit("duplicate_cell").alias("issue"))
    bad = cells.select("survey_id", "cell_id", F.explode(F.filter(F.array(F.when((F.col("mode") == "count") & ~(F.coalesce("n", F.lit(0)) > 0), "bad_n"), F.when((F.col("mode") == "proportion") & ~(F.coalesce("proportion", F.lit(0.0)) > 0), "bad_proportion")), lambda x: x.isNotNull())).alias("issue"))
    sums = cells.groupBy("survey_id").agg(F.first("mode").alias("mode"), F.max("size").alias("size"), F.sum("n").alias("n"), F.sum("proportion").alias("p"))
    whole = F.array(F.when(F.col("size") <= 0, "bad_size"), F.when((F.col("mode") == "count") & (F.col("n") != F.col("size")), "n_not_size"), F.when((F.col("mode") == "proportion") & (F.abs(F.col("p") - 1) > 1e-6), "proportion_not_one"))
    surveys = sums.select("survey_id", F.lit(None).cast("string").alias("cell_id"), F.explode(F.filter(whole, lambda x: x.isNotNull())).alias("issue"))
    return twice.unionByName(bad).unionByName(surveys)
