"""Run history: the latest run of each survey and its definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame, survey_type: str) -> DataFrame:
    """The last run of each survey of a type, newest first; equal times go to the larger run_id."""
    order = Window.partitionBy("survey_id").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return runs.filter(F.col("survey_type") == survey_type).withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at").orderBy(F.desc("finished_at"), F.desc("run_id"))


def latest_definition(runs: DataFrame, path: str = "$.survey") -> DataFrame:
    last = F.max_by("metadata_json", F.struct("finished_at", "run_id"))
    return runs.groupBy("survey_id").agg(F.get_json_object(last, path).alias("definition"))


def with_metadata(runs: DataFrame) -> DataFrame:
    """runs with metadata_json read once, as the variant metadata; null where it isn't JSON.

    Fields of any record, whatever its version, are then taken by path
    (:func:`field_of`) and stored in binary form, not parsed again from text.
    """
    return runs.withColumn("metadata", F.try_parse_json("metadata_json"))


def field_of(path: str, kind: str, metadata: Column | str = "metadata") -> Column:
    """One value of the metadata; null where the record lacks it or holds something of another kind."""
    return F.try_variant_get(F.col(metadata) if isinstance(metadata, str) else metadata, path, kind)


def array_of_json(text: Column, kind: str = "string") -> Column:
    """A JSON list as an array; null or broken text is an empty one."""
    empty = F.array().cast(f"array<{kind}>")
    return F.coalesce(F.from_json(text, f"array<{kind}>"), empty)


def panel_rows(panel: DataFrame, survey_id: str) -> DataFrame:
    return panel.filter(F.col("survey_id") == survey_id)
