"""Reading, writing and maintaining tables kept as Parquet, partitioned by survey."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION = "survey_id"


def is_path(where: str) -> bool:
    return "/" in where


def read_table(spark: SparkSession, where: str, schema: T.StructType | str | None = None, merge: bool = False) -> DataFrame:
    """A catalog table, or a Parquet path: with the schema given, else that kept beside its files, else that of one of them.

    Only with ``merge`` the footers of all files are read for their columns.
    """
    if not is_path(where):
        return spark.read.table(where)
    schema = schema or (None if merge else kept_schema(spark, where))
    if schema is not None:
        return spark.read.schema(schema).parquet(where)
    return spark.read.option("mergeSchema", merge).parquet(where)


def _schema_file(where: str) -> str:
    return f"{where.rstrip('/')}/_schema"  # such names are no data to Spark


def keep_schema(spark: SparkSession, where: str, schema: T.StructType) -> None:
    """Writes a table's schema beside its files, where readers find it without opening any."""
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(_schema_file(where))


def wider(before: T.StructType, now: T.StructType) -> T.StructType:
    """The columns of a table and those that rows of another schema add."""
    return T.StructType([*before.fields, *(f for f in now.fields if f.name not in before.names)])


def kept_schema(spark: SparkSession, where: str) -> T.StructType | None:
    if not table_exists(spark, _schema_file(where)):
        return None
    return T.StructType.fromJson(json.loads(spark.read.text(_schema_file(where)).first()["value"]))


def location(spark: SparkSession, where: str) -> str:
    """The folder of a table given by path or by catalog name."""
    if is_path(where):
        return where
    return spark.sql(f"describe formatted {where}").filter("col_name = 'Location'").first()["data_type"]


def refresh(spark: SparkSession, where: str) -> None:
    """Tells the catalog which partitions a table has now."""
    if not is_path(where):
        spark.sql(f"msck repair table {where} sync partitions")
        spark.catalog.refreshTable(where)


def read_persons(spark: SparkSession, paths: Sequence[str], version: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Shards of a person table, with the version they came in as a column."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths).withColumn("source_version", F.lit(version))


def write_table(df: DataFrame, where: str, mode: str = "overwrite", partition: str | None = PARTITION) -> None:
    """Overwrites (the schema may change) or appends, partitioned by survey where that column exists."""
    writer = df.write.mode(mode).format("parquet").option("partitionOverwriteMode", "static")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    if not is_path(where):
        writer.saveAsTable(where)
        return
    before = kept_schema(df.sparkSession, where) if mode == "append" else None
    writer.save(where)
    keep_schema(df.sparkSession, where, wider(before, df.schema) if before else df.schema)


def write_bucketed(df: DataFrame, name: str, key: str, n_buckets: int, path: str | None = None) -> None:
    """Overwrites a catalog table whose files are dealt by a hash of ``key``, one sorted file a bucket.

    Tables dealt into as many buckets by the same values join and group by that
    key without a shuffle.  A key that holds much of a table makes one large
    bucket, so deal by persons rather than by surveys.
    """
    writer = df.repartition(n_buckets, key).write.mode("overwrite").format("parquet").bucketBy(n_buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


@contextmanager
def colocated(spark: SparkSession) -> Iterator[None]:
    """Inside, a join by several keys needs no shuffle if its sides are dealt alike by some of them.

    Spark asks for all keys otherwise, lest few values of a part of the key make
    few tasks.  It holds for plans that are run inside.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table_exists(spark: SparkSession, where: str) -> bool:
    if not is_path(where):
        return spark.catalog.tableExists(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-independent content hash: two tables agree if these do.

    A row's text names its columns by order and gives each value with its
    length, a null as itself, so that values can't move between columns.
    """
    value = lambda c: F.col(f"`{c}`").cast("string")
    row = F.concat(*(F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("null")) for c in sorted(df.columns)))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content"))


def reject_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, failing at run time if a key occurs twice (a merge would be ambiguous)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_row"))
    checked = counts.withColumn("_ok", F.assert_true(F.col("_n") == 1, "duplicate key in the source of an upsert"))
    return checked.filter(F.col("_ok").isNull()).select("_row.*")


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], evolve_schema: bool = False) -> DataFrame:
    """Rows of target without a partner in source, and all of source."""
    added = [c for c in source.columns if c not in target.columns]
    if added and not evolve_schema:
        raise ValueError(f"the source has columns that the target lacks: {', '.join(added)}")
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def merge_upsert(spark: SparkSession, source: DataFrame, where: str, keys: Sequence[str], evolve_schema: bool = False) -> None:
    """Upserts into a partitioned table; only partitions that source touches are rewritten."""
    source = cut(reject_duplicate_keys(source, keys))
    if not table_exists(spark, where):
        write_table(source, where)
        forget(source)
        return
    touched = source.select(PARTITION).distinct()
    table = read_table(spark, where)
    new = cut(merged(table.join(touched, PARTITION, "left_semi"), source, keys, evolve_schema))
    added = [f for f in new.schema.fields if f.name not in table.columns]
    if added and not is_path(where):
        spark.sql(f"alter table {where} add columns ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in added)})")
    replace_partitions(new, where)
    forget(source)
    forget(new)


def replace_partitions(df: DataFrame, where: str) -> None:
    """Overwrites the partitions that df has rows of."""
    spark = df.sparkSession
    if is_path(where) and (before := kept_schema(spark, where)) is not None:
        keep_schema(spark, where, wider(before, df.schema))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(location(spark, where))
    refresh(spark, where)


def replace_survey(spark: SparkSession, df: DataFrame, where: str, survey_ids: Sequence[str]) -> None:
    """The rows of these surveys become df's; a survey that df has no row of loses its rows."""
    if table_exists(spark, where):
        left = {r[PARTITION] for r in df.select(PARTITION).distinct().filter(F.col(PARTITION).isin(list(survey_ids))).collect()}
        for survey in set(survey_ids) - left:
            delete_survey(spark, where, survey)
    replace_partitions(df, where)


def delete_survey(spark: SparkSession, where: str, survey_id: str) -> None:
    """Drops the partition of one survey."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(survey_id)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{location(spark, where)}/{PARTITION}={escaped}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    refresh(spark, where)


def read_census(spark: SparkSession, path: str) -> DataFrame | None:
    """sex, age_min, age_max, population; None if there is no file or no row, an error if a cell is blank."""
    if not table_exists(spark, path):
        return None
    df = spark.read.schema("sex string, age_min int, age_max int, population int").option("header", True).option("mode", "FAILFAST").csv(path)
    blank = F.count_if(F.greatest(*(F.col(c).isNull() for c in df.columns)))
    found = df.agg(F.count("*").alias("n"), blank.alias("blank")).first()
    if found["blank"]:
        raise ValueError(f"{found['blank']} rows of {path} have a blank cell")
    return df if found["n"] else None


def write_csv(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def flat_for_csv(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrays joined by |, rows range-partitioned and sorted by key, for a distributed dump in key order."""
    columns = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*columns).repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_outputs(folder: str, by_measure: DataFrame, stacked: DataFrame, composition: DataFrame, open_ends: DataFrame, raw: DataFrame) -> None:
    """The result set of a survey: one table per measure, the stacked one, composition, open answers and raw rows."""
    write_csv(by_measure, f"{folder}/by_measure", "measure")
    for name, df in (("stacked", stacked), ("composition", composition), ("open_ends", open_ends), ("raw", raw)):
        write_csv(df, f"{folder}/{name}")


def run_record(outcome: DataFrame, **payload) -> DataFrame:
    """Rows of the run history: the outcome's columns and metadata_json, an object of the payload's columns and values.

    outcome: survey_id, survey_name, survey_type, run_id, started_at,
    finished_at, sessions_total, _ok, _failed, _skipped, aborted_reason, and
    whatever columns the payload names.
    """
    own = ["survey_id", "survey_name", "survey_type", "run_id", "started_at", "finished_at", "sessions_total", "sessions_ok", "sessions_failed", "sessions_skipped", "aborted_reason"]
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    held = F.struct(F.col("run_id"), *(value(v).alias(k) for k, v in payload.items()))
    return outcome.select(*own, F.to_json(held).alias("metadata_json"))


def append_run(spark: SparkSession, where: str, record: DataFrame) -> None:
    record.write.mode("append").parquet(where)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, one of this machine, which only a local session may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all can reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that its lineage ends there and any executor can reread it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(written: DataFrame) -> None:
    """Deletes what :func:`cut` wrote, once nothing reads it any more; other tables stay."""
    path = getattr(written, "written_to", None)
    if path:
        spark = written.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
