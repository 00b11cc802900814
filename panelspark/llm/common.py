"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.tables import cut, forget, shared_folder  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from which operators derive how many buckets they deal out."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("n")).first()["n"] or 0)


def buckets(spark: SparkSession, nbytes: float, per_bucket: int) -> int:
    """Enough buckets that one holds about per_bucket bytes, and at least as many as shuffle partitions.

    Beyond 4096 buckets they grow up to eightfold before their number does: the
    blocks that tasks and buckets exchange number tasks times buckets.
    """
    size = min(max(per_bucket, nbytes / 4096), 8 * per_bucket)
    return max(shuffle_width(spark), int(nbytes // size) + 1)


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A key of a row's id and text: rows that share it have the same result, so repeated rows are harmless."""
    return F.xxhash64(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_column).cast("string")) % folds
