"""The corpus pipeline: five stages over the documents, each written as Parquet and read again.

Every stage works on all that its predecessor kept, with one of the corpus
operators, and all but the last return the columns of documents.  Operators see
an id and a text; all other columns travel beside them in one struct, so columns
of any name come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, lines, packing, setjoin, toxicity
from panelspark.llm.common import cut, forget, table

OWN = ("doc_id", "text")


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as the struct rest (absent if there are none)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, *([F.struct(*rest).alias("rest")] if rest else []))


def together(parts: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, in their order."""
    return parts.select(*(F.col(c) if c in OWN else F.col(f"rest.`{c}`").alias(c) for c in columns))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not rejected as toxic; a null or empty text is as toxic as the labels' base rate, so it stays."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.severity(apart(docs), model)
    return together(scored.filter(F.col("expected_severity") < toxicity.THRESHOLD), docs.columns)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least ten of the documents hold; n_chars follows a text that changed."""
    out = lines.dedup_lines(apart(docs), 10, 1)
    whole = together(out, docs.columns)
    if "n_chars" not in docs.columns:
        return whole
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return out.select(*(F.col(c) if c in OWN else n_chars.alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id (null ids last), of repeated rows any one.

    Wordless texts are in no group and stay.
    """
    numbered = cut(apart(docs).withColumn("row", F.monotonically_increasing_id()))  # written, so that the numbers stand
    groups = setjoin.near_duplicates(numbered.select("row", "text"), 5, 80, "row", "text").filter("n_shingles > 0")
    members = groups.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    gone = members.join(first, "component_id").filter(F.col("row") != F.col("least.row")).select("row")
    return together(numbered.join(gone, "row", "left_anti"), docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a passage of the benchmark."""
    marked = decontaminate.with_passages(apart(docs), table(spark, sf_dir, "benchmark"))
    return together(marked.filter(F.size("passages") == 0), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row per piece."""
    return packing.pack_documents(docs.select(*OWN))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", common_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("best_fit_packing", packed_sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold every stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        forget(before)  # but for the given table, which no stage wrote
    return docs
