"""Parsing raw answers in bulk, row flags, and the straightlining pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import answers as A

CHOICE = ("single", "scale", "multi")


def parse_answers(raw: DataFrame, questions: DataFrame) -> DataFrame:
    """raw plus answer_codes, answer_text, answer_reasoning and flags.

    questions: survey_id, question_id, type, n_options, with_reason.  Questions that ask
    for a reason are read from JSON only.  A code beyond the options flags
    out_of_range, no code of a choice question parse_error, a refusal phrase
    refusal (even beside a code), more than one attempt retried.
    """
    q = questions.select("survey_id", "question_id", F.col("type").alias("_type"), F.col("n_options").alias("_k"), F.col("with_reason").alias("_why"))
    df = raw.join(q, ["survey_id", "question_id"])
    text, scan = F.coalesce("answer_raw", F.lit("")), ~F.col("_why")
    one = A.single_code(text, scan)
    none = F.array().cast("array<int>")
    codes = F.when(F.col("_type").isin("single", "scale"), F.array_compact(F.array(one))).when(F.col("_type") == "multi", A.multi_codes(text, scan)).otherwise(none)
    reason = F.when(F.col("_why") & F.col("_type").isin(*CHOICE), A.reasoning(text))
    df = df.withColumn("answer_codes", codes).withColumn("answer_text", F.when(F.col("_type") == "open", F.trim(text)).when(F.col("_type") == "numeric", A.numeric_text(text))).withColumn("answer_reasoning", reason)
    flag = lambda cond, name: F.when(cond, name)
    flags = F.array(
        flag(F.col("_type").isin(*CHOICE) & (F.size("answer_codes") == 0), "parse_error"),
        flag(F.exists("answer_codes", lambda c: (c < 1) | (c > F.col("_k"))), "out_of_range"),
        flag(A.is_refusal(text, F.col("answer_reasoning")), "refusal"),
        flag(F.col("attempt") > 1, "retried"),
        flag(F.col("exhausted") if "exhausted" in raw.columns else F.lit(False), "output_limit"),
    )
    return df.withColumn("flags", F.filter(flags, lambda x: x.isNotNull())).drop("_type", "_k", "_why")


def mark_straightlining(responses: DataFrame, questions: DataFrame, least: int = 3) -> DataFrame:
    """The flag straightline on all rows of a person whose coded single and scale answers, at least ``least``, stand at one place; taken off all others."""
    asked = questions.filter(F.col("type").isin("single", "scale")).select("survey_id", "question_id").distinct().withColumn("_asked", F.lit(True))
    df = responses.join(asked, ["survey_id", "question_id"], "left")
    # a window holds one person's answers to one survey; answers are parsed and dealt once
    own = Window.partitionBy("survey_id", "persona_uuid")
    place = F.when(F.col("_asked") & (F.size("answer_codes") > 0), F.get("answer_codes", F.lit(0)))
    coded = F.when(F.col("_asked") & (F.size("answer_codes") > 0), True)
    df = df.withColumns({"_place": place, "_coded": coded})
    same = (F.count("_coded").over(own) >= least) & (F.min("_place").over(own) == F.max("_place").over(own)) & F.col("survey_id").isNotNull() & F.col("persona_uuid").isNotNull()
    df = df.withColumn("_same", same)
    plain = F.array_except(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit("straightline")))
    return df.withColumn("flags", F.when(F.col("_same"), F.array_append(plain, "straightline")).otherwise(plain)).select(*responses.columns)
