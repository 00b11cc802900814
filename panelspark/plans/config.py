"""The survey definition that the registered queries run over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7
AXES = ["total", "sex", "education_level", "sex_x_area"]
PERSON_COLUMNS = ["sex", "age", "area", "education_level", "marital_status"]

#: Matching persons for one place of a quota, in definitions that grow with the persons table.
PERSONS_PER_QUOTA = 20
#: Disjoint cells, and cells that overlap.
CELLS = [
    {"cell_id": "M_18_39", "sex": "男", "age_min": 18, "age_max": 39, "n": 60},
    {"cell_id": "F_18_39", "sex": "女", "age_min": 18, "age_max": 39, "n": 60},
    {"cell_id": "M_40_100", "sex": "男", "age_min": 40, "age_max": 100, "n": 90},
    {"cell_id": "F_40_100", "sex": "女", "age_min": 40, "age_max": 100, "n": 90},
]
OVERLAPPING = [
    {"cell_id": "young", "age_max": 45, "n": 70},
    {"cell_id": "east", "area": ["east"], "n": 80},
    {"cell_id": "men", "sex": "男", "age_min": 30, "n": 50},
    {"cell_id": "single", "marital_status": ["single"], "education_level": ["hs", "college"], "n": 40},
]
STIMULI = ["c1", "c2", "c3"]
BASES = [
    # id, type, options, top box, with_reason
    ("q_intent", "single", 5, [1, 2], False),
    ("q_multi", "multi", 5, [], False),
    ("q_price", "numeric", 0, [], False),
]
QUESTIONS = [(f"{b}_s{s}", b, s, i, kind, k, top, why) for s in (1, 2, 3) for i, (b, kind, k, top, why) in enumerate(BASES)]
ATTRIBUTES = [("age", "歳"), ("sex", ""), ("marital_status", ""), ("education_level", "卒")]
FIELDS = [("prefecture", "居住地"), ("occupation", "職業")]
PREMISE = "【条件】\n- 直近1か月に購入した"
# fixed values: measured tokens and speeds, prices, exchange rate and margin of a budget
RATES = {
    "input_tokens": 1600, "output_tokens": 15, "answers_per_minute": 1190.6,
    "judge_input_tokens": 4500, "judge_output_tokens": 60, "judge_calls_per_minute": 640.0,
    "input_usd_per_million": 1.0, "output_usd_per_million": 6.0, "jpy_per_usd": 150, "budget_margin": 1.1,
}
RULES = {"single": "番号1つで答えてください。", "scale": "番号1つで答えてください。", "multi": "あてはまる番号をすべて答えてください。", "numeric": "数字で答えてください。", "open": "{max_length}字以内で答えてください。"}
REASON_RULES = {"single": "番号1つと理由（{max_length}字以内）を答えてください。", "scale": "番号1つと理由（{max_length}字以内）を答えてください。", "multi": "番号すべてと理由（{max_length}字以内）を答えてください。"}


def questions(surveys: DataFrame) -> DataFrame:
    """The same nine questions in each survey (surveys: survey_id)."""
    fields = ("question_id", "measure", "slot", "ord", "type", "n_options", "top_box", "with_reason")
    value = lambda x: F.array(*map(F.lit, x)).cast("array<int>") if isinstance(x, list) else F.lit(x)
    asked = F.array(*(F.struct(*(value(x).alias(c) for c, x in zip(fields, q, strict=True))) for q in QUESTIONS))
    return surveys.select("survey_id", F.explode(asked).alias("q")).select("survey_id", "q.*")


def cells(spark: SparkSession, sized: list[dict]) -> DataFrame:
    total = sum(c["n"] for c in sized)
    return spark.createDataFrame([("s1", c["cell_id"], i, c["n"], total, c["sex"]) for i, c in enumerate(sized)], "survey_id string, cell_id string, ord int, n int, size int, sex string").selectExpr("*", "cast(null as double) as proportion")


def stimuli(surveys: DataFrame) -> DataFrame:
    shown = F.array(*(F.struct(F.lit(x).alias("stimulus_id"), F.lit(f"Concept {x[1:]}").alias("name")) for x in STIMULI))
    return surveys.select("survey_id", F.explode(shown).alias("s")).select("survey_id", "s.*")
