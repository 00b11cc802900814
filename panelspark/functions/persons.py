"""Normalising person rows: occupation parts, age bands, the fixed column order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: suffix words of an occupation and what they mean
SCALES = ("大手", "中堅", "中小")
ROLES = ("経営",)
EMPLOYMENT = {"(現在は引退)": "引退", "(現在は離職)": "離職"}
EMPLOYMENT_DEFAULT = "就業中"
CENTENARIAN = "100歳以上"


def _suffix(words) -> str:
    return r"\s(" + "|".join(re.escape(w) for w in words) + ")$"


def occupation(raw: Column) -> dict[str, Column]:
    """industry, scale, role and employment, taken off the end of an occupation in reverse order.

    A missing scale or role is null; a null occupation has industry ''.
    """
    raw = F.coalesce(raw, F.lit(""))
    mark = F.regexp_extract(raw, _suffix(EMPLOYMENT), 1)
    employed = F.coalesce(F.create_map(*(F.lit(x) for kv in EMPLOYMENT.items() for x in kv))[F.when(mark != "", mark)], F.lit(EMPLOYMENT_DEFAULT))
    rest = F.regexp_replace(raw, _suffix(EMPLOYMENT), "")
    role = F.nullif(F.regexp_extract(rest, _suffix(ROLES), 1), F.lit(""))
    rest = F.regexp_replace(rest, _suffix(ROLES), "")
    scale = F.nullif(F.regexp_extract(rest, _suffix(SCALES), 1), F.lit(""))
    return {"occupation_industry": F.regexp_replace(rest, _suffix(SCALES), ""), "occupation_scale": scale, "occupation_role": role, "employment_status": employed}


def age_band_5(age: Column) -> Column:
    low = (F.floor(age / 5) * 5).cast("int")
    return F.when(age >= 100, CENTENARIAN).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))


def age_band_10(age: Column) -> Column:
    return F.when(age >= 100, CENTENARIAN).otherwise(F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("代")))


# fixed values: the columns of the persons table, in their order
COLUMNS = (
    "uuid", "sex", "age", "age_band_5", "age_band_10", "prefecture", "region", "area", "marital_status", "education_level",
    "occupation_raw", "occupation_industry", "occupation_scale", "occupation_role", "employment_status",
    "persona", "cultural_background", "professional_persona", "sports_persona", "arts_persona", "travel_persona", "culinary_persona",
    "skills_and_expertise", "hobbies_and_interests", "career_goals_and_ambitions", "source_version",
)


def normalise(persons: DataFrame, version: str) -> DataFrame:
    """The 26 columns of the persons table in their order: occupation becomes occupation_raw and its parts, bands and source_version are added.

    Other columns go; a column that persons lack is an error.
    """
    made = {"occupation_raw": F.col("occupation"), **occupation(F.col("occupation")), "age_band_5": age_band_5(F.col("age")), "age_band_10": age_band_10(F.col("age")), "source_version": F.lit(version)}
    lacking = [c for c in COLUMNS if c not in made and c not in persons.columns]
    if lacking:
        raise ValueError(f"persons lack {', '.join(lacking)}")
    return persons.select(*(made.get(c, F.col(c)).alias(c) for c in COLUMNS))
