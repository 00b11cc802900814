"""Survey-shaped views of the benchmark tables, as SQL that Spark and DuckDB both read.

Each view names the views and tables it needs; :func:`with_views` strings them
into common table expressions, and :func:`view` runs one on Spark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "persons": ((), """
select concat('u', lpad(cast(c_custkey as string), 8, '0')) as uuid,
       case when c_custkey % 2 = 0 then '男' else '女' end as sex,
       cast(18 + (c_custkey * 7) % 83 as int) as age,
       n_name as prefecture, r_name as region,
       case when n_regionkey <= 1 then 'east' else 'west' end as area,
       case c_custkey % 3 when 0 then 'single' when 1 then 'married' else '' end as marital_status,
       case c_custkey % 4 when 0 then 'hs' when 1 then 'college' when 2 then 'graduate' end as education_level,
       concat(c_mktsegment,
              case c_custkey % 5 when 0 then ' 大手' when 1 then ' 中堅' when 2 then ' 中小' when 3 then ' 大手 経営' else '' end,
              case c_custkey % 7 when 0 then ' (現在は引退)' when 1 then ' (現在は離職)' else '' end) as occupation
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    # every order is a reply to one of nine units of its customer: the first to a unit belongs to survey s1, the next one to
    # s2, and so on.  Replies are numbered inside parts of the order keys, whose counts are added up first, so that no
    # window holds all orders of a customer
    "replies": ((), """
select r.o_custkey, r.o_orderkey, r.o_orderdate, r.o_orderpriority, r.unit, coalesce(c.earlier, 0) + row_number() over (partition by r.o_custkey, r.unit, r.part order by r.o_orderkey) as wave
from (select o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderkey % 9 as unit, floor(o_orderkey / 100000) as part from orders) r
join (select o_custkey, unit, part, sum(n) over (partition by o_custkey, unit order by part rows between unbounded preceding and 1 preceding) as earlier
      from (select o_custkey, o_orderkey % 9 as unit, floor(o_orderkey / 100000) as part, count(*) as n from orders group by o_custkey, o_orderkey % 9, floor(o_orderkey / 100000)) g) c
  on c.o_custkey = r.o_custkey and c.unit = r.unit and c.part = r.part"""),
    "responses_raw": (("replies",), """
select concat('s', cast(cast(wave as bigint) as string)) as survey_id, concat('u', lpad(cast(o_custkey as string), 8, '0')) as persona_uuid, concat('c', cast(slot as string)) as stimulus_id,
       concat(measure, '_s', cast(slot as string)) as question_id, slot as sequence,
       case o_orderkey % 13
         when 0 then concat('{"answer": ', code, '}') when 1 then 'わかりません'
         when 2 then '9' when 3 then concat('{"answers": [3, ', code, ', 3]}')
         when 4 then '３番です' when 5 then '1、3' when 6 then ''
         else priority end as answer_raw,
       cast(1 + o_orderkey % 3 as int) as attempt, ts
from (select o_custkey, o_orderkey, wave, o_orderpriority as priority, substring(o_orderpriority, 1, 1) as code, o_orderdate as ts,
             cast(floor(unit / 3) + 1 as int) as slot,
             case unit % 3 when 0 then 'q_intent' when 1 then 'q_multi' else 'q_price' end as measure
      from replies) b"""),
    # survey s1 is open to everyone, a later one to those who took part
    "takers": (("persons", "responses_raw"), """
select 's1' as survey_id, uuid as persona_uuid from persons
union all select distinct survey_id, persona_uuid from responses_raw where survey_id <> 's1'"""),
    "fielded": (("responses_raw",), """
select distinct survey_id from responses_raw union select 's1' as survey_id"""),
    "call_log": ((), """
select concat('run', cast(user_id % 5 as string)) as run_id, event_id as call_id, ts,
       event_type = 'error' as failed, cast(floor(value * 100) as int) as latency_ms,
       cast(1 + event_id % 3 as int) as attempt,
       case when event_id % 3 = 0 then null when user_id % 2 = 0 then 'timeout' else 'rate_limit' end as reason,
       cast(event_id % 3 as int) as retries, cast(event_id % 3 as double) / 2 as backoff_seconds,
       event_id % 41 = 0 as escalated, event_id % 83 = 0 as exhausted,
       cast(1000 + event_id % 700 as bigint) as input_tokens, case when event_id % 10 = 9 then null else cast(10 + event_id % 9 as bigint) end as output_tokens,
       concat('model-', cast(user_id % 3 as string)) as model_version
from events"""),
    # one survey per supplier: size, width of the age bands, oversampling
    "surveys": ((), """
select concat('s', lpad(cast(s_suppkey as string), 6, '0')) as survey_id, cast(200 + s_suppkey % 300 as int) as size,
       cast(case when s_suppkey % 2 = 0 then 5 else 10 end as int) as band, cast(2 + s_suppkey % 4 as int) as factor
from supplier"""),
    "ranges": (("surveys",), """
select survey_id, size, band, factor, sex, sex_ord, cast(20 + 10 * (size % 3) as int) as lo,
       cast(20 + 10 * (size % 3) + 10 * (2 + (size + sex_ord) % 2) - 1 as int) as hi
from surveys cross join (select '男' as sex, 1 as sex_ord union all select '女' as sex, 2 as sex_ord) x"""),
    "census": (("persons",), """
select sex, cast(floor(age / 5) * 5 as int) as age_min, cast(floor(age / 5) * 5 + 4 as int) as age_max,
       cast(1000 * count(*) + min(age) as int) as population
from persons group by sex, cast(floor(age / 5) * 5 as int), cast(floor(age / 5) * 5 + 4 as int)"""),
    # the census of each region, with more people of some ages in some regions
    "regional_census": (("census",), """
select r_name as region, sex, age_min, age_max, cast(population * (1 + (floor(age_min / 5) + r_regionkey) % 3) as int) as population
from census cross join region"""),
    # quota cells as someone typed them: some duplicate ids, some sums that are off
    "typed_cells": ((), """
select concat('t', cast(ps as string)) as survey_id, concat('cell', cast(case when p_partkey % 29 = 0 then 1 else k end as string)) as cell_id,
       k as ord, case when ps % 2 = 0 then 'count' else 'proportion' end as mode,
       case when ps % 2 = 0 then cast(case when p_partkey % 31 = 0 then 0 else 25 end as int) end as n,
       case when ps % 2 = 1 then case when p_partkey % 37 = 0 then 0.3 else 0.25 end end as proportion,
       cast(case when ps % 10 = 9 then 0 else 100 end as int) as size,
       case when k = 3 and ps % 5 = 0 then cast(null as string) when k % 2 = 0 then '男' else '女' end as sex,
       case when p_partkey % 17 = 0 then cast(null as int) else cast(20 + 10 * k as int) end as age_min,
       case when p_partkey % 19 = 0 then cast(null as int) else cast(29 + 10 * k as int) end as age_max
from (select p_partkey, cast(floor(p_partkey / 4) as int) as ps, cast(p_partkey % 4 as int) as k from part) p"""),
    # question definitions as someone typed them, twelve to a survey
    "typed_questions": ((), """
select concat('v', cast(v as string)) as survey_id,
       concat('q', cast(case when p_partkey % 53 = 0 then 0 else k end as string)) as question_id, k as ord,
       cast(case when p_partkey % 47 = 0 then 5 else 1 + floor(k / 4) end as int) as slot,
       case p_size % 5 when 0 then 'open' when 1 then 'numeric' when 2 then 'multi' when 3 then 'scale' else 'single' end as type,
       concat('m', cast(k % 4 as string)) as measure, cast(1 + p_size % 6 as int) as n_options, cast(p_size % 7 as int) as top,
       p_size % 11 = 0 as shuffled,
       case p_partkey % 4 when 0 then 'none' when 1 then 'all' else 'list' end as remember,
       concat('q', cast((k + 11 - p_partkey % 3) % 12 as string)) as ref_a,
       concat('q', cast(case when p_partkey % 43 = 0 then 40 when p_partkey % 7 = 0 then (k + 1) % 12 else (k + 10) % 12 end as string)) as ref_b
from (select p_partkey, p_size, cast(floor(p_partkey / 12) as int) as v, cast(p_partkey % 12 as int) as k from part) p"""),
    # the definitions repaired: ids by place, and list references that only point backwards in the asking order
    "clean_questions": (("typed_questions",), """
select survey_id, concat('q', cast(ord as string)) as question_id, ord, cast(1 + floor(ord / 4) as int) as slot,
       case when type = 'open' then 'open' else type end as type, measure, n_options, remember,
       case when remember = 'list' and ord >= 3 then concat('q', cast(ord - 3 as string)) end as ref_a,
       case when remember = 'list' and ord >= 6 then concat('q', cast(ord - 6 as string)) end as ref_b
from typed_questions"""),
    "panel": (("persons", "takers"), """
select survey_id, uuid as persona_uuid,
       concat(case when sex = '男' then 'M' else 'F' end, case when age < 40 then '_18_39' when age < 60 then '_40_59' else '_60_100' end) as cell_id,
       case when cast(substring(uuid, 2) as int) % 11 = 0 then 'reserve' when cast(substring(uuid, 2) as int) % 13 = 0 then 'screened_out' else 'main' end as role,
       case when cast(substring(uuid, 2) as int) % 9 = 0 then null else 0.5 + (cast(substring(uuid, 2) as int) % 4) * 0.25 end as weight
from takers join persons on uuid = persona_uuid"""),
    "cell_report": (("persons",), """
select region as survey_id, concat(prefecture, '_', cast(cast(floor(age / 20) as int) as string)) as cell_id, cast(5 as int) as needed,
       count(case when cast(substring(uuid, 2) as int) % 40 = 0 then 1 end) as achieved,
       count(case when cast(substring(uuid, 2) as int) % 45 = 1 then 1 end) as reserve,
       count(case when cast(substring(uuid, 2) as int) % 40 <> 0 and cast(substring(uuid, 2) as int) % 45 <> 1 then 1 end) as screened_out
from persons group by region, concat(prefecture, '_', cast(cast(floor(age / 20) as int) as string))"""),
    "panel_cells": (("panel",), """
select survey_id, cell_id, cast(floor(count(*) / 2) as int) as n, cast(500 as int) as size, cast(row_number() over (partition by survey_id order by cell_id) as int) as ord, case when substring(cell_id, 1, 1) = 'M' then '男' else '女' end as sex
from panel where cell_id <> 'F_60_100' group by survey_id, cell_id"""),
    # runs of surveys, from orders
    "runs": ((), """
select concat('s', cast(o_custkey as string)) as survey_id, case when o_orderkey % 5 = 0 then 'screening' else 'main' end as survey_type,
       concat('r', cast(o_orderkey as string)) as run_id, o_orderdate as finished_at,
       concat('{"survey": {"id": "s', cast(o_custkey as string), '", "size": ', cast(o_orderkey % 900 as string), '}}') as metadata_json
from orders"""),
}


def needed(*names: str, held: Collection[str] = ()) -> list[str]:
    """These views and those that they are built from, but for what only views in ``held`` need."""
    out: list[str] = []
    for n in names:
        for x in (*(() if n in held else needed(*VIEWS[n][0], held=held)), n):
            if x not in out:
                out.append(x)
    return out


def with_views(*names: str, also: dict[str, str] | None = None, recursive: bool = False, held: dict[str, str] | None = None) -> str:
    """A WITH clause of these views, what they need, and further named queries; ``held`` names tables that hold a view's rows."""
    held = held or {}
    parts = [f"{n} as ({f'select * from {held[n]}' if n in held else VIEWS[n][1]})" for n in needed(*names, held=held)] + [f"{n} as ({q})" for n, q in (also or {}).items()]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    """One view on Spark; the tables it reads become temporary views of the session.

    Views in ``written`` are read from there instead of being computed once more.
    """
    held = {n: f"panelspark_{n}_{uuid.uuid4().hex}" for n in written or {}}
    text = with_views(name, held=held) + f"select * from {name}"
    for t in TABLES:
        if re.search(rf"\b(from|join) {t}\b", text):
            base(spark, sf_dir, t).createOrReplaceTempView(t)
    for n, where in held.items():
        written[n].createOrReplaceTempView(where)
    try:
        return spark.sql(text)
    finally:
        for where in held.values():
            spark.catalog.dropTempView(where)
