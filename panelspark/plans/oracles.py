"""The registered queries in DuckDB SQL, written apart from the operators."""

from __future__ import annotations

from panelspark.functions.answers import REFUSALS
from panelspark.operators.prompts import EMPTY_CARD, HEADINGS
from panelspark.plans import config as C
from panelspark.sources.views import with_views

ORACLES: dict[str, str] = {}


def put(name: str, select: str, *views: str, also: dict[str, str] | None = None, recursive: bool = False) -> None:
    ORACLES[name] = (with_views(*views, also=also, recursive=recursive) if views or also else "") + select


def literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return f"'{x}'" if isinstance(x, str) else str(x)


def rows(names: str, data: list[tuple]) -> str:
    return "select * from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in data) + f") as v({names})"


NUM = "cast(substring(persona_uuid, 2) as int)"

# persons
OCCUPATION = r"""
select uuid, case mark when '(現在は引退)' then '引退' when '(現在は離職)' then '離職' else '就業中' end as employment_status,
       nullif(regexp_extract(r1, '\s(経営)$', 1), '') as occupation_role, nullif(regexp_extract(r2, '\s(大手|中堅|中小)$', 1), '') as occupation_scale,
       regexp_replace(r2, '\s(大手|中堅|中小)$', '') as occupation_industry
from (select uuid, mark, r1, regexp_replace(r1, '\s(経営)$', '') as r2
      from (select uuid, regexp_extract(coalesce(occupation, ''), '\s(\(現在は引退\)|\(現在は離職\))$', 1) as mark,
                   regexp_replace(coalesce(occupation, ''), '\s(\(現在は引退\)|\(現在は離職\))$', '') as r1 from persons) a) b"""
BANDS = "case when age >= 100 then '100歳以上' else concat(age // 5 * 5, '-', age // 5 * 5 + 4) end as age_band_5, case when age >= 100 then '100歳以上' else concat(age // 10 * 10, '代') end as age_band_10"
put("occupation_split", OCCUPATION, "persons")
put("age_bands", f"select uuid, {BANDS} from persons", "persons")
_TEXTS = ("persona", "cultural_background", "professional_persona", "sports_persona", "arts_persona", "travel_persona", "culinary_persona", "skills_and_expertise", "hobbies_and_interests", "career_goals_and_ambitions")
put("normalize_persons", f"select {', '.join(f"concat('{c} ', p.uuid) as {c}" for c in _TEXTS)}, p.uuid, sex, age, prefecture, region, area, marital_status, education_level, occupation as occupation_raw, employment_status, occupation_role, occupation_scale, occupation_industry, {BANDS}, 'v1' as source_version from persons p join o on p.uuid = o.uuid", "persons", also={"o": OCCUPATION})

# quotas
GENERATED = {"cells": """
select survey_id, size, factor, sex, age_min, age_min + band - 1 as age_max, concat(case sex when '男' then 'M' else 'F' end, '_', age_min, '_', age_min + band - 1) as cell_id,
       row_number() over (partition by survey_id order by sex_ord, age_min) as ord
from (select *, unnest(range(lo, hi + 1, band)) as age_min from ranges) r"""}
put("cells_even", "select survey_id, cell_id, sex, age_min, age_max, ord, round(1.0::double / count(*) over (partition by survey_id), 6) as proportion from cells", "ranges", also=GENERATED)
put("cells_population", """
select survey_id, cell_id, population, round(case when ord = max(ord) over (partition by survey_id) then 1 - coalesce(sum(share) over (partition by survey_id order by ord rows between unbounded preceding and 1 preceding), 0) else share end, 6) as proportion
from (select *, population / sum(population) over (partition by survey_id) as share
      from (select c.survey_id, c.cell_id, c.ord, sum(n.population) as population from cells c join census n on n.sex = c.sex and c.age_min <= n.age_min and n.age_max <= c.age_max group by all) x) y""", "ranges", "census", also=GENERATED)
put("cells_population_regional", """
select survey_id, cell_id, region, population, round(case when ord = max(ord) over (partition by survey_id) then 1 - coalesce(sum(share) over (partition by survey_id order by ord rows between unbounded preceding and 1 preceding), 0) else share end, 6) as proportion
from (select *, population / sum(population) over (partition by survey_id) as share
      from (select c.survey_id, c.cell_id, c.ord, n.region, sum(n.population) as population from cells c join region r on r.r_regionkey = c.size % 5
            join regional_census n on n.region = r.r_name and n.sex = c.sex and c.age_min <= n.age_min and n.age_max <= c.age_max group by all) x) y""", "ranges", "regional_census", also=GENERATED)
APPORTIONED = {"apportioned": """
select *, cast(f + case when row_number() over (partition by survey_id order by exact - f desc, cell_id) <= size - sum(f) over (partition by survey_id) then 1 else 0 end as int) as n
from (select *, floor(exact) as f from (select *, p * size as exact from (select *, 1.0::double / count(*) over (partition by survey_id) as p from cells) a) b) c"""}
put("apportion", "select survey_id, cell_id, size, n from apportioned", "ranges", also=GENERATED | APPORTIONED)
put("cell_weights", """
select survey_id, cell_id, n * factor as candidates, got as achieved, round(case when got = 0 then 0 else p / (got / sum(got) over (partition by survey_id)) end, 6) as weight
from (select c.survey_id, c.cell_id, c.n, c.factor, c.p, count(q.uuid) as got from apportioned c left join persons q on q.sex = c.sex and q.age between c.age_min and c.age_max group by all) x""", "ranges", "persons", also=GENERATED | APPORTIONED)


def condition(c: dict) -> str:
    parts = [f"sex = '{c['sex']}'"] if c.get("sex") else []
    parts += [f"age >= {c['age_min']}"] if c.get("age_min") is not None else []
    parts += [f"age <= {c['age_max']}"] if c.get("age_max") is not None else []
    parts += [f"{k} in ({', '.join(map(literal, c[k]))})" for k in ("area", "marital_status", "education_level") if c.get(k)]
    return " and ".join(parts) or "true"


_hits = ", ".join(f"coalesce({condition(c)}, false) as h{i}" for i, c in enumerate(C.OVERLAPPING))
_sum = " + ".join(f"cast(h{i} as int)" for i in range(len(C.OVERLAPPING)))
put("cell_filter_match", " union all ".join(f"select '{c['cell_id']}' as cell_id, count(*) filter (h{i}) as candidates, count(*) filter ({_sum} > 1) as overlapping from h" for i, c in enumerate(C.OVERLAPPING)), "persons", also={"h": f"select {_hits} from persons where age >= 20"})
put("quota_audit", """
select survey_id, cell_id, 'duplicate_cell' as issue from typed_cells group by all having count(*) > 1
union all select survey_id, cell_id, 'bad_n' from typed_cells where mode = 'count' and not coalesce(n, 0) > 0
union all select survey_id, cell_id, 'bad_proportion' from typed_cells where mode = 'proportion' and not coalesce(proportion, 0) > 0
union all select survey_id, null, 'bad_size' from typed_cells group by survey_id having max(size) <= 0
union all select survey_id, null, 'n_not_size' from typed_cells where mode = 'count' group by survey_id having sum(n) <> max(size)
union all select survey_id, null, 'proportion_not_one' from typed_cells where mode = 'proportion' group by survey_id having abs(sum(proportion) - 1) > 1e-6""", "typed_cells")
put("target_summary", """
select survey_id, sex, case when count(*) = count(age_min) then min(age_min) end as age_min, case when count(*) = count(age_max) then max(age_max) end as age_max, min(ord) as ord from typed_cells group by survey_id, sex
union all select survey_id, case when count(distinct sex) = 1 then min(sex) end, min(lo), max(hi), -1 from ranges group by survey_id""", "typed_cells", "ranges")

# draw
_CELL_ROWS = rows("cell_id, ord, sex, age_min, age_max, n", [(c["cell_id"], i, c["sex"], c["age_min"], c["age_max"], c["n"]) for i, c in enumerate(C.CELLS)])

CELL_ROWS = f"select * replace (cast(greatest(n, (select count(*) from persons p where p.sex = c.sex and p.age between c.age_min and c.age_max) // {C.PERSONS_PER_QUOTA}) as int) as n) from ({_CELL_ROWS}) c"


def drawn(times: int) -> dict[str, str]:
    return {"dim": CELL_ROWS, "drawn": f"""
select uuid, cell_id, cast(rn - 1 as int) as cell_rank from (
  select uuid, cell_id, n, row_number() over (partition by cell_id order by sha256(concat(uuid, '|{C.SEED}|', cell_id)), uuid) as rn
  from persons p join dim d on p.sex = d.sex and p.age between d.age_min and d.age_max) x where rn <= n * {times}"""}


CANDIDATES = drawn(4) | {"candidates": "select 's1' as survey_id, uuid as persona_uuid, cell_id, cell_rank from drawn"}
put("panel_draw", "select * from drawn", "persons", also=drawn(1))
_chain = {}
for _i, _c in enumerate(C.OVERLAPPING):
    _not = "".join(f" and uuid not in (select uuid from d{j})" for j in range(_i))
    _chain[f"d{_i}"] = f"select uuid, '{_c['cell_id']}' as cell_id, cast(rn - 1 as int) as cell_rank from (select uuid, row_number() over (order by sha256(concat(uuid, '|{C.SEED}|{_c['cell_id']}')), uuid) as rn from persons where {condition(_c)}{_not}) x where rn <= {_c['n']}"
put("panel_draw_overlap", " union all ".join(f"select * from d{i}" for i in range(len(C.OVERLAPPING))), "persons", also=_chain)
put("panel_shortfall", """
select d.cell_id, d.n * 6 as requested, (select count(*) from drawn x where x.cell_id = d.cell_id) as achieved,
       (select count(*) from persons p where p.sex = d.sex and p.age between d.age_min and d.age_max) as candidates,
       greatest(d.n * 6 - (select count(*) from drawn x where x.cell_id = d.cell_id), 0) as shortfall from dim d""", "persons", also=drawn(6))
put("panel_report", """
select cell_id, requested, achieved, candidates, round(case when achieved = 0 then 0 else (requested / sum(requested) over ()) / (achieved / sum(achieved) over ()) end, 6) as weight
from shortfall union all select null, sum(requested), sum(achieved), null, null from shortfall""", "persons", also=drawn(6) | {"shortfall": """
select d.cell_id, d.n * 6 as requested, (select count(*) from drawn x where x.cell_id = d.cell_id) as achieved,
       (select count(*) from persons p where p.sex = d.sex and p.age between d.age_min and d.age_max) as candidates from dim d"""})
_total = "(select sum(n) from dim)"
put("panel_build", f"""
select 's1' as survey_id, uuid as persona_uuid, w.cell_id, 'main' as role, cell_rank, '{",".join(C.STIMULI)}' as assigned_stimuli,
       round((w.n / {_total}) / (count(*) over (partition by w.cell_id) / count(*) over ()), 6) as weight
from drawn x join dim w on x.cell_id = w.cell_id""", "persons", also=drawn(1))
put("person_lookup_missing", """
select uuid, sex, age, false as missing from persons where uuid in (select uuid from w)
union all select uuid, null, null, true from w where uuid not in (select uuid from persons)""", "persons", also={"w": "select distinct concat('u', lpad(cast(o_custkey * 2 as string), 8, '0')) as uuid from orders"})

# screening
VERDICTS = CANDIDATES | {"verdicts": f"select survey_id, persona_uuid, {NUM} % 3 = 0 as passed from candidates where {NUM} % 7 <> 0 and {NUM} % 19 <> 0 and ({NUM} % 5 = 0 or {NUM} % 17 <> 0)"}
put("screen_todo", "select * from candidates where persona_uuid not in (select persona_uuid from verdicts)", "persons", also=VERDICTS)
BATCHES = CANDIDATES | {"batches": "select *, cast(i // 10 as int) as batch, cast(i % 10 + 1 as int) as position from (select *, row_number() over (order by cell_id, cell_rank) - 1 as i from candidates) x"}
put("screen_batches", "select survey_id, persona_uuid, cell_id, cell_rank, batch, position from batches", "persons", also=BATCHES)
put("screen_verdicts", f"""
select survey_id, persona_uuid, cell_id, batch, position, case when batch % 5 <> 4 and {NUM} % 3 = 0 then '1' else '' end as codes,
       concat('inferred', case when batch % 5 = 4 then ',judge_error' when batch % 7 = 3 then ',out_of_range' else '' end) as flags from batches""", "persons", also=BATCHES)
put("screen_finalize", f"""
select f.survey_id, f.persona_uuid, f.cell_id, role, cast(case role when 'main' then rn - 1 end as int) as cell_rank, untested, s.short,
       case role when 'main' then '{",".join(C.STIMULI)}' else '' end as assigned_stimuli,
       case role when 'main' then round((f.n / {_total}) / (count(*) filter (role = 'main') over (partition by f.cell_id) / count(*) filter (role = 'main') over ()), 6) else 1.0 end as weight
from (select c.*, d.n, v.passed is null as untested, row_number() over w as rn,
             case when not coalesce(v.passed, false) then 'screened_out' when row_number() over w <= d.n then 'main' else 'reserve' end as role
      from candidates c left join verdicts v on v.persona_uuid = c.persona_uuid join dim d on d.cell_id = c.cell_id
      window w as (partition by c.cell_id, coalesce(v.passed, false) order by c.cell_rank)) f
join (select d.cell_id, greatest(d.n - count(v.persona_uuid), 0) as short from dim d left join candidates c on c.cell_id = d.cell_id left join verdicts v on v.persona_uuid = c.persona_uuid and v.passed group by d.cell_id, d.n) s on s.cell_id = f.cell_id""", "persons", also=VERDICTS)
put("judge_totals", """
select run_id as survey_id, count(*) as batches_total, count(*) filter (not failed) as batches_ok, count(*) filter (failed) as batches_failed,
       sum(coalesce(input_tokens, 0))::bigint as input_tokens, sum(coalesce(output_tokens, 0))::bigint as output_tokens, sum(latency_ms)::bigint as latency_ms,
       count(*) filter (escalated) as budget_escalated, count(*) filter (exhausted) as budget_exhausted
from call_log group by run_id""", "call_log")
INCIDENCE = {"inc": """
select survey_id, cell_id, count(*) filter (role = 'main') as main, count(*) filter (role = 'reserve') as reserve, count(*) filter (role = 'screened_out') as screened_out, count(*) filter (role = 'candidate') as candidate,
       case when max(count(*) filter (role in ('reserve', 'screened_out'))) over (partition by survey_id) > 0
            then round(count(*) filter (role in ('main', 'reserve')) / nullif(count(*) filter (role <> 'candidate'), 0), 6) end as incidence
from panel group by grouping sets ((survey_id, cell_id), (survey_id))"""}
put("incidence", "select *, true as finalised from inc", "panel", also=INCIDENCE)
put("screen_unreachable", """
select survey_id, cell_id, needed, round(rate, 6) as rate, cast(case when rate > 0 then ceil(needed / rate) end as bigint) as candidates_needed
from (select *, (achieved + reserve) / nullif(achieved + reserve + screened_out, 0) as rate from cell_report where achieved < needed) x where rate * 8 < 1""", "cell_report")
put("premises", f"select c.survey_id, c.persona_uuid, case when v.passed then {literal(C.PREMISE)} end as premise from candidates c left join verdicts v on v.persona_uuid = c.persona_uuid", "persons", also=VERDICTS)

# work plan
QUESTION_ROWS = {"q": rows("question_id, measure, slot, ord, type, k, top_box", [(q, b, s, i, kind, k, top) for q, b, s, i, kind, k, top, _ in C.QUESTIONS])}
PLAN = QUESTION_ROWS | {"units": "select survey_id, persona_uuid, question_id, concat('c', slot) as stimulus_id, slot as sequence, cast((slot - 1) * 3 + ord as int) as ask_pos from panel cross join q where role = 'main'"}
put("slot_expand", """
select b.survey_id, concat(b.question_id, '_s', s) as question_id, b.type, b.ord, s as slot, b.question_id as measure
from (select *, unnest(range(1, cast(max(ord) over (partition by survey_id) + 2 as int))) as s from clean_questions) b""", "clean_questions")
put("work_plan", "select * from units", "panel", also=PLAN)
_R = C.RATES
put("work_volume", f"""
select *, round((input_tokens * {_R['input_usd_per_million']} + output_tokens * {_R['output_usd_per_million']}) / 1000000.0 * {_R['jpy_per_usd']} * {_R['budget_margin']}, 4) as budget_jpy from (
select u.*, case when u.survey_id = 's1' then j.judge_calls else 0 end as judge_calls, cast(answers * {_R['input_tokens']} + case when u.survey_id = 's1' then j.judge_calls else 0 end * {_R['judge_input_tokens']} as bigint) as input_tokens, cast(answers * {_R['output_tokens']} + case when u.survey_id = 's1' then j.judge_calls else 0 end * {_R['judge_output_tokens']} as bigint) as output_tokens,
       round(answers / {_R['answers_per_minute']}::double + case when u.survey_id = 's1' then j.judge_calls else 0 end / {_R['judge_calls_per_minute']}::double, 6) as minutes
from (select survey_id, count(*) as answers, count(distinct persona_uuid) as people, count(distinct (persona_uuid, sequence)) as sessions, count(distinct stimulus_id) as concepts,
             count(distinct measure) as measures, min(per) as n_per_concept_min, max(per) as n_per_concept_max
      from (select v.*, q.measure, p.per from units v join q on q.question_id = v.question_id join (select survey_id, stimulus_id, count(distinct persona_uuid) as per from units group by all) p on p.survey_id = v.survey_id and p.stimulus_id = v.stimulus_id) y group by survey_id) u
join (select ceil(count(*) / 10) as judge_calls from candidates) j on true) z""", "panel", also=PLAN | CANDIDATES)
put("question_audit", """
select survey_id, question_id, 'duplicate_id' as issue from a group by all having count(*) > 1
union all select distinct survey_id, question_id, 'too_few_options' from a where type in ('single', 'multi', 'scale') and n_options < 2
union all select distinct survey_id, question_id, 'top_box_out_of_range' from a where type in ('single', 'multi', 'scale') and (top < 1 or top > n_options)
union all select distinct survey_id, question_id, 'shuffled_scale' from a where type = 'scale' and shuffled
union all select s.survey_id, null, 'slot_uncovered' from (select distinct survey_id from a) s where exists (select 1 from range(1, 4) r(i) where not exists (select 1 from a where a.survey_id = s.survey_id and a.slot = r.i))
union all select survey_id, measure, 'measure_mismatch' from a group by survey_id, measure having count(distinct (type, n_options, top)) > 1
union all select distinct survey_id, question_id, 'remembers_itself' from refs where ref = question_id
union all select distinct survey_id, question_id, 'remembers_unknown' from refs where ref <> question_id and pos is null
union all select distinct survey_id, question_id, 'remembers_later' from refs where ref <> question_id and pos >= ask_pos""", "typed_questions", also={
    "a": "select *, row_number() over (partition by survey_id order by slot, ord) - 1 as ask_pos from typed_questions",
    "refs": "select x.*, (select min(ask_pos) from a where a.survey_id = x.survey_id and a.question_id = x.ref) as pos from (select survey_id, question_id, ask_pos, unnest([ref_a, ref_b]) as ref from a where remember = 'list') x",
})
EDGES = {
    "o": "select *, row_number() over (partition by survey_id order by slot, ord) - 1 as ask_pos from clean_questions",
    "edges": "select a.survey_id, a.question_id, b.question_id as remembered, b.ask_pos as remembered_pos from o a join o b on a.survey_id = b.survey_id and b.ask_pos < a.ask_pos where a.remember = 'all' or (a.remember = 'list' and (b.question_id = a.ref_a or b.question_id = a.ref_b))",
}
put("memory_edges", "select * from edges", "clean_questions", also=EDGES)
put("session_groups", "select r.survey_id, r.question_id, min(o.ask_pos) as group_pos from r join o on o.survey_id = r.survey_id and o.question_id = r.other group by all", "clean_questions", also=EDGES | {
    "both_ways": "select survey_id, question_id as a, remembered as b from edges union select survey_id, remembered, question_id from edges",
    "r": "select survey_id, question_id, question_id as other from o union select r.survey_id, r.question_id, e.b from r join both_ways e on e.survey_id = r.survey_id and e.a = r.other",
}, recursive=True)
put("option_order", f"""
select uuid, case when age % 2 = 0 then (select string_agg(i, ',' order by sha256(concat('{C.SEED}|', uuid, '|q_intent_s1|', i)), i) from range(1, 6) r(i)) else '1,2,3,4,5' end as options_order from persons""", "persons")

# answers
REFUSAL = "(" + "|".join(REFUSALS) + ")"


def parsed(raw: str = "responses_raw", scan: str = "true") -> dict[str, str]:
    return QUESTION_ROWS | {
        "t0": f"select r.*, q.measure, q.type, q.k, translate(coalesce(answer_raw, ''), '０１２３４５６７８９', '0123456789') as t from {raw} r join q on q.question_id = r.question_id",
        "t1": r"select *, regexp_extract(t, '(?s)\{.*', 0) as j from t0",
        "t2": r"select *, case when j <> '' and json_valid(j) then try_cast(json_extract_string(j, '$.answer') as int) end as ja, case when j <> '' and json_valid(j) then try_cast(json_extract(j, '$.answers') as int[]) end as jm, regexp_extract_all(t, '\d+') as runs from t1",
        "parsed": rf"""
select *, list_filter([case when type in ('single', 'multi') and len(codes) = 0 then 'parse_error' end, case when len(list_filter(codes, lambda c: c < 1 or c > k)) > 0 then 'out_of_range' end,
                       case when regexp_matches(target, '{REFUSAL}') then 'refusal' end, case when attempt > 1 then 'retried' end], lambda x: x is not null) as flags
from (select *, case type when 'single' then case when ja is not null then [ja] when {scan} and len(runs) > 0 then [cast(runs[1] as int)] else [] end
                when 'multi' then case when len(jm) > 0 then list_sort(list_distinct(jm)) when {scan} then list_sort(list_distinct(list_transform(runs, lambda x: cast(x as int)))) else [] end else [] end as codes,
             case when type = 'numeric' then nullif(regexp_extract(t, '-?\d[\d,]*(\.\d+)?', 0), '') end as answer_text, coalesce(answer_raw, '') as target from t2) x""",
    }


PARSED = parsed()
put("pending_sessions", """
select survey_id, persona_uuid, stimulus_id, question_id, sequence as group_pos from (
  select u.*, bool_and(d.question_id is not null) over (partition by u.survey_id, u.persona_uuid, u.sequence) as whole
  from units u left join (select distinct survey_id, persona_uuid, stimulus_id, question_id from parsed where not list_contains(flags, 'parse_error')) d
    on d.survey_id = u.survey_id and d.persona_uuid = u.persona_uuid and d.stimulus_id = u.stimulus_id and d.question_id = u.question_id) x where not whole""", "panel", "responses_raw", also=PLAN | PARSED)
for _name, _measure, _columns in (("parse_single", "q_intent", "array_to_string(codes, ',') as codes"), ("parse_multi", "q_multi", "array_to_string(codes, ',') as codes"), ("parse_numeric", "q_price", "answer_text")):
    put(_name, f"select persona_uuid, question_id, {_columns} from parsed where measure = '{_measure}'", "responses_raw", also=PARSED)
put("parse_reasoning", f"""
select persona_uuid, question_id, case attempt % 3 when 1 then '2' when 2 then '' else cast(length(answer_raw) as string) end as codes,
       case when attempt % 3 = 1 then concat('わかりません "', replace(answer_raw, '"', chr(39)), '"') end as answer_reasoning,
       array_to_string(list_filter([case when attempt % 3 = 2 then 'parse_error' end, case when attempt % 3 = 0 and length(answer_raw) not between 1 and 5 then 'out_of_range' end,
         case when attempt % 3 = 2 then 'refusal' end, case when attempt > 1 then 'retried' end], lambda x: x is not null), ',') as flags
from responses_raw where question_id like 'q_intent%'""", "responses_raw")
put("refusal", f"select persona_uuid, question_id, regexp_matches(answer_raw, '{REFUSAL}') as refusal from responses_raw", "responses_raw")
put("row_flags", "select persona_uuid, question_id, array_to_string(flags, ',') as flags from parsed", "responses_raw", also=PARSED)
RESPONSES = PARSED | {
    "same": "select survey_id, persona_uuid from parsed where type in ('single', 'scale') and len(codes) > 0 group by all having count(*) >= 3 and min(codes[1]) = max(codes[1])",
    "responses": f"select p.* exclude (flags), case when s.persona_uuid is null then flags else list_append(flags, 'straightline') end as flags, case when cast(substring(p.persona_uuid, 2) as int) % 2 = 0 then [3, 1, 2, 5, 4] else [1, 2, 3, 4, 5] end as options_order from parsed p left join same s on s.persona_uuid = p.persona_uuid and s.survey_id = p.survey_id",
}
put("straightline", "select persona_uuid, question_id, array_to_string(flags, ',') as flags from responses", "responses_raw", also=RESPONSES)
put("upsert_responses", """
select survey_id, persona_uuid, stimulus_id, question_id, sequence, case when sequence >= 2 then concat(answer_raw, '!') else answer_raw end as answer_raw, case when sequence >= 2 then true end as revised from responses_raw""", "responses_raw")

# prompts
ATTRS = "concat_ws('・', " + ", ".join(f"nullif(cast({c} as string), '') || '{s}'" for c, s in C.ATTRIBUTES) + ")"
LABELS = ", ".join(f"'【{label}】' || nullif({c}, '')" for c, label in C.FIELDS)
put("person_cards", f"""
select uuid, concat_ws(chr(10), nullif({ATTRS}, '') || chr(10), nullif(region, '') || chr(10), {LABELS}, case when age >= 60 then chr(10) || {literal(C.PREMISE)} end) as card,
       coalesce(nullif(concat_ws(' / ', nullif({ATTRS}, ''), nullif(region, ''), {LABELS}), ''), '{EMPTY_CARD}') as judge_card from persons""", "persons")


def rule(table: dict[str, str], n: str) -> str:
    return "case type " + " ".join(f"when '{k}' then replace('{v}', '{{max_length}}', '{n}')" for k, v in table.items()) + " end"


OPTIONS = "array_to_string(list_transform(range(1, n_options + 1), lambda i: concat(i, '. opt', i)), chr(10))"
put("question_blocks", f"""
select survey_id, ord, concat_ws(chr(10), '{HEADINGS["question"]}', 'Question ' || question_id, case when type in ('single', 'multi', 'scale') then {OPTIONS} end,
       chr(10) || case when type in ('single', 'multi', 'scale') and shuffled then {rule(C.REASON_RULES, "80")} when type = 'open' then case when ord % 2 = 0 then {rule({"open": C.RULES["open"]}, "100")} end else {rule(C.RULES, "0")} end) as block
from typed_questions""", "typed_questions")
MESSAGES = PLAN | {
    "blocks": f"select question_id, measure, slot, ord, concat_ws(chr(10), '{HEADINGS['question']}', 'Question ' || question_id, case when type in ('single', 'multi') then array_to_string(list_transform(range(1, k + 1), lambda i: concat(i, '. opt', i)), chr(10)) end, chr(10) || {rule(C.RULES, '0')}) as block from q",
    "cards": f"select uuid, concat_ws(chr(10), nullif({ATTRS}, '') || chr(10), {LABELS}) as card from persons",
    "turns": f"""
select u.survey_id, u.persona_uuid, u.question_id, x.measure as system, b.ord, b.slot, b.question_id as turn, b.ord = x.ord as last, r.answer_raw as answer,
       case when b.ord = 0 then concat('{HEADINGS["profile"]}', chr(10), card, chr(10), chr(10), '{HEADINGS["stimulus"]}', chr(10), 'Concept ', b.slot, chr(10), chr(10)) else '' end || b.block as said
from units u join blocks x on x.question_id = u.question_id join blocks b on b.slot = x.slot and b.ord <= x.ord join cards on cards.uuid = u.persona_uuid
left join responses_raw r on r.survey_id = u.survey_id and r.persona_uuid = u.persona_uuid and r.question_id = b.question_id""",
}


def talk(missing: str, user: str = "said", text: str = "{}") -> str:
    return f"""
select survey_id, persona_uuid, question_id, concat('system:', {text.format("'system ' || max(system)")}, chr(10), '---', chr(10), string_agg(concat('user:', {user}) || case when last then '' else concat(chr(10), '---', chr(10), 'assistant:', {text.format(missing)}) end, concat(chr(10), '---', chr(10)) order by ord)) as messages,
       coalesce(string_agg(turn, ',' order by ord) filter (not last and answer is null), '') as missing from turns group by all"""


put("message_rows", f"select survey_id, persona_uuid, question_id, messages from ({talk('answer')}) x where missing = ''", "panel", "persons", "responses_raw", also=MESSAGES)
_parts = """case when ord = 0 and slot = 2 then concat('[{"text":', to_json(said), ',"type":"text"},{"image_url":{"url":"img/2.png"},"type":"image_url"}]')
     when ord = 0 and slot = 3 then concat('[{"text":', to_json(said), ',"type":"text"},{"image_url":{"url":"img/\\"3\\".png"},"type":"image_url"}]') else to_json(said) end"""
put("message_images", f"select survey_id, persona_uuid, question_id, messages from ({talk('answer', _parts, 'to_json({})')}) x where missing = ''", "panel", "persons", "responses_raw", also=MESSAGES)
put("prompt_sample", talk("coalesce(answer, '(no answer)')"), "panel", "persons", "responses_raw", also={k: v.replace("where role = 'main'", "where role = 'main' and (survey_id, persona_uuid) in (select survey_id, min(persona_uuid) from panel where role = 'main' group by survey_id)") for k, v in MESSAGES.items()})

# monitoring
put("flag_rates", " union all ".join(f"select survey_id, '{f}' as flag, count(*) filter (list_contains(flags, '{f}')) as n, round(count(*) filter (list_contains(flags, '{f}')) / count(*), 6) as rate, {literal(f in ('parse_error', 'refusal'))} and count(*) filter (list_contains(flags, '{f}')) / count(*) > 0.05 as warn from responses group by survey_id" for f in ("parse_error", "out_of_range", "retried", "refusal", "straightline", "output_limit")), "responses_raw", also=RESPONSES)
put("failure_breach", """
select run_id, call_id, reason from (
  select *, row_number() over (partition by run_id order by ts, call_id) as rn from (
    select *, case when streak >= 4 then 'consecutive' when seen >= 20 and fails > 8 then 'share' end as reason from (
      select run_id, call_id, ts, sum(cast(failed as int)) over w4 as streak, sum(cast(failed as int)) over w20 as fails, count(*) over w20 as seen from call_log
      window w4 as (partition by run_id order by ts, call_id rows between 3 preceding and current row), w20 as (partition by run_id order by ts, call_id rows between 19 preceding and current row)) a) b
  where reason is not null) c where rn = 1""", "call_log")
put("run_totals", """
select run_id, n + 50 as total, ok, failed, 5 as skipped, round((ok + failed + 5) / (n + 50), 6) as progress, round(n / m, 6) as per_minute, round(greatest(n + 50 - (ok + failed + 5), 0) / (n / m), 6) as minutes_left, input_tokens, output_tokens, models
from (select run_id, count(*) as n, count(*) filter (not failed) as ok, count(*) filter (failed) as failed, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 60 as m,
             cast(sum(coalesce(input_tokens, 0)) as bigint) as input_tokens, cast(sum(coalesce(output_tokens, 0)) as bigint) as output_tokens, string_agg(distinct model_version, ',' order by model_version) as models from call_log group by run_id) x""", "call_log")
put("retry_stats", """
select c.run_id, count(*) as calls, count(*) filter (retries > 0) as retried, cast(sum(retries) as bigint) as retries, round(sum(backoff_seconds), 6) as backoff_seconds, count(*) filter (escalated) as escalated, count(*) filter (exhausted) as exhausted,
       coalesce(max(h.r), '') as reasons, count(*) filter (retries > 0) / count(*) > 0.05 as warn_retries, count(*) filter (escalated) + count(*) filter (exhausted) > 0 as warn_budget
from call_log c left join (select run_id, string_agg(concat(reason, '=', n), ',' order by reason) as r from (select run_id, reason, count(*) as n from call_log where reason is not null group by all) x group by run_id) h on h.run_id = c.run_id group by c.run_id""", "call_log")
put("panel_summary", """
select i.survey_id, a.requested, i.main as achieved, i.incidence, round((i.main + i.reserve + i.screened_out) / a.size, 6) as oversample_actual, r.roles, r.people
from inc i join (select survey_id, cast(sum(n) as bigint) as requested, max(size) as size from panel_cells group by survey_id) a on a.survey_id = i.survey_id
join (select survey_id, count(*) as roles, cast(sum(p) as bigint) as people from (select survey_id, role, count(distinct persona_uuid) as p from panel group by all) x group by survey_id) r on r.survey_id = i.survey_id where i.cell_id is null""", "panel_cells", also=INCIDENCE)

# aggregation
FRAME = RESPONSES | {
    "frame": """
select r.survey_id, r.persona_uuid, r.question_id, r.measure, r.type, r.k, r.stimulus_id, r.answer_text, p.cell_id, coalesce(p.weight, 1) as weight, sex, age, area, education_level, marital_status,
       list_transform(r.codes, lambda c: case when c between 1 and 5 then r.options_order[c] else c end) as codes,
       len(list_intersect(r.flags, ['parse_error', 'out_of_range', 'refusal', 'straightline', 'output_limit'])) > 0 as flagged
from responses r join panel p on p.survey_id = r.survey_id and p.persona_uuid = r.persona_uuid and p.role = 'main' left join persons on uuid = r.persona_uuid""",
    "seg": """
select f.*, x.axis, x.segment from frame f, lateral (
  select 'total' as axis, 'total' as segment union all select 'sex', coalesce(nullif(f.sex, ''), '(不明)') union all select 'education_level', coalesce(nullif(f.education_level, ''), '(不明)')
  union all select 'sex_x_area', concat(coalesce(nullif(f.sex, ''), '(不明)'), ' × ', coalesce(nullif(f.area, ''), '(不明)'))) x""",
    "val": "select *, list_distinct(list_filter(codes, lambda c: c >= 1 and c <= k)) as ok from seg where type in ('single', 'multi')",
    "grp": "select survey_id, measure, stimulus_id, axis, segment, max(k) as k, count(*) filter (len(ok) > 0) as n, count(*) filter (len(ok) > 0 and not flagged) as n_unflagged, coalesce(sum(weight) filter (len(ok) > 0), 0) as w from val group by all",
    "xt": """
select g.survey_id, g.measure, g.stimulus_id, g.axis, g.segment, g.code, g.n, g.n_unflagged, case when g.w > 0 then coalesce(c.w, 0) / g.w else 0 end as share
from (select *, unnest(range(1, k + 1)) as code from grp) g left join (select survey_id, measure, stimulus_id, axis, segment, code, sum(weight) as w from (select *, unnest(ok) as code from val) y group by survey_id, measure, stimulus_id, axis, segment, code) c
  on c.survey_id = g.survey_id and c.measure = g.measure and c.stimulus_id = g.stimulus_id and c.axis = g.axis and c.segment = g.segment and c.code = g.code""",
}


def frame(name: str, select: str, *more: str, also: dict[str, str] | None = None) -> None:
    put(name, select, "responses_raw", "panel", "persons", *more, also=FRAME | (also or {}))


put("code_remap", "select persona_uuid, question_id, array_to_string(list_transform(codes, lambda c: case when c between 1 and 5 then options_order[c] else c end), ',') as codes from responses", "responses_raw", also=RESPONSES)
frame("answer_frame", "select survey_id, persona_uuid, question_id, measure, stimulus_id, cell_id, weight, sex, age, area, education_level, marital_status, array_to_string(codes, ',') as codes, flagged from frame")
ORACLES["answer_frame_colocated"] = ORACLES["answer_frame"]
frame("segment_rows", "select persona_uuid, question_id, axis, segment from seg")
frame("crosstab_long", "select * replace (round(share, 6) as share) from xt")
_top = "select survey_id, measure, stimulus_id, axis, segment, case when max(measure) = 'q_intent' then round(sum(share) filter (code in (1, 2)), 6) end as top_box_share from xt group by survey_id, measure, stimulus_id, axis, segment"
frame("top_box", _top)
_mean = "select survey_id, measure, stimulus_id, axis, segment, count(*) as n, round(sum(weight * (k + 1 - c)) / sum(weight), 6) as mean_score from (select *, list_filter(codes, lambda c: c >= 1 and c <= k)[1] as c from seg where measure = 'q_intent') x where c is not null group by all"
frame("mean_score", _mean)
_numeric = "select survey_id, measure, stimulus_id, axis, segment, count(*) as n, count(*) filter (not flagged) as n_unflagged, round(sum(weight * v) / sum(weight), 6) as mean from (select *, try_cast(replace(answer_text, ',', '') as double) as v from seg where type = 'numeric') x where v is not null group by all"
frame("numeric_metric", _numeric)
frame("quality_split", "select survey_id, count(*) as n, count(*) filter (flagged) as n_flagged, round(count(*) filter (flagged) / count(*), 6) as share, count(*) filter (flagged) / count(*) > 0.05 as note from frame group by survey_id")
frame("concept_complete", "select g.survey_id, g.measure, g.stimulus_id, g.code, coalesce(x.n, 0) as n, round(x.share, 6) as share from (select f.survey_id, m.measure, s.stimulus_id, unnest(range(1, 6)) as code from fielded f, (values ('q_intent'), ('q_multi')) m(measure), (values ('c1'), ('c2'), ('c3'), ('c9')) s(stimulus_id)) g left join xt x on x.axis = 'total' and x.survey_id = g.survey_id and x.measure = g.measure and x.stimulus_id = g.stimulus_id and x.code = g.code", "fielded")
_wide = "select survey_id, measure, stimulus_id, axis, segment, n, n_unflagged, " + ", ".join(f"round(max(share) filter (code = {k}), 6) as option_{k}" for k in range(1, 7)) + " from xt group by all"
_GROUP = "survey_id, measure, stimulus_id, axis, segment"
_metrics = f"""
select x.*, t.top_box_share, m.mean_score from ({_wide}) x left join ({_top}) t using ({_GROUP}) left join (select {_GROUP}, mean_score from ({_mean}) y) m using ({_GROUP})
union all select {_GROUP}, n, n_unflagged, {", ".join(["null"] * 7)}, mean from ({_numeric}) z"""
frame("crosstab_measure", "select survey_id, measure, stimulus_id, axis, segment, n, n_unflagged, " + ", ".join(f'option_{k} as "{k}. opt{k}"' for k in range(1, 6)) + f", top_box_share, mean_score from ({_metrics}) x where measure = 'q_intent'")
_percent = [*(f"option_{k}" for k in range(1, 7)), "top_box_share"]
frame("crosstab_stacked", f"select {_GROUP}, n, n_unflagged, " + ", ".join(f"coalesce(format('{{:.1f}}%', round({c} * 100, 1)), '-') as {c}" for c in _percent) + f", coalesce(format('{{:.2f}}', round(mean_score, 2)), '-') as mean_score from ({_metrics}) x")
put("crosstab_legend", """
select survey_id, measure, line, case line when 0 then concat(measure, ': Question ', question_id)
       else concat(measure, ' の選択肢: ', array_to_string(list_transform(range(1, n_options + 1), lambda k: concat(k, '. opt', k)), ' / ')) end as note
from (select *, unnest(case when type = 'numeric' then [0] else [0, 1] end) as line from typed_questions where type <> 'open'
      qualify row_number() over (partition by survey_id, measure order by ord) = 1) x""", "typed_questions")
_answered = "select distinct survey_id, measure, stimulus_id from frame where type <> 'numeric' or try_cast(replace(answer_text, ',', '') as double) is not null"
frame("crosstab_unanswered", f"""
select g.*, 0 as n, 0 as n_unflagged, cast(null as double) as option_1, cast(null as double) as mean_score,
       concat('回答が1件も無いため n=0 で出している: ', string_agg(concat('Concept ', substring(stimulus_id, 2), ' / ', measure), '・' order by measure, stimulus_id) over (partition by survey_id rows between unbounded preceding and unbounded following)) as note
from (select f.survey_id, m.measure, s.stimulus_id from fielded f, (values ('q_intent'), ('q_multi'), ('q_price')) m(measure), (values ('c1'), ('c2'), ('c3'), ('c8'), ('c9')) s(stimulus_id)) g
where (survey_id, measure, stimulus_id) not in ({_answered})""", "fielded")
frame("off_target", "select distinct survey_id, 'cell_id' as kind, cell_id as value from frame where (survey_id, cell_id) not in (select survey_id, cell_id from panel_cells) union all select distinct survey_id, 'sex', sex from frame where sex <> '' and (survey_id, sex) not in (select survey_id, sex from panel_cells)", "panel_cells")
put("panel_composition", """
select c.survey_id, c.cell_id, c.ord, c.n as target, count(*) filter (role = 'main') as main, count(*) filter (role = 'reserve') as reserve, count(*) filter (role = 'screened_out') as screened_out, count(*) filter (role = 'candidate') as candidate,
       case when c.survey_id in (select survey_id from panel where role in ('reserve', 'screened_out')) then round(count(*) filter (role in ('main', 'reserve')) / nullif(count(*) filter (role <> 'candidate'), 0), 6) end as incidence, round(coalesce(max(weight) filter (role = 'main'), 1), 4) as weight
from panel_cells c join panel p on p.survey_id = c.survey_id and p.cell_id = c.cell_id group by c.survey_id, c.cell_id, c.ord, c.n""", "panel_cells")
frame("open_ends", "select r.survey_id, stimulus_id, r.question_id, r.persona_uuid, sex, age, area, education_level, marital_status, trim(coalesce(answer_raw, '')) as answer_text from responses_raw r join (select survey_id as ps, p.persona_uuid as pu, sex, age, area, education_level, marital_status from panel p join persons on uuid = p.persona_uuid where role = 'main') f on f.ps = r.survey_id and f.pu = r.persona_uuid where r.question_id like 'q_price%'")
frame("labelled_raw", "select persona_uuid, stimulus_id, concat('Concept ', substring(stimulus_id, 2)) as name, question_id, case when type = 'numeric' then '' else array_to_string(list_transform(list_sort(codes), lambda c: concat(c, '. ', case when c between 1 and k then concat('opt', c) else '(不明)' end)), '|') end as labels from frame")

# history
put("latest_runs", "select survey_id, run_id from runs where survey_type = 'main' qualify row_number() over (partition by survey_id order by finished_at desc, run_id desc) = 1", "runs")
put("latest_definition", "select survey_id, cast(json_extract_string(metadata_json, '$.survey.size') as int) as size from runs qualify row_number() over (partition by survey_id order by finished_at desc, run_id desc) = 1", "runs")

# tables
_ROW = ", ".join(f"case when {c} is null then 'null' else concat(length(cast({c} as string)), ':', cast({c} as string)) end" for c in ("answer_raw", "attempt", "persona_uuid", "question_id", "sequence", "stimulus_id", "survey_id", "ts"))
put("table_fingerprint", f"select count(*) as n_rows, cast(sum(cast(concat('0x', substring(sha256(concat({_ROW})), 1, 15)) as bigint)) as string) as content from responses_raw", "responses_raw")
put("latency_profile", """
select run_id, count(*) as n, round(avg(attempt), 6) as avg_attempt, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95, max(latency_ms) as max_ms
from call_log group by run_id""", "call_log")
put("latency_sketches", "select run_id, count(*) as n, round(avg(attempt), 6) as avg_attempt, max(latency_ms) as max_ms, true as p50_near, true as p95_near, true as calls_near from call_log group by run_id", "call_log")
put("run_metadata", """
select run_id, case when broken then null else json_extract_string(metadata_json, '$.survey.id') end as id,
       case when broken or n % 11 = 0 then null else cast(json_extract_string(metadata_json, '$.survey.size') as int) end as size, broken
from (select *, cast(substring(run_id, 2) as bigint) as n, cast(substring(run_id, 2) as bigint) % 7 = 0 as broken from runs) x""", "runs")
