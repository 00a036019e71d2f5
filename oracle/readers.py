"""SQL twins of ``cohortlab.plans.reader_queries``: the rows before they were text."""

from __future__ import annotations

import hashlib

from oracle.roles import with_roles
from oracle.sql import ORACLE, R6, seq_sql, seq_text_sql


def _sn(medcode: str) -> str:
    return str(int(hashlib.md5(f"{medcode}:snomed".encode()).hexdigest()[:15], 16) % 1000000)


ORACLE["read_delimited"] = with_roles(["demographics"], f"""
select patid, dob, gender, {R6('bmi')} as bmi from demographics where patid % 17 not in (1, 2, 3)""")
ORACLE["read_delimited_quarantine"] = with_roles(["demographics"], """
select patid || chr(9) || case when patid % 17 = 3 then 'unknown' else strftime(dob, '%d/%m/%Y') end || chr(9) || gender
  || case when patid % 17 <> 1 then chr(9) || coalesce(bmi::varchar, '') else '' end
  || case when patid % 17 = 2 then chr(9) || 'x' else '' end as line
from demographics where patid % 17 in (1, 2, 3)""")
ORACLE["read_code_list"] = "select distinct 'C' || (p_partkey % 40) as code from part where p_partkey % 7 <> 0"
ORACLE["read_scores"] = with_roles(["scores"], f"""
select patid, trait, case when trait = 'hash_score_b' and patid::bigint % 9 = 0 then null else {R6('score')} end as score
from scores where trait <> 'hash_score_a'""")
ORACLE["read_sequences_csv"] = """
select l_orderkey as patid, l_orderkey % 13 in (1, 2) as broken,
  case when l_orderkey % 13 not in (1, 2) then count(*)::int end as n,
  case when l_orderkey % 13 not in (1, 2) then md5(string_agg('ICD10_' || l_linenumber, ',' order by l_linenumber, year(l_shipdate), l_quantity) || '|'
    || string_agg(year(l_shipdate)::varchar, ',' order by l_linenumber, year(l_shipdate), l_quantity) || '|'
    || string_agg(floor(l_quantity)::bigint::varchar, ',' order by l_linenumber, year(l_shipdate), l_quantity)) end as digest
from lineitem group by l_orderkey"""

ORACLE["union_event_sources"] = with_roles(["sequence_events"], """
select patid, code, count(*) as n, min(eventdate) as first from sequence_events group by patid, code""")
ORACLE["sequences_of_event_sources"] = seq_sql(seq_text_sql("seqpos_before"))

# The hospital codes of the three case definitions.
ICD = {
    "PD": ["G20", "G200"],
    "AD": ["F00", "F000", "F001", "F002", "F009", "G30", "G300", "G301", "G308", "G309"],
    "PARM": ["G20", "G21", "G210", "G211", "G212", "G213", "G214", "G218", "G219", "G22", "G230", "G231",
             "G232", "G238", "G239", "G259", "G26", "G903"],
}
GP = [("AD", "readcode", "R91O"), ("AD", "readcode", "R92P"), ("PARM", "Snomedcode", _sn("94O")), ("PARM", "Snomedcode", _sn("95P"))]
SYMPTOMS = [("fall", "readcode", "R91P"), ("fall", "readcode", "R93O"), ("language", "readcode", "R92O"),
            ("memory", "readcode", "R94P"), ("confusion", "readcode", "R95P"), ("sleep", "readcode", "R99X"),
            ("dementia", "Snomedcode", _sn("91O")), ("depression", "Snomedcode", _sn("93P")),
            ("constipation", "Snomedcode", _sn("94O")), ("mci", "Snomedcode", _sn("92O"))]


def _lookups(wanted, code: str) -> str:
    return " union ".join(f"""select '{name}' as name, medcode as {code} from code_dictionary where "{col}" = '{value}'"""
                          for name, col, value in wanted)


_ICD = ", ".join(f"('{name}', '{code}')" for name, codes in ICD.items() for code in codes)
ORACLE["named_case_codes"] = with_roles(["code_dictionary"], f"select name, code from (values {_ICD}) t(name, code) union {_lookups(GP, 'code')}")
ORACLE["named_symptom_codes"] = with_roles(["code_dictionary"], _lookups(SYMPTOMS, "medcode"))

ORACLE["describe_codes_by_system"] = with_roles(["sequence_events", "code_descriptions"], """
select code, case when plain = 'Other chronic obstructive pulmonary disease' then 'COPD' else plain end as description,
  case when plain = 'Other chronic obstructive pulmonary disease' then 'special' when target is not null then 'map'
       when looked_up is not null then 'system' else 'code' end as step
from (select c.code, target, looked_up, coalesce(target, looked_up, c.code) as plain
      from codes c left join known k on k.key = c.code left join answer a on a.code = c.code)""", [
    ("codes", "select distinct case when starts_with(code, 'bnf_') then substr(code, 1, 8) else code end as code from sequence_events"),
    ("known", """select key, arg_max(target, line_no) as target from (
        select case when starts_with(k, 'bnf_') then substr(k, 1, 8) else k end as key, line_no,
               case when line_no % 10 = 0 then 'Other chronic obstructive pulmonary disease' else target end as target
        from (select regexp_replace(source, '^(DIA_|MED_)', '') as k, target, line_no from code_descriptions)) group by key"""),
    ("tens", "select p_partkey, lpad((p_partkey % 100)::varchar, 2, '0') as t from part"),
    ("systems", """select 'icd' as system, 'E' || t[1] as prefix, 1 as priority from tens where p_partkey % 3 = 0
        union select 'icd', 'E' || t, 1 from tens where 'E' || t < 'E3'
        union select 'opcs', 'PROC_0' || t[1], 1 from tens where 'PROC_0' || t[1] < 'PROC_05'
        union select * from (values ('any', 'PROC_0', 2), ('any', 'E01', 2))"""),
    ("answer", """select code, system || ' ' || prefix as looked_up from (
        select code, system, prefix, row_number() over (partition by code order by priority, length(prefix) desc, system) as rn
        from codes join systems on starts_with(code, prefix)) where rn = 1"""),
])

# The known regions in their order.
REGIONS = ["North East", "North West", "Yorkshire And The Humber", "East Midlands", "West Midlands", "East of England",
           "South West", "South Central", "London", "South East Coast", "Northern Ireland", "Scotland", "Wales"]
_REGIONS = ", ".join(f"({i}, '{name}')" for i, name in enumerate(REGIONS, 1))
ORACLE["region_counts"] = with_roles(["patients"], f"""
select region, count(*) as n from patients left join (values {_REGIONS}) t(code, region) on code = pracid + 1 group by region""")

_UPPER = ORACLE["cohort_attrition"]
_UPPER = _UPPER.replace(" as s5\n", """ as s5,
  count(*) filter (where index_date is not null and index_date between DATE '1996-01-01' and DATE '1999-12-31'
                   and index_date < enddate and index_date > least_gp_register_date and index_date >= min_age_date
                   and index_date < cast(dob + interval 60 year as date)) as s6\n""")
ORACLE["cohort_attrition_upper_age"] = _UPPER.replace("(5, 'old_enough', c.s5, c.s4))", "(5, 'old_enough', c.s5, c.s4), (6, 'young_enough', c.s6, c.s5))")
