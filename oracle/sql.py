"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently from the Spark code, on the driver's pre-registered
views; shared pieces are CTE snippets.  ``R6(x)`` is the engine-neutral
half-up rounding at 1e-6 used on every double output.
"""

from __future__ import annotations

from oracle.roles import with_roles

ORACLE: dict[str, str] = {}


def R6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


CASE_CODES = "('91O','92P','G31')"

# -- cohort CTEs ----------------------------------------------------------------
COHORT_CTES = [
    ("hd", """select patid, eventdate,
        case when source = 'CPRD' then medcode when source = 'HES' then "ICD" end as code
        from diagnoses where source in ('CPRD','HES')"""),
    ("ix", f"""select patid, eventdate as index_date, min(code) as code from (
        select patid, eventdate, code, min(eventdate) over (partition by patid) as m
        from hd where code in {CASE_CODES}) t
        where eventdate = m group by patid, eventdate"""),
    ("fd", "select patid, min(eventdate) as first_diagnosis_date from hd group by patid"),
    ("cand", """select d.*, cast(d.regdate + interval 1 year as date) as least_gp_register_date,
        cast(d.dob + interval 40 year as date) as min_age_date,
        ix.index_date, ix.code, p.pracid, fd.first_diagnosis_date, dp.imd2015_5
        from demographics d left join ix using (patid) join patients p using (patid)
        left join fd using (patid) join deprivation dp using (patid)"""),
    ("cohort", """select * from cand where index_date is not null
        and index_date >= DATE '1996-01-01' and index_date <= DATE '1999-12-31'
        and index_date < enddate and index_date > least_gp_register_date
        and index_date >= min_age_date"""),
    ("mort", """select c.*, endf as endfollowupdate,
        case when dod is not null and dod <= endf then 1 else 0 end as event,
        cast(date_diff('day', index_date, case when dod is null then least(enddate, endf)
             when dod > endf then endf else dod end) as integer) as time
        from (select *, cast(index_date + interval 2 year as date) as endf from cohort) c
        where dod is null or dod > index_date"""),
    ("hes", """select a.patid, a.spno, a.admidate, replace(a."ICD", '.', '') as code
        from admissions a join stays s on a.patid = s.patid and a.spno = s.spno
        where s.duration >= 1"""),
    ("firstadm", """select h.patid, min(h.admidate) as first_admission
        from hes h join mort m on h.patid = m.patid
        where h.code in ('G31') and h.admidate > m.index_date and h.admidate <= m.endfollowupdate
        group by h.patid"""),
    ("hosp", """select m.*, f.first_admission,
        case when f.first_admission is not null then 1 else 0 end as event_hos,
        cast(date_diff('day', m.index_date, coalesce(f.first_admission, least(m.dod, m.endfollowupdate))) as integer) as time_hos
        from mort m left join firstadm f using (patid)"""),
    ("lo0", "select h.*, l.label as old_label from hosp h join cluster_labels l using (patid)"),
    ("relabel", """select old_label, avg(event) as event_rate,
        row_number() over (order by avg(event), old_label) as new_label from lo0 group by old_label"""),
    ("lo", "select lo0.*, r.new_label as label from lo0 join relabel r using (old_label)"),
]
COHORT_ROLES = ["demographics", "patients", "deprivation", "diagnoses", "admissions", "stays",
                "cluster_labels"]


def cohort_sql(body: str, upto: str, extra=None) -> str:
    names = [n for n, _ in COHORT_CTES]
    ctes = COHORT_CTES[: names.index(upto) + 1]
    return with_roles(COHORT_ROLES, body, ctes + (extra or []))


ORACLE["harmonise_events"] = cohort_sql("select patid, eventdate, code from hd", "hd")
ORACLE["index_event"] = cohort_sql("select patid, index_date, code from ix", "ix")
ORACLE["first_diagnosis"] = cohort_sql("select patid, first_diagnosis_date from fd", "fd")
ORACLE["cohort_attrition"] = cohort_sql("""
select step_no, step, n_remaining, n_before - n_remaining as n_removed from (
select * from (select
  count(*) as s0,
  count(*) filter (where index_date is not null) as s1,
  count(*) filter (where index_date is not null and index_date between DATE '1996-01-01' and DATE '1999-12-31') as s2,
  count(*) filter (where index_date is not null and index_date between DATE '1996-01-01' and DATE '1999-12-31'
                   and index_date < enddate) as s3,
  count(*) filter (where index_date is not null and index_date between DATE '1996-01-01' and DATE '1999-12-31'
                   and index_date < enddate and index_date > least_gp_register_date) as s4,
  count(*) filter (where index_date is not null and index_date between DATE '1996-01-01' and DATE '1999-12-31'
                   and index_date < enddate and index_date > least_gp_register_date and index_date >= min_age_date) as s5
  from cand) c,
  lateral (select * from (values
    (0, 'linked_with_imd', c.s0, c.s0), (1, 'has_index_date', c.s1, c.s0),
    (2, 'index_in_window', c.s2, c.s1), (3, 'before_enddate', c.s3, c.s2),
    (4, 'registered_long_enough', c.s4, c.s3), (5, 'old_enough', c.s5, c.s4))
    v(step_no, step, n_remaining, n_before)))
""", "cand")
ORACLE["build_cohort"] = cohort_sql("""select patid, pracid, index_date, code, first_diagnosis_date,
  imd2015_5, dob, enddate, dod, least_gp_register_date, min_age_date from cohort""", "cohort")
ORACLE["mortality_outcome"] = cohort_sql(
    "select patid, index_date, endfollowupdate, event, time from mort", "mort")
ORACLE["hospital_outcome"] = cohort_sql(
    "select patid, first_admission, event_hos, time_hos from hosp", "hosp")
ORACLE["relabel_by_outcome"] = cohort_sql(
    f"select old_label, new_label, {R6('event_rate')} as event_rate from relabel", "relabel")


def km_sql(time_col: str, event_col: str, source: str = "lo", upto: str = "lo") -> str:
    extra = [
        ("per_t", f"""select label, {time_col} as time, count(*) as n, sum({event_col}) as events
               from {source} group by label, {time_col}"""),
        ("curve", """select label, time, n, events,
          sum(n) over (partition by label order by time desc rows between unbounded preceding and current row) as at_risk
          from per_t"""),
        ("km", """select label, time, at_risk, events, n - events as censored,
       product(1 - events / at_risk) over (partition by label order by time rows between unbounded preceding and current row) as survival
       from curve
       union all
       select label, 0, sum(n), 0, 0, 1.0 from per_t group by label having min(time) > 0"""),
    ]
    return cohort_sql(f"""
select label, cast(time as integer) as time, cast(at_risk as bigint) as at_risk, cast(events as bigint) as events,
  cast(censored as bigint) as censored, {R6('survival')} as survival, {R6('1 - survival')} as cumulative
from km""", upto, extra)


ORACLE["km_mortality"] = km_sql("time", "event")
ORACLE["km_hospital"] = km_sql("time_hos", "event_hos")


# -- sequences and splits --------------------------------------------------------
from oracle.roles import H  # noqa: E402

AGE_M = ("((year({e}) - year({d})) * 12 + (month({e}) - month({d}))"
         " - case when day({e}) < day({d}) then 1 else 0 end)")


def seq_ctes(stage: str) -> list[tuple[str, str]]:
    s = stage
    if stage == "before":
        src, cond = "sequence_events", "e.eventdate < c.index_date"
    else:
        src = "(select patid, eventdate, code from sequence_events union all select patid, enddate, 'lost' from cohort)"
        cond = "e.eventdate >= c.index_date" if stage == "after" else "true"
    return [
        (f"ev_{s}", f"""select e.patid, e.eventdate, e.code, {AGE_M.format(e='e.eventdate', d='c.dob')} as age
            from {src} e join cohort c using (patid) where e.code is not null and {cond}"""),
        (f"first_{s}", f"""select patid, code, min(eventdate) as eventdate from ev_{s}
            group by patid, code, floor(age / 6.0)"""),
        (f"vis_{s}", f"""select f.patid, f.eventdate, {AGE_M.format(e='f.eventdate', d='c.dob')} as age,
            year(f.eventdate) as yr, list_sort(list(f.code)) as codes
            from first_{s} f join cohort c using (patid) group by f.patid, f.eventdate, c.dob"""),
        (f"tok_{s}", f"""select patid, eventdate, age, yr, unnest(list_concat(codes, ['SEP'])) as code,
            unnest(range(1, len(codes) + 2)) as vpos from vis_{s}"""),
        (f"seqpos_{s}", f"""select patid, cast(row_number() over (partition by patid order by eventdate, vpos) as integer) as pos,
            code, cast(yr as integer) as year, cast(age as integer) as age from tok_{s}"""),
    ]


def seq_text_sql(src: str, prefix: str = "", where: str = "true") -> str:
    p = prefix
    return f"""select patid, cast(count(*) as integer) as {p}n_tokens,
      string_agg(code, ' ' order by pos) as {p}code_text,
      string_agg(cast(year as varchar), ',' order by pos) as {p}year_text,
      string_agg(cast(age as varchar), ',' order by pos) as {p}age_text
      from {src} where {where} group by patid"""


SEQ_ROLES = COHORT_ROLES + ["sequence_events"]


def seq_sql(body: str, stages=("before",), extra=None) -> str:
    names = [n for n, _ in COHORT_CTES]
    ctes = COHORT_CTES[: names.index("cohort") + 1]
    for st in stages:
        ctes = ctes + seq_ctes(st)
    return with_roles(SEQ_ROLES, body, ctes + (extra or []))


ORACLE["build_sequences"] = seq_sql(seq_text_sql("seqpos_before"))
ORACLE["build_sequences_after"] = seq_sql(seq_text_sql("seqpos_after"), ("after",))
ORACLE["sequence_long"] = seq_sql("select patid, pos, code, year, age from seqpos_before")

_VIEW_EXTRA = [
    ("ep", "select * from (values (0), (1)) t(epoch)"),
    ("seps", """select patid, pos, row_number() over (partition by patid order by pos) as k,
        count(*) over (partition by patid) as nsep from seqpos_before where code = 'SEP'"""),
    ("ntok", "select patid, count(*) as n from seqpos_before group by patid"),
    ("cuts", f"""select t.patid, ep.epoch,
        coalesce((select s.pos from seps s where s.patid = t.patid and s.nsep > 1
                  and s.k = {H("cast(t.patid as varchar) || ':' || cast(ep.epoch as varchar)", "'view0'")}
                            % greatest((select max(nsep) - 1 from seps s2 where s2.patid = t.patid), 1) + 1), t.n) as cut
        from ntok t cross join ep"""),
    ("vw", """select c.patid, c.epoch, p.pos, p.code, p.year, p.age, p.pos <= c.cut as is_pre
        from cuts c join seqpos_before p using (patid)"""),
    ("pre", """select patid, epoch, cast(count(*) filter (where is_pre) as integer) as pre_n_tokens,
        string_agg(code, ' ' order by pos) filter (where is_pre) as pre_code_text,
        string_agg(cast(year as varchar), ',' order by pos) filter (where is_pre) as pre_year_text,
        string_agg(cast(age as varchar), ',' order by pos) filter (where is_pre) as pre_age_text,
        cast(count(*) filter (where not is_pre) as integer) as post_n_tokens,
        string_agg(code, ' ' order by pos) filter (where not is_pre) as post_code_text,
        string_agg(cast(year as varchar), ',' order by pos) filter (where not is_pre) as post_year_text,
        string_agg(cast(age as varchar), ',' order by pos) filter (where not is_pre) as post_age_text
        from vw group by patid, epoch"""),
]
ORACLE["contrastive_views"] = seq_sql(
    "select * from pre where post_n_tokens > 0", extra=_VIEW_EXTRA)

SIDE = f"case when {H('pracid', chr(39) + 'split' + chr(39))} / 1152921504606846976.0::DOUBLE < 0.8 then 'internal' else 'external' end"
ORACLE["practice_split"] = with_roles(["patients"], f"select distinct pracid, {SIDE} as side from patients")
ORACLE["split_by_group"] = seq_sql(
    f"""select c.patid, c.pracid, {SIDE.replace('pracid', 'c.pracid')} as side
        from cohort c where c.patid in (select patid from seqpos_before)""")
ORACLE["kfold"] = with_roles(["patients"], f"select patid, cast({H('patid', chr(39) + 'fold' + chr(39))} % 5 as integer) as fold from patients")
ORACLE["sample_n"] = with_roles(["patients"], f"select patid from patients order by {H('patid', chr(39) + 'sample' + chr(39))}, patid limit 100")
ORACLE["bootstrap_draws"] = with_roles(["vectors"], f"""
select dr.rep, dr.draw, ix.idx, ix.id from dr join ix
  on ix.idx = {H("cast(dr.rep as varchar) || ':' || cast(dr.draw as varchar)", "'boot'")} % dr.n""", [
    ("ix", "select id, row_number() over (order by id) - 1 as idx from vectors"),
    ("nn", "select count(*) as n, greatest(2, cast(floor(0.8 * count(*)) as bigint)) as m from vectors"),
    ("dr", "select g.i // nn.m as rep, g.i % nn.m as draw, nn.n from nn, generate_series(0, 3 * (select m from nn) - 1) g(i)"),
])

SPECIALS_SQL = "select * from (values ('PAD', 0), ('UNK', 1), ('SEP', 2), ('CLS', 3), ('MASK', 4)) t(token, idx)"
ORACLE["vocabulary"] = seq_sql(f"""
select token, cast(idx as bigint) as idx from ({SPECIALS_SQL})
union all
select token, 4 + row_number() over (order by token) from (
  select distinct code as token from seqpos_before where code not in ('PAD','UNK','SEP','CLS','MASK'))""")

_SPLIT_EXTRA = [
    ("seqside", f"""select p.*, {SIDE.replace('pracid', 'c.pracid')} as side
        from seqpos_before p join cohort c using (patid)"""),
    ("vocab", f"""select token, cast(idx as bigint) as idx from ({SPECIALS_SQL})
        union all
        select token, 4 + row_number() over (order by token) from (
          select distinct code as token from seqside where side = 'internal'
          and code not in ('PAD','UNK','SEP','CLS','MASK'))"""),
]
ORACLE["keep_vocabulary"] = seq_sql("""
select patid, pos, code from seqside where side = 'external' and code <> 'SEP'
  and code in (select token from vocab where idx >= 5)""", extra=_SPLIT_EXTRA)
ORACLE["vocab_encode"] = seq_sql("""
select patid, '3,' || string_agg(cast(coalesce(v.idx, 1) as varchar), ',' order by pos)
        || repeat(',0', cast(512 - 1 - count(*) as integer)) as ids_text,
  cast(count(*) + 1 as integer) as n_real
from seqside s left join vocab v on v.token = s.code
where side = 'external' and pos <= 511 group by patid""", extra=_SPLIT_EXTRA)


# -- profiles -------------------------------------------------------------------------
CONT = ["age", "sbp", "bmi"]
CATS = ["Male", "Female", "BMI underweight", "BMI healthy", "BMI overweight", "BMI obesity",
        "Smoker", "Ex-Smoker", "Non-Smoker", "ethnicity_White", "imd_1", "imd_2", "imd_3", "imd_4", "imd_5"]


def r(x: str, d: int) -> str:
    return f"floor(({x}) * {10 ** d}.0 + 0.5) / {10 ** d}.0"


_FEATS = """select label, date_diff('day', dob, index_date) / 365.2425 as age, sbp, bmi,
  case when gender = 1 then 1 else 0 end as "Male", case when gender = 2 then 1 else 0 end as "Female",
  case when bmi > 0 and bmi <= 18.5 then 1 else 0 end as "BMI underweight",
  case when bmi > 18.5 and bmi <= 25 then 1 else 0 end as "BMI healthy",
  case when bmi > 25 and bmi <= 30 then 1 else 0 end as "BMI overweight",
  case when bmi > 30 and bmi <= 100 then 1 else 0 end as "BMI obesity",
  case when smoke = 1 then 1 else 0 end as "Smoker", case when smoke = 2 then 1 else 0 end as "Ex-Smoker",
  case when smoke = 3 then 1 else 0 end as "Non-Smoker",
  case when gen_ethnicity = 'White' then 1 else 0 end as "ethnicity_White",
  case when imd2015_5 = 1 then 1 else 0 end as imd_1, case when imd2015_5 = 2 then 1 else 0 end as imd_2,
  case when imd2015_5 = 3 then 1 else 0 end as imd_3, case when imd2015_5 = 4 then 1 else 0 end as imd_4,
  case when imd2015_5 = 5 then 1 else 0 end as imd_5
  from lo"""


def _baseline_long() -> str:
    parts = []
    for v in CONT:
        m, s = f'avg("{v}")', f'stddev_samp("{v}")'
        x = f'count(*) filter (where "{v}" is null) / count(*) * 100.0'
        parts.append(f"""select label, count(*) as n, '{v}' as variable, {m} as value, {s} as sd,
          cast(null as double) as pct, {x} as missing_pct,
          printf('%.2f (%.2f) Miss(%.1f%%)', {r(m, 2)}, {r(s, 2)}, {r(x, 1)}) as text from feats group by label""")
    for v in CATS:
        c = f'sum(case when "{v}" = 1 then 1 else 0 end)'
        x = f'count(*) filter (where "{v}" is null) / count(*) * 100.0'
        p = f"{c} / count(*) * 100.0"
        parts.append(f"""select label, count(*), '{v}', cast({c} as double), cast(null as double), {p}, {x},
          printf('%d (%.1f%%) Miss(%.1f%%)', {c}, {r(p, 1)}, {r(x, 1)}) from feats group by label""")
    parts.append("""select label, count(*), 'N', cast(count(*) as double), cast(null as double), cast(null as double),
          cast(null as double), format('{:,}', count(*)) from feats group by label""")
    return "\nunion all\n".join(parts)


_BASE_EXTRA = [("feats", _FEATS), ("base", _baseline_long())]
ORACLE["baseline_table"] = cohort_sql(f"""select label, cast(n as bigint) as n, variable,
  {R6('value')} as value, {R6('sd')} as sd, {R6('pct')} as pct, {R6('missing_pct')} as missing_pct, text
  from base""", "lo", _BASE_EXTRA)
ORACLE["baseline_pivot"] = cohort_sql("select variable, " + ", ".join(
    f"max(text) filter (where label = {k}) as cluster_{k}" for k in range(1, 6)) + " from base group by variable",
    "lo", _BASE_EXTRA)
ORACLE["cluster_sizes"] = cohort_sql(f"""select label, count(*) as n,
  {R6('count(*) / sum(count(*)) over ()')} as share from lo group by label""", "lo")

GROUP_CODE = """case when length({c}) = 4 then substr({c}, 1, 3)
  when starts_with({c}, 'PROC_') then substr({c}, 1, 8) when {c} = 'SEP' then null
  when starts_with({c}, 'bnf_') then substr({c}, 1, 8) else {c} end"""

_PREV_EXTRA = [
    ("lseq", "select s.*, l.label from seqpos_before s join lo l using (patid)"),
    ("prev_counts", f"""select label, code, count(distinct patid) as n_patients from (
        select patid, label, {GROUP_CODE.format(c='code')} as code from lseq) t
        where code is not null group by label, code"""),
    ("sizes", "select label, count(*) as cluster_size from (select distinct patid, label from lseq) group by label"),
    ("prev", """select c.code, c.label, c.n_patients, s.cluster_size, c.n_patients / s.cluster_size as prevalence
        from prev_counts c join sizes s using (label)"""),
    ("ranges", """select code, max(prevalence) as max_prev,
        case when count(*) < 5 then 0.0 else min(prevalence) end as min_prev,
        max(prevalence) - case when count(*) < 5 then 0.0 else min(prevalence) end as prevalence_range
        from prev group by code"""),
    ("dmap", """select key, arg_max(target, line_no) as target from (
        select case when starts_with(k, 'bnf_') then substr(k, 1, 8) else k end as key, target, line_no
        from (select regexp_replace(source, '^(DIA_|MED_)', '') as k, target, line_no from code_descriptions))
        group by key"""),
]


def seq_prev_sql(body: str) -> str:
    names = [n for n, _ in COHORT_CTES]
    return with_roles(SEQ_ROLES + ["code_descriptions"], body,
                      COHORT_CTES[: names.index("lo") + 1] + seq_ctes("before") + _PREV_EXTRA)


ORACLE["code_prevalence"] = seq_prev_sql(
    f"select code, label, n_patients, cluster_size, {R6('prevalence')} as prevalence from prev")
ORACLE["prevalence_range"] = seq_prev_sql(
    f"select code, {R6('max_prev')} as max_prev, {R6('min_prev')} as min_prev, "
    f"{R6('prevalence_range')} as prevalence_range from ranges")

DESC = "coalesce(case when {c} = 'Other chronic obstructive pulmonary disease' then 'COPD' end, dm.target, {c})"
INITCAP = "array_to_string(list_transform(string_split(lower({d}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def matrix_sql(family_pred: str, threshold: float = 0.15) -> str:
    desc = DESC.format(c="w.code")
    desc2 = f"case when ({desc}) = 'Other chronic obstructive pulmonary disease' then 'COPD' else ({desc}) end"
    disp = f"substr(case when ({desc2}) = upper({desc2}) then ({desc2}) else {INITCAP.format(d=desc2)} end, 1, 50)"
    cols = ", ".join(f"{R6(f'coalesce(max(p.prevalence) filter (where p.label = {k}), 0.0)')} as p{k}"
                     for k in range(1, 6))
    return seq_prev_sql(f"""select w.code, {desc2} as description, {disp} as display, w.p1, w.p2, w.p3, w.p4, w.p5
      from (select k.code, {cols} from ranges k left join prev p using (code)
            where k.prevalence_range > {threshold} and ({family_pred.format(c='k.code')}) group by k.code) w
      left join dmap dm on dm.key = w.code""")


ORACLE["prevalence_matrix"] = matrix_sql("true")
ORACLE["prevalence_matrix_t05"] = matrix_sql("true", 0.05)
ORACLE["prevalence_matrix_icd"] = matrix_sql("length({c}) = 3", 0.05)
ORACLE["prevalence_matrix_med"] = matrix_sql("starts_with({c}, 'bnf_') or starts_with({c}, 'vtm_')", 0.05)
ORACLE["prevalence_matrix_val"] = matrix_sql("starts_with({c}, 'VAL_')", 0.05)
ORACLE["prevalence_matrix_proc"] = matrix_sql("starts_with({c}, 'PROC_')", 0.05)
ORACLE["describe_codes"] = seq_prev_sql(f"""select g.code, {DESC.format(c='g.code').replace("dm.target", "dm.target")} as description
  from (select distinct {GROUP_CODE.format(c='code')} as code from seqpos_before) g
  left join dmap dm on dm.key = g.code where g.code is not null""")


# -- genetics -------------------------------------------------------------------------
GEN_ROLES = ["dosage", "score_labels", "snp_frequencies", "scores"]


def gen_sql(body: str, extra=None) -> str:
    return with_roles(GEN_ROLES, body, extra)


def _carrier(missing: str) -> str:
    n = "count(d.dosage)" if missing == "exclude" else "count(*)"
    k = ("count(*) filter (where d.dosage <> 0)" if missing == "exclude"
         else "count(*) filter (where d.dosage is null or d.dosage <> 0)")
    return gen_sql(f"""select d.snp, l.label, {n} as n, {k} as carriers, f.freq,
      {R6(f'({k}) / ({n}) / f.freq')} as ratio
      from dosage d join score_labels l using (patid) join snp_frequencies f using (snp)
      group by d.snp, l.label, f.freq""")


ORACLE["carrier_ratio"] = _carrier("exclude")
ORACLE["carrier_ratio_missing_as_carrier"] = _carrier("carrier")


def LC(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


LP = "({lc1} + {lc2} - {lc3})"
_FISHER_EXTRA = [
    ("cnt", """select snp, label, count(dosage) as n, count(*) filter (where dosage <> 0) as k
        from dosage join score_labels using (patid) group by snp, label"""),
    ("ovr", """select c.snp, 'Cluster ' || cast(c.label as varchar) as cluster, c.n as group_n, t.tn - c.n as other_n,
        c.k as group_nonzero, t.tk - c.k as other_nonzero
        from cnt c join (select snp, cast(sum(n) as bigint) as tn, cast(sum(k) as bigint) as tk from cnt group by snp) t using (snp)"""),
    ("tab", """select *, group_nonzero as a, group_n - group_nonzero as b, other_nonzero as c,
        other_n - other_nonzero as d, group_n as r1, other_n as r2, group_nonzero + other_nonzero as c1,
        group_n + other_n as nn from ovr"""),
    ("sup", f"""select snp, cluster, x,
        {LC('r1', 'x')} + {LC('r2', 'c1 - x')} - {LC('nn', 'c1')} as lp,
        {LC('r1', 'a')} + {LC('r2', 'c1 - a')} - {LC('nn', 'c1')} as obs
        from (select *, unnest(generate_series(greatest(0, c1 - r2), least(r1, c1))) as x from tab)"""),
    ("fx", """select snp, cluster, least(1.0, sum(case when lp <= obs + ln(1 + 1e-7) then exp(lp) else 0 end)) as p_value
        from sup group by snp, cluster"""),
]
ORACLE["snp_association"] = gen_sql(f"""select t.snp, t.cluster, cast(group_n as bigint) as group_n,
  cast(other_n as bigint) as other_n, cast(group_nonzero as bigint) as group_nonzero,
  cast(other_nonzero as bigint) as other_nonzero,
  {R6('case when group_n > 0 then group_nonzero / group_n * 100.0 end')} as group_pct,
  {R6('case when other_n > 0 then other_nonzero / other_n * 100.0 end')} as other_pct,
  {R6("case when b * c <> 0 then (a * d) / (b * c) when a * d <> 0 then 'inf'::double end")} as odds_ratio,
  {R6('p_value')} as p_value
  from tab t join fx using (snp, cluster)""", _FISHER_EXTRA)

_LS = [
    ("ls", """select s.patid, s.trait, s.score,
        coalesce('Cluster ' || cast(l.label as varchar), 'Control') as grp
        from scores s left join score_labels l using (patid)"""),
    ("summ", "select trait, grp, count(score) as n, avg(score) as mean, var_samp(score) as var from ls group by trait, grp"),
]
ORACLE["prs_group_summary"] = gen_sql(
    f'select trait, grp as "group", n, {R6("mean")} as mean, {R6("var")} as var from summ', _LS)


def trait_filter_sql(threshold: float) -> str:
    return gen_sql(f"""select trait, {R6('max_mean')} as max_mean, {R6('min_mean')} as min_mean,
  {R6('max_mean - min_mean')} as mean_range from (
  select trait, max(mean) as max_mean, min(mean) as min_mean from summ where grp <> 'Control' group by trait)
  where max_mean - min_mean > {threshold}""", _LS)


ORACLE["prs_trait_filter"] = trait_filter_sql(0.15)
ORACLE["prs_trait_filter_t02"] = trait_filter_sql(0.02)

SIMPSON_N = 4000


def t_pvalue_ctes(src: str, keys: str) -> list[tuple[str, str]]:
    """Two-sided t p-value: 1 - I_y(1/2, dof/2) with y = t^2/(dof+t^2), by Simpson's rule on
    I_y(1/2, a) = int_0^sqrt(y) 2 (1-v^2)^(a-1) dv / B(1/2, a)."""
    return [
        (f"{src}_g", f"""select {keys}, dof / 2.0 as a, sqrt(t_stat * t_stat / (dof + t_stat * t_stat)) / {SIMPSON_N} as h,
            exp(lgamma(0.5) + lgamma(dof / 2.0) - lgamma(dof / 2.0 + 0.5)) as beta,
            unnest(generate_series(0, {SIMPSON_N})) as i from {src}"""),
        (f"{src}_p", f"""select {keys}, 1 - sum(case when i = 0 or i = {SIMPSON_N} then 1 when i % 2 = 1 then 4 else 2 end
              * 2 * pow(1 - (i * h) * (i * h), a - 1)) * min(h) / 3 / min(beta) as p_val
            from {src}_g group by {keys}"""),
    ]


_PW = _LS + [
    ("pairs", """select a.trait, a.grp as group1, b.grp as group2, a.n as n1, b.n as n2, a.mean as mean1,
        b.mean as mean2, a.var as v1, b.var as v2 from summ a join summ b on a.trait = b.trait and a.grp < b.grp"""),
    ("pw", """select *, (mean1 - mean2) / sqrt(v1 / n1 + v2 / n2) as t_stat,
        pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) as dof,
        case when sqrt((v1 + v2) / 2) > 0 then (mean1 - mean2) / sqrt((v1 + v2) / 2) end as cohen_d from pairs"""),
] + t_pvalue_ctes("pw", "trait, group1, group2") + [
    ("bh0", """select pw.*, p.p_val, row_number() over (partition by pw.trait order by p.p_val) as rk,
        count(p.p_val) over (partition by pw.trait) as m from pw join pw_p p using (trait, group1, group2)"""),
    ("bh", """select *, least(1.0, min(p_val * m / rk) over (partition by trait order by rk desc
        rows between unbounded preceding and current row)) as p_val_adjusted from bh0"""),
]
ORACLE["prs_pairwise"] = gen_sql(f"""select trait, group1, group2, n1, n2, {R6('mean1')} as mean1, {R6('mean2')} as mean2,
  {R6('t_stat')} as t_stat, {R6('dof')} as dof, {R6('p_val')} as p_val, {R6('cohen_d')} as cohen_d,
  {R6('p_val_adjusted')} as p_val_adjusted, p_val_adjusted <= 0.05 as significant from bh""", _PW)
ORACLE["prs_significant"] = gen_sql(f"""select trait, group1, group2, {R6('p_val_adjusted')} as p_val_adjusted
  from bh where p_val_adjusted <= 0.05""", _PW)

_OVR = _LS + [
    ("cl", "select distinct trait, grp from ls where grp <> 'Control'"),
    ("ov", """select cl.trait, cl.grp as cluster,
        count(ls.score) filter (where ls.grp = cl.grp) as n_group, count(ls.score) filter (where ls.grp <> cl.grp) as n_other,
        avg(ls.score) filter (where ls.grp = cl.grp) as mean_group, avg(ls.score) filter (where ls.grp <> cl.grp) as mean_other,
        var_samp(ls.score) filter (where ls.grp = cl.grp) as v1, var_samp(ls.score) filter (where ls.grp <> cl.grp) as v2
        from cl join ls on ls.trait = cl.trait and ls.grp <> 'Control' group by cl.trait, cl.grp"""),
    ("ovt", """select *, (mean_group - mean_other) / sqrt(v1 / n_group + v2 / n_other) as t_stat,
        pow(v1 / n_group + v2 / n_other, 2) / (pow(v1 / n_group, 2) / (n_group - 1) + pow(v2 / n_other, 2) / (n_other - 1)) as dof,
        case when sqrt((v1 + v2) / 2) > 0 then (mean_group - mean_other) / sqrt((v1 + v2) / 2) end as cohen_d from ov"""),
] + t_pvalue_ctes("ovt", "trait, cluster")
ORACLE["prs_one_vs_rest"] = gen_sql(f"""select trait, cluster, n_group, cast(n_other as bigint) as n_other,
  {R6('mean_group')} as mean_group, {R6('mean_other')} as mean_other, {R6('t_stat')} as t_stat, {R6('dof')} as dof,
  {R6('p.p_val')} as p_val, {R6('cohen_d')} as cohen_d from ovt join ovt_p p using (trait, cluster)""", _OVR)


# -- cluster metrics ----------------------------------------------------------------------
VEC_ROLES = ["vectors", "class_centers"]
HS = lambda key, salt_sql: H(key, salt_sql) + " / 1152921504606846976.0::DOUBLE"

_PART = [
    ("nv", """select v.id, v.label, v.features, c.idx, list_distance(v.features, c.center) as dist
        from vectors v, class_centers c"""),
    ("part", """select id, label, features, idx as nearest from (
        select *, row_number() over (partition by id order by dist, idx) as rn from nv) where rn = 1"""),
]


def vec_sql(body: str, extra=None) -> str:
    return with_roles(VEC_ROLES, body, _PART + (extra or []))


def ari_ctes(src: str, a: str, b: str, keys: list[str], p: str) -> list[tuple[str, str]]:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = (" using (" + k + ")") if keys else " on true"
    return [
        (f"{p}_ct", f"select {kc}{a} as a, {b} as b, count(*) as n from {src} group by {kc}{a}, {b}"),
        (f"{p}_s", f"""select * from (select {kc}sum(n * (n - 1) / 2.0) as s_ab, sum(n) as nn from {p}_ct {'group by ' + k if keys else ''}) c
            join (select {kc}sum(x * (x - 1) / 2.0) as s_a from (select {kc}sum(n) as x from {p}_ct group by {kc}a) {'group by ' + k if keys else ''}) ra{on}
            join (select {kc}sum(x * (x - 1) / 2.0) as s_b from (select {kc}sum(n) as x from {p}_ct group by {kc}b) {'group by ' + k if keys else ''}) rb{on}"""),
        (f"{p}_ari", f"""select {kc}case when (s_a + s_b) / 2.0 = s_a * s_b / (nn * (nn - 1) / 2.0) then 1.0
            else (s_ab - s_a * s_b / (nn * (nn - 1) / 2.0)) / ((s_a + s_b) / 2.0 - s_a * s_b / (nn * (nn - 1) / 2.0)) end as ari,
            case when s_ab + (s_a - s_ab) + (s_b - s_ab) = 0 then 1.0
            else s_ab / (s_ab + (s_a - s_ab) + (s_b - s_ab)) end as jaccard from {p}_s"""),
    ]


ORACLE["nearest_center"] = vec_sql("select id, label, nearest from part")
ORACLE["crosstab"] = vec_sql("select label, nearest, count(*) as n_ab from part group by label, nearest")
ORACLE["adjusted_rand"] = vec_sql(f"select {R6('ari')} as ari from x_ari", ari_ctes("part", "label", "nearest", [], "x"))
ORACLE["jaccard_partition"] = vec_sql(f"select {R6('jaccard')} as jaccard from x_ari",
                                      ari_ctes("part", "label", "nearest", [], "x"))
ORACLE["best_mapping_accuracy"] = with_roles(VEC_ROLES, f"""
select {R6('max(val) / (select sum(n) from mx)')} as accuracy from dp
where i = (select count(distinct ai) from mx)""", _PART + [
    ("ct", "select label as a, nearest as b, count(*) as n from part group by label, nearest"),
    ("mx", """select dense_rank() over (order by a) - 1 as ai, dense_rank() over (order by b) - 1 as bj, n from ct"""),
    ("dp(i, mask, val) USING KEY (i, mask)", """
  select 0::bigint, 0::bigint, 0::double
  union
  select d.i + 1, d.mask | (1::bigint << m.bj), max(d.val + m.n)::double
  from dp d join mx m on m.ai = d.i where (d.mask & (1::bigint << m.bj)) = 0
  group by d.i + 1, d.mask | (1::bigint << m.bj)"""),
], recursive=True)

# each label's commonest partner; an optimal matching if no partner is taken twice, else no row
ORACLE["best_mapping_many_labels"] = f"""
with o as (select o_orderkey, {H('o_custkey', "'map'")} % 60 as a from orders),
x as (select a, case when {H('o_orderkey', "'stay'")} % 5 > 0 then (a * 7 + 3) % 60
             else {H('o_orderkey', "'away'")} % 60 end as b from o),
ct as (select a, b, count(*) as n_ab from x group by a, b),
best as (select a, arg_max(b, n_ab) as b, max(n_ab) as n_ab from ct group by a)
select a::int as a, b::int as b, n_ab from best where (select count(distinct b) = count(*) from best)"""

_PS = [("cells", "select label, nearest, count(*) as c from part group by label, nearest"),
       ("psc", """select label as cluster, cast(sum(c) as bigint) as size,
           case when sum(c) <= 1 then 'inf'::double else sum(c * (c - 1) / 2.0) / (sum(c) * (sum(c) - 1) / 2.0) end as strength
           from cells group by label""")]
ORACLE["prediction_strength_by_cluster"] = vec_sql(f"select cluster, size, {R6('strength')} as strength from psc", _PS)
ORACLE["prediction_strength"] = vec_sql(f"select {R6('min(strength)')} as prediction_strength from psc", _PS)

_SIL = [
    ("pdist", """select a.id, a.label as la, b.label as lb, list_distance(a.features, b.features) as d
        from vectors a join vectors b on a.id <> b.id"""),
    ("per", "select id, la, lb, sum(d) as sd, count(*) as cnt from pdist group by id, la, lb"),
    ("own", "select label, count(*) as n_own from vectors group by label"),
    ("sil", """select v.id, v.label, case when o.n_own <= 1 or greatest(ai, bmin) = 0 then 0.0 else
          (bmin - ai) / greatest(ai, bmin) end as s
        from vectors v join own o using (label)
        left join (select id, sd / cnt as ai from per where la = lb) a using (id)
        left join (select id, min(sd / cnt) as bmin from per where la <> lb group by id) b using (id)"""),
]
ORACLE["silhouette"] = vec_sql(f"select {R6('avg(s)')} as silhouette from sil", _SIL)
ORACLE["silhouette_points"] = vec_sql(f"select id, label, {R6('s')} as s from sil", _SIL)

_SIL2 = [(n, q.replace("list_distance(a.features, b.features) as d", "list_distance(a.features, b.features) ** 2 as d"))
         for n, q in _SIL]
ORACLE["silhouette_squared"] = vec_sql(f"select {R6('avg(s)')} as silhouette_squared from sil", _SIL2)

_DISP = [
    ("dims", "select id, label, unnest(features) as x, unnest(range(0, len(features))) as dim from vectors"),
    ("cen", "select label, dim, avg(x) as mu from dims group by label, dim"),
    ("allm", "select dim, avg(x) as mu from dims group by dim"),
    ("cnt", "select label, count(*) as n from vectors group by label"),
    ("bw", """select (select sum(c.n * pow(ce.mu - a.mu, 2)) from cen ce join allm a using (dim) join cnt c using (label)) as b,
        (select sum(pow(d.x - ce.mu, 2)) from dims d join cen ce using (label, dim)) as w,
        (select count(*) from cnt) as k, (select count(*) from vectors) as n"""),
    ("spread", """select label, avg(dist) as s from (
        select d.id, d.label, sqrt(sum(pow(d.x - ce.mu, 2))) as dist from dims d join cen ce using (label, dim)
        group by d.id, d.label) group by label"""),
    ("cdist", """select a.label as i, b.label as j, sqrt(sum(pow(a.mu - b.mu, 2))) as dij
        from cen a join cen b on a.dim = b.dim and a.label <> b.label group by a.label, b.label"""),
]
ORACLE["calinski_harabasz"] = vec_sql(
    f"select {R6('case when k <= 1 then null when w = 0 then 1.0 else (b / (k - 1)) / (w / (n - k)) end')} as calinski_harabasz from bw", _DISP)
ORACLE["within_dispersion"] = vec_sql(f"select {R6('w')} as inertia from bw", _DISP)
ORACLE["davies_bouldin"] = vec_sql(f"""select {R6("case when (select max(s) from spread) = 0 or (select max(dij) from cdist) = 0 then 0.0 else avg(rmax) end")} as davies_bouldin from (
  select c.i, max(case when c.dij > 0 then (si.s + sj.s) / c.dij else 0.0 end) as rmax
  from cdist c join spread si on si.label = c.i join spread sj on sj.label = c.j group by c.i)""", _DISP)
ORACLE["inertia_to_centers"] = vec_sql(f"""select {R6('sum(d2)')} as inertia from (
  select id, min(pow(dist, 2)) as d2 from nv group by id)""")
ORACLE["gap_from_inertia"] = vec_sql(f"""select o.k, {R6('m - ln(o.w)')} as gap, {R6('sd * sqrt(1 + 1.0 / n)')} as s_k,
  {R6('ln(o.w)')} as log_w, {R6('m')} as ref_log_mean
  from costs o join (select k, avg(ln(w)) as m, stddev_samp(ln(w)) as sd, count(*) as n from costs where b >= 0 group by k) r
    using (k) where o.b = -1""", [("costs", """select b, cast(k as integer) as k, sum(d2) as w from (
      select b, k, v.id, min(pow(list_distance(list_transform(v.features, lambda e: e + b + 1), c.center), 2)) as d2
      from vectors v, (values (-1), (0), (1), (2)) bb(b), (values (2), (3), (4)) kk(k), class_centers c
      where c.idx < k group by b, k, v.id) group by b, k""")])
ORACLE["validation_report"] = " union all ".join(
    f"select '{section}' as section, '{column}' as metric, {column} as value from ({ORACLE[name]})" for section, name, column in (
        ("internal", "calinski_harabasz", "calinski_harabasz"), ("internal", "davies_bouldin", "davies_bouldin"),
        ("agreement", "adjusted_rand", "ari")))
ORACLE["minmax_scale"] = vec_sql(f"""select d.id, cast(d.dim as integer) as dim,
  {R6('case when m.hi > m.lo then (d.x - m.lo) / (m.hi - m.lo) else 0.0 end')} as value
  from dims d join (select dim, min(x) as lo, max(x) as hi from dims group by dim) m using (dim)""", _DISP)


def rep_label_ctes(reps: int, full: bool, p: str) -> list[tuple[str, str]]:
    rr = ", ".join(f"({r})" for r in range(reps))
    target = "vectors v" if full else "sub v"
    tcond = "" if full else "and v.rep = c.rep"
    return [
        (f"{p}_reps", f"select * from (values {rr}) t(rep)"),
        (f"{p}_sub", f"""select r.rep, v.* from {p}_reps r join vectors v
            on {HS('v.id', "'pac' || cast(r.rep as varchar)")} < 0.8"""),
        (f"{p}_ctr", f"""select rep, label as idx, arg_min(features, {H('id', "'ctr' || cast(rep as varchar)")}) as center
            from {p}_sub group by rep, label"""),
        (f"{p}_dist", f"""select c.rep, v.id, c.idx, list_distance(v.features, c.center) as dist
            from {target.replace('sub', p + '_sub')} join {p}_ctr c on true {tcond}"""),
        (f"{p}_rl", f"""select rep, id, idx as label from (
            select *, row_number() over (partition by rep, id order by dist, idx) as rn from {p}_dist) where rn = 1"""),
    ]


_PAC = rep_label_ctes(5, False, "pc") + [
    ("pairs", """select a.id as i, b.id as j, count(*) as both_n, count(*) filter (where a.label = b.label) as same_n
        from pc_rl a join pc_rl b on a.rep = b.rep and a.id < b.id group by a.id, b.id"""),
    ("pacs", """select 2 * count(*) filter (where same_n / both_n > 0.1 and same_n / both_n < 0.9) as ambiguous,
        2 * count(*) as cosampled, (select count(*) from vectors) as n from pairs"""),
]
ORACLE["consensus_pac"] = vec_sql(f"""select {R6('ambiguous / (n * (n - 1.0))')} as pac, ambiguous, cosampled,
  cast(n as integer) as n from pacs""", _PAC)
ORACLE["consensus_pac_cosampled"] = vec_sql(f"""select {R6('ambiguous / greatest(cosampled - n, 1.0)')} as pac,
  ambiguous, cosampled, cast(n as integer) as n from pacs""", _PAC)

_RPA = rep_label_ctes(4, True, "rf") + [
    ("rpairs", """select a.rep as rep1, b.rep as rep2, a.label as l1, b.label as l2
        from rf_rl a join rf_rl b on a.id = b.id and a.rep < b.rep"""),
] + ari_ctes("rpairs", "l1", "l2", ["rep1", "rep2"], "rp")
ORACLE["replicate_pair_ari"] = vec_sql(f"select rep1, rep2, {R6('ari')} as ari from rp_ari", _RPA)
ORACLE["bootstrap_ari"] = vec_sql(
    f"select {R6('avg(ari)')} as mean_ari, {R6('stddev_pop(ari)')} as sd_ari from rp_ari", _RPA)
ORACLE["bootstrap_ari_ddof1"] = vec_sql(
    f"select {R6('avg(ari)')} as mean_ari, {R6('stddev_samp(ari)')} as sd_ari from rp_ari", _RPA)

_BJ = [
    ("ix", "select id, row_number() over (order by id) - 1 as idx from vectors"),
    ("nn", "select count(*) as n, greatest(2, cast(floor(0.8 * count(*)) as bigint)) as m from vectors"),
    ("dr", "select g.i // nn.m as rep, g.i % nn.m as draw, nn.n from nn, generate_series(0, 3 * (select m from nn) - 1) g(i)"),
    ("drawn", f"""select dr.rep, dr.draw, v.id, v.label, v.features from dr
        join ix on ix.idx = {H("cast(dr.rep as varchar) || ':' || cast(dr.draw as varchar)", "'boot'")} % dr.n
        join vectors v on v.id = ix.id"""),
    ("bctr", f"""select rep, label as idx, arg_min(features, {H('id', "'ctr' || cast(rep as varchar)")}) as center
        from drawn group by rep, label"""),
    ("bl", """select rep, draw, id, idx as label from (
        select d.rep, d.draw, d.id, c.idx, row_number() over (partition by d.rep, d.draw order by list_distance(d.features, c.center), c.idx) as rn
        from drawn d join bctr c on c.rep = d.rep) where rn = 1"""),
    ("bj", "select b.rep, p.nearest as full_label, b.label from bl b join part p using (id)"),
] + ari_ctes("bj", "full_label", "label", ["rep"], "bjx")
ORACLE["bootstrap_jaccard"] = vec_sql(
    f"select {R6('avg(jaccard)')} as mean_jaccard, {R6('stddev_pop(jaccard)')} as sd_jaccard from bjx_ari", _BJ)

_CS = [
    ("src", f"select *, {HS('id', chr(39) + 'src' + chr(39))} < 0.5 as is_a from vectors"),
    ("ca", "select label as idx, features as center from src s where is_a and id = (select min(id) from src t where t.is_a and t.label = s.label)"),
    ("cb", "select label as idx, features as center from src s where not is_a and id = (select min(id) from src t where not t.is_a and t.label = s.label)"),
    ("tr", """select s.id, (select c.idx from ca c order by list_distance(s.features, c.center), c.idx limit 1) as transfer,
        (select c.idx from cb c order by list_distance(s.features, c.center), c.idx limit 1) as native
        from src s where not is_a"""),
] + ari_ctes("tr", "transfer", "native", [], "cs")
ORACLE["cross_source_ari"] = vec_sql(f"select {R6('ari')} as ari from cs_ari", _CS)

_PRL = [
    ("pa", "select id // 2 as i, features as a from vectors where id % 2 = 0"),
    ("pb", "select (id - 1) // 2 as i, features as b from vectors where id % 2 = 1"),
    ("pp", "select i // 16 as batch, i % 16 as pos, a, b from pa join pb using (i)"),
    ("sc", """select x.batch, x.pos as i, y.pos as j, 20.0 * list_dot_product(x.a, y.b) as s
        from pp x join pp y on x.batch = y.batch"""),
    ("rowce", """select batch, i, max(s) + ln(sum(exp(s - (select max(s) from sc z where z.batch = sc.batch and z.i = sc.i))))
        - max(s) + max(s) as lse, max(case when i = j then s end) as diag from sc group by batch, i"""),
]
ORACLE["pair_ranking_loss"] = vec_sql(f"""select {R6('(r + c) / 2.0')} as loss from
  (select avg(lse - diag) as r from (
     select batch, i, m + ln(sum(exp(s - m))) as lse, max(case when i = j then s end) as diag
     from (select *, max(s) over (partition by batch, i) as m from sc) group by batch, i, m)),
  (select avg(lse - diag) as c from (
     select batch, j, m + ln(sum(exp(s - m))) as lse, max(case when i = j then s end) as diag
     from (select *, max(s) over (partition by batch, j) as m from sc) group by batch, j, m))""", _PRL[:4])


# -- features and model selection ------------------------------------------------------------
_TFIDF = _SPLIT_EXTRA + [
    ("tdoc", f"""select patid as doc, code, side, {H('patid', chr(39) + 'fold' + chr(39))} % 5 as fold
        from seqside where code <> 'SEP'"""),
    ("tf", """select t.doc, v.idx, count(*) as tf, min(t.side) as side, min(t.fold) as fold
        from tdoc t join vocab v on v.token = t.code where v.idx >= 5 group by t.doc, v.idx"""),
    ("idf", f"""select v.idx, ln((1 + (select count(distinct patid) from seqside where side = 'internal' and {H('patid', chr(39) + 'fold' + chr(39))} % 5 <> 0))
        / (1 + coalesce(d.df, 0))) + 1 as idf
        from vocab v left join (select idx, count(*) as df from tf where side = 'internal' and fold <> 0 group by idx) d
        using (idx) where v.idx >= 5"""),
    ("tw", "select tf.*, tf.tf * i.idf as w from tf join idf i using (idx)"),
    ("tfidf", "select doc, idx, side, fold, w / sqrt(sum(w * w) over (partition by doc)) as value from tw"),
]
ORACLE["tfidf"] = seq_sql(f"select doc, idx, {R6('value')} as value from tfidf where side = 'internal' and fold = 0",
                          extra=_TFIDF)
ORACLE["tfidf_external"] = seq_sql(f"select doc, idx, {R6('value')} as value from tfidf where side = 'external'",
                                   extra=_TFIDF)
ORACLE["idf"] = seq_sql(f"select idx, {R6('idf')} as idf from idf", extra=_TFIDF)

_SWEEP = [
    ("vf", f"select *, {H('id', chr(39) + 'fold' + chr(39))} % 3 as fold from vectors"),
    ("fk", "select * from (values (0), (1), (2)) f(fold), (values (2), (3), (4)) kk(k)"),
    ("tl", """select fold, k, id, features, idx as test_label from (
        select fk.fold, fk.k, v.id, v.features, c.idx,
          row_number() over (partition by fk.fold, fk.k, v.id order by list_distance(v.features, c.center), c.idx) as rn
        from fk join vf v on v.fold = fk.fold join class_centers c on c.idx < fk.k) where rn = 1"""),
    ("trm", """select fk.fold, fk.k, v.label as idx, min(v.id) as mid
        from fk join vf v on v.fold <> fk.fold and v.label < fk.k group by fk.fold, fk.k, v.label"""),
    ("trc", """select t.fold, t.k, t.idx, v.features as center, row_number() over (partition by t.fold, t.k order by t.idx) - 1 as pos
        from trm t join vf v on v.id = t.mid"""),
    ("nr", """select fold, k, id, test_label, pos as near from (
        select t.fold, t.k, t.id, t.test_label, c.pos,
          row_number() over (partition by t.fold, t.k, t.id order by list_distance(t.features, c.center), c.pos) as rn
        from tl t join trc c using (fold, k)) where rn = 1"""),
    ("cellz", "select fold, k, test_label, near, count(*) as c from nr group by fold, k, test_label, near"),
    ("psk", """select fold, k, min(case when sz <= 1 then 'inf'::double else m / (sz * (sz - 1) / 2.0) end) as prediction_strength
        from (select fold, k, test_label, sum(c * (c - 1) / 2.0) as m, sum(c) as sz from cellz group by fold, k, test_label)
        group by fold, k"""),
    ("pd2", """select a.fold, a.k, a.id, a.test_label as la, b.test_label as lb, list_distance(a.features, b.features) as d
        from tl a join tl b on a.fold = b.fold and a.k = b.k and a.id <> b.id"""),
    ("per2", "select fold, k, id, la, lb, sum(d) / count(*) as md from pd2 group by fold, k, id, la, lb"),
    ("own2", "select fold, k, test_label, count(*) as n_own from tl group by fold, k, test_label"),
    ("silk", """select t.fold, t.k, avg(case when o.n_own <= 1 or greatest(a.ai, b.bmin) = 0 then 0.0 else (b.bmin - a.ai) / greatest(a.ai, b.bmin) end) as silhouette
        from tl t join own2 o on o.fold = t.fold and o.k = t.k and o.test_label = t.test_label
        left join (select fold, k, id, md as ai from per2 where la = lb) a on a.fold = t.fold and a.k = t.k and a.id = t.id
        left join (select fold, k, id, min(md) as bmin from per2 where la <> lb group by fold, k, id) b
          on b.fold = t.fold and b.k = t.k and b.id = t.id
        group by t.fold, t.k"""),
    ("sweep", """select cast(p.fold + 1 as integer) as fold, cast(p.k as integer) as k, p.prediction_strength, s.silhouette
        from psk p join silk s using (fold, k)"""),
    ("ssum", "select k, avg(prediction_strength) as prediction_strength, avg(silhouette) as silhouette from sweep group by k"),
]


def sweep_sql(body: str, extra=None) -> str:
    return vec_sql(body, _SWEEP + (extra or []))


def select_k_sql(threshold: float) -> str:
    return sweep_sql(f"""select cast(coalesce(bs, bf) as integer) as best_k,
      case when bs is not null then 'prediction_strength' else 'silhouette' end as rule from (
      select max(case when prediction_strength >= {threshold} then k end) as bs,
        (select k from ssum order by silhouette desc, k limit 1) as bf from ssum)""")


ORACLE["fixed_center_sweep"] = sweep_sql(
    f"select fold, k, {R6('prediction_strength')} as prediction_strength, {R6('silhouette')} as silhouette from sweep")
ORACLE["sweep_summary"] = sweep_sql(
    f"select cast(k as integer) as k, {R6('prediction_strength')} as prediction_strength, {R6('silhouette')} as silhouette from ssum")
ORACLE["select_k"] = select_k_sql(0.9)
ORACLE["select_k_strict"] = select_k_sql(0.95)
ORACLE["select_k_by_strength"] = sweep_sql("""select cast(bs as integer) as best_k,
  case when bs is not null then 'prediction_strength' end as rule from (
  select max(case when prediction_strength >= 0.5 then k end) as bs from ssum)""")
ORACLE["best_fold"] = sweep_sql(f"""select k, fold, {R6('prediction_strength')} as prediction_strength from (
  select s.*, row_number() over (order by prediction_strength desc, fold) as rn from sweep s
  where k = (select coalesce(max(case when prediction_strength >= 0.9 then k end),
                             (select k from ssum order by silhouette desc, k limit 1)) from ssum)) where rn = 1""")
ORACLE["argmax_k_per_fold"] = sweep_sql(f"""select fold, cast(arg_min(k, [-prediction_strength, k]) as integer) as best_k,
  {R6('max(prediction_strength)')} as max_prediction_strength from sweep group by fold""")

ORACLE["mean_pool"] = with_roles(SEQ_ROLES + ["vectors"], f"""
select t.patid, cast(u.dim as integer) as dim, {R6('avg(u.x)')} as value
from seqpos_before t
join (select token, {H('token', chr(39) + 'tok' + chr(39))} % (select count(*) from vectors) as vid
      from (select distinct code as token from seqpos_before)) tv on tv.token = t.code
join (select id, unnest(features) as x, unnest(range(0, len(features))) as dim from vectors) u on u.id = tv.vid
group by t.patid, u.dim""", COHORT_CTES[: [n for n, _ in COHORT_CTES].index("cohort") + 1] + seq_ctes("before"))


# -- code lists and sides ------------------------------------------------------------------------
import hashlib  # noqa: E402


def _sn(medcode: str) -> str:
    return str(int(hashlib.md5(f"{medcode}:snomed".encode()).hexdigest()[:15], 16) % 1000000)


CODE_LIST = f"""select * from (values ('read', 'case', 'R91O'), ('snomed', 'case', '{_sn("92P")}'),
  ('read', 'fall', 'R91P'), ('read', 'fall', 'R93O'), ('snomed', 'memory', '{_sn("94P")}'),
  ('snomed', 'memory', '{_sn("95O")}'), ('read', 'sleep', 'R99X')) t(system, name, code)"""
_CASE = [
    ("cl", CODE_LIST),
    ("casec", """select distinct code from (
        select d.medcode as code from code_dictionary d join cl on cl.name = 'case'
          and ((cl.system = 'read' and cl.code = d.readcode) or (cl.system = 'snomed' and cl.code = d."Snomedcode"))
        union all select 'G31')"""),
]
ORACLE["case_codes"] = with_roles(["code_dictionary"], "select code from casec", _CASE)
ORACLE["symptom_codes"] = with_roles(["code_dictionary"], """select distinct cl.name, d.medcode
  from code_dictionary d join cl on cl.name <> 'case'
   and ((cl.system = 'read' and cl.code = d.readcode) or (cl.system = 'snomed' and cl.code = d."Snomedcode"))""", _CASE)
ORACLE["index_event_from_definitions"] = with_roles(["code_dictionary", "diagnoses"], """
select patid, eventdate as index_date, min(code) as code from (
  select patid, eventdate, code, min(eventdate) over (partition by patid) as m
  from hd where code in (select code from casec)) t where eventdate = m group by patid, eventdate""",
    _CASE + COHORT_CTES[:1])
ORACLE["relabel_external"] = cohort_sql(f"""select patid, side, cast(r.new_label as integer) as label, event from (
  select h.*, l.label as old_label, {SIDE.replace('pracid', 'h.pracid')} as side
  from hosp h join cluster_labels l using (patid)) x
  left join (select old_label, row_number() over (order by avg(event), old_label) as new_label from (
      select h.event, l.label as old_label, {SIDE.replace('pracid', 'h.pracid')} as side
      from hosp h join cluster_labels l using (patid)) where side = 'internal' group by old_label) r using (old_label)""",
    "hosp")


ORACLE["index_code_counts"] = cohort_sql(
    f"select code, count(*) as n, {R6('count(*) / sum(count(*)) over ()')} as share from cohort group by code", "cohort")
_NORM = "trim(regexp_replace(replace(coalesce(text, ''), ',', ' '), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
ORACLE["text_normalise"] = f"""select doc_id, cast(case when {_NORM} = '' then 0 else len(string_split({_NORM}, ' ')) end as integer) as n_tokens,
  md5({_NORM}) as digest from documents"""

ORACLE["parse_dosage"] = gen_sql("select patid, snp, dosage from dosage")
ORACLE["parse_dates"] = """
select l_orderkey, count(*) filter (where l_orderkey % 5 <> 0) as n_dates,
       min(case when l_orderkey % 5 <> 0 then cast(l_shipdate as date) end) as first_date,
       max(case when l_orderkey % 5 <> 0 then cast(l_shipdate as date) end) as last_date
from lineitem group by l_orderkey"""
ORACLE["shifted_labels"] = with_roles(["cluster_labels", "patients"], """
select patid, cast(label + 1 as integer) as cluster, pracid from cluster_labels join patients using (patid)""")

# any exact truncated SVD with eight components gives these rows
ORACLE["svd_invariants"] = """
select 'dot' as part, i::int as i, j::int as j, case when i = j then 1.0 else 0.0 end::double as value
from range(8) a(i), range(8) b(j) where i <= j
union all
select 'residual', i::int, i::int, 1.0::double from range(8) a(i)"""


from oracle import readers, selection  # noqa: E402, F401
