"""SQL twins of ``cohortlab.sources.roles`` as CTE snippets for the oracle.

Each entry is ``name AS (select ...)``; ``with_roles`` prefixes a query with
the CTEs it needs (dependencies resolved in order).  Written for DuckDB on
the pre-registered driver views.
"""

from __future__ import annotations


def H(key: str, salt_sql: str) -> str:
    """Portable md5 hash, identical to ``cohortlab.functions.hashing``."""
    return f"(('0x'||substr(md5(cast({key} as varchar)||':'||{salt_sql}),1,15))::BIGINT)"


ROLES: dict[str, tuple[list[str], str]] = {}


def role(name: str, deps: list[str], sql: str) -> None:
    ROLES[name] = (deps, sql)


role("patients", [], """
select c_custkey as patid, cast(c_nationkey as bigint) as pracid from customer""")

role("demographics", [], """
select c_custkey as patid,
  DATE '1930-01-01' + cast((c_custkey*37) % 12000 as integer) as dob,
  cast(1 + c_custkey % 2 as integer) as gender,
  DATE '1994-01-01' + cast((c_custkey*11) % 1000 as integer) as regdate,
  DATE '1998-06-01' + cast((c_custkey*13) % 1200 as integer) as enddate,
  case when c_custkey % 3 = 0 then DATE '1996-01-01' + cast((c_custkey*17) % 2500 as integer) end as dod,
  cast(1 + c_custkey % 4 as integer) as smoke,
  case when c_custkey % 13 <> 0 then 15.0 + cast((c_custkey*7) % 300 as double) / 10.0 end as bmi,
  cast(100 + c_custkey % 80 as double) as sbp,
  cast(1 + c_nationkey % 13 as integer) as region,
  case when c_custkey % 5 = 0 then 'Other' when c_custkey % 5 = 1 then 'Asian' else 'White' end as gen_ethnicity
from customer""")

role("deprivation", [], """
select c_custkey as patid, cast(1 + c_custkey % 5 as integer) as imd2015_5
from customer where c_custkey % 11 <> 0""")

role("cluster_labels", [], """
select c_custkey as patid, cast(dense_rank() over (order by c_mktsegment) as integer) as label
from customer""")

role("diagnoses", [], """
select o_custkey as patid, cast(o_orderdate as date) as eventdate,
  case when o_orderstatus = 'F' then 'HES' else 'CPRD' end as source,
  case when o_orderstatus <> 'F' then '9' || substr(o_orderpriority,1,1) || o_orderstatus end as medcode,
  case when o_orderstatus = 'F' then 'G3' || substr(o_orderpriority,1,1) end as "ICD"
from orders""")

role("admissions", [], """
select o_custkey as patid, l_orderkey as spno, cast(l_shipdate as date) as admidate,
  'G3.' || cast(l_linenumber as varchar) as "ICD"
from lineitem join orders on l_orderkey = o_orderkey""")

role("stays", [], """
select o_custkey as patid, l_orderkey as spno, cast(floor(max(l_quantity)) as integer) - 1 as duration
from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_orderkey""")

role("sequence_events", [], """
select o_custkey as patid, cast(l_shipdate as date) as eventdate,
  case p_type
    when 'ECONOMY' then 'bnf_' || lpad(cast(p_partkey as varchar), 6, '0')
    when 'LARGE' then 'PROC_' || lpad(cast(p_partkey % 1000 as varchar), 4, '0')
    when 'MEDIUM' then 'VAL_' || cast(p_partkey % 300 as varchar)
    when 'PROMO' then 'vtm_' || cast(p_partkey % 200 as varchar)
    when 'SMALL' then 'I' || lpad(cast(p_partkey % 100 as varchar), 2, '0')
    else 'E' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') end as code
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""")

role("vectors", [], """
select vec_id as id, cast(embedding as double[]) as features, cast(label as integer) as label
from embeddings""")

role("class_centers", ["vectors"], """
select v.label as idx, v.features as center from vectors v
where v.id = (select min(id) from vectors w where w.label = v.label)""")

role("snp_frequencies", [], """
select * from (values ('rs429358_C', 0.06817::double), ('rs7412_T', 0.082919::double),
  ('rs143332484_T', 0.010499::double), ('rs3764650_G', 0.093706::double),
  ('rs3752246_G', 0.17085::double)) t(snp, freq)""")

_DOSE_H = H("c_custkey", "'snp' || cast(j as varchar)")
role("dosage", [], f"""
select cast(c_custkey as varchar) as patid, s.snp as snp,
  case when {_DOSE_H} % 20 = 19 then null
       when {_DOSE_H} % 20 = 0 then 2.0
       when {_DOSE_H} % 20 <= 5 then 1.0 else 0.0 end::double as dosage
from customer cross join (values (1, 'rs429358_C'), (2, 'rs7412_T'), (3, 'rs143332484_T'),
  (4, 'rs3764650_G'), (5, 'rs3752246_G')) s(j, snp)""")

role("scores", [], f"""
select cast(c_custkey as varchar) as patid, 'acctbal_score' as trait, c_acctbal / 10000.0 as score from customer
union all
select cast(c_custkey as varchar), 'hash_score_a', cast({H('c_custkey', "'prs2'")} % 2001 - 1000 as double) / 1000.0 from customer
union all
select cast(c_custkey as varchar), 'hash_score_b',
  cast({H('c_custkey', "'prs3'")} % 2001 - 1000 as double) / 400.0 + case when c_custkey % 5 = 0 then 0.5 else 0.0 end
from customer""")

role("score_labels", ["cluster_labels"], """
select cast(patid as varchar) as patid, label from cluster_labels where patid % 7 <> 0""")

role("code_dictionary", ["diagnoses"], f"""
select medcode, 'R' || medcode as readcode,
  cast({H('medcode', "'snomed'")} % 1000000 as varchar) as "Snomedcode", 'term ' || medcode as term
from (select distinct medcode from diagnoses where medcode is not null)""")

role("code_descriptions", [], """
select case when p_type = 'SMALL' then 'DIA_I' || lpad(cast(p_partkey % 100 as varchar), 2, '0')
            else 'MED_bnf_' || lpad(cast(p_partkey as varchar), 6, '0') end as source,
  p_name as target, p_partkey as line_no
from part where p_type in ('SMALL', 'ECONOMY')""")


def with_roles(names: list[str], body: str, extra: list[tuple[str, str]] | None = None,
               recursive: bool = False) -> str:
    """Build ``WITH <roles...>, <extra...> <body>``; roles resolved transitively."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in ROLES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({ROLES[n][1].strip()})" for n in order]
    for n, sql in extra or []:
        parts.append(f"{n} AS ({sql.strip()})")
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
