"""SQL twins of ``cohortlab.plans.selection_queries``: every pair of rows, no tiles or weights."""

from __future__ import annotations

from oracle.roles import H, with_roles
from oracle.sql import HS, ORACLE, R6, ari_ctes, sweep_sql

_SETS = [
    ("half", f"select *, case when {HS('id', chr(39) + 'src' + chr(39))} < 0.5 then 'internal' else 'external' end as ds from vectors"),
    ("ks", "select * from (values (2), (3), (4)) t(k)"),
    ("reps", "select * from (values (0), (1), (2), (3)) t(rep)"),
    ("fullc", "select k, ds, label, arg_min(features, id) as center from half join ks on label < k group by k, ds, label"),
    ("subc", f"""select k, ds, rep, label, arg_min(features, {H('id', "'ctr' || cast(rep as varchar)")}) as center
        from half join ks on label < k cross join reps group by k, ds, rep, label"""),
    ("booc", f"""select k, ds, rep, label, arg_min(features, {H('id', "'boo' || cast(rep as varchar)")}) as center
        from half join ks on label < k cross join reps group by k, ds, rep, label"""),
    # labels of a set's rows by the internal set's model, and by its own
    ("lab", """select k, ds, id, features, arg_min(label, (dist, label)) as label from (
        select c.k, v.ds, v.id, v.features, c.label, list_distance(v.features, c.center) as dist
        from half v join fullc c on c.ds = 'internal') group by k, ds, id, features"""),
    ("own", """select k, ds, id, arg_min(label, (dist, label)) as native from (
        select c.k, v.ds, v.id, c.label, list_distance(v.features, c.center) as dist
        from half v join fullc c on c.ds = v.ds) group by k, ds, id"""),
    # silhouette
    ("pd", """select a.k, a.ds, a.id, a.label as la, b.label as lb, sum(list_distance(a.features, b.features)) as sd, count(*) as cnt
        from lab a join lab b on a.k = b.k and a.ds = b.ds and a.id <> b.id group by a.k, a.ds, a.id, a.label, b.label"""),
    ("sizes", "select k, ds, label, count(*) as n from lab group by k, ds, label"),
    ("ab", """select k, ds, id, la as label, max(sd / cnt) filter (where la = lb) as a, min(sd / cnt) filter (where la <> lb) as b
        from pd group by k, ds, id, la"""),
    ("sil", """select k, ds, avg(case when n <= 1 or greatest(a, b) = 0 then 0.0 else (b - a) / greatest(a, b) end) as silhouette
        from ab join sizes using (k, ds, label) group by k, ds"""),
    # dispersions
    ("dims", "select k, ds, id, label, unnest(features) as x, unnest(range(0, len(features))) as dim from lab"),
    ("cen", "select k, ds, label, dim, avg(x) as mu from dims group by k, ds, label, dim"),
    ("mid", "select k, ds, dim, avg(x) as mu from dims group by k, ds, dim"),
    ("w", """select k, ds, label, id, sum((x - mu) ** 2) as d2 from dims join cen using (k, ds, label, dim) group by k, ds, label, id"""),
    ("ch", """select k, ds, (b / (c - 1)) / (wss / (n - c)) as calinski_harabasz from
        (select k, ds, sum(n * (cen.mu - mid.mu) ** 2) as b from cen join mid using (k, ds, dim) join sizes using (k, ds, label) group by k, ds) x
        join (select k, ds, sum(d2) as wss, count(*) as n, count(distinct label) as c from w group by k, ds) y using (k, ds)"""),
    ("spread", "select k, ds, label, avg(sqrt(d2)) as s from w group by k, ds, label"),
    ("cdist", """select a.k, a.ds, a.label as i, b.label as j, sqrt(sum((a.mu - b.mu) ** 2)) as d
        from cen a join cen b on a.k = b.k and a.ds = b.ds and a.dim = b.dim and a.label <> b.label group by a.k, a.ds, a.label, b.label"""),
    ("db", """select k, ds, avg(r) as davies_bouldin from (
        select c.k, c.ds, c.i, max((x.s + y.s) / c.d) as r from cdist c
        join spread x on x.k = c.k and x.ds = c.ds and x.label = c.i join spread y on y.k = c.k and y.ds = c.ds and y.label = c.j
        group by c.k, c.ds, c.i) group by k, ds"""),
    # consensus of the subsamples
    ("subl", f"""select k, ds, rep, id, arg_min(label, (dist, label)) as label from (
        select c.k, c.ds, c.rep, v.id, c.label, list_distance(v.features, c.center) as dist
        from subc c join half v on v.ds = c.ds
        where {HS("cast(v.id as varchar) || ':' || cast(c.rep as varchar)", "'sub0'")} < 0.8) group by k, ds, rep, id"""),
    ("together", """select a.k, a.ds, a.id as i, b.id as j, count(*) as n, count(*) filter (where a.label = b.label) as same
        from subl a join subl b on a.k = b.k and a.ds = b.ds and a.rep = b.rep and a.id <> b.id group by a.k, a.ds, a.id, b.id"""),
    ("pac", """select k, ds, count(*) filter (where same / n > 0.1 and same / n < 0.9) as ambiguous, count(*) as cosampled
        from together group by k, ds"""),
    ("n", "select ds, count(*) as items from half group by ds"),
    # agreement of the resamples
    ("bool_", """select k, ds, rep, id, arg_min(label, (dist, label)) as label from (
        select c.k, c.ds, c.rep, v.id, c.label, list_distance(v.features, c.center) as dist
        from booc c join half v on v.ds = c.ds) group by k, ds, rep, id"""),
    ("bp", """select a.k, a.ds, a.rep as r1, b.rep as r2, a.label as l1, b.label as l2
        from bool_ a join bool_ b on a.k = b.k and a.ds = b.ds and a.id = b.id and a.rep < b.rep"""),
    *ari_ctes("bp", "l1", "l2", ["k", "ds", "r1", "r2"], "ba"),
    ("boot", """select k, ds, avg(ari) as bootstrap_ari_mean, stddev_pop(ari) as sd0, stddev_samp(ari) as sd1 from ba_ari group by k, ds"""),
    # transferred and native labels of the external set
    ("moved", "select k, label as l1, native as l2 from lab join own using (k, ds, id) where ds = 'external'"),
    *ari_ctes("moved", "l1", "l2", ["k"], "cs"),
    # gap
    ("cost", """select k, shift, sum(near) as inertia from (
        select c.k, s.shift, v.id, min(list_distance(list_transform(v.features, lambda e: e + s.shift), c.center) ** 2) as near
        from half v cross join (values (0), (1), (2), (3)) s(shift) join fullc c on c.ds = v.ds
        where v.ds = 'internal' group by c.k, s.shift, v.id) group by k, shift"""),
    ("gap", """select k, avg(ln(inertia)) filter (where shift > 0) - max(ln(inertia)) filter (where shift = 0) as gap,
        (stddev_samp(ln(inertia)) filter (where shift > 0)) * sqrt(1 + 1 / 3.0) as gap_se from cost group by k"""),
]

_CORE = ", ".join(f"{R6(c)} as {c}" for c in ("silhouette", "calinski_harabasz", "davies_bouldin"))
_FROM = """from sil join ch using (k, ds) join db using (k, ds) join pac using (k, ds) join n using (ds) join boot using (k, ds)"""
ORACLE["k_table_fixed"] = with_roles(["vectors"], f"""
select k, {_CORE}, {R6('gap')} as gap, {R6('gap_se')} as gap_se, {R6('ambiguous / (items * (items - 1.0))')} as consensus_pac,
  {R6('bootstrap_ari_mean')} as bootstrap_ari_mean, {R6('sd0')} as bootstrap_ari_sd, {R6('cs_ari.ari')} as cross_source_ari_external
{_FROM} join gap using (k) join cs_ari using (k) where ds = 'internal'""", _SETS)
ORACLE["validation_table_fixed"] = with_roles(["vectors"], f"""
select ds as dataset, k, {_CORE}, {R6('ambiguous / greatest(cosampled - items, 1.0)')} as consensus_pac,
  {R6('bootstrap_ari_mean')} as bootstrap_ari_mean, {R6('sd1')} as bootstrap_ari_sd,
  case when ds = 'external' then {R6('cs_ari.ari')} end as cross_source_ari
{_FROM} join cs_ari using (k) where k = 3""", _SETS)

# holds for any fit: K and nine metrics, each in its range
ORACLE["k_table_fitted"] = "select k::int as k, 10 as n_columns, true as in_range from (values (2), (3)) t(k)"

ORACLE["select_k_by_strength_t09"] = sweep_sql("""select cast(bs as integer) as best_k,
  case when bs is not null then 'prediction_strength' end as rule from (
  select max(case when prediction_strength >= 0.9 then k end) as bs from ssum)""")
