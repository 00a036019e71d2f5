"""Genetic association by cluster.

Pattern: patient rows are reduced ONCE to summary rows - (snp, label)
counts or (trait, label) n/mean/var - and every test runs on those summary
rows.  Comparisons against "the rest" are derived from per-family totals
(total - group), and pairs of labels are a self-join of summary rows
(labels x labels per trait), never of patient rows.  The only Python is the
Student-t tail and Fisher's exact test (pandas UDFs over summary rows).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.numeric import safe_div
from cohortlab.functions.stats import fisher_two_sided, student_t_two_sided

CONTROL = "Control"


def cluster_name(label_col: str = "label"):
    """F12/F16: 'Cluster <n>' for a numeric label; null label -> 'Control'."""
    return F.coalesce(F.concat(F.lit("Cluster "), F.col(label_col).cast("string")), F.lit(CONTROL))


# -- SNPs ---------------------------------------------------------------------------

def carrier_counts(dosage: DataFrame, labels: DataFrame, missing: str = "exclude") -> DataFrame:
    """J11 + A14/A15 counts per (snp, label): n and carriers (dosage <> 0).

    missing='exclude' drops null dosages from both counts; 'carrier' counts
    a missing dosage as a carrier and keeps it in n (parity with NaN != 0).
    """
    j = dosage.join(labels.select("patid", "label"), "patid", "inner")
    if missing == "exclude":
        n = F.count("dosage")
        car = F.count(F.when(F.col("dosage") != 0, 1))
    elif missing == "carrier":
        n = F.count(F.lit(1))
        car = F.count(F.when(F.col("dosage").isNull() | (F.col("dosage") != 0), 1))
    else:
        raise ValueError("missing must be 'exclude' or 'carrier'")
    return j.groupBy("snp", "label").agg(n.alias("n"), car.alias("carriers"))


def carrier_ratio(dosage: DataFrame, labels: DataFrame, freqs: DataFrame,
                  missing: str = "exclude") -> DataFrame:
    """Carrier share per (snp, label) divided by the population frequency."""
    c = carrier_counts(dosage, labels, missing)
    c = c.join(freqs.select("snp", "freq"), "snp", "inner")     # both one row per SNP: left to measured sizes
    share = safe_div(F.col("carriers").cast("double"), F.col("n").cast("double"))
    return c.select("snp", "label", F.col("n").cast("bigint"), F.col("carriers").cast("bigint"),
                    "freq", safe_div(share, F.col("freq")).alias("ratio"))


def fisher_exact(tables: DataFrame, keys: list[str], a: str = "a", b: str = "b",
                 c: str = "c", d: str = "d") -> DataFrame:
    """Two-sided Fisher exact test per 2x2 table [[a, b], [c, d]].

    p = sum of hypergeometric probabilities not above the observed one
    (relative tolerance 1e-7); odds ratio ad/bc (inf when bc = 0 < ad,
    null when both are 0).  A projection of the summary rows: no support is
    exploded and nothing is shuffled.
    """
    cell = [F.col(x).cast("long") for x in (a, b, c, d)]
    ad, bc = (cell[0] * cell[3]).cast("double"), (cell[1] * cell[2]).cast("double")
    odds = F.when(bc != 0, ad / bc).when(ad != 0, F.lit(float("inf")))
    other = [x for x in tables.columns if x not in keys]
    return tables.select(*keys, *other, odds.alias("odds_ratio"), fisher_two_sided(*cell).alias("p_value"))


def one_vs_rest_counts(counts: DataFrame, family: str, group: str, n: str, k: str) -> DataFrame:
    """Group counts next to the rest of its family (total - group).

    Totals are a window over the family's summary rows (one per group), so
    the summary is not joined back to an aggregate of itself.
    """
    w = Window.partitionBy(family)
    return counts.select(family, group, F.col(n).alias("group_n"), (F.sum(n).over(w) - F.col(n)).alias("other_n"),
                         F.col(k).alias("group_k"), (F.sum(k).over(w) - F.col(k)).alias("other_k"))


def snp_association(dosage: DataFrame, labels: DataFrame, missing: str = "exclude") -> DataFrame:
    """Fisher test of carriers, each cluster vs all other clusters, per SNP.

    One pass over the genotype rows to (snp, label) counts; everything after
    runs on those summary rows.
    """
    counts = carrier_counts(dosage, labels.where(F.col("label").isNotNull()), missing)   # P16
    ovr = one_vs_rest_counts(counts, "snp", "label", "n", "carriers")
    tab = ovr.select("snp", cluster_name("label").alias("cluster"),
                     F.col("group_n").cast("bigint"), F.col("other_n").cast("bigint"),
                     F.col("group_k").cast("bigint").alias("group_nonzero"),
                     F.col("other_k").cast("bigint").alias("other_nonzero"))
    tab = (tab.withColumn("a", F.col("group_nonzero")).withColumn("b", F.col("group_n") - F.col("group_nonzero"))
              .withColumn("c", F.col("other_nonzero")).withColumn("d", F.col("other_n") - F.col("other_nonzero")))
    fx = fisher_exact(tab, ["snp", "cluster"])
    pct = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n) * 100.0)
    return fx.select("snp", "cluster", "group_n", "other_n", "group_nonzero", "other_nonzero",
                     pct("group_nonzero", "group_n").alias("group_pct"),
                     pct("other_nonzero", "other_n").alias("other_pct"), "odds_ratio", "p_value")


# -- scores -------------------------------------------------------------------------

def labelled_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores left-joined to labels; unlabelled patients become 'Control'."""
    j = scores.join(labels.select("patid", "label"), "patid", "left")
    return j.select("patid", "trait", "score", cluster_name("label").alias("group"))


def group_summary(ls: DataFrame, group: str = "group") -> DataFrame:
    """N, mean, sample variance per (trait, group); null scores omitted."""
    return ls.groupBy("trait", group).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("var"))


def trait_filter(ls: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Traits whose cluster means (controls excluded) differ by more than ``threshold``."""
    s = group_summary(ls.where(F.col("group") != CONTROL))
    r = s.groupBy("trait").agg(F.max("mean").alias("max_mean"), F.min("mean").alias("min_mean"))
    r = r.withColumn("mean_range", F.col("max_mean") - F.col("min_mean"))
    return r.where(F.col("mean_range") > F.lit(threshold))


def welch(n1, m1, v1, n2, m2, v2):
    """M30 on summary columns: (t, df, two-sided p); null where a group has fewer than
    two rows or both groups are constant."""
    se1, se2 = safe_div(v1, n1), safe_div(v2, n2)
    t = safe_div(m1 - m2, F.sqrt(se1 + se2))
    df = safe_div((se1 + se2) * (se1 + se2), safe_div(se1 * se1, n1 - 1) + safe_div(se2 * se2, n2 - 1))
    return t, df, student_t_two_sided(t, df)


def cohen_d(m1, v1, m2, v2):
    """(m1 - m2) / sqrt((s1^2 + s2^2) / 2); pooled sd 0 -> null."""
    pooled = F.sqrt((v1 + v2) / F.lit(2.0))
    return F.when(pooled > 0, (m1 - m2) / pooled)


def bh_adjust(df: DataFrame, p_col: str = "p_val", by: list[str] | None = None,
              alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p and reject flag within each family.

    adj_(i) = min_{j >= i} p_(j) m / j, capped at 1; null p is not counted in
    m and stays null.  Windows partition by the family (one row per test).
    """
    by = by or []
    part = by if by else [F.lit(1)]
    valid = F.col(p_col).isNotNull()
    w_rank = Window.partitionBy(*part, valid).orderBy(F.col(p_col).asc())
    w_m = Window.partitionBy(*part, valid)
    x = (df.withColumn("_rank", F.row_number().over(w_rank))
           .withColumn("_m", F.count(p_col).over(w_m)))
    w_min = (Window.partitionBy(*part, valid).orderBy(F.col("_rank").desc())
             .rowsBetween(Window.unboundedPreceding, 0))
    adj = F.least(F.lit(1.0), F.min(F.col(p_col) * F.col("_m") / F.col("_rank")).over(w_min))
    x = x.withColumn("p_val_adjusted", F.when(valid, adj))
    return (x.withColumn("significant", F.col("p_val_adjusted") <= F.lit(alpha))
             .drop("_rank", "_m"))


def pairwise_tests(summary: DataFrame, group: str = "group") -> DataFrame:
    """J16 + M30/M31 for every unordered pair of groups within a trait.

    The few summary rows of a trait are gathered into one sorted array and
    the pairs (g1 < g2) are generated with higher-order functions - one pass
    over the summary, no self-join (which would recompute it).
    """
    per = summary.groupBy("trait").agg(F.sort_array(F.collect_list(
        F.struct(F.col(group).alias("g"), "n", "mean", "var"))).alias("_s"))
    pairs = F.flatten(F.transform("_s", lambda a, i: F.transform(
        F.slice("_s", i + 2, F.greatest(F.size("_s") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("p"), b.alias("q")))))
    x = per.select("trait", F.explode(pairs).alias("_pq"))
    x = x.select("trait", F.col("_pq.p.g").alias("group1"), F.col("_pq.q.g").alias("group2"),
                 F.col("_pq.p.n").alias("n1"), F.col("_pq.q.n").alias("n2"),
                 F.col("_pq.p.mean").alias("mean1"), F.col("_pq.q.mean").alias("mean2"),
                 F.col("_pq.p.var").alias("v1"), F.col("_pq.q.var").alias("v2"))
    t, df, p = welch(F.col("n1"), F.col("mean1"), F.col("v1"), F.col("n2"), F.col("mean2"), F.col("v2"))
    return x.select("trait", "group1", "group2", "n1", "n2", "mean1", "mean2",
                    t.alias("t_stat"), df.alias("dof"), p.alias("p_val"),
                    cohen_d(F.col("mean1"), F.col("v1"), F.col("mean2"), F.col("v2")).alias("cohen_d"))


def prs_pairwise(scores: DataFrame, labels: DataFrame, alpha: float = 0.05) -> DataFrame:
    """All label pairs including Control, with BH per trait."""
    s = group_summary(labelled_scores(scores, labels))
    return bh_adjust(pairwise_tests(s), "p_val", ["trait"], alpha)


def prs_one_vs_rest(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Each cluster vs all other clusters (controls excluded).

    The rest's n/mean/variance are merged from the other groups' n, mean and M2 (sums of
    squares about the mean), so large means do not cancel; a trait with one cluster has
    no rest and null statistics.
    """
    ls = labelled_scores(scores, labels).where((F.col("group") != CONTROL) & F.col("score").isNotNull())
    g = ls.groupBy("trait", "group").agg(F.count("score").alias("n"), F.avg("score").alias("mean"),
                                         F.var_samp("score").alias("var"))
    w = Window.partitionBy("trait")        # one row per cluster in each trait
    j = g.withColumn("_all", F.collect_list(F.struct("group", "n", "mean", F.coalesce("var", F.lit(0.0)).alias("var"))).over(w))
    j = j.withColumn("_rest", F.filter("_all", lambda x: x["group"] != F.col("group")))
    total = lambda term: F.aggregate("_rest", F.lit(0.0), lambda acc, x: acc + term(x))
    rn = total(lambda x: x["n"].cast("double"))
    j = j.withColumn("_rn", rn).withColumn("_rmean", safe_div(total(lambda x: x["n"] * x["mean"]), F.col("_rn")))
    rn, rmean = F.col("_rn"), F.col("_rmean")
    rvar = safe_div(total(lambda x: (x["n"] - 1) * x["var"] + x["n"] * (x["mean"] - F.col("_rmean")) * (
        x["mean"] - F.col("_rmean"))), rn - 1)
    j = j.select("trait", "group", F.col("n").alias("n_group"), rn.cast("bigint").alias("n_other"),
                 F.col("mean").alias("mean_group"), rmean.alias("mean_other"),
                 F.col("var").alias("v1"), rvar.alias("v2"))
    t, df, p = welch(F.col("n_group"), F.col("mean_group"), F.col("v1"), F.col("n_other"),
                     F.col("mean_other"), F.col("v2"))
    return j.select("trait", F.col("group").alias("cluster"), "n_group", "n_other", "mean_group", "mean_other",
                    t.alias("t_stat"), df.alias("dof"), p.alias("p_val"),
                    cohen_d(F.col("mean_group"), F.col("v1"), F.col("mean_other"), F.col("v2")).alias("cohen_d"))
