"""Registered queries of model selection: K table and validation report, over fixed centers and fitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.hashing import portable_hash, unit_hash
from cohortlab.functions.vectors import squared_distance
from cohortlab.operators import model_selection as MS
from cohortlab.plans.queries import register, rounded
from cohortlab.sources import roles as R

KS, REPS = [2, 3, 4], 4
METRICS = ["silhouette", "calinski_harabasz", "davies_bouldin", "consensus_pac", "bootstrap_ari_mean", "bootstrap_ari_sd"]


def two_sets(spark, d):
    """The vectors in two halves by the hash of their id."""
    v = R.vectors(spark, d)
    first = unit_hash(F.col("id"), "src") < F.lit(0.5)
    return {"internal": v.where(first), "external": v.where(~first)}


def fixed_models(datasets):
    """Models table without a fit.  The center of class c of a model is the set's vector of that
    class with the least id (full) or the least hash for the repetition (replicates); K classes
    make a model.  Gap costs are the sums of squares to the full model's centers, of the set as it
    is and shifted by 1, 2 and 3 in every dimension."""
    out = None
    sizes = F.explode(F.array(*[F.lit(k) for k in KS])).alias("k")
    for name, v in datasets.items():
        reps = F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))
        each = v.withColumn("rep", reps)
        rank = lambda salt: portable_hash(F.col("id"), F.concat(F.lit(salt), F.col("rep").cast("string")))
        parts = {MS.FULL: v.withColumn("rep", F.lit(0)).groupBy("rep", "label").agg(F.min_by("features", "id").alias("center")),
                 MS.SUBSAMPLE: each.groupBy("rep", "label").agg(F.min_by("features", rank("ctr")).alias("center")),
                 MS.BOOTSTRAP: each.groupBy("rep", "label").agg(F.min_by("features", rank("boo")).alias("center"))}
        for purpose, centers in parts.items():
            rows = centers.select("rep", "label", "center", sizes).where("label < k").groupBy("k", "rep").agg(
                F.sort_array(F.collect_list(F.struct("label", "center"))).alias("c"))
            rows = rows.select(F.lit(name).alias("dataset"), F.lit(purpose).alias("purpose"), "k", F.col("rep").cast("int"),
                               F.col("c.center").alias("centers"), F.lit(0.0).alias("cost"))
            out = rows if out is None else out.unionByName(rows)
    models = out.checkpoint(eager=True)
    costs = None
    for name, v in datasets.items():
        full = models.where((F.col("purpose") == MS.FULL) & (F.col("dataset") == name)).select("k", "centers")
        shift = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift")
        x = v.select("features", shift).join(F.broadcast(full))            # one row per K
        moved = F.transform("features", lambda e: e + F.col("shift"))
        near = F.array_min(F.transform("centers", lambda c: squared_distance(moved, c)))
        rows = x.groupBy("k", "shift").agg(F.sum(near).alias("cost")).select(
            F.lit(name).alias("dataset"), F.when(F.col("shift") == 0, MS.GAP_OBSERVED).otherwise(MS.GAP_REFERENCE).alias("purpose"),
            "k", F.greatest(F.col("shift") - 1, F.lit(0)).alias("rep"), F.array().cast("array<array<double>>").alias("centers"), "cost")
        costs = rows if costs is None else costs.unionByName(rows)
    return models.unionByName(costs).checkpoint(eager=True)


@register("k_table_fixed")
def q_k_table_fixed(spark, d):
    """One row per K with all ten columns, over fixed centers."""
    sets = two_sets(spark, d)
    out = MS.selection_table(sets, fixed_models(sets), "internal")
    return rounded(out, *METRICS, "gap", "gap_se", "cross_source_ari_external")


@register("validation_table_fixed")
def q_validation_table_fixed(spark, d):
    """One row per set at K = 3, over fixed centers."""
    sets = two_sets(spark, d)
    return rounded(MS.validation_table(sets, fixed_models(sets), 3, "internal"), *METRICS, "cross_source_ari")


@register("k_table_fitted")
def q_k_table_fitted(spark, d):
    """The K table with a Spark ML fit for every model, and what holds for any fit: how many of
    the ten metrics each K has, and whether each lies in its range."""
    sets = two_sets(spark, d)
    models = MS.fit_models(sets, [2, 3], consensus_reps=2, bootstrap_reps=3, gap_sets=2, restarts=1, max_iter=5,
                           targets=("external",))
    table = MS.selection_table(sets, models, "internal")
    names = [*METRICS, "gap", "gap_se", "cross_source_ari_external"]
    within = [F.col("silhouette").between(-1, 1), F.col("calinski_harabasz") > 0, F.col("davies_bouldin") > 0,
              F.col("consensus_pac").between(0, 1), F.col("bootstrap_ari_mean").between(-1, 1), F.col("bootstrap_ari_sd") >= 0,
              F.col("gap_se") >= 0, F.col("cross_source_ari_external").between(-1, 1)]
    found = sum(F.col(c).isNotNull().cast("int") for c in names)
    return table.select("k", (found + 1).alias("n_columns"), F.forall(F.array(*within), lambda x: x).alias("in_range"))
