"""K-Means, the k sweep and model selection.

* Every fit is Spark ML ``KMeans`` (distributed Lloyd, k-means||) over all
  rows of its set, replicates of the gap statistic, the consensus and the
  bootstraps included; no set is clustered inside one task.  A resample is a
  weight per row and replicate (``weightCol``), never a copy of the vectors.
* Restarts are separate seeds and the lowest training cost wins.  Fits that
  do not depend on each other (restarts, values of k, replicates) are
  submitted ``PARALLEL_FITS`` at a time over vectors persisted once per set.
* Model selection (select_k, best_fold, gap formula) are aggregates and
  windows over the metric rows (a few rows per (fold, k)).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.hashing import unit_hash
from cohortlab.functions.vectors import squared_distance
from cohortlab.operators import metrics as M
from cohortlab.operators.splits import resample_counts

PARALLEL_FITS = 4             # independent fits submitted at a time


@dataclass
class FittedKMeans:
    k: int
    centers: list[list[float]]
    cost: float
    seed: int


def _concurrently(calls: list[Callable]) -> list:
    """Results of independent calls in their order, a few Spark jobs at a time."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(lambda call: call()), calls))


def _fit(x: DataFrame, k: int, max_iter: int, seed: int, weight: str | None = None) -> FittedKMeans:
    """One fit on a vector column ``vec``; rows of weight 0 take no part."""
    if weight is not None:
        x = x.where(F.col(weight) > 0)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if k == 1:        # Spark ML takes two centers at least; the best single one is the mean
        center = x.agg(Summarizer.metrics("mean").summary(F.col("vec"), w).alias("s")).first().s.mean
        apart = squared_distance(vector_to_array("vec"), F.lit([float(v) for v in center]))
        return FittedKMeans(1, [list(map(float, center))], float(x.agg(F.sum(w * apart)).first()[0]), seed)
    estimator = KMeans(k=k, featuresCol="vec", maxIter=max_iter, seed=seed, initMode="k-means||")
    model = (estimator if weight is None else estimator.setWeightCol(weight)).fit(x)
    return FittedKMeans(k, [list(map(float, c)) for c in model.clusterCenters()], float(model.summary.trainingCost), seed)


def _least_cost(fits: list[FittedKMeans]) -> FittedKMeans:
    return min(fits, key=lambda m: (m.cost, m.seed))


def kmeans_fits(df: DataFrame, ks: list[int], features: str = "features", restarts: int = 3,
                max_iter: int = 50, seed: int = 0) -> dict[int, FittedKMeans]:
    """M12 for several k: per k the best of ``restarts`` fits by training cost."""
    # Lloyd iterations re-read the input: one persisted copy serves every fit
    x = df.select(array_to_vector(F.col(features)).alias("vec")).persist()
    try:
        fits = _concurrently([partial(_fit, x, k, max_iter, seed + r) for k in ks for r in range(restarts)])
    finally:
        x.unpersist()
    return {k: _least_cost([m for m in fits if m.k == k]) for k in ks}


def kmeans_fits_weighted(df: DataFrame, k: int, replicates: int, weights: str = "weights", features: str = "features",
                         restarts: int = 3, max_iter: int = 50, seed: int = 0) -> list[FittedKMeans]:
    """M12 once per replicate: replicate r counts a row ``weights[r]`` times (0: left out).

    All replicates read one persisted set of vectors; a resample is a weight, not a copy.
    Replicate r starts from seeds ``seed + r`` on.
    """
    x = df.select(array_to_vector(F.col(features)).alias("vec"), weights).persist()
    sets = [x.select("vec", F.get(weights, F.lit(r)).cast("double").alias("w")) for r in range(replicates)]
    try:
        fits = _concurrently([partial(_fit, part, k, max_iter, seed + r + s, "w")
                              for r, part in enumerate(sets) for s in range(restarts)])
    finally:
        x.unpersist()
    return [_least_cost(fits[r * restarts:(r + 1) * restarts]) for r in range(replicates)]


def kmeans_fit(df: DataFrame, k: int, features: str = "features", restarts: int = 3,
               max_iter: int = 50, seed: int = 0) -> FittedKMeans:
    """Best of ``restarts`` Spark ML K-Means fits by training cost."""
    return kmeans_fits(df, [k], features, restarts, max_iter, seed)[k]


def kmeans_predict(df: DataFrame, model: FittedKMeans, features: str = "features",
                   out: str = "label") -> DataFrame:
    """Label rows by the nearest fitted center (projection over a broadcast row)."""
    return M.assign_nearest(df, model.centers, features, out)


# -- gap statistic --------------------------------------------------------------------

def uniform_reference(scaled: DataFrame, B: int, id_col: str = "id", features: str = "features",
                      salt: str = "gapref", first: int = 0) -> DataFrame:
    """Reference sets ``first`` to ``first + B - 1``, uniform in the per-dimension [min, max] box.

    Deterministic portable-hash uniforms; one output row per (b, input row).
    """
    box = (scaled.select(array_to_vector(F.col(features)).alias("v"))
           .agg(Summarizer.metrics("min", "max").summary(F.col("v")).alias("s"))
           .select(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi")))
    x = (scaled.select(id_col, F.explode(F.sequence(F.lit(first), F.lit(first + B - 1))).alias("b"))
               .join(F.broadcast(box), how="cross"))      # one-row box statistics
    key = F.concat_ws(":", F.col("b").cast("string"), F.col(id_col).cast("string"))
    u = F.transform(F.sequence(F.lit(0), F.size("lo") - 1),
                    lambda i: unit_hash(F.concat_ws(":", key, i.cast("string")), salt))
    vals = F.zip_with(u, F.arrays_zip("lo", "hi"), lambda a, r: r["lo"] + a * (r["hi"] - r["lo"]))
    return x.select("b", id_col, vals.alias(features))


def gap_from_inertia(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """M19 formula: gap = mean(log W_ref) - log W; s = sd(log W_ref, ddof 1) * sqrt(1 + 1/B).

    ``observed`` (k, inertia); ``reference`` (b, k, inertia).
    """
    r = reference.groupBy("k").agg(F.avg(F.log("inertia")).alias("ref_log_mean"),
                                   F.stddev_samp(F.log("inertia")).alias("_sd"),
                                   F.count(F.lit(1)).alias("_B"))
    j = observed.join(r, "k")
    return j.select("k", (F.col("ref_log_mean") - F.log("inertia")).alias("gap"),
                    (F.col("_sd") * F.sqrt(F.lit(1.0) + F.lit(1.0) / F.col("_B"))).alias("s_k"),
                    F.log("inertia").alias("log_w"), "ref_log_mean")


def gap_statistic(df: DataFrame, ks: list[int], B: int = 10, id_col: str = "id", features: str = "features",
                  restarts: int = 3, max_iter: int = 50, seed: int = 0) -> DataFrame:
    """Gap statistic of all rows, min-max scaled.

    The observed set and each reference set (as many rows, made anew from the
    scaled ids) are fitted whole; (B + 1) x len(ks) costs reach the driver.
    """
    spark = df.sparkSession
    xs = M.minmax_scale(df.select(id_col, features), features).checkpoint(eager=True)
    observed = [(k, m.cost) for k, m in kmeans_fits(xs, ks, features, restarts, max_iter, seed).items()]
    sets = [uniform_reference(xs, 1, id_col, features, first=b) for b in range(B)]
    fitted = _concurrently([partial(kmeans_fits, x, ks, features, restarts, max_iter, seed + 1 + b)
                            for b, x in enumerate(sets)])
    reference = [(b, k, m.cost) for b, models in enumerate(fitted) for k, m in models.items()]
    return gap_from_inertia(spark.createDataFrame(observed, "k int, inertia double"),
                            spark.createDataFrame(reference, "b int, k int, inertia double"))


# -- k sweep and selection -----------------------------------------------------------------

def label_all_k(test: DataFrame, train_models: dict, test_models: dict, features: str = "features",
                id_col: str = "id") -> DataFrame:
    """Test rows x every k with ``test_label`` (own-fold model) and
    ``train_label`` (training model) in ONE projection.

    Centers are model parameters (sum of k rows of d numbers) joined as a
    bounded broadcast keyed by k.
    """
    spark = test.sparkSession
    ks = sorted(train_models)
    cen = spark.createDataFrame([(int(k), train_models[k].centers, test_models[k].centers) for k in ks],
                                "k int, tr array<array<double>>, te array<array<double>>")
    x = test.select(id_col, features, F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    x = x.join(F.broadcast(cen), "k")

    def nearest(col):
        d = F.transform(col, lambda c: squared_distance(F.col(features), c))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    return x.select("k", id_col, features, nearest(F.col("te")).alias("test_label"),
                    nearest(F.col("tr")).alias("train_label"))


def sweep_fold_metrics(labelled: DataFrame, features: str = "features", id_col: str = "id",
                       sil_max_n: int | None = None, squared: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Strength, silhouette, CH and DB for every k of one fold: one grouped pass per
    metric over the labelled test rows (keyed by k, or by fold and k).  ``squared``
    takes the linear ``silhouette_squared`` in place of the pairwise silhouette."""
    keys = keys or ["k"]
    ps = (M.strength_from_assignment(labelled, "test_label", "train_label", keys)
          .groupBy(*keys).agg(F.coalesce(F.min("strength"), F.lit(float("inf"))).alias("prediction_strength")))
    sil = (M.silhouette_squared(labelled, "train_label", features, keys) if squared
           else M.silhouette(labelled, "train_label", features, id_col, sil_max_n, keys=keys))
    ch = M.calinski_harabasz(labelled, "train_label", features, keys=keys)
    db = M.davies_bouldin(labelled, "train_label", features, keys=keys)
    return ps.join(sil, keys, "left").join(ch, keys, "left").join(db, keys, "left")


def k_sweep(df: DataFrame, ks: list[int], folds: int = 5, features: str = "features", id_col: str = "id",
            restarts: int = 3, max_iter: int = 50, seed: int = 0, squared: bool = False) -> DataFrame:
    """Metric rows (fold, k, ...) over hash folds.

    Only fits run fold by fold, and the fits of all folds are submitted together; the test
    folds are then labelled for all k and each metric is one job keyed by (fold, k).  No data
    rows pass through the driver.  ``squared`` takes the silhouette that is linear in the
    rows (column ``silhouette_squared``), the choice for very large sets.
    """
    from cohortlab.operators.splits import kfold
    x = kfold(df.select(id_col, features), id_col, folds, f"fold{seed}").checkpoint(eager=True)
    parts = [(x.where(F.col("fold") != f), x.where(F.col("fold") == f)) for f in range(folds)]
    fits = _concurrently([partial(kmeans_fits, part, ks, features, restarts, max_iter, seed) for pair in parts for part in pair])
    out = None
    for f, (_, test) in enumerate(parts):
        lab = label_all_k(test, fits[2 * f], fits[2 * f + 1], features, id_col).withColumn("fold", F.lit(f + 1))
        out = lab if out is None else out.unionByName(lab)
    met = sweep_fold_metrics(out.checkpoint(eager=True), features, id_col, squared=squared, keys=["fold", "k"])
    return met.select(F.col("fold").cast("int"), F.col("k").cast("int"), "silhouette_squared" if squared else "silhouette",
                      "prediction_strength", "calinski_harabasz", "davies_bouldin").checkpoint(eager=True)


def summarise_sweep(metrics: DataFrame) -> DataFrame:
    """Mean of every metric per k."""
    cols = [c for c in ("silhouette", "silhouette_squared", "prediction_strength", "calinski_harabasz", "davies_bouldin")
            if c in metrics.columns]
    return metrics.groupBy("k").agg(*[F.avg(c).alias(c) for c in cols])


def select_k(summary: DataFrame, threshold: float = 0.95, fallback: str | None = "silhouette") -> DataFrame:
    """Largest k whose mean strength >= threshold; else argmax of the
    fallback metric (first k on ties), or null without fallback."""
    s = summary.agg(F.max(F.when(F.col("prediction_strength") >= threshold, F.col("k"))).alias("by_strength"),
                    *([F.min_by("k", F.struct(-F.col(fallback), F.col("k"))).alias("by_fallback")] if fallback else []))
    chosen = F.coalesce("by_strength", "by_fallback") if fallback else F.col("by_strength")
    return s.select(chosen.cast("int").alias("best_k"),
                    F.when(F.col("by_strength").isNotNull(), F.lit("prediction_strength"))
                     .otherwise(F.lit(fallback) if fallback else F.lit(None)).alias("rule"))


def best_fold(metrics: DataFrame, k_col: DataFrame) -> DataFrame:
    """Fold with the highest strength at the selected k (first fold on ties)."""
    x = metrics.join(k_col.select(F.col("best_k").alias("k")), "k")
    w = Window.partitionBy("k").orderBy(F.col("prediction_strength").desc(), F.col("fold"))
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "k", "fold", "prediction_strength")


def argmax_k_per_fold(metrics: DataFrame, metric: str = "prediction_strength") -> DataFrame:
    """W6 log: the k with the highest metric in each fold (first k on ties)."""
    return metrics.groupBy("fold").agg(F.min_by("k", F.struct(-F.col(metric), F.col("k"))).alias("best_k"),
                                       F.max(metric).alias(f"max_{metric}"))


def validation_report(sections: dict[str, DataFrame]) -> DataFrame:
    """Union of one-row metric frames into (section, metric, value)."""
    out = None
    for name, df in sections.items():
        cols = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                            for c in cols]))).withColumn("section", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out.select("section", "metric", "value")


# -- replicate stability with model fitting (R operators) ------------------------------------

def labels_of_models(df: DataFrame, models: list[FittedKMeans], features: str = "features", out: str = "labels") -> DataFrame:
    """M13 for several models in one projection: ``out[r]`` is the row's label by model r.
    The centers (model parameters) are one broadcast row."""
    row = df.sparkSession.createDataFrame([([m.centers for m in models],)], "_models array<array<array<double>>>")
    near = lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")
    label = lambda centers: F.transform(F.array(F.transform(
        centers, lambda c: squared_distance(F.col(features), c))), near)[0]
    return df.crossJoin(F.broadcast(row)).withColumn(out, F.transform("_models", label)).drop("_models")


def label_signatures(labelled: DataFrame, labels: str = "labels", weights: str | None = None) -> DataFrame:
    """(sig, w) of :func:`metrics.signatures` from label arrays: entry (r, label) for each
    replicate, or only for those with a weight above 0."""
    sig = F.transform(labels, lambda label, r: F.struct(r.cast("int").alias("rep"), label.alias("label")))
    if weights is not None:
        sig = F.filter(sig, lambda e: F.get(weights, e["rep"]) > 0)
    return labelled.groupBy(sig.alias("sig")).agg(F.count(F.lit(1)).alias("w"))


def subsample_weights(df: DataFrame, reps: int, frac: float, id_col: str, salt: str) -> DataFrame:
    """``weights[r]`` = 1 for the ids that replicate r draws without replacement (hash < frac)."""
    drawn = lambda r: unit_hash(F.concat_ws(":", F.col(id_col).cast("string"), r.cast("string")), salt) < F.lit(frac)
    return df.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: drawn(r).cast("int")))


def consensus_pac_fit(df: DataFrame, k: int, reps: int = 30, frac: float = 0.8, id_col: str = "id",
                      features: str = "features", denominator: str = "all", restarts: int = 3,
                      max_iter: int = 50, seed: int = 0) -> DataFrame:
    """M20 with training: ``reps`` subsamples of all rows without replacement
    (hash < frac), a K-Means fit on each whole subsample, then PAC."""
    x = subsample_weights(df.select(id_col, features), reps, frac, id_col, f"sub{seed}").checkpoint(eager=True)
    models = kmeans_fits_weighted(x, k, reps, "weights", features, restarts, max_iter, seed)
    sigs = label_signatures(labels_of_models(x, models, features), weights="weights")
    return M.pac_of_signatures(sigs, denominator)


def bootstrap_ari_fit(df: DataFrame, k: int, reps: int = 20, frac: float = 0.8, id_col: str = "id",
                      features: str = "features", restarts: int = 3, max_iter: int = 50, seed: int = 0,
                      ddof: int = 0) -> DataFrame:
    """M21 with training: fit on each with-replacement resample (rows weighted by how often
    they were drawn), label the FULL data with each model, mean/sd of pairwise ARI."""
    x = resample_counts(df.select(id_col, features), reps, frac, id_col, f"boot{seed}").checkpoint(eager=True)
    models = kmeans_fits_weighted(x, k, reps, "weights", features, restarts, max_iter, seed)
    sigs = label_signatures(labels_of_models(x, models, features))
    return M.ari_summary(M.ari_of_counts(M.pair_counts(sigs), "l1", "l2", ["rep1", "rep2"]), ddof)


def bootstrap_jaccard_fit(df: DataFrame, k: int, reps: int = 20, frac: float = 0.8, id_col: str = "id",
                          features: str = "features", restarts: int = 3, max_iter: int = 50,
                          seed: int = 0) -> DataFrame:
    """M22 with training: full-data labels vs labels of a model refitted on
    each resample (a row drawn twice counts twice); mean and sd (ddof 0) of the Jaccard."""
    x = resample_counts(df.select(id_col, features), reps, frac, id_col, f"boot{seed}").checkpoint(eager=True)
    full = kmeans_fit(x, k, features, restarts, max_iter, seed)
    models = kmeans_fits_weighted(x, k, reps, "weights", features, restarts, max_iter, seed + 1)
    x = kmeans_predict(labels_of_models(x, models, features), full, features, "full_label")
    drawn = x.select("full_label", F.posexplode(F.arrays_zip("labels", "weights")).alias("rep", "own"))
    drawn = drawn.select("rep", "full_label", "own.labels", "own.weights").where("weights > 0")
    per = M.jaccard_partition(drawn, "full_label", "labels", ["rep"], "weights")
    return per.agg(F.avg("jaccard").alias("mean_jaccard"), F.stddev_pop("jaccard").alias("sd_jaccard"))


def cross_source_ari_fit(source: DataFrame, target: DataFrame, k: int, features: str = "features",
                         restarts: int = 3, max_iter: int = 50, seed: int = 0) -> DataFrame:
    """M26 with training: labels transferred from a model fitted on the
    source vs the target's own model, as ARI."""
    ms = kmeans_fit(source, k, features, restarts, max_iter, seed)
    mt = kmeans_fit(target, k, features, restarts, max_iter, seed)
    return M.cross_source_ari(target, ms.centers, mt.centers, features)
