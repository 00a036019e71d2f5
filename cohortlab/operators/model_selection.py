"""Model selection over K and validation reports from one table of fitted models.

Every model that the metrics need - on a whole set, on its subsamples and resamples, on
the scaled set and the reference sets of the gap statistic - is fitted once and is a row of
the models table (dataset, purpose, k, rep, centers, cost).  The metrics read that table, so
they can be computed again, extended by a K or checked with given centers without a fit.

The table holds parameters (k rows of d numbers a model); its rows are the only thing that
passes through the driver.  Data rows are labelled by broadcast centers, as in M13.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import clustering as CL
from cohortlab.operators import metrics as M
from cohortlab.operators.splits import resample_counts

MODELS = "dataset string, purpose string, k int, rep int, centers array<array<double>>, cost double"
#: Purposes of a model.
FULL, SUBSAMPLE, BOOTSTRAP, GAP_OBSERVED, GAP_REFERENCE = "full", "subsample", "bootstrap", "gap_observed", "gap_reference"


def fit_models(datasets: dict[str, DataFrame], ks: list[int], consensus_reps: int = 30, consensus_frac: float = 0.8,
               bootstrap_reps: int = 20, bootstrap_frac: float = 0.8, gap_sets: int = 10, restarts: int = 10,
               max_iter: int = 300, seed: int = 0, id_col: str = "id", features: str = "features",
               targets: tuple[str, ...] = ()) -> DataFrame:
    """The models table of ``datasets`` (name -> rows of id and features) for every K.

    ``targets`` names the sets that only serve as targets of transferred labels: they get
    their whole-set models and no repetitions.
    Subsamples and resamples are weights on one persisted set of vectors.  A part with no
    repetitions (``consensus_reps=0``, ...) is left out, and its columns are null later.
    """
    found: list[tuple] = []
    spark = SparkSession.active()

    def add(name: str, purpose: str, models: list[tuple[int, CL.FittedKMeans]]) -> None:
        found.extend((name, purpose, m.k, rep, m.centers, m.cost) for rep, m in models)

    for name, df in datasets.items():
        x = df.select(id_col, features)
        whole = CL.kmeans_fits(x, ks, features, restarts, max_iter, seed)
        add(name, FULL, [(0, m) for m in whole.values()])
        if name in targets:
            continue
        weighted = []
        if consensus_reps:
            weighted.append((SUBSAMPLE, consensus_reps, CL.subsample_weights(x, consensus_reps, consensus_frac, id_col, f"sub{seed}")))
        if bootstrap_reps:
            weighted.append((BOOTSTRAP, bootstrap_reps, resample_counts(x, bootstrap_reps, bootstrap_frac, id_col, f"boot{seed}")))
        for purpose, reps, sets in weighted:
            sets = sets.checkpoint(eager=True)
            for k in ks:
                add(name, purpose, list(enumerate(CL.kmeans_fits_weighted(sets, k, reps, "weights", features, restarts, max_iter, seed))))
        if gap_sets:
            scaled = M.minmax_scale(x, features).checkpoint(eager=True)
            fit = partial(CL.kmeans_fits, ks=ks, features=features, restarts=restarts, max_iter=max_iter)
            add(name, GAP_OBSERVED, [(0, m) for m in fit(scaled, seed=seed).values()])
            for b in range(gap_sets):
                reference = CL.uniform_reference(scaled, 1, id_col, features, first=b)
                add(name, GAP_REFERENCE, [(b, m) for m in fit(reference, seed=seed + b + 1).values()])
    return spark.createDataFrame(found, MODELS)


def models_of(models: DataFrame, dataset: str, purpose: str, k: int | None = None) -> list[CL.FittedKMeans]:
    """Rows of the table as models, by K and repetition (parameters, bounded)."""
    rows = models.where((F.col("dataset") == dataset) & (F.col("purpose") == purpose))
    rows = rows if k is None else rows.where(F.col("k") == k)
    found = rows.orderBy("k", "rep").limit(M.MAX_CENTERS + 1).collect()
    if len(found) > M.MAX_CENTERS:
        raise ValueError(f"more than {M.MAX_CENTERS} models of one purpose")
    return [CL.FittedKMeans(r["k"], [list(c) for c in r["centers"]], r["cost"], 0) for r in found]


def _by_k(df: DataFrame, models: list[CL.FittedKMeans], features: str, label: str = "label") -> DataFrame:
    """Rows x K with the label of each K's model."""
    ks = F.array(*[F.lit(m.k) for m in models])
    x = CL.labels_of_models(df, models, features, "_labels")
    return x.select(*df.columns, F.inline(F.arrays_zip(ks.alias("k"), F.col("_labels").alias(label))))


def _per_k(spark: SparkSession, parts: list[tuple[int, DataFrame]], schema: str) -> DataFrame:
    """Union of one-row results, each with its K."""
    out = None
    for k, df in parts:
        row = df.withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return spark.createDataFrame([], schema) if out is None else out


def internal_metrics(df: DataFrame, labelled_by: list[CL.FittedKMeans], squared: bool = False, id_col: str = "id",
                     features: str = "features") -> DataFrame:
    """(k, silhouette, calinski_harabasz, davies_bouldin) of the labels by one model per K;
    ``squared`` takes the linear silhouette of squared distances."""
    labelled = _by_k(df.select(id_col, features), labelled_by, features).checkpoint(eager=True)
    sil = (M.silhouette_squared(labelled, "label", features, ["k"]).withColumnRenamed("silhouette_squared", "silhouette")
           if squared else M.silhouette(labelled, "label", features, id_col, keys=["k"]))
    ks = labelled.select("k").distinct()
    return (ks.join(sil, "k", "left").join(M.calinski_harabasz(labelled, "label", features, ["k"]), "k", "left")
            .join(M.davies_bouldin(labelled, "label", features, ["k"]), "k", "left"))


def stability_metrics(df: DataFrame, models: DataFrame, dataset: str, ks: list[int], denominator: str = "all", ddof: int = 0,
                      consensus_frac: float = 0.8, seed: int = 0, id_col: str = "id", features: str = "features") -> DataFrame:
    """(k, consensus_pac, bootstrap_ari_mean, bootstrap_ari_sd) from the set's replicate models."""
    spark, x = df.sparkSession, df.select(id_col, features)
    pac, ari = [], []
    for k in ks:
        drawn, resampled = models_of(models, dataset, SUBSAMPLE, k), models_of(models, dataset, BOOTSTRAP, k)
        if drawn:
            rows = CL.subsample_weights(x, len(drawn), consensus_frac, id_col, f"sub{seed}")
            sigs = CL.label_signatures(CL.labels_of_models(rows, drawn, features), weights="weights")
            pac.append((k, M.pac_of_signatures(sigs, denominator).select(F.col("pac").alias("consensus_pac"))))
        if resampled:
            cells = M.pair_counts(CL.label_signatures(CL.labels_of_models(x, resampled, features)))
            summary = M.ari_summary(M.ari_of_counts(cells, "l1", "l2", ["rep1", "rep2"]), ddof)
            ari.append((k, summary.withColumnsRenamed({"mean_ari": "bootstrap_ari_mean", "sd_ari": "bootstrap_ari_sd"})))
    out = spark.createDataFrame([(k,) for k in ks], "k int")
    out = out.join(_per_k(spark, pac, "consensus_pac double, k int"), "k", "left")
    return out.join(_per_k(spark, ari, "bootstrap_ari_mean double, bootstrap_ari_sd double, k int"), "k", "left")


def gap_metrics(models: DataFrame, dataset: str) -> DataFrame:
    """(k, gap, gap_se) from the costs of the set's gap models."""
    own = models.where(F.col("dataset") == dataset)
    observed = own.where(F.col("purpose") == GAP_OBSERVED).select("k", F.col("cost").alias("inertia"))
    reference = own.where(F.col("purpose") == GAP_REFERENCE).select(F.col("rep").alias("b"), "k", F.col("cost").alias("inertia"))
    return CL.gap_from_inertia(observed, reference).select("k", "gap", F.col("s_k").alias("gap_se"))


def cross_source_metrics(target: DataFrame, models: DataFrame, source_name: str, target_name: str,
                         features: str = "features") -> DataFrame:
    """(k, ari): the target's rows labelled by the source's model and by its own, for every K at once."""
    source = {m.k: m for m in models_of(models, source_name, FULL)}
    native = {m.k: m for m in models_of(models, target_name, FULL)}
    ks = sorted(source.keys() & native.keys())
    x = CL.labels_of_models(target.select(features), [source[k] for k in ks], features, "_a")
    x = CL.labels_of_models(x, [native[k] for k in ks], features, "_b")
    zipped = F.arrays_zip(F.array(*[F.lit(k) for k in ks]).alias("k"), F.col("_a").alias("transfer"), F.col("_b").alias("native"))
    return M.adjusted_rand(x.select(F.inline(zipped)), "transfer", "native", ["k"])


def selection_table(datasets: dict[str, DataFrame], models: DataFrame, source: str, squared: bool = False,
                    consensus_frac: float = 0.8, seed: int = 0, id_col: str = "id", features: str = "features") -> DataFrame:
    """One row per K of the ``source`` set - silhouette, Calinski-Harabasz, Davies-Bouldin,
    gap and its error, consensus PAC, bootstrap ARI mean and sd, and a column
    ``cross_source_ari_<name>`` for every other set."""
    full = models_of(models, source, FULL)
    df = datasets[source]
    out = internal_metrics(df, full, squared, id_col, features).join(gap_metrics(models, source), "k", "left")
    out = out.join(stability_metrics(df, models, source, [m.k for m in full], "all", 0, consensus_frac, seed, id_col, features), "k", "left")
    for name in datasets:
        if name != source:
            ari = cross_source_metrics(datasets[name], models, source, name, features)
            out = out.join(ari.withColumnRenamed("ari", f"cross_source_ari_{name}"), "k", "left")
    return out


def validation_table(datasets: dict[str, DataFrame], models: DataFrame, k: int, source: str, squared: bool = False,
                     consensus_frac: float = 0.8, seed: int = 0, id_col: str = "id", features: str = "features") -> DataFrame:
    """One row per set at the chosen K - the internal metrics of the labels by the
    ``source`` model, PAC (co-sampled pairs) and bootstrap ARI (sd with ddof 1) of the set's own
    replicates, and for the other sets the ARI of transferred and native labels."""
    chosen = [m for m in models_of(models, source, FULL) if m.k == k]
    out = None
    for name, df in datasets.items():
        row = internal_metrics(df, chosen, squared, id_col, features).join(
            stability_metrics(df, models, name, [k], "cosampled_minus_n", 1, consensus_frac, seed, id_col, features), "k", "left")
        ari = F.lit(None).cast("double")
        if name == source:
            row = row.withColumn("cross_source_ari", ari)
        else:
            cross = cross_source_metrics(df, models.where(F.col("k") == k), source, name, features)
            row = row.join(cross.withColumnRenamed("ari", "cross_source_ari"), "k", "left")
        row = row.withColumn("dataset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
