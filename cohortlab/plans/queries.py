"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Outputs keep stable column names (matched by the SQL twins in
``oracle/sql.py``); doubles are rounded half-up at 1e-6 so both engines
print the same digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.numeric import round6
from cohortlab.functions.vectors import squared_distance
from cohortlab.operators import cohort as CH
from cohortlab.operators import outcomes as O
from cohortlab.plans import study as S
from cohortlab.sources import roles as R

QUERIES: dict[str, Callable] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, round6(F.col(c)))
    return df


# -- cohort -------------------------------------------------------------------

@register("harmonise_events")
def q_harmonise_events(spark, d):
    return S.harmonised_diagnoses(spark, d)


@register("index_event")
def q_index_event(spark, d):
    return CH.index_event(S.harmonised_diagnoses(spark, d), S.case_code_df(spark))


@register("first_diagnosis")
def q_first_diagnosis(spark, d):
    return CH.first_diagnosis(S.harmonised_diagnoses(spark, d))


@register("cohort_attrition")
def q_cohort_attrition(spark, d):
    return S.attrition(spark, d)


@register("build_cohort")
def q_build_cohort(spark, d):
    return S.cohort(spark, d).select(
        "patid", "pracid", "index_date", "code", "first_diagnosis_date", "imd2015_5",
        "dob", "enddate", "dod", "least_gp_register_date", "min_age_date")


# -- outcomes -----------------------------------------------------------------

@register("mortality_outcome")
def q_mortality(spark, d):
    return (O.mortality_outcome(S.cohort(spark, d), years=R.FOLLOW_UP_YEARS)
            .select("patid", "index_date", "endfollowupdate", "event", "time"))


@register("hospital_outcome")
def q_hospital(spark, d):
    return S.outcomes(spark, d).select("patid", "first_admission", "event_hos", "time_hos")


@register("relabel_by_outcome")
def q_relabel(spark, d):
    out = S.outcomes(spark, d).join(R.cluster_labels(spark, d), "patid", "inner")
    rates = O.mean_by_label(out, "event", alias="event_rate")
    m = O.outcome_relabel_map(out)
    return rounded(rates.join(m, F.col("label") == F.col("_old"))
                   .select(F.col("_old").alias("old_label"), F.col("_new").alias("new_label"),
                           "event_rate"), "event_rate")


@register("km_mortality")
def q_km_mortality(spark, d):
    return rounded(S.survival_by_cluster(spark, d, "mortality"), "survival", "cumulative")


@register("km_hospital")
def q_km_hospital(spark, d):
    return rounded(S.survival_by_cluster(spark, d, "hospital"), "survival", "cumulative")


# -- splits and sequences ------------------------------------------------------------

from cohortlab.operators import sequences as SQ  # noqa: E402
from cohortlab.operators import splits as SP  # noqa: E402


def seq_text(df: DataFrame, prefix: str = "") -> DataFrame:
    """Arrays rendered as text so results compare as scalars."""
    return (df.withColumn(f"{prefix}n_tokens", F.size(f"{prefix}code").cast("int"))
              .withColumn(f"{prefix}code_text", F.array_join(f"{prefix}code", " "))
              .withColumn(f"{prefix}year_text", F.array_join(F.col(f"{prefix}year").cast("array<string>"), ","))
              .withColumn(f"{prefix}age_text", F.array_join(F.col(f"{prefix}age").cast("array<string>"), ","))
              .drop(f"{prefix}code", f"{prefix}year", f"{prefix}age"))


@register("build_sequences")
def q_build_sequences(spark, d):
    return seq_text(S.sequences(spark, d, "before"))


@register("build_sequences_after")
def q_build_sequences_after(spark, d):
    return seq_text(S.sequences(spark, d, "after"))


@register("sequence_long")
def q_sequence_long(spark, d):
    return SQ.sequence_long(S.sequences(spark, d, "before"))


@register("contrastive_views")
def q_contrastive_views(spark, d):
    v = SQ.non_empty(SQ.contrastive_views(S.sequences(spark, d, "before"), n_epochs=2, seed=0), "post_")
    v = seq_text(seq_text(v, "pre_"), "post_")
    return v


@register("practice_split")
def q_practice_split(spark, d):
    return SP.split_groups(R.patients(spark, d), "pracid", 0.8, "split")


@register("split_by_group")
def q_split_by_group(spark, d):
    seq = S.sequences_with_practice(spark, d).select("patid", "pracid")
    internal, external = SP.split_by_group(seq, "pracid", 0.8, "split")
    return (internal.withColumn("side", F.lit("internal"))
            .unionByName(external.withColumn("side", F.lit("external"))))


@register("kfold")
def q_kfold(spark, d):
    return SP.kfold(R.patients(spark, d).select("patid"), "patid", 5, "fold")


@register("sample_n")
def q_sample_n(spark, d):
    return SP.sample_n(R.patients(spark, d).select("patid"), 100, "patid", "sample")


@register("bootstrap_draws")
def q_bootstrap_draws(spark, d):
    v = R.vectors(spark, d).select("id")
    n = v.count()
    idx = SP.dense_index(v, "id", "idx")
    return SP.bootstrap_draws(idx, n, reps=3, frac=0.8, salt="boot").select("rep", "draw", "idx", "id")


@register("vocabulary")
def q_vocabulary(spark, d):
    return SQ.vocabulary(SQ.sequence_tokens(S.sequences(spark, d, "before")))


def _split_vocab(spark, d):
    seq = S.sequences_with_practice(spark, d)
    internal, external = SP.split_by_group(seq, "pracid", 0.8, "split")
    vocab = SQ.vocabulary(SQ.sequence_tokens(internal))
    return internal, external, vocab


@register("keep_vocabulary")
def q_keep_vocabulary(spark, d):
    _, external, vocab = _split_vocab(spark, d)
    return SQ.keep_vocabulary(external, vocab)


@register("vocab_encode")
def q_vocab_encode(spark, d):
    _, external, vocab = _split_vocab(spark, d)
    enc = SQ.vocab_encode(external, vocab, max_len=512)
    return enc.select("patid", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids_text"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


# -- profiles --------------------------------------------------------------------------

from cohortlab.operators import codes as CD  # noqa: E402
from cohortlab.operators import profile as PR  # noqa: E402

LABELS = [1, 2, 3, 4, 5]


@register("cluster_sizes")
def q_cluster_sizes(spark, d):
    return rounded(PR.value_counts(S.labelled_outcomes(spark, d), "label"), "share")


@register("baseline_table")
def q_baseline_table(spark, d):
    return rounded(PR.baseline_table(S.labelled_outcomes(spark, d)), "value", "sd", "pct", "missing_pct")


@register("baseline_pivot")
def q_baseline_pivot(spark, d):
    long = PR.baseline_table(S.labelled_outcomes(spark, d))
    wide = PR.pivot_by_label(long, "variable", "text", LABELS)
    return wide.select("variable", *[F.col(str(k)).alias(f"cluster_{k}") for k in LABELS])


@register("code_prevalence")
def q_code_prevalence(spark, d):
    return rounded(PR.code_prevalence(S.labelled_sequences(spark, d)), "prevalence")


@register("prevalence_range")
def q_prevalence_range(spark, d):
    prev = PR.code_prevalence(S.labelled_sequences(spark, d))
    return rounded(PR.prevalence_range(prev, len(LABELS)), "max_prev", "min_prev", "prevalence_range")


def _matrix(spark, d, family, threshold=0.15):
    prev = PR.code_prevalence(S.labelled_sequences(spark, d))
    m = PR.prevalence_matrix(prev, R.code_descriptions(spark, d), LABELS, threshold, family)
    return rounded(m.select("code", "description", "display",
                            *[F.col(str(k)).alias(f"p{k}") for k in LABELS]), *[f"p{k}" for k in LABELS])


@register("prevalence_matrix")
def q_prevalence_matrix(spark, d):
    return _matrix(spark, d, "all")


@register("prevalence_matrix_t05")
def q_prevalence_matrix_t05(spark, d):
    return _matrix(spark, d, "all", 0.05)


@register("prevalence_matrix_icd")
def q_prevalence_matrix_icd(spark, d):
    return _matrix(spark, d, "icd", 0.05)


@register("prevalence_matrix_med")
def q_prevalence_matrix_med(spark, d):
    return _matrix(spark, d, "med", 0.05)


@register("prevalence_matrix_val")
def q_prevalence_matrix_val(spark, d):
    return _matrix(spark, d, "val", 0.05)


@register("prevalence_matrix_proc")
def q_prevalence_matrix_proc(spark, d):
    return _matrix(spark, d, "proc", 0.05)


@register("describe_codes")
def q_describe_codes(spark, d):
    from cohortlab.functions.codes import group_code
    codes = (SQ.sequence_long(S.sequences(spark, d)).select(group_code("code").alias("code"))
             .where(F.col("code").isNotNull()).distinct())
    return CD.describe_codes(codes, R.code_descriptions(spark, d), "code")


# -- genetics ------------------------------------------------------------------------------

from cohortlab.operators import genetics as G  # noqa: E402


@register("carrier_ratio")
def q_carrier_ratio(spark, d):
    return rounded(G.carrier_ratio(R.dosage(spark, d), R.score_labels(spark, d), R.snp_frequencies(spark)),
                   "ratio")


@register("carrier_ratio_missing_as_carrier")
def q_carrier_ratio_mc(spark, d):
    return rounded(G.carrier_ratio(R.dosage(spark, d), R.score_labels(spark, d), R.snp_frequencies(spark),
                                   missing="carrier"), "ratio")


@register("snp_association")
def q_snp_association(spark, d):
    return rounded(G.snp_association(R.dosage(spark, d), R.score_labels(spark, d)),
                   "group_pct", "other_pct", "odds_ratio", "p_value")


@register("prs_group_summary")
def q_prs_group_summary(spark, d):
    s = G.group_summary(G.labelled_scores(R.scores(spark, d), R.score_labels(spark, d)))
    return rounded(s, "mean", "var")


@register("prs_trait_filter")
def q_prs_trait_filter(spark, d):
    ls = G.labelled_scores(R.scores(spark, d), R.score_labels(spark, d))
    return rounded(G.trait_filter(ls, 0.15), "max_mean", "min_mean", "mean_range")


@register("prs_trait_filter_t02")
def q_prs_trait_filter_t02(spark, d):
    ls = G.labelled_scores(R.scores(spark, d), R.score_labels(spark, d))
    return rounded(G.trait_filter(ls, 0.02), "max_mean", "min_mean", "mean_range")


@register("prs_pairwise")
def q_prs_pairwise(spark, d):
    return rounded(G.prs_pairwise(R.scores(spark, d), R.score_labels(spark, d)),
                   "mean1", "mean2", "t_stat", "dof", "p_val", "cohen_d", "p_val_adjusted")


@register("prs_significant")
def q_prs_significant(spark, d):
    pw = G.prs_pairwise(R.scores(spark, d), R.score_labels(spark, d))
    return rounded(pw.where(F.col("significant")).select("trait", "group1", "group2", "p_val_adjusted"),
                   "p_val_adjusted")


@register("prs_one_vs_rest")
def q_prs_one_vs_rest(spark, d):
    return rounded(G.prs_one_vs_rest(R.scores(spark, d), R.score_labels(spark, d)),
                   "mean_group", "mean_other", "t_stat", "dof", "p_val", "cohen_d")


# -- cluster metrics -----------------------------------------------------------------------

from cohortlab.operators import metrics as M  # noqa: E402


@register("nearest_center")
def q_nearest_center(spark, d):
    return S.vector_partitions(spark, d).select("id", "label", "nearest")


@register("crosstab")
def q_crosstab(spark, d):
    return M.crosstab(S.vector_partitions(spark, d), "label", "nearest")


@register("adjusted_rand")
def q_adjusted_rand(spark, d):
    return rounded(M.adjusted_rand(S.vector_partitions(spark, d), "label", "nearest"), "ari")


@register("jaccard_partition")
def q_jaccard(spark, d):
    return rounded(M.jaccard_partition(S.vector_partitions(spark, d), "label", "nearest"), "jaccard")


@register("best_mapping_accuracy")
def q_best_mapping(spark, d):
    acc = M.best_mapping_accuracy(S.vector_partitions(spark, d), "label", "nearest")
    return rounded(spark.createDataFrame([(acc,)], "accuracy double"), "accuracy")


@register("best_mapping_many_labels")
def q_best_mapping_many(spark, d):
    """M25 with 60 labels on either side: orders by customer, and a renumbering of that
    which a fifth of the orders leaves."""
    from cohortlab.functions.hashing import portable_hash
    orders = R.table(spark, d, "orders").select("o_orderkey", (portable_hash("o_custkey", "map") % 60).cast("int").alias("a"))
    other = F.when(portable_hash("o_orderkey", "stay") % 5 > 0, (F.col("a") * 7 + 3) % 60).otherwise(
        portable_hash("o_orderkey", "away") % 60)
    return M.best_mapping(orders.withColumn("b", other.cast("int")), "a", "b")


@register("prediction_strength_by_cluster")
def q_ps_by_cluster(spark, d):
    return rounded(M.prediction_strength_by_cluster(R.vectors(spark, d), "label", S.class_center_list(spark, d)),
                   "strength")


@register("prediction_strength")
def q_ps(spark, d):
    return rounded(M.prediction_strength(R.vectors(spark, d), "label", S.class_center_list(spark, d)),
                   "prediction_strength")


@register("silhouette")
def q_silhouette(spark, d):
    return rounded(M.silhouette(R.vectors(spark, d), "label"), "silhouette")


@register("silhouette_squared")
def q_silhouette_squared(spark, d):
    return rounded(M.silhouette_squared(R.vectors(spark, d), "label"), "silhouette_squared")


@register("silhouette_points")
def q_silhouette_points(spark, d):
    return rounded(M.silhouette_points(R.vectors(spark, d), "label"), "s")


@register("calinski_harabasz")
def q_ch(spark, d):
    return rounded(M.calinski_harabasz(R.vectors(spark, d), "label"), "calinski_harabasz")


@register("davies_bouldin")
def q_db(spark, d):
    return rounded(M.davies_bouldin(R.vectors(spark, d), "label"), "davies_bouldin")


@register("within_dispersion")
def q_inertia(spark, d):
    return rounded(M.within_dispersion(R.vectors(spark, d), "label"), "inertia")


@register("inertia_to_centers")
def q_inertia_centers(spark, d):
    return rounded(M.inertia_to_centers(R.vectors(spark, d), S.class_center_list(spark, d)), "inertia")


@register("minmax_scale")
def q_minmax(spark, d):
    x = M.minmax_scale(R.vectors(spark, d), "features", "scaled")
    return rounded(x.select("id", F.posexplode("scaled").alias("dim", "value")), "value")


@register("consensus_pac")
def q_pac(spark, d):
    rl = S.replicate_labels(spark, d, reps=5, frac=0.8)
    return rounded(M.consensus_pac(rl, R.vectors(spark, d).select("id"), denominator="all"), "pac")


@register("consensus_pac_cosampled")
def q_pac_b(spark, d):
    rl = S.replicate_labels(spark, d, reps=5, frac=0.8)
    return rounded(M.consensus_pac(rl, R.vectors(spark, d).select("id"), denominator="cosampled_minus_n"), "pac")


@register("replicate_pair_ari")
def q_rep_pair_ari(spark, d):
    return rounded(M.replicate_pair_ari(S.replicate_labels(spark, d, reps=4, frac=0.8, full=True)), "ari")


@register("bootstrap_ari")
def q_bootstrap_ari(spark, d):
    return rounded(M.bootstrap_ari(S.replicate_labels(spark, d, reps=4, frac=0.8, full=True), ddof=0),
                   "mean_ari", "sd_ari")


@register("bootstrap_ari_ddof1")
def q_bootstrap_ari1(spark, d):
    return rounded(M.bootstrap_ari(S.replicate_labels(spark, d, reps=4, frac=0.8, full=True), ddof=1),
                   "mean_ari", "sd_ari")


@register("bootstrap_jaccard")
def q_bootstrap_jaccard(spark, d):
    full = S.vector_partitions(spark, d).select("id", F.col("nearest").alias("label"))
    return rounded(M.bootstrap_jaccard(S.bootstrap_refit_labels(spark, d, reps=3, frac=0.8), full),
                   "mean_jaccard", "sd_jaccard")


@register("cross_source_ari")
def q_cross_source_ari(spark, d):
    from cohortlab.functions.hashing import unit_hash
    v = R.vectors(spark, d)
    src = unit_hash(F.col("id"), "src") < F.lit(0.5)
    a, b = v.where(src), v.where(~src)

    def centers(x):
        first = x.groupBy("label").agg(F.min("id").alias("id"))
        c = x.join(first, ["label", "id"], "left_semi").select(F.col("label").alias("idx"), F.col("features").alias("center"))
        return M.collect_centers(c, with_ids=True)

    (ca, ia), (cb, ib) = centers(a), centers(b)
    x = M.assign_nearest(b, ca, "features", "transfer", ia)
    x = M.assign_nearest(x, cb, "features", "native", ib)
    return rounded(M.adjusted_rand(x, "transfer", "native"), "ari")


@register("pair_ranking_loss")
def q_pair_ranking_loss(spark, d):
    v = R.vectors(spark, d)
    a = v.where(F.col("id") % 2 == 0).select((F.col("id") / 2).cast("long").alias("i"), F.col("features").alias("a"))
    b = v.where(F.col("id") % 2 == 1).select(((F.col("id") - 1) / 2).cast("long").alias("i"), F.col("features").alias("b"))
    pairs = a.join(b, "i").select((F.col("i") / 16).cast("long").alias("batch"), (F.col("i") % 16).alias("pos"), "a", "b")
    return rounded(M.pair_ranking_loss(pairs, scale=20.0), "loss")


# -- features and clustering ----------------------------------------------------------------

from cohortlab.operators import clustering as CL  # noqa: E402
from cohortlab.operators import features as FE  # noqa: E402


@register("tfidf")
def q_tfidf(spark, d):
    _, te, _, _, _ = S.tfidf_split(spark, d)
    return rounded(te, "value")


@register("tfidf_external")
def q_tfidf_external(spark, d):
    _, _, ex, _, _ = S.tfidf_split(spark, d)
    return rounded(ex, "value")


@register("idf")
def q_idf(spark, d):
    _, _, _, _, idf = S.tfidf_split(spark, d)
    return rounded(idf, "idf")


COMPONENTS = 300


def _svd(spark, d, k=8):
    tr, te, ex, vocab, _ = S.tfidf_split(spark, d)
    n_feat = vocab.agg(F.max("idx")).first()[0] + 1
    loads, sv = FE.svd_loadings(tr, n_feat, k)
    return tr, te, ex, loads, sv


@register("svd_project")
def q_svd_project(spark, d):
    """Rows-only (signs of singular vectors are arbitrary): test docs in the SVD space of M11, 300
    components (zeros for those that the training documents do not have)."""
    _, te, _, loads, _ = _svd(spark, d, COMPONENTS)
    p = FE.project(te, loads, COMPONENTS)
    return p.select("doc", F.size("features").alias("dims"),
                    F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@register("svd_invariants")
def q_svd_invariants(spark, d):
    """What every truncated SVD of the training documents has in common: V'V is the identity
    (part ``dot``), and |X'Xv - s^2 v| is below 1e-6 s^2 for every component (part ``residual``, 1)."""
    tr, _, _, loads, sv = _svd(spark, d)
    image = FE._times_sparse(tr, FE.project(tr, loads, len(sv)).withColumnRenamed("features", "vec"), "doc", "idx")
    zero = F.lit(0.0)
    by_term = loads.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("comp", "v"))).alias("m"))
    rows = image.join(by_term, "idx", "left").select("vec", F.transform(
        F.sequence(F.lit(0), F.lit(len(sv) - 1)), lambda c: F.coalesce(F.try_element_at("m", c), zero)).alias("own"))
    rows = rows.checkpoint(eager=True)
    dots = rows.select("own", F.posexplode("own").alias("i", "a")).select("i", "a", F.posexplode("own").alias("j", "b"))
    dots = dots.where("i <= j").groupBy("i", "j").agg(F.abs(F.sum(F.col("a") * F.col("b"))).alias("value"))
    squares = F.array(*[F.lit(s * s) for s in sv])
    off = rows.select(F.posexplode(F.arrays_zip("vec", "own", squares.alias("s2"))).alias("i", "x"))
    apart = off.groupBy("i").agg(F.sqrt(F.sum(F.pow(F.col("x.vec") - F.col("x.s2") * F.col("x.own"), F.lit(2)))).alias("apart"),
                                 F.first("x.s2").alias("s2"))
    within = apart.select(F.lit("residual").alias("part"), "i", F.col("i").alias("j"),
                          (F.col("apart") <= 1e-6 * F.col("s2")).cast("double").alias("value"))
    return rounded(dots.select(F.lit("dot").alias("part"), "i", "j", "value").unionByName(within), "value")


@register("kmeans_labels")
def q_kmeans_labels(spark, d):
    """Rows-only: K-Means fitted on projected train docs, external docs labelled."""
    tr, _, ex, loads, _ = _svd(spark, d)
    model = CL.kmeans_fit(FE.project(tr, loads, 8), 4, restarts=2, max_iter=20)
    return CL.kmeans_predict(FE.project(ex, loads, 8), model).select("doc", "label")


@register("k_sweep")
def q_k_sweep(spark, d):
    """Rows-only: folds x k metric rows with K-Means fits on the vectors."""
    return CL.k_sweep(R.vectors(spark, d), [2, 3], folds=2, restarts=1, max_iter=10, squared=True)


@register("gap_statistic")
def q_gap(spark, d):
    """Rows-only: gap statistic with Spark ML fits of the whole observed and reference sets."""
    return CL.gap_statistic(R.vectors(spark, d), [2, 3, 4], B=3, restarts=1, max_iter=10)


@register("gap_from_inertia")
def q_gap_from_inertia(spark, d):
    """M19 formula on fixed centers: squared distances of the vectors to the first k class
    centers; reference b shifts every vector by b + 1."""
    v = R.vectors(spark, d)
    classes = R.class_centers(spark, d).agg(F.sort_array(F.collect_list(F.struct("idx", "center"))).alias("_g"))
    b = F.explode(F.sequence(F.lit(-1), F.lit(2))).alias("b")
    k = F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("k")
    x = v.select("features", b).select("features", "b", k).crossJoin(F.broadcast(classes))    # one row of ten centers
    shifted = F.transform("features", lambda e: e + F.col("b") + 1)
    cost = F.array_min(F.transform(F.slice("_g", 1, F.col("k")), lambda c: squared_distance(shifted, c["center"])))
    inertia = x.groupBy("b", "k").agg(F.sum(cost).alias("inertia"))
    gap = CL.gap_from_inertia(inertia.where("b = -1").drop("b"), inertia.where("b >= 0"))
    return rounded(gap, "gap", "s_k", "log_w", "ref_log_mean")


@register("fixed_center_sweep")
def q_fixed_sweep(spark, d):
    return rounded(S.fixed_center_sweep(spark, d), "prediction_strength", "silhouette")


@register("sweep_summary")
def q_sweep_summary(spark, d):
    return rounded(CL.summarise_sweep(S.fixed_center_sweep(spark, d)), "prediction_strength", "silhouette")


@register("select_k")
def q_select_k(spark, d):
    return CL.select_k(CL.summarise_sweep(S.fixed_center_sweep(spark, d)), 0.9)


@register("select_k_strict")
def q_select_k_strict(spark, d):
    return CL.select_k(CL.summarise_sweep(S.fixed_center_sweep(spark, d)), 0.95)


@register("select_k_by_strength")
def q_select_k_by_strength(spark, d):
    """W5 without fallback, at a threshold that the strengths of fixed centers reach."""
    return CL.select_k(CL.summarise_sweep(S.fixed_center_sweep(spark, d)), 0.5, None)


@register("select_k_by_strength_t09")
def q_select_k_by_strength_t09(spark, d):
    """W5 without fallback at 0.9: null when no K is that strong."""
    return CL.select_k(CL.summarise_sweep(S.fixed_center_sweep(spark, d)), 0.9, None)


@register("best_fold")
def q_best_fold(spark, d):
    m = S.fixed_center_sweep(spark, d)
    return rounded(CL.best_fold(m, CL.select_k(CL.summarise_sweep(m), 0.9)), "prediction_strength")


@register("argmax_k_per_fold")
def q_argmax_k(spark, d):
    return rounded(CL.argmax_k_per_fold(S.fixed_center_sweep(spark, d)), "max_prediction_strength")


@register("mean_pool")
def q_mean_pool(spark, d):
    """Token vectors: vocabulary token -> the vector with id = hash(token) mod n."""
    from cohortlab.functions.hashing import portable_hash
    seq = S.sequences(spark, d)
    toks = SQ.sequence_tokens(seq)
    v = R.vectors(spark, d)
    n = v.count()
    tv = (toks.select(F.col("code").alias("token")).distinct()
              .withColumn("id", portable_hash(F.col("token"), "tok") % n)
              .join(v.select("id", "features"), "id").select("token", "features"))
    pooled = FE.mean_pool(toks, tv)
    return rounded(pooled.select("patid", F.posexplode("pooled").alias("dim", "value")), "value")


# -- code lists and sides ---------------------------------------------------------------------

@register("case_codes")
def q_case_codes(spark, d):
    return CD.case_codes(S.code_list(spark), R.code_dictionary(spark, d), "case", S.icd_code_df(spark))


@register("symptom_codes")
def q_symptom_codes(spark, d):
    return CD.symptom_codes(S.code_list(spark).where(F.col("name") != "case"), R.code_dictionary(spark, d))


@register("index_event_from_definitions")
def q_index_event_defs(spark, d):
    codes = CD.case_codes(S.code_list(spark), R.code_dictionary(spark, d), "case", S.icd_code_df(spark))
    return CH.index_event(S.harmonised_diagnoses(spark, d), codes)


@register("relabel_external")
def q_relabel_external(spark, d):
    return S.relabelled_sides(spark, d).select("patid", "side", "label", "event")


@register("validation_report")
def q_validation_report(spark, d):
    """Union of one-row metric frames into (section, metric, value)."""
    v = R.vectors(spark, d)
    parts = S.vector_partitions(spark, d)
    return rounded(CL.validation_report({
        "internal": M.calinski_harabasz(v, "label").crossJoin(M.davies_bouldin(v, "label")),
        "agreement": M.adjusted_rand(parts, "label", "nearest"),
    }), "value")


@register("consensus_pac_fit")
def q_pac_fit(spark, d):
    """Rows-only: PAC with a Spark ML K-Means fit per whole subsample."""
    return CL.consensus_pac_fit(R.vectors(spark, d), 4, reps=5, frac=0.8, restarts=1, max_iter=10)


@register("bootstrap_ari_fit")
def q_bootstrap_ari_fit(spark, d):
    """Rows-only: bootstrap ARI with Spark ML fits per resample."""
    return CL.bootstrap_ari_fit(R.vectors(spark, d), 4, reps=3, restarts=1, max_iter=10)


@register("bootstrap_jaccard_fit")
def q_bootstrap_jaccard_fit(spark, d):
    """Rows-only: bootstrap Jaccard with Spark ML fits per resample."""
    return CL.bootstrap_jaccard_fit(R.vectors(spark, d), 4, reps=2, restarts=1, max_iter=10)


@register("cross_source_ari_fit")
def q_cross_source_ari_fit(spark, d):
    """Rows-only: cross-source ARI with K-Means fitted on each source."""
    from cohortlab.functions.hashing import unit_hash
    v = R.vectors(spark, d)
    src = unit_hash(F.col("id"), "src") < F.lit(0.5)
    return CL.cross_source_ari_fit(v.where(src), v.where(~src), 4, restarts=1, max_iter=10)


@register("index_code_counts")
def q_index_code_counts(spark, d):
    """A5: cohort patients per index code, by descending frequency with share."""
    return rounded(PR.value_counts(S.cohort(spark, d), "code"), "share")


@register("text_normalise")
def q_text_normalise(spark, d):
    """F9 on whole document texts: token count and a digest of the normalised text."""
    from cohortlab.functions.codes import text_tokens_normalised
    docs = R.table(spark, d, "documents").select("doc_id", "text")
    t = text_tokens_normalised("text")
    n = F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))
    return docs.select("doc_id", n.alias("n_tokens"), F.md5(t).alias("digest"))


@register("parse_dosage")
def q_parse_dosage(spark, d):
    """The genotypes as the lines of a dosage file, parsed back."""
    from cohortlab.sources import io
    names = [n for n, _ in R.SNP_FREQUENCIES]
    cell = lambda n: F.coalesce(F.max(F.when(F.col("snp") == n, F.col("dosage").cast("string"))), F.lit("NA"))
    lines = (R.dosage(spark, d).groupBy("patid").agg(*[cell(n).alias(f"_{i}") for i, n in enumerate(names)])
             .select(F.concat_ws(" ", "patid", "patid", *[f"_{i}" for i in range(len(names))]).alias("value")))
    return io.parse_dosage(lines, " ".join(["FID", "IID", *names]))


@register("parse_dates")
def q_parse_dates(spark, d):
    """ship dates as day/month/year text, broken in every fifth order."""
    from cohortlab.functions.dates import parse_date
    li = R.table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("day"))
    text = F.date_format("day", "dd/MM/yyyy")
    broken = F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return (li.withColumn("parsed", parse_date(broken)).groupBy("l_orderkey")
            .agg(F.count("parsed").alias("n_dates"), F.min("parsed").alias("first_date"), F.max("parsed").alias("last_date")))


@register("shifted_labels")
def q_shifted_labels(spark, d):
    """One-based labels joined to the patient columns that they lack."""
    from cohortlab.functions.codes import shift_label
    labels = R.cluster_labels(spark, d).select("patid", shift_label("label").alias("cluster"))
    return CD.non_overlapping_join(labels, R.patients(spark, d).withColumn("cluster", F.lit(-1)))


# Queries of the readers, code systems and model selection register themselves.
from cohortlab.plans import reader_queries, selection_queries  # noqa: E402, F401
