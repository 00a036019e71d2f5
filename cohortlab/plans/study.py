"""End-to-end compositions over the role tables derived from the driver's data.

Each function takes (spark, sf_dir) and returns a lazy DataFrame; nothing is
collected.  These are the flows a user of the library writes: cohort ->
outcomes -> survival by cluster; cohort -> sequences -> profiles; vectors ->
cluster metrics; genotypes/scores -> association tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import codes as C
from cohortlab.operators import cohort as CH
from cohortlab.operators import outcomes as O
from cohortlab.plans.materialize import literal_table, materialized
from cohortlab.sources import roles as R

STUDY = CH.CohortConfig(window_start=R.INDEX_WINDOW[0], window_end=R.INDEX_WINDOW[1], least_age=40)


def case_code_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(c,) for c in R.CASE_GP_CODES + R.CASE_ICD_CODES], ["code"])


def icd_code_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(c,) for c in R.CASE_ICD_CODES], ["code"])


def harmonised_diagnoses(spark, sf_dir) -> DataFrame:
    return C.harmonise_events(R.diagnoses(spark, sf_dir))


def cohort_inputs(spark, sf_dir):
    return (R.demographics(spark, sf_dir), harmonised_diagnoses(spark, sf_dir),
            case_code_df(spark), R.patients(spark, sf_dir), R.deprivation(spark, sf_dir))


def candidates(spark, sf_dir, cfg: CH.CohortConfig = STUDY) -> DataFrame:
    """M4 before eligibility: linked patients with index event and IMD.

    Written once (co-partitioned on patid); both the cohort (a filter) and
    the attrition counts (one aggregate) are derived from it, so the patient
    joins and the diagnosis scans run once.
    """
    return materialized(spark, ("candidates", sf_dir, cfg),
                        lambda: CH.cohort_candidates(*cohort_inputs(spark, sf_dir), cfg=cfg), "patid")


def cohort(spark, sf_dir, cfg: CH.CohortConfig = STUDY) -> DataFrame:
    return materialized(spark, ("cohort", sf_dir, cfg),
                        lambda: CH.apply_eligibility(candidates(spark, sf_dir, cfg), cfg), "patid")


def attrition(spark, sf_dir, cfg: CH.CohortConfig = STUDY) -> DataFrame:
    return CH.attrition(candidates(spark, sf_dir, cfg), CH.eligibility_steps(cfg), start_name="linked_with_imd")


def outcomes(spark, sf_dir, years: int = R.FOLLOW_UP_YEARS) -> DataFrame:
    """Cohort with mortality and hospitalisation outcomes."""
    def build():
        mort = O.mortality_outcome(cohort(spark, sf_dir), years=years)
        return O.hospital_outcome(mort, R.admissions(spark, sf_dir), R.stays(spark, sf_dir),
                                  icd_code_df(spark))
    return materialized(spark, ("outcomes", sf_dir, years), build, "patid")


def labelled_outcomes(spark, sf_dir) -> DataFrame:
    """Outcomes joined to cluster labels (J10), relabelled by mortality."""
    def build():
        out = outcomes(spark, sf_dir).join(R.cluster_labels(spark, sf_dir), "patid", "inner")
        return O.relabel_by_outcome(out)
    return materialized(spark, ("labelled_outcomes", sf_dir), build, "patid")


def survival_by_cluster(spark, sf_dir, kind: str = "mortality") -> DataFrame:
    lo = labelled_outcomes(spark, sf_dir)
    if kind == "mortality":
        return O.kaplan_meier(lo, "time", "event", "label")
    return O.kaplan_meier(lo, "time_hos", "event_hos", "label")


# -- sequences -------------------------------------------------------------------

def sequences(spark, sf_dir, stage: str = "before") -> DataFrame:
    """M5 over the study cohort; 'after'/'all' include the follow-up end event."""
    from cohortlab.operators import sequences as SQ

    def build():
        coh = cohort(spark, sf_dir)
        ev = R.sequence_events(spark, sf_dir)
        if stage != "before":
            ev = ev.unionByName(SQ.followup_end_events(coh))
        return SQ.build_sequences(ev, coh, stage=stage)
    return materialized(spark, ("sequences", sf_dir, stage), build, "patid")


def sequences_with_practice(spark, sf_dir, stage: str = "before") -> DataFrame:
    """Cohort (patid, pracid) joined to its sequences."""
    def build():
        coh = cohort(spark, sf_dir).select("patid", "pracid")
        return coh.join(sequences(spark, sf_dir, stage), "patid", "inner")
    return materialized(spark, ("sequences_with_practice", sf_dir, stage), build, "patid")


def labelled_sequences(spark, sf_dir, stage: str = "before") -> DataFrame:
    """Sequences of cohort patients with their (relabelled) cluster."""
    lab = labelled_outcomes(spark, sf_dir).select("patid", "label")
    return sequences(spark, sf_dir, stage).join(lab, "patid", "inner")


# -- vectors and replicate labelings ---------------------------------------------------------

def class_center_list(spark, sf_dir):
    from cohortlab.operators.metrics import collect_centers
    return collect_centers(R.class_centers(spark, sf_dir))


def vector_partitions(spark, sf_dir) -> DataFrame:
    """Two labelings of the vectors: the given class (label) and the nearest
    class center (nearest)."""
    from cohortlab.operators.metrics import assign_nearest
    return assign_nearest(R.vectors(spark, sf_dir), class_center_list(spark, sf_dir))


def replicate_labels(spark, sf_dir, reps: int = 5, frac: float = 0.8, full: bool = False) -> DataFrame:
    """(rep, id, label) replicate labelings derived from the vectors.

    Replicate r subsamples ids with hash(id, 'pac<r>') < frac, takes per
    class the subsampled vector with the smallest hash(id, 'ctr<r>') as a
    center and labels by nearest center (its class).  ``full`` labels every
    vector (fit on the subsample, predict all), otherwise only the subsample.
    All replicates are handled together: one grouped job builds every
    replicate's centers (reps x classes rows, joined back as one array per
    replicate), one projection labels the rows.
    """
    from cohortlab.functions.hashing import portable_hash, unit_hash
    from cohortlab.functions.vectors import squared_distance
    v = R.vectors(spark, sf_dir)
    x = v.select("id", "label", "features", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    rep_s = F.col("rep").cast("string")
    sampled = unit_hash(F.col("id"), F.concat(F.lit("pac"), rep_s)) < F.lit(frac)
    x = x.withColumn("_in", sampled)
    cen = (x.where("_in").groupBy("rep", "label")
             .agg(F.min_by("features", portable_hash(F.col("id"), F.concat(F.lit("ctr"), rep_s))).alias("center"))
             .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("idx"), "center")))
                                 .alias("_c")))
    target = x if full else x.where("_in")
    # one row per replicate (bounded by reps): broadcast
    j = target.join(F.broadcast(cen), "rep")
    d = F.transform("_c", lambda c: squared_distance(F.col("features"), c["center"]))
    pos = F.array_position(d, F.array_min(d)).cast("int")
    return j.select("rep", "id", F.element_at("_c", pos)["idx"].cast("int").alias("label"))


def bootstrap_refit_labels(spark, sf_dir, reps: int = 3, frac: float = 0.8) -> DataFrame:
    """(rep, draw, id, label): with-replacement draws labelled by centers
    chosen from the drawn rows (per class, smallest hash(id, 'ctr<r>')),
    all replicates in one grouped job plus one projection."""
    from cohortlab.functions.hashing import portable_hash
    from cohortlab.functions.vectors import squared_distance
    from cohortlab.operators.splits import bootstrap_draws, dense_index
    v = R.vectors(spark, sf_dir)
    n = v.count()
    drawn = bootstrap_draws(dense_index(v, "id", "idx"), n, reps, frac, "boot").checkpoint(eager=True)
    rep_s = F.col("rep").cast("string")
    cen = (drawn.groupBy("rep", "label")
                .agg(F.min_by("features", portable_hash(F.col("id"), F.concat(F.lit("ctr"), rep_s))).alias("center"))
                .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("idx"), "center")))
                                    .alias("_c")))
    j = drawn.join(F.broadcast(cen), "rep")      # one row per replicate
    d = F.transform("_c", lambda c: squared_distance(F.col("features"), c["center"]))
    pos = F.array_position(d, F.array_min(d)).cast("int")
    return j.select("rep", "draw", "id", F.element_at("_c", pos)["idx"].cast("int").alias("label"))


# -- features and clustering -------------------------------------------------------------

def tfidf_split(spark, sf_dir, test_fold: int = 0, folds: int = 5):
    """Internal sequences split into train/test folds, vocabulary from the
    internal set, idf fitted on train; returns (train_x, test_x, external_x, vocab)."""
    from cohortlab.operators import features as FE
    from cohortlab.operators import sequences as SQ
    from cohortlab.operators import splits as SP
    seq = sequences_with_practice(spark, sf_dir)
    internal, external = SP.split_by_group(seq, "pracid", 0.8, "split")
    vocab = materialized(spark, ("vocab_internal", sf_dir),
                         lambda: SQ.vocabulary(SQ.sequence_tokens(internal)))
    internal = SP.kfold(internal, "patid", folds, "fold")
    toks = lambda df: SQ.sequence_tokens(df).where(F.col("code") != "SEP")
    tr = FE.term_counts(toks(internal.where(F.col("fold") != test_fold)), vocab)
    te = FE.term_counts(toks(internal.where(F.col("fold") == test_fold)), vocab)
    ex = FE.term_counts(toks(external), vocab)
    key = ("tfidf", sf_dir, test_fold, folds)
    idf = materialized(spark, key + ("idf",), lambda: FE.fit_idf(
        tr, vocab, internal.where(F.col("fold") != test_fold)))
    m = lambda name, df: materialized(spark, key + (name,), lambda: FE.tfidf(df, idf))
    return m("train", tr), m("test", te), m("external", ex), vocab, idf


def fixed_center_sweep(spark, sf_dir, ks=(2, 3, 4), folds: int = 3) -> DataFrame:
    """Deterministic (fold, k) metric rows without model fitting.

    Test labels: nearest of the first k global class centers; train centers:
    per class (< k) the smallest-id train vector.  Scores: prediction
    strength and silhouette of the test fold.
    """
    return materialized(spark, ("fixed_sweep", sf_dir, tuple(ks), folds),
                        lambda: _fixed_center_sweep(spark, sf_dir, ks, folds))


def _fixed_center_sweep(spark, sf_dir, ks, folds) -> DataFrame:
    """All (fold, k) cells in one keyed job per metric; the centers are one row per
    fold and one row of class centers (labels x folds vectors in all), broadcast."""
    from cohortlab.functions.vectors import squared_distance
    from cohortlab.operators import metrics as M
    from cohortlab.operators.splits import kfold
    v = kfold(R.vectors(spark, sf_dir), "id", folds, "fold")
    every = lambda values: F.explode(F.array(*[F.lit(x) for x in values]))
    least = v.groupBy("label", "fold").agg(F.min(F.struct("id", "features")).alias("m"))
    train = (least.withColumn("f", every(range(folds))).where(F.col("f") != F.col("fold"))
             .groupBy("f", "label").agg(F.min("m").alias("m"))
             .groupBy(F.col("f").alias("fold")).agg(F.sort_array(F.collect_list(
                 F.struct("label", F.col("m.features").alias("center")))).alias("_t")))
    classes = R.class_centers(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("idx", "center"))).alias("_g"))
    x = (v.select("id", "features", "fold", every(ks).alias("k"))
          .join(F.broadcast(train), "fold").crossJoin(F.broadcast(classes)))

    def nearest(centers):
        d = F.transform(centers, lambda c: squared_distance(F.col("features"), c["center"]))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    labelled = x.select("fold", "k", "id", "features", nearest(F.slice("_g", 1, F.col("k"))).alias("test_label"),
                        nearest(F.filter("_t", lambda c: c["label"] < F.col("k"))).alias("train_label")
                        ).checkpoint(eager=True)
    keys = ["fold", "k"]
    ps = (M.strength_from_assignment(labelled, "test_label", "train_label", keys)
          .groupBy(*keys).agg(F.coalesce(F.min("strength"), F.lit(float("inf"))).alias("prediction_strength")))
    sil = M.silhouette(labelled, "test_label", keys=keys)
    return ps.join(sil, keys, "left").select((F.col("fold") + 1).cast("int").alias("fold"), F.col("k").cast("int"),
                                             "prediction_strength", "silhouette")


# -- code lists ---------------------------------------------------------------------------------

def snomed_of(medcode: str) -> str:
    """Same value as the derived dictionary's Snomedcode column (portable hash)."""
    import hashlib
    return str(int(hashlib.md5(f"{medcode}:snomed".encode()).hexdigest()[:15], 16) % 1000000)


def code_list(spark) -> DataFrame:
    """Definition lists (system, name, code) against the derived dictionary."""
    rows = [("read", "case", "R91O"), ("snomed", "case", snomed_of("92P")),
            ("read", "fall", "R91P"), ("read", "fall", "R93O"), ("snomed", "memory", snomed_of("94P")),
            ("snomed", "memory", snomed_of("95O")), ("read", "sleep", "R99X")]
    return literal_table(spark, rows, ["system", "name", "code"])


def relabelled_sides(spark, sf_dir) -> DataFrame:
    """Internal and external outcome sets; the external set takes the
    internal set's mortality-ordered label map."""
    from cohortlab.operators import splits as SP
    out = outcomes(spark, sf_dir).join(R.cluster_labels(spark, sf_dir), "patid", "inner")
    internal, external = SP.split_by_group(out, "pracid", 0.8, "split")
    i2, e2 = O.relabel_by_outcome(internal, external)
    return (i2.withColumn("side", F.lit("internal"))
              .unionByName(e2.withColumn("side", F.lit("external"))))
