"""Invariants for model-based and randomised operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import clustering as CL
from cohortlab.operators import features as FE
from cohortlab.operators import metrics as M
from cohortlab.operators import splits as SP
from cohortlab.sources import roles as R


@pytest.fixture(scope="module")
def vecs(spark, sf_small):
    return R.vectors(spark, sf_small).cache()


def test_kfold_disjoint_and_complete(spark, sf_small):
    p = SP.kfold(R.patients(spark, sf_small), "patid", 5)
    assert p.select("fold").distinct().count() == 5
    assert p.count() == p.select("patid").distinct().count() == R.patients(spark, sf_small).count()


def test_split_no_practice_on_both_sides(spark, sf_small):
    internal, external = SP.split_by_group(R.patients(spark, sf_small), "pracid")
    a = {r.pracid for r in internal.select("pracid").distinct().collect()}
    b = {r.pracid for r in external.select("pracid").distinct().collect()}
    assert a and b and not (a & b)


def test_dense_index_contiguous(spark):
    df = spark.range(0, 300, 3).withColumnRenamed("id", "k")
    idx = SP.dense_index(df, "k").orderBy("k").collect()
    assert [r.idx for r in idx] == list(range(100))


def test_kmeans_labels_in_range_and_restarts(spark, vecs):
    m1 = CL.kmeans_fit(vecs, 3, restarts=1, max_iter=10, seed=5)
    m3 = CL.kmeans_fit(vecs, 3, restarts=3, max_iter=10, seed=5)
    assert m3.cost <= m1.cost + 1e-9
    labs = {r.label for r in CL.kmeans_predict(vecs, m3).select("label").distinct().collect()}
    assert labs <= {0, 1, 2}


def test_svd_loadings_orthonormal(spark):
    rng = np.random.default_rng(0)
    rows = [(d, i, float(rng.random())) for d in range(30) for i in range(12) if rng.random() < 0.5]
    x = spark.createDataFrame(rows, "doc int, idx long, value double")
    loads, sv = FE.svd_loadings(x, 12, 4)
    V = np.zeros((12, 4))
    for r in loads.collect():
        V[r.idx, r.comp] = r.v
    assert np.allclose(V.T @ V, np.eye(4), atol=1e-8)
    X = np.zeros((30, 12))
    for d, i, v in rows:
        X[d, i] = v
    assert np.allclose(sorted(sv, reverse=True), np.linalg.svd(X, compute_uv=False)[:4], atol=1e-8)


def test_gap_formula(spark):
    obs = spark.createDataFrame([(2, 10.0)], "k int, inertia double")
    ref = spark.createDataFrame([(0, 2, 20.0), (1, 2, 40.0)], "b int, k int, inertia double")
    r = CL.gap_from_inertia(obs, ref).first()
    logs = np.log([20.0, 40.0])
    assert r.gap == pytest.approx(logs.mean() - np.log(10.0))
    assert r.s_k == pytest.approx(logs.std(ddof=1) * np.sqrt(1 + 1 / 2))


def test_gap_uses_every_row(spark):
    """Two tight far groups: the fit on all rows leaves their inner spread, whatever the row count."""
    x = [(i, [float(i % 2) * 10 + (i % 5) * 0.1, float(i % 3) * 0.1]) for i in range(120)]
    df = spark.createDataFrame(x, "id long, features array<double>")
    gap = {r.k: r for r in CL.gap_statistic(df, [1, 2], B=2, restarts=1, max_iter=10).collect()}
    v = np.array([f for _, f in x])
    v = (v - v.min(0)) / (v.max(0) - v.min(0))
    side = np.arange(120) % 2
    inner = sum(((v[side == s] - v[side == s].mean(0)) ** 2).sum() for s in (0, 1))
    assert gap[1].log_w == pytest.approx(np.log(((v - v.mean(0)) ** 2).sum()), rel=1e-9)
    assert gap[2].log_w == pytest.approx(np.log(inner), rel=1e-9)
    assert gap[2].gap > gap[1].gap


def test_select_k_rules(spark):
    s = spark.createDataFrame([(2, 0.97, 0.1), (3, 0.96, 0.3), (4, 0.5, 0.2)],
                              "k int, prediction_strength double, silhouette double")
    assert CL.select_k(s, 0.95).first().best_k == 3
    assert CL.select_k(s, 0.99).first().best_k == 3       # fallback: best silhouette
    assert CL.select_k(s, 0.99, fallback=None).first().best_k is None


def test_ari_bounds_on_replicates(spark, sf_small):
    from cohortlab.plans import study
    rl = study.replicate_labels(spark, sf_small, reps=3, full=True)
    for r in M.replicate_pair_ari(rl).collect():
        assert -1.0 <= r.ari <= 1.0


def test_km_survival_non_increasing(spark, sf_small):
    from cohortlab.plans import study
    km = study.survival_by_cluster(spark, sf_small).orderBy("label", "time").collect()
    by = {}
    for r in km:
        by.setdefault(r.label, []).append(r.survival)
    for s in by.values():
        assert all(a >= b - 1e-12 for a, b in zip(s, s[1:]))


def test_randomized_svd_matches_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(d, i, float(rng.random())) for d in range(40) for i in range(25) if rng.random() < 0.4]
    x = spark.createDataFrame(rows, "doc int, idx long, value double")
    loads, sv = FE.randomized_svd_loadings(x, 25, 3, oversample=10, power_iters=5)
    X = np.zeros((40, 25))
    for d, i, v in rows:
        X[d, i] = v
    assert np.allclose(sv, np.linalg.svd(X, compute_uv=False)[:3], rtol=1e-4)
    V = np.zeros((25, 3))
    for r in loads.collect():
        V[r.idx, r.comp] = r.v
    assert np.allclose(V.T @ V, np.eye(3), atol=1e-6)


def test_trained_stability_ranges(spark, vecs):
    pac = CL.consensus_pac_fit(vecs, 3, reps=3, restarts=1, max_iter=5).first()
    assert 0.0 <= pac.pac <= 1.0
    ari = CL.bootstrap_ari_fit(vecs, 3, reps=2, restarts=1, max_iter=5).first()
    assert -1.0 <= ari.mean_ari <= 1.0 and ari.sd_ari >= 0.0
    jac = CL.bootstrap_jaccard_fit(vecs, 3, reps=2, restarts=1, max_iter=5).first()
    assert 0.0 <= jac.mean_jaccard <= 1.0
    same = CL.cross_source_ari_fit(vecs, vecs, 3, restarts=1, max_iter=5, seed=1).first()
    assert same.ari == pytest.approx(1.0)


def test_keyed_sweep_metrics_match_single_cell(spark, vecs):
    tr, te = vecs.where(F.col("id") % 3 != 0), vecs.where(F.col("id") % 3 == 0)
    ks = [2, 3]
    m_tr = {k: CL.kmeans_fit(tr, k, restarts=1, max_iter=5) for k in ks}
    m_te = {k: CL.kmeans_fit(te, k, restarts=1, max_iter=5) for k in ks}
    keyed = {r.k: r for r in CL.sweep_fold_metrics(CL.label_all_k(te, m_tr, m_te)).collect()}
    for k in ks:
        x = CL.kmeans_predict(CL.kmeans_predict(te, m_te[k], out="test_label"), m_tr[k], out="train_label")
        assert keyed[k].prediction_strength == pytest.approx(
            M.prediction_strength(x, "test_label", m_tr[k].centers).first()[0])
        assert keyed[k].silhouette == pytest.approx(M.silhouette(x, "train_label").first()[0])
        assert keyed[k].calinski_harabasz == pytest.approx(M.calinski_harabasz(x, "train_label").first()[0])
        assert keyed[k].davies_bouldin == pytest.approx(M.davies_bouldin(x, "train_label").first()[0])
