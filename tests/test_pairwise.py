"""Silhouettes, consensus, replicate agreement and weighted resamples against brute force."""
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions.assignment import best_assignment
from cohortlab.operators import clustering as CL
from cohortlab.operators import metrics as M
from cohortlab.operators import splits as SP
from test_mended import brute_silhouette, points


def clouds(n, seed=3, spread=1.0, copies=1):
    rng = np.random.default_rng(seed)
    base = [[float(v) for v in rng.normal(4 * (i % 4), spread, 3)] for i in range(n)]
    return [(c * n + i, i % 4, base[i]) for c in range(copies) for i in range(n)]


@pytest.mark.parametrize("rows", [clouds(90), clouds(40, spread=0.2, copies=5), clouds(60, spread=9.0)],
                         ids=["apart", "copies", "mixed"])
@pytest.mark.parametrize("tile_rows", [8192, 7])
def test_silhouette_with_skipped_clusters_and_copies(spark, rows, tile_rows):
    x = points(spark, rows)
    got = {r.id: r.s for r in M.silhouette_points(x, tile_rows=tile_rows).collect()}
    want = brute_silhouette(rows)
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)
    assert M.silhouette(x, tile_rows=tile_rows).first()[0] == pytest.approx(np.mean(want), abs=1e-9)


def test_silhouette_of_many_equal_vectors_is_one_row_each(spark):
    """1,500 copies of two vectors: the tiles see four rows."""
    x = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("label"),
                                 F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.col("id") % 4 * 2 + i).cast("double")).alias("features"))
    rows = [(r.id, r.label, r.features) for r in x.limit(400).collect()]
    assert M.silhouette(x.limit(400)).first()[0] == pytest.approx(np.mean(brute_silhouette(rows)), abs=1e-9)
    assert M._distinct_silhouettes(x, "label", "features", [], 8192).count() == 4


def test_silhouette_keyed_and_one_label(spark):
    rows = clouds(40)
    x = points(spark, rows).withColumn("k", F.lit(1)).unionByName(points(spark, [(i, 0, v) for i, _, v in rows]).withColumn("k", F.lit(2)))
    got = {r.k: r.silhouette for r in M.silhouette(x, keys=["k"]).collect()}
    assert got[1] == pytest.approx(np.mean(brute_silhouette(rows))) and got[2] is None
    got = {r.k: r.silhouette_squared for r in M.silhouette_squared(x, keys=["k"]).collect()}
    assert got[1] is not None and got[2] is None


def test_silhouette_squared(spark):
    rows = clouds(50, spread=3.0) + [(500, 9, [1e4, 0.0, 0.0])]
    v, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d, out = ((v[:, None] - v[None]) ** 2).sum(-1), []
    for i in range(len(v)):
        own = y == y[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    assert M.silhouette_squared(points(spark, rows)).first()[0] == pytest.approx(np.mean(out), abs=1e-9)


def brute_pac(labels, low=0.1, high=0.9):
    """labels: per item {rep: label}."""
    amb = co = 0
    for i, a in enumerate(labels):
        for j, b in enumerate(labels):
            both = a.keys() & b.keys()
            if i != j and both:
                co += 1
                amb += low < sum(a[r] == b[r] for r in both) / len(both) < high
    return amb, co


@pytest.mark.parametrize("tile_rows", [8192, 5])
def test_consensus_of_ten_copies_of_each_item(spark, tile_rows):
    rng = np.random.default_rng(5)
    base = [{r: int(rng.integers(3)) for r in range(6) if rng.random() < 0.8} for _ in range(17)] + [{}]
    labels = [base[i % len(base)] for i in range(10 * len(base))]
    reps = spark.createDataFrame([(r, i, v) for i, own in enumerate(labels) for r, v in own.items()], "rep int, id long, label int")
    got = M.consensus_pac(reps, spark.range(len(labels)), tile_rows=tile_rows).first()
    assert (got.ambiguous, got.cosampled) == brute_pac(labels) and got.n == len(labels)
    assert M.signatures(reps, items=spark.range(len(labels))).count() <= len(base)


def test_replicate_contingencies_need_no_join(spark):
    rng = np.random.default_rng(2)
    rows = [(r, i, "abc"[int(rng.integers(3))]) for r in range(5) for i in range(80) if rng.random() < 0.9]
    reps = spark.createDataFrame(rows, "rep int, id long, label string")
    cells = M.pair_counts(M.signatures(reps))
    own = {}
    for r, i, v in rows:
        own.setdefault(i, {})[r] = v
    want = {}
    for labels in own.values():
        for r in labels:
            for s in labels:
                if r < s:
                    key = (r, s, labels[r], labels[s])
                    want[key] = want.get(key, 0) + 1
    assert {tuple(c)[:4]: c.n_ab for c in cells.collect()} == want
    assert "Join" not in cells._jdf.queryExecution().toString()


def test_best_assignment():
    rng = np.random.default_rng(0)
    for t in range(150):
        r = int(rng.integers(1, 5))
        m = rng.integers(0, [2, 10, 1000][t % 3], (r, int(rng.integers(r, 6)))).astype(float)
        got = best_assignment(m)
        assert len(set(got)) == r
        assert sum(m[i, j] for i, j in enumerate(got)) == max(sum(m[i, p[i]] for i in range(r)) for p in permutations(range(m.shape[1]), r))


def test_best_mapping(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), "xyzwv"[int((a + (rng.random() < 0.3)) % 5)]) for a in rng.integers(0, 3, 300)] + [(None, "x"), (1, None)]
    for cols in (("a", "b"), ("b", "a")):
        df = spark.createDataFrame(rows, "a int, b string")
        got = M.best_mapping(df, *cols).collect()
        assert got[0].asDict().keys() == {*cols, "n_ab"} and len(got) == 3
        m = np.array([[sum(x == (a, b) for x in rows) for b in "xyzwv"] for a in range(3)])
        best = max(sum(m[i, p[i]] for i in range(3)) for p in permutations(range(5), 3))
        assert sum(r.n_ab for r in got) == best
        assert M.best_mapping_accuracy(df, *cols) == pytest.approx(best / 300)
    assert np.isnan(M.best_mapping_accuracy(df.limit(0), "a", "b")) and M.best_mapping(df.limit(0), "a", "b").count() == 0


# -- resamples as weights -----------------------------------------------------------------------

def test_resample_counts_are_the_draws(spark):
    df = spark.range(5, 45).withColumnRenamed("id", "key")
    counts = {r.key: r.weights for r in SP.resample_counts(df, 3, 0.8, "key", "s").collect()}
    draws = SP.bootstrap_draws(SP.dense_index(df, "key", "idx"), 40, 3, 0.8, "s").collect()
    for key, weights in counts.items():
        assert weights == [sum(d.key == key and d.rep == r for d in draws) for r in range(3)]
    assert sum(map(sum, counts.values())) == 3 * 32


def test_weighted_fit_equals_the_fit_of_copies(spark):
    rows = [(i, [float(10 * (i % 3)) + 0.1 * (i % 7), float(i % 2)], [i % 4, (i * 3) % 5]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, features array<double>, weights array<int>")
    for r, model in enumerate(CL.kmeans_fits_weighted(df, 3, 2, restarts=3)):
        copies = df.select(F.explode(F.array_repeat("features", F.col("weights")[r])).alias("features"))
        want = CL.kmeans_fit(copies, 3, restarts=3)
        assert np.allclose(sorted(model.centers), sorted(want.centers), atol=1e-9)
        assert model.cost == pytest.approx(want.cost, abs=1e-6)
    one, all_rows = CL.kmeans_fits_weighted(df, 1, 1)[0], [v for _, v, w in rows for _ in range(w[0])]
    assert one.centers[0] == pytest.approx(np.mean(all_rows, axis=0))
    assert one.cost == pytest.approx(((np.array(all_rows) - np.mean(all_rows, axis=0)) ** 2).sum())


def test_resampled_fits_agree_with_labels_of_copies(spark):
    """Three far groups: every refit finds them, so every agreement is 1 and nothing is ambiguous."""
    df = spark.createDataFrame([(i, [10.0 * (i % 3) + 0.01 * (i % 5), 0.0]) for i in range(90)], "id long, features array<double>")
    assert CL.bootstrap_ari_fit(df, 3, reps=3).first().mean_ari == pytest.approx(1.0)
    assert CL.bootstrap_jaccard_fit(df, 3, reps=3).first().mean_jaccard == pytest.approx(1.0)
    pac = CL.consensus_pac_fit(df, 3, reps=4).first()
    assert pac.pac == 0.0 and pac.n == 90 and pac.cosampled > 0


def test_sweep_of_all_folds_with_the_linear_silhouette(spark):
    df = points(spark, clouds(120, spread=0.3)).drop("label")
    got = CL.k_sweep(df, [2, 4], folds=2, restarts=2, max_iter=10, squared=True)
    assert got.columns[2] == "silhouette_squared"
    rows = {(r.fold, r.k): r for r in got.collect()}
    assert set(rows) == {(f, k) for f in (1, 2) for k in (2, 4)}
    assert all(rows[f, 4].silhouette_squared > rows[f, 2].silhouette_squared for f in (1, 2))
    best = CL.select_k(CL.summarise_sweep(got), 2.0, "silhouette_squared").first()
    assert best.best_k == 4 and best.rule == "silhouette_squared"
