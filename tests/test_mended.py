"""Answers that were wrong once, as micro-tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import genetics as G
from cohortlab.operators import metrics as M
from cohortlab.sources import io


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, features array<double>")


def brute_silhouette(rows):
    x = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i, y == y[i]].sum() / (own - 1)
        b = min(d[i, y == c].mean() for c in set(y) if c != y[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return out


def test_silhouette_keeps_duplicates_of_two_clusters(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 2, [3.0, 3.0]), (3, 3, [3.0, 3.0]), (4, 0, [0.0, 0.0]),
            (5, 1, [0.0, 0.0]), (6, 4, [9.0, 9.0]), (7, 4, [9.0, 9.5])]
    got = {r.id: r.s for r in M.silhouette_points(points(spark, rows)).collect()}
    assert [got[i] for i in range(8)] == pytest.approx(brute_silhouette(rows))
    same = [(i, i % 2, [1.0, 2.0]) for i in range(6)]
    assert M.silhouette(points(spark, same)).first()[0] == 0.0


def test_silhouette_in_tiles_smaller_than_the_data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), [float(v) for v in rng.normal(i % 3, 1, 4)]) for i in range(120)]
    got = {r.id: r.s for r in M.silhouette_points(points(spark, rows), tile_rows=17).collect()}
    assert len(got) == 120
    assert [got[i] for i in range(120)] == pytest.approx(brute_silhouette(rows))


def test_pac_in_tiles_smaller_than_the_data(spark):
    rng = np.random.default_rng(5)
    rows = [(r, i, int(rng.integers(3))) for r in range(6) for i in range(60) if rng.random() < 0.8]
    reps = spark.createDataFrame(rows, "rep int, id long, label int")
    items = spark.range(60)
    whole, tiled = M.consensus_pac(reps, items).first(), M.consensus_pac(reps, items, tile_rows=7).first()
    assert whole == tiled and 0 < whole.pac < 1


def test_one_item(spark):
    one = spark.createDataFrame([(1, 0, 0)], "id long, a int, b int")
    assert M.adjusted_rand(one, "a", "b").first().ari == 1.0
    reps = spark.createDataFrame([(0, 1, 0)], "rep int, id long, label int")
    assert M.consensus_pac(reps, one.select("id")).first().pac == 0.0


def test_constant_trait_and_single_label(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "patid string, label int")
    scores = spark.createDataFrame([(p, "t", 5.0) for p in "abcd"], "patid string, trait string, score double")
    assert [r.t_stat for r in G.prs_pairwise(scores, labels).collect()] == [None]
    only = G.prs_one_vs_rest(scores, labels.filter("label = 1")).collect()
    assert [(r.n_other, r.t_stat, r.p_val) for r in only] == [(0, None, None)]


def test_one_vs_rest_does_not_cancel(spark):
    rng = np.random.default_rng(1)
    base = 1e8
    vals = {f"p{i}": base + float(v) for i, v in enumerate(rng.normal(0, 1e-2, 30))}
    labels = spark.createDataFrame([(p, i % 3) for i, p in enumerate(vals)], "patid string, label int")
    scores = spark.createDataFrame([(p, "t", v) for p, v in vals.items()], "patid string, trait string, score double")
    got = {r.cluster: r for r in G.prs_one_vs_rest(scores, labels).collect()}
    v = np.array(list(vals.values())) - base
    g, rest = v[::3], np.delete(v, np.arange(0, 30, 3))
    t = (g.mean() - rest.mean()) / np.sqrt(g.var(ddof=1) / len(g) + rest.var(ddof=1) / len(rest))
    name = sorted(got)[0]
    assert got[name].t_stat == pytest.approx(t, rel=1e-3)


def test_reuse_or_build_rejects_unfinished_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    io.reuse_or_build(spark, path, lambda: spark.range(100))
    (tmp_path / "t" / "_SUCCESS").unlink()
    parts = sorted((tmp_path / "t").glob("part-*"))
    parts[0].unlink()
    assert io.reuse_or_build(spark, path, lambda: spark.range(100)).count() == 100
    empty = tmp_path / "e"
    empty.mkdir()
    assert io.reuse_or_build(spark, str(empty), lambda: spark.range(3)).count() == 3
    assert io.reuse_or_build(spark, path, lambda: spark.range(5)).count() == 100      # kept, not built again


def test_draws_reach_every_row(spark):
    from cohortlab.functions.hashing import portable_hash
    h = spark.range(2000).select(portable_hash(F.col("id"), "x").alias("h")).agg(F.max("h"), F.min("h")).first()
    assert h[0] > 2 ** 59 and h[1] >= 0


def test_fisher_sums_both_tails():
    from math import comb
    from random import Random
    from cohortlab.functions.stats import hypergeometric_two_sided
    rnd = Random(1)
    tables = [[rnd.randint(0, m) for _ in range(4)] for m in (2, 5, 30, 120) for _ in range(200)]
    for a, b, c, d in tables + [[0, 0, 0, 0], [5, 0, 0, 5], [0, 7, 9, 0]]:
        r1, r2, c1 = a + b, c + d, a + c
        p = {x: comb(r1, x) * comb(r2, c1 - x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
        want = sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / comb(r1 + r2, c1)
        assert hypergeometric_two_sided(a, b, c, d) == pytest.approx(want, abs=1e-11)
    # margins of 10^8: only the terms that count are summed
    assert 0.5 < hypergeometric_two_sided(10**7, 9 * 10**7, 10**7 + 3000, 9 * 10**7) < 0.55


def test_parse_dosage_by_position(spark):
    lines = spark.createDataFrame([("FID IID SEX a b",), ("p1 p1 1 0 2",), ("",), ("  p2 p2 2 NA 1.5",)], "value string")
    got = {(r.patid, r.snp): r.dosage for r in io.parse_dosage(lines, "FID IID SEX a b").collect()}
    assert got == {("p1", "a"): 0.0, ("p1", "b"): 2.0, ("p2", "a"): None, ("p2", "b"): 1.5}
    assert {r.snp for r in io.parse_dosage(lines, "FID IID SEX a b", snps=["b"]).collect()} == {"b"}


def test_centroids_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, i % 3, [float(i % 3) * 5 + i / 10, float(i % 7)]) for i in range(30)]
    x = spark.createDataFrame(rows, "id long, label int, features array<double>")
    near = [f(x, "label").first()[0] for f in (M.within_dispersion, M.calinski_harabasz, M.davies_bouldin)]
    monkeypatch.setattr(M, "MAX_BROADCAST_NUMBERS", 0)
    assert [f(x, "label").first()[0] for f in (M.within_dispersion, M.calinski_harabasz, M.davies_bouldin)] == pytest.approx(near)
