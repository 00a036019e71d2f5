"""SVD spaces of hundreds of components: the query's 300, every way they are found, matrices of lower rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import features as FE
from cohortlab.plans import queries as Q
from cohortlab.plans import study as S

WAYS = {"driver": {}, "filtered": {"MAX_DRIVER_RANK": 0}, "blocks": {"MAX_DRIVER_RANK": 0, "MAX_BROADCAST_CELLS": 0},
        "tables": {"MAX_DRIVER_NUMBERS": 0, "MAX_BROADCAST_CELLS": 0}}


def sparse(docs, terms, seed=0):
    """Cells of random documents, one term in all of them, one cell in two rows; and the matrix."""
    rng = np.random.default_rng(seed)
    rows = [(d, 3 * i, float(rng.random()) + 0.1) for d in range(docs) for i in range(terms) if rng.random() < 0.1 or i == 0]
    rows.append((0, 0, 0.25))
    x = np.zeros((docs, terms))
    for d, i, v in rows:
        x[d, i // 3] += v
    return rows, x


def loadings(spark, rows, terms, k):
    loads, sv = FE.svd_loadings(spark.createDataFrame(rows, "doc int, idx long, value double"), 3 * terms, k)
    v = np.zeros((terms, len(sv)))
    for r in loads.collect():
        v[r.idx // 3, r.comp] = r.v
    return loads, np.array(sv), v


def set_limits(monkeypatch, way):
    for name, limit in WAYS[way].items():
        monkeypatch.setattr(FE, name, limit)


def test_svd_project_has_300_components(spark, monkeypatch):
    rows, x = sparse(340, 360)
    unseen = [(r[0], r[1] + 1, r[2]) for r in rows[:5]]
    train = spark.createDataFrame([r for r in rows if r[0] >= 20], "doc int, idx long, value double")
    test = spark.createDataFrame([r for r in rows if r[0] < 20] + unseen, "doc int, idx long, value double")
    vocab = spark.range(0, 1080, 3).select(F.col("id").alias("idx"))
    monkeypatch.setattr(S, "tfidf_split", lambda *a: (train, test, test, vocab, None))
    got = {r.doc: (r.dims, r.norm) for r in Q.QUERIES["svd_project"](spark, "").collect()}
    v = np.linalg.svd(x[20:])[2][:300].T
    want = np.linalg.norm(x[:20] @ v, axis=1)
    assert {d: n for d, (n, _) in got.items()} == dict.fromkeys(range(20), 300)
    assert [got[d][1] for d in range(20)] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("way", WAYS)
def test_many_components_are_exact(spark, monkeypatch, way):
    set_limits(monkeypatch, way)
    monkeypatch.setattr(FE, "SLICE_NUMBERS", 5000)         # several runs of terms, the last one short
    tables = {t.name for t in spark.catalog.listTables()}
    rows, x = sparse(180, 220)
    _, sv, v = loadings(spark, rows, 220, 80)
    s2 = sv ** 2
    assert sv == pytest.approx(np.linalg.svd(x, compute_uv=False)[:80], rel=1e-9)
    assert np.allclose(v.T @ v, np.eye(80), atol=1e-8)
    assert (np.linalg.norm(x.T @ x @ v - v * s2, axis=0) < 1e-6 * s2).all()
    assert {t.name for t in spark.catalog.listTables()} == tables


@pytest.mark.parametrize("way", WAYS)
def test_components_that_do_not_exist_are_left_out(spark, monkeypatch, way):
    """40 documents, 10 of them twice: 40 components whatever is asked for."""
    set_limits(monkeypatch, way)
    rows, x = sparse(40, 120, seed=1)
    rows, x = rows + [(d + 100, i, v) for d, i, v in rows if d < 10], np.vstack([x, x[:10]])
    _, sv, v = loadings(spark, rows, 120, 90)
    assert sv == pytest.approx(np.linalg.svd(x, compute_uv=False)[:40], rel=1e-9)
    assert np.allclose(v @ v.T @ x.T, x.T, atol=1e-6)


def test_vectors_that_cannot_be_told_apart_are_not_filtered(spark, monkeypatch):
    """More documents and terms than vectors, but a lower rank: the filter gives way to the blocks."""
    monkeypatch.setattr(FE, "MAX_DRIVER_RANK", 0)
    rows, x = sparse(50, 160, seed=2)
    rows, x = [(d + 50 * c, i, v) for c in range(4) for d, i, v in rows], np.vstack([x] * 4)
    _, sv, v = loadings(spark, rows, 160, 90)
    assert sv == pytest.approx(np.linalg.svd(x, compute_uv=False)[:50], rel=1e-9)
    assert np.allclose(v @ v.T @ x.T, x.T, atol=1e-6)


def test_projection_by_parts(spark, monkeypatch):
    """Text and null ids, repeated cells, unseen terms, documents of unseen terms only; several parts."""
    monkeypatch.setattr(FE, "PART_NUMBERS", 5000)
    rows, x = sparse(60, 90, seed=3)
    v = np.random.default_rng(4).normal(size=(90, 70))
    v[5, 3:] = 0.0
    loads = spark.createDataFrame([(3 * i, c, float(v[i, c])) for i in range(90) for c in range(70) if v[i, c] and i != 7], "idx long, comp int, v double")
    v[7] = 0.0
    cells = [(f"d{d}" if d else None, i, value) for d, i, value in rows] + [("new", 1, 1.0), ("d1", 4, 1.0)]
    got = {r.doc: r.features for r in FE.project(spark.createDataFrame(cells, "doc string, idx long, value double"), loads, 70).collect()}
    assert set(got) == {None, *(f"d{d}" for d in range(1, 60))}
    assert np.allclose([got[f"d{d}" if d else None] for d in range(60)], x @ v, atol=1e-10)
