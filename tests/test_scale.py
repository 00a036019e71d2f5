"""What may grow with the tables and what may not: blocks of the SVD, memory of a pairwise tile."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import DataFrame

from cohortlab.operators import features as FE
from cohortlab.operators import metrics as M


def test_svd_blocks_in_tables_never_reach_the_driver(spark, monkeypatch):
    """Several parts of documents, text ids, a term in every document and terms of one document."""
    monkeypatch.setattr(FE, "MAX_DRIVER_NUMBERS", 0)
    monkeypatch.setattr(FE, "PART_CELLS", 150, raising=False)
    monkeypatch.setattr(FE, "BLOCKS", 3)
    monkeypatch.setattr(DataFrame, "toArrow", None)
    rng = np.random.default_rng(4)
    rows = [(f"d{d}", i * 7, float(rng.random())) for d in range(50) for i in range(20) if rng.random() < 0.4 or i == 0]
    rows += [(f"d{d}", 1000 + d, 0.5) for d in range(30)]
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(docs), len(terms)))
    for d, i, v in rows:
        x[docs.index(d), terms.index(i)] = v
    tables = {t.name for t in spark.catalog.listTables()}
    loads, sv = FE.svd_loadings(spark.createDataFrame(rows, "doc string, idx long, value double"), 0, 3, 3)
    v = np.zeros((len(terms), 3))
    for r in loads.collect():
        v[terms.index(r.idx), r.comp] = r.v
    s2 = np.array(sv) ** 2
    assert sv == pytest.approx(np.linalg.svd(x, compute_uv=False)[:3], rel=1e-9)
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-9)
    assert (np.linalg.norm(x.T @ x @ v - v * s2, axis=0) < 1e-6 * s2).all()
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_a_silhouette_tile_holds_few_pairs_at_a_time():
    """A whole tile of near copies: each distance is taken from differences, a few megabytes at a time."""
    rng = np.random.default_rng(1)
    ref = np.round(rng.normal(size=(1, 64)), 3) + 1e-7 * rng.normal(size=(M.TILE_ROWS, 64))
    query, weight = ref[:96] + 1e-6, rng.integers(1, 5, M.TILE_ROWS).astype(float)
    tracemalloc.start()
    got = M._distance_sums(ref, weight, query)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [np.sqrt(((q - ref) ** 2).sum(axis=1)) @ weight for q in query]
    assert got == pytest.approx(want, rel=1e-9) and peak < 40e6
