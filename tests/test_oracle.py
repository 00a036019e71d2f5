"""Every registered query against its DuckDB twin (sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = QUERIES[name](spark, sf_small)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    res = con.sql(ORACLE[name])
    drows = [dict(zip(res.columns, r)) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(res.columns)
    assert len(srows) == len(drows)
    nbad, ex = compare(srows, drows, sorted(sdf.columns))
    assert nbad == 0, ex


def test_every_query_has_oracle_or_is_model_based():
    from cohortlab.plans.queries import QUERIES as OWN
    rows_only = set(OWN) - set(ORACLE)
    assert rows_only == {"svd_project", "kmeans_labels", "k_sweep", "gap_statistic",
                         "consensus_pac_fit", "bootstrap_ari_fit", "bootstrap_jaccard_fit", "cross_source_ari_fit"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"label", "time", "survival"} <= set(df.columns)
