import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, node string, kind string"


@pytest.fixture()
def make_docs(spark):
    """Documents with extra columns whose names the operators use inside."""
    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "x", "y", "z") for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture()
def edge_rows():
    """Nulls in any column, empty and blank texts, one very long text, ties, repeated rows."""
    long = " ".join(f"w{i % 997} v{i % 1013}" for i in range(60_000))
    return [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b", None, None), (None, "one two three", "de", "b"),
            (4, long, "en", "a"), (5, "same text in two rows here", "en", "b"), (5, "same text in two rows here", "en", "b"),
            (6, "same text in two rows here", None, None), (None, None, None, None), (7, "x" * 50_000, "fr", "c")]
