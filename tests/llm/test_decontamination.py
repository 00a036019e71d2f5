"""Seeds of the decontamination find every leak on a line; repeated words stay cheap."""
import time
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pytest

from cohortlab.llm import decontamination as D
from cohortlab.llm._tables import prepare


@pytest.mark.parametrize("need", [5, 6, 7, 8, 12, 25])
def test_masks_hit_every_run(need):
    """All runs of up to 20 words that match three quarters of themselves, by enumeration."""
    masks = D.covering_masks(need, 0.75)
    for n in range(max(need, 5), 21):
        for lost in combinations(range(n), n - ceil(0.75 * n)):
            run = np.ones(n, bool)
            run[list(lost)] = False
            if run.sum() >= need:
                assert any(run[at + np.array(m)].all() for m in masks for at in range(n - m[-1])), (n, lost)


CELLS = [(10, 2), (10, 3), (11, 2), (11, 3), (12, 3), (13, 3), (14, 3), (14, 4), (15, 3), (15, 4), (17, 4), (17, 5),
         (20, 5), (25, 5), (30, 6), (38, 9), (40, 8), (59, 14)]


@pytest.mark.parametrize("n, changed", CELLS)
def test_every_replaced_copy_that_is_a_leak_is_found(n, changed):
    rng, leaks = np.random.default_rng(n * 100 + changed), 0
    for _ in range(120):
        item = [f"w{i}" for i in range(n)]
        copy = list(item)
        for i in rng.choice(n, changed, replace=False):
            copy[i] = f"x{i}"
        equal = np.array([a == b for a, b in zip(item, copy)])
        total = np.concatenate(([0], np.cumsum(equal)))
        want = any(total[e] - total[b] >= max(min(0.7 * n, 25), 0.75 * (e - b)) for b in range(n) for e in range(b + 1, n + 1))
        index = D.SeedIndex([1], [" ".join(item)])
        got = index.leaks(*D.normal_words(pa.array(["so " + " ".join(copy) + " so"])), 0.7, 25, 0.75)
        assert bool(got) == want
        leaks += want
    assert leaks


def test_repeated_words_and_bounded_hits(monkeypatch):
    """A long text of one word against an item of that word: the first whole match is reported."""
    index = D.SeedIndex([1, 2], ["a " * 100, "a b c d e f g h i j k l"])
    text = "z " + "a " * 20_000 + "b c d x f g h i j k l"
    whole = None
    for hits in (D.HITS, 1000):
        monkeypatch.setattr(D, "HITS", hits)
        began = time.time()
        got = sorted(index.leaks(*D.normal_words(pa.array([text, None, ""])), 0.7, 25, 0.75))
        assert time.time() - began < 20
        assert whole is None or got == whole
        whole = got
    assert whole == [(0, 1, 1, 101, 0, 100, 100), (0, 2, 20_000, 20_012, 0, 11, 12)]


def test_chunks_one_after_the_other(spark, make_docs):
    prepare(spark)
    items = [(i, " ".join(f"item{i}w{k}" for k in range(12))) for i in range(30)] + [(30, None), (3, " ".join(f"item3w{k}" for k in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(100 + i, f"start {t} end", "en", "a") for i, t in items[:30:3]] + [(1, "nothing here of any item at all", "en", "a")])
    whole = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    assert len(whole) == 11 and sorted(map(tuple, D.find_leaks(docs, bench, chunk_chars=300).collect())) == whole
    assert [r.doc_id for r in D.without_leaks(docs, bench, chunk_chars=300).collect()] == [1]
    assert D.find_leaks(docs, bench.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), bench).count() == 0
