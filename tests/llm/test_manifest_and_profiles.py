"""Operators 11, 12 and 13: brute force and edge cases."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import divergence, language_id, merkle
from cohortlab.llm._tables import documents, prepare
from cohortlab.llm.perfect_hash import PerfectHash, hash64


def some_rows(edge_rows, n=700):
    """Edge cases and ``n`` short documents over few sources; one tree is over 256 leaves."""
    langs = ["en", "en", "en", "de", None, "é"]
    return edge_rows + [(1000 + i * 7 % n, f"Alpha beta{'x' * (i % 3)} gämma {'delta ' * (i % 4)}{i % 11}É", langs[i % 6],
                         [None, "a", "b", "ü", "c"][i * i % 5]) for i in range(n)]


# -- 13: Merkle manifest --------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(level):
    """Root and the path of each leaf."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for p, i in enumerate(at):
            left, right = (level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else "")
            paths[p].append((left, right))
            at[p] = i // 2
        level = [digest(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        trees[lang].append((i is not None, i or 0, leaf(i, source, lang, n, text), (i, source, lang, n, text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {name: tree([x[2] for x in sorted(trees[name], key=lambda x: x[:3])]) for name in names}
    root, tops = tree([own[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for (_, _, h, (i, source, lang, n, text)), path in zip(sorted(trees[name], key=lambda x: x[:3]), own[name][1]):
            path = path + top
            tampered = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            node = leaf(i, source, lang, n + 1 if tampered else n, text)
            for left, right in path:
                node = digest(left, node, right)
            out.append((i, h, own[name][0], root, digest(*(a + b for a, b in path)), node, node == root))
    return out


def compared(rows):
    return sorted(map(tuple, rows), key=repr)


def five(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


def test_manifest(spark, make_docs, edge_rows):
    prepare(spark)
    docs = make_docs(some_rows(edge_rows)).repartition(5)
    got = merkle.verified_manifest(docs)
    want = brute_manifest(five(docs))
    assert compared(got.collect()) == compared(want)
    assert 0 < sum(not w[-1] for w in want) < len(want)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 33])
def test_manifest_of_one_tree(spark, make_docs, n):
    prepare(spark)
    docs = make_docs([(i, f"t{i}", "en", "a") for i in range(n)])
    got = merkle.verified_manifest(docs).collect()
    assert compared(got) == compared(brute_manifest(five(docs)))
    if n == 1:
        assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == digest("")


def test_manifest_keeps_general_outputs(spark, make_docs):
    """Trees by any column; the paths fold to the root."""
    prepare(spark)
    leaves = make_docs([(i, f"t{i}", "en", "ab"[i % 2]) for i in range(20)])
    proven = merkle.manifest(leaves.selectExpr("source AS tree", "sha2(text, 256) AS h", "text"), ["text"], ["text"])
    folded = proven.select("root", merkle.fold(proven["h"], proven["path"]).alias("again"), "tree", "idx", "text").collect()
    assert len(folded) == 20 and all(r.root == r.again for r in folded) and len({r.root for r in folded}) == 1
    assert [r.text for r in sorted(folded, key=lambda r: (r.tree, r.idx)) if r.tree == "a"] == sorted(f"t{i}" for i in range(0, 20, 2))


def test_no_rows(spark, make_docs):
    prepare(spark)
    empty = make_docs([])
    assert merkle.verified_manifest(empty).count() == 0
    assert divergence.source_divergence(empty).count() == 0
    assert language_id.predict_languages(empty).count() == 0


# -- 11: perfect hash and divergence ----------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), unique=True, max_size=300), st.lists(st.binary(min_size=1, max_size=12), max_size=40))
def test_perfect_hash_numbers_keys_and_rejects_others(keys, others):
    levels, order, kept = PerfectHash.build(keys)
    table = PerfectHash(levels, order, pa.array(kept, pa.binary()))
    assert table.slots(hash64(kept), pa.array(kept, pa.binary())).tolist() == list(range(len(keys))) and kept == sorted(keys)
    place = {k: i for i, k in enumerate(kept)}
    assert table.slots(hash64(others), pa.array(others, pa.binary())).tolist() == [place.get(k, -1) for k in others]


def test_perfect_hash_with_equal_hashes(monkeypatch):
    monkeypatch.setattr("cohortlab.llm.perfect_hash.hash64", lambda keys: np.array([len(k) for k in keys], np.uint64))
    keys = [b"aa", b"bb", b"cc", b"d"]
    table = PerfectHash(*PerfectHash.build(keys)[:2], pa.array(keys, pa.binary()))
    ask = [b"cc", b"d", b"ee", b"aa", b"x"]
    assert table.slots(np.array([2, 1, 2, 2, 1], np.uint64), pa.array(ask, pa.binary())).tolist() == [2, 3, -1, 0, -1]


def test_hash_is_sparks(spark):
    words = ["a", "éa", "longer term of more than thirty-two bytes", "日本語"]
    got = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w)").collect()]
    assert got == hash64([w.encode() for w in words]).tolist()


def test_term_lists_in_pieces(monkeypatch):
    text = "Ab1cd éF;xyz  q" * 50
    whole = [t for piece in divergence.term_lists(text.encode()) for t in piece]
    monkeypatch.setattr(divergence, "PIECE", 7)
    pieces = list(divergence.term_lists(text.encode()))
    assert len(pieces) > 20 and [t for piece in pieces for t in piece] == whole
    assert [t.decode() for t in whole] == TERM.findall(text.translate(LOWER))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_divergence(rows):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        frequency = Counter(t for _, _, terms in mine for t in set(terms))
        kept = [t for t, n in frequency.items() if n >= 10]
        counts = {s: Counter() for s in {r[1] for r in mine}}
        for _, source, terms in mine:
            counts[source].update(t for t in terms if frequency[t] >= 10)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            found = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items) if part == "pair" or i < 10]
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_terms": 2, "broadcast_bytes": 60, "tile_sources": 2}])
def test_divergence(spark, make_docs, edge_rows, limits):
    """Whole, and with many shards, several broadcasts and tiles of two sources."""
    prepare(spark)
    docs = make_docs(some_rows(edge_rows, 400))
    got = divergence.source_divergence(docs, **limits)
    assert compared(got.collect()) == compared(brute_divergence(five(docs)))


def test_divergence_when_tasks_send_sums_early(spark, make_docs, edge_rows):
    prepare(spark)
    rows = [(lang or "", source or "", text or "") for _, text, lang, source, _ in five(make_docs(some_rows(edge_rows, 300)))]
    batch = pa.record_batch({"lang": [r[0] for r in rows], "source": [r[1] for r in rows], "text": [r[2] for r in rows]})
    texts = spark.createDataFrame(rows, "lang string, source string, text string")
    shards = divergence.term_shards(divergence.kept_terms(texts, 10), 3)

    class Sent:
        value = [shards.toArrow()]

    def sums():
        total = Counter()
        for out in divergence.recount(Sent)(batch.slice(i, 20) for i in range(0, len(rows), 20)):
            for lang, source, shard, slot, n in zip(*(c.to_pylist() for c in out.columns)):
                total[lang, source, shard, slot] += n
        return total

    whole, entries, size = sums(), divergence.ENTRIES, divergence.DENSE_BYTES
    try:
        divergence.ENTRIES = divergence.DENSE_BYTES = 8
        assert sums() == whole and whole
    finally:
        divergence.ENTRIES, divergence.DENSE_BYTES = entries, size


def test_shares_stay_exact_in_64_bits():
    counts, total, terms = np.array([[89_999_999_999_999, 0, 7]]), np.array([90_000_000_000_000]), 3_000_000
    want = [1 + 10**9 * (c + 2) // (90_000_000_000_000 + 6_000_000) for c in counts[0].tolist()]
    assert divergence.shares(counts, total, terms)[0].tolist() == want


# -- 12: language profiles ---------------------------------------------------------------------


def brute_profile(words, size):
    grams = Counter()
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            grams.update(g for g in (w[i:i + n] for i in range(len(w) - n + 1)) if g != " ")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def words_of(text):
    return regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()) if regex.search(r"\p{L}", text or "") else []


def brute_languages(rows, size):
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    corpus = defaultdict(list)
    for out, (_, text, lang, *_) in zip(held, rows):
        if not out and lang is not None and words_of(text):
            corpus[lang] += words_of(text)
    profiles = {lang: {g: k for k, g in enumerate(brute_profile(w, size))} for lang, w in corpus.items()}
    result = []
    for out, (i, text, *_) in zip(held, rows):
        own = brute_profile(words_of(text), size)
        far = [(sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)), lang.encode()) for lang, p in profiles.items()]
        d, lang = min(far) if own and far else (0, b"und")
        result.append((i, out, lang.decode(), round(1 - d / (size * len(own)), 12) if own and far else 0.0))
    return result


@pytest.mark.parametrize("block_langs", [1024, 1])
def test_languages(spark, sf_dir, make_docs, edge_rows, block_langs):
    prepare(spark)
    real = [(r.doc_id + 100, r.text, r.lang, r.source) for r in documents(spark, sf_dir).limit(60).collect()]
    docs = make_docs(edge_rows + real + [(2001, "12 ?!", "en", "a"), (2002, "Ça", "fr", "a"), (2003, "наука и жизнь", "ru", "a"),
                                         (2004, "жизнь", None, "a"), (2005, "x", "", "a"), (2007, "été", "", "b")])
    size = 50
    texts = docs.select("doc_id", language_id.held_out(docs["doc_id"]).alias("held_out"), "lang",
                        language_id.normal_text(docs["text"]).alias("text"))
    profiles = language_id.learn_profiles(texts.filter("NOT held_out"), size)
    got = language_id.identify(texts.drop("lang"), profiles, size, block_langs)
    assert compared((r.doc_id, r.held_out, r.lang_pred, round(r.score, 12)) for r in got.collect()) == compared(brute_languages(five(docs), size))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " " + " ".join(f"wörd{i % 17}x" for i in range(300)) + " "
    codes, counts = language_id.text_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 30)
    again, more = language_id.text_counts(text)
    assert codes.tolist() == again.tolist() and counts.tolist() == more.tolist()


def test_held_out_languages(spark):
    """Nearly all documents that were not learnt from are told right."""
    prepare(spark)
    docs = documents(spark, "/root/testdata/sf0.01")
    got = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
