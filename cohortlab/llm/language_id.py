"""Language identification by rank-order profiles (operator 12).

A profile is the ``PROFILE`` most frequent character n-grams (1 to 3 characters) in
order of frequency.  A document's own profile is compared with each language's: the
out-of-place distance sums, over the document's n-grams, how far their places are
apart, ``PROFILE`` for an n-gram that the language's profile lacks.  The nearest
language is predicted; the score is 1 minus its distance over the largest possible one.

Texts are lower-cased, runs of characters that are neither letters nor marks are one
blank, and words have a blank on either side; n-grams do not reach over a blank within.
Equal frequencies are ordered by the n-gram's code points.

Scale: profiles count the n-grams of all learning documents, no sample; tasks send sums,
and at most ``PROFILE`` rows a task and language are ranked.  ``PROFILE`` rows a
language are broadcast, ``BLOCK_LANGS`` languages at a time: with more languages the
documents go through one pass for each block, which keeps the nearest language so far.
Scoring shuffles nothing.

Edge cases: documents with null language are not learnt from, the empty language is a
language; a null doc_id is not held out; null texts and texts without a letter are
``und`` with score 0 (so are all texts if nothing was learnt); equal distances go to the
language that is first in UTF-8 order; repeated rows are scored alike; very long texts
are counted in pieces; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm._tables import stage
from cohortlab.llm._words import text_slices

PROFILE = 400
BLOCK_LANGS = 1024
UNKNOWN = "und"
BLANK = 32
CHAR_BITS = 21                # three code points fit into 63 bits
PIECE = 1 << 21               # n-grams that are sorted at a time


def normal_text(text: Column) -> Column:
    """Lower-case words of letters and marks with single blanks around; null without a letter."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "), F.lit(" "))
    return F.when(text.rlike(r"\p{L}"), F.regexp_replace(words, "  +", " "))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# -- n-grams as numbers ----------------------------------------------------------------------


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a normal text, a piece at a time: one, two or three code points
    of 21 bits, so different n-grams have different codes."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for start in range(0, len(chars), PIECE // 3):
        c = chars[start:start + PIECE // 3 + 2].astype(np.int64)
        blank = c == BLANK
        n = min(PIECE // 3, len(chars) - start)
        two = (c[:-1] << CHAR_BITS) | c[1:]
        three = (two[:-1] << CHAR_BITS) | c[2:]
        yield np.concatenate([c[:n][~blank[:n]], two[:n], three[:n][~blank[1:-1][:n]]])


def counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often (with ``counts``: their sums)."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return codes[first], sums


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [counted(piece) for piece in grams(text)]
    return parts[0] if len(parts) == 1 else counted(*(np.concatenate(x) for x in zip(*parts)))


def profile_of(text: str, size: int) -> np.ndarray:
    """The codes of the text's most frequent n-grams, in order."""
    codes, counts = text_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


# -- learning --------------------------------------------------------------------------------


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) sums of the batches' texts."""
    held: dict[str, list[np.ndarray]] = defaultdict(list)

    def sums(lang: str) -> pa.RecordBatch:
        codes, n = counted(np.concatenate(held.pop(lang)))
        return pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes), "n": pa.array(n)})

    for batch in batches:
        for part in text_slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                for piece in grams(text):
                    held[lang].append(piece)
                    if sum(map(len, held[lang])) > 4 * PIECE:
                        yield sums(lang)
            if sum(len(p) for pieces in held.values() for p in pieces) > 8 * PIECE:
                for lang in list(held):
                    yield sums(lang)
    for lang in list(held):
        yield sums(lang)


def learn_profiles(texts: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) of every language's most frequent n-grams; ``texts`` has lang
    and the normal text."""
    known = texts.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = known.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < size).select("lang", "gram", "place")


# -- scoring ---------------------------------------------------------------------------------


class Profiles:
    """Places of the n-grams of some languages: ``places[i, j]`` of gram i in language j."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        langs, codes, places = (rows.column(c).to_pylist() for c in ("lang", "gram", "place"))
        self.size, self.langs = size, sorted(set(langs), key=lambda x: x.encode())
        self.codes = np.unique(np.array(codes, np.int64))
        self.places = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        column = {lang: j for j, lang in enumerate(self.langs)}
        self.places[np.searchsorted(self.codes, codes), [column[x] for x in langs]] = places

    def nearest(self, profile: np.ndarray) -> tuple[float, str]:
        """Least out-of-place distance over the largest possible one, and its language."""
        at = np.minimum(np.searchsorted(self.codes, profile), len(self.codes) - 1)
        mine = np.flatnonzero(self.codes[at] == profile)
        places = self.places[at[mine]]
        apart = np.where(places >= 0, np.abs(places - mine[:, None]), self.size).sum(axis=0)
        distance = apart + self.size * (len(profile) - len(mine))
        best = int(np.argmin(distance))
        return float(distance[best]) / (self.size * len(profile)), self.langs[best]


def scorer(sent, size: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(sent.value, size)
        for batch in batches:
            for part in text_slices(batch):
                far, lang = part.column("far").to_pylist(), part.column("lang_pred").to_pylist()
                for i, text in enumerate(part.column("text").to_pylist()):
                    if text is not None:
                        found = profiles.nearest(profile_of(text, size))
                        if lang[i] == UNKNOWN or (found[0], found[1].encode()) < (far[i], lang[i].encode()):
                            far[i], lang[i] = found
                yield pa.record_batch([pa.array(far, pa.float64()) if c == "far" else pa.array(lang, pa.string()) if c == "lang_pred"
                                       else part.column(c) for c in part.schema.names], part.schema.names)
    return score


def identify(texts: DataFrame, profiles: DataFrame, size: int = PROFILE, block_langs: int = BLOCK_LANGS) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to rows with a normal ``text``, which goes."""
    spark = texts.sparkSession
    blocks = -(-profiles.select("lang").distinct().count() // block_langs)
    out = texts.withColumns({"far": F.lit(1.0), "lang_pred": F.lit(UNKNOWN)})
    for b in range(blocks):
        rows = profiles.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            out = out.mapInArrow(scorer(spark.sparkContext.broadcast(rows), size), out.schema)
    return out.withColumn("score", 1 - F.col("far")).drop("text", "far")


def predict_languages(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the documents that are not held out."""
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", normal_text(F.col("text")).alias("text"))
    profiles = stage(learn_profiles(texts.filter("NOT held_out"), size), "language-profiles")
    return identify(texts.drop("lang"), profiles, size).select("doc_id", "held_out", "lang_pred", "score")
