"""Benchmark decontamination by spaced seeds (operator 3).

Fixed masks pick some of the words in a window and ignore the others, so a
window still hashes alike after substitutions at ignored places.  Hashes of
all masked windows of the benchmark are looked up for every window of the
documents; each hit fixes how item and document line up, and the whole
overlap on that line is compared word by word.  It is a leak if any run of it
matches ``min(0.7 * item words, 25)`` words and three quarters of its own
length.  Reported is the best run (a match counts 1, a mismatch -2) if it is
such a run, else the longest of them (see ``longest_run``).

Words are compared lower-cased and without punctuation at their ends.  The masks
follow from the words that an item must match, by one rule for all lengths
(``covering_masks``): every pattern of substitutions that is a leak has a hit, so no
leak on a line is missed for want of a seed.  Items that must match fewer than five words
(items of five words) are looked up by their whole length; items of fewer than
``MIN_ITEM`` words are too short to tell and are not searched.  An inserted or
deleted word ends a line; what stands on either side of it is a run of its own.

Scale: one pass over the documents, nothing shuffled.  The benchmark is the
query set.  Its index is broadcast in place of a join, one chunk of at most
``chunk_chars`` characters (counted before; at most 24 bytes of index a character) at a
time: with more than one chunk, the pass over the documents is written before the next
chunk is read.  Texts are cut into windows inside Arrow batches of a few MB; hits are
taken a bounded number at a time, and of the lines of a text and item only those that
could beat the best so far are compared run by run, so a text and an item of one
repeated word cost their product in numpy only.

Edge cases: null and empty texts have no windows and no leaks; null items
likewise; equal items are each reported; of several alignments of one item in
one document the longest match is reported, then the first; repeated document
rows are reported once each; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._tables import stage
from cohortlab.llm._words import hash_words, split_words, text_slices, windows

MIN_ITEM = 5
CHUNK_CHARS = 4 << 20
HITS = 1 << 20                # seed hits that are lined up at a time
PUNCTUATION = string.punctuation + "«»“”„‘’…–—¿¡"
SCHEMA = ("doc_id long, item_id long, start_word long, end_word long, item_start long, matched long, "
          "item_words long")


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the compared words of each text."""
    offsets, flat = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    hashes = hash_words(flat, lambda w: w.strip(PUNCTUATION))
    keep = hashes != 0
    if not keep.all():
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        hashes = hashes[keep]
    return offsets, hashes


def longest_run(equal: np.ndarray, same: float) -> tuple[int, int]:
    """The run [begin, end) with the most matches among those that match at least
    ``same`` of their length; of equal ones the first end, then the last begin."""
    total = np.concatenate(([0], np.cumsum(equal)))
    spare = total - same * np.arange(len(total))             # a run will do if this does not fall over it
    least = np.minimum.accumulate(spare)
    begin = np.searchsorted(-least, -(spare + 1e-9))         # the first start that will do for each end
    end = int(np.argmax(total - total[begin]))
    start = int(begin[end])
    return start + int(np.argmax(equal[start:end])) if end > start else start, end


@cache
def covering_masks(need: int, same: float) -> tuple[tuple[int, ...], ...]:
    """Places that each mask takes, for items that must match ``need`` words (5 at least).

    Masks take four words, three where fewer than seven must match.  They are chosen one
    by one, each time the mask that hits most of the runs not hit yet, among all runs of
    matches and mismatches of ``least`` to 2 ``least`` - 1 words that match ``same`` of their
    words, where ``least`` is 5 or 7; a longer run has a half that is again such a run.
    """
    weight, least = (3, 5) if need < 7 else (4, 7)
    runs = []
    for n in range(least, 2 * least):
        lost = n - ceil(same * n - 1e-9)      # runs with fewer mismatches are hit where these are
        runs += [(n, (1 << n) - 1 - sum(1 << i for i in c)) for c in combinations(range(n), lost)]
    masks = [(0, *mid, end) for end in range(weight - 1, least) for mid in combinations(range(1, end), weight - 2)]
    bits = {m: sum(1 << i for i in m) for m in masks}
    hit = lambda m, n, run: any(run >> at & bits[m] == bits[m] for at in range(n - m[-1]))
    chosen: list[tuple[int, ...]] = []
    while runs:
        best = max(masks, key=lambda m: sum(hit(m, n, run) for n, run in runs))
        left = [(n, run) for n, run in runs if not hit(best, n, run)]
        if len(left) == len(runs):
            raise ValueError(f"no masks of {weight} words find every run that matches {same} of its words")
        chosen.append(best)
        runs = left
    return tuple(chosen)


class SeedIndex:
    """Masked window hashes of benchmark items, with a bit table in front."""

    def __init__(self, item_ids: list, texts: list, share: float = 0.7, enough: int = 25, same: float = 0.75):
        self.ids = item_ids
        self.offsets, self.words = normal_words(pa.array(texts, pa.string()))
        self.share, self.enough, self.same = share, enough, same
        seeds: dict[tuple[int, ...], list[int]] = {}              # mask -> items that it is for
        for j, n in enumerate(np.diff(self.offsets).tolist()):
            need = ceil(min(share * n, enough) - 1e-9)
            if n >= MIN_ITEM:
                for mask in covering_masks(need, same) if n > MIN_ITEM and need >= 5 else [tuple(range(n))]:
                    seeds.setdefault(mask, []).append(j)
        self.seeds = list(seeds)
        keys, items, places = [], [], []
        for k, (seed, of) in enumerate(seeds.items()):
            for j in of:
                h = windows(self.words[self.offsets[j]:self.offsets[j + 1]], seed) ^ np.uint64(k)
                keys.append(h)
                items.append(np.full(len(h), j, np.int32))
                places.append(np.arange(len(h), dtype=np.int32))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.items = np.concatenate(items)[order] if items else np.zeros(0, np.int32)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int32)
        bits = max(16, int(16 * len(self.keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys >> self.shift] = True

    def hit_chunks(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """(item, window start, place in the item) rows of all seed hits, about ``HITS`` at a time."""
        for k, seed in enumerate(self.seeds):
            h = windows(words, seed) ^ np.uint64(k)
            at = np.flatnonzero(self.table[h >> self.shift])
            lo = np.searchsorted(self.keys, h[at], "left")
            n = np.searchsorted(self.keys, h[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            total = np.cumsum(n)
            cuts = np.searchsorted(total, np.arange(HITS, total[-1] if len(total) else 0, HITS))
            for part in np.split(np.arange(len(at)), np.unique(cuts)):
                if len(part):
                    size = n[part]
                    take = np.repeat(lo[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    yield np.stack([self.items[take], np.repeat(at[part], size), self.places[take]], 1)

    def hits(self, words: np.ndarray) -> np.ndarray:
        found = list(self.hit_chunks(words))
        return np.concatenate(found) if found else np.zeros((0, 3), int)

    def lines(self, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Distinct (text, item, shift): how texts and items line up where a seed hits."""
        found = []
        for hits in self.hit_chunks(words):
            doc = np.searchsorted(offsets, hits[:, 1], "right") - 1
            found.append(np.unique(np.stack([doc, hits[:, 0], hits[:, 1] - offsets[doc] - hits[:, 2]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), int)

    def matched_words(self, offsets: np.ndarray, words: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line: the words that match on the whole overlap, and where in the text the first does."""
        doc, item, shift = lines.T
        size, length = np.diff(self.offsets)[item], np.diff(offsets)[doc]
        lo, hi = np.maximum(0, -shift), np.minimum(size, length - shift)
        matches, first = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
        ends = np.cumsum(hi - lo)
        for part in np.split(np.arange(len(lines)), np.unique(np.searchsorted(ends, np.arange(HITS, ends[-1], HITS)))):
            if len(part):
                n = (hi - lo)[part]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)
                equal = (self.words[np.repeat(self.offsets[item[part]], n) + inside]
                         == words[np.repeat(offsets[doc[part]] + shift[part], n) + inside])
                starts = np.cumsum(n) - n
                matches[part] = np.add.reduceat(equal, starts, dtype=np.int64)
                place = np.where(equal, inside, np.iinfo(np.int64).max)
                first[part] = np.minimum.reduceat(place, starts) + shift[part]
        return matches, first

    def leaks(self, offsets: np.ndarray, words: np.ndarray, share: float, enough: int,
              same: float) -> list[tuple]:
        """(text, item id, start, end, item start, matched, item words) of all texts."""
        lines = self.lines(offsets, words)
        # windows that run over the end of their text are no hits; a line sees only the text
        sizes, lengths = np.diff(self.offsets)[lines[:, 1]], np.diff(offsets)[lines[:, 0]]
        lines = lines[(np.minimum(sizes, lengths - lines[:, 2]) > np.maximum(0, -lines[:, 2]))]
        if not len(lines):
            return []
        total, first = self.matched_words(offsets, words, lines)
        could = total >= np.minimum(share * np.diff(self.offsets)[lines[:, 1]], enough)
        lines, total, first = lines[could], total[could], first[could]
        best: dict[tuple[int, int], tuple] = {}
        # most matches first, then the earliest: a line whose matches are fewer than the best run
        # found so far, or as many and later, cannot beat it
        for at in np.lexsort((first, -total)).tolist():
            d, j, shift = lines[at].tolist()
            known = best.get((d, j))
            if known and (total[at], -first[at]) <= known[:2]:
                continue
            text = words[offsets[d]:offsets[d + 1]]
            item = self.words[self.offsets[j]:self.offsets[j + 1]]
            lo, hi = max(0, -shift), min(len(item), len(text) - shift)
            equal = item[lo:hi] == text[lo + shift:hi + shift]
            gained = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
            gain = gained - np.minimum.accumulate(gained)
            end = int(np.argmax(gain))
            begin = int(np.argmin(gained[:end + 1]))
            matched = int(equal[begin:end].sum())
            if matched < min(share * len(item), enough) or matched < same * (end - begin):
                begin, end = longest_run(equal, same)
                matched = int(equal[begin:end].sum())
            if matched >= min(share * len(item), enough) and matched >= same * (end - begin):
                row = (matched, -(lo + begin + shift), d, j, lo + begin + shift, lo + end + shift, lo + begin)
                if known is None or row > known:
                    best[d, j] = row
        return [(d, self.ids[j], s, e, i, m, int(self.offsets[j + 1] - self.offsets[j]))
                for m, _, d, j, s, e, i in best.values()]


def seed_indexes(benchmark: DataFrame, chunk_chars: int = CHUNK_CHARS, share: float = 0.7, enough: int = 25,
                 same: float = 0.75) -> Iterator:
    """Broadcast indexes of the benchmark one after the other, each of about ``chunk_chars``
    characters at most; and whether more than one is needed."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    chars = int(items.agg(F.sum(F.length("text"))).first()[0] or 0)
    n_chunks = 1 + chars // max(1, chunk_chars // 2)      # halves: chunks dealt by hash are uneven
    for c in range(n_chunks):
        mine = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n_chunks)) == c
        part = items.filter(mine).collect()
        yield spark.sparkContext.broadcast(SeedIndex([r[0] for r in part], [r[1] for r in part], share, enough, same)), n_chunks > 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.7, enough: int = 25, same: float = 0.75,
               chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document row and benchmark item that it holds (see module)."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start_word", "end_word", "item_start",
                                                  "matched", "item_words")])

    def searcher(index):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in text_slices(batch):
                    got = index.value.leaks(*normal_words(piece.column("text")), share, enough, same)
                    if got:
                        columns = [piece.column("doc_id").take(pa.array([x[0] for x in got]))]
                        columns += [pa.array([x[k] for x in got], pa.int64()) for k in range(1, 7)]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        return search

    rows, found = docs.select("doc_id", "text"), []
    for index, several in seed_indexes(benchmark, chunk_chars, share, enough, same):
        part = rows.mapInArrow(searcher(index), SCHEMA)
        found.append(stage(part, "leaks") if several else part)
        if several:
            index.unpersist()
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.7, enough: int = 25, same: float = 0.75,
                  chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` less the rows that hold a benchmark item; columns as they were."""
    def keeper(index):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in text_slices(batch):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[x[0] for x in index.value.leaks(*normal_words(piece.column("text")), share, enough, same)]] = False
                    yield piece.filter(pa.array(clean))
        return keep

    for index, several in seed_indexes(benchmark, chunk_chars, share, enough, same):
        docs = docs.mapInArrow(keeper(index), docs.schema)
        if several:
            docs = stage(docs, "without-leaks")
            index.unpersist()
    return docs
