"""Quality classifier on random-indexing word vectors (operator 6).

1. Every word has a fixed sparse index vector (a few +1 and -1 at places that its
   hash names).  A word's vector is the sum of the index vectors of its neighbours
   within two words, over all documents.  Words share ``BUCKETS`` rows by hash, so
   the table has a fixed size whatever the corpus.
2. A document is pooled to the mean and the standard deviation of its words'
   vectors, the mean of its words' own index vectors, and the shares of distinct and
   of repeated words (by 64-bit hashes of the words, not by rows).
3. A two-layer network (numpy) is trained on a bounded sample of labelled documents;
   its temperature is fitted on a part of them that it has not seen, and the
   calibrated probability is the score.

Labels are learnt only from rows whose ``crc32(doc_id as text) mod 5`` is not 0.
Labels, lang, source and doc_id are no inputs of a score.

Scale: two passes over the whole texts.  The first sends the rows that a task has seen
of each block of the word table to a sum (one row a task and block); the second
writes one pooled vector per document, from which training and scoring read.  The
driver holds the word table (``BUCKETS`` x ``DIM``), the sample and the network.

Edge cases: null and empty texts pool to zeros and get the network's score of that;
labels without document, null labels or ids are not learnt from; of repeated label
rows the largest counts; without labels of both kinds every score is the smoothed
share of label 1; repeated rows are scored alike; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._tables import hash_order, hash_thinned, stage
from cohortlab.llm._words import hash_words, mix64, split_words, text_slices

BUCKETS, DIM, NONZERO, REACH = 1 << 18, 32, 4, 2
BLOCKS = 64                                  # parts of the word table that are summed apart
BLOCK_ROWS = BUCKETS // BLOCKS               # fits 16 bits
POOLED = 3 * DIM + 3
HIDDEN, CUTOFF = 32, 0.3


def index_vectors() -> np.ndarray:
    """The fixed sparse +1/-1 vector of each bucket."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    seed = np.arange(BUCKETS, dtype=np.uint64)
    for k in range(NONZERO):
        h = mix64(seed * np.uint64(NONZERO) + np.uint64(k + 1))
        out[np.arange(BUCKETS), (h % np.uint64(DIM)).astype(int)] += np.where(h >> np.uint64(63), 1, -1)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat = split_words(texts)
    return offsets, hash_words(flat)


def table_rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def row_order(rows: np.ndarray) -> np.ndarray:
    """Stable order of table rows, sorted by digits of 16 bits."""
    low = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((rows[low] >> 16).astype(np.uint16), kind="stable")]


def neighbour_sums(offsets: np.ndarray, words: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of its neighbours in the same text
    (``index`` in int8: at most 2 * REACH * NONZERO in a place)."""
    own = index[words]
    around = np.zeros_like(own)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for s in range(1, REACH + 1):
        same = (row[s:] == row[:-s])[:, None]
        around[:-s] += own[s:] * same
        around[s:] += own[:-s] * same
    return around


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbours' index vectors: for each block of the word table
    the rows that it saw, those of small numbers in one byte a number."""
    total, seen, index = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, bool), index_vectors().astype(np.int8)
    for batch in batches:
        for piece in text_slices(batch, limit=1 << 20):
            offsets, hashes = word_hashes(piece.column("text"))
            if len(hashes) < 2:
                continue
            words = table_rows(hashes)
            order = row_order(words)
            first = np.flatnonzero(np.concatenate(([True], np.diff(words[order]) != 0)))
            around, rows = neighbour_sums(offsets, words, index)[order], words[order][first]
            total[rows] += np.add.reduceat(around, first, axis=0, dtype=np.int32)
            seen[rows] = True
    for block in range(BLOCKS if seen.any() else 0):
        rows = np.flatnonzero(seen[block * BLOCK_ROWS:(block + 1) * BLOCK_ROWS])
        sums = total[block * BLOCK_ROWS + rows]
        small = np.abs(sums).max(axis=1, initial=0) < 128
        parts = [x.tobytes() for x in (rows[small].astype(np.uint16), sums[small].astype(np.int8),
                                       rows[~small].astype(np.uint16), sums[~small])]
        yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x], pa.binary()) for x in parts]],
                                         ["block", "few_rows", "few", "many_rows", "many"])


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' sums added up: word vectors of length 1 of each block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for i, block in enumerate(columns[0].to_pylist()):
            sums = total.setdefault(block, np.zeros((BLOCK_ROWS, DIM)))
            for rows, values, kind in ((1, 2, np.int8), (3, 4, np.int64)):
                sums[np.frombuffer(columns[rows][i].as_py(), np.uint16)] += np.frombuffer(
                    columns[values][i].as_py(), kind).reshape(-1, DIM)
    for block, sums in total.items():
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        unit = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([unit.tobytes()], pa.binary())], ["block", "v"])


def word_table(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) word vectors of length 1 from all texts of ``docs``."""
    parts = docs.select("text").mapInArrow(
        context_batches, "block long, few_rows binary, few binary, many_rows binary, many binary")
    summed = parts.repartition(BLOCKS, "block").mapInArrow(block_batches, "block long, v binary")
    table = np.zeros((BLOCKS, BLOCK_ROWS, DIM), np.float32)
    for block, v in summed.toLocalIterator():                # BLOCKS rows of fixed length
        table[block] = np.frombuffer(v, np.float32).reshape(BLOCK_ROWS, DIM)
    return table.reshape(BUCKETS, DIM)


def pool(offsets: np.ndarray, hashes: np.ndarray, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of POOLED numbers for each text."""
    n = np.diff(offsets)
    out = np.zeros((len(n), POOLED), np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    words = table_rows(hashes)
    at, size = offsets[:-1][some], n[some][:, None]
    v = table[words]
    mean = np.add.reduceat(v, at, axis=0) / size
    square = np.add.reduceat(v * v, at, axis=0) / size
    out[some, :DIM] = mean
    out[some, DIM:2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[some, 2 * DIM:3 * DIM] = np.add.reduceat(index[words], at, axis=0) / size
    row = np.repeat(np.arange(len(n)), n)
    # words are told apart by their 64-bit hashes, not by their rows of the table
    keys = mix64(hashes ^ mix64(row.astype(np.uint64) + np.uint64(1)))
    distinct = np.bincount(row[np.unique(keys, return_index=True)[1]], minlength=len(n))
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out[some, 3 * DIM] = (distinct[some] / n[some])
    out[some, 3 * DIM + 1] = np.bincount(row[same], minlength=len(n))[some] / n[some]
    out[some, 3 * DIM + 2] = np.log1p(n[some]) / 10
    return out


def pooled_documents(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, pooled array<float>) of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(table)   # BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            for piece in text_slices(batch, limit=1 << 20):
                p = pool(*word_hashes(piece.column("text")), shared.value, index)
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, POOLED, dtype=np.int32), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], ["doc_id", "pooled"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pooled array<float>")


# -- the network ---------------------------------------------------------------------------

class Network:
    """Two layers (tanh, then one logit) with a temperature; inputs are standardised."""

    def __init__(self, base: float = 0.5):
        self.mean, self.sd = np.zeros(POOLED), np.ones(POOLED)
        self.w1, self.b1 = np.zeros((POOLED, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = np.zeros(HIDDEN), float(np.log(base / (1 - base)))
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.sd @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3,
            l2: float = 1e-4, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.sd
        self.w1 = rng.normal(0, 1 / np.sqrt(POOLED), (POOLED, HIDDEN))
        self.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, np.zeros(1))]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                i, t = order[s:s + batch], t + 1
                h = np.tanh(z[i] @ self.w1 + self.b1)
                e = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[i]) / len(i)
                back = np.outer(e, self.w2) * (1 - h * h)
                grads = (z[i].T @ back + l2 * self.w1, back.sum(0), h.T @ e + l2 * self.w2, np.array([e.sum()]))
                moves = []
                for (m, v), g in zip(state, grads):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    moves.append(rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8))
                self.w1 -= moves[0]
                self.b1 = self.b1 - moves[1]
                self.w2 -= moves[2]
                self.b2 -= float(moves[3][0])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss, on rows not trained on."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, -np.where(y == 1, z, -z) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(pooled: DataFrame, labels: DataFrame, max_train: int = 12_000) -> Network:
    """Network of a hash sample of at most ``max_train`` labelled documents that are
    not held out; a sixth of them sets the temperature."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.max("quality").alias("quality")).filter(~held_out(F.col("doc_id"))))
    known = hash_thinned(known, max_train, "quality")
    rows = pooled.join(known, "doc_id").orderBy(hash_order("quality"), "doc_id", "pooled").limit(max_train).select("pooled", "quality").collect()
    y = np.array([r[1] for r in rows], float)
    network = Network((y.sum() + 1) / (len(y) + 2))
    if len(y) >= 12 and 0 < y.mean() < 1:
        x, cut = np.array([r[0] for r in rows], float), len(y) // 6
        network.fit(x[cut:], y[cut:])
        network.calibrate(x[:cut], y[:cut])
    return network


def score_quality(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, max_train: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    pooled = stage(pooled_documents(docs, word_table(docs)), "quality-pooled")
    network = docs.sparkSession.sparkContext.broadcast(train(pooled, labels, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("pooled").flatten().to_numpy().reshape(-1, POOLED)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.value.score(x.astype(float)))],
                                             ["doc_id", "score"])

    return (pooled.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= cutoff).cast("int").alias("predicted")))
