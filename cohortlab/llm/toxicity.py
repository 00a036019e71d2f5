"""Toxicity by classifier chains (operator 4).

Categories are predicted one after the other.  The linear model of a category
sees the words of the document and the probabilities that the earlier models
gave for the earlier categories.  For training, those probabilities are
out-of-fold: each labelled document gets them from a model that was fitted on
the other folds, so a later model does not learn from overfitted inputs.  The
cutoff of the deciding category is the one with the best F1 out of fold.

Features: distinct lower-case words without punctuation at their ends, and their
first four letters (marked ``^``), so unseen inflections count; each feature is a
log frequency, and a document's features have length 1.  The vocabulary is that of
the sample: the ``n_features`` features in most sample documents.

Scale: training takes a hash sample of at most ``max_train`` labelled documents (a
documented bound; the labels that name them are broadcast, at most ``max_train``
rows).  Scoring is one pass over all whole texts with the fitted weights, nothing
shuffled.

Edge cases: null and empty texts have no features and get the models' intercepts;
labels without document or with null labels are ignored; documents without label are
scored like the others; of repeated label rows the largest label counts; without any
labelled document, or with one class only, probabilities are the smoothed base rate
and nothing is rejected; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._tables import hash_order, hash_thinned
from cohortlab.llm._words import split_words, text_slices

PUNCTUATION = string.punctuation + "«»“”„‘’…–—¿¡"
#: Chain of categories over the label columns, in the order of prediction.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1", "toxic_junk": "toxic = 1 AND quality = 0"}
DECIDING = "toxic"
FOLDS = 5


def feature_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, names): features of each text with repeats, as codes into names."""
    offsets, flat = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = flat.dictionary_encode()
    names: dict[str, int] = {}
    words = [w.strip(PUNCTUATION) for w in coded.dictionary.to_pylist()]
    pairs = np.array([[names.setdefault(w, len(names)), names.setdefault("^" + w[:4], len(names))] for w in words],
                     np.int64).reshape(-1, 2)
    return offsets, pairs[np.asarray(coded.indices)].ravel(), list(names)


@dataclass
class Sparse:
    """Rows of features: row i has columns ``cols[at[i]:at[i+1]]`` with ``vals``."""
    at: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.vals * w[self.cols], len(self.at) - 1)

    def transposed_times(self, y: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.cols, self.vals * y[self.row], width)


def weigh(offsets: np.ndarray, codes: np.ndarray, lookup: np.ndarray, width: int) -> Sparse:
    """Log frequencies of the known features, each row scaled to length 1."""
    known = lookup[codes]
    row = np.repeat(np.arange(len(offsets) - 1), 2 * np.diff(offsets))
    keep = known >= 0
    key, count = np.unique(row[keep] * width + known[keep], return_counts=True)
    r, c, v = key // width, key % width, 1 + np.log(count)
    norm = np.sqrt(np.bincount(r, v * v, len(offsets) - 1))
    return Sparse(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(offsets) - 1)))), c, v / norm[r])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray, width: int,
               l2: float = 1e-3, steps: int = 60, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on the rows ``use`` by Adam on the whole gradient: weights of
    the words, then of the extra columns, then the intercept."""
    wide = np.column_stack([extra, np.ones(len(y))])
    base = np.clip(y[use].mean() if use.any() else 0.5, 1e-3, 1 - 1e-3)
    w = np.zeros(width + wide.shape[1])
    w[-1] = np.log(base / (1 - base))
    if not use.any() or y[use].min() == y[use].max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        error = np.where(use, sigmoid(x.times(w) + wide @ w[width:]) - y, 0) / use.sum()
        g = np.concatenate([x.transposed_times(error, width), wide.T @ error])
        g[:-1] += l2 * w[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


@dataclass
class Chain:
    names: list[str]                 # categories in order
    features: dict[str, int]
    weights: list[np.ndarray]        # of category k: words, k earlier probabilities, intercept
    cutoff: float
    deciding: int

    def probabilities(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x.at) - 1, len(self.names)))
        for k, w in enumerate(self.weights):
            wide = np.column_stack([out[:, :k], np.ones(len(out))])
            out[:, k] = sigmoid(x.times(w) + wide @ w[len(self.features):])
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, names = feature_rows(texts)
        lookup = np.array([self.features.get(n, -1) for n in names] or [-1])
        return self.probabilities(weigh(offsets, codes, lookup, max(1, len(self.features))))


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """Cutoff of the best F1, in the middle between two probabilities."""
    if not len(y) or y.min() == y.max():
        return float("inf")
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    k = int(np.argmax(f1))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


def sample_features(texts: list, n_features: int, step: int = 200) -> tuple[Sparse, dict[str, int]]:
    """Features of the sample and the vocabulary; a few hundred texts are cut at a time."""
    known: dict[str, int] = {}
    rows, cols, counts = [], [], []
    for s in range(0, len(texts), step):
        offsets, codes, names = feature_rows(pa.array(texts[s:s + step], pa.string()))
        to = np.array([known.setdefault(n, len(known)) for n in names], np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), 2 * np.diff(offsets))
        key, count = np.unique(row * max(1, len(names)) + codes, return_counts=True)
        rows.append((key // max(1, len(names)) + s).astype(np.int32))
        cols.append((to[key % max(1, len(names))] if len(key) else key).astype(np.int32))
        counts.append(count.astype(np.int32))
    row, col, count = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, cols, counts))
    df = np.bincount(col, minlength=len(known))
    words = list(known)
    order = sorted((i for i in range(len(words)) if df[i] > 1), key=lambda i: (-df[i], words[i]))[:n_features]
    lookup = np.full(max(1, len(words)), -1, np.int32)
    lookup[order] = np.arange(len(order))
    keep = lookup[col] >= 0
    row, col, value = row[keep], lookup[col[keep]], 1 + np.log(count[keep])
    order_in = np.lexsort((col, row))
    row, col, value = row[order_in], col[order_in], value[order_in]
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
    return Sparse(at, col, value / norm[row]), {words[i]: k for k, i in enumerate(order)}


def fit_chain(ids: list, texts: list, labels: np.ndarray, names: list[str], deciding: str = DECIDING,
              n_features: int = 30_000, folds: int = FOLDS) -> Chain:
    """The chain of a bounded sample; ``labels`` has a 0/1 column for each category."""
    x, features = sample_features(texts, n_features)
    width = max(1, len(features))
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in ids])
    extra, weights = np.zeros((len(texts), 0)), []
    for k in range(len(names)):
        y, out = labels[:, k].astype(float), np.zeros(len(texts))
        for f in range(folds):
            w = fit_linear(x, extra, y, fold != f, width)
            wide = np.column_stack([extra, np.ones(len(y))])
            out = np.where(fold == f, sigmoid(x.times(w) + wide @ w[width:]), out)
        weights.append(fit_linear(x, extra, y, np.ones(len(y), bool), width))
        extra = np.column_stack([extra, out])
    at = names.index(deciding)
    return Chain(names, features, [w if len(features) else np.concatenate([w[width:]]) for w in weights],
                 best_cutoff(extra[:, at], labels[:, at]), at)


def training_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int) -> DataFrame:
    """At most ``max_train`` labelled documents: (doc_id, text, one 0/1 column a category)."""
    marks = [F.max(F.expr(f"int({rule})")).alias(name) for name, rule in categories.items()]
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*marks).dropna()
    order, most = hash_order("toxicity"), max_train + max_train // 2
    # half as many again, for labels without document; the limit bounds the broadcast
    named = hash_thinned(known, most, "toxicity").orderBy(order, "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id")
    one = found.groupBy("doc_id").agg(F.max("text").alias("text"), *[F.first(c).alias(c) for c in categories])
    return one.orderBy(order, "doc_id").limit(max_train)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, deciding: str = DECIDING,
          max_train: int = 4000, n_features: int = 30_000) -> Chain:
    """The chain of the labelled sample of ``docs``."""
    names = list(categories)
    sample = training_sample(docs, labels, categories, max_train).toPandas().sort_values("doc_id", kind="stable")
    return fit_chain(sample["doc_id"].tolist(), sample["text"].tolist(),
                     sample[names].to_numpy(dtype=int).reshape(-1, len(names)), names, deciding, n_features)


def score_documents(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES,
                    deciding: str = DECIDING, max_train: int = 4000, n_features: int = 30_000) -> DataFrame:
    """(doc_id, p_<category>..., rejected) of every document row."""
    names = list(categories)
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, deciding, max_train, n_features))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                p = chain.value.score(piece.column("text"))
                columns = [piece.column("doc_id")]
                columns += [pa.array(p[:, k]) for k in range(len(names))]
                columns.append(pa.array(p[:, chain.value.deciding] >= chain.value.cutoff))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"p_{n}" for n in names], "rejected"])

    shape = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(score, shape)


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` less the rejected rows; columns as they were."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                p = chain.value.score(piece.column("text"))[:, chain.value.deciding]
                yield piece.filter(pa.array(p < chain.value.cutoff))

    return docs.mapInArrow(keep, docs.schema)
