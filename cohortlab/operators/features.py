"""Sequence features: TF-IDF, truncated SVD, mean pooling.

TF-IDF stays in long sparse form (doc, idx, value) - one row per non-zero
- so vocabulary size never turns into dense rows.  The SVD (no centring, as
truncated SVD of a sparse matrix) iterates on X'X in the space of the terms;
projection X.V is a join of the sparse rows with the (vocabulary x components)
loading table and a grouped sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.hashing import unit_hash
from cohortlab.operators.sequences import SPECIAL_TOKENS
from cohortlab.plans.materialize import remove_stage, write_stage
from cohortlab.session import ensure_checkpoint_dir


def term_counts(tokens: DataFrame, vocab: DataFrame, doc_col: str = "patid",
                token_col: str = "code") -> DataFrame:
    """Raw term frequency per (doc, vocabulary idx); specials and OOV dropped."""
    v = vocab.where(~F.col("token").isin(*SPECIAL_TOKENS)).select(F.col("token").alias(token_col), "idx")
    return (tokens.join(v, token_col, "inner")
                  .groupBy(F.col(doc_col).alias("doc"), "idx").agg(F.count(F.lit(1)).alias("tf")))


def fit_idf(train_tf: DataFrame, vocab: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """Smoothed idf over the fixed vocabulary: ln((1+n)/(1+df)) + 1.

    n = rows of ``train_docs`` (one row per training document, also those that keep
    no token; without it, the documents in ``train_tf``); df = training documents containing the term
    (0 for vocabulary terms never seen in training).
    """
    n_docs = (train_tf.agg(F.countDistinct("doc").alias("n")) if train_docs is None
              else train_docs.agg(F.count(F.lit(1)).alias("n")))
    df = train_tf.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
    v = vocab.where(~F.col("token").isin(*SPECIAL_TOKENS)).select("idx")
    j = v.join(df, "idx", "left").join(F.broadcast(n_docs), how="cross")  # one-row count
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.coalesce(F.col("df"), F.lit(0)))) + F.lit(1.0)
    return j.select("idx", idf.alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """tf x idf, then L2-normalised per document -> (doc, idx, value)."""
    from pyspark.sql.window import Window
    x = tf.join(idf, "idx").withColumn("w", F.col("tf") * F.col("idf"))
    # per-document norm as a window over that document's terms (no self-join)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return x.select("doc", "idx", (F.col("w") / norm).alias("value"))



# -- truncated SVD ---------------------------------------------------------------------------

#: Numbers of one block of vectors (terms x columns) that are broadcast; larger ones stay in tables.
MAX_BROADCAST_NUMBERS = 1 << 22
#: Blocks of vectors that the iteration keeps before it shrinks its space.
BLOCKS = 8
#: Numbers of all blocks and their images that are kept on the driver; more are kept in tables.
MAX_DRIVER_NUMBERS = 1 << 23
CHUNK_TERMS = 4096
#: Cells (non-zeros) of the documents that one task multiplies at a time when blocks are in tables.
PART_CELLS = 1 << 17
#: Share of the largest s^2 that counts as 0.
NOTHING = 1e-13
#: Vectors beyond which a space of ``BLOCKS`` blocks is too wide: fewer, filtered vectors are iterated.
WIDE = 64
#: Smaller side of a matrix that is decomposed on the driver when many components are asked for.
MAX_DRIVER_RANK = 1 << 10
#: Cells of the documents that are broadcast to filter vectors a few columns at a time.
MAX_BROADCAST_CELLS = 1 << 22
FILTER_COLUMNS = 8
#: Numbers of all rows of V that a part of the documents may need.
PART_NUMBERS = 1 << 23
#: Numbers of one run of terms of the filtered vectors.
SLICE_NUMBERS = 1 << 18
MAX_DEGREE = 32
#: What a filter may blow up errors of the vectors by, against the smallest wanted one.
MAX_GAIN = 1e3
SEGMENT = 16


def _times_sparse(x: DataFrame, dense: DataFrame, on: str, out_key: str) -> DataFrame:
    """sum over ``on`` of value * vec: (out_key, vec array) - X.D (on=idx) or X'.D (on=doc).

    ``dense`` is (on, vec array<double>); the product is a join plus a
    grouped ``Summarizer.sum`` (partial aggregation on the JVM).
    """
    j = x.join(dense, on)
    v = array_to_vector(F.transform("vec", lambda e: e * F.col("value")))
    s = j.select(out_key, v.alias("_v")).groupBy(out_key).agg(Summarizer.sum(F.col("_v")).alias("_s"))
    return s.select(out_key, vector_to_array("_s").alias("vec"))


def _matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    values = batch.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return np.asarray(values.flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _arrays(block: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * block.shape[1], pa.int32()), pa.array(block.ravel()))


def _sorted_matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of (idx, vec) rows by id."""
    ids = np.asarray(table.column("idx"))
    order = np.argsort(ids)
    return ids[order], _matrix(table, "vec")[order]


def _own_sums(batches: Iterator[pa.RecordBatch], known: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """X'X.D of a task's documents (rows of index and value arrays), all rows of D."""
    sums = np.zeros_like(dense)
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("idx"))).astype(np.int64)
        if not sizes.sum():
            continue
        at = np.searchsorted(known, np.asarray(batch.column("idx").flatten()))
        value = np.asarray(batch.column("value").flatten())[:, None]
        full = np.flatnonzero(sizes)
        by_doc = np.add.reduceat(value * dense[at], (np.cumsum(sizes) - sizes)[full])
        np.add.at(sums, at, value * np.repeat(by_doc, sizes[full], axis=0))
    return sums


def _whole_sums(docs: DataFrame, ids: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """X'X.D for the broadcast rows D of the ascending ``ids``, as one matrix: tasks send runs
    of ``CHUNK_TERMS`` rows, each one vector."""
    sent = docs.sparkSession.sparkContext.broadcast((ids, dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _own_sums(batches, *sent.value)
        for start in range(0, len(sums), CHUNK_TERMS):
            part = sums[start:start + CHUNK_TERMS]
            if part.any():
                yield pa.record_batch({"start": pa.array([start], pa.int64()), "vec": pa.array([part.ravel()], pa.list_(pa.float64()))})

    parts = docs.mapInArrow(run, "start long, vec array<double>")
    total = parts.groupBy("start").agg(Summarizer.sum(array_to_vector("vec")).alias("_s"))
    out = np.zeros_like(dense)
    for row in total.collect():
        part = row["_s"].toArray().reshape(-1, dense.shape[1])
        out[row["start"]:row["start"] + len(part)] = part
    return out


class _DriverBlocks:
    """Blocks of term vectors and their images under X'X as numpy matrices; the product runs on Spark."""

    def __init__(self, x: DataFrame, start: Column) -> None:
        self.docs = (x.groupBy("doc").agg(F.collect_list(F.struct("idx", "value")).alias("t"))
                     .select(F.col("t.idx").alias("idx"), F.col("t.value").alias("value")).checkpoint(eager=True))
        self.ids, first = _sorted_matrix(x.select("idx").distinct().select("idx", start.alias("vec")).toArrow())
        self.blocks = [(first, _whole_sums(self.docs, self.ids, first))]

    def _combined(self, m: np.ndarray, side: int) -> np.ndarray:
        return np.hstack([b[side] for b in self.blocks]) @ m

    def newest_products(self) -> np.ndarray:
        return np.hstack([v for v, _ in self.blocks]).T @ np.hstack(self.blocks[-1])

    def extend(self, m: np.ndarray, value: np.ndarray) -> None:
        fresh = self._combined(m, 1) - self._combined(m, 0) * value
        self.blocks.append((fresh, _whole_sums(self.docs, self.ids, fresh)))

    def shrink(self, m: np.ndarray) -> None:
        self.blocks = [(self._combined(m, 0), self._combined(m, 1))]

    def vectors(self, spark: SparkSession, m: np.ndarray) -> DataFrame:
        return spark.createDataFrame(pa.table({"idx": self.ids, "v": _arrays(self._combined(m, 0))}))

    def close(self) -> None:
        pass


def _packed(cells: pa.Table) -> pa.Table:
    """The cells (p, doc, idx, value) of one part as one row: its terms, each cell's place among
    them and document, and the values."""
    term, at = np.unique(np.asarray(cells.column("idx")), return_inverse=True)
    doc = pc.dictionary_encode(cells.column("doc").combine_chunks(), null_encoding="encode").indices
    row = {"p": cells.column("p").slice(0, 1).combine_chunks()}
    for name, values in (("term", pa.array(term, pa.int64())), ("at", pa.array(at, pa.int32())),
                         ("row", doc.cast(pa.int32())), ("value", cells.column("value").combine_chunks())):
        row[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table(row)


def _part_products(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """X'X.D of the documents of one part (a row of :func:`_packed`) and the rows of D that it
    needs; rows whose home is this part come back in ``own``."""
    term, at, row, value = (np.asarray(docs.column(c).combine_chunks().flatten()) for c in ("term", "at", "row", "value"))
    dense = np.empty((len(term), len(rows.column("vec")[0])))
    place = np.searchsorted(term, np.asarray(rows.column("idx")))
    dense[place] = _matrix(rows, "vec")
    image = np.empty_like(dense)
    for c in range(dense.shape[1]):
        by_doc = np.bincount(row, weights=value * dense[at, c])
        image[:, c] = np.bincount(at, weights=value * by_doc[row], minlength=len(term))
    home = pc.equal(rows.column("home").combine_chunks(), True)
    own = pc.if_else(home, rows.column("vec").combine_chunks(), pa.scalar(None, pa.list_(pa.float64())))
    return pa.table({"idx": rows.column("idx").combine_chunks(), "own": own, "image": _arrays(image[place])})


class _TableBlocks:
    """The same as tables (idx, v, av) of one block each, bucketed on the term.

    A block and its image are written once; all passes over them join the tables bucket by
    bucket, without a shuffle.  The documents stand in parts of about ``PART_CELLS`` cells.  A
    product sends each row of a block to the parts that have its term, and adds what they send back.
    """

    def __init__(self, x: DataFrame, start: Column, cells: int) -> None:
        parts = -(-cells // PART_CELLS)
        self.spark, self.made = x.sparkSession, []
        self.buckets = min(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        x = x.select(F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int").alias("p"), "doc", "idx", "value")
        packed = x.groupBy("p").applyInArrow(_packed, "p int, term array<long>, at array<int>, row array<int>, value array<double>")
        self.docs = self._written(packed.repartition(self.buckets, "p"), "p")
        terms = x.select("idx", "p").distinct().repartition(self.buckets, "idx").groupBy("idx").agg(F.collect_list("p").alias("parts"))
        self.terms = self._written(terms, "idx")
        self.blocks, self.widths = [], []
        first = self.terms.select("idx", "parts", start.alias("vec"))
        self._append(first, len(first.first()["vec"]))

    def _written(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows``, dealt by ``key`` into the buckets, as a table of their own."""
        name = f"svd_{uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}"
        rows.write.bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        self.made.append((name, path))
        return self.spark.table(name)

    def _append(self, rows: DataFrame, width: int) -> None:
        """Write the block (idx, parts, vec) and its image."""
        sent = rows.select("idx", "vec", F.posexplode("parts").alias("home", "p")).withColumn("home", F.col("home") == 0)
        found = self.docs.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(
            _part_products, "idx long, own array<double>, image array<double>")
        sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("own", "image") for i in range(width)]
        total = found.repartition(self.buckets, "idx").groupBy("idx").agg(*sums)
        side = lambda c: F.array(*[f"{c}{i}" for i in range(width)])
        self.blocks.append(self._written(total.select("idx", side("own").alias("v"), side("image").alias("av")), "idx"))
        self.widths.append(width)

    def _rows(self) -> DataFrame:
        rows = self.terms
        for j, block in enumerate(self.blocks):     # buckets meet in place; no table is small enough to be sent around
            rows = rows.join(block.withColumnsRenamed({"v": f"v{j}", "av": f"av{j}"}).hint("merge"), "idx")
        return rows

    def _combined(self, columns: dict[str, dict[str, np.ndarray]], kept: str = "") -> DataFrame:
        """(idx, kept, new columns): each a sum of block columns times small matrices (map only)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = {c: batch.column(c) for c in ("idx", kept) if c}
                    for name, parts in columns.items():
                        out[name] = _arrays(sum(_matrix(batch, c) @ m for c, m in parts.items()))
                    yield pa.record_batch(out)

        shape = ["idx long", *([f"{kept} array<int>"] if kept else []), *(f"{c} array<double>" for c in columns)]
        return self._rows().mapInArrow(run, ", ".join(shape))

    def _split(self, m: np.ndarray, side: str) -> dict[str, np.ndarray]:
        return {f"{side}{j}": part for j, part in enumerate(np.split(m, np.cumsum(self.widths)[:-1]))}

    def newest_products(self) -> np.ndarray:
        old, new = [f"v{j}" for j in range(len(self.blocks))], [f"{c}{len(self.blocks) - 1}" for c in ("v", "av")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + np.hstack([_matrix(batch, c) for c in old]).T @ np.hstack([_matrix(batch, c) for c in new])
            if not np.isscalar(total):
                yield pa.record_batch({"g": pa.array([total.ravel()], pa.list_(pa.float64()))})

        sums = self._rows().select(*{*old, *new}).mapInArrow(run, "g array<double>")
        total = sums.agg(Summarizer.sum(array_to_vector("g")).alias("s")).first()["s"].toArray()
        return np.asarray(total).reshape(sum(self.widths), -1)

    def extend(self, m: np.ndarray, value: np.ndarray) -> None:
        fresh = self._split(m, "av") | self._split(-m * value, "v")
        self._append(self._combined({"vec": fresh}, "parts"), len(value))

    def shrink(self, m: np.ndarray) -> None:
        rows = self._combined({"v": self._split(m, "v"), "av": self._split(m, "av")})
        block, old = self._written(rows.repartition(self.buckets, "idx"), "idx"), self.made[2:]
        self.blocks, self.widths, self.made = [block], [m.shape[1]], [*self.made[:2], self.made[-1]]
        self._remove([t for t in old if t not in self.made])

    def vectors(self, spark: SparkSession, m: np.ndarray) -> DataFrame:
        return self._combined({"v": self._split(m, "v")})

    def _remove(self, tables: list[tuple[str, str]]) -> None:
        for name, path in tables:
            remove_stage(self.spark, name, path)

    def close(self) -> None:
        self._remove(self.made)


# -- many components ---------------------------------------------------------------------------

def _layers(row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int) -> tuple:
    """The cells of a sparse matrix for :func:`_times`: rows cut into segments of ``SEGMENT`` cells,
    the j-th cells of all segments as layer j, longest segments first."""
    order = np.argsort(row, kind="stable")
    row, col, value = row[order], col[order].astype(np.int32), value[order]
    size = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    parts = -(-size // SEGMENT)
    start = np.cumsum(parts) - parts
    segment, place = start[row] + place // SEGMENT, place % SEGMENT
    rank = np.empty(parts.sum(), np.int64)
    rank[np.argsort(-np.bincount(segment, minlength=len(rank)), kind="stable")] = np.arange(len(rank))
    order = np.lexsort((rank[segment], place))
    cuts = np.searchsorted(place[order], np.arange(SEGMENT + 1))
    layers = [(col[order[a:b]], value[order[a:b], None]) for a, b in zip(cuts, cuts[1:]) if b > a]
    full = np.flatnonzero(parts)
    return layers, rank, start[full], full, rows


def _times(matrix: tuple, dense: np.ndarray) -> np.ndarray:
    layers, rank, start, full, rows = matrix
    sums, out = np.zeros((len(rank), dense.shape[1])), np.zeros((rows, dense.shape[1]))
    for col, value in layers:
        cells = dense.take(col, axis=0)
        cells *= value
        sums[:len(col)] += cells
    if len(full):
        out[full] = np.add.reduceat(sums[rank], start, axis=0)
    return out


def _filtered(both: tuple, x: np.ndarray, degree: int, top: float, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """p(X'X).x with unit columns, and its image: p is the Chebyshev polynomial that stays small on
    [0, cut], scaled to 1 at ``top``; for degree 0 the matrix itself."""
    image = lambda v: _times(both[1], _times(both[0], v))
    if not degree:
        y = image(x)
    else:
        half = cut / 2
        scale = half / (top - half)
        twice, y = 2 / scale, (image(x) - half * x) * (scale / half)
        for _ in range(degree - 1):
            fresh = 1 / (twice - scale)
            x, y = y, (image(y) - half * y) * (2 * fresh / half) - (scale * fresh) * x
            scale = fresh
    y /= np.maximum(np.linalg.norm(y, axis=0), 1e-300)
    return y, image(y)


def _cells(x: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """On the driver: term ids in ascending order, and of each cell document, place of the term and value."""
    docs = x.groupBy("doc").agg(F.collect_list(F.struct("idx", "value")).alias("t")).select(
        F.col("t.idx").alias("idx"), F.col("t.value").alias("value")).toArrow().combine_chunks()
    side = lambda c: np.asarray(pa.concat_arrays([a.flatten() for a in docs.column(c).chunks]))
    ids, at = np.unique(side("idx"), return_inverse=True)
    return ids, np.repeat(np.arange(docs.num_rows), np.asarray(pc.list_value_length(docs.column("idx")))), at, side("value"), docs.num_rows


class _FilteredVectors:
    """Vectors with their images under X'X, in runs of terms (slice, v, av: matrices as bytes) as a table.

    A round filters groups of ``FILTER_COLUMNS`` whole vectors beside a broadcast X, so that nothing
    moves within a filter; the results are cut into runs of terms, where inner products and
    rotations add up.  Vectors that are good enough stay in their runs as they are.
    """

    def __init__(self, spark: SparkSession, cells: tuple, width: int, seed: int) -> None:
        self.spark, self.width, self.table = spark, width, None
        self.ids, row, at, value, docs = cells
        both = _layers(row, at, value, docs), _layers(at, row, value, len(self.ids))
        self.sent = spark.sparkContext.broadcast(both)
        self.step = max(1, SLICE_NUMBERS // width)
        self.slices = -(-len(self.ids) // self.step)
        self.seed = seed
        self._write(self._filter(None, range(width), 0, 0.0, 0.0))

    def _filter(self, pieces: DataFrame | None, columns, degree: int, top: float, cut: float) -> DataFrame:
        """Rows (slice, g, v, av) of the filtered ``columns``; ``pieces`` (g, slice, v) has them, or they are drawn."""
        sent, step, terms, groups, seed = self.sent, self.step, len(self.ids), -(-len(columns) // FILTER_COLUMNS), self.seed
        width = [min(FILTER_COLUMNS, len(columns) - g * FILTER_COLUMNS) for g in range(groups)]

        def rows(g: int, x: np.ndarray) -> pa.Table:
            v, av = _filtered(sent.value, x, degree, top, cut)
            starts = range(0, terms, step)
            return pa.table({"slice": pa.array(range(len(starts)), pa.int32()), "g": pa.array([g] * len(starts), pa.int32()),
                             "v": pa.array([v[s:s + step].tobytes() for s in starts], pa.binary()),
                             "av": pa.array([av[s:s + step].tobytes() for s in starts], pa.binary())})

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.column("g").to_pylist():
                    rng = np.random.default_rng([seed, g])
                    yield from rows(g, rng.standard_normal((terms, width[g]))).to_batches()

        def whole(key: tuple, table: pa.Table) -> pa.Table:
            g = key[0].as_py()
            x = np.empty((terms, width[g]))
            for s, v in zip(table.column("slice").to_pylist(), table.column("v")):
                x[s * step:(s + 1) * step] = np.frombuffer(v.as_buffer()).reshape(-1, width[g])
            return rows(g, x)

        shape = "slice int, g int, v binary, av binary"
        if pieces is None:
            return self.spark.range(0, groups, 1, groups).select(F.col("id").cast("int").alias("g")).mapInArrow(drawn, shape)
        return pieces.repartition(groups, "g").groupBy("g").applyInArrow(whole, shape)

    def _write(self, pieces: DataFrame) -> None:
        """The table anew: a row (slice, v, av) of each run from its pieces (slice, g, v, av)."""
        step, terms = self.step, len(self.ids)

        def joined(key: tuple, table: pa.Table) -> pa.Table:
            rows = min(step, terms - key[0].as_py() * step)
            order = np.argsort(np.asarray(table.column("g")))
            side = lambda c: np.hstack([np.frombuffer(table.column(c)[i].as_buffer()).reshape(rows, -1) for i in order.tolist()])
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([side("v").tobytes()], pa.binary()),
                             "av": pa.array([side("av").tobytes()], pa.binary())})

        old, name = self.table, f"svd_{uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}"
        tasks = min(self.slices, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        whole = pieces.repartition(tasks, "slice").groupBy("slice").applyInArrow(joined, "slice int, v binary, av binary")
        write_stage(whole, name, path)
        self.table = name, path
        if old:
            remove_stage(self.spark, *old)

    def _run(self, one, shape: str) -> DataFrame:
        """What ``one`` (slice, V, AV -> record batches) makes of every run."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, v, av in zip(batch.column("slice").to_pylist(), batch.column("v"), batch.column("av")):
                    yield from one(s, *(np.frombuffer(b.as_buffer()).reshape(-1, width) for b in (v, av)))

        return self.spark.table(self.table[0]).mapInArrow(run, shape)

    def _sum(self, one) -> np.ndarray:
        def run(_, v: np.ndarray, av: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch({"g": pa.array([one(v, av).ravel()], pa.list_(pa.float64()))})

        total = self._run(run, "g array<double>").agg(Summarizer.sum(array_to_vector("g")).alias("s")).first()["s"]
        return total.toArray()

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """V'V and V'X'XV."""
        both = self._sum(lambda v, av: np.hstack([v.T @ v, v.T @ av]))
        gram, stiff = np.split(both.reshape(self.width, -1), 2, axis=1)
        return gram, (stiff + stiff.T) / 2

    def apart(self, turn: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Lengths of the residuals X'XVt - Vt value."""
        return np.sqrt(self._sum(lambda v, av: ((av @ turn - (v @ turn) * value) ** 2).sum(axis=0)))

    def next(self, turn: np.ndarray, good: np.ndarray, degree: int, top: float, cut: float) -> None:
        """Turn the vectors and filter those that are not ``good``."""
        left = np.flatnonzero(~good)

        def moved(s: int, v: np.ndarray, av: np.ndarray) -> Iterator[pa.RecordBatch]:
            x = v @ turn[:, left]
            for g, c in enumerate(range(0, len(left), FILTER_COLUMNS)):
                yield pa.record_batch({"g": pa.array([g], pa.int32()), "slice": pa.array([s], pa.int32()),
                                       "v": pa.array([x[:, c:c + FILTER_COLUMNS].tobytes()], pa.binary())})

        def stays(s: int, v: np.ndarray, av: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch({"slice": pa.array([s], pa.int32()), "g": pa.array([-1], pa.int32()),
                                   "v": pa.array([(v @ turn[:, good]).tobytes()], pa.binary()),
                                   "av": pa.array([(av @ turn[:, good]).tobytes()], pa.binary())})

        pieces = self._filter(self._run(moved, "g int, slice int, v binary"), left, degree, top, cut)
        if good.any():
            pieces = pieces.unionByName(self._run(stays, "slice int, g int, v binary, av binary"))
        self._write(pieces)

    def vectors(self, turn: np.ndarray) -> DataFrame:
        """(idx, v) by term."""
        ids, step = self.ids, self.step
        sent = self.spark.sparkContext.broadcast(ids)

        def one(s: int, v: np.ndarray, av: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch({"idx": pa.array(sent.value[s * step:(s + 1) * step]), "v": _arrays(v @ turn)})

        return self._run(one, "idx long, v array<double>")

    def close(self) -> None:
        self.sent.destroy()
        remove_stage(self.spark, *self.table)


def _many_vectors(spark: SparkSession, cells: tuple, width: int, k: int, max_rounds: int, tolerance: float,
                  seed: int) -> tuple[DataFrame, np.ndarray] | None:
    """(idx, v) rows of the first k vectors and their s^2, or None when ``width`` vectors cannot be told apart.

    Subspace iteration: each round filters the vectors that are not yet good, and takes the best vectors
    of what they span.  A filter is as steep as the errors that are left allow."""
    space = _FilteredVectors(spark, cells, width, seed)
    try:
        for rounds in range(max_rounds + 1):
            gram, stiff = space.products()
            scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
            sizes, turn = np.linalg.eigh(gram * scale[:, None] * scale[None, :])
            if sizes[0] <= 1e-13 * sizes[-1]:
                return None
            ortho = scale[:, None] * turn / np.sqrt(sizes)
            value, best = np.linalg.eigh(ortho.T @ stiff @ ortho)
            value, turn = value[::-1], (ortho @ best)[:, ::-1]
            if value[-1] <= NOTHING * value[0]:
                return None
            apart = space.apart(turn, value) / value
            if rounds == max_rounds or (apart[:k] <= tolerance).all():
                break
            good = (apart <= tolerance / 10) & (np.arange(width) < k)
            x = 2 * value[:k] / value[-1] - 1
            growth = np.log(x + np.sqrt(np.maximum(x * x - 1, 0.0)))
            errors = np.log(np.maximum(apart[:k], 1e-15))
            steep = [d for d in range(1, MAX_DEGREE + 1) if (d * growth + errors).max() - d * growth[-1] <= np.log(MAX_GAIN)]
            space.next(turn, good, max(steep, default=1), value[0], value[-1])
        rows = space.vectors(turn[:, :k]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx")
        return rows.checkpoint(eager=True), value[:k]
    finally:
        space.close()


def _driver_vectors(spark: SparkSession, cells: tuple, k: int) -> tuple[DataFrame, np.ndarray]:
    """The same of a small matrix, all components that it has up to k."""
    ids, row, at, value, docs = cells
    x = np.zeros((docs, len(ids)))
    np.add.at(x, (row, at), value)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    k = min(k, int((s > s[0] * max(x.shape) * np.finfo(float).eps).sum()))
    return spark.createDataFrame(pa.table({"idx": ids, "v": _arrays(np.ascontiguousarray(v[:k].T))})), s[:k] ** 2


def svd_loadings(x: DataFrame, n_features: int, k: int, oversample: int = 10, max_rounds: int = 60,
                 tolerance: float = 1e-7, seed: int = 0, all_residuals: bool = False) -> tuple[DataFrame, list[float]]:
    """Right singular vectors V (idx, comp, v) and singular values of the sparse long
    matrix (doc, idx, value), without centring.

    Block iteration on X'X in the space of the terms: a round adds the residuals of the best
    vectors found so far to the space; its inner products give the best vectors of the larger
    space.  After ``BLOCKS`` rounds the space shrinks to the k + oversample best vectors and the
    directions that were added last.  A round applies X'X to the residuals only, in one pass over
    the documents; of the first k it takes those that were not below the tolerance before (or with
    ``all_residuals`` those of all k + oversample vectors).  Rounds end when every residual
    |X'X v - s^2 v| of the first k is below ``tolerance`` x s^2 in one and the same round.

    The blocks (terms x (k + oversample) numbers at most) stay on the driver while all of them
    hold at most ``MAX_DRIVER_NUMBERS`` numbers, else each is a table that is written once.

    With more than ``WIDE`` vectors a small matrix is decomposed on the driver, and one of at most
    ``MAX_BROADCAST_CELLS`` cells by :func:`_many_vectors`, to the same tolerance.  Components whose
    s^2 rounding cannot tell from 0 are left out, so there may be fewer than k.
    """
    spark = x.sparkSession
    x = x.select("doc", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).checkpoint(eager=True)
    size = x.agg(F.count_distinct("idx").alias("terms"), F.count(F.lit(1)).alias("cells")).first()
    width = min(k + oversample, size["terms"])
    if not width:
        return spark.createDataFrame([], "idx long, comp int, v double"), []
    if width > WIDE:
        found = _many_components(x, size["terms"], size["cells"], k, oversample, max_rounds, tolerance, seed)
        if found is not None:
            rows, value = found
            loads = rows.select("idx", F.posexplode("v").alias("comp", "v")).where(F.col("v") != 0.0)
            return loads, [float(s) for s in np.sqrt(value)]
    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: unit_hash(
        F.concat_ws(":", F.col("idx").cast("string"), c.cast("string")), f"omega{seed}") * 2.0 - 1.0)
    block = size["terms"] * width
    small = block <= MAX_BROADCAST_NUMBERS and 2 * BLOCKS * block <= MAX_DRIVER_NUMBERS
    space = _DriverBlocks(x, start) if small else _TableBlocks(x, start, size["cells"])

    blocks, k = 1, min(k, width)
    live = every = np.arange(width if all_residuals else k)
    gram, stiff = np.split(space.newest_products(), 2, axis=1)
    value, last, taken = np.zeros(width), np.eye(width), every
    for rounds in range(max_rounds + 1):
        if rounds:      # the newest block holds the residuals of the last vectors
            apart = np.sqrt(np.diag(gram)[len(gram) - len(taken):])
            far = (taken < k) & (apart > np.maximum(tolerance * value[taken], NOTHING * value[0]))
            if rounds == max_rounds or (len(taken) == len(live) and not far.any()):
                break
            taken = taken[far] if far.any() and not all_residuals else every
        # an orthonormal basis of the space (directions that rounding cannot tell apart are left out) ...
        scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        sizes, turn = np.linalg.eigh(gram * scale[:, None] * scale[None, :])
        keep = sizes > 1e-12 * sizes.max()
        ortho = scale[:, None] * turn[:, keep] / np.sqrt(sizes[keep])
        # ... and in it the vectors with the largest X'X
        values, best = np.linalg.eigh(ortho.T @ ((stiff + stiff.T) / 2) @ ortho)
        top = np.argsort(values)[::-1][:width]
        value, last = np.maximum(values[top], 0.0), ortho @ best[:, top]
        value, last = np.pad(value, (0, width - len(value))), np.pad(last, ((0, 0), (0, width - len(value))))
        live = every[value[every] > NOTHING * value[0]]     # the residual of a vector without image is rounding only
        if not len(live):
            break
        taken = taken[np.isin(taken, live)] if np.isin(taken, live).any() else live
        if blocks == BLOCKS:        # the space shrinks to the vectors and the directions that were added last
            added = last[:, :len(every)].copy()
            added[:width] = 0.0
            space.shrink(np.hstack([last, added]))
            gram, stiff = np.split(space.newest_products(), 2, axis=1)
            blocks, last = 1, np.eye(len(gram), width)
        space.extend(last[:, taken], value[taken])      # it grows by the residuals
        blocks += 1
        fresh, image = np.split(space.newest_products(), 2, axis=1)
        n = len(gram)
        gram = np.block([[gram, fresh[:n]], [fresh[:n].T, fresh[n:]]])
        stiff = np.block([[stiff, image[:n]], [image[:n].T, image[n:]]])
        last = np.vstack([last, np.zeros((len(taken), width))])
    k = int((value[:k] > NOTHING * value[0]).sum())
    vectors = space.vectors(spark, last)
    loads = vectors.select("idx", F.posexplode("v").alias("comp", "v")).where((F.col("comp") < k) & (F.col("v") != 0.0))
    loads = loads.select("idx", F.col("comp").cast("int"), "v")
    if not small:
        loads = loads.checkpoint(eager=True)
    space.close()
    return loads, [float(s) for s in np.sqrt(value[:k])]


def _many_components(x: DataFrame, terms: int, cells: int, k: int, oversample: int, max_rounds: int,
                     tolerance: float, seed: int) -> tuple[DataFrame, np.ndarray] | None:
    """(idx, v) rows and s^2 where the matrix is small or can be broadcast, else None."""
    docs = x.select("doc").distinct().count()
    width = k + max(oversample, k // 5)
    if docs * terms <= MAX_DRIVER_NUMBERS and min(docs, terms) <= MAX_DRIVER_RANK:
        return _driver_vectors(x.sparkSession, _cells(x), k)
    if cells <= MAX_BROADCAST_CELLS and width < min(docs, terms):
        return _many_vectors(x.sparkSession, _cells(x), width, k, max_rounds, tolerance, seed)
    return None


def randomized_svd_loadings(x: DataFrame, n_features: int, k: int, oversample: int = 10,
                            power_iters: int = 5, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """:func:`svd_loadings` with at most ``power_iters`` rounds, converged or not."""
    return svd_loadings(x, n_features, k, oversample, power_iters, seed=seed, all_residuals=True)


def project(x: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """X.V for sparse rows: (doc, features array<double> of length k).

    Loadings become one k-vector per term; each non-zero contributes
    value * V[idx] and the per-document sum is a ``Summarizer.sum``
    (one shuffled row per non-zero, partial aggregation).  Beyond ``WIDE`` components a row of V is
    sent once to each part of the documents that has its term.
    """
    if k > WIDE:
        return _project_parts(x, loadings, k)
    wide = (loadings.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("comp", "v"))).alias("m"))
                    .select("idx", F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                               lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(0.0)))
                            .alias("vec")))
    return _times_sparse(x, wide, "idx", "doc").withColumnRenamed("vec", "features")


def _project_parts(x: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    parts = max(1, -(-x.count() * k // PART_NUMBERS))
    x = x.select(F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int").alias("p"), "doc", "idx", F.col("value").cast("double").alias("value"))
    rows = loadings.where(F.col("comp") < k).groupBy("idx").agg(F.collect_list(F.struct("comp", "v")).alias("t"))
    sent = x.select("p", "idx").distinct().join(rows, "idx").select(
        F.col("p").alias("part"), F.col("idx").alias("term"), F.col("t.comp").alias("comp"), F.col("t.v").alias("v"))

    def run(cells: pa.Table, rows: pa.Table) -> pa.Table:
        term = np.asarray(rows.column("term"))
        order, flat = np.argsort(term), lambda c: np.asarray(rows.column(c).combine_chunks().flatten())
        dense = np.zeros((len(term), k))
        dense[np.repeat(np.arange(len(term)), np.asarray(pc.list_value_length(rows.column("comp")))), flat("comp")] = flat("v")
        cells = cells.filter(pc.is_in(cells.column("idx"), rows.column("term")))
        doc = pc.dictionary_encode(cells.column("doc").combine_chunks(), null_encoding="encode")
        at = order[np.searchsorted(term, np.asarray(cells.column("idx")), sorter=order)] if len(term) else np.zeros(0, int)
        row, value = np.asarray(doc.indices), np.asarray(cells.column("value"))
        sums = [np.bincount(row, weights=value * dense[at, c], minlength=len(doc.dictionary)) for c in range(k)]
        return pa.table({"doc": doc.dictionary, "features": _arrays(np.ascontiguousarray(np.stack(sums, axis=1)))})

    shape = f"doc {x.schema['doc'].dataType.simpleString()}, features array<double>"
    return x.groupBy("p").cogroup(sent.groupBy("part")).applyInArrow(run, shape)


def mean_pool(tokens: DataFrame, token_vectors: DataFrame, doc_col: str = "patid",
              token_col: str = "code", vec_col: str = "features") -> DataFrame:
    """Mean of the token vectors of each document (unknown tokens masked).

    ``Summarizer.mean`` over VectorUDT per document; documents without any
    known token are absent (denominator >= 1).
    """
    j = tokens.join(token_vectors.select(F.col("token").alias(token_col), vec_col), token_col, "inner")
    s = (j.withColumn("_v", array_to_vector(F.col(vec_col))).groupBy(doc_col)
          .agg(Summarizer.mean(F.col("_v")).alias("_m")))
    return s.select(doc_col, vector_to_array(F.col("_m")).alias("pooled"))
