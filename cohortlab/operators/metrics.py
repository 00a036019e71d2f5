"""Cluster-quality metrics as distributed aggregates.

Design:
* Label agreement (ARI, Jaccard, prediction strength, best mapping) is
  computed from contingency counts - ``groupBy(a, b).count()`` - never from
  pair matrices: n(n-1)/2 pair counts are sums of comb2 over cells.
* Centroid statistics use Spark ML ``Summarizer`` over ``VectorUDT``
  (JVM, partial aggregation); per-cluster rows are bounded by k.
* Fitted centers (k x d, model parameters) are one broadcast row, so
  nearest-center assignment is a projection without shuffle.
* Silhouette and consensus PAC are pairwise by definition and use every row.
  Equal rows first collapse to one row with a weight (equal vectors of a cluster,
  equal label arrays); what is left meets in tiles of two blocks of ``TILE_ROWS``
  rows, and a tile returns sums per row or one row of counts.  The silhouette skips
  clusters that the triangle inequality rules out.  No pair rows, no group larger
  than two blocks.  ``silhouette_squared`` is linear in the rows.  A caller who wants
  a sample passes ``max_n`` (the sampling operator O4); there is no default.
* Replicate labelings are label arrays: one array per item, distinct arrays counted,
  contingencies of all replicate pairs summed from these weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from cohortlab.functions.assignment import best_assignment
from cohortlab.functions.numeric import comb2, safe_div
from cohortlab.functions.vectors import dot, euclidean, squared_distance
from cohortlab.operators.splits import sample_n

MAX_BROADCAST_NUMBERS = 1 << 22     # 32 MB of centroids
MAX_CENTERS = 10_000          # bound on the centers of one broadcast row (k)
MAX_LABELS = 4096             # of each side in the contingency table of best_mapping
TILE_ROWS = 8192              # distinct rows of each side that meet in one pairwise task
CHUNK_NUMBERS = 1 << 19       # pairs of a tile whose distances or counts are held at a time (4 MB of doubles)
NEAR_NUMBERS = 1 << 19        # numbers of the vector differences that are held at a time


# -- centers and assignment -------------------------------------------------------------

def collect_centers(centers: DataFrame, idx_col: str = "idx", vec_col: str = "center",
                    with_ids: bool = False):
    """Fitted centers (k rows) to a Python list ordered by index; k is checked."""
    rows = centers.select(idx_col, vec_col).orderBy(idx_col).limit(MAX_CENTERS + 1).collect()
    if len(rows) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centers")
    vecs = [list(map(float, r[vec_col])) for r in rows]
    if with_ids:
        return vecs, [r[idx_col] for r in rows]
    return vecs


def _with_centers(df: DataFrame, centers: list[list[float]], ids: list[int], features: str) -> DataFrame:
    """``df`` with the squared distances ``_d`` to the centers and their ``_ids``; the
    centers (k x d model parameters) are one broadcast row."""
    row = df.sparkSession.createDataFrame([([list(map(float, c)) for c in centers], list(map(int, ids)))],
                                          "_centers array<array<double>>, _ids array<int>")
    x = df.crossJoin(F.broadcast(row))
    return x.withColumn("_d", F.transform("_centers", lambda c: squared_distance(F.col(features), c))).drop("_centers")


def assign_nearest(df: DataFrame, centers: list[list[float]], features: str = "features",
                   out: str = "nearest", center_ids: list[int] | None = None) -> DataFrame:
    """Index of the nearest center (Euclidean), ties -> lowest index.

    With ``center_ids`` the result is the id of the nearest center instead
    of its position.
    """
    ids = range(len(centers)) if center_ids is None else center_ids
    x = _with_centers(df, centers, list(ids), features)
    pos = F.array_position("_d", F.array_min("_d")).cast("int")
    return x.withColumn(out, F.element_at("_ids", pos)).drop("_d", "_ids")


def to_vector(df: DataFrame, features: str = "features", out: str = "vec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features)))


def cluster_centroids(df: DataFrame, label: str = "label", features: str = "features",
                      keys: list[str] | None = None) -> DataFrame:
    """(keys, label, n, centroid array) with ``Summarizer`` (vectorised, partial aggregation)."""
    keys = keys or []
    s = (to_vector(df, features).groupBy(*keys, label)
         .agg(Summarizer.metrics("mean", "count").summary(F.col("vec")).alias("s")))
    return s.select(*keys, label, F.col("s.count").alias("n"), vector_to_array(F.col("s.mean")).alias("centroid"))


# -- contingency-based agreement ----------------------------------------------------------

def crosstab(df: DataFrame, a: str, b: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Pair counts of two labelings (optionally per key, e.g. replicate pair); a row
    with a ``weight`` counts as that many rows."""
    keys = keys or []
    return df.groupBy(*keys, a, b).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n_ab"))


def _pair_sums(ct: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Sum of comb2 over cells, row margins and column margins, per key.

    Margins are windows over the contingency cells (ka x kb rows per key);
    each margin is counted once via its first cell.  One aggregate, no joins.
    """
    part = keys or [F.lit(1)]
    wa = Window.partitionBy(*part, a)
    wb = Window.partitionBy(*part, b)
    x = (ct.withColumn("_na", F.sum("n_ab").over(wa)).withColumn("_nb", F.sum("n_ab").over(wb))
           .withColumn("_fa", F.row_number().over(wa.orderBy(b)) == 1)
           .withColumn("_fb", F.row_number().over(wb.orderBy(a)) == 1))
    return x.groupBy(*keys).agg(F.sum(comb2("n_ab")).alias("s_ab"), F.sum("n_ab").alias("n"),
                                F.sum(F.when(F.col("_fa"), comb2("_na")).otherwise(F.lit(0.0))).alias("s_a"),
                                F.sum(F.when(F.col("_fb"), comb2("_nb")).otherwise(F.lit(0.0))).alias("s_b"))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Adjusted Rand index from the contingency table; degenerate -> 1."""
    return ari_of_counts(crosstab(df, a, b, keys, weight), a, b, keys)


def ari_of_counts(counts: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """M23 of contingency cells (keys, a, b, n_ab)."""
    keys = keys or []
    s = _pair_sums(counts, a, b, keys)
    expected = F.coalesce(safe_div(F.col("s_a") * F.col("s_b"), comb2("n")), F.lit(0.0))   # one item: no pairs
    mx = (F.col("s_a") + F.col("s_b")) / 2.0
    ari = F.when(mx == expected, F.lit(1.0)).otherwise((F.col("s_ab") - expected) / (mx - expected))
    return s.select(*keys, ari.alias("ari"))


def jaccard_partition(df: DataFrame, a: str, b: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Pair-counting Jaccard m11 / (m11 + m10 + m01); empty -> 1."""
    keys = keys or []
    s = _pair_sums(crosstab(df, a, b, keys, weight), a, b, keys)
    m11 = F.col("s_ab")
    den = m11 + (F.col("s_a") - m11) + (F.col("s_b") - m11)
    return s.select(*keys, F.when(den == 0, F.lit(1.0)).otherwise(m11 / den).alias("jaccard"))


def best_mapping(df: DataFrame, a: str, b: str) -> DataFrame:
    """The one-to-one matching of labels that most rows agree with: (a, b, n_ab).

    Labels are counted on Spark before any row moves; only a contingency table of at most
    ``MAX_LABELS`` labels on either side reaches the driver, where the assignment is solved
    in polynomial time.  Every label of the side with fewer labels is matched (n_ab 0 if
    the pair never occurs).  Rows with a null label have no match and are left out.
    """
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    counts = crosstab(rows.where("_a IS NOT NULL AND _b IS NOT NULL"), "_a", "_b").checkpoint(eager=True)
    labels = counts.agg(F.count_distinct("_a").alias("a"), F.count_distinct("_b").alias("b")).first()
    if max(labels) > MAX_LABELS:
        raise ValueError(f"best mapping of more than {MAX_LABELS} labels on one side")
    types = dict(rows.dtypes)
    shape = f"`{a}` {types['_a']}, `{b}` {types['_b']}, n_ab long"
    if not max(labels):
        return df.sparkSession.createDataFrame([], shape)
    cells = counts.collect()
    names_a, names_b = sorted({r["_a"] for r in cells}), sorted({r["_b"] for r in cells})
    at_a, at_b = {v: i for i, v in enumerate(names_a)}, {v: i for i, v in enumerate(names_b)}
    agree = np.zeros((len(names_a), len(names_b)))
    for r in cells:
        agree[at_a[r["_a"]], at_b[r["_b"]]] = r["n_ab"]
    pairs = enumerate(best_assignment(agree)) if len(names_a) <= len(names_b) else (
        (i, j) for j, i in enumerate(best_assignment(agree.T)))
    return df.sparkSession.createDataFrame([(names_a[i], names_b[j], int(agree[i, j])) for i, j in pairs], shape)


def best_mapping_accuracy(df: DataFrame, a: str, b: str) -> float:
    """Share of the rows (with both labels) that agree with the best mapping; no rows -> nan."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).count()
    agree = best_mapping(df, a, b).agg(F.sum("n_ab")).first()[0]
    return float(agree / rows) if rows else float("nan")


def strength_from_assignment(x: DataFrame, test_label: str, near: str,
                             keys: list[str] | None = None) -> DataFrame:
    """M14 per (keys, test cluster) from a precomputed nearest-train-center column."""
    keys = keys or []
    cells = x.groupBy(*keys, test_label, near).agg(F.count(F.lit(1)).alias("c"))
    g = cells.groupBy(*keys, test_label).agg(F.sum(comb2("c")).alias("match"), F.sum("c").alias("size"))
    s = F.when(F.col("size") <= 1, F.lit(float("inf"))).otherwise(F.col("match") / comb2("size"))
    return g.select(*keys, F.col(test_label).alias("cluster"), F.col("size").cast("bigint"), s.alias("strength"))


def prediction_strength_by_cluster(test: DataFrame, test_label: str, train_centers: list[list[float]],
                                   features: str = "features") -> DataFrame:
    """M14 per test cluster: share of its point pairs sharing the nearest train center.

    Size <= 1 -> +inf.  Returns (cluster, size, strength) for clusters
    present in ``test``; absent clusters count as +inf in the minimum.
    """
    return strength_from_assignment(assign_nearest(test, train_centers, features, "_near"), test_label, "_near")


def prediction_strength(test: DataFrame, test_label: str, train_centers: list[list[float]],
                        features: str = "features") -> DataFrame:
    """Min over clusters of the per-cluster strength (one row)."""
    per = prediction_strength_by_cluster(test, test_label, train_centers, features)
    return per.agg(F.coalesce(F.min("strength"), F.lit(float("inf"))).alias("prediction_strength"))


# -- dispersion-based indices -------------------------------------------------------------

def with_centroids(df: DataFrame, label: str = "label", features: str = "features",
                   centroids: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Points joined to their cluster centroid.  The centroids (keys x k rows, written
    first) are broadcast if they hold at most ``MAX_BROADCAST_NUMBERS`` numbers;
    larger tables are joined as Spark's own sizes tell."""
    keys = keys or []
    cen = centroids if centroids is not None else cluster_centroids(df, label, features, keys).checkpoint(eager=True)
    numbers = cen.agg(F.sum(F.size("centroid"))).first()[0] or 0
    return df.join(F.broadcast(cen) if numbers <= MAX_BROADCAST_NUMBERS else cen, keys + [label])


def within_dispersion(df: DataFrame, label: str = "label", features: str = "features",
                      centroids: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Inertia sum ||x - centroid(label)||^2 (one row per key)."""
    keys = keys or []
    x = with_centroids(df, label, features, centroids, keys)
    return x.groupBy(*keys).agg(F.sum(squared_distance(F.col(features), F.col("centroid"))).alias("inertia"))


def inertia_to_centers(df: DataFrame, centers: list[list[float]], features: str = "features") -> DataFrame:
    """K-Means cost: squared distance of every point to its nearest center."""
    x = _with_centers(df, centers, list(range(len(centers))), features)
    return x.agg(F.sum(F.array_min("_d")).alias("inertia"))


def calinski_harabasz(df: DataFrame, label: str = "label", features: str = "features",
                      keys: list[str] | None = None) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)); fewer than 2 clusters -> null.

    B comes from the k centroid rows alone (the overall mean is their
    size-weighted mean); W is one pass of the points against their centroid.
    With ``keys`` every labelling (e.g. every k of a sweep) is scored in the
    same two passes.
    """
    keys = keys or []
    # k rows per key, used twice: written once so the points are read in two passes only
    cen = cluster_centroids(df, label, features, keys).checkpoint(eager=True)
    cs = cen.groupBy(*keys).agg(F.collect_list(F.struct("n", "centroid")).alias("_c"))
    tot = F.aggregate("_c", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    dim = F.size(F.col("_c")[0]["centroid"])
    mu = F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.aggregate(
        "_c", F.lit(0.0), lambda acc, c: acc + c["n"] * c["centroid"][i]) / tot)
    bstat = cs.select(*keys, F.size("_c").alias("k_"), tot.alias("n_all"),
                      F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + c["n"] * F.aggregate(
                          F.zip_with(c["centroid"], mu, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                          lambda s, v: s + v)).alias("B"))
    w = within_dispersion(df, label, features, cen, keys)
    j = bstat.join(w, keys) if keys else bstat.crossJoin(w)   # one row per key on each side
    k, n = F.col("k_"), F.col("n_all")
    # W = 0 (every point on its centroid) scores 1.0 by convention
    ch = (F.when(k <= 1, F.lit(None).cast("double"))
           .when(F.col("inertia") == 0, F.lit(1.0))
           .otherwise((F.col("B") / (k - 1)) / (F.col("inertia") / (n - k))))
    return j.select(*keys, ch.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str = "label", features: str = "features",
                   keys: list[str] | None = None) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j).

    s_i = mean distance of cluster i's points to its centroid.  The k
    per-cluster rows of each key are gathered into one array and the k x k
    ratios are computed with higher-order functions (no self-join).
    """
    keys = keys or []
    x = with_centroids(df, label, features, None, keys)
    s = x.groupBy(*keys, label).agg(F.avg(euclidean(F.col(features), F.col("centroid"))).alias("s"),
                                    F.first("centroid").alias("c"))
    arr = s.groupBy(*keys).agg(F.collect_list(F.struct(F.col(label).alias("i"), "s", "c")).alias("_a"))

    def worst(a):
        # coinciding centroids divide by +inf (ratio 0), as in the usual definition
        others = F.filter("_a", lambda b: b["i"] != a["i"])
        r = F.transform(others, lambda b: F.when(euclidean(a["c"], b["c"]) > 0,
                                                   (a["s"] + b["s"]) / euclidean(a["c"], b["c"]))
                        .otherwise(F.lit(0.0)))
        return F.array_max(r)

    per = F.transform("_a", worst)
    all_s0 = F.aggregate("_a", F.lit(True), lambda acc, b: acc & (b["s"] == 0))
    pair_d = F.flatten(F.transform("_a", lambda a: F.transform(
        F.filter("_a", lambda b: b["i"] != a["i"]), lambda b: euclidean(a["c"], b["c"]))))
    all_d0 = F.aggregate(pair_d, F.lit(True), lambda acc, x: acc & (x == 0))
    mean = F.aggregate(per, F.lit(0.0), lambda acc, v: acc + v) / F.size(per)
    return arr.select(*keys, F.when(all_s0 | all_d0, F.lit(0.0)).otherwise(mean).alias("davies_bouldin"))


def minmax_scale(df: DataFrame, features: str = "features", out: str | None = None) -> DataFrame:
    """per-dimension min-max scaling to [0, 1]; a constant dimension -> 0."""
    out = out or features
    st = (to_vector(df, features).agg(Summarizer.metrics("min", "max").summary(F.col("vec")).alias("s"))
          .select(vector_to_array(F.col("s.min")).alias("_lo"), vector_to_array(F.col("s.max")).alias("_hi")))
    j = df.crossJoin(F.broadcast(st))   # one-row statistics
    scaled = F.zip_with(F.col(features), F.zip_with("_lo", "_hi", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))),
                        lambda x, r: F.when(r["hi"] > r["lo"], (x - r["lo"]) / (r["hi"] - r["lo"])).otherwise(F.lit(0.0)))
    return j.withColumn(out, scaled).drop("_lo", "_hi")


# -- silhouettes ---------------------------------------------------------------------------

def _cluster_table(df: DataFrame, label: str, features: str, keys: list[str], squared: bool) -> DataFrame:
    """(keys, clusters): per key one array of (label, n, centroid, spread); the spread is the
    mean squared or plain distance to the centroid.  Labels x keys rows, written once."""
    x = with_centroids(df, label, features, None, keys)
    far = squared_distance(F.col(features), F.col("centroid"))
    rows = x.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.first("centroid").alias("centroid"),
                                       F.avg(far if squared else F.sqrt(far)).alias("spread"))
    cluster = F.struct(F.col(label).alias("label"), "n", "centroid", "spread")
    return rows.groupBy(*keys).agg(F.collect_list(cluster).alias("clusters")).checkpoint(eager=True)


def _beside(df: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the cluster array of its key, broadcast if it is small enough."""
    size = F.aggregate("clusters", F.lit(0), lambda n, c: n + F.size(c["centroid"]))
    numbers = clusters.agg(F.sum(size)).first()[0] or 0
    side = F.broadcast(clusters) if numbers <= MAX_BROADCAST_NUMBERS else clusters
    return df.join(side, keys) if keys else df.crossJoin(side)          # without keys: one row


def _silhouette_value(n, a, b):
    """(b - a) / max(a, b); singleton -> 0, no other cluster -> null, both 0 -> 0."""
    most = F.greatest(a, b)
    return F.when(n <= 1, 0.0).when(b.isNull(), None).when(most == 0, 0.0).otherwise(safe_div(b - a, most)).cast("double")


def silhouette_squared(df: DataFrame, label: str = "label", features: str = "features",
                       keys: list[str] | None = None) -> DataFrame:
    """Mean silhouette of squared Euclidean distances over all rows, per key.

    A statistic of its own, not M15: the mean squared distance of a row to a cluster is its
    squared distance to the centroid plus the cluster's mean squared spread, so each row
    meets the clusters only and the cost is linear in the rows.
    """
    keys = keys or []
    x = _beside(df.select(*keys, label, features), _cluster_table(df, label, features, keys, True), keys)
    apart = lambda c: squared_distance(F.col(features), c["centroid"]) + c["spread"]
    own = F.filter("clusters", lambda c: c["label"] == F.col(label))[0]
    others = F.transform(F.filter("clusters", lambda c: c["label"] != F.col(label)), apart)
    x = x.select(*keys, own["n"].alias("n"), F.when(own["n"] > 1, apart(own) * own["n"] / (own["n"] - 1)).alias("a"),
                 F.array_min(others).alias("b"))
    s = _silhouette_value(F.col("n"), F.col("a"), F.col("b"))
    return x.groupBy(*keys).agg(F.avg(s).alias("silhouette_squared"))


def _chunks(queries: int, refs: int) -> Iterator[slice]:
    """Runs of query rows that make at most ``CHUNK_NUMBERS`` pairs with the references."""
    step = max(1, CHUNK_NUMBERS // max(1, refs))
    return (slice(start, start + step) for start in range(0, queries, step))


def _vectors(rows: pa.Table, column: str) -> np.ndarray:
    """The vectors of an Arrow list column as a matrix, without an object per row."""
    values = rows.column(column).combine_chunks()
    if values.null_count:
        raise ValueError("a row has no vector")
    return np.asarray(values.flatten(), float).reshape(rows.num_rows, -1)


def _distance_sums(ref: np.ndarray, weight: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Weighted sum of the distances of each query row of a tile to its references."""
    norm, sums = (ref * ref).sum(axis=1), np.empty(len(query))
    step = max(1, NEAR_NUMBERS // ref.shape[1])
    for part in _chunks(len(query), len(ref)):
        q = query[part]
        own = (q * q).sum(axis=1)[:, None]
        d2 = q @ ref.T
        d2 *= -2.0
        d2 += own + norm[None, :]
        # the expanded square leaves rounding noise near distance 0: those pairs are taken from the differences
        i, j = np.nonzero(d2 < 1e-9 * (1.0 + own))
        for at in range(0, len(i), step):
            near = slice(at, at + step)
            d2[i[near], j[near]] = ((q[i[near]] - ref[j[near]]) ** 2).sum(axis=1)
        sums[part] = np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2) @ weight
    return sums


def _distinct_silhouettes(rows: DataFrame, label: str, features: str, keys: list[str], tile_rows: int) -> DataFrame:
    """(keys, label, features, _w, s) of every distinct (label, vector) and how many rows it stands for.

    Equal vectors of a cluster collapse to one row with a weight.  By the triangle
    inequality the mean distance of a row to a cluster lies between its distance to the
    centroid and that plus the cluster's mean spread; clusters that cannot be the nearest
    other one are skipped, and a pair of clusters that no row needs is not dealt at all.
    What is left meets in tiles of a block of one cluster's rows against a block of a cluster.
    """
    clusters = _cluster_table(rows, label, features, keys, False)
    points = (rows.groupBy(*keys, F.col(label).alias("_l"), F.col(features).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
              .withColumn("_p", F.monotonically_increasing_id()).checkpoint(eager=True))

    far = lambda c: euclidean(F.col("_v"), c["centroid"])
    others = F.filter("clusters", lambda c: c["label"] != F.col("_l"))
    nearest = F.array_min(F.transform(others, lambda c: far(c) + c["spread"]))
    # a little slack, so that rounding never skips the nearest cluster
    needed = F.filter("clusters", lambda c: (c["label"] == F.col("_l")) | (far(c) <= F.col("_near") * (1 + 1e-9) + 1e-12))
    asked = _beside(points, clusters, keys).withColumn("_near", nearest)
    asked = asked.select(*keys, "_p", "_l", "_v", "_w", F.transform(needed, lambda c: c["label"]).alias("_needed"))
    asked = asked.checkpoint(eager=True)

    blocks = points.groupBy(*keys, "_l").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_blocks"))
    pairs = asked.select(*keys, "_l", F.explode("_needed").alias("_c")).distinct()
    pairs = pairs.join(blocks.withColumnsRenamed({"_blocks": "_of_l"}), [*keys, "_l"])
    pairs = pairs.join(blocks.withColumnsRenamed({"_l": "_c", "_blocks": "_of_c"}), [*keys, "_c"]).checkpoint(eager=True)
    own_block = lambda n: F.pmod(F.xxhash64("_p"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = [*keys, "_l", "_c", "_i", "_j"]
    query = (asked.withColumn("_c", F.explode("_needed")).join(pairs, [*keys, "_l", "_c"])
             .withColumn("_i", own_block("_of_l")).withColumn("_j", each("_of_c"))
             .select(*tile, "_p", "_v", "_w", F.lit(True).alias("_q")))
    ref = (points.withColumnRenamed("_l", "_c").join(pairs, [*keys, "_c"])
           .withColumn("_j", own_block("_of_c")).withColumn("_i", each("_of_l"))
           .select(*tile, "_p", "_v", "_w", F.lit(False).alias("_q")))
    kind = dict(points.dtypes)
    shape = ", ".join([f"`{k}` {kind[k]}" for k in keys] + [f"_p long, _c {kind['_l']}, _d double"])

    def run(rows: pa.Table) -> pa.Table:
        asking = rows.column("_q")
        found, there = rows.filter(asking), rows.filter(pc.invert(asking))
        sums = np.zeros(found.num_rows)
        if found.num_rows and there.num_rows:
            sums = _distance_sums(_vectors(there, "_v"), np.asarray(there.column("_w"), float), _vectors(found, "_v"))
        return found.select([*keys, "_p", "_c"]).append_column("_d", pa.array(sums))

    sums = (query.unionByName(ref).groupBy(*tile).applyInArrow(run, shape)
            .groupBy(*keys, "_p", "_c").agg(F.sum("_d").alias("_d")))
    sizes = points.groupBy(*keys, F.col("_l").alias("_c")).agg(F.sum("_w").alias("_n"))
    sums = sums.join(sizes, [*keys, "_c"]).groupBy(*keys, "_p").agg(F.collect_list(F.struct("_c", "_n", "_d")).alias("_sums"))
    own = F.filter("_sums", lambda c: c["_c"] == F.col("_l"))[0]
    rest = F.filter("_sums", lambda c: c["_c"] != F.col("_l"))
    s = _silhouette_value(own["_n"], own["_d"] / (own["_n"] - 1), F.array_min(F.transform(rest, lambda c: c["_d"] / c["_n"])))
    return points.join(sums, [*keys, "_p"]).select(*keys, F.col("_l").alias(label), F.col("_v").alias(features), "_w", s.alias("s"))


def _sampled(df: DataFrame, columns: list[str], id_col: str, max_n: int | None, salt: str) -> DataFrame:
    rows = df.select(*columns)
    if max_n is None:
        return rows
    return rows.join(sample_n(df.select(id_col).distinct(), max_n, id_col, salt), id_col, "left_semi")


def silhouette_points(df: DataFrame, label: str = "label", features: str = "features",
                      id_col: str = "id", max_n: int | None = None, salt: str = "silhouette",
                      keys: list[str] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """M15 per point: (keys, id, label, s) with Euclidean distances; singleton -> 0,
    a point at distance 0 from its own and the next cluster -> 0, one label only -> null.

    Uses every row unless the caller asks for a hash sample of ``max_n`` ids.  With
    ``keys`` (several labellings of the same rows) every labelling is scored in the same job.
    """
    keys = keys or []
    rows = _sampled(df, [*keys, id_col, label, features], id_col, max_n, salt)
    found = _distinct_silhouettes(rows, label, features, keys, tile_rows).drop("_w")
    return rows.join(found, [*keys, label, features]).select(*keys, id_col, label, "s")


def silhouette(df: DataFrame, label: str = "label", features: str = "features", id_col: str = "id",
               max_n: int | None = None, salt: str = "silhouette", keys: list[str] | None = None,
               tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean Euclidean silhouette over all rows (or the sample asked for), per key."""
    keys = keys or []
    rows = _sampled(df, [*keys, id_col, label, features], id_col, max_n, salt)
    found = _distinct_silhouettes(rows, label, features, keys, tile_rows)
    weight = F.when(F.col("s").isNotNull(), F.col("_w"))
    return found.groupBy(*keys).agg(safe_div(F.sum(F.col("s") * F.col("_w")), F.sum(weight)).alias("silhouette"))


# -- replicate labelings --------------------------------------------------------------------

def signatures(rep_labels: DataFrame, id_col: str = "id", items: DataFrame | None = None) -> DataFrame:
    """(sig, w): the distinct arrays of (rep, label) and how many ids have them.

    ``items`` may name ids that no replicate has; their array is empty.  Items that every
    replicate labels alike are one row from here on.
    """
    entry = F.struct(F.col("rep"), F.col("label"))
    own = rep_labels.groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("sig"))
    if items is not None:
        own = items.select(id_col).distinct().join(own, id_col, "left")
        own = own.withColumn("sig", F.coalesce("sig", F.array().cast(dict(own.dtypes)["sig"])))
    return own.groupBy("sig").agg(F.count(F.lit(1)).alias("w"))


def _label_matrix(sigs: pa.Array, reps: dict, labels: dict) -> np.ndarray:
    """(rows x reps) label codes, -1 where a replicate lacks the row; both dicts take new values."""
    entries = sigs.flatten()
    row = np.repeat(np.arange(len(sigs)), np.asarray(sigs.value_lengths()))
    codes = [np.array([known.setdefault(v, len(known)) for v in entries.field(i).to_pylist()], np.int64)
             for i, known in ((0, reps), (1, labels))]
    out = np.full((len(sigs), max(1, len(reps))), -1, np.int64)
    out[row, codes[0]] = codes[1]
    return out


def consensus_pac(rep_labels: DataFrame, items: DataFrame, id_col: str = "id",
                  denominator: str = "all", low: float = 0.1, high: float = 0.9,
                  tile_rows: int = TILE_ROWS) -> DataFrame:
    """Proportion of ambiguous clustering from replicate labels.

    ``rep_labels`` (rep, id, label) lists the items sampled in each
    replicate with their label; ``items`` is the item universe.
    consensus(i, j) = #reps with the same label / #reps with both
    sampled (0 when never co-sampled); ambiguous = strictly inside
    (low, high).  denominator: 'all' -> n(n-1) ordered pairs; 'cosampled' ->
    ordered co-sampled pairs; 'cosampled_minus_n' -> that minus n, floor 1.
    Fewer than two items have no pairs: PAC 0.
    """
    return pac_of_signatures(signatures(rep_labels, id_col, items), denominator, low, high, tile_rows)


def pac_of_signatures(sigs: DataFrame, denominator: str = "all", low: float = 0.1, high: float = 0.9,
                      tile_rows: int = TILE_ROWS) -> DataFrame:
    """M20 of a weighted signature table (sig, w).

    Items with equal label arrays are one row, so the work goes with the distinct arrays:
    blocks of them meet in tiles (each pair of blocks once) and a tile returns one row
    of counts, weighted by the ordered item pairs behind a pair of arrays.
    """
    if denominator not in ("all", "cosampled", "cosampled_minus_n"):
        raise ValueError("denominator must be 'all', 'cosampled' or 'cosampled_minus_n'")
    rows = sigs.withColumn("_p", F.monotonically_increasing_id()).checkpoint(eager=True)
    size = rows.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("w"), F.lit(0)).alias("items")).first()
    blocks = max(1, -(-size["distinct"] // tile_rows))
    own = F.pmod(F.xxhash64("_p"), F.lit(blocks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)),
                        lambda t: F.struct(F.least(t, own).alias("_i"), F.greatest(t, own).alias("_j")))
    dealt = rows.select("sig", "w", "_p", own.alias("_b"), F.inline(tiles))

    def run(tile: pa.Table) -> pa.Table:
        reps, labels = {}, {}
        sig = tile.column("sig").combine_chunks()
        _label_matrix(sig, reps, labels)                       # all replicates of the tile are known first
        codes = _label_matrix(sig, reps, labels)
        w, p, b = (np.asarray(tile.column(c)) for c in ("w", "_p", "_b"))
        i, j = tile.column("_i")[0].as_py(), tile.column("_j")[0].as_py()
        query, ref = np.flatnonzero(b == i), np.flatnonzero(b == j)
        ambiguous = cosampled = 0
        there, ref_codes = (codes[ref] >= 0).astype(np.float32).T, np.ascontiguousarray(codes[ref].T)
        for part in _chunks(len(query), len(ref)):
            q = query[part]
            both = ((codes[q] >= 0).astype(np.float32) @ there).astype(np.int32)
            same = np.zeros_like(both)
            for r in range(codes.shape[1]):
                own_label = codes[q, r][:, None]
                same += (own_label == ref_codes[r][None, :]) & (own_label >= 0)
            consensus = np.where(both > 0, same / np.maximum(both, 1), 0.0)
            pairs = w[q][:, None] * (w[ref][None, :] - (p[q][:, None] == p[ref][None, :]))
            pairs = pairs * (1 if i == j else 2)               # (i, j) and (j, i)
            ambiguous += int(pairs[(consensus > low) & (consensus < high)].sum())
            cosampled += int(pairs[both > 0].sum())
        return pa.table({"ambiguous": [ambiguous], "cosampled": [cosampled]})

    agg = (dealt.groupBy("_i", "_j").applyInArrow(run, "ambiguous long, cosampled long")
           .agg(F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("ambiguous"),
                F.coalesce(F.sum("cosampled"), F.lit(0)).alias("cosampled")))
    n = F.lit(float(size["items"]))
    if denominator == "all":
        den = n * (n - F.lit(1.0))
    elif denominator == "cosampled":
        den = F.greatest(F.col("cosampled").cast("double"), F.lit(1.0))
    else:
        den = F.greatest(F.col("cosampled").cast("double") - n, F.lit(1.0))
    return agg.select(F.coalesce(safe_div(F.col("ambiguous").cast("double"), den), F.lit(0.0)).alias("pac"),
                      "ambiguous", "cosampled", F.lit(size["items"]).cast("int").alias("n"))


def pair_counts(sigs: DataFrame) -> DataFrame:
    """(rep1, rep2, l1, l2, n_ab), rep1 < rep2: contingency cells of every pair of replicates
    from a signature table.

    A task turns its rows into a label matrix and counts each pair of columns; it sends one
    row per occurring cell, at most reps^2 / 2 x labels^2, whatever the number of items.
    """
    entry = sigs.schema["sig"].dataType.elementType
    rep, label = entry["rep"].dataType.simpleString(), entry["label"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter = Counter()
        for batch in batches:
            reps, labels = {}, {}
            codes, w = _label_matrix(batch.column("sig"), reps, labels), np.asarray(batch.column("w"))
            names, places, k = list(labels), sorted(reps, key=lambda r: r), len(labels)
            for x, r1 in enumerate(places):
                for r2 in places[x + 1:]:
                    c1, c2 = codes[:, reps[r1]], codes[:, reps[r2]]
                    in_both = (c1 >= 0) & (c2 >= 0)
                    cell, at = np.unique(c1[in_both] * k + c2[in_both], return_inverse=True)
                    sums = np.bincount(at, weights=w[in_both], minlength=len(cell)).astype(np.int64)
                    for c, n in zip(cell.tolist(), sums.tolist()):
                        cells[r1, r2, names[c // k], names[c % k]] += n
        if cells:
            columns = [*zip(*cells), list(cells.values())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["rep1", "rep2", "l1", "l2", "n_ab"])

    arrow = to_arrow_schema(StructType([StructField("r", entry["rep"].dataType), StructField("l", entry["label"].dataType)]))
    kinds = [arrow.field("r").type] * 2 + [arrow.field("l").type] * 2 + [pa.int64()]
    shape = f"rep1 {rep}, rep2 {rep}, l1 {label}, l2 {label}, n_ab long"
    return sigs.mapInArrow(count, shape).groupBy("rep1", "rep2", "l1", "l2").agg(F.sum("n_ab").alias("n_ab"))


def replicate_pair_ari(rep_labels: DataFrame, id_col: str = "id") -> DataFrame:
    """M21 core: ARI of every pair of replicate labelings of the same items.

    One label array per item, counted as distinct arrays; no self-join of items.
    """
    return ari_of_counts(pair_counts(signatures(rep_labels, id_col)), "l1", "l2", ["rep1", "rep2"])


def bootstrap_ari(rep_labels: DataFrame, id_col: str = "id", ddof: int = 0) -> DataFrame:
    """Mean and sd (ddof 0 or 1) of pairwise replicate ARIs; < 2 reps -> (1, 0)."""
    return ari_summary(replicate_pair_ari(rep_labels, id_col), ddof)


def ari_summary(ari: DataFrame, ddof: int = 0) -> DataFrame:
    sd = F.stddev_pop("ari") if ddof == 0 else F.stddev_samp("ari")
    out = ari.agg(F.avg("ari").alias("mean_ari"), sd.alias("sd_ari"), F.count(F.lit(1)).alias("pairs"))
    return out.select(F.coalesce("mean_ari", F.lit(1.0)).alias("mean_ari"),
                      F.when(F.col("pairs") == 0, F.lit(0.0)).otherwise(F.coalesce("sd_ari", F.lit(0.0))).alias("sd_ari"))


def bootstrap_jaccard(draws: DataFrame, full_labels: DataFrame, id_col: str = "id", ddof: int = 0) -> DataFrame:
    """Per replicate, Jaccard of full-data labels vs refit labels on the
    resample (duplicates kept); mean and sd over replicates.

    ``draws``: (rep, draw, id, label) - the refit label of each drawn row.
    """
    j = draws.join(full_labels.select(id_col, F.col("label").alias("full_label")), id_col)
    per = jaccard_partition(j, "full_label", "label", ["rep"])
    sd = F.stddev_pop("jaccard") if ddof == 0 else F.stddev_samp("jaccard")
    return per.agg(F.avg("jaccard").alias("mean_jaccard"), sd.alias("sd_jaccard"))


def cross_source_ari(target: DataFrame, source_centers: list[list[float]],
                     target_centers: list[list[float]], features: str = "features") -> DataFrame:
    """ARI between labels transferred from the source model and the
    target's native labels (both as nearest-center assignments)."""
    x = assign_nearest(target, source_centers, features, "transfer")
    x = assign_nearest(x, target_centers, features, "native")
    return adjusted_rand(x, "transfer", "native")


def pair_ranking_loss(pairs: DataFrame, scale: float = 20.0, batch: str = "batch",
                      a: str = "a", b: str = "b", pos: str = "pos", tile_rows: int = 2048) -> DataFrame:
    """Symmetric in-batch ranking loss over stored vector pairs.

    S_ij = scale * a_i . b_j within a batch; loss = mean over rows and over
    columns of logsumexp - diagonal, averaged.  ``pos`` tells the pairs of a batch apart.

    A batch meets itself in tiles of two blocks of about ``tile_rows`` pairs: one matrix
    product per tile, which returns for each row and column the mergeable state of its
    log-sum-exp (largest score, sum of exp(score - largest)).  One pass over the pairs.
    """
    rows = pairs.select(F.col(batch).alias("_batch"), F.col(pos).alias("_pos"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    sizes = rows.groupBy("_batch").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("_pos"), F.col("_blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = rows.join(sizes, "_batch")
    left = rows.select("_batch", "_pos", F.col("_a").alias("_v"), own.alias("_i"), each.alias("_j"), F.lit(True).alias("_row"))
    right = rows.select("_batch", "_pos", F.col("_b").alias("_v"), each.alias("_i"), own.alias("_j"), F.lit(False).alias("_row"))
    kind = dict(rows.dtypes)
    shape = f"_batch {kind['_batch']}, _row boolean, _pos {kind['_pos']}, high double, mass double, diag double"

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        x, y = tile[tile["_row"]], tile[~tile["_row"]]
        if x.empty or y.empty:
            return tile.iloc[:0][["_batch", "_row", "_pos"]].assign(high=0.0, mass=0.0, diag=0.0)
        matrix = lambda part: np.stack(part["_v"].map(np.asarray).to_numpy()).astype(float)
        scores = scale * matrix(x) @ matrix(y).T
        same = x["_pos"].to_numpy()[:, None] == y["_pos"].to_numpy()[None, :]
        out = []
        for part, s, d in ((x, scores, same), (y, scores.T, same.T)):
            high = s.max(axis=1)
            out.append(part[["_batch", "_row", "_pos"]].assign(high=high, mass=np.exp(s - high[:, None]).sum(axis=1),
                                                               diag=np.where(d.any(axis=1), (s * d).sum(axis=1), np.nan)))
        return pd.concat(out)

    state = left.unionByName(right).groupBy("_batch", "_i", "_j").applyInPandas(run, shape)
    states = state.groupBy("_batch", "_row", "_pos").agg(
        F.max("high").alias("high"), F.collect_list(F.struct("high", "mass")).alias("parts"),
        F.sum(F.when(F.isnan("diag"), F.lit(0.0)).otherwise(F.col("diag"))).alias("diag"))
    mass = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["mass"] * F.exp(p["high"] - F.col("high")))
    loss = F.col("high") + F.log(mass) - F.col("diag")
    return states.agg(F.avg(F.when(F.col("_row"), loss)).alias("r"), F.avg(F.when(~F.col("_row"), loss)).alias("c")).select(
        ((F.col("r") + F.col("c")) / 2.0).alias("loss"))
