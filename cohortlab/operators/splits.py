"""Splits, folds, samples and bootstrap draws (M7, M9, O4, M21 draws, O5).

Every random choice is a function of the portable hash of an id, so
membership is a *filter* (no shuffle, no join) and identical across engines,
partitionings and re-runs after executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.hashing import HASH_RANGE, portable_hash, unit_hash

HASH_SPACE = int(HASH_RANGE)


def group_side(group_col: str = "pracid", frac: float = 0.8, salt: str = "split"):
    """Column: 'internal' when the group's hash falls under ``frac``."""
    return F.when(unit_hash(F.col(group_col), salt) < F.lit(frac), F.lit("internal")).otherwise(F.lit("external"))


def split_groups(df: DataFrame, group_col: str = "pracid", frac: float = 0.8,
                 salt: str = "split") -> DataFrame:
    """M7 report: distinct groups with their side (one row per group)."""
    return df.select(group_col).distinct().withColumn("side", group_side(group_col, frac, salt))


def split_by_group(df: DataFrame, group_col: str = "pracid", frac: float = 0.8,
                   salt: str = "split") -> tuple[DataFrame, DataFrame]:
    """Rows of internal and external groups; no group is on both sides.

    The side is a pure function of the group key, so this is two filters
    over the same scan instead of a distinct + randomSplit + two joins.
    """
    side = group_side(group_col, frac, salt)
    return df.where(side == "internal"), df.where(side == "external")


def kfold(df: DataFrame, id_col: str, k: int = 5, salt: str = "fold") -> DataFrame:
    """M9: add ``fold`` in 0..k-1 from the id hash (near-equal folds)."""
    return df.withColumn("fold", (portable_hash(F.col(id_col), salt) % k).cast("int"))


def sample_n(df: DataFrame, n: int, id_col: str, salt: str = "sample") -> DataFrame:
    """At most ``n`` rows without replacement - the n smallest id hashes.

    Exact and distributed: a hash threshold t (expected ~n + 5 sqrt(n)
    survivors) is applied as a filter in every task, and only the
    survivors are ranked.  A plain ``orderBy(h).limit(n)`` would funnel
    every partition's top n rows into one task (partitions x n rows).
    """
    import math
    h = portable_hash(F.col(id_col), salt)
    total = df.count()
    if total <= n:
        return df
    x = df.withColumn("_h", h)
    frac = min(1.0, (n + 5.0 * math.sqrt(n) + 10.0) / total)
    while True:
        cand = x.where(F.col("_h") < F.lit(int(frac * HASH_SPACE)))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2.0)     # rare: too few survivors, widen
    return cand.orderBy("_h", id_col).limit(n).drop("_h")


def dense_index(df: DataFrame, order_col: str, index_col: str = "idx",
                checkpoint: bool = True) -> DataFrame:
    """Dense 0-based index in ``order_col`` order, computed distributed.

    Range-partition on the key, sort within partitions, then add per-partition
    offsets (one row per partition, so the offset table is bounded by the
    partition count).  The partitioned frame is checkpointed so the counts
    and the index come from the same materialisation.
    """
    part = df.repartitionByRange(order_col).sortWithinPartitions(order_col)
    part = part.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        part = part.checkpoint(eager=True)
    counts = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window and the broadcast are bounded by the partition count
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = part.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return out.withColumn(index_col, (F.col("_off") + local).cast("bigint")).drop("_pid", "_mid", "_off")


def bootstrap_draws(indexed: DataFrame, n_rows: int, reps: int, frac: float = 1.0,
                    salt: str = "boot", index_col: str = "idx") -> DataFrame:
    """With-replacement draws: for rep r and draw j, row ``h(r:j) mod n``.

    ``indexed`` carries a dense 0..n-1 index.  The draw table is generated
    with ``range`` (distributed), joined to the index; duplicates are kept.
    Returns (rep, draw, <indexed columns>).
    """
    m = max(2, int(frac * n_rows))
    spark = indexed.sparkSession
    draws = spark.range(reps * m).select((F.col("id") / m).cast("long").alias("rep"),
                                         (F.col("id") % m).alias("draw"))
    key = F.concat_ws(":", F.col("rep").cast("string"), F.col("draw").cast("string"))
    draws = draws.withColumn(index_col, portable_hash(key, salt) % n_rows)
    return draws.join(indexed, index_col)


def resample_counts(df: DataFrame, reps: int, frac: float, id_col: str, salt: str = "boot") -> DataFrame:
    """``df`` with ``weights[r]``: how often replicate r of :func:`bootstrap_draws` draws the row.

    Draws are (replicate, row number) pairs that are counted before they meet the rows, so
    the rows themselves are never copied.  ``id_col`` must be distinct.
    """
    index = dense_index(df.select(id_col), id_col, "_idx")
    draws = bootstrap_draws(index.select("_idx"), df.count(), reps, frac, salt, "_idx")
    counts = draws.groupBy("_idx", "rep").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    counts = counts.groupBy("_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rep").cast("int"), "_n"))).alias("_by"))
    by_id = index.join(counts, "_idx").select(id_col, "_by")
    weight = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.coalesce(F.try_element_at("_by", r), F.lit(0)))
    return df.join(by_id, id_col, "left").withColumn("weights", weight).drop("_by")
