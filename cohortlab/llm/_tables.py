"""Written tables in the shared folder: the lineage cut of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.hashing import HASH_RANGE, portable_hash
from cohortlab.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, library importable in the executors' Python."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later plans start from files that every executor sees, with column
    pruning and pushed filters; nothing upstream runs twice or again after a
    lost executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def hash_order(salt: str) -> Column:
    return portable_hash(F.col("doc_id"), salt)


def hash_thinned(rows: DataFrame, n: int, salt: str) -> DataFrame:
    """A fifth more than ``n`` of ``rows`` by the hash of doc_id (all, if there are
    fewer), so that taking the first ``n`` of them sorts and sends no more than that
    however many partitions there are."""
    share = 1.2 * n / max(1, rows.count())
    return rows if share >= 1 else rows.filter(hash_order(salt) < F.lit(int(share * HASH_RANGE)))
