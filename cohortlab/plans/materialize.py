"""Shared intermediate tables, written once per application as bucketed Parquet.

Cohort, outcomes and sequences feed many downstream analyses.  Each of them is a stage:
a Parquet table in the folder that ``spark.checkpoint.dir`` names, so a lost executor
re-reads files instead of recomputing the upstream joins, and later plans read only the
columns they use.  Patient-keyed stages are bucketed and sorted on their key with one
file per bucket; joins and aggregations among them on that key need no shuffle.

A stage is keyed by its name, its parameters and a fingerprint of the input files (path,
length, modification time).  When an input file changes, the stage is built anew and the
old table and its files are removed; ``clear`` removes all stages of the application.  A
frame over a removed stage can no longer be read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlab.session import ensure_checkpoint_dir

#: (application, name and parameters) -> (fingerprint, table, path)
_STAGES: dict[tuple, tuple[str, str, str]] = {}


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Small constant table as a SQL VALUES relation (size known to the
    optimizer, so joins against it broadcast)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    vals = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {vals} AS t({', '.join(columns)})")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def input_fingerprint(spark: SparkSession, folder: str) -> str:
    """Digest of the names, lengths and modification times of the tables' files below
    ``folder`` (a listing; no file is opened)."""
    fs, path = _file_system(spark, folder)
    found = []
    for table in fs.listStatus(path):
        for status in fs.listStatus(table.getPath()) if table.isDirectory() else [table]:
            found.append(re.sub(r"access_time=\d+", "", str(status)))
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def materialized(spark: SparkSession, key: tuple, build: Callable[[], DataFrame],
                 partition_by: str | None = None) -> DataFrame:
    """The stage of ``key`` = (name, input folder, parameters ...), built if it does not
    stand or if the files of the input folder have changed since.

    With ``partition_by`` the table is bucketed on that column into
    ``spark.sql.shuffle.partitions`` buckets.
    """
    ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    fingerprint = input_fingerprint(spark, key[1])
    known = _STAGES.get((app, *key))
    if known is None or known[0] != fingerprint:
        digest = hashlib.md5(repr((app, key, fingerprint)).encode()).hexdigest()
        table = f"stage_{key[0]}_{digest}"
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}"
        write_stage(build(), table, path, partition_by)
        if known is not None:
            remove_stage(spark, *known[1:])
        _STAGES[(app, *key)] = known = fingerprint, table, path
    return spark.table(known[1])


def write_stage(df: DataFrame, table: str, path: str, partition_by: str | None = None) -> None:
    """``df`` as the Parquet table ``table`` at ``path``; with ``partition_by`` one sorted
    file per bucket."""
    if partition_by is None:
        df.write.option("path", path).saveAsTable(table)
        return
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, partition_by).write.bucketBy(buckets, partition_by).sortBy(partition_by)
     .option("path", path).saveAsTable(table))


def remove_stage(spark: SparkSession, table: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    fs, folder = _file_system(spark, path)
    fs.delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Remove all stages of this application and their files."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STAGES if k[0] == app]:
        remove_stage(spark, *_STAGES.pop(key)[1:])
