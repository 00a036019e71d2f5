"""Portable hashing for splits, folds, samples and bootstrap draws.

``randomSplit`` / ``rand`` depend on partitioning and on the engine; every
random choice in the library instead uses the first 60 bits of
``md5(id || ':' || salt)``.  The same number is produced by any engine that
has md5 (DuckDB: ``('0x'||substr(md5(id||':'||salt),1,15))::BIGINT``), which
makes splits, folds and samples reproducible and oracle-checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = float(2 ** 60)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def portable_hash(key, salt) -> Column:
    """60-bit hash of ``key:salt`` as BIGINT in [0, 2^60): wide enough that ``hash % n``
    reaches every row of a table evenly."""
    salt_col = salt if isinstance(salt, Column) else F.lit(str(salt))
    text = F.concat_ws(":", _as_col(key).cast("string"), salt_col.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unit_hash(key, salt) -> Column:
    """Portable hash scaled to [0, 1)."""
    return portable_hash(key, salt) / F.lit(HASH_RANGE)
