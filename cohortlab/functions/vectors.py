"""Dense-vector arithmetic on ``array<double>`` columns.

Vectors stay ``array<double>`` at rest; these higher-order expressions run
JVM-side.  ``VectorUDT`` is used only at the Spark ML boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    """Euclidean distance between two equal-length arrays."""
    return F.sqrt(squared_distance(a, b))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def to_double_array(c) -> Column:
    return _c(c).cast("array<double>")
