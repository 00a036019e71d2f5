"""Small numeric Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(c) -> Column:
    """Round half up at 1e-6 the same way in every engine.

    ``round()`` differs at ties between engines; ``floor(x*1e6+0.5)/1e6``
    does not.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def comb2(n) -> Column:
    """n*(n-1)/2 in double (no ANSI overflow for large n)."""
    n = F.col(n) if isinstance(n, str) else n
    n = n.cast("double")
    return n * (n - F.lit(1.0)) / F.lit(2.0)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (no ANSI divide-by-zero error)."""
    return F.when(b != 0, a / b)
