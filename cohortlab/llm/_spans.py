"""Positions of regular-expression matches as array columns (DataFrame functions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: higher-order functions that read an
    array for each element would otherwise compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers.  Appending copies an array, so sums are
    made in chunks and the chunks' offsets the same way."""
    def appended(xs: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def from_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.element_at(c, -1))
        return bound(appended(totals), lambda before: F.flatten(F.zip_with(
            chunks, F.slice(before, 1, F.size(chunks)),
            lambda c, b: F.transform(F.slice(c, 2, F.size(c) - 1), lambda x: x + b))))

    def chunked(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")),
                            lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))
        return bound(F.transform(parts, appended), from_chunks)

    return bound(numbers, chunked)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern, left to right without overlap, as
    array<struct<start: long, end: long, found: string>> in code points.

    The pieces between matches (``split`` with the same pattern) give the positions.
    """
    empty = F.expr("cast(array() AS array<struct<start: bigint, end: bigint, found: string>>)")

    def placed(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]
        lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        return F.zip_with(running_sums(lengths), found, lambda end, m: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(text, pattern, -1).alias("pieces"))
    return F.when(text.rlike(pattern), bound(both, placed)).otherwise(empty)
