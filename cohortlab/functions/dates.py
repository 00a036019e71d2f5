"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(c) -> Column:
    """Timestamps (incl. timestamp_ntz) and dates to DATE."""
    return _c(c).cast("date")


def add_years(c, years: int) -> Column:
    """date + N years; Feb-29 maps to Feb-28 in a non-leap target year."""
    return F.add_months(_c(c), 12 * int(years))


def earliest(*cols) -> Column:
    """Earliest non-null date (``least`` skips nulls)."""
    return F.least(*[_c(c) for c in cols])


def elapsed_days(end, start) -> Column:
    """Calendar days from start to end (no daylight-saving artefacts)."""
    return F.datediff(_c(end), _c(start))


def age_years(at, dob) -> Column:
    """Age in mean Gregorian years (365.2425 days)."""
    return F.datediff(_c(at), _c(dob)) / F.lit(365.2425)


def parse_date(c, fmt: str = "dd/MM/yyyy") -> Column:
    """Text date to DATE; unparsable text gives null instead of an error."""
    return F.try_to_date(_c(c), fmt)
