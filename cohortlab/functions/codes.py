"""Code and category expressions.

All of them are plain Column expressions (JVM side, inside whole-stage
codegen); none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the studied analysis for identical results.
# Category labels of the baseline table, in their natural order.
SMOKE_CATEGORIES = {1: "Smoker", 2: "Ex-Smoker", 3: "Non-Smoker"}
GENDER_CATEGORIES = {1: "Male", 2: "Female"}
REGION_CATEGORIES = {
    1: "North East", 2: "North West", 3: "Yorkshire And The Humber",
    4: "East Midlands", 5: "West Midlands", 6: "East of England",
    7: "South West", 8: "South Central", 9: "London",
    10: "South East Coast", 11: "Northern Ireland", 12: "Scotland",
    13: "Wales",
}
# BMI bands are right-closed: (0,18.5] (18.5,25] (25,30] (30,100].
BMI_BANDS = [(0.0, 18.5, "BMI underweight"), (18.5, 25.0, "BMI healthy"),
             (25.0, 30.0, "BMI overweight"), (30.0, 100.0, "BMI obesity")]
# Code families and their prefixes.
SEP = "SEP"
PROC_PREFIX = "PROC_"
BNF_PREFIX = "bnf_"
VTM_PREFIX = "vtm_"
VAL_PREFIX = "VAL_"
CODE_FAMILIES = ("icd", "proc", "med", "val", "all")
# Case definitions: name -> (system of the GP code list, hospital ICD-10 codes).
CASE_DEFINITIONS = {
    "PD": (None, ["G20", "G200"]),
    "AD": ("read", ["F00", "F000", "F001", "F002", "F009", "G30", "G300", "G301", "G308", "G309"]),
    "PARM": ("snomed", ["G20", "G21", "G210", "G211", "G212", "G213", "G214", "G218", "G219", "G22", "G230", "G231",
                        "G232", "G238", "G239", "G259", "G26", "G903"]),
}
# Symptom definitions: name -> system of the code list.
SYMPTOM_SYSTEMS = {
    "fall": "read", "language": "read", "memory": "read", "confusion": "read", "sleep": "read",
    "dementia": "snomed", "depression": "snomed", "constipation": "snomed", "mci": "snomed",
}
# Description special case applied before any lookup.
DESCRIPTION_SPECIAL_CASES = {
    "Other chronic obstructive pulmonary disease": "COPD",
}
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_dots(c) -> Column:
    """remove dots from ICD codes (``G30.1`` -> ``G301``)."""
    return F.regexp_replace(_c(c), r"\.", "")


def normalise_description_key(c) -> Column:
    """drop a ``DIA_``/``MED_`` prefix and cut ``bnf_`` codes to 8 chars."""
    s = F.regexp_replace(_c(c), r"^(DIA_|MED_)", "")
    return F.when(s.startswith(BNF_PREFIX), F.substring(s, 1, 8)).otherwise(s)


def group_code(c) -> Column:
    """F8: map a token to its reporting group; ``SEP`` maps to null.

    Rules in order: length 4 -> first 3 chars; ``PROC_`` -> first 8;
    ``SEP`` -> dropped; ``bnf_`` -> first 8; everything else unchanged.
    """
    c = _c(c)
    return (F.when(F.length(c) == 4, F.substring(c, 1, 3))
            .when(c.startswith(PROC_PREFIX), F.substring(c, 1, 8))
            .when(c == F.lit(SEP), F.lit(None).cast("string"))
            .when(c.startswith(BNF_PREFIX), F.substring(c, 1, 8))
            .otherwise(c))


def group_code_set(codes) -> Column:
    """F8 on an array: grouped codes per row as a set (nulls removed)."""
    return F.array_distinct(F.filter(F.transform(_c(codes), group_code),
                                     lambda x: x.isNotNull()))


def code_family_predicate(c, family: str) -> Column:
    """Membership test for a code family; unknown family is an error."""
    c = _c(c)
    if family == "icd":
        return F.length(c) == 3
    if family == "proc":
        return c.startswith(PROC_PREFIX)
    if family == "med":
        return c.startswith(BNF_PREFIX) | c.startswith(VTM_PREFIX)
    if family == "val":
        return c.startswith(VAL_PREFIX)
    if family == "all":
        return F.lit(True)
    raise ValueError(f"unknown code family {family!r}; expected one of {CODE_FAMILIES}")


def bmi_band(c) -> Column:
    """right-closed BMI bands; outside (0,100] or null -> null."""
    c = _c(c)
    expr = None
    for lo, hi, name in BMI_BANDS:
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def decode(c, mapping: dict) -> Column:
    """map literal lookup; unmatched -> null.  Uses a CASE chain."""
    c = _c(c)
    expr = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def safe_int(c) -> Column:
    """text/number to INT; dirty values become null."""
    return _c(c).try_cast("int")


WHITESPACE = "[ \t\n\r\f]+"


def text_tokens_normalised(c) -> Column:
    """F9 for text cells: commas to blanks, whitespace runs to one blank,
    trimmed, null -> ''."""
    s = F.regexp_replace(F.coalesce(_c(c), F.lit("")), ",", " ")
    return F.trim(F.regexp_replace(s, WHITESPACE, " "))


def title_unless_upper(c) -> Column:
    """title case unless the label is all upper case; cut to 50 chars."""
    c = _c(c)
    titled = F.when(c == F.upper(c), c).otherwise(F.initcap(c))
    return F.substring(titled, 1, 50)


def one_hot(c, values: list, prefix: str | None = None) -> list[Column]:
    """0/1 indicator columns for known values (null -> all zeros)."""
    c = _c(c)
    name = (lambda v: f"{prefix}_{v}") if prefix else (lambda v: str(v))
    return [F.coalesce(c == F.lit(v), F.lit(False)).cast("int").alias(name(v)) for v in values]


def shift_label(c, by: int = 1) -> Column:
    """shift 0-based cluster labels to 1-based."""
    return (_c(c) + F.lit(by)).cast("int")
