"""Event harmonisation, code-list filters and description lookups.

P1 harmonise_events, P5 prefix_code, P7 filter_codes, P8 case_codes,
P9 symptom_codes, J13 describe_codes, J14 dictionary lookup.

Code lists stay DataFrames end to end (never collected into an ``isin``
literal).  Joins against them are left unhinted: Spark broadcasts them when
their measured size is under ``autoBroadcastJoinThreshold`` (and AQE
re-checks at runtime), otherwise it shuffles - a size-checked broadcast with
a fallback for large code lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.codes import (CASE_DEFINITIONS, DESCRIPTION_SPECIAL_CASES, SYMPTOM_SYSTEMS, decode,
                                       normalise_description_key)


def harmonise_events(diagnoses: DataFrame) -> DataFrame:
    """One ``code`` column - GP rows keep ``medcode``, hospital rows ``ICD``.

    One projection with CASE instead of two filtered scans and a union.
    """
    code = (F.when(F.col("source") == "CPRD", F.col("medcode"))
            .when(F.col("source") == "HES", F.col("ICD")))
    return (diagnoses.where(F.col("source").isin("CPRD", "HES"))
            .select("patid", "eventdate", code.alias("code")))


def prefix_code(events: DataFrame, prefix: str, col: str = "code") -> DataFrame:
    """P5: prepend a family prefix (e.g. ``PROC_``) to a code column."""
    return events.withColumn(col, F.concat(F.lit(prefix), F.col(col)))


def union_event_sources(*frames: DataFrame) -> DataFrame:
    """U1/U2 + P6: union of (patid, eventdate, code) sources by name, nulls dropped."""
    out = None
    for f in frames:
        f = f.select("patid", "eventdate", "code")
        out = f if out is None else out.unionByName(f)
    return out.dropna(how="any")


def filter_codes(events: DataFrame, codes: DataFrame, col: str = "code",
                 codes_col: str = "code") -> DataFrame:
    """Keep events whose code is in a code-list DataFrame (semi join)."""
    keys = codes.select(F.col(codes_col).alias(col)).where(F.col(col).isNotNull())
    return events.join(keys, col, "left_semi")


def case_codes(code_list: DataFrame, dictionary: DataFrame, name: str,
               icd_codes: DataFrame, system_col: str = "system") -> DataFrame:
    """Case definition -> distinct codes (GP medcodes + hospital ICD).

    ``code_list`` rows (system, name, code) select dictionary entries by
    Read code (system 'read') or SNOMED code (system 'snomed'); the matched
    medcodes are unioned with the ICD list and de-duplicated.  An empty ICD
    list is an error, as in the case definition it mirrors.
    """
    if icd_codes.limit(1).count() == 0:
        raise ValueError("case definition needs at least one ICD-10 code")
    wanted = code_list.where(F.col("name") == name)
    read = dictionary.join(
        wanted.where(F.col(system_col) == "read").select(F.col("code").alias("readcode")),
        "readcode", "left_semi")
    snomed = dictionary.join(
        wanted.where(F.col(system_col) == "snomed").select(F.col("code").alias("Snomedcode")),
        "Snomedcode", "left_semi")
    med = read.select(F.col("medcode").cast("string").alias("code")).unionByName(
        snomed.select(F.col("medcode").cast("string").alias("code")))
    icd = icd_codes.select(F.col("code").cast("string").alias("code"))
    return med.unionByName(icd).distinct()


def named_case_codes(code_list: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """P8 for a definition of ``CASE_DEFINITIONS``: its ICD-10 codes and the GP codes that the
    dictionary has for its code list (rows (system, name, code)), by the definition's system.
    An unknown name is an error.  Nothing runs while the plan is built."""
    if name not in CASE_DEFINITIONS:
        raise ValueError(f"unknown case definition {name!r}; expected one of {sorted(CASE_DEFINITIONS)}")
    system, icd = CASE_DEFINITIONS[name]
    codes = dictionary.sparkSession.createDataFrame([(c,) for c in icd], "code string")
    if system is not None:
        wanted = code_list.where((F.col("name") == name) & (F.col("system") == system))
        codes = codes.unionByName(_dictionary_codes(wanted, dictionary).select(F.col("medcode").alias("code")))
    return codes.distinct()


def named_symptom_codes(code_list: DataFrame, dictionary: DataFrame) -> DataFrame:
    """P9 for all nine symptoms: (name, medcode), each by the system of ``SYMPTOM_SYSTEMS``;
    rows of another name or system take no part."""
    own = F.create_map(*[F.lit(x) for pair in SYMPTOM_SYSTEMS.items() for x in pair])
    return _dictionary_codes(code_list.where(F.col("system") == F.try_element_at(own, F.col("name"))), dictionary)


def _dictionary_codes(wanted: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, medcode) of the dictionary entries that the list's Read or SNOMED codes name."""
    entries = dictionary.select(F.col("medcode").cast("string").alias("medcode"), F.inline(F.array(
        F.struct(F.lit("read").alias("system"), F.col("readcode").cast("string").alias("code")),
        F.struct(F.lit("snomed").alias("system"), F.col("Snomedcode").cast("string").alias("code")))))
    return wanted.join(entries, ["system", "code"]).select("name", "medcode").distinct()


def symptom_codes(code_list: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every (symptom, system) definition in one pass -> (name, medcode)."""
    read = (code_list.where(F.col("system") == "read")
            .join(dictionary, F.col("code") == F.col("readcode")))
    snomed = (code_list.where(F.col("system") == "snomed")
              .join(dictionary, F.col("code") == F.col("Snomedcode")))
    cols = [F.col("name"), F.col("medcode").cast("string").alias("medcode")]
    return read.select(*cols).unionByName(snomed.select(*cols)).distinct()


def dedupe_descriptions(descriptions: DataFrame, order_col: str = "line_no") -> DataFrame:
    """Description map keyed by normalised source code; last line wins."""
    d = descriptions.select(normalise_description_key("source").alias("key"), "target", order_col)
    return d.groupBy("key").agg(F.max_by("target", order_col).alias("target"))


def longest_prefix(codes: DataFrame, systems: DataFrame, col: str = "code") -> DataFrame:
    """Code-system lookup: (code, description, system) of every distinct code that a system knows.

    ``systems`` has (system, prefix, priority, description).  The system with the least
    priority that has any prefix of the code answers, with its longest one (equal ones:
    the first system and description by name).  Codes meet the dictionary in one join on
    their own prefixes, as many rows a code as it has characters.
    """
    distinct = codes.select(F.col(col).cast("string").alias(col)).where(F.length(col) > 0).distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length(col)), lambda n: F.substring(F.col(col), F.lit(1), n))
    hits = distinct.select(col, F.explode(cuts).alias("prefix")).join(systems, "prefix")
    order = F.struct("priority", (-F.length("prefix")).alias("length"), "system", "description")
    best = hits.groupBy(col).agg(F.min(order).alias("best"))
    return best.select(col, "best.description", "best.system")


def describe_codes(codes: DataFrame, descriptions: DataFrame, col: str = "code",
                   fallback: DataFrame | None = None, order_col: str = "line_no", step: str | None = None) -> DataFrame:
    """Add ``description`` with the chain special case -> map -> fallback -> code.

    ``fallback`` is an optional (code, description) table, as :func:`longest_prefix` of a
    code system gives it.  The description map is aggregated to one row per key
    before the join, so the join cannot fan out.  ``step`` names a column that tells
    which link of the chain answered: special, map, system or code.
    """
    m = dedupe_descriptions(descriptions, order_col)
    out = codes.join(m.withColumnRenamed("key", col), col, "left")
    chain = [decode(F.col(col), DESCRIPTION_SPECIAL_CASES), F.col("target")]
    if fallback is not None:
        fb = fallback.select(F.col("code").alias(col), F.col("description").alias("_fb"))
        out = out.join(fb, col, "left")
        chain.append(F.col("_fb"))
    chain.append(F.col(col))
    desc = F.coalesce(*chain)
    special = decode(desc, DESCRIPTION_SPECIAL_CASES)
    if step is not None:
        answered = F.when(F.col("target").isNotNull(), "map")
        answered = answered if fallback is None else answered.when(F.col("_fb").isNotNull(), "system")
        out = out.withColumn(step, F.when(special.isNotNull(), "special").otherwise(answered.otherwise("code")))
    desc = F.coalesce(special, desc)
    return out.withColumn("description", desc).drop("target", "_fb")


def non_overlapping_join(left: DataFrame, right: DataFrame, key: str = "patid", how: str = "inner") -> DataFrame:
    """Join only the right-side columns absent on the left (plus the key)."""
    cols = [c for c in right.columns if c not in left.columns and c != key]
    return left.join(right.select(key, *cols), key, how)


def with_row_id(df: DataFrame, col: str = "row_num") -> DataFrame:
    """Unique (not dense, not stable across re-partitioning) row id."""
    return df.withColumn(col, F.monotonically_increasing_id())
