"""Outcomes and survival.

M1 mortality_outcome, M2 hospital_outcome (P19, F6, P7, J7-J9, A3),
M29 kaplan_meier (W4), W2 relabel_by_outcome, A7 mean_by_label.

Survival curves aggregate to (label, time) before any window, so the window
runs over at most (#labels x #distinct follow-up days) rows - independent of
the number of patients.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.codes import strip_dots
from cohortlab.functions.dates import add_years, elapsed_days, earliest
from cohortlab.operators.codes import filter_codes


def mortality_outcome(cohort: DataFrame, years: int = 5, index_col: str = "index_date") -> DataFrame:
    """M1: all-cause mortality within ``years`` after the index date.

    dod null -> event 0 at least(enddate, end); dod > end -> 0 at end;
    index < dod <= end -> 1 at dod; dod <= index -> row dropped.
    One CASE over one scan.  ``time`` is calendar days from the index date.
    """
    idx, dod = F.col(index_col), F.col("dod")
    end = add_years(index_col, years)
    out = cohort.withColumn("endfollowupdate", end).where(dod.isNull() | (dod > idx))
    event = F.when(dod.isNotNull() & (dod <= F.col("endfollowupdate")), F.lit(1)).otherwise(F.lit(0))
    until = (F.when(dod.isNull(), earliest("enddate", "endfollowupdate"))
             .when(dod > F.col("endfollowupdate"), F.col("endfollowupdate"))
             .otherwise(dod))
    return (out.withColumn("event", event.cast("int"))
               .withColumn("time", elapsed_days(until, idx).cast("int")))


def hospital_admissions(admissions: DataFrame, stays: DataFrame, icd_codes: DataFrame,
                        min_duration: int = 1) -> DataFrame:
    """Admissions of at least ``min_duration`` days with a case ICD code.

    J7 is a composite-key join on (patid, spno); ``stays`` must hold one row
    per stay, otherwise the join fans out.
    """
    # the case-code filter runs first: it keeps a small fraction of the
    # admissions, so the composite-key join with stays shuffles only those
    case = filter_codes(admissions.withColumn("code", strip_dots("ICD")), icd_codes)   # F6 + P7
    st = stays.where(F.col("duration") >= min_duration).select("patid", "spno")        # P19
    return case.join(st, ["patid", "spno"], "inner").select("patid", "spno", "admidate")  # J7


def hospital_outcome(outcomes: DataFrame, admissions: DataFrame, stays: DataFrame,
                     icd_codes: DataFrame, index_col: str = "index_date",
                     min_duration: int = 1) -> DataFrame:
    """M2: first hospitalisation in (index, endfollowupdate].

    Expects ``outcomes`` from ``mortality_outcome`` (has endfollowupdate, dod).
    No admission -> event_hos 0 at least(dod, end); else 1 at the admission.
    """
    hes = hospital_admissions(admissions, stays, icd_codes, min_duration)
    win = outcomes.select("patid", F.col(index_col).alias("_idx"), "endfollowupdate")
    inwin = (hes.join(win, "patid", "inner")                                       # J8
                .where((F.col("admidate") > F.col("_idx")) & (F.col("admidate") <= F.col("endfollowupdate"))))
    first = inwin.groupBy("patid").agg(F.min("admidate").alias("first_admission"))  # A3
    out = outcomes.join(first, "patid", "left")                                     # J9
    has = F.col("first_admission").isNotNull()
    until = F.when(has, F.col("first_admission")).otherwise(earliest("dod", "endfollowupdate"))
    return (out.withColumn("event_hos", has.cast("int"))
               .withColumn("time_hos", elapsed_days(until, index_col).cast("int")))


def kaplan_meier(df: DataFrame, time_col: str = "time", event_col: str = "event",
                 by: str = "label") -> DataFrame:
    """Product-limit estimate per group.

    Returns (by, time, at_risk, events, censored, survival, cumulative) with
    cumulative = 1 - S(t) and a starting row (time 0, S = 1) per group when
    no subject has time 0.  One aggregation to (group, time), then windows
    over those rows only; the product window keeps S = 0 exact when every
    subject at risk has the event.
    """
    per_t = (df.groupBy(by, F.col(time_col).alias("time"))
               .agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.col(event_col).cast("long")).alias("events")))
    g = Window.partitionBy(by)
    w_desc = g.orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w_asc = g.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    curve = (per_t.withColumn("at_risk", F.sum("n").over(w_desc))
                  .withColumn("survival", F.product(F.lit(1.0) - F.col("events") / F.col("at_risk")).over(w_asc))
                  .withColumn("_tmin", F.min("time").over(g)))
    row = F.struct(F.col("time").cast("int").alias("time"), F.col("at_risk").cast("bigint").alias("at_risk"),
                   F.col("events").cast("bigint").alias("events"),
                   (F.col("n") - F.col("events")).cast("bigint").alias("censored"),
                   F.col("survival").alias("survival"))
    start = F.struct(F.lit(0).alias("time"), F.col("at_risk").cast("bigint").alias("at_risk"),
                     F.lit(0).cast("bigint").alias("events"), F.lit(0).cast("bigint").alias("censored"),
                     F.lit(1.0).alias("survival"))
    first = (F.col("time") == F.col("_tmin")) & (F.col("_tmin") > 0)
    rows = F.when(first, F.array(start, row)).otherwise(F.array(row))
    out = curve.select(by, F.inline(rows))
    return out.withColumn("cumulative", F.lit(1.0) - F.col("survival"))


def mean_by_label(df: DataFrame, value_col: str, by: str = "label", alias: str | None = None) -> DataFrame:
    """Mean of a value per label."""
    return df.groupBy(by).agg(F.avg(F.col(value_col).cast("double")).alias(alias or f"mean_{value_col}"))


def outcome_relabel_map(internal: DataFrame, by: str = "label", event_col: str = "event") -> DataFrame:
    """New label 1..k by ascending event rate of the internal set (ties by old label).

    The window runs over one row per label (k rows), never over patients.
    """
    rates = internal.groupBy(by).agg(F.avg(F.col(event_col).cast("double")).alias("_rate"))
    w = Window.orderBy("_rate", by)
    return rates.select(F.col(by).alias("_old"), F.row_number().over(w).cast("int").alias("_new"))


def apply_relabel(df: DataFrame, mapping: DataFrame, by: str = "label") -> DataFrame:
    """Old -> new label by the map's rows (one per label); an unknown label becomes null."""
    numbered = df.withColumnRenamed(by, "_old").join(mapping, "_old", "left")
    return numbered.select(*[F.col("_new").alias(by) if c == by else F.col(c) for c in df.columns])


def relabel_by_outcome(internal: DataFrame, *others: DataFrame, by: str = "label",
                       event_col: str = "event"):
    """Renumber clusters by internal mortality; same map for external sets."""
    mapping = outcome_relabel_map(internal, by, event_col)
    res = [apply_relabel(df, mapping, by) for df in (internal, *others)]
    return res[0] if not others else tuple(res)
