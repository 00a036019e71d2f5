"""Cohort selection: index event, eligibility and attrition.

A1 index_event, A2 first_diagnosis, M3 prepare_demographics, P10
eligibility_steps, P11 attrition, M4 build_cohort.

Everything is one lazy plan: the patient-keyed joins shuffle once on
``patid`` and the per-patient aggregates are partial (map-side) so a patient
with a huge history never lands whole in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.dates import add_years
from cohortlab.operators.codes import filter_codes


@dataclass(frozen=True)
class CohortConfig:
    window_start: str = "2005-01-01"
    window_end: str = "2018-01-01"      # both ends inclusive
    least_age: int = 40
    greatest_age: int | None = None     # optional upper age limit
    least_years_registered: int = 1


def index_event(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Per patient the earliest case event and its code.

    ``min(struct(eventdate, code))`` gives the first date and, among codes
    on that date, the smallest - one partial aggregate, no window sort.
    """
    hits = filter_codes(events.select("patid", "eventdate", "code"), codes)
    first = hits.groupBy("patid").agg(F.min(F.struct("eventdate", "code")).alias("_f"))
    return first.select("patid", F.col("_f.eventdate").alias("index_date"), F.col("_f.code").alias("code"))


def first_diagnosis(events: DataFrame) -> DataFrame:
    """A2: earliest diagnosis of any code per patient."""
    return events.groupBy("patid").agg(F.min("eventdate").alias("first_diagnosis_date"))


def prepare_demographics(demographics: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """M3: add registration-plus-N-years and age-limit dates."""
    out = (demographics
           .withColumn("least_gp_register_date", add_years("regdate", cfg.least_years_registered))
           .withColumn("min_age_date", add_years("dob", cfg.least_age)))
    if cfg.greatest_age is not None:
        out = out.withColumn("max_age_date", add_years("dob", cfg.greatest_age))
    return out


def eligibility_steps(cfg: CohortConfig = CohortConfig()) -> list[tuple[str, Column]]:
    """P10: the ordered eligibility chain as (name, predicate)."""
    d = F.col("index_date")
    steps = [
        ("has_index_date", d.isNotNull()),
        ("index_in_window", (d >= F.lit(cfg.window_start).cast("date"))
         & (d <= F.lit(cfg.window_end).cast("date"))),
        ("before_enddate", d < F.col("enddate")),
        ("registered_long_enough", d > F.col("least_gp_register_date")),
        ("old_enough", d >= F.col("min_age_date")),
    ]
    if cfg.greatest_age is not None:
        steps.append(("young_enough", d < F.col("max_age_date")))
    return steps


def attrition(candidates: DataFrame, steps: list[tuple[str, Column]],
              start_name: str = "linked") -> DataFrame:
    """Rows left after each step, in ONE aggregation pass.

    Returns (step_no, step, n_remaining, n_removed).
    """
    aggs = [F.count(F.lit(1)).alias("s0")]
    cond = None
    for i, (_, c) in enumerate(steps, start=1):
        cond = c if cond is None else (cond & c)
        aggs.append(F.count(F.when(cond, 1)).alias(f"s{i}"))
    counts = candidates.agg(*aggs)
    names = [start_name] + [n for n, _ in steps]
    remaining = F.array(*[F.col(f"s{i}") for i in range(len(names))])
    before = F.concat(F.array(F.col("s0")), F.slice(remaining, 1, len(names) - 1))
    rows = F.arrays_zip(F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("step_no"),
                        F.array(*[F.lit(n) for n in names]).alias("step"),
                        remaining.alias("n_remaining"), before.alias("n_before"))
    return (counts.select(F.inline(rows))
            .select(F.col("step_no").cast("int"), "step",
                    F.col("n_remaining").cast("bigint"),
                    (F.col("n_before") - F.col("n_remaining")).cast("bigint").alias("n_removed")))


def cohort_candidates(demographics: DataFrame, events: DataFrame, codes: DataFrame,
                      patients: DataFrame, deprivation: DataFrame,
                      cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """M4 before the eligibility filters: all linked patients with IMD."""
    demo = prepare_demographics(demographics, cfg)
    out = (demo.join(index_event(events, codes), "patid", "left")                 # J1
               .join(patients.select("patid", "pracid"), "patid", "inner")       # J2
               .join(first_diagnosis(events), "patid", "left")                   # J3
               .join(deprivation.select("patid", "imd2015_5"), "patid", "inner"))  # J4
    return out


def apply_eligibility(candidates: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """P10: keep candidates passing every eligibility step."""
    cond = None
    for _, c in eligibility_steps(cfg):
        cond = c if cond is None else cond & c
    return candidates.where(cond)


def build_cohort(demographics: DataFrame, events: DataFrame, codes: DataFrame,
                 patients: DataFrame, deprivation: DataFrame,
                 cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """M4: eligible cohort, one row per patient with its index date."""
    return apply_eligibility(cohort_candidates(demographics, events, codes, patients, deprivation, cfg), cfg)


def cohort_attrition(demographics: DataFrame, events: DataFrame, codes: DataFrame,
                     patients: DataFrame, deprivation: DataFrame,
                     cfg: CohortConfig = CohortConfig()) -> DataFrame:
    cand = cohort_candidates(demographics, events, codes, patients, deprivation, cfg)
    return attrition(cand, eligibility_steps(cfg), start_name="linked_with_imd")
