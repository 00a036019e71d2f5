"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it
as Parquet in the shared folder and hands the reread table to the next one.  All but
the last return the columns of ``documents``; the mix returns, for every document that
is left, its size, its source's size and target and the words the mix takes.

Learnt stages have no SQL form (``ORACLE_SQL`` is None); ``tests/llm/test_pipeline.py``
checks each stage against a brute-force version of its rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import decontamination, mixing, near_duplicates, personal_data, toxicity
from cohortlab.llm._tables import documents, labels, prepare, stage

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    prepare(spark)
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    prepare(spark)
    return near_duplicates.one_per_class(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    prepare(spark)
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    prepare(spark)
    return mixing.words_taken(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("personal_data", redact_personal_data),
          ("mix", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
