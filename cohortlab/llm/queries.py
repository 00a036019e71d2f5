"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import (decontamination, divergence, language_id, license_scan, merkle, mixing, near_duplicates,
                           personal_data, quality_classifier, quality_rules, secrets, toxicity, warc)
from cohortlab.llm._tables import documents, labels, prepare, shared_path


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.words_taken(documents(spark, sf_dir))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archived_pages(pages, shared_path(spark, "warc"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(documents(spark, sf_dir), benchmark)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_classifier.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return personal_data.report(documents(spark, sf_dir))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.report(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return divergence.source_divergence(documents(spark, sf_dir))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.predict_languages(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return merkle.verified_manifest(documents(spark, sf_dir))


def quality_rules_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 with risks at which cutoffs bind in strata of a few hundred good documents."""
    prepare(spark)
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir), total_alpha=0.25, delta=0.2)


def secret_scan_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 in two runs over one ledger: the documents of English, then all documents, of
    which only blobs that the ledger does not hold are scanned; the result is that of one run."""
    prepare(spark)
    docs, ledger = documents(spark, sf_dir), shared_path(spark, "secrets-ledger")
    secrets.scan_versions(docs.filter("lang = 'en'"), ledger)
    return secrets.report(docs, ledger_path=ledger)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_warc_archive, op3_decontaminate, op4_toxicity_chain, op5_quality_rules, op6_quality_classifier,
    op7_personal_data, op8_ngram_jaccard_join, op9_secret_scan, op10_license_scan,
    op11_source_divergence, op12_language_id, op13_merkle_manifest, quality_rules_wide, secret_scan_two_versions)}
