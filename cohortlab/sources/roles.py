"""Operator inputs derived from the driver's TPC-H-style tables.

Each function reads the parquet tables it needs under ``sf_dir`` and derives
one input role with integer arithmetic or the portable md5 hash only, so a
SQL engine computes exactly the same rows (see ``oracle/roles.py``).  Every
role grows with the tables it is read from.

Derived columns are projected straight after the scan so only the used
columns are read (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.hashing import portable_hash

# ---------------------------------------------------------------------------
# Fixed values of the genetic analysis: the five studied variants and their
# population carrier frequencies, in their natural order.
SNP_FREQUENCIES = [
    ("rs429358_C", 0.06817),
    ("rs7412_T", 0.082919),
    ("rs143332484_T", 0.010499),
    ("rs3764650_G", 0.093706),
    ("rs3752246_G", 0.17085),
]
# Case definition used against the derived diagnoses: GP codes and hospital
# ICD-10 codes, study window for the index date and follow-up years.
CASE_GP_CODES = ["91O", "92P"]
CASE_ICD_CODES = ["G31"]
INDEX_WINDOW = ("1996-01-01", "1999-12-31")
FOLLOW_UP_YEARS = 2
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days_after(base: str, days: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int"))


def patients(spark, sf_dir) -> DataFrame:
    """patient: patid, pracid (practice = nation)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("patid"),
                    F.col("c_nationkey").cast("bigint").alias("pracid"))


def demographics(spark, sf_dir) -> DataFrame:
    """demographics: one row per patient with dates and baseline measures."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("patid"),
        _days_after("1930-01-01", (k * 37) % 12000).alias("dob"),
        (F.lit(1) + k % 2).cast("int").alias("gender"),
        _days_after("1994-01-01", (k * 11) % 1000).alias("regdate"),
        _days_after("1998-06-01", (k * 13) % 1200).alias("enddate"),
        F.when(k % 3 == 0, _days_after("1996-01-01", (k * 17) % 2500)).alias("dod"),
        (F.lit(1) + k % 4).cast("int").alias("smoke"),
        F.when(k % 13 != 0, F.lit(15.0) + ((k * 7) % 300).cast("double") / F.lit(10.0)).alias("bmi"),
        (F.lit(100) + k % 80).cast("double").alias("sbp"),
        (F.lit(1) + F.col("c_nationkey") % 13).cast("int").alias("region"),
        F.when(k % 5 == 0, F.lit("Other")).when(k % 5 == 1, F.lit("Asian"))
         .otherwise(F.lit("White")).alias("gen_ethnicity"),
    )


def deprivation(spark, sf_dir) -> DataFrame:
    """deprivation: patid, imd2015_5; every 11th patient has none."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.where(k % 11 != 0).select(k.alias("patid"),
                                       (F.lit(1) + k % 5).cast("int").alias("imd2015_5"))


def cluster_labels(spark, sf_dir) -> DataFrame:
    """cluster label 1..5 = dense rank of the market segment.

    The rank is computed on the distinct segments (a handful of rows) and
    joined back, instead of a global window that would run in one task.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    seg = c.select("c_mktsegment").distinct()
    ranked = seg.withColumn("label", F.dense_rank().over(Window.orderBy("c_mktsegment")))
    # bounded: one row per distinct segment
    return (c.join(F.broadcast(ranked), "c_mktsegment")
             .select(F.col("c_custkey").alias("patid"), F.col("label").cast("int")))


def diagnoses(spark, sf_dir) -> DataFrame:
    """diagnoses: finished orders are hospital (ICD) records, others GP (medcode)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    pri = F.substring("o_orderpriority", 1, 1)
    hes = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_custkey").alias("patid"),
        F.col("o_orderdate").cast("date").alias("eventdate"),
        F.when(hes, F.lit("HES")).otherwise(F.lit("CPRD")).alias("source"),
        F.when(~hes, F.concat(F.lit("9"), pri, F.col("o_orderstatus"))).alias("medcode"),
        F.when(hes, F.concat(F.lit("G3"), pri)).alias("ICD"),
    )


def admissions(spark, sf_dir) -> DataFrame:
    """admissions: one row per line item; spno = order, ICD = 'G3.' || line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("patid"), F.col("l_orderkey").alias("spno"),
                    F.col("l_shipdate").cast("date").alias("admidate"),
                    F.concat(F.lit("G3."), F.col("l_linenumber").cast("string")).alias("ICD"))


def stays(spark, sf_dir) -> DataFrame:
    """stays: one row per (patid, spno) with the longest duration of its line items."""
    li = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("patid"), F.col("l_orderkey").alias("spno"),
                    (F.floor("l_quantity").cast("int") - 1).alias("duration"))


def sequence_events(spark, sf_dir) -> DataFrame:
    """Clinical events for sequences: (patid, eventdate, code).

    The code family follows the part type: bnf_ (medication), PROC_
    (procedure), VAL_ (measurement), vtm_ (medication), 3-char and 4-char
    diagnosis codes.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    k = F.col("p_partkey")
    code = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("bnf_"), F.lpad(k.cast("string"), 6, "0")))
            .when(F.col("p_type") == "LARGE", F.concat(F.lit("PROC_"), F.lpad((k % 1000).cast("string"), 4, "0")))
            .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("VAL_"), (k % 300).cast("string")))
            .when(F.col("p_type") == "PROMO", F.concat(F.lit("vtm_"), (k % 200).cast("string")))
            .when(F.col("p_type") == "SMALL", F.concat(F.lit("I"), F.lpad((k % 100).cast("string"), 2, "0")))
            .otherwise(F.concat(F.lit("E"), F.lpad((k % 1000).cast("string"), 3, "0"))))
    codes = p.select("p_partkey", code.alias("code"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(codes, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("o_custkey").alias("patid"),
                    F.col("l_shipdate").cast("date").alias("eventdate"), "code")


def vectors(spark, sf_dir) -> DataFrame:
    """embeddings: id, features array<double>, label (10 classes)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("int").alias("label"))


def class_centers(spark, sf_dir) -> DataFrame:
    """Fixed centers: the vector with the smallest id of each class; idx = class."""
    return (vectors(spark, sf_dir).groupBy(F.col("label").alias("idx"))
            .agg(F.min_by("features", "id").alias("center")))


def snp_frequencies(spark) -> DataFrame:
    return spark.createDataFrame(SNP_FREQUENCIES, "snp string, freq double")


def dosage(spark, sf_dir) -> DataFrame:
    """Long-form genotype dosage: customer x five SNPs.

    h % 20: 19 -> missing, 0 -> 2 copies, 1..5 -> 1 copy, else 0.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey")
    snps = F.array(*[F.struct(F.lit(i + 1).alias("j"), F.lit(n).alias("snp"))
                     for i, (n, _) in enumerate(SNP_FREQUENCIES)])
    x = c.select("c_custkey", F.explode(snps).alias("s"))
    h = portable_hash(F.col("c_custkey"), F.concat(F.lit("snp"), F.col("s.j").cast("string"))) % 20
    d = (F.when(h == 19, F.lit(None).cast("double")).when(h == 0, F.lit(2.0))
         .when(h <= 5, F.lit(1.0)).otherwise(F.lit(0.0)))
    return x.select(F.col("c_custkey").cast("string").alias("patid"), F.col("s.snp").alias("snp"),
                    d.alias("dosage"))


def scores(spark, sf_dir) -> DataFrame:
    """Long-form polygenic scores: three traits per customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    t2 = (portable_hash(k, "prs2") % 2001 - 1000).cast("double") / F.lit(1000.0)
    t3 = (portable_hash(k, "prs3") % 2001 - 1000).cast("double") / F.lit(400.0) \
        + F.when(k % 5 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    traits = F.array(
        F.struct(F.lit("acctbal_score").alias("trait"), (F.col("c_acctbal") / F.lit(10000.0)).alias("score")),
        F.struct(F.lit("hash_score_a").alias("trait"), t2.alias("score")),
        F.struct(F.lit("hash_score_b").alias("trait"), t3.alias("score")),
    )
    x = c.select(k.cast("string").alias("patid"), F.explode(traits).alias("t"))
    return x.select("patid", F.col("t.trait").alias("trait"), F.col("t.score").alias("score"))


def score_labels(spark, sf_dir) -> DataFrame:
    """Cluster labels of the genotyped cohort; every 7th customer is a control (no label)."""
    lab = cluster_labels(spark, sf_dir)
    return (lab.where(F.col("patid") % 7 != 0)
               .select(F.col("patid").cast("string").alias("patid"), "label"))


def code_dictionary(spark, sf_dir) -> DataFrame:
    """Dictionary medcode -> readcode / Snomedcode / term, from the GP codes in use."""
    d = diagnoses(spark, sf_dir).where(F.col("medcode").isNotNull()).select("medcode").distinct()
    return d.select("medcode",
                    F.concat(F.lit("R"), F.col("medcode")).alias("readcode"),
                    (portable_hash(F.col("medcode"), "snomed") % 1000000).cast("string").alias("Snomedcode"),
                    F.concat(F.lit("term "), F.col("medcode")).alias("term"))


def code_descriptions(spark, sf_dir) -> DataFrame:
    """Description table (source, target, line_no) with duplicate keys.

    Keys are 3-char diagnosis codes behind a ``DIA_`` prefix and grouped
    ``bnf_`` codes behind ``MED_``; several parts share a key, the part key
    is the line number, so 'last row wins' is well defined.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    k = F.col("p_partkey")
    src = (F.when(F.col("p_type") == "SMALL", F.concat(F.lit("DIA_I"), F.lpad((k % 100).cast("string"), 2, "0")))
           .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("MED_bnf_"), F.lpad(k.cast("string"), 6, "0"))))
    return (p.where(src.isNotNull())
             .select(src.alias("source"), F.col("p_name").alias("target"), k.alias("line_no")))
