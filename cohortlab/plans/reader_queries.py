"""Registered queries of the text readers, the composed event sources and the code systems.

The lines of text are made from the given tables, with some of them broken, and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions import codes as FC
from cohortlab.operators import codes as CD
from cohortlab.operators import cohort as CH
from cohortlab.operators import sequences as SQ
from cohortlab.plans import study as S
from cohortlab.plans.materialize import literal_table
from cohortlab.plans.queries import register, rounded, seq_text
from cohortlab.sources import io
from cohortlab.sources import roles as R

# -- text lines ---------------------------------------------------------------------------------


def patient_lines(spark, d):
    """Tab-separated patient records; of 17 customers one has a cell too few, one a cell too
    many and one a date that is none."""
    demo = R.demographics(spark, d)
    k = F.col("patid")
    cells = [k.cast("string"), F.when(k % 17 == 3, F.lit("unknown")).otherwise(F.date_format("dob", "dd/MM/yyyy")),
             F.col("gender").cast("string"), F.coalesce(F.col("bmi").cast("string"), F.lit(""))]
    line = F.when(k % 17 == 1, F.concat_ws("\t", *cells[:3])).when(k % 17 == 2, F.concat_ws("\t", *cells, F.lit("x")))
    return demo.select(line.otherwise(F.concat_ws("\t", *cells)).alias("value"))


PATIENT = "patid long, dob date, gender int, bmi double"


@register("read_delimited")
def q_read_delimited(spark, d):
    """The accepted rows of the patient lines."""
    rows = io.accepted(io.parse_delimited(patient_lines(spark, d), PATIENT, header="patid\tdob\tgender\tbmi", date_format="dd/MM/yyyy"))
    return rounded(rows, "bmi")


@register("read_delimited_quarantine")
def q_read_delimited_quarantine(spark, d):
    """The broken lines, each as it stood."""
    return io.quarantined(io.parse_delimited(patient_lines(spark, d), PATIENT, date_format="dd/MM/yyyy"))


@register("read_code_list")
def q_read_code_list(spark, d):
    """S3: codes of a CSV list with quoted names, blanks around codes, empty codes and repeats."""
    part = R.table(spark, d, "part").select("p_partkey", "p_type")
    k = F.col("p_partkey")
    code = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" C"), (k % 40).cast("string"), F.lit(" ")))
    lines = part.select(F.concat(F.lit('"'), "p_type", F.lit(', kind",'), code).alias("value"))
    return io.parse_code_list(lines, "name,code", "code")


@register("read_scores")
def q_read_scores(spark, d):
    """Three score columns as text; one has a word in some rows and goes as a whole."""
    wide = R.scores(spark, d).groupBy("patid").pivot("trait", ["acctbal_score", "hash_score_a", "hash_score_b"]).agg(F.first("score"))
    k = F.col("patid").cast("long")
    cells = ["patid", F.col("acctbal_score").cast("string"),
             F.when(k % 50 == 0, "missing").otherwise(F.col("hash_score_a").cast("string")),
             F.when(k % 9 == 0, "").otherwise(F.col("hash_score_b").cast("string"))]
    lines = wide.select(F.concat_ws(",", *cells).alias("value"))
    names = ["acctbal_score", "hash_score_a", "hash_score_b"]
    return rounded(io.parse_scores(lines, ",".join(["patid", *names]), names), "score")


def sequence_lines(spark, d):
    """CSV lines of stringified lists, one per order; of 13 orders one lacks a bracket and one a year."""
    items = R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.year("l_shipdate").alias("year"))
    by_order = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "year", "l_quantity"))).alias("t"))
    listed = lambda c: F.concat(F.lit('"['), F.array_join(F.transform("t", c), ", "), F.lit(']"'))
    k = F.col("l_orderkey")
    codes = listed(lambda t: F.concat(F.lit("'ICD10_"), t["l_linenumber"].cast("string"), F.lit("'")))
    years = F.when(k % 13 == 2, F.lit('"[]"')).otherwise(listed(lambda t: t["year"].cast("string")))
    ages = listed(lambda t: F.floor(t["l_quantity"]).cast("string"))
    codes = F.when(k % 13 == 1, F.regexp_replace(codes, "]", "")).otherwise(codes)
    return by_order.select(F.concat_ws(",", k.cast("string"), codes, years, ages).alias("value"))


@register("read_sequences_csv")
def q_read_sequences(spark, d):
    """Per line its lists' length and a digest of their entries; broken lines have none."""
    rows = io.parse_sequences(sequence_lines(spark, d), "patid,code,year,age")
    whole = F.col(io.BROKEN).isNull()
    entry = F.concat_ws("|", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("code", "year", "age")])
    return rows.select(F.col("patid").cast("long").alias("patid"), (~whole).alias("broken"),
                       F.when(whole, F.size("code")).alias("n"), F.when(whole, F.md5(entry)).alias("digest"))


# -- event sources ------------------------------------------------------------------------------


def event_sources(spark, d):
    """Diagnoses, medications, procedures and measurements as separate tables, the
    procedures without their prefix, every source with rows that lack a code."""
    events = R.sequence_events(spark, d)
    code = F.col("code")
    kind = (F.when(code.startswith(FC.PROC_PREFIX), "procedures")
            .when(code.startswith(FC.BNF_PREFIX) | code.startswith(FC.VTM_PREFIX), "medications")
            .when(code.startswith(FC.VAL_PREFIX), "measurements").otherwise("diagnoses"))
    part = lambda name: events.where(kind == name)
    bare = part("procedures").withColumn("code", F.substring(code, len(FC.PROC_PREFIX) + 1, 10))
    with_gaps = lambda df: df.unionByName(df.where(F.col("patid") % 3 == 0).withColumn("code", F.lit(None).cast("string")))
    sources = [with_gaps(x) for x in (part("medications"), bare, part("diagnoses"), part("measurements"))]
    sources[1] = CD.prefix_code(sources[1], FC.PROC_PREFIX)
    return CD.union_event_sources(*sources)


@register("union_event_sources")
def q_union_event_sources(spark, d):
    return event_sources(spark, d).groupBy("patid", "code").agg(F.count("*").alias("n"), F.min("eventdate").alias("first"))


@register("sequences_of_event_sources")
def q_sequences_of_event_sources(spark, d):
    """M5 over the composed sources: the same sequences as from the one event table."""
    return seq_text(SQ.build_sequences(event_sources(spark, d), S.cohort(spark, d), stage="before"))


# -- code systems -------------------------------------------------------------------------------


def definition_lists(spark):
    """Code lists against the derived dictionary, with rows of the wrong system."""
    rows = [("read", "AD", "R91O"), ("read", "AD", "R92P"), ("snomed", "AD", S.snomed_of("93O")),
            ("snomed", "PARM", S.snomed_of("94O")), ("snomed", "PARM", S.snomed_of("95P")), ("read", "PARM", "R91P"),
            ("read", "PD", "R91O"), ("read", "fall", "R91P"), ("read", "fall", "R93O"), ("snomed", "fall", S.snomed_of("92O")),
            ("read", "language", "R92O"), ("read", "memory", "R94P"), ("read", "confusion", "R95P"), ("read", "sleep", "R99X"),
            ("snomed", "dementia", S.snomed_of("91O")), ("snomed", "depression", S.snomed_of("93P")),
            ("snomed", "constipation", S.snomed_of("94O")), ("snomed", "mci", S.snomed_of("92O")), ("read", "mci", "R91O")]
    return literal_table(spark, rows, ["system", "name", "code"])


@register("named_case_codes")
def q_named_case_codes(spark, d):
    """The three named definitions."""
    out = None
    for name in FC.CASE_DEFINITIONS:
        codes = CD.named_case_codes(definition_lists(spark), R.code_dictionary(spark, d), name).withColumn("name", F.lit(name))
        out = codes if out is None else out.unionByName(codes)
    return out.select("name", "code")


@register("named_symptom_codes")
def q_named_symptom_codes(spark, d):
    """The nine symptoms."""
    return CD.named_symptom_codes(definition_lists(spark), R.code_dictionary(spark, d))


@register("describe_codes_by_system")
def q_describe_by_system(spark, d):
    """Every step of the chain - special case, map, code system by longest prefix, the code itself."""
    part = R.table(spark, d, "part").select("p_partkey")
    tens = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    block = F.concat(F.lit("E"), F.substring(tens, 1, 1))
    systems = (part.where(F.col("p_partkey") % 3 == 0).select(F.lit("icd").alias("system"), block.alias("prefix"))
               .unionByName(part.select(F.lit("icd").alias("system"), F.concat(block, F.substring(tens, 2, 1)).alias("prefix"))
                            .where(F.col("prefix") < "E3"))
               .unionByName(part.select(F.lit("opcs").alias("system"), F.concat(F.lit("PROC_0"), F.substring(tens, 1, 1)).alias("prefix"))
                            .where(F.col("prefix") < "PROC_05"))
               .unionByName(literal_table(spark, [("any", "PROC_0"), ("any", "E01")], ["system", "prefix"]))).distinct()
    rank = F.when(F.col("system") == "any", 2).otherwise(1)
    systems = systems.select("system", "prefix", rank.alias("priority"), F.concat_ws(" ", "system", "prefix").alias("description"))
    codes = R.sequence_events(spark, d).select(FC.normalise_description_key("code").alias("code")).distinct()
    special = F.when(F.col("line_no") % 10 == 0, F.lit("Other chronic obstructive pulmonary disease"))
    known = R.code_descriptions(spark, d).withColumn("target", F.coalesce(special, "target"))
    return CD.describe_codes(codes, known, fallback=CD.longest_prefix(codes, systems), step="step")


@register("region_counts")
def q_region_counts(spark, d):
    """patients by decoded region; practices beyond the known regions have none."""
    region = FC.decode(F.col("pracid") + 1, FC.REGION_CATEGORIES)
    return R.patients(spark, d).groupBy(region.alias("region")).agg(F.count("*").alias("n"))


@register("cohort_attrition_upper_age")
def q_attrition_upper_age(spark, d):
    """M3/P11 with the upper age limit switched on."""
    cfg = CH.CohortConfig(window_start=R.INDEX_WINDOW[0], window_end=R.INDEX_WINDOW[1], least_age=40, greatest_age=60)
    return S.attrition(spark, d, cfg)
