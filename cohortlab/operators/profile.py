"""Cluster profiles: sizes, baseline table, code prevalence.

All per-cluster statistics come from ONE grouped aggregation over the
patient rows (partial aggregation map-side), then reshape the k summary rows
- nothing scales with patients after the first aggregate.  The code
prevalence never materialises a one-hot matrix: it counts distinct
(patient, code) pairs per cluster in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import codes as FC
from cohortlab.functions.dates import age_years
from cohortlab.operators.codes import describe_codes

# The variables of the baseline table.
CONTINUOUS_VARS = ["age", "sbp", "bmi"]
CATEGORICAL_VARS = ["Male", "Female", "BMI underweight", "BMI healthy", "BMI overweight",
                    "BMI obesity", "Smoker", "Ex-Smoker", "Non-Smoker", "ethnicity_White",
                    "imd_1", "imd_2", "imd_3", "imd_4", "imd_5"]


def _r(c: Column, digits: int) -> Column:
    s = 10.0 ** digits
    return F.floor(c * F.lit(s) + F.lit(0.5)) / F.lit(s)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) by descending frequency, equal ones by value.

    The total is one broadcast row; the order is a range sort of one row per value.
    """
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")))
    return (c.crossJoin(total).select(col, "n", (F.col("n") / F.col("_total")).alias("share"))
            .orderBy(F.col("n").desc(), col))


def baseline_features(df: DataFrame, index_col: str = "index_date") -> DataFrame:
    """Derived baseline variables and 0/1 indicators per patient."""
    smoke = FC.decode("smoke", FC.SMOKE_CATEGORIES)
    gender = FC.decode(FC.safe_int(F.col("gender")), FC.GENDER_CATEGORIES)
    bmi_cat = FC.bmi_band("bmi")
    ind = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    cols = {
        "age": age_years(index_col, "dob"),
        "sbp": F.col("sbp").cast("double"),
        "bmi": F.col("bmi").cast("double"),
        "Male": ind(gender == "Male"), "Female": ind(gender == "Female"),
        "Smoker": ind(smoke == "Smoker"), "Ex-Smoker": ind(smoke == "Ex-Smoker"),
        "Non-Smoker": ind(smoke == "Non-Smoker"),
        "ethnicity_White": ind(F.col("gen_ethnicity") == "White"),
    }
    for _, _, name in FC.BMI_BANDS:
        cols[name] = ind(bmi_cat == name)
    for q in range(1, 6):
        cols[f"imd_{q}"] = ind(F.col("imd2015_5") == q)
    return df.select("label", *[v.alias(k) for k, v in cols.items()])


def baseline_table(df: DataFrame, label_col: str = "label", index_col: str = "index_date") -> DataFrame:
    """Long Table 1 - (variable, label, n, value, sd, pct, missing_pct, text).

    Continuous: "mean (sd) Miss(p%)", sd with ddof 1.  Categorical: "count
    (p%) Miss(q%)" as true percentages.  Row ``N`` holds the cluster size with
    a thousands separator.  Numbers are rounded half-up before formatting so
    the text is engine-independent.
    """
    feats = baseline_features(df.withColumnRenamed(label_col, "label"), index_col)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for v in CONTINUOUS_VARS:
        aggs += [F.avg(F.col(v)).alias(f"{v}__m"), F.stddev_samp(F.col(v)).alias(f"{v}__s"),
                 F.count(F.when(F.col(v).isNull(), 1)).alias(f"{v}__x")]
    for v in CATEGORICAL_VARS:
        aggs += [F.sum(F.when(F.col(f"`{v}`") == 1, 1).otherwise(0)).alias(f"{v}__c"),
                 F.count(F.when(F.col(f"`{v}`").isNull(), 1)).alias(f"{v}__x")]
    g = feats.groupBy("label").agg(*aggs)
    n = F.col("_n").cast("double")
    rows = []
    for v in CONTINUOUS_VARS:
        m, s, x = F.col(f"`{v}__m`"), F.col(f"`{v}__s`"), F.col(f"`{v}__x`") / n * 100.0
        text = F.format_string("%.2f (%.2f) Miss(%.1f%%)", _r(m, 2), _r(s, 2), _r(x, 1))
        rows.append(F.struct(F.lit(v).alias("variable"), m.alias("value"), s.alias("sd"),
                             F.lit(None).cast("double").alias("pct"), x.alias("missing_pct"), text.alias("text")))
    for v in CATEGORICAL_VARS:
        c, x = F.col(f"`{v}__c`"), F.col(f"`{v}__x`") / n * 100.0
        pct = c / n * 100.0
        text = F.format_string("%d (%.1f%%) Miss(%.1f%%)", c, _r(pct, 1), _r(x, 1))
        rows.append(F.struct(F.lit(v).alias("variable"), c.cast("double").alias("value"),
                             F.lit(None).cast("double").alias("sd"), pct.alias("pct"), x.alias("missing_pct"),
                             text.alias("text")))
    rows.append(F.struct(F.lit("N").alias("variable"), n.alias("value"), F.lit(None).cast("double").alias("sd"),
                         F.lit(None).cast("double").alias("pct"), F.lit(None).cast("double").alias("missing_pct"),
                         F.format_number(F.col("_n"), 0).alias("text")))
    return g.select("label", F.col("_n").cast("bigint").alias("n"), F.inline(F.array(*rows)))


def pivot_by_label(long: DataFrame, row_col: str, value_col: str, labels: list | None = None,
                   label_col: str = "label") -> DataFrame:
    """Transpose a long (row, label, value) table to one column per label.

    Pass ``labels`` to skip the extra job that discovers them.
    """
    g = long.groupBy(row_col)
    g = g.pivot(label_col, labels) if labels is not None else g.pivot(label_col)
    return g.agg(F.first(value_col))


def code_prevalence(seq: DataFrame, label_col: str = "label", code_col: str = "code") -> DataFrame:
    """Share of each cluster's patients having each grouped code (F8).

    ``seq`` has one row per patient and the codes are a set, so a plain count
    (combined before the shuffle) is the number of patients.  Returns (code,
    label, n_patients, cluster_size, prevalence).  Both sides of the join are
    aggregates; which one is broadcast is left to their measured sizes.
    """
    pats = seq.select(F.col(label_col).alias("label"),
                      F.explode(FC.group_code_set(F.col(code_col))).alias("code"))
    counts = pats.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n_patients"))
    sizes = seq.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("cluster_size"))
    return (counts.join(sizes, "label")
                  .withColumn("prevalence", F.col("n_patients") / F.col("cluster_size")))


def prevalence_range(prev: DataFrame, n_clusters: int) -> DataFrame:
    """Max - min prevalence per code over clusters, absent clusters = 0.

    A code missing from some cluster has minimum 0; no zero-filled
    code x cluster product is built.
    """
    g = prev.groupBy("code").agg(F.max("prevalence").alias("max_prev"),
                                 F.min("prevalence").alias("_min"),
                                 F.count(F.lit(1)).alias("_k"))
    mn = F.when(F.col("_k") < n_clusters, F.lit(0.0)).otherwise(F.col("_min"))
    return g.select("code", "max_prev", mn.alias("min_prev"), (F.col("max_prev") - mn).alias("prevalence_range"))


def prevalence_filter(ranges: DataFrame, threshold: float = 0.15, col: str = "prevalence_range") -> DataFrame:
    """Keep rows whose range is strictly above the threshold."""
    return ranges.where(F.col(col) > F.lit(threshold))


def prevalence_matrix(prev: DataFrame, descriptions: DataFrame, labels: list, threshold: float = 0.15,
                      family: str = "all") -> DataFrame:
    """Code x cluster prevalence of the retained codes, described.

    One pivot aggregate; a code stays if the range over its row (0 where a
    cluster lacks it) is above the threshold.  Columns: code, description,
    display (title case unless upper, <= 50 chars), then one zero-filled
    column per label.
    """
    wide = (prev.where(FC.code_family_predicate(F.col("code"), family))
                .groupBy("code").pivot("label", labels).agg(F.first("prevalence")).na.fill(0.0))
    row = F.array(*[F.col(f"`{k}`") for k in labels])
    wide = wide.where(F.array_max(row) - F.array_min(row) > F.lit(threshold))
    described = describe_codes(wide, descriptions, "code")
    return described.withColumn("display", FC.title_unless_upper(F.col("description")))
