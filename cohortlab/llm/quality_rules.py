"""Quality rules with risk-controlled thresholds (operator 5, DataFrame functions only).

Each rule is a ratio of counts, higher for worse text.  A rule's cutoff in a stratum
(language) is chosen on labelled good documents: cutoffs are tested from the mildest
to the strictest, and a cutoff passes if the exact binomial bound says that it rejects
more than ``alpha`` of good documents with probability at most ``delta`` over the
number of rules times strata (Bonferroni; the fixed order within a rule needs no
further correction).  The strictest cutoff before the first failure is used; a rule
with too few good documents for any bound rejects nothing in that stratum.  ``alpha``
is the total divided by the number of rules, so in each stratum at most the total is
falsely rejected, with probability at least ``1 - delta`` in all strata at once.

Counts are exact and over whole texts; 3-word windows are compared by 64-bit hash.
A ratio a / b is kept as its bin ``ceil(GRID * a / b)``, in integers.

Scale: one pass over the texts, rows of counts only after that; labels meet counts on
doc_id, and the bounds are computed on (stratum, rule, bin) counts.

Edge cases: null and empty texts have no words and fail the base; a null language is
a stratum of its own; labels without document, with null id or label are ignored; of
repeated label rows the largest counts; repeated document rows are judged alike; of several
rows of one id in a stratum the one with the least bins (rules in order) counts as the label's
document; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.stats import log_choose
from cohortlab.llm._spans import bound
from cohortlab.llm._tables import stage
from cohortlab.llm._words import WORD

GRID = 200
#: Rule -> (numerator, denominator) over the counts.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
         "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"),
         "bangs": ("n_bangs", "n_words")}


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur at least twice (the first included)."""
    def covered(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j + 1) | same(j - 1, j))
        at = F.transform(places, lambda j: F.get(s, j)["i"])
        return bound(at, lambda p: F.size(F.array_distinct(F.concat(
            p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    return F.when(F.size(words) > 3, bound(hashed(words), covered)).otherwise(0).cast("long")


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words and the other counts) of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        repeat_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select("doc_id", F.col("lang").alias("stratum"),
                       bound(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), of_words).alias("w"),
                       bound(lines, of_lines).alias("l"), left(r"[^#*$%&|<>]+").alias("n_symbols"),
                       left(r"[^\p{Lu}]+").alias("n_upper"), left(r"[^!]+").alias("n_bangs")).select(
        "doc_id", "stratum", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        "l.n_lines", "n_upper", "n_bangs")


def ratio_bin(rule: str) -> Column:
    a, b = RULES[rule]
    return F.when(F.col(b) > 0, F.least(F.expr(f"({GRID} * {a} + {b} - 1) div {b}"), F.lit(GRID + 1))).otherwise(0).cast("int")


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p): from the term at k downwards.  At k >= n p it is
    about one half or more, and 1 is given."""
    top = F.exp(log_choose(n, k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    odds = (1 - p) / p
    steps = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(top.alias("term"), top.alias("sum"))
    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] * i * odds / (n - i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))
    return F.when(k < n * p, F.aggregate(steps, zero, down, lambda acc: acc["sum"])).otherwise(1.0)


def choose_cutoffs(counts: DataFrame, labels: DataFrame, total_alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoffs map<rule, bin>): a rule rejects bins above its cutoff."""
    good = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id"))
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"row.{r}").alias("bin")) for r in RULES]))
    # of a document's rows in a stratum the one with the least bins, rule by rule, counts
    row = F.struct(*[ratio_bin(r).alias(r) for r in RULES])
    firsts = counts.join(good, "doc_id").groupBy("doc_id", "stratum").agg(F.min(row).alias("row"))
    held = firsts.select("stratum", bins.alias("x"))
    per = held.groupBy("stratum", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    # one row per stratum and rule with its histogram (at most GRID + 2 bins)
    hist = per.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bin", "n")).alias("h"))
    strata = F.count(F.lit(1)).over(Window.partitionBy())                # rules times strata: a few rows
    tests = (hist.withColumn("tests", strata)
             .withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
             .withColumn("k", F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc + F.when(
                 x["bin"] > F.col("cut"), x["n"]).otherwise(0))))
    passed = binomial_at_most(F.col("k"), F.col("n"), total_alpha / len(RULES)) <= F.lit(delta) / F.col("tests")
    worst = tests.withColumn("failed", F.when(~passed, F.col("cut"))).groupBy("stratum", "rule").agg(
        F.coalesce(F.max("failed"), F.lit(-1)).alias("failed"))
    # cutoff 0 rejects every ratio above 0; the mildest one rejects what exceeds the grid, and
    # beyond it (GRID + 1) nothing is rejected
    cut = F.col("failed") + 1
    return worst.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", cut.alias("cut")))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """(doc_id, counts, base_failed, kept, reasons) of every row of ``docs``."""
    counts = stage(text_counts(docs), "quality-counts")
    cutoffs = stage(choose_cutoffs(counts, labels, **risk), "quality-cutoffs").withColumnRenamed("stratum", "_s")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def fails(rule: str) -> Column:
        cut = F.coalesce(F.element_at("cutoffs", rule), F.lit(GRID + 1))
        return F.when(ratio_bin(rule) > cut, rule)

    reasons = F.array_compact(F.array(*map(fails, RULES)))
    return (counts.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_s")), "left")
            .withColumn("base_failed", failed).withColumn("_why", reasons)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.size("_why") == 0)).alias("kept"), F.array_join("_why", ",").alias("reasons")))
