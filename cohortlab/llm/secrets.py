"""Secret scans with an incremental blob ledger (operator 9, DataFrame functions only).

Every version of every path is named by the SHA-256 of its content.  The ledger
says which rule versions have scanned which blob and what they found; only pairs of
blob and rule version that it does not hold are scanned, each blob once however many
paths and versions share it, and the findings are joined back to all paths.

The ledger is a Parquet folder of (blob, rules, findings) rows that each run appends
to; a blob has a further row when rules of a new version have scanned it.

Rules: the three base kinds of the contract (assign, access, hex) and the formats
pem (private key blocks), github and jwt, which add spans.

Scale: each content moves once, to the key (blob, least id of the blob), so the copies
of a hot blob spread over all tasks and only the row that represents it is scanned; the
join back carries findings only (blobs without findings are not in it, hot blobs are
split by the skew join).

Edge cases: a null text is an empty blob; null ids and repeated rows are paths like
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._spans import matches
from cohortlab.llm._tables import stage

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = ("(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A private key block to its END line; the BEGIN line alone where no key and END follow.
PEM = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
       r"(?:[\x20\x09-\x0D]++[A-Za-z0-9+/=\x20\x09-\x0D]*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
#: Rule -> (pattern, test of the found text); the first three are the contract's base.
RULES = {
    "assign@1": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    "access@1": (r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 16),
    "hex@1": (r"[0-9a-f]{32,}+", None),
    "pem@2": (PEM, None),
    "github@1": (r"gh[pousr]_[A-Za-z0-9]{36,}+", None),
    "jwt@1": (r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", None),
}
BASE = ("assign", "access", "hex")
FINDING = "array<struct<start: bigint, rank: int, end: bigint, rule: string>>"
LEDGER = f"blob string, rules array<string>, findings {FINDING}"


def scan(text: Column, todo: Column, rules: dict = RULES) -> Column:
    """Findings of the rules named in ``todo``, by start, then rule."""
    def findings(rank: int, name: str, pattern: str, test) -> Column:
        found = matches(text, pattern)
        if test is not None:
            found = F.filter(found, lambda m: test(m["found"]))
        spans = F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(name).alias("rule")))
        return F.when(F.array_contains(todo, name), spans).otherwise(F.expr(f"cast(array() AS {FINDING})"))

    parts = [findings(rank, name, *rule) for rank, (name, rule) in enumerate(rules.items())]
    return F.sort_array(F.concat(*parts))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES) -> DataFrame:
    """New ledger rows: what this run must scan of ``docs`` (doc_id, text)."""
    keys = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    named = F.array(*map(F.lit, rules))
    todo = keys.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is None:
        todo = todo.withColumn("todo", named)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        todo = (todo.join(seen, "blob", "left")
                .withColumn("todo", F.array_except(named, F.coalesce("seen", F.array().cast("array<string>"))))
                .filter(F.size("todo") > 0).drop("seen"))
    texts = docs.select("doc_id", blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    same = (F.col("t.blob") == F.col("s.blob")) & F.col("t.doc_id").eqNullSafe(F.col("s.first_id"))
    # of repeated rows each is scanned where it stands: their findings are smaller to move than their texts
    return (texts.alias("t").join(todo.alias("s"), same)
            .select("t.blob", F.col("todo").alias("rules"), scan(F.col("text"), F.col("todo"), rules).alias("findings"))
            .dropDuplicates(["blob"]))


def join_findings(docs: DataFrame, ledger: DataFrame, rules: dict = RULES) -> DataFrame:
    """(doc_id, findings) of every row of ``docs``: what the ledger's current rule
    versions found in its blob."""
    current = F.array(*map(F.lit, rules))
    found = (ledger.filter(F.size("findings") > 0)
             .filter(F.arrays_overlap("rules", current)).groupBy("blob")
             .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.filter(
                 "findings", lambda f: f["rule"].isin(*rules)))))).alias("findings")))
    keys = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return (keys.join(found, "blob", "left")
            .select("doc_id", F.coalesce("findings", F.expr(f"cast(array() AS {FINDING})")).alias("findings")))


def scan_versions(docs: DataFrame, ledger_path: str | None = None, rules: dict = RULES) -> DataFrame:
    """Scan what is new in ``docs``, extend the ledger at ``ledger_path`` (if given) and
    return (doc_id, findings) of every row."""
    spark = docs.sparkSession
    if ledger_path is None:
        return join_findings(docs, stage(scan_blobs(docs, None, rules), "secrets-ledger"), rules)
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    new = stage(scan_blobs(docs, spark.read.schema(LEDGER).parquet(ledger_path), rules), "secrets-new")
    new.write.mode("append").parquet(ledger_path)
    return join_findings(docs, spark.read.schema(LEDGER).parquet(ledger_path), rules)


def kind(finding: Column) -> Column:
    """The rule's name without its version."""
    return F.substring_index(finding["rule"], "@", 1)


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", kind(f), f["start"].cast("string"),
                                                                    f["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns."""
    base = F.filter("findings", lambda f: kind(f).isin(*BASE))
    count = lambda k: F.size(F.filter("findings", lambda f: kind(f) == k)).cast("long")
    return scan_versions(docs, **options).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
