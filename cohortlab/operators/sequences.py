"""Patient code sequences.

A sequence row holds three parallel arrays ``code``, ``year``, ``age``
(months); each visit (one date) lists its codes in ascending order followed
by ``SEP``, visits in date order, including a trailing ``SEP``.

Scale: events are reduced before any per-patient collect - first to one
row per (patient, code, 6-month bucket), then to one row per visit - so the
final per-patient array holds at most (distinct codes x age buckets)
entries, which is the sequence itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.codes import SEP
from cohortlab.functions.hashing import portable_hash
from cohortlab.operators.splits import dense_index

# ---------------------------------------------------------------------------
# Special tokens occupy the first five vocabulary ids.
SPECIAL_TOKENS = ["PAD", "UNK", "SEP", "CLS", "MASK"]
PAD_ID, UNK_ID, SEP_ID, CLS_ID, MASK_ID = range(5)
LOST_CODE = "lost"
# ---------------------------------------------------------------------------

MAX_DICTIONARY = 1 << 20      # vocabulary tokens that are broadcast for encoding
JOIN_SALTS = 16               # copies of a larger vocabulary, so that no token is one hot key


def whole_months(at, dob) -> Column:
    """Completed months of age: month difference, minus one if the day of
    month has not been reached yet (engine-neutral definition)."""
    at = F.col(at) if isinstance(at, str) else at
    dob = F.col(dob) if isinstance(dob, str) else dob
    m = (F.year(at) - F.year(dob)) * 12 + (F.month(at) - F.month(dob))
    return (m - F.when(F.dayofmonth(at) < F.dayofmonth(dob), 1).otherwise(0)).cast("int")


def followup_end_events(cohort: DataFrame) -> DataFrame:
    """M6: a ``lost`` event at each patient's end of follow-up."""
    return cohort.select("patid", F.col("enddate").alias("eventdate"), F.lit(LOST_CODE).alias("code"))


def build_sequences(events: DataFrame, cohort: DataFrame, stage: str = "before",
                    index_col: str = "index_date", dob_col: str = "dob",
                    unique_in_months: int = 6) -> DataFrame:
    """M5: (patid, code[], year[], age[]) per cohort patient.

    stage 'before': events strictly before the index date; 'after': on or
    after it; 'all': no cut.  The same code within one ``unique_in_months``
    age bucket is kept once (earliest).  Patients without events are absent
    (inner join, J5).
    """
    keys = cohort.select("patid", F.col(index_col).alias("_idx"), F.col(dob_col).alias("_dob"))
    ev = events.select("patid", "eventdate", "code").where(F.col("code").isNotNull())
    ev = ev.join(keys, "patid", "inner")
    if stage == "before":
        ev = ev.where(F.col("eventdate") < F.col("_idx"))
    elif stage == "after":
        ev = ev.where(F.col("eventdate") >= F.col("_idx"))
    elif stage != "all":
        raise ValueError(f"unknown stage {stage!r}")
    bucket = F.floor(whole_months("eventdate", "_dob") / F.lit(unique_in_months))
    # age is a function of (date, dob) and dob is constant per patient, so the
    # dedupe is a plain min(date) - a hash aggregate with map-side combine
    first = (ev.groupBy("patid", "_dob", "code", bucket.alias("_b"))
               .agg(F.min("eventdate").alias("eventdate")))
    first = first.withColumn("age", whole_months("eventdate", "_dob"))
    visits = (first.groupBy("patid", "eventdate", "age")
                   .agg(F.array_sort(F.collect_list("code")).alias("codes")))
    per_pat = visits.groupBy("patid").agg(
        F.array_sort(F.collect_list(F.struct("eventdate", "age", "codes"))).alias("_v"))
    toks = F.transform("_v", lambda v: F.concat(v["codes"], F.array(F.lit(SEP))))
    reps = lambda field: F.transform(
        "_v", lambda v: F.array_repeat(field(v), F.size(v["codes"]) + 1))
    return per_pat.select(
        "patid",
        F.flatten(toks).alias("code"),
        F.flatten(reps(lambda v: F.year(v["eventdate"]))).alias("year"),
        F.flatten(reps(lambda v: v["age"])).alias("age"),
    )


def sequence_long(seq: DataFrame) -> DataFrame:
    """Parallel arrays to long form (patid, pos, code, year, age), pos 1-based."""
    z = seq.select("patid", F.posexplode(F.arrays_zip("code", "year", "age")).alias("pos", "t"))
    return z.select("patid", (F.col("pos") + 1).alias("pos"),
                    F.col("t.code").alias("code"), F.col("t.year").alias("year"), F.col("t.age").alias("age"))


def non_empty(seq: DataFrame, *prefixes: str) -> DataFrame:
    """Keep rows whose arrays are all non-empty (for each view prefix)."""
    cond = F.lit(True)
    for p in prefixes or ("",):
        for c in ("code", "age", "year"):
            cond = cond & (F.size(F.col(f"{p}{c}")) > 0)
    return seq.where(cond)


def contrastive_views(seq: DataFrame, n_epochs: int = 1, seed: int = 0,
                      id_col: str = "patid") -> DataFrame:
    """Split each sequence after one uniformly drawn ``SEP``.

    The last ``SEP`` is never drawn; with no candidate the first view is the
    whole sequence and the second is empty.  One row per (patient, epoch)
    with ``pre_*`` and ``post_*`` arrays; other columns are carried.
    The draw is the portable hash of (id, epoch, seed).
    """
    n = F.size("code")
    seps = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: F.try_element_at(F.col("code"), i) == F.lit(SEP))
    cands = F.when(F.size(seps) > 1, F.slice(seps, 1, F.size(seps) - 1)).otherwise(F.array().cast("array<int>"))
    out = seq.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.col("epoch").cast("string"))
    pick = (portable_hash(key, f"view{seed}") % F.greatest(F.size(cands), F.lit(1))).cast("int") + 1
    out = out.withColumn("_cut", F.when(F.size(cands) > 0, F.element_at(cands, pick)).otherwise(n))
    for c in ("code", "year", "age"):
        out = (out.withColumn(f"pre_{c}", F.slice(c, 1, F.col("_cut")))
                  .withColumn(f"post_{c}", F.slice(c, F.col("_cut") + 1, F.greatest(n - F.col("_cut"), F.lit(0)))))
    return out.drop("_cut", "code", "year", "age")


def vocabulary(tokens: DataFrame, token_col: str = "code") -> DataFrame:
    """Vocabulary (token, idx): five special tokens, then distinct tokens by name.

    The ordinal comes from ``dense_index`` (range partitioned), not from a
    global single-task window.
    """
    spark = tokens.sparkSession
    dist = tokens.select(F.col(token_col).alias("token")).where(
        F.col("token").isNotNull() & ~F.col("token").isin(*SPECIAL_TOKENS)).distinct()
    ranked = dense_index(dist, "token", "idx").select("token", (F.col("idx") + len(SPECIAL_TOKENS)).alias("idx"))
    specials = spark.createDataFrame(list(zip(SPECIAL_TOKENS, range(len(SPECIAL_TOKENS)))), "token string, idx long")
    return specials.unionByName(ranked)


def sequence_tokens(seq: DataFrame) -> DataFrame:
    return sequence_long(seq).select("patid", "pos", "code")


def keep_vocabulary(seq: DataFrame, vocab: DataFrame) -> DataFrame:
    """drop ``SEP`` and out-of-vocabulary tokens, order kept.

    Long form (patid, pos, code) semi-joined to the vocabulary; the
    vocabulary join is left to Spark's size-checked broadcast / AQE.
    """
    v = vocab.where(~F.col("token").isin(*SPECIAL_TOKENS)).select(F.col("token").alias("code"))
    long = sequence_tokens(seq).where(F.col("code") != SEP).join(v, "code", "left_semi")
    return long


def _encoded(rows: DataFrame, ids: Column, max_len: int) -> DataFrame:
    """``ids`` after [CLS], padded and masked to ``max_len``."""
    body = F.concat(F.array(F.lit(CLS_ID)), ids)
    n = F.size(body)
    spare = F.lit(max_len) - n
    return rows.select("patid", F.concat(body, F.array_repeat(F.lit(PAD_ID), spare)).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), spare)).alias("attention_mask"))


def _encode_in_place(seq: DataFrame, vocab: DataFrame, max_len: int) -> DataFrame:
    """(patid, ids): tokens looked up in a broadcast dictionary, arrays stay as they are."""
    known = seq.sparkSession.sparkContext.broadcast(vocab.select("token", "idx").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = known.value.column("token").combine_chunks()
        numbers = known.value.column("idx").combine_chunks().cast(pa.int32())
        for batch in batches:
            cut = pc.list_slice(batch.column("code"), 0, max_len - 1)
            at = pc.index_in(cut.flatten(), value_set=tokens)
            ids = pc.fill_null(numbers.take(at), UNK_ID)
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(cut)))))
            yield pa.record_batch({"patid": batch.column("patid"),
                                   "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)})

    return seq.select("patid", "code").mapInArrow(run, f"patid {dict(seq.dtypes)['patid']}, ids array<int>")


def _encode_by_join(seq: DataFrame, vocab: DataFrame, max_len: int) -> DataFrame:
    """(patid, ids): tokens meet the vocabulary in a join salted by position; specials, the
    commonest tokens, are numbered by a literal map before it."""
    specials = F.create_map(*[F.lit(x) for i, t in enumerate(SPECIAL_TOKENS) for x in (t, i)])
    salts = F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))
    long = sequence_tokens(seq).where(F.col("pos") <= max_len - 1)
    long = long.withColumn("_special", F.try_element_at(specials, F.coalesce("code", F.lit(""))))
    long = long.withColumn("_salt", F.when(F.col("_special").isNull(), (F.col("pos") % JOIN_SALTS).cast("int")))
    words = vocab.where(~F.col("token").isin(*SPECIAL_TOKENS)).select(F.col("token").alias("code"), "idx", F.explode(salts).alias("_salt"))
    ids = long.join(words, ["code", "_salt"], "left").withColumn("idx", F.coalesce("_special", "idx", F.lit(UNK_ID)).cast("int"))
    return ids.groupBy("patid").agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_t")).select(
        "patid", F.col("_t.idx").alias("ids"))


def vocab_encode(seq: DataFrame, vocab: DataFrame, max_len: int = 512, max_dictionary: int = MAX_DICTIONARY) -> DataFrame:
    """token ids with [CLS] first, truncated to ``max_len``, padded, masked.

    Returns (patid, input_ids[], attention_mask[]) of the patients with a token; ``patid``
    is distinct.  Unknown tokens map to UNK.  A vocabulary of at most ``max_dictionary``
    tokens is broadcast and looked up without a shuffle, a larger one is joined.
    """
    seq = seq.where(F.size("code") > 0)
    small = vocab.limit(max_dictionary + 1).count() <= max_dictionary
    rows = (_encode_in_place if small else _encode_by_join)(seq, vocab, max_len)
    return _encoded(rows, F.col("ids"), max_len)
