"""Mixing sources to target weights (operator 1, DataFrame functions only).

A low-discrepancy schedule decides which source fills each slot of the mix:
golden-ratio points are mapped through the cumulative target weights, the
slots of a source are ranked, and slot number k of a source takes the k-th
equal-sized block of words of that source's shuffled documents.

* The points are ``(i * F45 mod F46) / F46`` for consecutive Fibonacci numbers
  (the golden ratio in exact integers), scaled to the total of the targets.
* A source's documents are laid on a line in the order of a hash of their id;
  the line is as long as its words and runs a second time if its target asks
  for it.  Blocks cut the line every ``block_words`` words, the last one at the
  target, so a source gives exactly its rounded target.
* Points are spread evenly but not exactly: a source whose slots are a few
  short gets the missing ranks after the last slot; ranks beyond a target stay
  unused.

Scale: no window or group holds a source.  Line positions and slot ranks are
prefix sums over buckets of a few thousand rows, then over bucket totals.  The
driver sees one row (number of slots and sources).

Edge cases: a null text or one of blanks has size 0 and takes 0; a null source
is a source of its own, after all others; documents without id are shuffled as
if their id were empty; repeated rows are documents of their own; no rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.llm._tables import stage
from cohortlab.llm._words import WORD

WEIGHTS = (5, 2, 1)
F45, F46 = 1134903170, 1836311903       # fixed values: Fibonacci numbers
BLOCK_WORDS = 256
BUCKET_ROWS = 4096
SLOT_CHUNK = 65536


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def document_sizes(docs: DataFrame, salt: str = "mix") -> DataFrame:
    """(doc_id, source, size, h): words of each document and its shuffle key."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                      F.lit(f":{salt}"))).alias("h"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: int = 2,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: (src, source, n_docs, source_size, weight, target, want).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``cap`` times its source and
    the rest is shared again by weight (water filling: with sources ordered by
    cap over weight, the level is the first one that the next cap exceeds).
    ``want`` is the target rounded to words.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())           # one row per source
    per = per.withColumn("src", F.row_number().over(by_name) - 1)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(ws, (F.col("src") % len(weights)).cast("int") + 1))
    most = F.lit(float(cap)) * F.col("source_size")
    by_ratio = Window.orderBy(most / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = (per.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(whole)
                          - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
           .withColumn("w_left", F.sum("weight").over(after))
           .withColumn("place", F.row_number().over(by_ratio)))
    open_ = F.col("weight") * F.col("left") / F.col("w_left") <= most
    per = per.withColumn("level", F.min(F.when(open_, F.struct("place", "left", "w_left"))).over(whole))
    target = F.least(most, F.col("weight") * F.col("level.left") / F.col("level.w_left"))
    return (per.withColumn("target", target)
            .select("src", "source", "n_docs", "source_size", "weight", "target",
                    F.floor(F.col("target") + 0.5).cast("long").alias("want")))


def _bucket_offsets(totals: DataFrame, group: str, bucket: str, value: str) -> DataFrame:
    """Sum of ``value`` over the smaller buckets of the group, in two levels so
    that no window holds more than a few thousand rows of a group's buckets."""
    top = totals.withColumn("_top", F.floor(F.col(bucket) / BUCKET_ROWS))
    inner = Window.partitionBy(group, "_top").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    tops = (top.groupBy(group, "_top").agg(F.sum(value).alias("_sum"))
            .select(group, "_top", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_above")))
    return (top.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(tops, [group, "_top"])
            .select(group, bucket, (F.col("_in") + F.col("_above")).alias("_off")))


def document_lines(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's place on its source's line: adds src, bucket, seq (its
    unique key) and start (words before it in hash order)."""
    near = targets.select("src", F.col("source").alias("_s"), "n_docs", "source_size", "target", "want")
    rows = sizes.join(near, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    lead = F.conv(F.substring("h", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(lead * buckets / (1 << 28)).cast("long"))
    totals = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    offsets = _bucket_offsets(totals, "src", "bucket", "words")
    order = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("seq", F.row_number().over(order))
            .withColumn("_in", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
            .join(offsets, ["src", "bucket"])
            .withColumn("start", F.col("_in") + F.col("_off")).drop("_in", "_off", "n_docs", "h"))


def slot_sources(targets: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int, int]:
    """(slot, src, rank) of every slot, the number of slots and of sources."""
    spark = targets.sparkSession
    one = targets.agg(F.sum("want").alias("w"), F.count(F.lit(1)).alias("n")).first()
    total, n_sources = int(one["w"] or 0), int(one["n"])
    n_slots = -(-total // block_words)
    # a source's interval of the cumulative targets, found by grid cell
    width = max(1, -(-total // max(1024, 4 * n_sources)))
    upto = Window.orderBy("src")                                          # one row per source
    spans = (targets.withColumn("hi", F.sum("want").over(upto)).withColumn("lo", F.col("hi") - F.col("want"))
             .filter("want > 0")
             .select("src", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell")))
    big = "decimal(38,0)"
    point = (((F.col("slot") % F46) * F45) % F46).cast(big)
    slots = (spark.range(n_slots).withColumnRenamed("id", "slot")
             .withColumn("at", F.floor(point * F.lit(total).cast("decimal(18,0)") / F.lit(F46)).cast("long"))
             .withColumn("cell", F.expr(f"at div {width}")))
    slots = (slots.join(spans, "cell").filter("at >= lo AND at < hi")
             .select("slot", "src", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk")))
    offsets = _bucket_offsets(slots.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n")), "src", "chunk", "n")
    order = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = (slots.withColumn("_in", F.row_number().over(order) - 1).join(offsets, ["src", "chunk"])
              .select("slot", "src", (F.col("_in") + F.col("_off")).alias("rank")))
    return ranked, n_slots, n_sources


def mix_schedule(lines: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS,
                 cap: int = 2) -> DataFrame:
    """The mix: (slot, src, rank, doc_id, bucket, seq, from_word, to_word).

    Words ``from_word`` to ``to_word`` (exclusive) of the document stand in the
    slot; slots in order are the mix.
    """
    slots, n_slots, n_sources = slot_sources(targets, block_words)
    runs = lines.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    runs = (runs.withColumn("lo", F.col("run") * F.col("source_size") + F.col("start"))
            .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("want")))
            .filter("hi > lo")
            .withColumn("rank", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})"))))
    first = F.greatest(F.col("lo"), F.col("rank") * block_words)
    last = F.least(F.col("hi"), (F.col("rank") + 1) * block_words)
    pieces = runs.select("src", "rank", "doc_id", "bucket", "seq", (first - F.col("lo")).alias("from_word"),
                         (last - F.col("lo")).alias("to_word"))
    late = F.lit(n_slots) + F.col("rank") * n_sources + F.col("src")
    return pieces.join(slots, ["src", "rank"], "left").withColumn("slot", F.coalesce(F.col("slot"), late))


def mix_documents(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS,
                  block_words: int = BLOCK_WORDS, salt: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(lines, schedule) of the whole mix of ``docs`` (doc_id, source, text).

    ``lines`` has each document with its source's size and target, ``schedule``
    the pieces of :func:`mix_schedule`.
    """
    sizes = stage(document_sizes(docs, salt), "mix-sizes")
    targets = stage(source_targets(sizes, share, cap, weights), "mix-targets")
    lines = stage(document_lines(sizes, targets), "mix-lines")
    return lines, mix_schedule(lines, targets, block_words, cap)


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    lines, schedule = mix_documents(docs, **options)
    took = schedule.groupBy("src", "bucket", "seq").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return (lines.join(took, ["src", "bucket", "seq"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).alias("taken")))
