"""Merkle manifest of a dataset with a proof for every row (operator 13).

Every row is a leaf, every tree (here: a language) hashes its leaves in pairs up to a
subroot, and the subroots are the leaves of one last tree.  H is the lowercase hex
sha256 of the concatenated inputs; digests go in as hex text.

Method: nested-struct rollup.  A leaf's rank in its tree is cut into digits of
``DIGIT_BITS`` bits.  Within a block of 16 x 16 nodes the digits are grouped away one
after the other, from the last: a group collects at most 16 child structs in the order
of their digit, hashes its ``DIGIT_BITS`` levels and is the child struct of the next
group.  All groupings of a block run on one hash partitioning by (tree, block).  A
final ``posexplode`` of the nested runs emits every node's siblings without joins.
Trees of more than 256 leaves repeat this over the block nodes; a block row meets its
own one path from the tier above (one row on each side), so no join has a hot key.

Scale: ranks come from a range partitioning by (tree, order, leaf, row) and counts per
partition, so a tree with a third of all rows, or one order value with a third of all
rows, is spread over tasks like any other.  No task holds more than 256 nodes of a
block at a time; the driver sees one number (the levels of the highest tree).  Every
tier is a written table in the shared folder, so lost executors repeat little.

Edge cases: a null field is ``-``; leaves with a null doc_id come first; rows with
equal doc_id are ordered by their leaf hash, and rows equal in all five fields are
separate leaves with equal digests; the null language is a tree of its own and the
first one; a lone leaf is its own subroot, a lone subroot the root (empty proof); an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm._tables import stage

DIGIT_BITS = 4
BLOCK_DIGITS = 2
BLOCK_BITS = DIGIT_BITS * BLOCK_DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<l: string, r: string>"


# -- hashes -------------------------------------------------------------------------------


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(values: Sequence[Column]) -> Column:
    """H of the fields: ``-`` for null, else byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return sha(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def pairs(nodes: Column) -> Column:
    """The next level: H of every two consecutive nodes, of the last one alone if it is odd."""
    last = F.shiftright(F.size(nodes) - 1, 1)
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: sha(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def siblings(levels: Column, place: Column) -> Column:
    """Steps (l, r) from the node at ``place`` of the lowest level to the top of its run;
    '' where there is no sibling on that side."""
    def step(row: Column, k: Column) -> Column:
        i = F.call_function("shiftright", place, k)
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.get(row, i - 1)).otherwise("").alias("l"),
                        F.when(odd, F.lit("")).otherwise(F.coalesce(F.get(row, i + 1), F.lit(""))).alias("r"))
    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path give."""
    return F.aggregate(path, leaf, lambda node, s: sha(s["l"], node, s["r"]))


def path_text(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.aggregate(path, F.lit(""), lambda text, s: F.concat(text, s["l"], s["r"]))


# -- ranks --------------------------------------------------------------------------------


def ranked(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``idx`` (0-based rank in ``tree`` by ``order``) and ``levels`` (of the tree)
    to staged ``nodes``.  ``order`` must end with columns that tell all rows apart."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = stage(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()),
                   f"merkle-{name}-order")
    tree = Window.partitionBy("tree")
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    parts = parts.select(F.col("tree").alias("t"), F.col("part").alias("p"), "first",
                         (F.sum("rows").over(tree.orderBy("part")) - F.col("rows")).alias("before"),
                         F.sum("rows").over(tree).alias("leaves"))
    levels = F.when(F.col("leaves") > 1, F.length(F.bin(F.col("leaves") - 1))).otherwise(0)
    return (placed.join(parts, placed["tree"].eqNullSafe(parts["t"]) & (placed["part"] == parts["p"]))
            .withColumn("idx", F.col("row") - F.col("first") + F.col("before"))
            .withColumn("levels", levels.cast("int")).drop("t", "p", "part", "row", "first", "before", "leaves"))


# -- rollup -------------------------------------------------------------------------------


def rolled_up(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(tree, block, levels, node) from (tree, idx, levels, h, payload): the nodes of each
    block nested in runs of 16, with the hashes of all levels of a run."""
    digits = [f"digit{d}" for d in range(BLOCK_DIGITS)]
    base = 1 << DIGIT_BITS
    x = nodes.select("tree", "levels", F.shiftright("idx", BLOCK_BITS).alias("block"),
                     *[(F.shiftright("idx", DIGIT_BITS * d) % base).cast("int").alias(c) for d, c in enumerate(digits)],
                     F.struct("h", *payload).alias("node"))
    x = x.repartition("tree", "block")
    for d, digit in enumerate(digits):
        rest = ["tree", "block", "levels", *digits[d + 1:]]
        x = x.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("run"))
        height = F.greatest(F.lit(0), F.least(F.lit(DIGIT_BITS), F.col("levels") - DIGIT_BITS * d))
        upward = F.slice(F.array(*[F.lit(i) for i in range(DIGIT_BITS)]), F.lit(1), height)
        x = x.withColumn("hashes", F.aggregate(upward, F.array(F.col("run.node.h")),
                                               lambda rows, _: F.concat(rows, F.array(pairs(F.element_at(rows, -1))))))
        x = x.select(*rest, F.struct(F.element_at("hashes", -1)[0].alias("h"), "hashes",
                                     F.col("run.node").alias("kids")).alias("node"))
    return x


def tiers_of(nodes: DataFrame, payload: Sequence[str], name: str) -> list[DataFrame]:
    """Staged block tables from the leaves up; the last one has one block per tree."""
    nodes = stage(nodes, f"merkle-{name}-ranked")
    highest = nodes.agg(F.max("levels")).first()[0] or 0
    tiers = []
    for t in range(max(1, -(-highest // BLOCK_BITS))):
        tiers.append(stage(rolled_up(nodes, [] if t else payload), f"merkle-{name}-tier{t}"))
        nodes = tiers[-1].select("tree", F.col("block").alias("idx"), "node.h",
                                 F.greatest(F.lit(0), F.col("levels") - BLOCK_BITS).alias("levels"))
    return tiers


def proofs(tiers: list[DataFrame], above: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(tree, idx, h, payload, path, further columns of ``above``) of every leaf.

    ``above`` has one row (tree, idx 0, path, ...) per tree: the steps that follow its top.
    """
    further = [c for c in above.columns if c not in ("tree", "idx", "path")]
    for t in reversed(range(len(tiers))):
        up = above.withColumnsRenamed({"tree": "up_tree", "idx": "up_idx"})
        x = tiers[t].join(up, F.col("tree").eqNullSafe(F.col("up_tree")) & (F.col("block") == F.col("up_idx")))
        x = x.select("tree", F.col("block").alias("idx"), "node", "path", *further)
        for _ in range(BLOCK_DIGITS):
            x = x.select("tree", "idx", "path", *further, F.col("node.hashes").alias("hashes"), F.posexplode("node.kids"))
            x = x.select("tree", (F.col("idx") * (1 << DIGIT_BITS) + F.col("pos")).alias("idx"), F.col("col").alias("node"),
                         F.concat(siblings(F.col("hashes"), F.col("pos")), "path").alias("path"), *further)
        kept = ["node.h", *(f"node.{c}" for c in payload)] if t == 0 else []
        above = x.select("tree", "idx", "path", *kept, *further)
    return above


def manifest(leaves: DataFrame, order: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """Every leaf with its subroot, the root and its path.

    ``leaves`` has ``tree`` (any type, null is a tree), ``h`` (the leaf digest), the
    ``order`` columns and the ``payload`` columns.  Returns tree, idx (rank in the
    tree), h, payload, path (array of steps: left and right sibling, '' if none),
    subroot, root.
    """
    order = [*order, "h", "row_key"]
    staged = stage(leaves.withColumn("row_key", F.monotonically_increasing_id()), "merkle-leaves")
    trees = tiers_of(ranked(staged, order, "rows").select("tree", "idx", "levels", "h", *payload), payload, "rows")
    tops = trees[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "node.h")
    last = tiers_of(ranked(tops, ["name"], "trees").select("tree", "idx", "levels", "h", "name"), ["name"], "trees")
    root = last[-1].select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast(f"array<{STEP}>").alias("path"),
                           F.col("node.h").alias("root"))
    named = proofs(last, root, ["name"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path",
                                                F.col("h").alias("subroot"), "root")
    return proofs(trees, named, payload)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` by language, and a check of it against rows that were changed:
    where 7 divides the unsigned crc32 of the decimal doc_id, n_chars is one larger."""
    fields = [F.col(c) for c in FIELDS]
    changed = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), leaf_hash(fields).alias("h"),
                         F.when(tampered, leaf_hash(changed)).alias("seen"))
    proven = manifest(leaves, ["doc_id"], ["doc_id", "seen"])
    folded = proven.withColumn("folded_root", fold(F.coalesce("seen", "h"), F.col("path")))
    return folded.select("doc_id", F.col("h").alias("leaf"), "subroot", "root",
                         F.sha2(path_text(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
