"""N-gram Jaccard join with Bayesian pruning (operator 8).

Documents whose sets of five-word shingles have a Jaccard similarity of at
least 0.8 are linked.

1. Equal texts form one class, counted and represented once: a text that a
   third of all rows repeats is one row from here on.
2. A class gets 128 MinHash values.  Bands of four values make candidates (a
   pair at 0.8 shares none of 32 bands with probability 5e-8).
3. Candidates are compared value by value, 16 more at a time; a pair leaves as
   soon as the posterior probability (uniform prior) that its similarity
   reaches 0.8 is below 1e-6.  Members of a large bucket meet in tiles of
   bounded size, and a tile reports for each member one partner at most that it
   is connected with - no pair rows.
4. Connected classes are verified: the shingle sets of a component meet in tiles
   of bounded size and every pair's similarity is counted exactly.  A tile
   reports for each member the number of its links and one partner.

Result: one row per document with its class (documents connected by links), the
class's least doc_id, its number of links (other documents at 0.8 or more,
copies included) and its copy key.

Shuffles carry keys, 128-byte sketches of classes, and the shingle sets of connected
classes; a bit table of fixed size (2 MB, from connected classes' keys) keeps other
texts out.  Nothing else is collected but counts.

Edge cases: words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words has one
shingle, all its words; null texts and texts without words have no links and a
class each of their own key (all such rows of equal text share it, but they count
no links); null ids are allowed and least of all ids only if a class has no other;
repeated rows are documents, linked with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._tables import stage
from cohortlab.llm._words import hash_words, mix64, split_words, text_slices, windows
from cohortlab.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
N_HASH = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-6
TILE = 512                  # members of a bucket that meet in one tile, per side
TILE_SHINGLES = 1 << 18     # shingles that meet in one tile, per side
FILTER_BITS = 24            # bits (as a power of 2) of the filter before texts are shuffled


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(hashlib.sha256(f"minhash:{i}".encode()).digest()[:8] for i in range(N_HASH))
    both = np.frombuffer(raw, np.uint32).reshape(N_HASH, 2)
    return both[:, 0] | np.uint32(1), both[:, 1]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): all five-word shingles of each text, repeats included."""
    offsets, flat = split_words(texts)
    words = hash_words(flat)
    n = np.diff(offsets)
    counts = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(counts)))
    hashes = np.zeros(out[-1], np.uint64)
    every = windows(words, tuple(range(WORDS)))
    long = np.repeat(n >= WORDS, counts)
    starts = np.repeat(offsets[:-1], counts) + np.arange(out[-1]) - np.repeat(out[:-1], counts)
    hashes[long] = every[starts[long]]
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        hashes[out[i]] = windows(words[offsets[i]:offsets[i + 1]], tuple(range(n[i])))[0] + np.uint64(n[i])
    return out, hashes


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (node, doc_id, text): n, bands and sketch; drops the text."""
    a, b = _multipliers()
    for batch in batches:
        for piece in text_slices(batch, limit=1 << 20):
            offsets, hashes = shingles(piece.column("text"))
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            sign = np.zeros((piece.num_rows, N_HASH), np.uint32)
            if len(some):
                h, at = (hashes >> np.uint64(32)).astype(np.uint32), offsets[:-1][some]
                for k in range(N_HASH):
                    sign[some, k] = np.minimum.reduceat(h * a[k] + b[k], at)
            wide = sign.astype(np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(n), 1), np.uint64)
            for r in range(ROWS):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r] + np.uint64(1))
            low = np.ascontiguousarray((sign & np.uint32(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([
                piece.column("node"), piece.column("doc_id"), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32),
                                         pa.array(keys.view(np.int64).ravel())),
                pa.array([x.tobytes() for x in low], pa.binary())], ["node", "doc_id", "n", "bands", "sketch"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values 16, 32, ...: the fewest matches with which
    the posterior of similarity >= threshold is not below the tolerance.  Values are
    kept to 8 bits, so unequal ones match with probability 1/256."""
    s = (np.arange(20000) + 0.5) / 20000
    c = s + (1 - s) / 256
    out = []
    for n in range(STEP, N_HASH + 1, STEP):
        for m in range(n + 1):
            logp = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(logp - logp.max())
            if p[s >= threshold].sum() >= tolerance * p.sum():
                out.append(m)
                break
    return out


def surviving(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (i, j) of sketch rows outlast the incremental comparison."""
    alive, seen = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        seen = seen + (sketch[i[alive], part] == sketch[j[alive], part]).sum(1, dtype=np.int32)
        keep = seen >= need
        alive, seen = alive[keep], seen[keep]
    return alive


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row connected with each of n rows by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def tile_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, run starts) of whole runs of equal keys in sorted batches; the last run
    of a batch waits for the next batch (a run is a tile, of bounded size)."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = cut(table)
        if len(starts) > 2:
            yield table.slice(0, starts[-2]), starts[:-1]
        held = table.slice(starts[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def tile_pairs(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that a tile is for: within its block, or across its two blocks."""
    if same:
        return np.triu_indices(len(side), 1)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def prune_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of bucket members -> (a, b) edges that connect what survives."""
    least = least_matches()
    for table, starts in tile_runs(batches, ["bucket", "ti", "tj"]):
        nodes = table.column("node").combine_chunks()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, N_HASH)
        side = table.column("side").to_numpy()
        same = (table.column("ti").to_numpy() == table.column("tj").to_numpy())
        left, right, held = [], [], 0
        found_i, found_j = [], []

        def run():
            i, j = np.concatenate(left), np.concatenate(right)
            alive = surviving(sketch, i, j, least)
            found_i.append(i[alive])
            found_j.append(j[alive])

        for s, e in zip(starts[:-1], starts[1:]):
            i, j = tile_pairs(side[s:e], bool(same[s]))
            left.append(i + s)
            right.append(j + s)
            held += len(i)
            if held > 100_000:
                run()
                left, right, held = [], [], 0
        if held:
            run()
        if found_i:
            label = lowest(table.num_rows, np.concatenate(found_i), np.concatenate(found_j))
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], ["a", "b"])


def _filter_place(node: str):
    return F.pmod(F.xxhash64(node), F.lit(1 << FILTER_BITS))


def member_filter(members: DataFrame) -> np.ndarray:
    """Bit table of the members' keys, of fixed size: texts that it lacks are no
    members; texts that it has are looked up."""
    place = members.select(_filter_place("node").alias("at"))
    words = place.groupBy(F.expr("int(at div 64)").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def member_shingles(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(root, blocks, node, n_docs, shingles): the sorted distinct shingles of each
    member.  Only texts that pass the filter become shingle sets and are shuffled."""
    table = rows.sparkSession.sparkContext.broadcast(member_filter(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy().astype(np.uint64)
            bit = table.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            for piece in text_slices(batch.filter(pa.array(bit.astype(bool)))):
                offsets, hashes = shingles(piece.column("text"))
                sets = [np.unique(hashes[s:e]).tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("node"), piece.column("doc_id"), pa.array(sets, pa.binary())],
                                                 ["node", "doc_id", "shingles"])

    sets = (rows.withColumn("at", _filter_place("node"))
            .mapInArrow(run, "node binary, doc_id long, shingles binary"))
    same = (F.col("s.node") == F.col("m.node")) & F.col("s.doc_id").eqNullSafe(F.col("m.rep"))
    return (sets.alias("s").join(members.alias("m"), same)
            .select("root", "blocks", "m.node", "n_docs", "shingles").dropDuplicates(["node"]))


def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of component members -> (node, links, partner): linked documents counted
    exactly, and the least row of the tile that the node is connected with."""
    for table, starts in tile_runs(batches, ["root", "ti", "tj"]):
        all_nodes = table.column("node").combine_chunks()
        sets = table.column("shingles").to_pylist()
        copies = table.column("n_docs").to_numpy()
        sides, same = table.column("side").to_numpy(), table.column("ti").to_numpy() == table.column("tj").to_numpy()
        rows, links, partners = [], [], []
        for s, e in zip(starts[:-1], starts[1:]):
            own = [np.frombuffer(x, np.uint64) for x in sets[s:e]]
            n = np.array([len(x) for x in own])
            ends = np.cumsum(n)
            vocabulary, code = np.unique(np.concatenate(own), return_inverse=True)
            mark = np.zeros(len(vocabulary), bool)
            side, linked = sides[s:e], np.zeros(e - s, np.int64)
            pi, pj = [], []
            later = np.arange(e - s)
            for i in range(e - s):
                if same[s]:
                    others = later[i + 1:]
                elif side[i] == 0:
                    others = np.flatnonzero(side == 1)
                else:
                    continue
                others = others[(THRESHOLD * n[others] <= n[i]) & (n[others] >= THRESHOLD * n[i])]
                if not len(others):
                    continue
                mark[code[ends[i] - n[i]:ends[i]]] = True
                if len(others) == 1:
                    common = np.array([mark[code[ends[others[0]] - n[others[0]]:ends[others[0]]]].sum()])
                else:
                    lo = others[0]
                    flags = mark[code[ends[lo] - n[lo]:ends[others[-1]]]]
                    sums = np.concatenate(([0], np.cumsum(flags)))
                    base = ends[lo] - n[lo]
                    common = sums[ends[others] - base] - sums[ends[others] - n[others] - base]
                mark[code[ends[i] - n[i]:ends[i]]] = False
                near = others[common >= THRESHOLD * (n[i] + n[others] - common) - 1e-9]
                linked[i] += copies[s:e][near].sum()
                linked[near] += copies[s + i]
                pi.append(np.full(len(near), i))
                pj.append(near)
            label = lowest(e - s, np.concatenate(pi), np.concatenate(pj)) if pi else later
            kept = np.flatnonzero(linked)
            rows.append(kept + s)
            links.append(linked[kept])
            partners.append(label[kept] + s)
        at = np.concatenate(rows)
        if len(at):
            yield pa.RecordBatch.from_arrays([all_nodes.take(pa.array(at)), pa.array(np.concatenate(links)),
                                              all_nodes.take(pa.array(np.concatenate(partners)))],
                                             ["node", "links", "partner"])


def _tiles(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deal each row to the tiles of its group: block i meets every block j."""
    mine = F.pmod(F.xxhash64("node", F.lit("tile")), F.col(blocks))
    dealt = (rows.withColumn("_mine", mine)
             .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
             .withColumn("ti", F.least("_mine", "_other")).withColumn("tj", F.greatest("_mine", "_other"))
             .withColumn("side", F.when(F.col("_mine") == F.col("ti"), 0).otherwise(1)).drop("_mine", "_other", blocks))
    return dealt.repartition(key, "ti", "tj").sortWithinPartitions(key, "ti", "tj", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, class_key, copy_key) of every document row."""
    rows = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("node"), "doc_id", "text")
    sketched = stage(rows.mapInArrow(sketch_batches, "node binary, doc_id long, n long, bands array<long>, sketch binary"),
                     "nd-sketches")
    classes = stage(sketched.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"),
                                                 F.first("n").alias("n"), F.first("bands").alias("bands"),
                                                 F.first("sketch").alias("sketch")), "nd-classes")
    # candidates: buckets of two and more
    posted = classes.filter("n > 0").select("node", F.explode("bands").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    meeting = (posted.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("size") / TILE))
               .select("bucket", "blocks", "node").join(classes.select("node", "sketch"), "node"))
    edges = _tiles(meeting, "bucket", "blocks").mapInArrow(prune_batches, "a binary, b binary").distinct()
    connected = components(edges)
    # verification, component by component
    members = stage(classes.select("node", "rep", "n_docs", "n").join(connected, "node"), "nd-members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("all") / TILE_SHINGLES)).alias("blocks")
    members = members.join(sizes.select("root", blocks), "root")
    sets = member_shingles(rows, members)
    verified = stage(_tiles(sets, "root", "blocks")
                     .mapInArrow(verify_batches, "node binary, links long, partner binary"), "nd-links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.filter("node <> partner").select(F.col("node").alias("a"), F.col("partner").alias("b")))
    found = (classes.select("node", "rep", "n_docs", "n").join(links, "node", "left")
             .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = found.groupBy("root").agg(F.min("rep").alias("class_id"))
    found = stage(found.join(least, "root").select(
        "node", "root", "class_id",
        F.when(F.col("n") > 0, F.col("n_docs") - 1 + F.coalesce(F.col("links"), F.lit(0))).otherwise(0).alias("n_links")),
        "nd-classes")
    return (sketched.select("node", "doc_id").join(found, "node")
            .select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"),
                    F.lower(F.hex("root")).alias("class_key"), F.lower(F.hex("node")).alias("copy_key")))


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the row with the least
    doc_id (null ids last), of equal ids the least copy key.  Of rows without words one
    of each text stays."""
    found = near_duplicates(docs)
    first = (found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy_key")).alias("k"))
             .select(F.col("k.doc_id").alias("_id"), F.col("k.copy_key").alias("_copy")))
    # texts meet the kept keys in one shuffle at every size; of repeated rows one is left.
    # The rows travel as one struct, so their columns may have any names
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"),
                        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    same = (F.col("_text") == F.col("_copy")) & F.col("_doc").eqNullSafe(F.col("_id"))
    return keyed.join(first.hint("merge"), same, "left_semi").dropDuplicates(["_doc", "_text"]).select("row.*")
