"""How far the sources of a language diverge, term by term (operator 11).

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A language
keeps the terms in at least ``MIN_DOCS`` of its documents.  With a group's share of each
kept term as an integer p out of 10^9 (add-two smoothed), two groups differ by
f = floor((p-q)^2 / (p+q)) in a term.  Reported are the sum of f between every two
sources of a language, and each source's terms that are furthest above their language.

Method: minimal-perfect-hash recount.  The first pass counts documents per (language,
term) exactly and filters.  The kept terms of a language are dealt to shards by hash,
each with a perfect hash over its terms (:mod:`perfect_hash`) built in a task.  The
shards are broadcast and a second pass over the texts increments dense arrays of one
slot a term for each (language, source); a term that was not kept is told by the
comparison with the stored key.  Shards then meet as numpy matrices (sources x slots).

Scale: one broadcast holds at most ``BROADCAST_BYTES`` of shards; if all shards are
larger the texts are recounted for one part of the shards after the other.  Tasks sum in
dictionaries and arrays of bounded size, and send their sums on when these are full;
Spark adds them up by (language, source, shard, slot), so a hot source or language
is spread over slots.  A matrix has at most 2 x ``TILE_SOURCES`` sources and about
``SHARD_TERMS`` slots; more sources meet in tiles (every pair of a language's sources is
part of the result).  Ranking sees ten rows a shard and group.

All arithmetic is exact in 64-bit integers while a group has less than 9 * 10^13 terms.

Edge cases: null text, language and source are ''; a group without terms, and a language
without kept terms, still give their pairs (with equal shares, or value 0); ties are in
UTF-8 order of the item; repeated rows are documents of their own; very long texts are
read in pieces cut between terms; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm._tables import stage
from cohortlab.llm._words import text_slices
from cohortlab.llm.perfect_hash import PerfectHash, hash64

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
SHARD_TERMS = 8192
TILE_SOURCES = 128
SALTS = 64
BROADCAST_BYTES = 32 << 20
PIECE = 4 << 20               # bytes of one text that are split at a time
ENTRIES = 1 << 18             # dictionary entries a task holds before it sends them on
DENSE_BYTES = 64 << 20        # of slot arrays, likewise

#: Byte table: A-Z to lower case, other ASCII that is no letter to a blank.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text, start = text.translate(FOLDED), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE) if start + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def grouped_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[tuple, bytes]]]:
    """For each slice of a few MB: its (group, text) rows; the group is all but the text."""
    for batch in batches:
        for part in text_slices(batch):
            groups = zip(*(part.column(c).to_pylist() for c in part.schema.names if c != "text"))
            yield zip(groups, part.column("text").cast(pa.binary()).to_pylist())


# -- first pass: exact document counts, shards -----------------------------------------------


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def sums() -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(counter), pa.string()),
                                   "term": pa.array(list(counter), pa.binary()).cast(pa.string()),
                                   "docs": pa.array(list(counter.values()), pa.int64())})
        held.clear()

    for rows in grouped_texts(batches):
        for (lang,), text in rows:
            terms: set[bytes] = set()
            for piece in term_lists(text):
                terms.update(piece)
            held[lang].update(terms)
        if sum(map(len, held.values())) > ENTRIES:
            yield from sums()
    yield from sums()


def kept_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    counts = texts.select("lang", "text").mapInArrow(document_counts, "lang string, term string, docs long")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)


def build_shard(rows: pa.Table) -> pa.Table:
    levels, order, keys = PerfectHash.build(rows.column("term").cast(pa.binary()).to_pylist())
    return pa.table({"lang": rows.column("lang")[:1], "shard": rows.column("shard")[:1], "shards": rows.column("shards")[:1],
                     "sizes": pa.array([[s for s, _ in levels]], pa.list_(pa.int32())),
                     "bits": pa.array([[b for _, b in levels]], pa.list_(pa.binary())),
                     "numbers": pa.array([order.tolist()], pa.list_(pa.int32())),
                     "terms": pa.array([[k.decode() for k in keys]], pa.list_(pa.string()))})


def term_shards(kept: DataFrame, shard_terms: int) -> DataFrame:
    """One row per (lang, shard): a perfect hash over its terms; ``terms`` are in slot order.

    The number of a language's shards meets its terms in a join salted by the term's hash, so
    the terms of one language are spread over ``SALTS`` keys.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard_terms).cast("int").alias("shards")).withColumn("salt", salts)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    dealt = salted.join(sizes, ["lang", "salt"]).select(
        "lang", "term", "shards", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    return dealt.groupBy("lang", "shard").applyInArrow(
        build_shard, "lang string, shard int, shards int, sizes array<int>, bits array<binary>, numbers array<int>, terms array<string>")


# -- second pass: dense counts ---------------------------------------------------------------


def open_shards(tables: list[pa.Table]) -> dict[str, tuple[int, dict[int, PerfectHash]]]:
    out: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
    for table in tables:
        for row in range(table.num_rows):
            lang, shard, shards, sizes, bits, numbers = (table.column(c)[row].as_py() for c in table.schema.names[:6])
            keys = table.column("terms")[row].values.cast(pa.binary())
            levels = list(zip(sizes, bits))
            out.setdefault(lang, (shards, {}))[1][shard] = PerfectHash(levels, np.array(numbers, np.int32), keys)
    return out


def recount(shards) -> Callable:
    """Task function: counts of the broadcast shards' terms by (lang, source)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = open_shards(shards.value)
        held: dict[tuple, Counter] = defaultdict(Counter)
        dense: dict[tuple, np.ndarray] = {}

        def pour() -> None:
            """Adds the dictionaries' counts to the slots of their groups."""
            by_lang: dict[str, list] = defaultdict(list)
            for (lang, source), counter in held.items():
                by_lang[lang].append((source, counter))
            held.clear()
            for lang, counters in by_lang.items():
                n_shards, tables = hashes[lang]
                terms = [t for _, c in counters for t in c]
                keys, h = pa.array(terms, pa.binary()), hash64(terms)
                counts = np.fromiter((n for _, c in counters for n in c.values()), np.int64, len(terms))
                group = np.repeat(np.arange(len(counters)), [len(c) for _, c in counters])
                shard = h.astype(np.int64) % n_shards
                for s, table in tables.items():
                    mine = np.flatnonzero(shard == s)
                    slot = table.slots(h[mine], keys.take(pa.array(mine)))
                    mine, slot = mine[slot >= 0], slot[slot >= 0]
                    ends = np.searchsorted(group[mine], np.arange(len(counters) + 1))
                    for g, (source, _) in enumerate(counters):
                        if ends[g] < ends[g + 1]:
                            key = lang, source, s
                            if key not in dense:
                                dense[key] = np.zeros(len(table.keys), np.int64)
                            dense[key][slot[ends[g]:ends[g + 1]]] += counts[mine[ends[g]:ends[g + 1]]]

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source, s), counts in dense.items():
                slot = np.flatnonzero(counts)
                yield pa.record_batch({"lang": pa.array([lang] * len(slot), pa.string()),
                                       "source": pa.array([source] * len(slot), pa.string()),
                                       "shard": pa.array(np.full(len(slot), s, np.int32)),
                                       "slot": pa.array(slot.astype(np.int32)), "n": pa.array(counts[slot])})
            dense.clear()

        for rows in grouped_texts(batches):
            for group, text in rows:
                if group[0] in hashes:
                    for piece in term_lists(text):
                        held[group].update(piece)
            if sum(map(len, held.values())) > ENTRIES:
                pour()
            if sum(a.nbytes for a in dense.values()) > DENSE_BYTES:
                yield from sums()
        pour()
        yield from sums()

    return count


def rounds_of(shards: DataFrame, limit: int) -> Iterator[list[tuple[str, int]]]:
    """(lang, shard) keys of as many shards as one broadcast may hold, until all are named."""
    size = sum(F.aggregate(F.transform(c, F.octet_length), F.lit(0), lambda a, b: a + b) for c in ("terms", "bits"))
    sizes = shards.select("lang", "shard", (size + 14 * F.size("terms")).alias("bytes")).orderBy("lang", "shard").collect()
    part, total = [], 0
    for lang, shard, nbytes in sizes:
        if part and total + nbytes > limit:
            yield part
            part, total = [], 0
        part.append((lang, shard))
        total += nbytes
    if part:
        yield part


def slot_counts(texts: DataFrame, shards: DataFrame, limit: int) -> DataFrame:
    """(lang, source, shard, slot, n) of every kept term that occurs in a group."""
    spark, parts = texts.sparkSession, []
    schema = "lang string, source string, shard int, slot int, n long"
    for keys in rounds_of(shards, limit):
        wanted = F.broadcast(spark.createDataFrame(keys, "lang string, shard int"))
        sent = spark.sparkContext.broadcast([shards.join(wanted, ["lang", "shard"]).select(*shards.columns).toArrow()])
        sums = texts.mapInArrow(recount(sent), schema).groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        parts.append(stage(sums, "divergence-counts"))
        sent.unpersist()
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


# -- divergences -----------------------------------------------------------------------------


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)); multiplied in two steps to stay in 64 bits."""
    below = (total + 2 * terms)[:, None]
    whole, rest = np.divmod((counts + 2) * 100_000, below)
    return 1 + whole * 10_000 + rest * 10_000 // below


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


TILE = "lang string, shard int, ti int, tj int, place int, source string, slot int, n long, terms long, width int"
FOUND = "lang string, source string, part string, item string, shard int, slot int, value long"


def tile(rows: pa.Table, tile_sources: int) -> pa.Table:
    """Sums of f between the sources of a tile over one shard's slots; on the diagonal
    also each source's ``TOP_TERMS`` slots that are most above the language.

    Rows with slot -1 are heads (place, source, total; place -1 is the language), the
    others are counts."""
    col = {c: rows.column(c).combine_chunks() for c in rows.schema.names}
    place, slot, n = (np.asarray(col[c]) for c in ("place", "slot", "n"))
    ti, tj = col["ti"][0].as_py(), col["tj"][0].as_py()
    heads = np.flatnonzero(slot < 0)
    heads = heads[np.argsort(place[heads])]
    terms, width = col["terms"][int(heads[0])].as_py(), col["width"][int(heads[0])].as_py()
    names, places = col["source"].take(pa.array(heads)).to_pylist(), place[heads]
    counts = np.zeros((len(heads), width), np.int64)
    cells = np.flatnonzero(slot >= 0)
    counts[np.searchsorted(places, place[cells]), slot[cells]] = n[cells]
    p = shares(counts, n[heads], terms)
    out: list[tuple] = []
    tiles = places // tile_sources
    for i in np.flatnonzero((places >= 0) & (tiles == ti)):
        others = np.flatnonzero((tiles == tj) & (places > places[i]))
        sums = difference(p[i], p[others]).sum(axis=1)
        for j, value in zip(others, sums.tolist()):
            out += [(names[i], "pair", names[j], None, None, value), (names[j], "pair", names[i], None, None, value)]
        if ti == tj and width:
            above = np.flatnonzero((counts[i] > 0) & (p[i] > p[0]))
            f = difference(p[i, above], p[0, above])
            for k in np.lexsort((above, -f))[:TOP_TERMS]:
                out.append((names[i], "term", None, col["shard"][0].as_py(), int(above[k]), int(f[k])))
    fields = list(zip(*out)) or [[]] * 6
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    found = {c: pa.array(v, t) for c, v, t in zip(("source", "part", "item", "shard", "slot", "value"), fields, kinds)}
    return pa.table({"lang": pa.array([col["lang"][0].as_py()] * len(out), pa.string())} | found)


def tile_rows(groups: DataFrame, counts: DataFrame, shards: DataFrame, tile_sources: int) -> DataFrame:
    """Heads and counts of every (lang, shard, tile), in the columns of ``TILE``."""
    by_lang = Window.partitionBy("lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = (groups.join(totals, ["lang", "source"], "left").fillna(0, ["n"])
              .withColumn("place", F.row_number().over(by_lang.orderBy("source")) - 1))
    groups = stage(groups.withColumn("sources", F.count("*").over(by_lang)), "divergence-groups")
    widths = shards.select("lang", "shard", F.size("terms").alias("width"))
    sizes = widths.groupBy("lang").agg(F.sum("width").cast("long").alias("terms"))
    widths = groups.select("lang").distinct().join(widths, "lang", "left").join(sizes, "lang", "left")
    widths = widths.fillna(0, ["shard", "width", "terms"])

    last = F.floor((F.col("sources") - 1) / tile_sources).cast("int")
    own = F.floor(F.col("place") / tile_sources).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), last),
                        lambda t: F.struct(F.least(t, own).alias("ti"), F.greatest(t, own).alias("tj")))
    diagonal = F.transform(F.sequence(F.lit(0), last), lambda t: F.struct(t.alias("ti"), t.alias("tj")))

    dealt = groups.select("lang", "source", "place", "n", F.inline(tiles))
    lang = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.first("sources").alias("sources"))
    dealt = dealt.unionByName(lang.select("lang", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("place"), "n",
                                          F.inline(diagonal)))
    heads = dealt.join(widths, "lang").withColumn("slot", F.lit(-1))

    places = groups.select("lang", "source", "place", "sources")
    cells = counts.join(places, ["lang", "source"]).select("lang", "shard", "slot", "n", "place", F.inline(tiles))
    of_lang = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")).join(lang.select("lang", "sources"), "lang")
    cells = cells.unionByName(of_lang.select("lang", "shard", "slot", "n", F.lit(-1).alias("place"), F.inline(diagonal)))
    cells = cells.withColumns({"source": F.lit(None).cast("string"), "terms": F.lit(None).cast("long"),
                               "width": F.lit(None).cast("int")})
    names = [c.split()[0] for c in TILE.split(", ")]
    return heads.select(*names).unionByName(cells.select(*names))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS,
                      broadcast_bytes: int = BROADCAST_BYTES, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources of the
    language) and ``term`` (the ten kept terms furthest above the language)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # written first: both sides of the join in term_shards read it
    kept = stage(kept_terms(texts, min_docs), "divergence-terms")
    shards = stage(term_shards(kept, shard_terms), "divergence-shards")
    counts = slot_counts(texts, shards, broadcast_bytes)
    groups = texts.select("lang", "source").distinct()
    tiles = tile_rows(groups, counts, shards, tile_sources).groupBy("lang", "shard", "ti", "tj")
    found = stage(tiles.applyInArrow(lambda rows: tile(rows, tile_sources), FOUND), "divergence-found")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = found.filter("part = 'term'").drop("item")
    names = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "item"))
    best = best.join(names, ["lang", "shard", "slot"]).select(*pairs.columns)
    out = pairs.unionByName(best).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
