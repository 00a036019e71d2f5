"""Words of texts inside Arrow batches (numpy and Arrow, used within tasks).

A word is a run of characters other than space, tab, newline, vertical tab,
form feed and carriage return: ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SLICE_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices of about ``limit`` bytes of text (one row at
    least), so that a task's memory does not depend on the batch size."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, flat words): text i has words ``flat[offsets[i]:offsets[i+1]]``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        offsets = before[offsets]
        flat = flat.filter(pa.array(full))
    return offsets.astype(np.int64), flat


def hash_words(flat: pa.Array, normal: Callable[[str], str] | None = None) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once.

    ``normal`` maps a word before hashing; words that it empties get 0.
    """
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    if normal is not None:
        words = [normal(w) for w in words]
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) if w else 0 for w in words), np.uint64, len(words))
    return table[np.asarray(coded.indices)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``positions`` after each start.

    Start i covers ``hashes[i + p] for p in positions``; there are
    ``len(hashes) - positions[-1]`` starts (none if that is negative).
    """
    n = len(hashes) - positions[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p in positions:
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[p:p + n]
    return mix64(out)
