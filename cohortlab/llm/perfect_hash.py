"""Minimal perfect hash over byte strings, with the strings stored for verification.

Levels of bit tables: a key that is alone at its place of a level is settled there,
the others go on to the next, smaller level.  The number of set bits before a key's bit
numbers all keys 0..n-1 without gaps; a stored permutation turns these numbers into the
keys' byte order.  Looking up a string that was not built in ends at another key or
none, which the comparison with the stored string tells (numpy and Arrow, in tasks).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from cohortlab.llm._words import mix64

LEVELS = 24
PLACES_PER_KEY = 2


def hash64(keys: Sequence[bytes]) -> np.ndarray:
    """Spark's ``xxhash64`` of the strings (seed 42), as unsigned numbers."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, 42) for k in keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix64(hashes + salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``levels``: packed bit tables with their sizes; ``order``: number -> slot;
    ``keys``: the strings by slot, ascending."""

    def __init__(self, levels: list[tuple[int, bytes]], order: np.ndarray, keys: pa.Array) -> None:
        self.order, self.keys = order, keys
        self.bits, self.ranks, before = [], [], 0
        for size, packed in levels:
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
            self.bits.append(bits)
            self.ranks.append((np.cumsum(bits) - 1 + before).astype(np.int32))
            before += int(bits.sum())
        # keys whose 64-bit hashes are equal never settle: they are numbered last and found by name
        rest = keys.take(pa.array(order[before:])).to_pylist() if before < len(order) else []
        self.rest = dict(zip(rest, order[before:].tolist()))

    @staticmethod
    def build(keys: list[bytes]) -> tuple[list[tuple[int, bytes]], np.ndarray, list[bytes]]:
        """The constructor's arguments for distinct ``keys``."""
        keys = sorted(keys)
        hashes, left = hash64(keys), np.arange(len(keys))
        levels, order = [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = PLACES_PER_KEY * len(left)
            place = _places(hashes[left], level, size)
            alone = np.bincount(place, minlength=size) == 1
            settled = alone[place]
            levels.append((size, np.packbits(alone).tobytes()))
            order.append(left[settled][np.argsort(place[settled])])
            left = left[~settled]
        return levels, np.concatenate([*order, left]).astype(np.int32), keys

    def slots(self, hashes: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Slot of each key, -1 if it was not built in."""
        found, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            if not len(left):
                break
            place = _places(hashes[left], level, len(bits))
            here = bits[place]
            found[left[here]] = self.order[ranks[place[here]]]
            left = left[~here]
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            same = pc.equal(self.keys.take(pa.array(found[hit])), keys.take(pa.array(hit)))
            found[hit[~np.asarray(same, dtype=bool)]] = -1
        if self.rest:
            for i in np.flatnonzero(found < 0):
                found[i] = self.rest.get(keys[i].as_py(), -1)
        return found
