"""Minimal perfect hashes over the byte strings of a shard, with the keys kept for verification.

A key takes the bit that its hash names in the first level; keys that meet there go on to the next, smaller level. A key's slot is
the number of set bits before its own. The levels hold 2 bits a key or less in each and end when every key has its bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bits of a level to a key that comes to it; the seed of the key's hash, as Spark's ``xxhash64`` has it.
ROOM, SEED = 2.0, 42


def hashed(keys: list[bytes], seed: int = SEED) -> np.ndarray:
    """Spark's ``xxhash64`` of each key, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2 ** 64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class PerfectHash:
    """Slots 0 .. n-1 of n distinct keys. ``levels``: the number of bits of each level; ``bits``: the bits of all levels, packed."""

    levels: list[int]
    bits: np.ndarray
    keys: pa.Array
    seed: int = SEED

    def __post_init__(self):
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.levels)]).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """Of distinct keys, by the first seed that gives them distinct 64-bit hashes."""
        seed, h = SEED, hashed(keys)
        while len(np.unique(h)) < len(keys):
            seed += 1
            h = hashed(keys, seed)
        levels, set_bits, rest = [], [], h
        while len(rest):
            m = max(64, int(len(rest) * ROOM))
            at = (_mix(rest, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            set_bits.append(alone)
            levels.append(m)
            rest = rest[~alone[at]]
        packed = np.packbits(np.concatenate(set_bits), bitorder="little") if levels else np.zeros(0, np.uint8)
        out = cls(levels, packed, pa.array([], pa.binary()), seed)
        order = np.empty(len(keys), np.int64)
        order[out._slots(h)] = np.arange(len(keys))
        out.keys = pa.array(keys, pa.binary()).take(pa.array(order)) if keys else out.keys
        return out

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot that each hash leads to, -1 where no level has its bit."""
        out, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, m in enumerate(self.levels):
            bit = (_mix(h[rest], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            byte, place = bit >> 3, (bit & 7).astype(np.uint8)
            word = self.bits[byte]
            there = (word >> place) & 1 == 1
            below = word[there] & ((np.uint8(1) << place[there]) - np.uint8(1))
            out[rest[there]] = self.before[byte[there]] + np.bitwise_count(below)
            rest = rest[~there]
        return out

    def find(self, keys: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each key with hash ``h``, -1 for a key that is not one of the shard's: the key kept in its slot is compared."""
        slots = self._slots(h if self.seed == SEED else hashed(keys.to_pylist(), self.seed))
        there = slots >= 0
        same = pc.equal(self.keys.take(pa.array(slots[there])), keys.filter(pa.array(there))).to_numpy(zero_copy_only=False)
        slots[np.nonzero(there)[0][~same.astype(bool)]] = -1
        return slots
