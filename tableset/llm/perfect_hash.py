"""Minimal perfect hash of 64-bit keys, built and probed with whole arrays.

Level by level the keys that no other key meets in a bit array keep their bit, and the others
go on to the next, smaller array. A key's index is the number of bits set before its own.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each of its keys.
SPARSE = 2
_STEP = 0x9E3779B97F4A7C15


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys ^ np.uint64(_STEP * (level + 1) % (1 << 64))
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(multiplier)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        #: For each level, one byte per position while in use; packed to bits when stored.
        self.levels = levels
        ends = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.n = int(ends[-1])
        self.before = [end + np.cumsum(x) - x for end, x in zip(ends, levels)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: different 64-bit numbers."""
        rest, levels = keys.astype(np.int64).view(np.uint64), []
        while len(rest):
            size = SPARSE * len(rest) + 1
            at = _position(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            rest = rest[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, 0 to n - 1; for other keys any index, or -1."""
        keys = keys.astype(np.int64).view(np.uint64)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = _position(keys[rest], level, len(bits))
            hit = bits[at] == 1
            out[rest[hit]] = before[at[hit]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x.astype(bool)).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(np.int64))
            at += len(packed)
        return cls(levels)
