"""Minimal perfect hashing of 64-bit keys, in numpy.

Level by level, keys fall on a bit array of twice their number; a key alone on its place keeps
it, the others go to the next level with another hash. A key's number is the count of taken
places before its own, so ``n`` keys get the numbers 0 to n-1 without gaps. A key that was not
hashed gets some number or none: the caller compares the key stored under it.
"""

from __future__ import annotations

import numpy as np

_SPREAD = 2


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key; other seeds give other hashes."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, taken = [], 0
        for bits in levels:
            self.before.append(taken + np.cumsum(bits, dtype=np.int64) - bits)
            taken += int(bits.sum())
        self.size = taken

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` differ from each other."""
        levels = []
        while len(keys):
            at = (mix(keys, len(levels)) % np.uint64(_SPREAD * len(keys))).astype(np.int64)
            alone = np.bincount(at, minlength=_SPREAD * len(keys)) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level takes it."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = (mix(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = before[at[here]]
            left = left[~here]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            used = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=size).astype(bool))
            at += used
        return cls(levels)
