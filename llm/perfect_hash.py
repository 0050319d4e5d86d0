"""Minimal perfect hashing of 64-bit keys in levels of bit arrays, built and read with numpy.

A level has two places for each key that is left. Keys alone in their place set its bit and are done; the others go
on to the next level. The number of set bits before a key's own is its hash, so n keys get 0..n-1. About 3.7
bits a key are kept. Keys outside the set get any number: compare with a stored key.
"""

from __future__ import annotations

import numpy as np

from llm.packed import pack, unpack
from llm.words import mix


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """``levels``: one bool array each."""
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + base)
            base += int(np.count_nonzero(bits))
        self.size = base

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        spread = mix(keys ^ mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return ((spread >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64 values, fewer than 2**31."""
        levels: list[np.ndarray] = []
        while len(keys):
            size = max(8, 2 * len(keys))
            at = cls._places(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level knows it."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._places(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(b) for b in self.levels], np.int64)
        packed = np.concatenate([np.packbits(b) for b in self.levels]) if self.levels else np.zeros(0, np.uint8)
        head = pack(sizes)
        return len(head).to_bytes(8, "little") + head + pack(packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        cut = 8 + int.from_bytes(data[:8], "little")
        (sizes,), (packed,) = unpack(data[8:cut], np.int64), unpack(data[cut:], np.uint8)
        levels, at = [], 0
        for size in sizes.tolist():
            width = -(-size // 8)
            levels.append(np.unpackbits(packed[at : at + width], count=size).astype(bool))
            at += width
        return cls(levels)
