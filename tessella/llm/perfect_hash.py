"""Minimal perfect hash over 64-bit keys: n keys to the slots 0..n-1, about four bits a key.

Each level is a bit array twice as long as the keys that reach it; a key that is alone
at its bit sets it, the others go on to the next level.  A key's slot is the number of
bits set before its own.  Other keys get some slot or none, so callers
keep the keys by slot and compare.
"""

from __future__ import annotations

import numpy as np

from .store import load, save
from .words import U64, mix

LEVELS = 60


def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = mix(keys + U64((level * 0x9E3779B97F4A7C15) % (1 << 64)))
    return ((h >> U64(32)) * U64(bits) >> U64(32)).astype(np.int64)


class PerfectHash:
    def __init__(self, bits: np.ndarray, rank: np.ndarray, begin: np.ndarray):
        #: bits of all levels in 64-bit words, bits set before each word, first bit of each level (and the end)
        self.bits, self.rank, self.begin = bits, rank, begin

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        parts, begin = [], [0]
        while len(keys):
            if len(parts) == LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-2 * len(keys) // 64) * 64
            at = _at(keys, len(parts), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(U64))
            begin.append(begin[-1] + size)
            keys = keys[~alone[at]]
        bits = np.concatenate(parts) if parts else np.zeros(0, U64)
        set_ = np.bitwise_count(bits).astype(np.int64)
        return cls(bits, np.cumsum(set_) - set_, np.array(begin, dtype=np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.begin) - 1):
            if not len(left):
                break
            at = self.begin[level] + _at(keys[left], level, int(self.begin[level + 1] - self.begin[level]))
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit & U64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            out[left[hit]] = self.rank[at[hit] >> 6] + below
            left = left[~hit]
        return out

    def save(self, uri: str) -> None:
        for name in ("bits", "rank", "begin"):
            save(f"{uri}/{name}", getattr(self, name))

    @classmethod
    def load(cls, uri: str) -> PerfectHash:
        return cls(load(f"{uri}/bits"), load(f"{uri}/rank"), np.array(load(f"{uri}/begin")))
