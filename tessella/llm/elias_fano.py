"""Elias-Fano sequences in numpy: compact, memory-mapped, looked up many at a time."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .store import Spool, load_all, save_all

U64 = np.uint64
BLOCK = 1 << 15
_SELECT = np.full((256, 8), 8, dtype=np.uint8)  # place of the j-th zero of a byte, lowest bit first
for _b in range(256):
    _zeros = [k for k in range(8) if not _b >> k & 1]
    _SELECT[_b, : len(_zeros)] = _zeros
_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], dtype=np.int64)
_ZEROS8 = _ZEROS.astype(np.uint8)
_EIGHT = np.arange(8)


def windows(data: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, one row each."""
    return data[byte[:, None] + _EIGHT]


def in_window(rows: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place, in bits, of the left-th zero (from 0) of eight bytes."""
    ends = np.cumsum(_ZEROS8[rows], axis=1, dtype=np.uint8)
    byte = (ends <= left[:, None]).sum(axis=1)
    at = np.arange(len(rows))
    before = np.where(byte > 0, ends[at, byte - 1], 0)
    return byte * 8 + _SELECT[rows[at, byte], left - before]


class EliasFano:
    """n non-decreasing integers below ``universe``: l low bits of each packed, the rest in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, n: int, bits: int):
        self.low, self.high, self.zeros, self.n, self.bits = low, high, zeros, n, bits

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Made a block at a time, so that ``values`` may be a mapping of any size."""
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low, high, zeros = Spool(np.uint8), Spool(np.uint8), Spool(np.uint32)
        unary, at, seen = np.zeros(0, np.uint8), 0, 0  # ends of whole blocks of 64 bits are written
        for k in range(0, max(n, 1), BLOCK):
            block = values[k : k + BLOCK].astype(U64)
            if bits:  # BLOCK is a multiple of 8: the planes of a block fill whole bytes
                low.add(np.packbits(((block[:, None] >> np.arange(bits, dtype=U64)) & U64(1)).astype(np.uint8).ravel(), bitorder="little"))
            last = k + BLOCK >= n
            # the tail is padded with zeros, eight bytes of them at least
            up = (block >> U64(bits)).astype(np.int64) + np.arange(k, k + len(block)) - at
            end = -(-(n + (universe >> bits) + 2) // 64) * 64 + 64 - at if last else int(up[-1]) + 1
            unary = np.append(unary, np.zeros(end - len(unary), np.uint8))
            unary[up] = 1
            whole = len(unary) // 64 * 64
            packed = np.packbits(unary[:whole], bitorder="little")
            high.add(packed)
            sums = seen + np.append(0, np.cumsum(_ZEROS[packed].reshape(-1, 8).sum(axis=1)))
            zeros.add(sums[:-1])
            unary, at, seen = unary[whole:], at + whole, int(sums[-1])
        zeros.add(np.array([seen]))
        low.add(np.zeros(8, np.uint8))
        return cls(low.array(), high.array(), zeros.array(), n, bits)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.bits]), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of_parts(cls, found: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(found[f"{name}.low"], found[f"{name}.high"], found[f"{name}.zeros"], *found[f"{name}.meta"].tolist())

    def save(self, uri: str) -> None:
        save_all(uri, self.parts(""))

    @classmethod
    def load(cls, uri: str) -> EliasFano:
        return cls.of_parts(load_all(uri), "")

    def lows(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the entries i (57 bits at most)."""
        if not self.bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.bits
        word = windows(self.low, at >> 3).view("<u8").ravel()
        return ((word >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def select0(self, h: np.ndarray) -> np.ndarray:
        """Place of the h-th zero (from 0) of the unary part."""
        word = np.searchsorted(self.zeros, h, side="right") - 1
        left = h - self.zeros[word].astype(np.int64)
        return word * 64 + in_window(windows(self.high, word * 8), left)

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry, and the one after the last, with upper bits h."""
        # the ones between two zeros are a bucket's entries; mostly the second zero is close behind the first
        begin = np.zeros(len(h), dtype=np.int64)
        inner = h > 0
        begin[inner] = self.select0(h[inner] - 1) + 1
        word = ~(windows(self.high, begin >> 3).view("<u8").ravel() >> (begin & 7).astype(U64))
        first = word & (~word + U64(1))
        size = np.frexp(first.astype(np.float64))[1].astype(np.int64) - 1
        far = (size + (begin & 7) >= 64) | (word == 0)
        if far.any():
            size[far] = self.select0(h[far]) - begin[far]
        return begin - h, begin - h + size

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first entry >= x within the bucket of x, whether it equals x)."""
        x = x.astype(np.int64)
        lo, end = self.bucket(x >> self.bits)
        hi, want = end.copy(), x & ((1 << self.bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        hit = lo < end
        hit[hit] = self.lows(lo[hit]) == want[hit]
        return lo, hit

    @cached_property
    def ones(self) -> np.ndarray:
        """Ones before each 64 bits of the unary part."""
        return np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros

    def access(self, i: np.ndarray) -> np.ndarray:
        """Entries i: the i-th one of the unary part by binary search over the zeros before it."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        left = i - self.ones[word]
        up = np.zeros(len(i), dtype=np.int64)
        live = np.ones(len(i), dtype=bool)
        for k in range(8):
            byte = self.high[np.minimum(word * 8 + k, len(self.high) - 1)]
            here = 8 - _ZEROS[byte]
            found = live & (left < here)
            up[found] = (word[found] * 8 + k) * 8 + _SELECT[255 - byte[found], left[found]]
            live &= ~found
            left = np.where(live, left - here, left)
        return ((up - i) << self.bits) | self.lows(i)
