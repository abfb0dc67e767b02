"""Vectorised words over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of these
are ASCII, so splitting UTF-8 bytes equals splitting code points.  Hashes are
deterministic across processes and machines (no Python ``hash``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: dict[int, np.ndarray] = {}

#: Text bytes that one numpy pass handles; a longer text is still handled whole.
CHUNK_BYTES = 3 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 8 << 20:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` text bytes; every row is in one slice."""
    if not batch.num_rows:
        return
    _, offs = text_parts(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch of texts: byte range, row and 64-bit hash of each."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        data, offs = text_parts(column)
        if lower:
            data = _LOWER[data]
        n = len(data)
        self.rows = len(offs) - 1
        inside = _WORD[data]
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cuts = offs[(offs > 0) & (offs < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.offs = offs
        self.set(data)

    def set(self, data: np.ndarray) -> None:
        """Hashes and row bounds for ``start``, ``end`` over ``data``."""
        self.data, n = data, len(data)
        #: words of row r are first[r]:first[r + 1]
        self.first = np.searchsorted(self.start, self.offs)
        self.count = np.diff(self.first)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_TABLE[data] * powers(_P, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(_PINV, n + 1)[self.start])

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries; len(h) - k + 1 values (none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    if k <= 8:
        out = h[:n].copy()
        for j in range(1, k):
            out *= U64(_P)
            out += h[j : j + n]
        return mix(out)
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * powers(_P, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers(_PINV, n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span : w - span + n])


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    length = np.asarray(length, dtype=np.int64)
    total = int(length.sum())
    out = np.arange(total, dtype=np.int64)
    begins = np.cumsum(length) - length
    return out + np.repeat(np.asarray(start, dtype=np.int64) - begins, length)


def binary(flat: np.ndarray, length: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of ``flat``, in its own byte order."""
    flat = np.ascontiguousarray(flat)
    offs = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(np.asarray(length, dtype=np.int64) * flat.itemsize, out=offs[1:])
    if offs[-1] >= 2**31 - 1:
        return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offs), pa.py_buffer(flat)])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(flat)])


def of_binary(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths in values) of a binary column without nulls."""
    data, offs = text_parts_binary(column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype=dtype), np.diff(offs) // size


def text_parts_binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]
