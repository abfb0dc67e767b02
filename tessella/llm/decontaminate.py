"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

Edit distance here counts words (A-Z lower-cased).  An item of n words occurs if
some stretch of a document is within n // 5 edits of it (none under 8 words, where all
words must match in a row).

A CGK walk reads a word sequence with a pointer that stays or moves on by a random bit
of the step and the word it is at, and writes a word at every step: an item-sized
window of n words gives 2 n outputs, and windows that differ by few edits give outputs
of small Hamming distance.  Each of ``repeats`` walks samples ``bits`` of the outputs,
spread over the whole window, into one key; items of n words and windows of n
words with an equal key are candidates.  All candidates are verified by exact edit
distance against the document around the window.

Each edit spoils at most three runs of three words, so a window within n // 5 edits
keeps at least n - 2 - 3 * (n // 5) of the item's, each at most n // 5 places from where
it should stand; windows with fewer can't match and are not embedded.  The tests
measure the recall for each length at the full number of edits (0.95 is the target).

Rules: null or empty texts and items match nothing; rows without doc_id or
item_id are left out of the pairs, but ``clean`` drops rows without doc_id like any
other; equal items are separate; repeated rows give one pair; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, grams, mix, pieces, spread

BITS, REPEATS, SHORT, SEED = 3, 48, 8, 3
#: Items of one block: rows, and bytes of text.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: Outputs of walks, and candidates, that one numpy pass holds.
CELLS, CANDIDATES = 2 << 20, 1 << 20


@functools.lru_cache(maxsize=4096)
def multipliers(repeat: int, steps: int) -> np.ndarray:
    """Of each step of a walk, the odd number that turns a word into the step's random bit."""
    return np.random.default_rng([11, repeat]).integers(1, 1 << 62, steps).astype(U64) * U64(2) + U64(1)


@functools.lru_cache(maxsize=1 << 16)
def samples(repeat: int, n: int, bits: int) -> tuple[int, ...]:
    """Steps that a walk over n words samples."""
    return tuple(sorted(np.random.default_rng([12, repeat, n]).choice(2 * n, min(bits, 2 * n), replace=False).tolist()))


def walk(h: np.ndarray, start: np.ndarray, stop: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, places from the start) that walks from ``start`` write at each step; from ``stop`` on all words are 0."""
    out, place = np.empty((len(odd), len(start)), dtype=U64), np.empty((len(odd), len(start)), dtype=np.int32)
    at, last = start.copy(), max(len(h) - 1, 0)
    for j in range(len(odd)):
        word = h[np.minimum(at, last)]
        word[at >= stop] = 0
        out[j], place[j] = word, at - start
        at += ((word * odd[j]) >> U64(63)).astype(np.int64)
    return out, place


def keys(out: np.ndarray, place: np.ndarray, n: int, repeat: int, bits: int) -> np.ndarray:
    """One key of the n-word window at each start of a walk; what lies beyond the window is 0."""
    key = np.full(out.shape[1], repeat << 20 | n, dtype=U64)
    for j in samples(repeat, n, bits):
        key *= U64(0x9E3779B97F4A7C15)
        key ^= np.where(place[j] < n, out[j], U64(0))
    return mix(key)


class Table:
    """Values under 64-bit keys, looked up many at a time; a bitmap passes over most of what isn't there."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.values = key[order], [v[order] for v in values]
        self.map: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "map": None}  # made again where it is used

    def find(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(place in ``key``, values) of all entries, in parts of bounded size."""
        if self.map is None:
            self.bits = U64(max(1 << 16, 1 << (16 * len(self.key)).bit_length()) - 1)
            self.map = np.zeros(int(self.bits) + 1, dtype=bool)
            self.map[(self.key & self.bits).astype(np.int64)] = True
        maybe = np.flatnonzero(self.map[(key & self.bits).astype(np.int64)])
        low = np.searchsorted(self.key, key[maybe], side="left")
        count = np.searchsorted(self.key, key[maybe], side="right") - low
        ends = np.cumsum(count)
        a = 0
        while a < len(maybe):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, side="right")))
            entry = spread(low[a:b], count[a:b])
            yield np.repeat(maybe[a:b], count[a:b]), *(v[entry] for v in self.values)
            a = b


class Items:
    """The items of one block with their tables: for each band of lengths the seeds, and of each walk the keys."""

    def __init__(self, ids: list[int], texts: list[str], repeats: int = REPEATS, bits: int = BITS):
        words = Words(pa.array(texts, pa.string()), lower=True)
        self.ids, self.repeats, self.bits = np.array(ids, dtype=np.int64), repeats, bits
        self.n, self.first, self.hash = words.count.astype(np.int64), words.first[:-1], words.hash
        self.edits = np.where(self.n < SHORT, 0, self.n // 5)
        #: short items by their whole sequence
        self.short = []
        for size in sorted({int(x) for x in self.n if 0 < x < SHORT}):
            own = np.flatnonzero(self.n == size)
            self.short.append((size, Table(grams(words.hash, size)[self.first[own]], own)))
        self.bands = []
        band = np.where(self.n >= SHORT, np.ceil(np.log2(np.maximum(self.n, 1))), -1).astype(np.int64)
        for k in sorted(set(band.tolist()) - {-1}):
            own = np.flatnonzero(band == k)
            sizes = sorted(set(self.n[own].tolist()))
            seeds = spread(self.first[own], self.n[own] - SEED + 1)
            of = np.repeat(own, self.n[own] - SEED + 1)
            # many items may share three words: one entry for each place and number of edits
            entry = np.unique(np.stack([grams(words.hash, SEED)[seeds].view(np.int64), seeds - self.first[of], self.edits[of]]), axis=1)
            tables = []
            for r in range(repeats):
                key, item = [], []
                odd = multipliers(r, 2 * sizes[-1])
                for n in sizes:
                    mine = own[self.n[own] == n]
                    at = self.first[mine]
                    key.append(keys(*walk(words.hash, at, at + n, odd[: 2 * n]), n, r, bits))
                    item.append(mine)
                tables.append(Table(np.concatenate(key), np.concatenate(item)))
            least = int((self.n[own] - SEED + 1 - SEED * self.edits[own]).min())
            self.bands.append((sizes, least, Table(entry[0].view(U64), entry[1], entry[2]), tables))


def nearest(items: Items, item: np.ndarray, words: Words, begin: np.ndarray, width: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Smallest edit distance of each item to any stretch of the words [begin, begin + width) of its row."""
    out = np.zeros(len(item), dtype=np.int64)
    size = items.n[item]
    first, stop = words.first[row], words.first[row + 1]
    for n in np.unique(size).tolist():
        for own in np.array_split(np.flatnonzero(size == n), -(-int((size == n).sum()) // 4096)):
            m = int(width[own].max())
            at = begin[own][:, None] + np.arange(m)[None, :]
            inside = (at >= first[own][:, None]) & (at < stop[own][:, None]) & (np.arange(m)[None, :] < width[own][:, None])
            text = np.where(inside, words.hash[np.clip(at, 0, max(len(words) - 1, 0))], U64(0))
            want = items.hash[items.first[item[own]][:, None] + np.arange(n)[None, :]]
            ramp = np.arange(m + 1)[None, :]
            row_above = np.zeros((len(own), m + 1), dtype=np.int64)  # a match may begin anywhere
            for i in range(n):
                now = row_above + 1
                now[:, 1:] = np.minimum(now[:, 1:], row_above[:, :-1] + (text != want[:, i : i + 1]))
                row_above = np.minimum.accumulate(now - ramp, axis=1) + ramp
            out[own] = row_above.min(axis=1)
    return out


def starts(words: Words, seeds: Table, least: int) -> np.ndarray:
    """Where windows begin that share enough runs of words with items, ``least`` of them, to be embedded."""
    h, n = grams(words.hash, SEED), len(words) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(words.row[:n] == words.row[SEED - 1 :])
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for at, offset, edits in seeds.find(h[inside]):
        place = inside[at]
        row = words.row[place]
        first, last = words.first[row], words.first[row + 1] - 1
        # a match may begin before the row does, as words of the item may be missing there
        low = np.clip(place - offset - edits, first, last)
        high = np.clip(place - offset + edits, low, last) + 1
        # ranges of one place that overlap count once
        order = np.lexsort((low, place))
        place, low, high = place[order], low[order], high[order]
        shift = place * (len(words) + 2)
        reach = np.maximum.accumulate(high + shift) - shift
        new = np.append(True, (place[1:] != place[:-1]) | (low[1:] > reach[:-1]))[: len(place)]
        np.add.at(edge, low[new], 1)
        np.add.at(edge, reach[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)] if len(place) else low, -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] >= least)


def candidates(items: Items, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(begin of a window, item) with an equal key."""
    for size, table in items.short:
        key = grams(words.hash, size)
        inside = np.flatnonzero(words.row[: len(key)] == words.row[size - 1 :][: len(key)])
        for at, item in table.find(key[inside]):
            yield inside[at], item
    for sizes, least, seeds, tables in items.bands:
        every, steps = starts(words, seeds, least), 2 * sizes[-1]
        part = max(1, CELLS // steps)
        for a in range(0, len(every), part):
            begin = every[a : a + part]
            stop = words.first[words.row[begin] + 1]
            for r, table in enumerate(tables):
                out, place = walk(words.hash, begin, stop, multipliers(r, steps))
                # the keys of all lengths one after the other
                for at, item in table.find(np.concatenate([keys(out, place, n, r, items.bits) for n in sizes])):
                    yield begin[at % len(begin)], item


def occurrences(items: Items, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, distance) of every verified candidate, the nearest of each pair."""
    seen = np.zeros((0, 3), dtype=np.int64)
    if len(words) and len(items.ids):
        for begin, item in candidates(items, words):
            # neighbouring windows share one stretch
            row = words.row[begin]
            part = (begin - words.first[row]) // np.maximum(items.edits[item], 1)
            seen = np.unique(np.concatenate([seen, np.stack([row, item, part], axis=1)]), axis=0)
    row, item, part = seen[:, 0], seen[:, 1], seen[:, 2]
    edits = items.edits[item]
    step = np.maximum(edits, 1)
    far = nearest(items, item, words, words.first[row] + part * step - edits, items.n[item] + 3 * edits + step, row)
    ok = far <= edits
    row, item, far = row[ok], item[ok], far[ok]
    order = np.lexsort((far, item, row))
    row, item, far = row[order], item[order], far[order]
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], item[new], far[new]


def item_blocks(benchmark: DataFrame, repeats: int, bits: int, block: int) -> Iterator[Items]:
    """The items in blocks of at most about ``block`` rows and ``ITEM_BYTES``, so that what is sent to the tasks has a bound."""
    given = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = given.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil(size[0] / block), math.ceil((size[1] or 0) / ITEM_BYTES))
    for k in range(parts):
        own = given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow().sort_by("item_id")
        yield Items(own.column("item_id").to_pylist(), own.column("text").to_pylist(), repeats, bits)


def leaks(docs: DataFrame, benchmark: DataFrame, repeats: int = REPEATS, bits: int = BITS, block: int = ITEMS) -> DataFrame:
    """Pairs (doc_id, item_id, distance): the items that occur in each document.  Each block of items is one scan of the documents."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in item_blocks(benchmark, repeats, bits, block):

        def of(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole):
                    row, item, far = occurrences(items, Words(batch.column("text"), lower=True))
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(items.ids[item]), pa.array(far)], names=["doc_id", "item_id", "distance"])

        some = rows.mapInArrow(of, "doc_id long, item_id long, distance long")
        found = some if found is None else found.unionByName(some)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, repeats: int = REPEATS, bits: int = BITS, block: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, each judged by its own text; nothing is shuffled."""
    names = docs.columns
    for items in item_blocks(benchmark, repeats, bits, block):

        def of(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole):
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[occurrences(items, Words(batch.column("text"), lower=True))[0]] = False
                    yield batch.filter(pa.array(keep)).select(names)

        docs = docs.mapInArrow(of, docs.schema)
    return docs
