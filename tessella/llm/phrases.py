"""Phrase collocations: counts of frequent phrases through minimal perfect hashes.

Level by level, a phrase of k words is a candidate where both phrases of k - 1 words in
it are frequent (no frequent phrase is missed: each of its parts is at least as frequent).  The
candidates that occur get a minimal perfect hash; their keys, kept by slot, tell
them from everything else.  Tasks count occurrences with bincount into arrays by
slot, and the arrays are added up in a tree.  Cuts of a phrase then read the counts of
its parts by slot.

Words are counted first; the frequent ones (of each language) get numbers, and the
corpus is kept as those numbers, a zero where a piece ends or a word is rare.  The key of
a phrase is (number of its first k - 1 words, number of its last word), so keys
of phrases are exact.  Words are found by two 64-bit hashes.

Every array lies in the shared folder, a shard of at most about SHARD keys in
each file; the driver sees one row of sizes for each shard.  A language with most
of the rows is no group: words and phrases are dealt by hash, and the ranking
keeps only the first rows of each task before it shuffles.

Rules: null text is empty, null lang is ``und``; texts without words count nothing;
repeated rows count each; other columns, doc_id too, are ignored; where no phrase is frequent there are no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash
from .shared import cut, has_checkpoint_dir, release
from .store import load, remove, save
from .substring import groups
from .words import _LOWER, _P, _TABLE, U64, Words, binary, mix, of_binary, pieces, powers, text_parts

LEAST, LONGEST, TOP, PERMILLE = 100, 5, 2000, 1000
SHARD, CHUNK, FAN, HELD = 4_000_000, 1 << 16, 32, 64 << 20
OTHER = "und"
NODES = "node long, slots binary, counts binary"
ROWS = "lang string, level int, id long, phrase string, a long, l long, r long, n long, score long, prefix long, suffix long"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_OTHER_TABLE = mix(_TABLE + U64(77))
_Q = 0xD6E8FEB86659FD93


class PieceWords(Words):
    """Lower-cased words of texts, with ``glued``: whether a word follows the one before it in a piece."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        data, offs = text_parts(column)
        data, n = _LOWER[data], len(data)
        self.rows, self.offs = len(offs) - 1, offs
        inside = ~(_SPACE | _STOP)[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offs[:-1]] = True
        before = np.append(False, inside[:-1])[:n] & ~first[:n]
        after = np.append(inside[1:], False)[:n] & ~first[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.set(data)
        stops = np.append(0, np.cumsum(_STOP[data] | first[:n]))[self.start + 1] if n else self.start
        self.glued = np.append(False, stops[1:] == stops[:-1])[: len(self)]

    def second_hash(self) -> np.ndarray:
        """Another 64-bit hash of each word."""
        sums = np.append(U64(0), np.cumsum(_OTHER_TABLE[self.data] * powers(_Q, len(self.data))))
        inverse = pow(_Q, -1, 1 << 64)
        return mix((sums[self.end] - sums[self.start]) * powers(inverse, len(self.data) + 1)[self.start])


def lang_keys(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(place of each row's language, languages)."""
    coded = langs.fill_null(OTHER).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def keyed(words: PieceWords, place: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (language, word) of each word."""
    own = np.array([lang_hash(x) for x in langs], dtype=U64)[place[words.row]]
    return mix(words.hash ^ own), words.second_hash() ^ own


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            words = PieceWords(batch.column("text"))
            if not len(words):
                continue
            place, langs = lang_keys(batch.column("lang"))
            key, _ = keyed(words, place, langs)
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            size = words.end[at] - words.start[at]
            raw = words.data.tobytes()
            text = [raw[a : a + n] for a, n in zip(words.start[at].tolist(), size.tolist(), strict=True)]
            lang = pa.array(langs, pa.string()).take(pa.array(place[words.row[at]]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(text, pa.binary()).cast(pa.string()), pa.array(count)], names=["lang", "word", "f"])


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(key ^ U64(_Q)) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def flat_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def word_shards(shards: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = PieceWords(batch.column("word"))
            place, langs = lang_keys(batch.column("lang"))
            key, other = keyed(words, place, langs)
            columns = [pa.array(shard_of(key, shards).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(other.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in ("lang", "word", "f", "n"))], names=["shard", "key", "other", "lang", "word", "f", "n"])

    return of


def write_words(root: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "shard", 16 << 20):
            shard = table.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                part = table.filter(pa.array(shard == s)).combine_chunks()
                key = part.column("key").to_numpy().view(U64)
                where = f"{root}/1/{s}"
                phf = PerfectHash.of(key)
                slot = phf.slots(key)
                order = np.argsort(slot)
                phf.save(where)
                save(f"{where}/key", key[order])
                save(f"{where}/other", part.column("other").to_numpy().view(U64)[order])
                save(f"{where}/count", part.column("f").to_numpy()[order])
                place, langs = lang_keys(part.column("lang").combine_chunks() if isinstance(part.column("lang"), pa.ChunkedArray) else part.column("lang"))
                n = np.zeros(len(langs), dtype=np.int64)
                n[place] = part.column("n").to_numpy()
                save(f"{where}/lang", place[order])
                save(f"{where}/n", n)
                for name, texts in (("langs", langs), ("words", part.column("word").take(pa.array(order)).to_pylist())):
                    flat, offs = flat_text(texts)
                    save(f"{where}/{name}", flat)
                    save(f"{where}/{name}_at", offs)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(key)], pa.int64())], names=["shard", "size"])

    return of


class Table:
    """One level: shard s holds the numbers from offset[s] on, by slot; number 0 is none."""

    def __init__(self, root: str, level: int, sizes: tuple[int, ...], least: int):
        self.root, self.level, self.sizes, self.least = root, level, sizes, least
        self.offset = np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.kept: dict[tuple[int, str], object] = {}

    def part(self, s: int, name: str):
        if (s, name) not in self.kept:
            where = f"{self.root}/{self.level}/{s}"
            self.kept[s, name] = PerfectHash.load(where) if name == "hash" else load(f"{where}/{name}")
        return self.kept[s, name]

    def slots(self, key: np.ndarray, other: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in key, slots) of the keys that are there."""
        shard = shard_of(key, len(self.sizes))
        order = np.argsort(shard, kind="stable") if len(self.sizes) > 1 else np.arange(len(key))
        cuts = np.searchsorted(shard[order], np.arange(len(self.sizes) + 1))
        for s in range(len(self.sizes)):
            mine = order[cuts[s] : cuts[s + 1]]
            if not len(mine) or not self.sizes[s]:
                continue
            slot = self.part(s, "hash").slots(key[mine])
            hit = (slot >= 0) & (self.part(s, "key")[slot] == key[mine])
            if other is not None:
                hit &= self.part(s, "other")[slot] == other[mine]
            yield s, mine[hit], slot[hit]

    def find(self, key: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """Numbers (from 1) of the frequent ones, else 0."""
        out = np.zeros(len(key), dtype=np.int64)
        for s, at, slot in self.slots(key, other):
            often = self.part(s, "count")[slot] >= self.least
            out[at[often]] = self.offset[s] + slot[often] + 1
        return out

    def read(self, name: str, number: np.ndarray) -> np.ndarray:
        """``name`` ("key" or "count") of numbers."""
        out = np.empty(len(number), dtype=U64 if name == "key" else np.int64)
        shard = np.searchsorted(self.offset, number - 1, side="right") - 1
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            out[at] = self.part(s, name)[number[at] - 1 - self.offset[s]]
        return out


@functools.lru_cache(maxsize=8)
def table(root: str, level: int, sizes: tuple[int, ...], least: int) -> Table:
    return Table(root, level, sizes, least)


def encode(root: str, sizes: tuple[int, ...], least: int):
    """Texts as numbers of frequent words; 0 where a piece ends, a word is rare or stands alone between such."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = table(root, 1, sizes, least)
        for whole in batches:
            for batch in pieces(whole):
                words = PieceWords(batch.column("text"))
                key, other = keyed(words, *lang_keys(batch.column("lang")))
                _, at, back = np.unique(key, return_index=True, return_inverse=True)
                x = words_of.find(key[at], other[at])[back]
                x = np.append(np.insert(x, np.flatnonzero(~words.glued), 0), 0)
                lone = (x > 0) & (np.append(0, x[:-1]) == 0) & (np.append(x[1:], 0) == 0)
                x[lone] = 0
                x = x[(x > 0) | (np.append(0, x[:-1]) > 0)]
                if len(x):
                    yield pa.RecordBatch.from_arrays([binary(x.astype(np.uint32), np.array([len(x)])), pa.array([len(x)], pa.int64())], names=["ids", "n"])

    return of


Levels = tuple[tuple[int, ...], ...]


def extended(now: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the candidates of k words; ``now`` holds the numbers of the k - 1 words from each place on."""
    at = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0))
    return at, now[at].astype(U64) << U64(32) | x[at + k - 1].astype(U64)


def candidates_of(x: np.ndarray, root: str, levels: Levels, least: int) -> np.ndarray:
    """Keys of the candidates of the level after ``levels`` in one run of numbers, one for each occurrence."""
    x = x.astype(np.int64)
    now = x
    for k in range(2, len(levels) + 1):
        at, key = extended(now, x, k)
        now = np.zeros(max(0, len(now) - 1), dtype=np.int64)
        now[at] = table(root, k, levels[k - 1], least).find(key)
    return extended(now, x, len(levels) + 1)[1]


def propose(root: str, levels: Levels, least: int, shards: int):
    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        key = np.unique(np.concatenate(held))
        shard = shard_of(key, shards)
        order = np.argsort(shard, kind="stable")
        size = np.bincount(shard, minlength=shards)
        some = np.flatnonzero(size)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), binary(key[order], size[some])], names=["shard", "keys"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(np.unique(candidates_of(of_binary(batch.column("ids").slice(k, 1), np.uint32)[0], root, levels, least)))
                if sum(map(len, held)) > SHARD:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > SHARD // 2:
                        yield sent(held)
                        held = []
        if held:
            yield sent(held)

    return of


def write_candidates(root: str, level: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, "shard", 16 << 20):
            shard = whole.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                key = np.unique(of_binary(whole.filter(pa.array(shard == s)).column("keys"), U64)[0])
                phf = PerfectHash.of(key)
                by_slot = np.empty_like(key)
                by_slot[phf.slots(key)] = key
                phf.save(f"{root}/{level}/{s}")
                save(f"{root}/{level}/{s}/key", by_slot)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(key)], pa.int64())], names=["shard", "size"])

    return of


def nodes(counts: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    """Arrays of counts in chunks of slots; where few are set, those alone."""
    for s, array in counts.items():
        rows: list[tuple] = []
        for a in range(0, len(array), CHUNK):
            own = array[a : a + CHUNK]
            some = np.flatnonzero(own)
            if len(some):
                thin = 4 * len(some) < len(own)
                rows.append(((s << 32) | (a // CHUNK << 16) | part, some.astype(np.uint16).tobytes() if thin else None, (own[some] if thin else own).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["node", "slots", "counts"])


def count(root: str, levels: Levels, sizes: tuple[int, ...], least: int):
    """Occurrences of the candidates of the level after ``levels``, by slot."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = table(root, len(levels) + 1, sizes, least), TaskContext.get().partitionId() % (1 << 16)
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                key = candidates_of(of_binary(batch.column("ids").slice(k, 1), np.uint32)[0], root, levels, least)
                for s, _, slot in own.slots(key):
                    seen = np.bincount(slot, minlength=sizes[s])
                    held[s] = held[s] + seen if s in held else seen
                    if sum(x.nbytes for x in held.values()) > HELD:
                        yield from nodes(held, part)
                        held = {}
        yield from nodes(held, part)

    return of


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the arrays of each node; rows come sorted by node."""
    node, total = None, np.zeros(0, np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["node", "slots", "counts"])

    for batch in batches:
        for n, slots, counts in zip(*(batch.column(c) for c in ("node", "slots", "counts")), strict=True):
            if n.as_py() != node:
                yield from done()
                node, total = n.as_py(), np.zeros(CHUNK, np.int64)
            more = np.frombuffer(counts.as_buffer(), dtype=np.int64)
            if slots.is_valid:
                total[np.frombuffer(slots.as_buffer(), dtype=np.uint16)] += more
            else:
                total[: len(more)] += more
    yield from done()


def tree_sum(arrays: DataFrame, tasks: int) -> DataFrame:
    """Arrays of all tasks added up, FAN parts at a time."""
    while True:
        last = tasks <= FAN
        node = F.col("node").bitwiseAND(~0xFFFF)
        if not last:
            node = node + F.floor(F.col("node").bitwiseAND(0xFFFF) / FAN).cast("long")
        arrays = arrays.select(node.alias("node"), "slots", "counts").repartition("node").sortWithinPartitions("node").mapInArrow(added, NODES)
        if last:
            return arrays
        tasks = -(-tasks // FAN)


def write_counts(root: str, level: int, sizes: tuple[int, ...], least: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = np.zeros(0, np.int64), -1

        def done() -> Iterator[pa.RecordBatch]:
            if shard >= 0:
                save(f"{root}/{level}/{shard}/count", held)
                yield pa.RecordBatch.from_arrays([pa.array([int((held >= least).sum())], pa.int64())], names=["frequent"])

        for batch in batches:
            for n, counts in zip(batch.column("node").to_pylist(), batch.column("counts"), strict=True):
                if n >> 32 != shard:
                    yield from done()
                    shard = n >> 32
                    held = np.zeros(sizes[shard], np.int64)
                at = (n >> 16 & 0xFFFF) * CHUNK
                own = np.frombuffer(counts.as_buffer(), dtype=np.int64)[: sizes[shard] - at]
                held[at : at + len(own)] = own
        yield from done()

    return of


def texts_of(words: Table, number: np.ndarray) -> list[str]:
    out = [""] * len(number)
    shard = np.searchsorted(words.offset, number - 1, side="right") - 1
    for i, (s, x) in enumerate(zip(shard.tolist(), (number - 1 - words.offset[shard]).tolist(), strict=True)):
        at = words.part(s, "words_at")
        out[i] = words.part(s, "words")[at[x] : at[x + 1]].tobytes().decode()
    return out


def cuts(root: str, levels: Levels, least: int):
    """Rows of the frequent phrases of (level, shard): counts of all their parts read by slot, the cut that scores lowest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [table(root, k, sizes, least) for k, sizes in enumerate(levels, 1)]
        for batch in batches:
            for level, shard, first in zip(*(batch.column(c).to_pylist() for c in ("level", "shard", "first")), strict=True):
                own = tables[level - 1]
                often = np.flatnonzero(own.part(shard, "count")[first : first + CHUNK] >= least) + first
                if len(often):
                    yield rows_of(tables, level, own.offset[shard] + often + 1)

    return of


def lowest(a: int, n: int, left: list[int], right: list[int]) -> tuple[int, int]:
    """(score, words of the first part) of the cut that scores lowest, ties to the shorter first part; integers have no bound here."""
    return min((PERMILLE * a * n // (l * r), k) for k, (l, r) in enumerate(zip(left, right, strict=True), 1))


def rows_of(tables: list[Table], level: int, number: np.ndarray) -> pa.RecordBatch:
    words = np.empty((level, len(number)), dtype=np.int64)
    left, now, prefix = [np.zeros(0, np.int64)] * level, number, number
    for k in range(level, 1, -1):  # the first k words, then k - 1
        key = tables[k - 1].read("key", now)
        words[k - 1], now = (key & U64(0xFFFFFFFF)).astype(np.int64), (key >> U64(32)).astype(np.int64)
        left[k - 1] = tables[k - 2].read("count", now)  # of the first k - 1 words
        prefix = now if k == level else prefix
    words[0] = now
    right, suffix = [np.zeros(0, np.int64)] * level, number
    for j in range(1, level):  # the words from j on
        now = words[j]
        for t in range(j + 1, level):
            now = tables[t - j].find(now.astype(U64) << U64(32) | words[t].astype(U64))
        right[j] = tables[level - j - 1].read("count", now)
        suffix = now if j == 1 else suffix
    first = tables[0]
    shard = np.searchsorted(first.offset, words[0] - 1, side="right") - 1
    place = [int(first.part(s, "lang")[x]) for s, x in zip(shard.tolist(), (words[0] - 1 - first.offset[shard]).tolist(), strict=True)]
    n = [int(first.part(s, "n")[p]) for s, p in zip(shard.tolist(), place, strict=True)]
    lang = [first.part(s, "langs")[first.part(s, "langs_at")[p] : first.part(s, "langs_at")[p + 1]].tobytes().decode() for s, p in zip(shard.tolist(), place, strict=True)]
    unique, back = np.unique(words, return_inverse=True)
    text = texts_of(first, unique)
    spelled = [" ".join(text[i] for i in row) for row in back.reshape(words.shape).T.tolist()]
    a = tables[level - 1].read("count", number)
    best = [lowest(*x) for x in zip(a.tolist(), n, np.stack(left[1:]).T.tolist(), np.stack(right[1:]).T.tolist(), strict=True)]
    cut_at = np.array([j for _, j in best])
    at = np.arange(len(number))
    l, r = np.stack(left[1:])[cut_at - 1, at], np.stack(right[1:])[cut_at - 1, at]
    columns = [lang, np.full(len(number), level), number, spelled, a, l, r, n, [s for s, _ in best], prefix, suffix]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])


def sizes_of(written: DataFrame, shards: int) -> tuple[int, ...]:
    """Keys of each shard: one row for each reaches the driver."""
    size = {r.shard: r.size for r in cut(written).collect()}
    if sum(size.values()) >= (1 << 32) - 1:
        raise ValueError("more candidates of one length than 32-bit numbers")
    return tuple(size.get(s, 0) for s in range(shards))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """Rows lang, level, id, phrase, a, l, r, n, score, prefix, suffix of every phrase of 2 to ``longest`` words that occurs ``least`` times; cut."""
    spark = docs.sparkSession
    root = f"{has_checkpoint_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(OTHER)).alias("lang"), "text")
    none = spark.createDataFrame([], ROWS)
    words = texts.mapInArrow(count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    # the rare words of a language are one row without a word, for its total
    words = cut(words.groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.filter(F.col("word").isNotNull())
    number = often.count()
    if not number:
        return none
    shards = -(-number // shard)
    dealt = often.join(total, "lang").mapInArrow(word_shards(shards), "shard int, key long, other long, lang string, word string, f long, n long")
    levels: Levels = (sizes_of(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(write_words(root), "shard int, size long"), shards),)
    try:
        encoded = cut(texts.mapInArrow(encode(root, levels[0], least), "ids binary, n long"), few=True)
        places, tasks = encoded.agg(F.sum("n")).first()[0] or 0, 4 * spark.sparkContext.defaultParallelism
        shards = max(1, -(-places // shard))  # there are no more candidates than places
        for level in range(2, longest + 1):
            proposed = encoded.mapInArrow(propose(root, levels, least, shards), "shard int, keys binary").repartition("shard").sortWithinPartitions("shard")
            sizes = sizes_of(proposed.mapInArrow(write_candidates(root, level), "shard int, size long"), shards)
            if not sum(sizes):
                break
            summed = tree_sum(encoded.mapInArrow(count(root, levels, sizes, least), NODES), tasks).withColumn("shard", F.shiftright("node", 32))
            counted = cut(summed.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(write_counts(root, level, sizes, least), "frequent long"))
            levels = (*levels, sizes)
            if not (counted.agg(F.sum("frequent")).first()[0] or 0):
                break
            release(spark)
        parts = [(k, s, a) for k, sizes in enumerate(levels[1:], 2) for s, size in enumerate(sizes) for a in range(0, size, CHUNK)]
        if not parts:
            return none
        asked = spark.createDataFrame(parts, "level int, shard int, first long").repartition(min(len(parts), tasks))
        return cut(asked.mapInArrow(cuts(root, levels, least), ROWS))
    finally:
        remove(root)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase as frequent as a longer one around it goes.  A longer one is no more
    frequent than any between the two, so those of one more word tell.
    """
    rows = frequent_phrases(docs, least, longest)
    around = rows.filter("level > 2").select(F.explode(F.array(F.struct("prefix", "a"), F.struct(F.col("suffix").alias("prefix"), "a"))).alias("x"), (F.col("level") - 1).alias("level"))
    around = around.groupBy("level", F.col("x.prefix").alias("id")).agg(F.max("x.a").alias("most"))
    stay = rows.join(around, ["level", "id"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a")))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stay.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
