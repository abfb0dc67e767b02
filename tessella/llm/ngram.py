"""Language-model scores from an Elias-Fano n-gram trie.

Counting takes two passes over the training documents; what the tasks send on
is already counted, as packed arrays, one row for each shard they touch.  The
first level of the trie holds the words (sorted hashes, tokens before each), the second the
followers of each word: ids made monotone by the word's own base, in an
Elias-Fano sequence, found by successor search inside the bucket of that base;
pointers to each word's followers are another Elias-Fano sequence.  The third
level holds the followers of each pair in the same way, under the pair's place in
its pack of the second.  One pass counts both: each pair is sent with the word
that comes next, to the shard of its place among all tokens, so that a frequent word
is dealt to several shards by its followers.  Follower
probabilities are smoothed by absolute discounting, interpolated with the
add-one unigram; the discounted shares and the third level's left-over masses are kept as 8-bit
steps between a shard's extremes, and scoring adds the level below.

Shards are what a task holds at a time and follow the input; ``PACKS`` of them in a row, one
after the other, make a pack, which is one sequence of each level and one file.  So the number of
files that a scoring task maps, and looks into for each batch, does not grow with the input.

A text is its words (A-Z lower-cased), then one end; the first word follows an
end.  Unseen followers get the word's left-over mass (from its pointers) times
the unigram; after unseen words the unigram counts alone.  ``score`` takes two words
before as context, ``score_2`` one; after unseen pairs, and for a first word, the former has the latter's value.

Rules: null and empty texts are the end alone; a row without doc_id counts as
the id ''; repeated rows count and are scored each; other columns are ignored; where no row may
be learnt from, every token has the base of an empty corpus.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared import cut, has_checkpoint_dir
from .store import Spool, load_all, remove, save_all
from .substring import groups
from .words import U64, Words, binary, of_binary, pieces

DISCOUNT, STEPS = 0.75, 255
#: Files of a level at most, each with several shards.
PACKS = 64
END = U64(0xE0D5EA4C01D5EED1)
COUNTS = "shard int, keys binary, counts binary"
TRIPLES = "shard int, keys binary, nexts binary, counts binary"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
NONE = np.uint32(0xFFFFFFFF)  # after the end of a text


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, ends of the rows' tokens): words and one end per row."""
    at = words.first[1:]
    return np.insert(words.hash, at, END), at + np.arange(1, words.rows + 1)


def before(h: np.ndarray, ends: np.ndarray, end) -> np.ndarray:
    """The token before each one; an end before each text."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    if len(h):
        out[0] = end
    out[ends[:-1]] = end
    return out


def sent(shard: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows of packed keys and counts for sorted shards."""
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(shard)))
    return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), binary(key, size), binary(count.astype(np.uint32), size)], names=["shard", "keys", "counts"])


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(count, first)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the upper half of a hash: in the order of the hashes."""
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def count_words(shards: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                h, _ = tokens(Words(batch.column("text"), lower=True))
                key, count = np.unique(h, return_counts=True)
                yield sent(shard_of(key, shards), key, count)

    return of


def gathered(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) for whole shards in a table."""
    shard = table.column("shard").to_numpy()
    for s in np.unique(shard).tolist():
        part = table.filter(pa.array(shard == s))
        key, _ = of_binary(part.column("keys"), U64)
        count, _ = of_binary(part.column("counts"), np.uint32)
        yield s, *summed(key, count.astype(np.int64))


def write_words(root: str, per: int):
    """Packs of ``per`` shards: the words in order of their hashes, the tokens before each one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            before.add(np.array([total]))
            save_all(f"{root}/1/{pack}", {"word": word.array(), "before": before.array()})
            return pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([word.n], pa.int64()), pa.array([total], pa.int64())], names=["pack", "words", "tokens"])

        pack = None
        for table in groups(batches, "shard", 24 << 20):
            for s, key, count in gathered(table):
                if pack != s // per:
                    if pack is not None:
                        yield closed()
                    pack, total, word, before = s // per, 0, Spool(U64), Spool(np.int64)
                word.add(key)
                before.add(total + np.cumsum(count) - count)
                total += int(count.sum())
        if pack is not None:
            yield closed()

    return of


class Vocabulary:
    """The first level: pack s holds the ids from offset[s] on, by hash; base[s] tokens are in the packs before it."""

    def __init__(self, root: str, offset: tuple[int, ...], base: tuple[int, ...]):
        self.offset, self.base, self.packs = np.array(offset, dtype=np.int64), base, len(offset) - 1
        self.levels = [load_all(f"{root}/1/{s}") if offset[s + 1] > offset[s] else None for s in range(self.packs)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted hashes."""
        ids, count = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        cuts = np.searchsorted(shard_of(h, self.packs), np.arange(self.packs + 1))
        for s in range(self.packs):
            a, b = cuts[s], cuts[s + 1]
            if a == b or self.levels[s] is None:
                continue
            word, before = self.levels[s]["word"], self.levels[s]["before"]
            at = np.searchsorted(word, h[a:b])
            at[at == len(word)] = 0
            hit = np.flatnonzero(word[at] == h[a:b])
            ids[a + hit] = at[hit] + self.offset[s]
            count[a + hit] = before[at[hit] + 1] - before[at[hit]]
        return ids, count

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens before, count) of sorted ids."""
        first, count = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        cuts = np.searchsorted(ids, self.offset)
        for s in range(self.packs):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                before, at = self.levels[s]["before"], ids[a:b] - self.offset[s]
                first[a:b] = before[at] + self.base[s]
                count[a:b] = before[at + 1] - before[at]
        return first, count


@functools.lru_cache(maxsize=1)
def vocabulary(root: str, offset: tuple[int, ...], base: tuple[int, ...]) -> Vocabulary:
    trie.cache_clear()  # a worker that is used again lets go of the last trie
    return Vocabulary(root, offset, base)


def numbered(h: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(h, return_inverse=True)
    ids, count = vocab.find(unique)
    return ids[back], count[back]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


def pair_shard(vocab: Vocabulary, word: np.ndarray, follower: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, count of the word) of pairs in order: by the tokens before the word and, among its own, by the follower."""
    start = runs(word)
    times = np.diff(np.append(start, len(word)))
    first, count = (np.repeat(x, times) for x in vocab.spans(word[start]))
    at = first + count * (follower / vocab.offset[-1])
    return np.minimum((at * (shards / vocab.base[-1])).astype(np.int64), shards - 1), count


def totals(key: np.ndarray, after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, after) in order, with their summed counts."""
    if not len(key):
        return key, after, count
    order = np.lexsort((after, key))
    key, after, count = key[order], after[order], count[order]
    del order
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (after[1:] != after[:-1])))
    return key[first], after[first], np.add.reduceat(count, first, dtype=np.int64)


def count_triples(root: str, offset: tuple[int, ...], base: tuple[int, ...], shards: int):
    """Pairs with the word that comes next."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(root, offset, base)
        end = int(vocab.find(np.array([END]))[0][0])
        for whole in batches:
            for batch in pieces(whole):
                h, ends = tokens(Words(batch.column("text"), lower=True))
                ids, _ = numbered(h, vocab)
                after = np.append(ids[1:], 0).astype(np.uint32)
                after[ends - 1] = NONE
                key, after, count = totals((before(ids, ends, end).astype(U64) << U64(32)) | ids.astype(U64), after, np.ones(len(ids), dtype=np.uint32))
                shard, _ = pair_shard(vocab, (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64), shards)
                out = sent(shard, key, count)
                size = of_binary(out.column("counts"), np.uint32)[1]
                yield pa.RecordBatch.from_arrays([out.column("shard"), out.column("keys"), binary(after, size), out.column("counts")], names=["shard", "keys", "nexts", "counts"])

    return of


def steps_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit steps between the extremes, [lowest, step])."""
    low, high = (float(p.min()), float(p.max())) if len(p) else (0.0, 0.0)
    step = (high - low) / STEPS or 1.0
    return np.rint((p - low) / step).astype(np.uint8), np.array([low, step])


class Pack:
    """The second and third level of the shards of a pack, added in order."""

    def __init__(self, number: int, vocab: Vocabulary):
        self.number, self.vocab, self.words = number, vocab, int(vocab.offset[-1])
        self.key, self.inner = Spool(U64), Spool(np.int64)
        self.steps = {name: Spool(np.uint8) for name in ("second", "third", "left")}
        #: of each shard: first pair, first triple, extremes of the three
        self.rows: list[list[float]] = []
        self.kinds: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pair: np.ndarray, after: np.ndarray, times: np.ndarray) -> None:
        """Distinct triples of one more shard, in order: pairs (word, follower), what comes next, how often."""
        start = runs(pair)
        key, count, size = pair[start], np.add.reduceat(times, start), np.diff(np.append(start, len(times)))
        word = (key >> U64(32)).astype(np.int64)
        head = runs(word)
        kinds = np.diff(np.append(head, len(word)))
        self.kinds.append((word[head], kinds))
        made = {"second": np.log10(np.maximum(count - DISCOUNT, 0) / np.repeat(self.vocab.spans(word[head])[1], kinds))}
        inner = after != NONE  # a pair that ends a text has none
        at = np.repeat(np.arange(len(count)), size)[inner]
        made["third"] = np.log10((times[inner] - DISCOUNT) / count[at])
        made["left"] = np.log10(DISCOUNT * np.maximum(np.bincount(at, minlength=len(count)), 1) / count)
        row = [float(self.key.n), float(self.inner.n)]
        self.inner.add((self.key.n + at) * self.words + after[inner].astype(np.int64))
        self.key.add(key)
        for name, p in made.items():
            steps, scale = steps_of(p)
            self.steps[name].add(steps)
            row += scale.tolist()
        self.rows.append(row)

    def save(self, root: str) -> pa.RecordBatch:
        word, kinds = (np.concatenate(x) for x in zip(*self.kinds, strict=True))
        first, last = int(word[0]), int(word[-1])
        kinds = np.bincount(word - first, weights=kinds).astype(np.int64)
        value, key = Spool(np.int64), self.key.array()
        for k in range(0, len(key), 1 << 18):
            part = key[k : k + (1 << 18)]
            value.add(((part >> U64(32)).astype(np.int64) - first) * self.words + (part & U64(0xFFFFFFFF)).astype(np.int64))
        made = EliasFano.of(value.array(), len(kinds) * self.words).parts("follower")
        made |= EliasFano.of(np.append(0, np.cumsum(kinds)), len(key) + 1).parts("pointer")
        made |= EliasFano.of(self.inner.array(), len(key) * self.words).parts("inner")
        made |= {name: steps.array() for name, steps in self.steps.items()} | {"rows": np.array(self.rows).ravel(), "words": np.array([first, len(kinds)])}
        save_all(f"{root}/2/{self.number}", made)
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int32()), *(pa.array([x], pa.int64()) for x in (first, last, int(kinds[0]), int(kinds[-1])))], names=["pack", "first", "last", "kinds_first", "kinds_last"])


PACKED = "pack int, first long, last long, kinds_first long, kinds_last long"


def write_triples(root: str, offset: tuple[int, ...], base: tuple[int, ...], per: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, pack = vocabulary(root, offset, base), None
        for table in groups(batches, "shard", 8 << 20):
            shard = table.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                part = table.filter(pa.array(shard == s))
                pair, after, times = totals(of_binary(part.column("keys"), U64)[0], of_binary(part.column("nexts"), np.uint32)[0], of_binary(part.column("counts"), np.uint32)[0])
                del part
                if pack is None or pack.number != s // per:
                    if pack is not None:
                        yield pack.save(root)
                    pack = Pack(s // per, vocab)
                pack.add(pair, after, times)
                del pair, after, times
        if pack is not None:
            yield pack.save(root)

    return of


class Trie:
    """A pack as it lies in the shared folder."""

    def __init__(self, root: str, number: int):
        found = load_all(f"{root}/2/{number}")
        self.follower, self.pointer, self.inner = (EliasFano.of_parts(found, name) for name in ("follower", "pointer", "inner"))
        self.steps = {name: found[name] for name in ("second", "third", "left")}
        self.rows = found["rows"].reshape(-1, 8).copy()
        self.begin = self.rows[:, :2].astype(np.int64).T.copy()
        self.first, self.words = found["words"].tolist()

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        """The logarithm that stands at places of an array."""
        k = ("second", "third", "left").index(name)
        shard = np.searchsorted(self.begin[int(name == "third")], at, side="right") - 1
        return self.rows[shard, 2 + 2 * k] + self.rows[shard, 3 + 2 * k] * self.steps[name][at]

    def pairs(self, word: np.ndarray, follower: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, discounted share, followers of the word here) of sorted pairs; a follower that is no word is unknown."""
        place, share, kinds = np.full(len(word), -1, dtype=np.int64), np.zeros(len(word)), np.zeros(len(word), dtype=np.int64)
        w = word - self.first
        here = np.flatnonzero((w >= 0) & (w < self.words))
        w = w[here]
        start = runs(w)
        kinds[here] = np.repeat(self.pointer.access(w[start] + 1) - self.pointer.access(w[start]), np.diff(np.append(start, len(w))))
        real = follower[here] < words
        at, hit = self.follower.successor(w[real] * words + follower[here][real])
        hits = here[real][hit]
        place[hits] = at[hit]
        share[hits] = 10.0 ** self.value("second", at[hit])
        return place, share, kinds


@functools.lru_cache(maxsize=None)
def trie(root: str, number: int) -> Trie:
    return Trie(root, number)


def after_pairs(root: str, pack: np.ndarray, place: np.ndarray, word: np.ndarray, p: np.ndarray, words: int) -> np.ndarray:
    """Third-level log probabilities of words (-1: unknown) after the pairs at a place of a pack of the second; p are those of the second."""
    out = np.empty(len(p))
    order = np.argsort(pack, kind="stable")
    for mine in np.split(order, runs(pack[order])[1:]) if len(order) else ():
        own = trie(root, int(pack[mine[0]]))
        at, w = place[mine], word[mine]
        q = 10.0 ** (own.value("left", at) + p[mine])
        unique, back = np.unique(at[w >= 0] * words + w[w >= 0], return_inverse=True)
        if len(unique):
            found, hit = own.inner.successor(unique)
            share = np.zeros(len(unique))
            share[hit] = 10.0 ** own.value("third", found[hit])
            q[w >= 0] += share[back]
        out[mine] = np.log10(q)
    return out


def score(root: str, offset: tuple[int, ...], base_tokens: tuple[int, ...], shards: int, per: int, packs: frozenset[int], edges: dict[int, int]):
    """packs: those with a file; edges: the followers of words that may lie in several, as the first and last of each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words, total = vocabulary(root, offset, base_tokens), offset[-1], base_tokens[-1]
        shared = np.array(sorted(edges), dtype=np.int64)
        shared_kinds = np.array([edges[w] for w in shared.tolist()], dtype=np.int64)
        end = int(vocab.find(np.array([END]))[0][0])
        for whole in batches:
            for batch in pieces(whole, most=2 << 20):
                h, ends = tokens(Words(batch.column("text"), lower=True))
                ids, count = numbered(h, vocab)
                base = np.log10((count + 1) / (total + (words if total else 0) + 1))
                prev = before(ids, ends, end)
                out = base.copy()
                known = np.flatnonzero((prev >= 0) & (total > 0))  # where nothing is learnt there are no other levels
                key, back = np.unique((prev[known].astype(U64) << U64(32)) | (ids[known] & 0xFFFFFFFF).astype(U64), return_inverse=True)
                word, follower = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
                unigram = np.zeros(len(key))
                unigram[back] = base[known]
                share, kinds, place = np.zeros(len(key)), np.zeros(len(key), dtype=np.int64), np.full(len(key), -1, dtype=np.int64)
                if len(key):
                    shard, seen = pair_shard(vocab, word, np.minimum(follower, words - 1), shards)
                    pack = shard // per
                    start = runs(pack)
                    for a, b in zip(start, np.append(start[1:], len(pack)), strict=True):
                        if int(pack[a]) in packs:
                            place[a:b], share[a:b], kinds[a:b] = trie(root, int(pack[a])).pairs(word[a:b], follower[a:b], words)
                    at = np.minimum(np.searchsorted(shared, word), len(shared) - 1)
                    wide = shared[at] == word
                    kinds[wide] = shared_kinds[at[wide]]
                    got = np.log10(share + DISCOUNT * kinds / seen * 10.0**unigram)
                    out[known] = got[back]
                # the pair before a token is the one that the token before it ends
                pair = np.full(len(ids), -1, dtype=np.int64)
                pair[known] = back
                pair[1:] = pair[:-1].copy()
                pair[np.append(0, ends[:-1])[: len(ends)]] = -1
                deep = np.flatnonzero(pair >= 0)
                deep = deep[place[pair[deep]] >= 0]
                out3 = out.copy()
                if len(deep):
                    out3[deep] = after_pairs(root, pack[pair[deep]], place[pair[deep]], ids[deep], out[deep], words)
                cuts = np.append(0, ends)
                sums = [np.append(0, np.cumsum(x)) for x in (count > 0, base, out, out3)]
                n_known, b_sum, s_sum, s3_sum = (x[cuts[1:]] - x[cuts[:-1]] for x in sums)
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(cuts)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(ends), total)), pa.array(b_sum), pa.array(s_sum), pa.array(s3_sum)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score_2", "score"])

    return of


def score_documents(docs: DataFrame, fold: int = 2, folds: int = 7, shard_tokens: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score_2, score; learnt from the rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``."""
    spark = docs.sparkSession
    root = f"{has_checkpoint_dir(spark).rstrip('/')}/ngram-{uuid.uuid4().hex}"
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    train = rows.filter(~F.col("held_out")).select("text")
    # shards follow the input; bytes are a rough guide to tokens, and one number is all that reaches the driver
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / 6 / shard_tokens))
    packs = min(shards, PACKS)
    per = -(-shards // packs)
    shards = packs * per

    def dealt(counted: DataFrame) -> DataFrame:
        """Each pack, with its shards in order, to a task of its own."""
        return counted.repartitionById(packs, F.expr(f"int(shard div {per})")).sortWithinPartitions("shard")

    words = dealt(train.mapInArrow(count_words(shards), COUNTS)).mapInArrow(write_words(root, per), "pack int, words long, tokens long")
    sizes = {r.pack: (r.words, r.tokens) for r in cut(words).collect()}  # one row per pack
    if not sizes:  # nothing to learn from: the end is the only known word, never seen
        save_all(f"{root}/1/0", {"word": np.array([END]), "before": np.zeros(2, np.int64)})
        sizes, packs = {0: (1, 0)}, 1
    offset, base = (tuple(np.append(0, np.cumsum([sizes.get(s, (0, 0))[k] for s in range(packs)])).tolist()) for k in (0, 1))
    if offset[-1] >= int(NONE):
        raise ValueError(f"{offset[-1]} words: ids have 32 bits")
    made = dealt(train.mapInArrow(count_triples(root, offset, base, shards), TRIPLES)).mapInArrow(write_triples(root, offset, base, per), PACKED)
    before_bytes = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(8 << 20))  # packed rows are long: batches of rows by number would hold a task's whole input
    try:
        written = cut(made).collect()  # one row per pack
    finally:
        spark.conf.unset(BATCH) if before_bytes is None else spark.conf.set(BATCH, before_bytes)
    edges: dict[int, int] = {}
    for r in written:
        for word, kinds in {r.first: r.kinds_first, r.last: r.kinds_last}.items():
            edges[word] = edges.get(word, 0) + kinds
    try:
        return cut(rows.mapInArrow(score(root, offset, base, shards, per, frozenset(r.pack for r in written), edges), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score_2 double, score double"))
    finally:
        remove(root)
