"""Sum-of-squares packing of token sequences.

Documents are tokenised, closed with an end id and cut into pieces of at most
``capacity`` tokens.  Pieces of full length are a sequence of their own.  The
others are dealt to shards of about ``SHARD`` pieces; each shard is packed with
the sum-of-squares rule over counts of open bins: N[g] bins have gap g, a piece
of length s goes where the sum of the squares N[g] ** 2 becomes smallest, be it a new
bin.  The pieces of a shard come longest first, so that the short ones fill what is
left; then the emptiest bins are dissolved into the gaps of the others while that
saves any.  A shard leaves a few bins open, whatever its size.

Only (doc_id, piece, length, digest) rows are shuffled, never token ids.

Rules: null and empty texts are the end id alone; repeated rows are separate
documents; a row without doc_id is packed like any other; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .words import Words, pieces, spread

CAPACITY, END_ID, SHARD = 4096, 1, 40_000
#: Distinct words whose ids one worker keeps.
CACHE = 2_000_000
_tokenizers: dict[str, object] = {}
_ids: dict[str, WordIds] = {}  # of this worker, for all its tasks


_KIND = np.full(256, 3, dtype=np.uint8)  # punctuation
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[65:91] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, dtype=bool)
_ODD[:9] = _ODD[14:32] = _ODD[127] = _ODD[0xC0:] = True
_ODD[0xC3] = False
_ODD[[39, 60]] = True  # contractions; special tokens


class Units(Words):
    """Words cut further where the word vocabularies' own rule always cuts: between letters, single digits and punctuation.

    Letters here are A-Z (lower-cased, as that vocabulary does) and Latin-1
    letters.  A word with any other character, an apostrophe or ``<`` stays
    one unit, in its own case, and is left to the tokenizer's rule.
    """

    def __init__(self, column):
        super().__init__(column)
        data, n = self.data, len(self.data)
        odd = _ODD[data]
        after_c3 = np.zeros(n, dtype=bool)
        after_c3[1:] = data[:-1] == 0xC3
        odd |= after_c3 & ((data == 0x97) | (data == 0xB7))
        many = np.append(0, np.cumsum(odd))
        strange = many[self.end] > many[self.start]
        edge = np.zeros(n + 1, dtype=np.int32)
        edge[self.start[strange]] += 1
        np.subtract.at(edge, self.end[strange], 1)
        free = np.cumsum(edge)[:n] == 0
        lower = data.copy()
        lower[free & (((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E)))] += 32
        kind = _KIND[lower]
        new = np.zeros(n + 1, dtype=bool)
        new[1:n] = free[1:] & (kind[1:] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        new[self.start] = True
        new[n:] = False
        start = np.flatnonzero(new)
        stop = new[1:] & (kind > 0)  # a unit ends before the next one
        stop[self.end - 1] = True
        self.start, self.end = start, np.flatnonzero(stop) + 1
        self.set(lower)


class WordIds:
    """Token ids of texts through ids of their units, which are kept.

    Sound for tokenizers that drop white space and split as described at
    Units: the ids of a text are those of its units, one after the other.
    """

    def __init__(self, path: str, most: int = CACHE):
        self.path, self.most = path, most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def tokenizer(self):
        if self.path not in _tokenizers:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
            from tokenizers import Tokenizer

            _tokenizers[self.path] = Tokenizer.from_file(self.path)
        return _tokenizers[self.path]

    def learn(self, words: Words, unique: np.ndarray, at: np.ndarray) -> None:
        place = np.searchsorted(self.key, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = place < len(self.key)
        known[inside] = self.key[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        raw = words.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True)]
        got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer().encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.concatenate(got)
        key = np.concatenate([self.key, unique[new]])
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])
        order = np.argsort(key, kind="stable")
        self.key, self.begin, self.length = key[order], begin[order], np.concatenate([self.length, length])[order]
        self.flat = np.concatenate([self.flat, flat])

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        unique, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.key) + len(unique) > self.most:
            self.clear()
        self.learn(words, unique, at)
        place = np.searchsorted(self.key, unique)[back]
        length = self.length[place]
        return self.flat[spread(self.begin[place], length)], length


def cut_pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids.setdefault(path, WordIds(path))
        for whole in batches:
            for batch in pieces(whole, most=2 << 20):
                words = Units(batch.column("text"))
                flat, length = ids_of.of(words)
                ends = np.append(0, np.cumsum(length))[words.first]
                ids = batch.column("doc_id").to_pylist()
                rows: list[tuple] = []
                for r in range(words.rows):
                    own = np.append(flat[ends[r] : ends[r + 1]], np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        rows.append((ids[r], k, a, len(part), zlib.crc32(part.tobytes()), part.tobytes() if with_ids else None))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                n = 5 + with_ids
                yield pa.RecordBatch.from_arrays(columns[:n], names=names[:n])

    return of


def sum_of_squares(lengths: np.ndarray, capacity: int, gaps: list[int] | None = None, opens: bool = True) -> tuple[np.ndarray, list[int]]:
    """(bin of each piece, gaps of all bins); pieces are taken in the order given, ``gaps`` are those of bins that are there before.

    Filling gap g takes one from N[g] and puts it at N[g - s] (nowhere if that
    is 0); half the change of the sum of squares is N[g - s] - N[g] + 1 (1/2 -
    N[g] for an exact fit).  A new bin is a gap of the whole capacity, of which
    there are enough and which no count holds: half the change is N[capacity - s] + 1/2.
    The smallest wins, ties to the smaller gap.  Unless it ``opens``, the choice is
    among the bins that are there, as long as one has room.
    """
    gaps = list(gaps or [])
    count = np.zeros(capacity + 1, dtype=np.float64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b, g in enumerate(gaps):
        if g:
            stacks[g].append(b)
            count[g] += 1
    where = np.zeros(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        fit = count[s:capacity]  # gaps s..capacity-1
        best = -1
        if len(fit):
            delta = count[: capacity - s] - fit + 1
            delta[0] = 0.5 - fit[0]
            delta[fit == 0] = np.inf
            g = int(delta.argmin())
            # a whole new sequence is the other choice
            if delta[g] < np.inf and (not opens or delta[g] <= count[capacity - s] + 0.5):
                best = g + s
        if best < 0:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        else:
            b, gap = stacks[best].pop(), best
            count[best] -= 1
        where[i], gaps[b] = b, gap - s
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return where, gaps


def bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins; pieces are taken longest first.

    All pieces are placed by the sum of squares.  While the gaps together hold whole
    bins, the emptiest bins (4 for each that could be saved, then 32 and 256) are
    dissolved and their pieces placed again, by the squares of the others, as long as
    that saves any.
    """
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    where, gaps = sum_of_squares(size, capacity)
    share = 4
    while (spare := sum(gaps) // capacity) and share <= 256:
        gap = np.array(gaps)
        stays = np.ones(len(gap), dtype=bool)
        stays[np.argsort(-gap, kind="stable")[: share * spare]] = False
        number = np.cumsum(stays) - 1
        again = ~stays[where]
        new, less = sum_of_squares(size[again], capacity, gap[stays].tolist(), opens=False)
        if len(less) >= len(gaps):
            share *= 8
            continue
        where, gaps = np.where(again, 0, number[where]), less
        where[again] = new
    by_bin = np.argsort(where, kind="stable")
    ends = np.cumsum(size[by_bin])
    begin = ends - size[by_bin]
    first = np.append(True, where[by_bin][1:] != where[by_bin][:-1])[: len(by_bin)]
    at = np.empty(len(size), np.int64)
    at[by_bin] = begin - np.maximum.accumulate(np.where(first, begin, 0))
    out, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    out[order], offset[order] = where, at
    return out, offset, len(gaps)


def place(capacity: int):
    def of(key, table):
        length = table.column("length").to_numpy()
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("piece").to_numpy(), ids, -length))
        where, offset, _ = bins(length[order], capacity)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        shard = key[0].as_py()
        sequence = where[back] + (np.int64(shard) << 32)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset[back]))

    return of


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ids) of all documents; ids are little-endian 32-bit."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_pieces(path, capacity, end_id, with_ids), schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset.

    Cut the lineage of ``parts`` before: it is read twice, once to count, and a row's number
    must be the same however often a task runs.
    """
    short = parts.filter(F.col("length") < capacity)
    n = short.count()
    shards = max(1, math.ceil(n / shard))
    # by the row's number: rows that are alike, as without doc_id, spread over all shards
    dealt = short.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = short.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    packed = dealt.groupBy("shard").applyInArrow(place(capacity), schema)
    # a full piece is alone in its sequence
    full = parts.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(token_pieces(docs, path, capacity, end_id, with_ids=False)), capacity)


def sequences(parts: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length and the ids of its pieces one after the other."""
    laid = packed.select("doc_id", "piece", "sequence_id", "offset").join(parts, ["doc_id", "piece"])
    rows = laid.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", "length", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
