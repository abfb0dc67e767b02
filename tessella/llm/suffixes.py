"""Repeated passages by sparse suffix arrays.

Of all suffixes of the corpus only those stay that begin at the minimiser of
some windows of ``least`` words: the smallest hash among their m-word grams.
Equal windows have equal minimisers, so every repeated window is met by
suffixes of one bucket (the gram they begin with).  A suffix travels with the
words that its windows reach to the right and (backwards) to the left.  Buckets are
sorted by what follows, neighbours are compared word by word and their matches are
extended to the right and to the left.

A suffix that its neighbours' matches do not cover whole may match longer to the
left with another one.  Such buckets are sorted by what precedes as well.  The
intervals of the first order with r words in common to the right, and of the second
with ``least`` - r in common to the left, are named for every r: two suffixes with
both names alike have a repeated window between them, so the result is exact.  A run of
windows that holds its minimiser more than once has a suffix for each occurrence that
is the first in some window; they share the one text that travels.

Buckets too large for a task are passed on and counted as the windows of op7 are.

Rules: null texts are empty; a row is known by a hash of doc_id and text, so rows
without doc_id or with the same one are rows of their own; repeated rows are copies
like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .substring import GATHER, SPANS, bounded, row_key, runs, spans_of, with_large
from .words import U64, Words, binary, grams, of_binary, pieces, spread

LEAST, GRAM = 50, 6
SUFFIXES = "bucket long, row long, start int, before binary, after binary, loose boolean"


def anchors(words: Words, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor word, gram hash, loose): one for each run of windows with the same minimiser.

    The anchor is where the minimiser first stands; loose runs hold it more
    than once (words that repeat in place), so they may match at other offsets.
    """
    begin, count, low = runs(words, least, gram)
    if not len(begin):
        return begin, count, begin, low, np.zeros(0, dtype=bool)
    g = grams(words.hash, gram)
    size = count + least - gram
    here = g[spread(begin, size)] == np.repeat(low, size)
    first = np.cumsum(size) - size
    hits = np.flatnonzero(here)
    at = hits[np.searchsorted(hits, first)] - first
    return begin, count, begin + at, low, np.add.reduceat(here, first) > 1


def suffixes(least: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                begin, count, at, bucket, loose = anchors(words, least, gram)
                if not len(begin):
                    continue
                row = words.row[begin]
                code = (words.hash >> U64(32)).astype(">u4")  # bytes sort as the numbers do
                ids = batch.column("row").to_numpy()
                before, after = at - begin, begin + count + least - 1 - at
                backwards = np.repeat(2 * begin + before - 1, before) - spread(begin, before)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(ids[row]), pa.array((begin - words.first[row]).astype(np.int32)), binary(code[backwards], before), binary(code[spread(at, after)], after), pa.array(loose)],
                    names=["bucket", "row", "start", "before", "after", "loose"],
                )

    return of


def common(code: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Equal codes from positions a and b on, ``step`` by ``step``, ``most`` at most."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    j = 0
    while len(live):
        live = live[code[a[live] + step * j] == code[b[live] + step * j]]
        j += 1
        out[live] = j
        live = live[most[live] > j]
    return out


def texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the texts one after the other, begin of each, words to the left and to the right of its anchor)."""
    left, nl = of_binary(table.column("before"), ">u4")
    right, nr = of_binary(table.column("after"), ">u4")
    begin = np.cumsum(nl + nr) - nl - nr
    code = np.empty(len(left) + len(right), dtype=np.uint32)
    code[np.repeat(begin + nl - 1, nl) - spread(np.zeros(len(nl), np.int64), nl)] = left
    code[spread(begin + nl, nr)] = right
    return code, begin, nl, nr


class Suffixes:
    """Suffixes of whole buckets: the flat codes of their texts, and of each its text's owner, anchor and reach to both sides."""

    def __init__(self, table: pa.Table, least: int, gram: int):
        code, begin, nl, nr = texts(table)
        self.code, self.begin = code, begin
        self.owner, self.anchor, self.left, self.right = np.arange(len(nl)), begin + nl, nl, nr
        bucket = table.column("bucket").to_numpy()
        loose = table.column("loose").to_numpy(zero_copy_only=False)
        if loose.any():
            again = np.flatnonzero(np.isin(bucket, np.unique(bucket[loose])))
            self.resort(again, loose, begin, nl, nr, bucket, least, gram)
        self.bucket = bucket[self.owner]

    def resort(self, rows: np.ndarray, loose: np.ndarray, begin: np.ndarray, nl: np.ndarray, nr: np.ndarray, bucket: np.ndarray, least: int, gram: int) -> None:
        """One suffix for each occurrence of the gram in loose texts of the buckets of ``rows``; these buckets sorted anew."""
        owner, anchor, low, high = [], [], [], []
        for r in rows.tolist():
            at, end = int(begin[r] + nl[r]), int(begin[r] + nl[r] + nr[r])
            places = np.array([at])
            if loose[r]:
                here = np.ones(end - gram + 1 - int(begin[r]), dtype=bool)
                for j in range(gram):
                    here &= self.code[int(begin[r]) + j : end - gram + 1 + j] == self.code[at + j]
                places = np.flatnonzero(here) + int(begin[r])
            # windows from behind the occurrence before (or the text's begin) up to this one have it as their first
            first = np.append(begin[r], places[:-1] + 1)
            last = np.minimum(places, end - least)
            some = first <= last
            owner.append(np.full(int(some.sum()), r))
            anchor.append(places[some])
            low.append(first[some])
            high.append(last[some] + least)
        own, at = np.concatenate(owner), np.concatenate(anchor)
        left, right = at - np.concatenate(low), np.concatenate(high) - at
        raw = self.code.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), right.tolist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
        order = order[np.argsort(bucket[own[order]], kind="stable")]
        rest = np.ones(len(nl), dtype=bool)
        rest[rows] = False
        rest = np.flatnonzero(rest)
        # the buckets taken out go behind the others
        self.owner, self.anchor = np.concatenate([rest, own[order]]), np.concatenate([self.anchor[rest], at[order]])
        self.left, self.right = np.concatenate([nl[rest], left[order]]), np.concatenate([nr[rest], right[order]])

    def neighbours(self, order: np.ndarray, step: int) -> np.ndarray:
        """Words that each suffix of an order has in common with the one before it, to one side; -1 in another bucket."""
        out = np.full(len(order), -1, dtype=np.int64)
        pair = np.flatnonzero(self.bucket[order[1:]] == self.bucket[order[:-1]]) + 1
        a, b = order[pair - 1], order[pair]
        reach = self.right if step > 0 else self.left
        shift = 0 if step > 0 else -1
        out[pair] = common(self.code, self.anchor[a] + shift, self.anchor[b] + shift, np.minimum(reach[a], reach[b]), step)
        return out

    def by_left(self, some: np.ndarray) -> np.ndarray:
        """``some`` suffixes sorted by bucket and what precedes, read backwards."""
        raw = self.code[::-1].astype(">u4").tobytes()
        n = len(self.code)
        keys = [raw[4 * (n - a) : 4 * (n - a + m)] for a, m in zip(self.anchor[some].tolist(), self.left[some].tolist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
        return some[order[np.argsort(self.bucket[some[order]], kind="stable")]]


def matches(x: Suffixes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, words to its left, words to its right) of passages that stand elsewhere too."""
    every = np.arange(len(x.owner))
    along = x.neighbours(every, 1)
    pair = np.flatnonzero(along >= 0)
    down = common(x.code, x.anchor[pair - 1] - 1, x.anchor[pair] - 1, np.minimum(x.left[pair - 1], x.left[pair]), -1)
    hit = along[pair] + down >= least
    pair, up, down = pair[hit], along[pair[hit]], down[hit]
    out = [(np.concatenate([pair - 1, pair]), np.concatenate([down, down]), np.concatenate([up, up]))]
    # suffixes that no neighbour's match covers whole, in buckets of more than two
    settled = np.zeros(len(every), dtype=bool)
    for who in (pair - 1, pair):
        settled[who[(down == x.left[who]) & (up == x.right[who])]] = True
    _, group, size = np.unique(x.bucket, return_inverse=True, return_counts=True)
    some = np.flatnonzero(((np.bincount(group, weights=~settled) > 0) & (size > 2))[group])
    if len(some):
        ahead, back = x.by_left(some), np.empty(len(every), dtype=np.int64)
        behind = x.neighbours(ahead, -1)
        back[ahead] = np.arange(len(ahead))
        right = x.neighbours(some, 1)
        for r in range(1, least + 1):
            mine = np.flatnonzero((x.right[some] >= r) & (x.left[some] >= least - r))
            if len(mine) < 2:
                continue
            to_right = np.cumsum(right < r)[mine]
            to_left = np.cumsum(behind < least - r)[back[some[mine]]]
            name = to_right * (len(some) + 1) + to_left
            _, at, times = np.unique(name, return_inverse=True, return_counts=True)
            who = some[mine[times[at] > 1]]
            out.append((who, np.full(len(who), least - r), np.full(len(who), r)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def compare(least: int, gram: int, gather: int):
    """Spans of repeated windows (packed is null), and the texts of buckets that are too large (stop is null)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in bounded(batches, "bucket", gather):
            if not whole:
                code, _, nl, nr = texts(table)
                yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), table.column("start").combine_chunks(), pa.nulls(len(nl), pa.int32()), binary(code, nl + nr)], names=["row", "start", "stop", "packed"])
                continue
            x = Suffixes(table, least, gram)
            who, left, right = matches(x, least)
            own = x.owner[who]
            zero = table.column("start").to_numpy().astype(np.int64)[own] + x.anchor[who] - x.begin[own]
            yield joined_spans(own, zero - left, zero + right, table.column("row").to_numpy())

    return of


def joined_spans(own: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Ranges of the same text joined where they overlap or touch."""
    order = np.lexsort((a, own))
    own, a, b = own[order], a[order], b[order]
    if len(own):
        far = int(b.max()) + 2
        reach = np.maximum.accumulate(b + own * far) - own * far  # of this owner, as later owners lie further
        new = np.append(True, (own[1:] != own[:-1]) | (a[1:] > reach[:-1]))
        last = np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)
        own, a, b = own[new], a[new], reach[last]
    return spans_of(rows[own], a, b)


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(Words(batch.column("text")).count.astype(np.int64))], names=["doc_id", "row", "n_words"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching ranges of a row, sorted, as one."""
    for batch in batches:
        ids, spans = batch.column("row"), []
        for ranges in batch.column("spans"):
            v = ranges.values
            a, b = v.field("start").to_numpy(), np.maximum.accumulate(v.field("stop").to_numpy())
            new = np.append(True, a[1:] > b[:-1])
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)], strict=True)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["row", "spans"])


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(row, spans): the word ranges of each row that also stand elsewhere, sorted and disjoint; only rows with any."""
    rows = docs.filter("text is not null").select(row_key().alias("row"), "text").mapInArrow(suffixes(least, gram), SUFFIXES)
    found = cut(rows.repartition("bucket").sortWithinPartitions("bucket", "after").mapInArrow(compare(least, gram, GATHER), SPANS))
    grouped = with_large(found, least).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return grouped.mapInArrow(joined, "row long, spans array<struct<start: int, stop: int>>")


def passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_repeated (words in repeated passages), n_passages, spans."""
    found = cut(repeated_passages(docs, least, gram))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(lengths, "doc_id long, row long, n_words long")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))
    return sizes.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce(total, F.lit(0)).cast("long").alias("n_repeated"), F.coalesce(F.size(F.filter("spans", lambda x: x.isNotNull())), F.lit(0)).cast("long").alias("n_passages"), F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>")).alias("spans")
    )
