"""Removal of repeated word windows by super-k-mer partitioning.

Every window of ``window`` consecutive words has a minimiser: the smallest hash
among its m-word grams.  Consecutive windows of a document that share it form
one super-k-mer, which travels as one packed string (32-bit word codes) to the
bucket of its minimiser.  Equal windows have equal minimisers, so a bucket sees
every copy of its windows; it sorts them and knows which occur more than once.

A bucket too large for a task's memory (a minimiser that very many windows share)
is not gathered: its super-k-mers are passed on as they stream by, and their
windows are counted by hash instead, partly before they are shuffled.

Rules: a row is known by a hash of doc_id and text, so rows without doc_id or with
the same one are rows of their own; null texts count as empty; texts of fewer than
``window`` words have no window and keep all words; repeated rows are copies of each
other like any other text; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, unused
from .words import U64, Words, binary, grams, mix, of_binary, pieces, sliding_min, spread

WINDOW, GRAM = 35, 6
#: Bytes of super-k-mers that a task gathers at a time.
GATHER = 24 << 20
RUNS = "bucket long, row long, start int, packed binary"
SPANS = "row long, start int, stop int, packed binary"


def row_key():
    """What tells a row from others in both readings of the documents: rows that share it have the same text."""
    return F.xxhash64("doc_id", "text")


def runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of every super-k-mer of a batch; a window is named by its first word."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    low = sliding_min(grams(words.hash, gram), window - gram + 1)
    row = words.row
    whole = row[:n] == row[window - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:n] != row[: n - 1])
    begin = np.flatnonzero(new & whole)
    # a run ends where the next begins or where windows leave the document
    stop = np.append(np.flatnonzero(new | ~whole), n)
    end = stop[np.searchsorted(stop, begin, side="right")]
    return begin, end - begin, low[begin]


def pack(window: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                begin, count, low = runs(words, window, gram)
                if not len(begin):
                    continue
                row = words.row[begin]
                code = (words.hash >> U64(32)).astype(np.uint32)
                ids = batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(ids[row]), pa.array((begin - words.first[row]).astype(np.int32)), binary(code[spread(begin, count + window - 1)], count + window - 1)],
                    names=["bucket", "row", "start", "packed"],
                )

    return of


def repeated(code: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """For each window (by its first code), whether the same codes start at another one: sort by hash, compare neighbours code by code."""
    wide = mix(code.astype(U64) + U64(1))
    key = grams(wide, window)[first]
    order = np.argsort(key, kind="stable")
    sorted_key, at = key[order], first[order]
    same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    a, b = at[same], at[same + 1]
    equal = np.ones(len(same), dtype=bool)
    for j in range(window):
        equal &= code[a + j] == code[b + j]
    hit = np.zeros(len(first), dtype=bool)
    hit[order[same[equal]]] = True
    hit[order[same[equal] + 1]] = True
    return hit


def merged(owner: np.ndarray, hit: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges that the hit windows of each owner cover, one for each stretch of consecutive hits."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
    begin = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
    return owner[begin], start[begin], start[end] + window


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by key, several at a time, about ``most`` bytes together or one group if that is larger."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(k, k[-1], side="left"))
        if size + batch.nbytes > most and (cut_at or held):
            if cut_at:
                yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
                held, size, batch = [], 0, batch.slice(cut_at)
            elif held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def bounded(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by key: whole groups, several at a time, about ``most`` bytes together; or (table, False) for parts of a group larger than that."""
    held: list[pa.RecordBatch] = []
    size, large = 0, None  # the key whose group is passed on in parts
    for batch in batches:
        for part in sliced(batch, most):
            k = part.column(key).to_numpy(zero_copy_only=False)
            if large is not None:
                to = int(np.searchsorted(k, large, side="right"))
                if to:
                    yield pa.Table.from_batches([part.slice(0, to)]), False
                    part, k = part.slice(to), k[to:]
                if not len(k):
                    continue
                large = None
            cut_at = int(np.searchsorted(k, k[-1], side="left"))
            if size + part.nbytes > most and held and not cut_at and held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.Table.from_batches(held), True
                held, size = [], 0
            if size + part.nbytes > most and cut_at:
                yield pa.Table.from_batches([*held, part.slice(0, cut_at)]), True
                held, size, part = [], 0, part.slice(cut_at)
            held.append(part)
            size += part.nbytes
            if size > most:
                # all that is held from the last key's first row on is one group
                table = pa.Table.from_batches(held)
                first = int(np.searchsorted(table.column(key).to_numpy(), k[-1], side="left"))
                if first:
                    yield table.slice(0, first), True
                    held = table.slice(first).to_batches()
                    size = sum(x.nbytes for x in held)
                if size > most:
                    yield pa.Table.from_batches(held), False
                    held, size, large = [], 0, k[-1]
    if held:
        yield pa.Table.from_batches(held), True


def sliced(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * most // max(4 * batch.nbytes, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def spans_of(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.nulls(len(row), pa.binary())], names=["row", "start", "stop", "packed"])


def count(window: int, gather: int):
    """Spans of repeated windows (packed is null), and the super-k-mers of buckets that are too large (stop is null)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in bounded(batches, "bucket", gather):
            if not whole:
                for part in table.select(["row", "start", "packed"]).to_batches():
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("start"), pa.nulls(part.num_rows, pa.int32()), part.column("packed")], names=["row", "start", "stop", "packed"])
                continue
            code, length = of_binary(table.column("packed"), np.uint32)
            windows = length - window + 1
            begin = np.cumsum(length) - length
            first = spread(begin, windows)
            owner = np.repeat(np.arange(len(length)), windows)
            hit = repeated(code, first, window)
            start = table.column("start").to_numpy().astype(np.int64)
            who, a, b = merged(owner, hit, start[owner] + first - begin[owner], window)
            yield spans_of(table.column("row").to_numpy()[who], a, b)

    return of


def named_windows(window: int):
    """(row, start, name): every window of packed super-k-mers with a hash of its codes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1 << 20):
                code, length = of_binary(part.column("packed"), np.uint32)
                windows = length - window + 1
                begin = np.cumsum(length) - length
                first = spread(begin, windows)
                owner = np.repeat(np.arange(len(length)), windows)
                name = grams(mix(code.astype(U64) + U64(1)), window)[first] if len(first) else np.zeros(0, U64)
                start = part.column("start").to_numpy().astype(np.int64)[owner] + first - begin[owner]
                yield pa.RecordBatch.from_arrays([pa.array(part.column("row").to_numpy()[owner]), pa.array(start.astype(np.int32)), pa.array(name.view(np.int64))], names=["row", "start", "name"])

    return of


def with_large(found: DataFrame, window: int) -> DataFrame:
    """(row, start, stop) of what ``count`` found and of the windows it passed on; ``found`` must be cut."""
    spans = found.filter("packed is null").select("row", "start", "stop")
    late = found.filter("packed is not null").select("row", "start", "packed")
    if late.isEmpty():
        return spans
    windows = cut(late.mapInArrow(named_windows(window), "row long, start int, name long"))
    again = windows.groupBy("name").agg(F.count("*").alias("times")).filter("times > 1").select("name")
    return spans.unionByName(windows.join(again, "name").select("row", "start", (F.col("start") + window).cast("int").alias("stop")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Word ranges (row, start, stop) covered by windows whose words also start anywhere else; ranges may overlap."""
    packed = docs.filter("text is not null").select(row_key().alias("row"), "text").mapInArrow(pack(window, gram), RUNS)
    return with_large(cut(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count(window, GATHER), SPANS)), window)


def by_row(spans: DataFrame) -> DataFrame:
    """(row, spans), equal ranges once."""
    return spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def kept_words(words: Words, spans: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Mask of the words that no range covers."""
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    n = len(words)
    edge = np.zeros(n + 1, dtype=np.int64)
    lists = np.diff(np.append(0, np.cumsum(np.nan_to_num(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False), nan=0)))).astype(np.int64)
    flat = spans.flatten()
    base = np.repeat(words.first[:-1], lists)
    if len(flat):
        most = np.repeat(words.count, lists)
        np.add.at(edge, base + np.minimum(flat.field("start").to_numpy(), most), 1)
        np.add.at(edge, base + np.minimum(flat.field("stop").to_numpy(), most), -1)
    return np.cumsum(edge)[:n] <= 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` without the repeated words: its columns, with the kept words joined by one space as ``text``, and two counts.

    A document none of whose words goes keeps its text as it is.  Columns of
    ``docs`` with the names in ``counts`` are replaced by the counts.
    """
    return _apply(docs, cut(by_row(repeated_spans(docs, window, gram))), counts)


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return _apply(docs.select("doc_id", "text"), cut(by_row(repeated_spans(docs, window, gram))), None)


def _apply(docs: DataFrame, spans: DataFrame, counts: tuple[str, str] | None) -> DataFrame:
    digest = counts is None
    of_, ranges = unused(docs, "_of"), unused(docs, "_spans")
    joined = docs.join(spans.select(F.col("row").alias(of_), F.col("spans").alias(ranges)), row_key() == F.col(of_), "left").drop(of_)
    names = docs.columns
    if digest:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        plain = docs.drop(*counts)
        names = plain.columns
        schema = T.StructType([*plain.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
        joined = joined.select(*names, ranges)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                keep = kept_words(words, batch.column(ranges))
                sums = np.append(0, np.cumsum(keep))
                n_kept = sums[words.first[1:]] - sums[words.first[:-1]]
                given = batch.column("text").to_pylist() if not digest else []
                raw = words.data.tobytes()
                out = []
                for r in range(words.rows):
                    a, b = words.first[r], words.first[r + 1]
                    if not digest and n_kept[r] == b - a:
                        out.append(given[r])
                        continue
                    at = np.flatnonzero(keep[a:b]) + a
                    kept = b" ".join(raw[i:j] for i, j in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True))
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
                total, gone = pa.array(words.count.astype(np.int64)), pa.array((words.count - n_kept).astype(np.int64))
                if digest:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), total, gone, pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, total, gone], names=[*names, *counts])

    return joined.mapInArrow(of, schema)
