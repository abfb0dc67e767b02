"""First-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenised and closed with an end id.  Runs of ``capacity`` tokens are
sequences of their own; what is left of each document is dealt at random to groups of
about ``group_bytes`` of text.  A group is packed on its own: pieces come longest first, and
each goes to the first bin with room, found from the root of a tree whose
nodes hold the most room below them.  Documents may be cut, and a sequence whose length is a power
of two needs no padding, so no padding is left at all: the emptiest bins of
a group are dissolved, just as many as fill the gaps of the others, and what then remains
makes sequences of falling powers of two.  That cuts about one piece for each gap.

The groups are drawn from the number of a row in its task, so rows that are alike spread
over all of them; the documents must be read in one order however often a task runs (files,
checkpoints and Parquet are).  A piece travels with its ids, as a cut needs them; full
sequences travel without, unless they are asked for.

Rules: null and empty texts are the end id alone; repeated rows, and rows without
doc_id, are documents of their own; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Units, WordIds, _ids
from .substring import groups
from .words import pieces, spread

CAPACITY, END_ID, GROUP_BYTES = 4096, 2, 48 << 20
PIECES = "group int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, in the order given: the first with room.

    Of the bins that first fit opens at most one is no more than half full, so twice the
    tokens hold them all; each starts with its whole capacity.
    """
    leaves = 1 << (2 * int(size.sum()) // capacity + 1).bit_length()
    room = [capacity] * (2 * leaves)
    where = []
    for s in size.tolist():
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < s:
                i += 1
        where.append(i - leaves)
        room[i] -= s
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if most == room[i]:  # so nothing changes above
                break
            room[i] = most
    return np.array(where, dtype=np.int64)


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def packed(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, begin in it, length, bin, offset) of every part of the pieces: bins are gapless and have ``capacity`` or a power of two of tokens."""
    if not len(size):
        return (np.zeros(0, np.int64),) * 5
    order = np.argsort(-size, kind="stable")
    where = np.empty(len(size), dtype=np.int64)
    where[order] = first_fit(size[order], capacity)
    fill = np.bincount(where, weights=size).astype(np.int64)
    emptiest = np.argsort(fill, kind="stable")
    have = np.append(0, np.cumsum(fill[emptiest]))
    lack = np.append(0, np.cumsum(capacity - fill[emptiest]))
    lack = lack[-1] - lack
    gone = int(np.argmax(have >= lack))  # so many bins are dissolved; less than a bin remains then
    stays = np.ones(len(fill), dtype=bool)
    stays[emptiest[:gone]] = False
    number = np.cumsum(stays) - 1

    kept = order[stays[where[order]]]
    kept = kept[np.argsort(where[kept], kind="stable")]
    ends = np.cumsum(size[kept])
    begin = ends - size[kept]
    first = np.append(True, where[kept][1:] != where[kept][:-1])[: len(kept)]
    offset = begin - np.maximum.accumulate(np.where(first, begin, 0)) if len(kept) else begin

    # parts of what is dissolved: cut where a piece ends and where a place is full
    loose = order[~stays[where[order]]]
    gaps = np.flatnonzero(stays & (fill < capacity))
    rest = powers_of_two(int(have[gone] - lack[gone]))
    room = np.append(capacity - fill[gaps], rest).astype(np.int64)
    at_bin = np.append(number[gaps], stays.sum() + np.arange(len(rest))).astype(np.int64)
    at_offset = np.append(fill[gaps], np.zeros(len(rest), np.int64)).astype(np.int64)
    piece_end, room_end = np.cumsum(size[loose]), np.cumsum(room)
    stop = np.union1d(piece_end, room_end).astype(np.int64)
    start = np.append(0, stop[:-1])[: len(stop)].astype(np.int64)
    p, r = np.searchsorted(piece_end, stop), np.searchsorted(room_end, stop)
    return (
        np.append(kept, loose[p]), np.append(np.zeros(len(kept), np.int64), start - (piece_end - size[loose])[p]), np.append(size[kept], stop - start),
        np.append(number[where[kept]], at_bin[r]), np.append(offset, at_offset[r] + start - (room_end - room)[r]),
    )


def cut_documents(path: str, capacity: int, end_id: int, number: int, with_ids: bool):
    """Full sequences and the rest of each document, with the groups they are dealt to."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids.setdefault(path, WordIds(path))
        for whole in batches:
            for batch in pieces(whole, most=2 << 20):
                words = Units(batch.column("text"))
                flat, length = ids_of.of(words)
                ends = np.append(0, np.cumsum(length))[words.first]
                total = np.diff(ends) + 1
                flat = np.insert(flat, ends[1:], end_id).astype("<u4")
                ends = ends + np.arange(words.rows + 1)
                parts = -(-total // capacity)
                row = np.repeat(np.arange(words.rows), parts)
                start = capacity * spread(np.zeros(words.rows, np.int64), parts)
                size = np.minimum(capacity, total[row] - start)
                key = batch.column("key").to_numpy()[row] + start  # a random number of the row
                raw = memoryview(flat).cast("B")
                cut = [raw[4 * a : 4 * b] for a, b in zip((ends[row] + start).tolist(), (ends[row] + start + size).tolist(), strict=True)]
                ids = [bytes(x) if with_ids or n < capacity else None for x, n in zip(cut, size.tolist(), strict=True)]
                columns = [
                    pa.array((key % number).astype(np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(total[row]), pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return of


def place(capacity: int, with_ids: bool):
    def one(group: int, table: pa.Table) -> pa.RecordBatch:
        length = table.column("length").to_numpy()
        full, short = np.flatnonzero(length == capacity), np.flatnonzero(length < capacity)
        part, begin, size, at, offset = packed(length[short], capacity)
        row = np.append(full, short[part])
        begin, size = np.append(np.zeros(len(full), np.int64), begin), np.append(length[full], size)
        bins = int(at.max()) + 1 if len(at) else 0
        sequence = np.append(bins + np.arange(len(full)), at) + (np.int64(group) << 32)
        crc = table.column("ids_crc32").to_numpy()[row]
        ids = table.column("ids").take(pa.array(row)).to_pylist() if with_ids else None
        source = table.column("ids")
        for k in np.flatnonzero(size < length[row]).tolist():  # what has been cut
            own = source[int(row[k])].as_py()[4 * int(begin[k]) : 4 * int(begin[k] + size[k])]
            crc[k] = zlib.crc32(own)
            if ids is not None:
                ids[k] = own
        take = pa.array(row)
        columns = [
            table.column("doc_id").take(take).combine_chunks(), pa.array(table.column("start").to_numpy()[row] + begin), pa.array(size), pa.array(crc),
            table.column("doc_tokens").take(take).combine_chunks(), pa.array(sequence), pa.array(np.append(np.zeros(len(full), np.int64), offset)),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if ids is not None:
            columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "group", 16 << 20):
            group = table.column("group").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield one(int(group[a]), table.slice(a, b - a).combine_chunks())

    return of


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian 32-bit)."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    number = max(1, math.ceil((rows + (size or 0)) / group_bytes))
    key = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(0x3FFFFFFFFFFFFFFF)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key")).mapInArrow(cut_documents(path, capacity, end_id, number, with_ids), PIECES)
    return parts.repartition("group").sortWithinPartitions("group").mapInArrow(place(capacity, with_ids), PLACED + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, length, ids."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", "length", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
