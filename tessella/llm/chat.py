"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts every
``<``, backslashes, ``|`` gets one more backslash, so that no control string can
appear there; taking one away restores the text.  All turns of a batch are
assembled at once: segment lengths, their cumulative sums as offsets, and one
scatter of the pool of headers and contents into a preallocated Arrow buffer.

Rules: turns come in the order of ``turn``, ties by role, then text; null text
and null role are empty; rows without conv_id form one conversation whose id is
null; repeated rows are repeated turns; other columns are ignored.  A newline in
a role becomes ``<n.``, every other ``<n`` there gets one more n.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import groups
from .words import spread, text_parts

START, MID, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
NO_ID = -(2**63)
SCHEMA = "conv_id long, formatted string, n_turns long, loss array<struct<start: long, stop: long>>"


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")
    return pc.replace_substring(pc.replace_substring_regex(out, "<(n+)", r"<\1n"), "\n", "<n.") if role else out


def unescape(text: str, role: bool = False) -> str:
    if role:
        text = re.sub(r"<(n+)(\.?)", lambda m: "\n" if m[1] == "n" and m[2] else f"<{m[1][1:]}{m[2]}", text)
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def assemble(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, sorted, to one row each."""
    role, ro = text_parts(escape(pc.fill_null(table.column("role").combine_chunks(), ""), role=True))
    text, to = text_parts(escape(pc.fill_null(table.column("text").combine_chunks(), "")))
    pool = np.concatenate([np.frombuffer(START + MID + END, np.uint8), role, text])
    n, head = len(ro) - 1, len(START) + len(MID) + len(END)
    source = np.empty((n, 5), dtype=np.int64)
    length = np.empty((n, 5), dtype=np.int64)
    for k, (a, size) in enumerate(((0, len(START)), (head + ro[:-1], np.diff(ro)), (len(START), len(MID)), (head + len(role) + to[:-1], np.diff(to)), (len(START) + len(MID), len(END)))):
        source[:, k], length[:, k] = a, size
    ends = np.cumsum(length.ravel())
    target = ends - length.ravel()
    size = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(size)
    out = np.frombuffer(buffer, dtype=np.uint8)
    out[spread(target, length.ravel())] = pool[spread(source.ravel(), length.ravel())]

    key = table.column("key").to_numpy()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    turn_at = target.reshape(n, 5)
    offs = np.append(turn_at[first, 0], size)
    turns = np.diff(np.append(first, n))
    learn = np.flatnonzero(pc.fill_null(pc.equal(table.column("role"), "assistant"), False).to_numpy())
    conv = np.repeat(np.arange(len(first)), turns)
    begin = turn_at[learn, 3] - offs[conv[learn]]
    spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + length[learn, 3])], names=["start", "stop"])
    each = np.append(0, np.cumsum(np.bincount(conv[learn], minlength=len(first))))
    texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offs.astype(np.int64)), buffer).cast(pa.string())
    ids = pa.array(key[first], mask=key[first] == NO_ID)
    return pa.RecordBatch.from_arrays([ids, texts, pa.array(turns), pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), spans)], names=["conv_id", "formatted", "n_turns", "loss"])


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, "key", 4 << 20):
        yield assemble(table)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns and loss, the byte ranges of the assistant texts in ``formatted``."""
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text").mapInArrow(assembled, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, unescaped."""
    start, end = START.decode(), END.decode()
    out = []
    for turn in formatted.split(end)[:-1]:
        role, _, text = turn[len(start) :].partition("\n")
        out.append((unescape(role, role=True), unescape(text)))
    return out


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns = parse(formatted)
            raw = formatted.encode()
            learnt = "".join(unescape(raw[s["start"] : s["stop"]].decode()) for s in loss)
            every = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted chats."""
    return chats.mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
