"""op12: the tree against plain first fit, the rows against whole tokenisation."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import first_fit
from tessella.llm.queries import op12_first_fit, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain(size, capacity):
    room, where = [], []
    for s in size:
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        where.append(k)
    return where


def test_tree_finds_the_first_bin_with_room():
    rng = np.random.default_rng(12)
    for capacity, n in ((16, 500), (64, 800), (4096, 300), (10, 1), (10, 0)):
        size = -np.sort(-rng.integers(1, capacity, n))
        assert first_fit.first_fit(size, capacity).tolist() == plain(size.tolist(), capacity)
        loose = rng.integers(1, capacity, n)
        assert first_fit.first_fit(loose, capacity).tolist() == plain(loose.tolist(), capacity)


def test_parts_are_gapless_and_need_no_padding():
    rng = np.random.default_rng(13)
    for capacity, n in ((16, 500), (64, 801), (4096, 300), (4096, 1), (8, 7), (4096, 0)):
        size = rng.integers(1, capacity, n)
        part, begin, length, where, offset = first_fit.packed(size, capacity)
        for k in range(n):
            mine = sorted(zip(begin[part == k].tolist(), length[part == k].tolist(), strict=True))
            assert mine[0][0] == 0 and sum(x for _, x in mine) == size[k] and all(a + x == b for (a, x), (b, _) in zip(mine, mine[1:]))
        fill = np.bincount(where, weights=length).astype(int)
        for b in range(len(fill)):
            mine = sorted(zip(offset[where == b].tolist(), length[where == b].tolist(), strict=True))
            assert mine[0][0] == 0 and all(a + x == c for (a, x), (c, _) in zip(mine, mine[1:]))
        assert all(f == capacity or f & (f - 1) == 0 and 0 < f < capacity for f in fill.tolist())
        assert n == 0 or (fill == capacity).sum() == size.sum() // capacity
        # a piece is cut for a gap or for the last sequences only
        assert len(part) - n <= len(set(plain(-np.sort(-size), capacity))) + capacity.bit_length()


def held(got, rows, capacity=4096):
    """Every id lies in one piece, sequences are gapless and need no padding."""
    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted((i if i is not None else -1, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    single = {i: ids for i, ids in want if sum(i == j for j, _ in want) == 1}
    assert set(by_doc) == {i for i, _ in want}
    for i, ids in single.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            own = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(own)
            at += r["length"]
        assert at == len(ids)
    for i in set(by_doc) - set(single):
        assert sum(r["length"] for r in by_doc[i]) == sum(len(ids) for j, ids in want if i == j)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held([r.asDict() for r in op12_first_fit(spark, SF).collect()], docs)


def test_odd_rows_and_many_groups(spark):
    long = " ".join(f"w{i % 400} x{i // 400}" for i in range(6000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (None, "a b c"), (None, None), (7, "same text"), (7, "same text"), (8, "café \U0001f600 <|endoftext|>"), *((100 + k, f"word{k} " * (k % 90)) for k in range(200))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("group", "key", "start", "length", "ids", "sequence_id", "offset", "doc_tokens")})
    for group_bytes in (2000, 1 << 30):
        got = [r.asDict() for r in first_fit.pack_documents(docs, tokenizer_path(), group_bytes=group_bytes, with_ids=True).collect()]
        held(got, rows)
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert len({r["sequence_id"] >> 32 for r in first_fit.pack_documents(docs, tokenizer_path(), group_bytes=2000).collect()}) > 5
    whole = {r["sequence_id"]: r for r in first_fit.sequences(spark.createDataFrame(got)).collect()}
    assert sum(r["length"] for r in whole.values()) == sum(r["length"] for r in got) and all(len(r["ids"]) == 4 * r["length"] for r in whole.values())
    assert first_fit.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_rows_alike_spread_over_all_groups(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    got = first_fit.pack_documents(docs, tokenizer_path(), group_bytes=30_000).groupBy(F.shiftright("sequence_id", 32)).agg(F.sum("length").alias("n")).collect()
    assert len(got) == 10 and max(r.n for r in got) < 1.2 * min(r.n for r in got)


@pytest.mark.parametrize("n", [0, 1, 5, 4095])
def test_powers(n):
    got = first_fit.powers_of_two(n)
    assert sum(got) == n and len(set(got)) == len(got)
