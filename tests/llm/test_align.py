"""op11 against brute force: whole texts through both libraries, groups and counts in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import align
from tessella.llm.queries import op11_align, token_paths

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
FIELDS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*token_paths())


def brute(pair, rows):
    docs, held = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            want = (" " + text).encode()
            a, b = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
            if b"".join(pair.bytes_a[x] for x in a) == want == b"".join(pair.bytes_b[x] for x in b):
                sides = []
                for ids, size in ((a, pair.size_a), (b, pair.size_b)):
                    end, out = 0, {}
                    for x in ids:
                        end += int(size[x])
                        out[end] = x
                    sides.append(out)
                cuts = sorted(set(sides[0]) & set(sides[1]))
                for low, high in zip([0, *cuts], cuts):
                    groups.append([[x for e, x in side.items() if low < e <= high] for side in sides])
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(set(links))
        docs.append((i, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sums = (sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()))
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), *sums, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def of(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=repr)


def test_whole_table(spark, pair):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert of(op11_align(spark, SF)) == brute(pair, docs)


ODD = [None, "", " ", "\n", "a", " a", "a ", "  two  spaces  ", "line\nline\r\n\ttab", "café straße é × x", "  nbsp   x", "▁ lower block", "<s> </s> <unk> <0x41> <|endoftext|>", "\U0001f600\U0001f600 漢字 漢 א", "it's we'll 'quoted' 3.14 1,000", "\x00 nul", "é combining", "x" * 5000, "z " * 3000, "　　 wide", "end of text \n "]


def test_odd_texts(spark, pair):
    rows = [*enumerate(ODD), (None, "rows without an id"), (None, None), (3, "same row"), (3, "same row")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "block", "a", "b", "cuts", "n", "group", "end")})
    want = brute(pair, rows)
    for size in (1 << 20, 500):
        assert of(align.align_documents(docs, *token_paths(), block_bytes=size)) == want
    assert sum(n_a == 0 for _, n_a, *_ in want) >= 4
    assert align.align_documents(spark.createDataFrame([], SCHEMA), *token_paths()).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("align_")]


def test_units_have_the_tokens_of_whole_texts(pair, spark):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    texts = [t for t in texts if t]
    place, of_text, count, good = pair.units(pa.array(texts))
    tokens = [[[x & align.ID for x in t] for t in pair.lists(side, place).to_pylist()] for side in (0, 1)]
    assert len(place) < 0.5 * len(of_text)
    at = 0
    for text, n, ok in zip(texts, count.tolist(), good.tolist(), strict=True):
        own = of_text[at : at + n].tolist()
        at += n
        want = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
        assert ok == (b"".join(pair.bytes_b[x] for x in want[1]) == (" " + text).encode())
        for side in (0, 1) if ok else ():
            assert [x for u in own for x in tokens[side][u]] == want[side]


def test_random_texts_are_cut_where_tokens_end(pair):
    rng = random.Random(11)
    bits = ["word", "Don", "'", "'s", "###", "!!!", "!", "$9", "12", ",", ".", "é", "ß", "×", "Ã", " ", "  ", "\n", "\t", "\u00a0", "x", "_", "(", ")", "--", "\u2581", "漢", "</s>", "#", "0x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    place, of_text, count, good = pair.units(pa.array(texts))
    tokens = [[[x & align.ID for x in t] for t in pair.lists(side, place).to_pylist()] for side in (0, 1)]
    at = 0
    for text, n, ok in zip(texts, count.tolist(), good.tolist(), strict=True):
        own = of_text[at : at + n].tolist()
        at += n
        want = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
        assert ok == all(b"".join(t[x] for x in w) == (" " + text).encode() for t, w in zip((pair.bytes_a, pair.bytes_b), want, strict=True)), text
        for side in (0, 1) if ok else ():
            assert [x for u in own for x in tokens[side][u]] == want[side], text


def test_ranks_and_merges_agree(pair, spark):
    assert pair.ranked is not None
    texts = [" " + (r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert pair.encode_first(texts) == [e.ids for e in pair.first.encode_batch_fast(texts, add_special_tokens=False)]
    assert align.by_rank({"merges": []}, [b"a", b"b"], {}) is None


def test_no_piece_crosses_a_cut_at_a_space(pair):
    """No piece of B has a space behind another character."""
    assert not [p for p in pair.bytes_b if b" " in p.lstrip(b" ")]


def test_tokens_and_cuts_are_never_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = align.Kept(spark, 4)
    labels = align.block_labels(spark, 4)
    with align.settings(spark):
        rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").select(F.get(F.array(*map(F.lit, labels)), (F.col("row") % 4).cast("int")).cast("long").alias("block"), "*")
        both = kept.put(rows.repartition(4, "block").sortWithinPartitions("block").mapInArrow(align.numbered(*token_paths()), align.UNITS), "units")
        texts, units = both.filter("row IS NOT NULL").select("block", "row", "doc_id", "units"), both.filter("unit IS NOT NULL").select("block", "unit", "a", "b")
        plans = [align.cut_lists(units)]
        units = units.join(kept.put(plans[0], "cuts").hint("merge"), ["block", "unit"])
        pairs = kept.put(align.pairs_of(units), "pairs")
        plans += [align.pairs_of(units), align.held_pairs(texts, pairs)]
        for p in plans:
            plan = p._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan
    kept.drop()


def test_units_that_blocks_share_are_kept_once(spark):
    """Cuts and links are found once for each unit of the corpus, not of each block."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("row"), "doc_id", "text")
    kept = align.Kept(spark, 4)
    labels = F.array(*map(F.lit, align.block_labels(spark, 4)))
    with align.settings(spark):
        rows = docs.select(F.get(labels, (F.col("row") % 4).cast("int")).cast("long").alias("block"), "*")
        both = kept.put(rows.repartition(4, "block").sortWithinPartitions("block").mapInArrow(align.numbered(*token_paths()), align.UNITS), "units")
        units = both.filter("unit IS NOT NULL").select("block", "unit", "key", "a", "b")
        own = kept.put(align.distinct_units(units), "own")
        each, once = units.count(), own.select("key").distinct().count()
        assert own.count() == once == units.select("key").distinct().count() < 0.7 * each
        assert own.select("block").distinct().count() == 4
    kept.drop()
