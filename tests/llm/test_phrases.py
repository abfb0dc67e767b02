"""op13: the hash, the counts and the ranking against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import phrases
from tessella.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string"


def test_perfect_hash_is_minimal(tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        phf = PerfectHash.of(keys)
        assert np.array_equal(np.sort(phf.slots(keys)), np.arange(len(keys)))
        phf.save(f"{tmp_path}/{n}")
        again = PerfectHash.load(f"{tmp_path}/{n}")
        assert np.array_equal(again.slots(keys), phf.slots(keys))
        other = rng.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64)
        assert again.slots(other).max(initial=-1) < max(1, len(keys))
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([5, 5], dtype=np.uint64))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        inside = any(q[0] == lang and len(q[1]) > len(w) and b >= a and any(q[1][i : i + len(w)] == w for i in range(len(q[1]))) for q, b in found.items())
        if not inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(mine, 1)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    common = ["the", "Of", "É", "straße", "x", "a", " ", "\U0001f600"]
    rows = []
    for i in range(150):
        w = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", "\x0b"]) for x in w)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    fixed = "one two three four five six"
    rows += [(200 + i, fixed, "en") for i in range(9)] + [(300, None, "en"), (301, "", None), (None, fixed, "en"), (None, fixed, "en"), (302, "b b b b b b b b b b b b b b", "fr"), (303, "rare only here", "xx"), (304, "q " * 30_000, "long")]
    return rows


@pytest.mark.parametrize(("least", "longest", "top"), [(5, 5, 2000), (8, 4, 7), (1, 3, 50), (10**6, 5, 10)])
def test_against_brute_force(spark, texts, least, longest, top):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(texts, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "f", "n", "shard", "rank", "level", "id", "a", "ids")})
    got = sorted(tuple(r) for r in phrases.collocations(docs.repartition(5), least, longest, top).collect())
    assert got == brute(texts, least, longest, top)


def test_many_shards_chunks_and_flushes(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, SCHEMA)
    got = sorted(tuple(r) for r in phrases.frequent_phrases(docs, 5, 5, shard=40).select("lang", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(tuple(r) for r in phrases.frequent_phrases(docs, 5, 5).select("lang", "phrase", "a", "l", "r", "n", "score").collect())


def test_tree_adds_arrays_of_all_tasks(spark):
    rng = np.random.default_rng(4)
    arrays = {part: {s: rng.integers(0, 3, 70_000) * (rng.random(70_000) < share) for s in (0, 3)} for part, share in zip(range(100), np.linspace(0, 1, 100), strict=True)}
    rows = []
    for part, counts in arrays.items():
        for b in phrases.nodes(counts, part):
            rows += b.to_pylist()
    got = phrases.tree_sum(spark.createDataFrame(rows, phrases.NODES), 100).collect()
    assert len(got) == 4
    for r in got:
        s, chunk = r.node >> 32, r.node >> 16 & 0xFFFF
        want = sum(a[s] for a in arrays.values())[chunk << 16 : (chunk + 1) << 16]
        assert np.array_equal(np.frombuffer(bytes(r.counts), np.int64)[: len(want)], want)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, ".,;", "en")], SCHEMA), least=1).collect() == []


def test_scores_beyond_64_bits():
    a, n = 3 * 10**12, 10**14
    assert phrases.lowest(a, n, [4 * 10**12, 4 * 10**12, 3 * 10**12], [5 * 10**12, 5 * 10**12, 10**14]) == (1000, 3)
    assert phrases.lowest(a, n, [4 * 10**12, 5 * 10**12], [5 * 10**12 + 1, 4 * 10**12 + 1]) == (14_999, 1)
