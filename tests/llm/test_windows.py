"""Repeated windows (op6, op7) against brute force: rows without an id or with the same one, periodic texts, buckets too large for a task."""

import random

import duckdb
import pytest

from tessella.llm import queries, substring, suffixes

SCHEMA = "doc_id long, text string"


def covered(texts, size):
    """For each text a mask of the words that windows which also start elsewhere cover."""
    seen = {}
    words = [(t or "").split() for t in texts]
    for w in words:
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])] = seen.get(tuple(w[k : k + size]), 0) + 1
    out = []
    for w in words:
        mask = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                mask[k : k + size] = [True] * size
        out.append(mask)
    return out


def mixed(rng):
    parts = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(6, 60))] for _ in range(12)]
    period = [f"p{i}" for i in range(7)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            part = rng.choice(parts)
            cut = rng.randint(0, len(part) // 3)
            w += part[cut:] if kind < 0.5 else (period * 9)[rng.randint(0, 9) : rng.randint(10, 60)] if kind < 0.7 else ["same"] * rng.randint(1, 50) if kind < 0.8 else [f"u{rng.randrange(10**9)}" for _ in range(rng.randint(1, 30))]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("gather", [substring.GATHER, 3000])
@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, monkeypatch, seed, gather):
    monkeypatch.setattr(substring, "GATHER", gather)
    monkeypatch.setattr(suffixes, "GATHER", gather)
    texts = mixed(random.Random(seed))
    # ids that repeat or are missing, over different texts
    df = spark.createDataFrame([(None if k % 5 == 0 else k // 3, t, k) for k, t in enumerate(texts)], SCHEMA + ", k long")
    for size, gram in ((20, 6), (12, 4)):
        want = covered(texts, size)
        cut = sorted(substring.remove_repeats(df, window=size, gram=gram).collect(), key=lambda r: r.k)
        assert [r.n_removed for r in cut] == [sum(m) for m in want]
        assert [r.text for r in cut] == [t if not any(m) else " ".join(x for x, gone in zip(t.split(), m, strict=True) if not gone) for t, m in zip(texts, want, strict=True)]
        rows = {(r.doc_id, r.n_words): r for r in suffixes.passages(df, least=size, gram=gram).collect()}
        for k, (t, m) in enumerate(zip(texts, want, strict=True)):
            same = [j for j, u in enumerate(texts) if len(u.split()) == len(m) and (None if j % 5 == 0 else j // 3) == (None if k % 5 == 0 else k // 3)]
            if len(same) == 1:
                r = rows[None if k % 5 == 0 else k // 3, len(m)]
                got = [False] * len(m)
                for s in r.spans:
                    got[s.start : s.stop] = [True] * (s.stop - s.start)
                assert got == m and r.n_repeated == sum(m)


def test_rows_of_one_id_and_rows_without_are_rows(spark, tmp_path):
    w, u = (" ".join(f"{c}{i}" for i in range(40)) for c in "wu")
    for given, want in (([(1, w), (None, w)], [40, 40]), ([(1, w), (1, u), (2, w)], [40, 0, 40]), ([(1, w), (1, w)], [40, 40])):
        path = f"{tmp_path}/{len(given)}{given[-1][0]}"
        spark.createDataFrame(given, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
        got = queries.op7_substring(spark, path)
        assert sorted(r.n_removed for r in got.collect()) == sorted(want)
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        for name in ("op6_suffixes", "op7_substring"):
            df = queries.QUERIES[name](spark, path)
            rows = db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
            assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in df.collect())
