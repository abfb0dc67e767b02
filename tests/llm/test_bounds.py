"""Numbers of any size in op9; the bounded sample and the chain of op3 against enumeration."""

import itertools
import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality, queries, topk


def test_products_of_any_size_are_exact(spark):
    rng = random.Random(4)
    for scale in (1.0, 3e6, 1e12, 3e15, 1e200):
        rows = [(i, [rng.uniform(-scale, scale) for _ in range(4)]) for i in range(60)] + [(0, [scale, -scale, 0.5, 1.0]), (100, [scale] * 4)]
        ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
        want = []
        for i, v in {(i, tuple(v)) for i, v in ints if i % 100 == 0}:
            got = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63) + 1), 2**63 - 1), j) for j, w in ints if j != i)[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(got, 1)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        for group in (8192, 16):
            assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, group=group, block=8).collect()) == sorted(want), scale


def test_large_components_against_sql(spark, tmp_path):
    rows = [(0, [2e6, 1.0]), (1, [1.0, 0.0]), (2, [2.5e6, 2.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0]), (3, [-2e6, 1.0]), (100, [1e6, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op9_topk(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op9_topk']})").fetchall())


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(200)] + [(k, "w " * 50) for k in range(100, 140)] + [(9, "long " * 1000), (11, "both"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 3 + [(k, k % 2) for k in range(100, 140)] + [(9, 0), (11, 0), (11, 1), (None, 1), (12, None)], "doc_id long, quality int")
    every = quality.sampled(docs, labels, learn_from=F.lit(True)).collect()
    assert sorted(r.doc_id for r in every) == [7, 9, *range(100, 140)]  # 11 is labelled both ways
    assert len(quality.sampled(docs, labels, sample=5, learn_from=F.lit(True)).collect()) == 5
    few = quality.sampled(docs, labels, most=1000, learn_from=F.lit(True)).collect()
    assert sum(len(r.text) for r in few) <= 1000 and 9 not in {r.doc_id for r in few} and len(few) > 5
    again = quality.sampled(docs.repartition(5), labels.repartition(3), most=1000, learn_from=F.lit(True)).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, again))


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(2)
    count = np.array([1, 5, 0, 3, 7])
    first = np.cumsum(count) - count
    emission, change = rng.normal(size=count.sum()) * 2, rng.normal(size=(2, 2))
    good, pairs = quality.forward_backward(emission, first, count, change)
    want, moves = np.zeros(len(emission)), np.zeros((2, 2))
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([math.exp(sum(emission[a + i] for i in range(n) if p[i]) + sum(change[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for i in range(n):
                want[a + i] += w * p[i]
            for x, y in itertools.pairwise(p):
                moves[x, y] += w
    assert np.allclose(good, want) and np.allclose(pairs, moves)
