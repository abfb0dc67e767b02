"""Rows of each pipeline stage against brute force over a small table with rows that repeat, lack an id, share one or have no text."""

import random
import zlib

import pytest

import corpus_pipeline
from tessella.llm import quality
from tessella.llm.queries import tokenizer_path

from test_near_dedup import brute, variants
from test_results import sellers
from test_windows import covered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(12)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    shared = own(50)
    item = own(20)
    texts = variants(rng, 12, 80, 4, "a") + variants(rng, 12, 400, 30, "b") + [f"{own(30)} {shared} {own(10)}" for _ in range(4)]
    texts += [f"{own(9)}  {item} {own(5)}", item, shared, own(3000), own(10), own(60), "", None, "one two", " \n "]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[3]), (None, own(40)), (5, own(44)), (5, item + " and"), (None, item), (None, None), rows[-1]]
    rng.shuffle(rows)
    at = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)], SCHEMA)
    df.repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, own(30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(30)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{given}/labels.parquet"))
    score = {(r.doc_id, r.n_chars): r.score for r in quality.score_documents(docs, model).join(docs.select("doc_id", "n_chars"), "doc_id").collect()}
    out = corpus_pipeline.keep_good(spark, docs, given)
    kept = pairs(out)
    single = {r.doc_id for r in docs.groupBy("doc_id").count().filter("count = 1").collect()}
    for r in docs.collect():
        if r.doc_id in single:
            assert ((r.doc_id, r.text) in kept) == (score[r.doc_id, r.n_chars] >= quality.KEEP)
        if not (r.text or "").split():
            assert (r.doc_id, r.text) not in kept
    assert out.columns == docs.columns and kept


def test_near_dedup(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, component = brute([t for _, t in rows], 80)
    groups = {}
    for k, (i, t) in enumerate(rows):
        name = component[k] if (t or "").split() else ("alone", i, t)  # such texts are alike to nothing; repeated rows are one
        groups.setdefault(name, []).append((i is None, i or 0, (i, t)))
    got = pairs(corpus_pipeline.one_of_each(spark, docs, given))
    assert len(got) == len(groups)
    left = {p: got.count(p) for p in got}
    for members in groups.values():
        least = min(m[:2] for m in members)
        fits = [p for none, i, p in members if (none, i) == least]
        assert sum(left.get(p, 0) for p in set(fits)) == 1 and sum(left.get(p, 0) for p in {p for *_, p in members}) == 1


def test_substring(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for (i, t), mask in zip(rows, covered([t for _, t in rows], 35), strict=True):
        if not any(mask):
            want.append((i, t, len(t) if t is not None else None))
        elif not all(mask):
            text = " ".join(w for w, gone in zip(t.split(), mask, strict=True) if not gone)
            want.append((i, text, len(text)))
    out = corpus_pipeline.without_repeats(spark, docs, given)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == sorted(want, key=str) and len(want) < len(rows)


def test_decontaminate(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    items = [r.text.split() for r in spark.read.parquet(f"{given}/benchmark.parquet").collect() if r.text]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, t) for i, t in rows if not any(sellers(w, (t or "").lower().split()) <= len(w) // 5 for w in items)]
    assert pairs(corpus_pipeline.without_benchmark(spark, docs, given)) == sorted(want, key=str) and len(want) == len(rows) - 4


def test_packing(spark, given):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{given}/documents.parquet")
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((r.doc_id, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = corpus_pipeline.packed(spark, docs, given).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_run_is_the_stages_one_after_the_other(spark, given, tmp_path):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, given).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, given).collect())) == sorted(map(key, docs.collect()))
