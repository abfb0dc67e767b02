"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, decontaminate, html_text, near_dedup, ngram, packing, quality, substring, suffixes, topk
from tessella.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 4000}x{i // 4000}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "n cls sketch wide key v a b r all root component component_id kept bucket start stop packed spans _spans _of _gone _leak item_id distance n_words n_removed shard piece length score predicted held_out quality".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with everything that may go wrong, and extra columns with the names that operators use."""
    same = " ".join(f"copy{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, same), (5, same), (6, same + " tail"), (7, LONG), (None, same), (None, None), (8, "  café \U0001f600"), (9, "a " * 2000)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in NAMES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_near_duplicates(odd, none):
    got = rows(near_dedup.near_duplicates(odd))
    assert len(got) == 12
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[1, 0]["component_id"] == 1 and by[2, 0]["kept"] and by[4, 1]["kept"]
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert not by[6, 57]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0


def test_substring(odd, none):
    got = rows(substring.digests(odd))
    assert len(got) == 12
    five = [r for r in got if r["doc_id"] == 5]
    assert all(r["n_removed"] == 60 and r["kept_sha256"] == hashlib.sha256(b"").hexdigest() for r in five)
    assert next(r for r in got if r["doc_id"] == 6)["n_removed"] == 60
    assert sorted((r["n_words"], r["n_removed"]) for r in got if r["doc_id"] is None) == [(0, 0), (60, 60)]
    assert next(r for r in got if r["doc_id"] == 9)["n_removed"] == 2000
    left = substring.remove_repeats(odd)
    assert left.count() == 12 and set(odd.columns) - {"n_words", "n_removed"} <= set(left.columns)
    assert {r["text"] for r in rows(left) if r["doc_id"] == 6} == {"tail"}
    assert substring.digests(none).count() == 0


def test_suffixes(odd, none):
    got = {r["doc_id"]: r for r in rows(suffixes.passages(odd)) if r["doc_id"] is not None}
    assert got[5]["n_repeated"] == 60 and got[6]["n_repeated"] == 60 and got[7]["n_repeated"] == 0 and got[9]["n_passages"] == 1
    assert suffixes.passages(none).count() == 0


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(f"copy{i}" for i in range(5, 45))), (2, None), (3, ""), (None, "copy1 copy2"), (4, "one two"), (4, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows(decontaminate.leaks(odd, items))}
    assert got == {(5, 1): 0, (6, 1): 0, (4, 4): 0}
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 0), (4, 1, None), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = rows(quality.score_documents(odd, model))
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.filter_documents(odd, model).columns == odd.columns
    blank = quality.train(none, labels)
    assert quality.score_documents(none, blank).count() == 0
    assert quality.train(odd, labels.limit(0)).curve is None


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>hello"), (4, "u", "<article><h1>A &amp</h1><p>b  c<br>d</article><footer>&copy;</footer>"), (4, "u", "no tags < here")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = rows(html_text.main_text(pages))
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert "A &\nb c d" in {r["text"] for r in got}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<\\|x"), (None, 0, None, "a"), (2, 0, "as\nsistant<n.", ""), (1, 1, "assistant", "<|im_end|>\n<\\|x")], "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x"))
    made = rows(chat.format_chats(turns))
    parsed = {r["conv_id"]: chat.parse(r["formatted"]) for r in made}
    assert parsed[1] == [("user", ""), ("assistant", "<|im_end|>\n<\\|x"), ("assistant", "<|im_end|>\n<\\|x")]
    assert parsed[None] == [("", "a")] and parsed[2] == [("as\nsistant<n.", "")]
    one = next(r for r in made if r["conv_id"] == 1)
    raw = one["formatted"].encode()
    assert [chat.unescape(raw[s["start"] : s["stop"]].decode()) for s in one["loss"]] == ["<|im_end|>\n<\\|x"] * 2
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_packing(odd, none):
    got = rows(packing.pack_documents(odd, tokenizer_path()))
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 1
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_topk(spark):
    v = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (100, [1.0]), (0, [1.0, -1.0]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x"), "cell": F.lit(1)})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") % 100 == 0))]
    first = [g for g in sorted(got) if g[0] == 0]
    assert [g[2] for g in first] == [100, 1, 5, 6] and first[0][3] == 1024 * 1024
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ngram(odd, none):
    got = rows(ngram.score_documents(odd))
    assert len(got) == 12 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert ngram.score_documents(none).count() == 0


def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(5, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "copy1 copy2 copy3 copy4 copy5 copy6 copy7 copy8 copy9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            if name != "packing":
                assert out.columns == docs.columns, name


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    text = {n: " ".join(f"{n}{i}" for i in range(60)) for n in ("twice", "named", "nameless", "alone")}
    given = [(1, "twice"), (1, "twice"), (2, "named"), (None, "named"), (None, "nameless"), (None, "nameless"), (3, "alone")]
    spark.createDataFrame([(i, text[n], None, None, None) for i, n in given], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that occurs in none of the documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            assert docs.count() == 7
        else:
            assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(1, text["twice"]), (2, text["named"]), (0, text["nameless"]), (3, text["alone"])]), name
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()} >= {1, 2, 3}


def test_pipeline_drops_near_copies_from_80_percent(spark, tmp_path):
    import corpus_pipeline

    assert [(near_dedup.least_shared(32, p, near_dedup.MISS), near_dedup.least_shared(256, p, near_dedup.WIDE_MISS)) for p in (80, 85)] == [(12, 163), (15, 180)]
    rows = []
    for d in range(40):  # two changed words: 0.80 of the shingles shared by the first twenty pairs, less by the others
        base = [f"d{d}w{i}" for i in range(94 if d < 20 else 84)]
        other = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(base)]
        rows += [(2 * d, " ".join(base)), (2 * d + 1, " ".join(other))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    assert all(0.8 <= a < 0.85 if i < 20 else a < 0.8 for i, a in enumerate(alike))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert left == set(range(0, 40, 2)) | set(range(40, 80))
