"""Plans that grow with the input and no faster: what is shuffled, and what one task may gather."""

import glob
import json
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import duplicates, graph, lexical, lookup, search, vectors, versions
from tessella.plans import registry, retrieval
from tessella.plans.corpus import Corpus
from tessella.sources import ingest, segments
from tessella.sources.segments import EDGES, Store

CHUNKS = "chunk_id string, document_id string, title string, identifier string, content string, heading string, aliases string, path string"


def chunks(spark):
    rows = [(f"c{i}", f"d{i // 2}", "the red fox", "Fox" if i % 3 else None, "the fox and the hen " * (i + 1) + "w" * (i % 5), "", None, f"a/{i}.md") for i in range(40)]
    return spark.createDataFrame([*rows, ("none", "dn", "", None, None, "", None, "")], CHUNKS).repartition(5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_within_their_chunk(spark):
    found = lexical.postings(chunks(spark))
    assert "hashpartitioning" not in plan(found)
    got = {(r.chunk_id, r.term): (r.length, r.frequency) for r in found.collect()}
    # content 1.0 a word, title 6.0, identifier 12.0
    assert got["c4", "the"] == (3 + 1 + 26 + 3, 6.0 + 10.0) and got["c4", "fox"][1] == 6.0 + 5.0 + 12.0 and got["c4", "wwww"][1] == 1.0
    assert len(got) == found.count() and not [k for k in got if k[0] == "none"]


def test_scores_gather_no_term_in_one_task(spark):
    asked = spark.createDataFrame([(1, "the fox"), (2, "hen"), (3, "the-red")], "query_id long, query string")
    found = lexical.bm25(asked, chunks(spark))
    # the asked phrases and their weights go to the postings, the sums stay where a chunk's postings lie
    assert "SortMergeJoin" not in plan(found) and not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan(found))
    assert {r.query_id for r in found.collect()} == {1, 2, 3}


def test_stored_postings_hold_numbers_for_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    half = chunks(spark)
    store.commit({"text": half.filter("document_id < 'd2'")})
    store.commit({"text": half.filter("document_id >= 'd2' OR document_id = 'd1'")}, half.filter("document_id = 'd1'").select("document_id"))
    for s in store.current()["segments"]:
        assert sorted(f["name"] for f in s["schemas"]["postings"]["fields"]) == ["bucket", "n", "places", "term"]
    asked = spark.createDataFrame([("the",), ("wwww",)], "term string")
    read = lambda: sorted((r.term, r.chunk_id, r.document_id, r.length, r.frequency, len(r.places)) for r in store.postings(asked).collect())
    got = read()
    want = {(r.term, r.chunk_id): (r.length, r.frequency) for r in lexical.postings(half).filter("term IN ('the', 'wwww')").collect()}
    assert {(t, c): (n, f) for t, c, _, n, f, _ in got} == want and len(got) == len(want)
    assert json.dumps(store.current()["segments"][0]["schemas"]).count('"n"') == 2 and store.corpus()[0] == 41
    store.compact()
    assert read() == got


def test_stored_search_shuffles_what_is_asked_only(spark, tmp_path, monkeypatch):
    """Postings are written in several parts; asked terms go to the postings though all buckets are asked; phrases that share words, or repeat one, score as without an index; a commit leaves no shuffle files."""
    monkeypatch.setattr(segments, "PART", 1)
    dirs = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())
    shuffled = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    store, before = Store(spark, str(tmp_path / "i"), buckets=2), shuffled()
    store.commit({"text": chunks(spark).filter("document_id < 'd2'")})
    store.commit({"text": chunks(spark).filter("document_id >= 'd2' OR document_id = 'd1'")}, chunks(spark).filter("document_id = 'd1'").select("document_id"))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    asked = [(1, "the-fox"), (2, "fox-and-the-hen"), (3, "the-fox hen-the"), (4, "the-the"), (5, "fox hen"), (6, "wwww"), (7, "hen-the-fox the"), (8, "hen-fox"), (9, "md a")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    score = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = score(lexical.bm25(queries, chunks(spark)))
    assert score(lexical.bm25_stored(queries, store)) == want and {q for q, _, _ in want} >= {1, 2, 3, 5, 6, 7, 9}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not re.search(r"hashpartitioning\((bucket|term)", plan(store.postings(spark.createDataFrame([("the",), ("fox",), ("hen",), ("and",)], "term string"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_aliases_without_a_limit(spark):
    """A property of each owner leads to the next one: more aliases than a limit lets through, and their types without any chain."""
    names = [(f"k{k}", f"T{k // 2}.m{k % 2}", f"t{k // 2}.m{k % 2}", "property", 1, "exact") for k in range(12)]
    identifiers = spark.createDataFrame(names, "chunk_id string, identifier string, normalized string, identifier_kind string, is_primary int, alias_type string")
    texts = spark.createDataFrame([(f"k{k}", "d", f"m{k % 2}: T{k // 2 + 1}" if k % 2 == 0 else "text") for k in range(12)], "chunk_id string, document_id string, content string")
    given = {"identifiers": identifiers, "edges": spark.createDataFrame([], EDGES), "chunks": texts, "documents": spark.createDataFrame([("d", "api")], "document_id string, kind string")}
    with pytest.raises(ValueError, match="ALIAS_LIMIT"):
        graph.derive_aliases(**given, most=5)
    edges = {(r.from_identifier, r.relation, r.to_identifier) for r in graph.derive_aliases(**given, most=None)[1].collect()}
    types = {(f"T{k}.m0", "property_type", f"T{k + 1}") for k in range(5)}
    assert {(r.from_identifier, r.relation, r.to_identifier) for r in graph.type_edges(**given).collect()} == types
    aliases = {(f"T{a}" + ".m0" * d + f".m{m}", "alias_of", f"T{a + d}.m{m}") for a in range(5) for d in range(1, 5) if a + d <= 5 for m in (0, 1)}
    assert edges == types | aliases and len(aliases) > 5


def test_candidates_go_to_the_texts(spark):
    """A bounded number of rows for each query is sent to the chunks, which are not shuffled for it."""
    queries = spark.range(3).withColumnRenamed("id", "query_id")
    one = chunks(spark).select("chunk_id").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(lexical.bounded(one, queries).join(chunks(spark), "chunk_id"))
        assert "BroadcastHashJoin" not in plan(lexical.bounded(one, spark.range(lexical.FEW)).join(chunks(spark), "chunk_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neighbours_in_pieces(spark):
    """One block of queries against one batch of rows, which has several times the cells that a task holds at once."""
    assert 2000 * 2000 > 3 * vectors.CELLS
    rows = spark.range(2000).selectExpr("id AS vec_id", "array(cast(id % 37 AS double), cast(id % 41 AS double), 1.0D) AS embedding").coalesce(1)
    got = {(r.query_id, r.pos): r.vec_id for r in vectors.knn_cosine(rows, rows.withColumnRenamed("vec_id", "query_id"), 3).collect()}
    v = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(1 - v @ v.T, 9)
    want = {(q, p + 1): int(i) for q in range(2000) for p, i in enumerate(np.lexsort((np.arange(2000), far[q]))[:3])}
    assert sum(got[k] != want[k] for k in want) == 0 and len(got) == len(want)


def test_names_of_a_document_are_counted_without_its_chunks(spark):
    found = registry.QUERIES["agg_distinct_identifiers"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(found) and found.columns == ["document_id", "identifiers"]


def test_names_go_to_the_identifiers(spark):
    """Asked names go to the identifiers and what is found to the chunks; many names give the same by a shuffle."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    names = c.chunks.select(F.lower("identifier").alias("query")).filter("query IS NOT NULL").distinct().orderBy("query").limit(1500).select(F.monotonically_increasing_id().alias("query_id"), "query").cache()
    tables = (c.identifiers, c.chunks, c.documents, c.sources)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = search.exact_hits(names.limit(20), *tables)
        assert not re.search(r"hashpartitioning\(chunk_id", plan(few)) and "BroadcastHashJoin" in plan(few)
        many = search.exact_hits(names.unionByName(spark.range(10_000, 10_000 + lexical.FEW).select(F.col("id").alias("query_id"), F.lit("no such name").alias("query"))), *tables)
        assert not re.search(r"BroadcastHashJoin \[normalized", plan(many))
        key = lambda df: sorted(tuple(r) for r in df.collect())
        own = {r.query_id for r in names.limit(20).collect()}
        assert key(few) == [r for r in key(many.select(few.columns)) if r[0] in own] != []
        assert "BroadcastHashJoin" in plan(lexical.sent(few).join(c.chunks, "chunk_id")) and "BroadcastHashJoin" not in plan(lexical.sent(few, 1).join(c.chunks, "chunk_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_first_words_of_few_queries_go_to_the_identifiers(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(retrieval._candidates(Corpus(spark, "/root/testdata/sf0.001")))
        assert re.search(r"BroadcastHashJoin \[normalized", found) and not re.search(r"SortMergeJoin \[normalized", found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fused_results_go_to_the_texts(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    stored = c.chunks.groupBy("doc_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id")).join(c.table("embeddings"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "chunk_id", "embedding")
    asked = c.queries.join(c.table("embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # the last join by chunk_id is the one with the texts
        found = re.findall(r"(\w+Join) \[chunk_id", plan(lookup.hybrid(c.queries, asked, stored, c.identifiers, c.chunks, c.documents, c.sources)))
        assert found[0] == "BroadcastHashJoin"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_are_compared_in_one_reading(spark):
    """Both versions' evidence comes from one join of identifiers and chunks."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    asked = c.chunks.filter("identifier IS NOT NULL").select(F.lower("identifier").alias("query_id"), "identifier").distinct()
    tables = (c.identifiers, c.chunks, c.documents, c.sources)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = versions.compare(asked, *tables, "api", "1.1.0", "2.2.0")
        assert len(re.findall(r"Join \[chunk_id", plan(found))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # of one version with itself nothing differs, and what has evidence there has it on both sides
    same = {r.status: r["count"] for r in versions.compare(asked, *tables, "api", "1.1.0", "1.1.0").groupBy("status").count().collect()}
    assert set(same) == {"unchanged", "not_found"}


def test_members_are_made_once(spark):
    """What an alias is derived from is computed before its first reading: no later step goes back to the texts."""
    names = spark.createDataFrame([("k0", "T0.m0", "t0.m0", "property", 1, "exact")], "chunk_id string, identifier string, normalized string, identifier_kind string, is_primary int, alias_type string")
    texts = spark.createDataFrame([("k0", "d", "m0: T0")], "chunk_id string, document_id string, content string")
    own, _ = graph._own_types(names, texts, spark.createDataFrame([("d", "api")], "document_id string, kind string"))
    assert "InMemoryTableScan" in plan(own) or "Join" not in plan(own)


def test_ingest_shuffles_no_text_for_small_tables(spark):
    """The registry of sources goes to the files, and chunks keep the path that the parse gave them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("s", "a/b.md", "# One\n\nWorld text\n\n# Two\n\nmore")], "source_id string, path string, content string")
        made = ingest.ingest(files, spark.createDataFrame([("s", "stable")], "source_id string, channel string"))
        assert not re.search(r"SortMergeJoin \[source_id", plan(made["documents"]))
        text = ingest.with_text_fields(made["chunks"], made["documents"], made["identifiers"])
        assert not re.search(r"Join \[document_id", plan(text)) and {r.path for r in text.collect()} == {"a/b.md"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_that_meet_no_other_are_left_out(spark):
    """Of many unlike sets hardly one is dealt out whole; a near duplicate stays even if all that it lacks lies in the part that is looked at."""
    rng = np.random.default_rng(5)
    shared, own = [4 * i + 1 for i in range(90)], [4 * i for i in range(11)]
    rows = [(1, shared + own[:10]), (2, shared), (3, [v + 20_000 for v in own] + [v + 10_000 for v in shared]), (4, [v + 10_000 for v in shared])]
    rows += [(100 + i, [int(v) for v in rng.choice(1 << 40, 100)]) for i in range(200)]
    got = duplicates.met(spark.createDataFrame([(i, [v - 5000 for v in s]) for i, s in rows], "set long, s array<long>"))
    left = {r["set"] for r in got.collect()}
    # the third has eleven of 101 values alone, those of the part only
    assert {1, 2, 4} <= left and 3 not in left and len(left) < 13

    seen = []
    texts = [(i, " ".join(f"w{v}" for v in rng.choice(1 << 40, 60))) for i in range(50)]
    texts += [(50 + i, texts[0][1] + " tail" * i) for i in (1, 2)]
    ask = lambda df: seen.append(df) or df.persist()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(duplicates, "kept", ask)
        found = {r.doc_id: r.class_id for r in duplicates.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {i: i for i in range(50)} | {51: 0, 52: 0}
    assert max(df.count() for df in seen if {"node", "s"} <= set(df.columns) and "text" not in df.columns) <= 10
