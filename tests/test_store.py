"""The index by segments: rebuild, changes, cascade of edges, a stream that is broken off, the stored text index."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, lexical, maintenance
from tessella.sources import build, ingest
from tessella.sources.segments import Store
from tessella.streaming import refresh

FILES = "source_id string, path string, content string"


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("docs", "stable", 1), ("api", "stable", 1)], "source_id string, channel string, tier int")


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


FIRST = [
    ("docs", "a.md", "# Alpha\nfirst text of alpha\n## Part\nmore words here"),
    ("docs", "b.md", "# Beta\nthe quick brown fox\n"),
    ("docs", "c.txt", "plain words the quick fox"),
    ("api", "bad.json", "{"),
]
LAST = [("docs", "a.md", "# Alpha\nother text\n"), ("docs", "c.txt", "plain words the quick fox"), ("docs", "d.md", "# Delta\nquick quick fox\n"), ("api", "bad.json", "{")]
CHANGED = [("docs", "a.md", LAST[0][2]), ("docs", "b.md", None), ("docs", "c.txt", LAST[1][2]), ("docs", "d.md", LAST[2][2])]


def rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or sorted(df.columns))).collect()))


def same(a, b):
    for name in ("documents", "chunks", "identifiers", "edges"):
        columns = sorted(set(a[name].columns) & set(b[name].columns))
        assert rows(a[name], *columns) == rows(b[name], *columns), name


def test_changes_give_what_a_rebuild_gives(spark, sources, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    build.rebuild(spark, one, files(spark, FIRST), sources)
    counts = build.apply(spark, one, files(spark, CHANGED), sources)
    assert counts == {"parsed": 2, "gone": 2, "touched": 0}
    same(Store(spark, one).tables(), build.rebuild(spark, two, files(spark, LAST), sources))
    assert Store(spark, one).corpus() == Store(spark, two).corpus()
    # only the segment of the change has been written
    segments = Store(spark, one).current()["segments"]
    assert len(segments) == 2 and segments[1]["gone"]
    assert spark.read.parquet(f"{one}/{segments[1]['name']}/documents").count() == 2
    before = Store(spark, one).tables()
    want = {n: rows(t) for n, t in before.items()}
    Store(spark, one).compact()
    assert {n: rows(t) for n, t in Store(spark, one).tables().items()} == want
    assert len(Store(spark, one).sweep()) == 2 and len(Store(spark, one).current()["segments"]) == 1
    assert build.apply(spark, one, files(spark, CHANGED), sources) == {"parsed": 0, "gone": 0, "touched": 0}
    assert {n: rows(t) for n, t in Store(spark, one).tables().items()} == want


def test_a_failed_run_changes_nothing(spark, sources, tmp_path):
    root = f"{tmp_path}/x"
    build.rebuild(spark, root, files(spark, FIRST), sources)
    want, listed = {n: rows(t) for n, t in Store(spark, root).tables().items()}, sorted(os.listdir(root))
    with pytest.raises(ValueError, match="SOURCE_EMPTY"):
        build.rebuild(spark, root, files(spark, FIRST[:3]), sources)
    with pytest.raises(ValueError, match="INDEX_INVALID"):
        build.apply(spark, root, files(spark, CHANGED), sources.filter("source_id = 'api'").unionByName(sources.filter("false")).unionByName(spark.createDataFrame([("docs", "stable", 1)], sources.schema).withColumn("source_id", F.lit("docs"))).unionByName(sources.filter("source_id = 'api'")))
    assert {n: rows(t) for n, t in Store(spark, root).tables().items()} == want and sorted(os.listdir(root)) == listed


def test_aliases_follow_documents_of_other_batches(spark, tmp_path):
    """A type that a later batch brings gives aliases to a member of an earlier one; when it goes they go."""
    sources = spark.createDataFrame([("api", "stable", 1)], "source_id string, channel string, tier int")
    page = lambda owner, member, kind: f"# {owner}\n## Properties\n### **{member}**\n`{member}: {kind}`\n"
    world = ("api", "docs/ScriptAPI/server/World.md", page("World", "afterEvents", "WorldAfterEvents"))
    events = ("api", "docs/ScriptAPI/server/WorldAfterEvents.md", page("WorldAfterEvents", "playerSpawn", "PlayerSpawn"))
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    build.rebuild(spark, one, files(spark, [world]), sources)
    build.apply(spark, one, files(spark, [events]), sources)
    same(Store(spark, one).tables(), build.rebuild(spark, two, files(spark, [world, events]), sources))
    build.apply(spark, one, files(spark, [(*events[:2], None)]), sources)
    same(Store(spark, one).tables(), build.rebuild(spark, two, files(spark, [world]), sources))


def test_edges_go_with_their_chunks(spark):
    documents = spark.createDataFrame([("a", "s"), ("b", "s")], "document_id string, source_id string")
    chunks = spark.createDataFrame([("c1", "a"), ("c2", "b")], "chunk_id string, document_id string")
    edges = spark.createDataFrame([("X", "uses", "Y", "c1"), ("X", "uses", "Y", "c2"), ("X", "uses", "Z", "c2"), ("P", "part_of", "Q", None)], "from_identifier string, relation string, to_identifier string, chunk_id string")
    identifiers = chunks.select("chunk_id", F.lit("X").alias("identifier"))
    tables = {"sources": spark.createDataFrame([("s",)], "source_id string"), "documents": documents, "chunks": chunks, "identifiers": identifiers, "edges": edges}
    left = maintenance.removed(tables, spark.createDataFrame([("b",)], "document_id string"))
    assert rows(left["edges"], "to_identifier", "chunk_id") == rows(edges.filter("chunk_id = 'c1' OR chunk_id IS NULL"), "to_identifier", "chunk_id")
    assert left["identifiers"].count() == 1 and maintenance.validate(left).first().ok
    start = spark.createDataFrame([(1, "X")], "query_id long, node string")
    assert [r.to_identifier for r in graph.traverse(left["edges"].select("from_identifier", "relation", "to_identifier"), start).collect()] == ["Y"]
    stale = maintenance.validate({**left, "edges": edges}).first()
    assert not stale.ok and stale.errors == ["orphan_edges: 2"]
    replaced = maintenance.replaced(tables, {"documents": documents.filter("document_id = 'b'"), "chunks": spark.createDataFrame([("c3", "b")], chunks.schema)})
    assert replaced["edges"].filter("chunk_id = 'c2'").count() == 0 and replaced["chunks"].filter("chunk_id = 'c3'").count() == 1
    gone = maintenance.removed(left, spark.createDataFrame([("a",)], "document_id string"))
    assert [r.to_identifier for r in gone["edges"].collect()] == ["Q"]


def drop(spark, folder, changes, at):
    spark.createDataFrame([(*c, at) for c in changes], refresh.CHANGES).coalesce(1).write.mode("append").parquet(folder)


def test_a_broken_stream_gives_the_rows_of_one_run(spark, sources, tmp_path, monkeypatch):
    incoming, plain = f"{tmp_path}/in", f"{tmp_path}/plain"
    drop(spark, incoming, FIRST, 1)
    drop(spark, incoming, CHANGED, 2)

    def run(root, state):
        refresh.refresh(spark, incoming, root, state, sources, files_per_batch=1).awaitTermination()

    run(plain, f"{tmp_path}/state0")
    want = {n: rows(t) for n, t in Store(spark, plain).tables().items()}
    assert Store(spark, plain).current()["streams"] == {"refresh": 1} and len(Store(spark, plain).current()["segments"]) == 2

    # stopped between writing and publishing, in the second batch
    broken, state, calls = f"{tmp_path}/broken", f"{tmp_path}/state1", []
    write = Store.commit

    def fails(self, *args, **given):
        calls.append(1)
        if len(calls) == 2:
            monkeypatch.setattr(self.folder, "write", lambda *x: (_ for _ in ()).throw(OSError("lost")))
            monkeypatch.setattr(self.folder, "drop", lambda *x: None)  # nobody is left to clean up
        return write(self, *args, **given)

    monkeypatch.setattr(Store, "commit", fails)
    with pytest.raises(Exception, match="lost"):
        run(broken, state)
    monkeypatch.undo()
    assert Store(spark, broken).current()["streams"] == {"refresh": 0}
    run(broken, state)
    assert {n: rows(t) for n, t in Store(spark, broken).tables().items()} == want
    assert len(Store(spark, broken).sweep()) >= 1

    # stopped between publishing and the stream's own note of it: the batch runs again and changes nothing
    commits = f"{state}/commits"
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    before = Store(spark, broken).current()
    run(broken, state)
    assert Store(spark, broken).current() == before
    assert {n: rows(t) for n, t in Store(spark, broken).tables().items()} == want


def test_stored_text_index_scores_like_the_texts(spark, sources, tmp_path):
    root = f"{tmp_path}/i"
    build.rebuild(spark, root, files(spark, FIRST), sources)
    build.apply(spark, root, files(spark, CHANGED), sources)
    store = Store(spark, root)
    queries = spark.createDataFrame(enumerate(["quick", "quick-fox", "the quick", "words plain", "nothing-here", "Alpha", "d.md", "quick quick", "the-quick-fox", ""]), "query_id long, query string")
    t = store.tables()
    text = ingest.with_text_fields(t["chunks"], t["documents"], t["identifiers"])
    score = lambda df: {(r.query_id, r.chunk_id): round(r.score, 9) for r in df.collect()}
    got = score(lexical.bm25_stored(queries, store))
    assert got and got == score(lexical.bm25(queries, text))
    store.compact()
    assert score(lexical.bm25_stored(queries, store)) == got


def test_a_search_reads_the_buckets_of_its_words(spark, sources, tmp_path):
    root = f"{tmp_path}/b"
    build.rebuild(spark, root, files(spark, FIRST), sources)
    store = Store(spark, root)
    found = store.postings(spark.createDataFrame([("quick",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.term for r in found.select("term").collect()} == {"quick"} and all(json.loads(json.dumps(list(r.places))) for r in found.collect())
