"""Queries of the maintenance operators; their SQL says what comes out in another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graph, maintenance
from tessella.schema import SCHEMA_VERSION
from tessella.sources import files

from .corpus import Corpus, duck
from .relational import STATEMENTS


def _c(f):
    return lambda spark, sf_dir: f(Corpus(spark, sf_dir))


def _mentions(chunks):
    """Edges read in chunks: the name of each, and the source that it is of; many chunks give the same one."""
    return chunks.filter("identifier IS NOT NULL").select(F.col("identifier").alias("from_identifier"), F.lit("mentions").alias("relation"), F.col("source_id").alias("to_identifier"), "chunk_id")


def _tables(c: Corpus) -> dict:
    edges = c.edges.withColumn("chunk_id", F.lit(None).cast("string")).unionByName(_mentions(c.chunks))
    return {"sources": c.sources, "documents": c.documents, "chunks": c.chunks, "identifiers": c.identifiers, "edges": edges}


def _by_edge(edges):
    return edges.groupBy("from_identifier", "relation", "to_identifier").agg(F.count("*").alias("n"))


#: The edges of chunks of some documents, and those that no chunk gives.
_EDGES = "SELECT from_identifier, relation, to_identifier, count(*) AS n FROM (SELECT identifier AS from_identifier, 'mentions' AS relation, source_id AS to_identifier FROM c_chunks WHERE identifier IS NOT NULL AND {} UNION ALL SELECT * FROM c_edges) GROUP BY ALL"


def _old(c: Corpus) -> dict:
    """The index before the update: an eleventh of the documents is new since."""
    gone = c.documents.filter("doc_id % 11 = 3").select("document_id")
    return maintenance.removed(_tables(c), gone)


def _found(c: Corpus):
    """What the scan of the update finds: an eleventh of the documents is gone, a ninth has another text."""
    return c.documents.filter("doc_id % 11 <> 7").withColumn("content_hash", F.when(F.col("doc_id") % 9 == 0, "new").otherwise(F.col("content_hash")))


def _update(c: Corpus, derive: bool = False):
    def parse(changed):
        ids = changed.select("document_id")
        chunks = c.chunks.join(ids, "document_id", "left_semi").withColumn("lifecycle", F.lit("parsed"))
        return {"chunks": chunks, "identifiers": kinds(c.identifiers.join(ids, "document_id", "left_semi")), "edges": _mentions(chunks)}

    def kinds(identifiers):
        return identifiers.withColumn("identifier_kind", F.lit("unknown")) if derive else identifiers

    old = _old(c)
    return maintenance.update({**old, "identifiers": kinds(old["identifiers"])}, c.sources, _found(c), parse)


def _api_names(c: Corpus) -> dict:
    """Members of a small API, one chunk each, to derive aliases over: owners T0, T1, ..., a property of each leads to the next by its signature, one to the last but one by a mention, one nowhere."""
    n = c.table("part").select(F.col("p_partkey").alias("k"))
    chunk = F.concat(F.lit("k"), F.col("k").cast("string"))
    owner = F.concat(F.lit("T"), F.floor(F.col("k") / 4).cast("string"))
    member = F.concat(owner, F.lit(".m"), (F.col("k") % 4).cast("string"))
    leads = F.when(F.col("k") % 4 == 0, F.concat(F.lit("T"), (F.floor(F.col("k") / 4) + 1).cast("string"))).when(F.col("k") % 4 == 1, F.concat(F.lit("T"), (F.floor(F.col("k") / 4) - 2).cast("string"))).otherwise("Nowhere")
    names = n.select(chunk.alias("chunk_id"), member.alias("identifier"), F.lower(member).alias("normalized"), F.when(F.col("k") % 4 < 3, "property").otherwise("method").alias("identifier_kind"), F.lit(1).alias("is_primary"), F.lit("exact").alias("alias_type"))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("m"), (F.col("k") % 4).cast("string"), F.lit(": "), leads)).otherwise("text")
    mentions = n.filter("k % 2 = 1").select(chunk.alias("chunk_id"), leads.alias("identifier"), F.lower(leads).alias("normalized"), F.lit("unknown").alias("identifier_kind"), F.lit(0).alias("is_primary"), F.lit("exact").alias("alias_type"))
    edges = c.spark.createDataFrame([], "from_identifier string, relation string, to_identifier string, chunk_id string")
    return {"identifiers": names.unionByName(mentions), "chunks": n.select(chunk.alias("chunk_id"), F.lit("d").alias("document_id"), text.alias("content")), "documents": c.spark.createDataFrame([("d", "api")], "document_id string, kind string"), "edges": edges}


def _derived(c: Corpus):
    t = _api_names(c)
    return graph.derive_aliases(t["identifiers"], t["edges"], t["chunks"], t["documents"], most=None)


def _replaced(c: Corpus) -> dict:
    ids = c.documents.filter("doc_id % 50 = 0").select("document_id")
    fresh = F.concat(F.lit("new_"), "document_id").alias("chunk_id")
    return maintenance.replaced(_tables(c), {"documents": c.documents.filter("doc_id % 50 = 0"), "chunks": ids.select("document_id", fresh), "identifiers": ids.select("document_id", fresh, F.lit("n").alias("identifier"))})


def _registry(c: Corpus):
    return c.sources.select(F.col("source_id").alias("id"), "tier", "channel", F.lit("main").alias("branch"), (F.col("tier") != 4).alias("defaultEnabled"))


def _empty(c: Corpus):
    rows = []
    for name, documents in (("full", c.documents), ("some", c.documents.filter("source_id <> 'src0'"))):
        try:
            maintenance.require_documents(c.sources, documents)
            rows.append((name, "ok"))
        except ValueError as e:
            rows.append((name, str(e).split(":")[0]))
    return c.spark.createDataFrame(rows, "documents string, outcome string")


_API = """n AS (SELECT p_partkey AS k, p_partkey // 4 AS o, p_partkey % 4 AS m, p_partkey // 4 + CASE p_partkey % 4 WHEN 0 THEN 1 ELSE -2 END AS t FROM part), ow AS (SELECT DISTINCT o FROM n),
pt AS (SELECT k, 'T' || o || '.m' || m AS property, t FROM n WHERE m < 2 AND t IN (SELECT o FROM ow)),
l AS (SELECT property AS prefix, t, 1 AS depth, CAST(NULL AS VARCHAR) AS member, CAST(NULL AS BIGINT) AS k FROM pt
 UNION ALL SELECT l.prefix || '.m' || n.m, pt.t, l.depth + 1, 'T' || n.o || '.m' || n.m, n.k FROM l JOIN n ON n.o = l.t LEFT JOIN pt ON pt.k = n.k WHERE l.depth <= 4 AND l.t IS NOT NULL),
al AS (SELECT DISTINCT prefix AS alias, member, k FROM l WHERE member IS NOT NULL AND lower(prefix) <> lower(member))"""

PAIRS = {
    "source_unchanged_skip": (
        _c(lambda c: maintenance.unchanged_sources(c.sources.withColumn("input", F.lit("a")), c.sources.select("source_id", F.when(F.col("tier") == 2, "old").otherwise(F.col("revision")).alias("revision"), F.when(F.col("tier") < 3, "a").alias("input")))),
        duck("SELECT source_id FROM c_sources WHERE tier = 1"),
    ),
    "diff_documents": (_c(lambda c: maintenance.compared(_old(c)["documents"], _found(c)).filter("status <> 'unchanged'").select("path", "status")), duck("SELECT path, CASE WHEN doc_id % 11 = 3 THEN 'added' WHEN doc_id % 11 = 7 THEN 'deleted' ELSE 'modified' END AS status FROM c_documents WHERE doc_id % 11 IN (3, 7) OR doc_id % 9 = 0")),
    "agg_incremental_counters": (
        _c(lambda c: _update(c)[1]),
        duck("SELECT count(*) FILTER (doc_id % 11 = 3) AS added, count(*) FILTER (doc_id % 11 NOT IN (3, 7) AND doc_id % 9 = 0) AS modified, count(*) FILTER (doc_id % 11 = 7) AS deleted, count(*) FILTER (doc_id % 11 NOT IN (3, 7) AND doc_id % 9 <> 0) AS unchanged, (SELECT count(*) FROM c_chunks WHERE doc_id % 11 <> 7 AND (doc_id % 11 = 3 OR doc_id % 9 = 0)) AS chunks_changed FROM c_documents"),
    ),
    "update_incremental": (
        _c(lambda c: _update(c)[0]["chunks"].select("document_id", "chunk_id", F.when(F.col("lifecycle") == "parsed", "parsed").otherwise("kept").alias("origin"))),
        duck("SELECT document_id, chunk_id, CASE WHEN doc_id % 11 = 3 OR doc_id % 9 = 0 THEN 'parsed' ELSE 'kept' END AS origin FROM c_chunks WHERE doc_id % 11 <> 7"),
    ),
    "update_edges": (_c(lambda c: _by_edge(_update(c)[0]["edges"])), duck(_EDGES.format("doc_id % 11 <> 7"))),
    "update_identifiers": (
        _c(lambda c: _update(c, derive=True)[0]["identifiers"].select("chunk_id", "normalized", "is_primary")),
        duck("SELECT i.chunk_id, i.normalized, i.is_primary FROM c_identifiers i JOIN c_documents d USING (document_id) WHERE d.doc_id % 11 <> 7 AND i.alias_type <> 'derived-chain'"),
    ),
    "removed_edges": (_c(lambda c: _by_edge(maintenance.removed(_tables(c), c.documents.filter("doc_id % 10 = 1").select("document_id"))["edges"])), duck(_EDGES.format("doc_id % 10 <> 1"))),
    "stale_edges": (
        _c(lambda c: maintenance.validate({"chunks": c.chunks.filter("doc_id % 10 <> 1"), "edges": _tables(c)["edges"]}).select("ok", F.explode("errors").alias("error"))),
        duck("SELECT false AS ok, 'orphan_edges: ' || count(*) AS error FROM c_chunks WHERE identifier IS NOT NULL AND doc_id % 10 = 1"),
    ),
    "refresh_provenance": (_c(lambda c: _update(c)[0]["documents"].select("document_id", "content_hash", "api_version")), duck("SELECT document_id, CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE content_hash END AS content_hash, api_version FROM c_documents WHERE doc_id % 11 <> 7")),
    "sink_upsert_source": (_c(lambda c: maintenance.upsert(c.sources.select("source_id", "name"), c.sources.filter("tier = 1").select("source_id", F.lit("renamed").alias("name")), ["source_id"])), duck(STATEMENTS["sink_upsert_source"])),
    "sink_replace_document": (_c(lambda c: _replaced(c)["chunks"].select("document_id", "chunk_id")), duck(STATEMENTS["sink_replace_document"])),
    "sink_replace_identifiers": (_c(lambda c: _replaced(c)["identifiers"].groupBy("document_id").agg(F.count("*").alias("n"))), duck("SELECT i.document_id, CASE WHEN d.doc_id % 50 = 0 THEN 1 ELSE count(*) END AS n FROM c_identifiers i JOIN c_documents d ON d.document_id = i.document_id GROUP BY i.document_id, d.doc_id UNION ALL SELECT document_id, 1 FROM c_documents d WHERE doc_id % 50 = 0 AND NOT EXISTS (SELECT 1 FROM c_identifiers i WHERE i.document_id = d.document_id)")),
    "sink_remove_document": (_c(lambda c: maintenance.removed(_tables(c), c.documents.filter("doc_id % 10 = 1").select("document_id"))["chunks"].select("chunk_id")), duck(STATEMENTS["sink_remove_document"])),
    "sink_clear": (_c(lambda c: maintenance.cleared(c.sources.select(F.concat(F.lit("source_input:"), "source_id").alias("k"), F.col("revision").alias("v")).unionByName(c.spark.createDataFrame([("schema_version", "1")], "k string, v string")))), duck(STATEMENTS["sink_clear"])),
    "input_identity_store": (
        _c(lambda c: maintenance.noted(c.sources.select(F.concat(F.lit("source_input:"), "source_id").alias("k"), F.lit("a").alias("v")), c.sources.filter("tier = 1").select(F.concat(F.lit("source_input:"), "source_id").alias("k"), F.col("revision").alias("v")), c.sources.filter("tier = 4").select(F.concat(F.lit("source_input:"), "source_id").alias("k")))),
        duck("SELECT 'source_input:' || source_id AS k, CASE WHEN tier = 1 THEN revision ELSE 'a' END AS v FROM c_sources WHERE tier <> 4"),
    ),
    "empty_source_guard": (_c(_empty), "SELECT 'full' AS documents, 'ok' AS outcome UNION ALL SELECT 'some', 'SOURCE_EMPTY'"),
    "revision_log": (
        _c(lambda c: maintenance.logged(c.spark.createDataFrame([("src0", 3, "completed", None, 7)], "source_id string, documents_changed long, status string, finished_at timestamp, run int"), _update(c)[2], "completed", F.lit("2024-01-01").cast("timestamp")).select("source_id", "documents_changed", "status", "run")),
        duck("SELECT 'src0' AS source_id, 3 AS documents_changed, 'completed' AS status, 7 AS run UNION ALL SELECT source_id, count(*), 'completed', 8 FROM c_documents WHERE doc_id % 11 IN (3, 7) OR doc_id % 9 = 0 GROUP BY source_id"),
    ),
    "validate_index": (
        _c(lambda c: maintenance.validate(_tables(c) | {"documents": c.documents.filter("doc_id % 25 <> 4")}, c.chunks.filter("doc_id % 20 <> 5").select("chunk_id")).select("ok", F.explode("counts").alias("name", "n"))),
        duck(
            "WITH ch AS (SELECT chunk_id, doc_id, identifier FROM c_chunks) SELECT false AS ok, * FROM (SELECT 'sources' AS name, count(*) AS n FROM c_sources UNION ALL SELECT 'documents', count(*) FROM c_documents WHERE doc_id % 25 <> 4 UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'identifiers', count(*) FROM c_identifiers UNION ALL SELECT 'orphan_documents', 0 UNION ALL SELECT 'orphan_chunks', count(*) FROM ch WHERE doc_id % 25 = 4 "
            "UNION ALL SELECT 'orphan_edges', 0 UNION ALL SELECT 'edges', (SELECT count(*) FROM c_edges) + (SELECT count(*) FROM ch WHERE identifier IS NOT NULL) UNION ALL SELECT 'orphan_identifiers', 0 UNION ALL SELECT 'repeated_sources', 0 UNION ALL SELECT 'repeated_documents', 0 UNION ALL SELECT 'repeated_chunks', 0 UNION ALL SELECT 'indexed', count(*) FROM ch WHERE doc_id % 20 <> 5 UNION ALL SELECT 'missing_in_index', count(*) FROM ch WHERE doc_id % 20 = 5 UNION ALL SELECT 'orphans_in_index', 0)"
        ),
    ),
    "status_report": (
        _c(lambda c: maintenance.status(_tables(c))),
        duck(
            "SELECT s.source_id, s.name, s.tier, s.channel, s.revision, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS chunks, coalesce(i.n, 0) AS identifiers, coalesce(round(100.0::DOUBLE * q.n / c.n, 2), 0) AS duplicate_percent, coalesce(d.n, 0) > 0 AND coalesce(c.n, 0) > 0 AS ready FROM c_sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM c_documents GROUP BY 1) d USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM c_chunks GROUP BY 1) c USING (source_id) "
            "LEFT JOIN (SELECT source_id, count(*) AS n FROM c_identifiers JOIN c_chunks USING (chunk_id) GROUP BY 1) i USING (source_id) LEFT JOIN (SELECT x.source_id, count(*) AS n FROM c_chunks x JOIN c_sources t ON t.source_id = x.source_id WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT y.content_hash, y.source_id, u.tier FROM c_chunks y JOIN c_sources u ON u.source_id = y.source_id) o WHERE o.content_hash = x.content_hash AND o.source_id <> x.source_id AND o.tier <= t.tier) GROUP BY 1) q USING (source_id)"
        ),
    ),
    "list_sources": (
        _c(lambda c: maintenance.status(_tables(c)).select("source_id", "name", "tier", "documents", "chunks", "duplicate_percent", F.col("ready").alias("healthy"))),
        duck(
            "SELECT s.source_id, s.name, s.tier, (SELECT count(*) FROM c_documents d WHERE d.source_id = s.source_id) AS documents, coalesce(c.n, 0) AS chunks, coalesce(round(100.0::DOUBLE * c.twice / c.n, 2), 0) AS duplicate_percent, coalesce(c.n, 0) > 0 AS healthy FROM c_sources s LEFT JOIN (SELECT x.source_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM (SELECT DISTINCT y.content_hash, y.source_id, u.tier FROM c_chunks y JOIN c_sources u ON u.source_id = y.source_id) o WHERE o.content_hash = x.content_hash AND o.source_id <> x.source_id AND o.tier <= t.tier)) AS twice FROM c_chunks x JOIN c_sources t ON t.source_id = x.source_id GROUP BY 1) c USING (source_id)"
        ),
    ),
    "backup_prune": (
        _c(lambda c: maintenance.prunable(c.table("events").select(X.iso_compact(F.col("ts").cast("timestamp")).alias("name")).unionByName(c.sources.select(F.col("name"))), 7)),
        "SELECT name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS r FROM (SELECT DISTINCT strftime(ts, '%Y%m%dT%H%M%SZ') AS name FROM events)) WHERE r > 7",
    ),
    "schema_gate": (
        _c(lambda c: c.table("events").select("event_id", maintenance.action((F.col("event_id") % 4).cast("int"), SCHEMA_VERSION).alias("action"))),
        f"SELECT event_id, CASE WHEN event_id % 4 = {SCHEMA_VERSION} THEN 'open' WHEN event_id % 4 > {SCHEMA_VERSION} THEN 'refuse' ELSE 'migrate' END AS action FROM events",
    ),
    "concurrency_permits": (
        _c(lambda c: maintenance.permits(c.table("events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 10 HOURS")).alias("end")), 2).select("client", "request_id", "active", "accepted")),
        "SELECT a.user_id AS client, a.event_id AS request_id, count(*) AS active, count(*) <= 2 AS accepted FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts < a.ts AND b.ts + INTERVAL 10 HOURS > a.ts OR b.ts = a.ts AND b.event_id <= a.event_id) GROUP BY ALL",
    ),
    "registry_select": (_c(lambda c: files.select_registry(_registry(c), False).select(F.col("id").alias("source_id"))), duck(STATEMENTS["registry_select"])),
    "registry_load": (_c(lambda c: files.bad_entries(_registry(c).unionByName(_registry(c).filter("tier = 4"))).select("id", "reason")), duck("SELECT source_id AS id, 'repeated' AS reason FROM c_sources WHERE tier = 4 UNION ALL SELECT source_id, 'bad' FROM c_sources WHERE channel = 'unknown' UNION ALL SELECT source_id, 'bad' FROM c_sources WHERE channel = 'unknown' AND tier = 4")),
    "npm_sync": (
        _c(lambda c: files.synced(c.documents.select(F.col("document_id").alias("name"), F.col("text").alias("document")), c.documents.filter("doc_id % 10 <> 3").select(F.col("document_id").alias("name"), F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("text")).alias("document")))),
        duck("SELECT document_id AS name, CASE WHEN doc_id % 10 = 3 THEN 'created' WHEN doc_id % 9 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM c_documents"),
    ),
    "derive_property_types": (_c(lambda c: graph.type_edges(**_api_names(c)).select("from_identifier", "to_identifier")), f"WITH RECURSIVE {_API} SELECT property AS from_identifier, 'T' || t AS to_identifier FROM pt"),
    "alias_edges": (_c(lambda c: _derived(c)[1].filter("relation = 'alias_of'").select("from_identifier", "to_identifier")), f"WITH RECURSIVE {_API} SELECT alias AS from_identifier, member AS to_identifier FROM al"),
    "reset_derived": (_c(lambda c: graph.reset_derived(c.identifiers, c.edges.withColumn("chunk_id", F.lit("x")))[0].select("chunk_id", "normalized")), duck("SELECT chunk_id, normalized FROM c_identifiers WHERE alias_type <> 'derived-chain'")),
}
