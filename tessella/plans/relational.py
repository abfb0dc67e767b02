"""Relational operators declared in SQL over the corpus relations.

The text is the plan: Catalyst prunes columns, pushes filters and picks the
joins.  Statements that both engines read alike are written once.  Rewrites done
by hand: correlated EXISTS as semi joins, scalar counts as grouped aggregates,
an OR of two equalities as the union of two equi-joins, DISTINCT counts over
fan-out joins as counts of pre-aggregated rows.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .corpus import Corpus, duck

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIFECYCLE_RANK = "CASE {}.lifecycle WHEN 'active' THEN 0 WHEN 'deprecated' THEN 1 WHEN 'historical' THEN 2 ELSE 3 END"
STABILITY_RANK = "CASE {}.stability WHEN 'stable' THEN 0 WHEN 'beta' THEN 1 WHEN 'experimental' THEN 2 ELSE 3 END"
CHANNEL_RANK = "CASE {}.channel WHEN 'stable' THEN 0 WHEN 'preview' THEN 1 ELSE 2 END"
EXACT_ORDER = f"{LIFECYCLE_RANK.format('c')}, {STABILITY_RANK.format('c')}, {CHANNEL_RANK.format('d')}, s.tier, i.is_primary DESC, CASE i.alias_type WHEN 'exact' THEN 0 ELSE 1 END, c.ordinal, c.chunk_id"
JOINED = "c_identifiers i JOIN c_chunks c ON c.chunk_id = i.chunk_id JOIN c_documents d ON d.document_id = c.document_id JOIN c_sources s ON s.source_id = d.source_id"
#: Batch exact lookup: the query's words are the identifiers asked for.
ASKED = "(SELECT query_id, split_part(query, ' ', 1) AS normalized FROM c_queries)"
#: A name is ranked once, however many queries ask for it; the first 200 places are all that is ever used.
EXACT = f"SELECT a.query_id, x.chunk_id, x.document_id, x.ordinal, x.pos FROM (SELECT i.normalized, c.chunk_id, d.document_id, c.ordinal, row_number() OVER (PARTITION BY i.normalized ORDER BY {EXACT_ORDER}) AS pos FROM {JOINED} WHERE i.normalized IN (SELECT normalized FROM {ASKED} w)) x JOIN {ASKED} a ON a.normalized = x.normalized WHERE x.pos <= 200"
DIFF = "(SELECT source_id, path, content_hash FROM c_documents WHERE doc_id % 10 <> 3) o FULL OUTER JOIN (SELECT source_id, path, CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM c_documents WHERE doc_id % 10 <> 7) n ON o.source_id = n.source_id AND o.path = n.path"
STATUS = "CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'modified' END"
SNAP = "SELECT p_partkey, actual, {r} AS side FROM c_versions"

STATEMENTS: dict[str, str] = {
    # joins
    "join_ident_chunk_doc_source": f"SELECT i.normalized, i.is_primary, c.chunk_id, d.path, s.tier FROM {JOINED} WHERE i.is_primary = 1",
    "join_chunk_doc_source": "SELECT c.chunk_id, c.title, d.path, s.name FROM c_chunks c JOIN c_documents d ON d.document_id = c.document_id JOIN c_sources s ON s.source_id = d.source_id",
    "left_join_edges_provenance": "SELECT e.from_identifier, e.relation, e.to_identifier, c.chunk_id, d.path, s.name FROM (SELECT from_identifier, relation, to_identifier, CAST(replace(from_identifier, 'Supplier.', '') AS BIGINT) AS place FROM c_edges WHERE relation = 'ships_from' UNION ALL SELECT from_identifier, relation, to_identifier, CAST(NULL AS BIGINT) AS place FROM c_edges WHERE relation <> 'ships_from') e LEFT JOIN (SELECT chunk_id, document_id, doc_id FROM c_chunks WHERE ordinal = 0) c ON c.doc_id = e.place LEFT JOIN c_documents d ON d.document_id = c.document_id LEFT JOIN c_sources s ON s.source_id = d.source_id",
    "left_join_sources_docs_chunks": "SELECT s.source_id, d.document_id, c.chunk_id FROM c_sources s LEFT JOIN c_documents d ON d.source_id = s.source_id AND d.kind = 'api' LEFT JOIN c_chunks c ON c.document_id = d.document_id",
    "left_join_docs_chunks": "SELECT d.document_id, count(c.chunk_id) AS chunks FROM c_documents d LEFT JOIN c_chunks c ON c.document_id = d.document_id GROUP BY d.document_id",
    "semi_join_duplicate": "SELECT c.chunk_id FROM (SELECT x.chunk_id, x.content_hash, x.source_id, s.tier FROM c_chunks x JOIN c_sources s ON s.source_id = x.source_id) c WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT x.content_hash, x.source_id, s.tier FROM c_chunks x JOIN c_sources s ON s.source_id = x.source_id) o WHERE o.content_hash = c.content_hash AND o.source_id <> c.source_id AND o.tier <= c.tier)",
    "anti_join_missing_fts": "SELECT c.chunk_id FROM c_chunks c WHERE NOT EXISTS (SELECT 1 FROM c_chunks f WHERE f.doc_id % 20 <> 5 AND f.chunk_id = c.chunk_id)",
    "anti_join_orphan_fts": "SELECT f.chunk_id FROM c_chunks f WHERE NOT EXISTS (SELECT 1 FROM c_chunks c WHERE c.doc_id % 25 <> 4 AND f.chunk_id = c.chunk_id)",
    "fk_check": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')",
    "join_vector_chunk": "SELECT e.vec_id, e.label, d.document_id FROM embeddings e JOIN c_documents d ON d.doc_id = e.vec_id",
    "join_reuse_vectors": "SELECT n.chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'embed' ELSE 'reuse' END AS action FROM c_chunks n LEFT JOIN (SELECT DISTINCT chunk_id, content_hash FROM c_chunks WHERE doc_id % 3 = 0) o ON o.chunk_id = n.chunk_id AND o.content_hash = n.content_hash",
    "join_incremental_diff": f"SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.path, n.path) AS path, {STATUS} AS status FROM {DIFF}",
    "anti_join_unselected_sources": "SELECT d.document_id FROM c_documents d WHERE NOT EXISTS (SELECT 1 FROM c_sources s WHERE s.channel <> 'preview' AND s.source_id = d.source_id)",
    "hash_join_alias_members": "SELECT a.from_identifier AS alias, b.to_identifier AS member FROM c_edges a JOIN c_edges b ON a.to_identifier = b.from_identifier",
    "join_identifiers_docs_api": "SELECT i.identifier, i.is_primary, c.chunk_id FROM c_identifiers i JOIN c_chunks c ON c.chunk_id = i.chunk_id JOIN c_documents d ON d.document_id = c.document_id WHERE d.kind = 'api'",
    "join_theta_in_or": "SELECT DISTINCT from_identifier, relation, to_identifier FROM (SELECT e.* FROM c_edges e JOIN (SELECT concat('Nation.', CAST(n_nationkey AS STRING)) AS id FROM nation) f ON e.from_identifier = f.id UNION ALL SELECT e.* FROM c_edges e JOIN (SELECT concat('Nation.', CAST(n_nationkey AS STRING)) AS id FROM nation) f ON e.to_identifier = f.id) x",
    # aggregates
    "agg_source_summary": "SELECT s.source_id, s.tier, coalesce(d.documents, 0) AS documents, coalesce(c.chunks, 0) AS chunks FROM c_sources s LEFT JOIN (SELECT source_id, count(*) AS documents FROM c_documents GROUP BY source_id) d ON d.source_id = s.source_id LEFT JOIN (SELECT source_id, count(*) AS chunks FROM c_chunks GROUP BY source_id) c ON c.source_id = s.source_id",
    "agg_duplicate_percent": "SELECT c.source_id, round(CAST(100 AS DOUBLE) * sum(CASE WHEN h.n > 1 THEN 1 ELSE 0 END) / count(*), 2) AS duplicate_percent FROM c_chunks c JOIN (SELECT content_hash, count(DISTINCT source_id) AS n FROM c_chunks GROUP BY content_hash) h ON h.content_hash = c.content_hash GROUP BY c.source_id",
    "agg_health": "SELECT s.source_id, coalesce(x.documents, 0) > 0 AND coalesce(x.chunks, 0) > 0 AS healthy FROM c_sources s LEFT JOIN (SELECT source_id, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM c_chunks WHERE ordinal > 8 GROUP BY source_id) x ON x.source_id = s.source_id",
    "agg_category_summary": "SELECT d.category, count(*) AS documents, sum(coalesce(c.n, 0)) AS chunks FROM c_documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM c_chunks GROUP BY document_id) c ON c.document_id = d.document_id GROUP BY d.category",
    "agg_source_stats": "SELECT c.source_id, c.documents, c.chunks, coalesce(i.identifiers, 0) AS identifiers FROM (SELECT source_id, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM c_chunks GROUP BY source_id) c LEFT JOIN (SELECT source_id, count(*) AS identifiers FROM (SELECT DISTINCT x.source_id, y.normalized FROM c_identifiers y JOIN c_chunks x ON x.chunk_id = y.chunk_id) z GROUP BY source_id) i ON i.source_id = c.source_id",
    "agg_status": "SELECT s.source_id, s.tier, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS chunks, coalesce(i.n, 0) AS identifiers FROM c_sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM c_documents GROUP BY source_id) d ON d.source_id = s.source_id LEFT JOIN (SELECT source_id, count(*) AS n FROM c_chunks GROUP BY source_id) c ON c.source_id = s.source_id LEFT JOIN (SELECT x.source_id, count(*) AS n FROM c_identifiers y JOIN c_chunks x ON x.chunk_id = y.chunk_id GROUP BY x.source_id) i ON i.source_id = s.source_id",
    "agg_table_counts": "SELECT 'sources' AS name, count(*) AS n FROM c_sources UNION ALL SELECT 'documents', count(*) FROM c_documents UNION ALL SELECT 'chunks', count(*) FROM c_chunks UNION ALL SELECT 'identifiers', count(*) FROM c_identifiers",
    "agg_chunks_per_doc": "SELECT document_id, count(*) AS chunks FROM c_chunks GROUP BY document_id",
    "agg_last_indexed": "SELECT max(ts) AS last_indexed_at FROM events",
    "agg_distinct_identifiers": "SELECT c.document_id, count(DISTINCT i.normalized) AS identifiers FROM c_chunks c JOIN c_identifiers i ON i.chunk_id = c.chunk_id GROUP BY c.document_id",
    "agg_doc_stability": "SELECT document_id, CASE WHEN count(*) > 0 AND bool_and(stability = 'experimental') THEN 'experimental' ELSE 'stable' END AS stability FROM c_chunks GROUP BY document_id",
    "agg_incremental_counters": f"SELECT sum(CASE WHEN status = 'added' THEN 1 ELSE 0 END) AS added, sum(CASE WHEN status = 'modified' THEN 1 ELSE 0 END) AS modified, sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS deleted, sum(CASE WHEN status = 'unchanged' THEN 1 ELSE 0 END) AS unchanged FROM (SELECT {STATUS} AS status FROM {DIFF}) x",
    # ranks, windows, sorts
    "rank_exact": f"SELECT query_id, chunk_id, pos FROM ({EXACT}) x WHERE pos <= 120",
    "topk_exact": f"SELECT query_id, chunk_id, pos FROM ({EXACT}) x WHERE pos <= 40",
    "dedupe_first_per_chunk": f"SELECT query_id, chunk_id, first_pos FROM (SELECT query_id, chunk_id, min(pos) AS first_pos FROM ({EXACT}) x WHERE pos <= 40 GROUP BY query_id, chunk_id) y",
    "exact_lookup": f"SELECT query_id, chunk_id, r AS pos FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) AS r FROM (SELECT query_id, chunk_id, min(pos) AS first_pos FROM ({EXACT}) x WHERE pos <= 40 GROUP BY query_id, chunk_id) y) z WHERE r <= 10",
    "first_per_document": "SELECT document_id, chunk_id FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS r FROM c_chunks) x WHERE r = 1",
    "cap_per_document": f"SELECT query_id, document_id, chunk_id FROM (SELECT query_id, document_id, chunk_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY pos) AS r FROM ({EXACT}) x WHERE pos <= 40) y WHERE r <= 2",
    "neighbor_lag_lead": "SELECT a.chunk_id, a.step, b.chunk_id AS neighbour FROM (SELECT chunk_id, document_id, ordinal - 1 AS wanted, -1 AS step FROM c_chunks UNION ALL SELECT chunk_id, document_id, ordinal + 1 AS wanted, 1 AS step FROM c_chunks) a JOIN c_chunks b ON a.document_id = b.document_id AND b.ordinal = a.wanted",
    "version_fallback_pool": "SELECT category, document_id FROM (SELECT category, document_id, kind, max(CASE WHEN kind = 'reference' THEN 1 ELSE 0 END) OVER (PARTITION BY category) AS any_reference FROM c_documents) x WHERE any_reference = 0 OR kind = 'reference'",
    "filter_kind_definition_like": "SELECT source_id, document_id FROM (SELECT source_id, document_id, kind, max(CASE WHEN kind NOT IN ('code', 'example') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id) AS any_reference FROM c_documents) x WHERE any_reference = 0 OR kind NOT IN ('code', 'example')",
    "sort_ranked": "SELECT kind, document_id, row_number() OVER (PARTITION BY kind, category ORDER BY score DESC, tier, document_id) AS r FROM (SELECT d.kind, d.category, d.document_id, s.tier, d.doc_id % 17 AS score FROM c_documents d JOIN c_sources s ON s.source_id = d.source_id) x",
    "sort_hybrid": "SELECT document_id, row_number() OVER (PARTITION BY category ORDER BY exact DESC, score DESC, tier, document_id) AS r FROM (SELECT d.document_id, d.category, s.tier, d.doc_id % 17 AS score, d.doc_id % 5 = 0 AS exact FROM c_documents d JOIN c_sources s ON s.source_id = d.source_id) x",
    "topk_definitions": "SELECT category, document_id, r FROM (SELECT d.category, d.document_id, row_number() OVER (PARTITION BY d.category ORDER BY CASE WHEN d.api_version = '1.1.0' THEN 30 WHEN d.api_version IS NULL THEN -4 ELSE 0 END DESC, s.tier, d.document_id) AS r FROM c_documents d JOIN c_sources s ON s.source_id = d.source_id) x WHERE r <= 3",
    "topk_examples": "SELECT normalized, chunk_id, r FROM (SELECT normalized, chunk_id, row_number() OVER (PARTITION BY normalized ORDER BY tier, ch, ordinal, chunk_id) AS r FROM (SELECT DISTINCT i.normalized, c.chunk_id, s.tier, c.ordinal, " + CHANNEL_RANK.format("d") + f" AS ch FROM {JOINED} WHERE d.kind IN ('code', 'example')) x) y WHERE r <= 30",
    "top1_snapshot": "SELECT normalized, chunk_id FROM (SELECT i.normalized, c.chunk_id, row_number() OVER (PARTITION BY i.normalized ORDER BY i.is_primary DESC, s.tier, " + f"{CHANNEL_RANK.format('d')}, {LIFECYCLE_RANK.format('c')}, c.ordinal, c.chunk_id) AS r FROM {JOINED} WHERE d.api_version = '1.1.0') x WHERE r = 1",
    "topk_canonical": "SELECT normalized, identifier, r FROM (SELECT normalized, identifier, row_number() OVER (PARTITION BY normalized ORDER BY is_primary DESC, identifier) AS r FROM (SELECT DISTINCT i.normalized, coalesce(c.identifier, i.identifier) AS identifier, i.is_primary FROM c_identifiers i JOIN c_chunks c ON c.chunk_id = i.chunk_id) x) y WHERE r <= 16",
    "canonical_identifiers": "SELECT q.query_id, coalesce(x.identifier, q.normalized) AS identifier FROM " + ASKED + " q LEFT JOIN (SELECT DISTINCT i.normalized, coalesce(c.identifier, i.identifier) AS identifier FROM c_identifiers i JOIN c_chunks c ON c.chunk_id = i.chunk_id WHERE i.is_primary = 1) x ON x.normalized = q.normalized",
    "sort_edges": "SELECT from_identifier, relation, to_identifier, row_number() OVER (PARTITION BY to_identifier ORDER BY relation, from_identifier) AS r FROM c_edges",
    "sort_status": "SELECT source_id, row_number() OVER (ORDER BY tier, source_id) AS r FROM c_sources",
    # sets
    "distinct_rows": "SELECT DISTINCT relation, to_identifier FROM c_edges",
    "union_candidates": f"SELECT query_id, document_id, sum(points) AS points FROM (SELECT query_id, document_id, CAST(1000 - 5 * (pos - 1) AS DOUBLE) AS points FROM ({EXACT}) x WHERE pos <= 30 UNION ALL SELECT q.query_id, d.document_id, CAST(50 AS DOUBLE) AS points FROM c_queries q JOIN c_documents d ON d.doc_id = q.query_id) y GROUP BY query_id, document_id",
    "union_examples": "SELECT document_id, min(pref) AS pref FROM (SELECT document_id, 0 AS pref FROM c_documents WHERE kind = 'code' UNION ALL SELECT document_id, 1 AS pref FROM c_documents WHERE kind IN ('code', 'docs')) x GROUP BY document_id",
    # filters over candidates
    "filter_preview": "SELECT document_id FROM c_documents WHERE NOT (channel = 'preview' OR stability IN ('beta', 'experimental', 'internal'))",
    "filter_historical": "SELECT document_id FROM c_documents WHERE lifecycle NOT IN ('historical', 'removed')",
    "scan_size_cap": "SELECT page_id, length(html) AS n FROM pages WHERE length(html) <= 4000",
    # maintenance
    "source_unchanged_skip": "SELECT s.source_id FROM c_sources s JOIN (SELECT source_id, CASE WHEN tier = 2 THEN 'old' ELSE revision END AS revision FROM c_sources) p ON p.source_id = s.source_id AND p.revision = s.revision",
    "diff_documents": f"SELECT coalesce(o.path, n.path) AS path, {STATUS} AS status FROM {DIFF} WHERE NOT (o.path IS NOT NULL AND n.path IS NOT NULL AND o.content_hash = n.content_hash)",
    "input_identity_store": "SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT concat('source_input:', source_id) AS k, 'a' AS v FROM c_sources) o FULL OUTER JOIN (SELECT concat('source_input:', source_id) AS k, revision AS v FROM c_sources WHERE tier = 1) n ON o.k = n.k",
    "sink_upsert_source": "SELECT * FROM (SELECT source_id, name FROM c_sources s WHERE NOT EXISTS (SELECT 1 FROM (SELECT source_id FROM c_sources WHERE tier = 1) n WHERE n.source_id = s.source_id)) o UNION ALL SELECT source_id, 'renamed' AS name FROM c_sources WHERE tier = 1",
    "sink_replace_document": "SELECT * FROM (SELECT document_id, chunk_id FROM c_chunks c WHERE NOT EXISTS (SELECT 1 FROM (SELECT document_id FROM c_documents WHERE doc_id % 50 = 0) n WHERE n.document_id = c.document_id)) o UNION ALL SELECT document_id, concat('new_', document_id) AS chunk_id FROM c_documents WHERE doc_id % 50 = 0",
    "sink_remove_document": "SELECT chunk_id FROM c_chunks c WHERE NOT EXISTS (SELECT 1 FROM c_documents d WHERE d.doc_id % 10 = 1 AND d.document_id = c.document_id)",
    "sink_clear": "SELECT * FROM (SELECT 'schema_version' AS k, '1' AS v UNION ALL SELECT 'built_at', 'x') m WHERE k = 'schema_version'",
    "registry_select": "SELECT source_id FROM c_sources WHERE CASE WHEN channel = 'preview' THEN false ELSE tier <> 4 END",
    "registry_load": "SELECT source_id, count(*) AS n FROM (SELECT source_id FROM c_sources UNION ALL SELECT source_id FROM c_sources WHERE tier = 4) x GROUP BY source_id HAVING count(*) > 1",
    "npm_recent_versions": "SELECT brand, version, r FROM (SELECT p_brand AS brand, actual AS version, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, actual DESC, v.p_partkey) AS r FROM c_versions v JOIN part p ON p.p_partkey = v.p_partkey) x WHERE r <= 12",
    "scan_npm_snapshot": "SELECT d.document_id, d.api_version FROM c_documents d JOIN (SELECT DISTINCT path FROM c_documents WHERE api_package IS NOT NULL) m ON m.path = d.path",
    # retrieval
    "fetch_document": "SELECT d.document_id, c.chunk_id, c.ordinal FROM c_documents d JOIN c_chunks c ON c.document_id = d.document_id WHERE d.kind = 'api'",
    "list_categories": "SELECT d.category, count(*) AS documents, sum(coalesce(c.n, 0)) AS chunks FROM c_documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM c_chunks GROUP BY document_id) c ON c.document_id = d.document_id GROUP BY d.category",
    # edges
    "derive_property_types": "SELECT m.from_identifier, m.relation, m.to_identifier FROM c_edges m JOIN (SELECT DISTINCT from_identifier AS owner FROM c_edges) o ON o.owner = m.to_identifier",
    "alias_edges": "SELECT concat(a.from_identifier, '.', b.to_identifier) AS alias, 'alias_of' AS relation, b.to_identifier AS member FROM c_edges a JOIN c_edges b ON a.to_identifier = b.from_identifier UNION ALL SELECT from_identifier, 'property_type', to_identifier FROM c_edges",
    "reset_derived": "SELECT chunk_id, normalized FROM c_identifiers WHERE alias_type <> 'derived-chain'",
    # quality
    "agg_quality_mean": "SELECT round(avg(CAST(quality AS DOUBLE)), 4) AS useful, round(avg(CAST(toxic AS DOUBLE)), 4) AS toxic FROM labels",
}


def run(c: Corpus, statement: str):
    """The statement over the relations that it names."""
    names = {n for n in re.findall(r"\b(c_\w+|[a-z]+)\b", statement) if n in TABLES or n.startswith("c_")}
    frames = {n: getattr(c, n[2:]) if n.startswith("c_") else c.table(n) for n in names if n in TABLES or hasattr(Corpus, n[2:])}
    marked = re.sub(r"\b(FROM|JOIN) (%s)\b" % "|".join(frames), r"\1 {\2}", statement)
    return c.spark.sql(marked, **{n: f for n, f in frames.items() if f"{{{n}}}" in marked})


def _query(statement: str):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir), statement)


#: Statements that only check an operator of the library: their queries stand in ``upkeep``.
CHECKS = "source_unchanged_skip diff_documents agg_incremental_counters sink_upsert_source sink_replace_document sink_remove_document sink_clear input_identity_store registry_select registry_load".split()
PAIRS = {k: (_query(s), duck(s)) for k, s in STATEMENTS.items() if k not in CHECKS}
#: An identifier says its document itself: nothing is joined with the chunks, whose words would be shuffled for it.
PAIRS["agg_distinct_identifiers"] = (lambda spark, sf_dir: Corpus(spark, sf_dir).identifiers.groupBy("document_id").agg(F.countDistinct("normalized").alias("identifiers")), duck(STATEMENTS["agg_distinct_identifiers"]))
