"""Queries of full-text, vector, search, graph and metric operators."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X
from tessella.operators import choice, duplicates, fetch, graph, lexical, quality_metrics, search, vectors, versions
from tessella.operators.keep import kept
from tessella.operators.options import SearchOptions

from .corpus import Corpus, duck
from .relational import CHANNEL_RANK, EXACT_ORDER, JOINED, LIFECYCLE_RANK
from .scalars import QUESTIONS, _values

# --- full text ---

FTS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
_TOKS = " UNION ALL ".join(f"SELECT chunk_id, {FTS.format(c)} AS t, {w} AS w FROM c_chunks" for c, w in lexical.WEIGHTS.items())
_DL = " + ".join(f"len({FTS.format(c)})" for c in lexical.WEIGHTS)
_P = f"SELECT chunk_id, unnest(t) AS term, w FROM ({_TOKS})"
_P2 = f"SELECT chunk_id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS term, w FROM ({_TOKS})"
_STOP = "(" + ", ".join(f"'{w}'" for w in X.RANKING_STOP_WORDS) + ")"
_MEANT = f"list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_@.$:-]+'), lambda x: length(x) > 1 AND x NOT IN {_STOP})"


def _bm(queries: str) -> str:
    """CTEs up to bm (query_id, chunk_id, score), of the phrases of ``queries`` (of one or two words)."""
    return f"""k AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_@.$:-]+'))) AS token FROM {queries}),
t AS (SELECT query_id, {FTS.format('token').replace('{{', '{').replace('}}', '}')} AS ws FROM k), n AS (SELECT query_id, count(*) AS terms FROM k GROUP BY query_id),
ph AS (SELECT query_id, array_to_string(ws, ' ') AS term, count(*) AS times FROM t GROUP BY ALL),
p AS (SELECT term, chunk_id, sum(w)::DOUBLE AS f FROM ({_P} UNION ALL {_P2}) WHERE term IN (SELECT term FROM ph) GROUP BY ALL), l AS (SELECT chunk_id, {_DL} AS dl FROM c_chunks),
st AS (SELECT count(*) AS n_all, avg(dl) AS av FROM l), df AS (SELECT term, count(*) AS n FROM p GROUP BY term),
sc AS (SELECT ph.query_id, ph.term, ph.times, n.terms, p.chunk_id, CASE WHEN ln((n_all - df.n + 0.5) / (df.n + 0.5)) > 0 THEN ln((n_all - df.n + 0.5) / (df.n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av)) AS s
  FROM ph JOIN n USING (query_id) JOIN p ON p.term = ph.term JOIN l ON l.chunk_id = p.chunk_id JOIN df ON df.term = ph.term, st),
bm AS (SELECT query_id, chunk_id, -sum(times * s) AS score FROM sc GROUP BY query_id, chunk_id, terms HAVING sum(times) = terms)"""


_BM, _BM1 = _bm("c_asked"), _bm(f"(SELECT DISTINCT unnest({_MEANT}) AS query_id, unnest({_MEANT}) AS query FROM c_queries)")
_FALLBACK = (
    f"WITH {_BM1}, r1 AS (SELECT query_id AS term, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS pos FROM bm), "
    f"a AS (SELECT query_id, list_transform(range(1, least(len(u), 8) + 1), lambda i: {{'n': i, 't': u[i]}}) AS ts FROM (SELECT query_id, list_filter({_MEANT}, lambda x, i: list_position({_MEANT}, x) = i) AS u FROM c_queries)), "
    "b AS (SELECT query_id, x.n AS n, x.t AS term FROM (SELECT query_id, unnest(ts) AS x FROM a)), "
    "m AS (SELECT query_id, chunk_id, sum(1 / pos) AS points, min({'n': n, 'pos': pos, 'score': score}) AS first FROM b JOIN r1 USING (term) WHERE pos <= 15 GROUP BY ALL) SELECT query_id, chunk_id, round(points, 6) AS points, r::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(points, 9) DESC, round(first.score, 9), first.n, first.pos) AS r FROM m) WHERE r <= 50"
)
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id)"


def _c(f):
    return lambda spark, sf_dir: f(Corpus(spark, sf_dir))


def _ids(c: Corpus):
    return c.identifiers, c.chunks, c.documents, c.sources


# --- filters ---

_OPTIONS = "SELECT *, CASE WHEN doc_id % 2 = 0 THEN '1' END AS wanted FROM c_documents"


def filter_all(c: Corpus):
    d = c.documents.join(c.sources.select("source_id", "tier"), "source_id").withColumn("wanted", F.when(F.col("doc_id") % 2 == 0, "1"))
    q, none = F.lit("how to use blocks"), F.lit(None)
    keep = (
        Y.preview_allowed(Y.preview_wanted(none.cast("boolean"), q, none.cast("string")), F.col("channel"), F.col("stability"))
        & Y.historical_allowed(none.cast("boolean"), q, F.col("lifecycle")) & Y.member_of(F.array(F.lit("docs"), F.lit("api")), F.col("kind")) & Y.tier_allowed(none.cast("array<int>"), F.col("tier"))
        & Y.path_under(F.lit("/Creator/documents/e"), F.col("path")) & Y.version_allowed(F.col("wanted"), F.col("api_version"))
    )
    return d.filter(keep).select("document_id")


def _kept(condition):
    return _c(lambda c: c.documents.join(c.sources.select("source_id", "tier"), "source_id").filter(condition()).select("document_id"))


def _optional(**given):
    """Documents that a search with these options may show for a query that implies nothing."""
    options = SearchOptions(**given)

    def run(c: Corpus):
        d = c.documents.join(c.sources.select("source_id", "tier"), "source_id")
        return d.filter(options.allowed({n: F.col(n) for n in d.columns}, F.lit("blocks"))).select("document_id")

    return _c(run)


_OPEN = "tier <= 3 AND lifecycle NOT IN ('historical', 'removed') AND NOT (d.channel = 'preview' OR stability IN ('beta', 'experimental', 'internal'))"


# --- ranking pieces ---


def _scored(c: Corpus):
    d = c.documents.join(c.sources.select("source_id", "tier"), "source_id")
    return d.select("document_id", Y.meta_bonus(F.col("tier"), F.col("lifecycle"), F.col("stability"), F.col("channel")).alias("points"))


META = "(5 - tier) * 15 + CASE lifecycle WHEN 'active' THEN 4 WHEN 'deprecated' THEN -4 WHEN 'historical' THEN -8 ELSE 0 END + CASE stability WHEN 'stable' THEN 4 WHEN 'beta' THEN 1 WHEN 'experimental' THEN -2 WHEN 'internal' THEN -5 ELSE 0 END + CASE d.channel WHEN 'stable' THEN 3 WHEN 'preview' THEN -2 ELSE 0 END"
DOCS = "c_documents d JOIN (SELECT source_id, tier, source_type FROM c_sources) s USING (source_id)"


def _intent_bonus(c: Corpus):
    d = c.documents.join(c.sources.select("source_id", "tier", "source_type"), "source_id").withColumn("query", F.lit("latest stable version example of the server"))
    cols = {n: F.col(n) for n in d.columns}
    return d.select("document_id", Y.intent_bonus(Y.intent_flags(cols["query"]), cols, X.meaningful_terms(cols["query"])).alias("points"))


_TERMS = "['stable', 'example', 'server']"
INTENT_SQL = f"""SELECT document_id, (CASE WHEN source_type = 'npm' THEN 28.0 ELSE 0 END + CASE WHEN api_version IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN kind = 'example' THEN 18 WHEN kind = 'code' THEN 10 ELSE 0 END
 + CASE WHEN d.channel = 'stable' THEN 18 WHEN d.channel = 'preview' THEN -16 ELSE 0 END + CASE WHEN stability = 'stable' THEN 8 ELSE 0 END
 + 2.5 * len(list_filter({_TERMS}, lambda t: contains(lower(title), t))) + 0.75 * len(list_filter({_TERMS}, lambda t: contains(lower(path), t))))::DOUBLE AS points FROM {DOCS}"""


def budget_fetch(c: Corpus, budget: int = 1000):
    """Chunks of each document in order until the character budget is spent; the last one clipped."""
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = c.chunks.select("document_id", "chunk_id", "content", "ordinal", (budget - before).alias("left")).filter("left > 0")
    cut = F.concat(F.regexp_replace(F.substr(F.col("content"), F.lit(1), (F.col("left") - 1).cast("int")), r"\s+$", ""), F.lit("…"))
    return rows.select("document_id", "chunk_id", F.when(F.length("content") <= F.col("left"), F.col("content")).otherwise(cut).alias("content"))


def _candidates(c: Corpus):
    """The best chunks of each query by text, and whether one carries the query's first word as its identifier."""
    best = kept(lexical.ranked(lexical.bm25(c.queries, c.chunks), 50).select("query_id", "chunk_id", "pos"))  # at most 50 of a query, read twice
    few = lexical.bounded(best.select("query_id", "chunk_id"), c.queries)
    words = c.queries.select("query_id", F.split("query", " ")[0].alias("normalized"))
    named = lexical.bounded(words, c.queries).join(c.identifiers.select("normalized", "chunk_id"), "normalized").join(few, ["query_id", "chunk_id"], "left_semi").select("query_id", "chunk_id", F.lit(True).alias("exact")).distinct()
    rows = lexical.bounded(best.join(named, ["query_id", "chunk_id"], "left"), c.queries).join(c.chunks.select("chunk_id", "document_id", "content"), "chunk_id")
    return rows.withColumn("exact", F.coalesce("exact", F.lit(False)) & (F.col("pos") % 2 == 0))


def _chosen_sql(limit: int, budget: int) -> str:
    """The choice step by step, by recursion over the ranks."""
    left = f"least(1600, {budget} - s.used)"
    size = f"CASE WHEN length(c.content) <= {left} THEN length(c.content) ELSE length(regexp_replace(substr(c.content, 1, {left} - 1), '\\s+$', '')) + 1 END"
    take = f"(len(s.docs) < {limit} AND {budget} - s.used >= 200 AND (c.exact OR len(list_filter(s.docs, lambda d: d = c.document_id)) < 2))"
    return f"""WITH RECURSIVE {_bm("c_queries")}, r AS (SELECT query_id, chunk_id, {_RANK} AS pos FROM bm),
c AS (SELECT r.query_id, r.pos, r.chunk_id, k.document_id, k.content, r.pos % 2 = 0 AND EXISTS (SELECT 1 FROM c_identifiers i JOIN c_queries q ON i.normalized = split_part(q.query, ' ', 1) WHERE q.query_id = r.query_id AND i.chunk_id = r.chunk_id) AS exact FROM r JOIN c_chunks k USING (chunk_id) WHERE r.pos <= 50),
s AS (SELECT query_id, 0::BIGINT AS pos, []::VARCHAR[] AS docs, 0::BIGINT AS used, false AS taken, 0::BIGINT AS chars, '' AS chunk_id FROM (SELECT DISTINCT query_id FROM c)
 UNION ALL SELECT s.query_id, c.pos, CASE WHEN {take} THEN list_append(s.docs, c.document_id) ELSE s.docs END, s.used + CASE WHEN {take} THEN {size} ELSE 0 END, {take}, {size}, c.chunk_id FROM s JOIN c ON c.query_id = s.query_id AND c.pos = s.pos + 1)
SELECT query_id, len(docs)::INT AS place, pos::INT AS pos, chunk_id, chars::INT AS chars FROM s WHERE taken"""


def _chosen(limit: int, budget: int):
    query = _c(lambda c: choice.chosen(_candidates(c), limit, budget).select("query_id", "place", "pos", "chunk_id", F.length("text").alias("chars")))
    return query, duck(_chosen_sql(limit, budget))


def _knn(c: Corpus):
    e = c.table("embeddings")
    return vectors.knn_cosine(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 40).select("query_id", "vec_id", "pos")


def _rankings(c: Corpus):
    docs = c.documents.select("doc_id", "category", "content_hash")
    rank = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    lex = docs.select(F.col("category").alias("query_id"), F.col("doc_id").alias("item")).filter("item % 3 < 2").withColumn("pos", rank("item"))
    sem = docs.select(F.col("category").alias("query_id"), F.col("doc_id").alias("item"), "content_hash").filter("item % 3 > 0").withColumn("pos", rank("content_hash", "item")).drop("content_hash")
    return lex, sem


def _rrf(c: Corpus):
    return vectors.rrf(*_rankings(c), F.lit(0.55), F.lit(0.45)).select("query_id", "item", F.round("score", 9).alias("score"))


_EW = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_@.$:-]+'), lambda w: length(w) > 1)"
NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, channel, api_version, product_version, {_EW} AS ws FROM c_documents WHERE len({_EW}) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 12)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i) UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.ws = y.ws AND x.doc_id < y.doc_id),
e AS (SELECT a, b FROM p JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b WHERE (x.ws = y.ws OR least(len(x.ws), len(y.ws)) >= 0.8 * greatest(len(x.ws), len(y.ws))) AND x.channel = y.channel
  AND (x.api_version IS NULL OR y.api_version IS NULL OR x.api_version = y.api_version) AND (x.product_version IS NULL OR y.product_version IS NULL OR x.product_version = y.product_version)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b) SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a"""


def _optioned(c: Corpus):
    """Candidates under options: narrow, so that more are fetched, with versions and preview material."""
    options = SearchOptions(channel="Preview", include_historical=True, api_version="1", tiers=(1, 2, 3, 4), stabilities=("stable", "beta"), path_prefix="/creator/")
    return search.candidates(c.queries, *_ids(c), options).select("query_id", "chunk_id", F.round("score", 3).alias("score"), "exact", "channel", "stability", "api_version")


def _fetched(c: Corpus):
    """Every fifth chunk, every document, and ids that name nothing."""
    chunk = c.chunks.filter("ordinal % 5 = 2").select(F.col("chunk_id").alias("id"))
    other = c.spark.createDataFrame([("doc_x",), ("doc_" + "0" * 24,)], "id string")
    ids = chunk.unionByName(c.documents.select(F.col("document_id").alias("id"))).unionByName(other)
    return ids.select(F.col("id").alias("request_id"), "id")


_FETCHED = "SELECT id AS request_id, id FROM (SELECT chunk_id AS id FROM c_chunks WHERE ordinal % 5 = 2 UNION ALL SELECT document_id FROM c_documents UNION ALL SELECT 'doc_x' UNION ALL SELECT 'doc_000000000000000000000000')"
_BUDGET = """y AS (SELECT *, 1500 - coalesce(sum(length(content)) OVER (PARTITION BY request_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(length(content)) OVER (PARTITION BY request_id) > 1500 AS truncated FROM x)
SELECT request_id, target, document_id, chunk_id, ordinal, CASE WHEN length(content) <= lft THEN content ELSE regexp_replace(substr(content, 1, (lft - 1)::BIGINT), '\\s+$', '') || '…' END AS content, truncated FROM y WHERE lft > 0"""


def _traverse(c: Corpus):
    starts = c.table("nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("Nation."), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.traverse(c.edges, starts, depth=2, limit=100).select("query_id", "depth", "direction", "from_identifier", "relation", "to_identifier", "pos")


def _related(c: Corpus):
    """What stands beside every nation, with where suppliers' edges were read."""
    asked = c.table("nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit(" nation."), F.col("n_nationkey").cast("string")).alias("identifier"))
    first = c.chunks.filter("ordinal = 0").select(F.concat(F.lit("Supplier."), F.col("doc_id").cast("string")).alias("from_identifier"), "chunk_id")
    edges = c.edges.join(first, "from_identifier", "left")
    return graph.relationships(asked, edges, *_ids(c), limit=40).select("query_id", "pos", "direction", "from_identifier", "relation", "to_identifier", "truncated", "chunk_id", "path")


_RELATED = """WITH m AS (SELECT n_nationkey::BIGINT AS query_id, 'incoming' AS direction, e.* FROM nation JOIN c_edges e ON lower(e.to_identifier) = 'nation.' || n_nationkey UNION ALL SELECT n_nationkey, 'outgoing', e.* FROM nation JOIN c_edges e ON lower(e.from_identifier) = 'nation.' || n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relation, from_identifier, to_identifier) AS pos, count(*) OVER (PARTITION BY query_id) > 40 AS truncated FROM m)
SELECT query_id, pos::INT AS pos, direction, from_identifier, relation, to_identifier, truncated, c.chunk_id, d.path FROM r LEFT JOIN (SELECT chunk_id, document_id, 'Supplier.' || doc_id AS s FROM c_chunks WHERE ordinal = 0) c ON c.s = from_identifier LEFT JOIN c_documents d ON d.document_id = c.document_id WHERE pos <= 40"""

TRAVERSE_SQL = """WITH e AS (SELECT *, lower(from_identifier) AS f, lower(to_identifier) AS t FROM c_edges),
f1 AS (SELECT n_nationkey::BIGINT AS query_id, 'nation.' || n_nationkey AS node FROM nation),
m1 AS (SELECT query_id, 1 AS depth, 0 AS d, e.* FROM e JOIN f1 ON f = node UNION ALL SELECT query_id, 1, 1, e.* FROM e JOIN f1 ON t = node),
f2 AS (SELECT query_id, node FROM (SELECT query_id, f AS node FROM m1 UNION SELECT query_id, t FROM m1) EXCEPT SELECT query_id, node FROM f1),
m2 AS (SELECT query_id, 2 AS depth, 0 AS d, e.* FROM e JOIN f2 ON f = node UNION ALL SELECT query_id, 2, 1, e.* FROM e JOIN f2 ON t = node),
o AS (SELECT query_id, from_identifier, relation, to_identifier, min(depth * 10 + d) AS k FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k // 10, relation, from_identifier, to_identifier) AS pos FROM o)
SELECT query_id, (k // 10)::INT AS depth, CASE k % 10 WHEN 0 THEN 'outgoing' ELSE 'incoming' END AS direction, from_identifier, relation, to_identifier, pos::INT AS pos FROM r WHERE pos <= 100"""


def _chains(c: Corpus):
    lower = lambda a: F.lower(a)
    properties = c.edges.select(F.col("from_identifier").alias("prefix"), lower("to_identifier").alias("target"))
    members = c.edges.filter("relation = 'part_of'").select(lower("from_identifier").alias("owner"), F.col("to_identifier").alias("suffix"), F.col("to_identifier").alias("member"), lower("to_identifier").alias("target"))
    return graph.alias_chains(properties, members)


CHAIN_SQL = """WITH RECURSIVE m AS (SELECT lower(from_identifier) AS owner, to_identifier AS suffix, lower(to_identifier) AS next FROM c_edges WHERE relation = 'part_of'),
l AS (SELECT from_identifier AS prefix, lower(to_identifier) AS target, 0 AS depth, CAST(NULL AS VARCHAR) AS member FROM c_edges
 UNION ALL SELECT l.prefix || '.' || m.suffix, m.next, l.depth + 1, m.suffix FROM l JOIN m ON m.owner = l.target WHERE l.depth < 4)
SELECT prefix AS alias, member, min(depth)::INT AS depth FROM l WHERE member IS NOT NULL GROUP BY ALL"""


def _suite(c: Corpus):
    """Forty cases whose results are ten documents each, relevance by category, source and path."""
    n = (F.col("doc_id") % 40).alias("case_id")
    order = Window.partitionBy("case_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    d = c.documents.filter("doc_id % 3 = 0").select(n, "doc_id", F.col("title").alias("identifier"), "source_id", "category", "channel", "api_package", "path")
    results = d.withColumn("pos", F.row_number().over(order)).filter("pos <= 10")
    cases = c.documents.select(n).distinct().withColumn("kind", F.when(F.col("case_id") % 2 == 0, "exact").otherwise("natural")).withColumn("required", F.when(F.col("case_id") % 3 == 0, (F.col("case_id") % 10 + 1).cast("int")))
    none = F.lit(None).cast("string")
    entry = lambda **f: cases.select("case_id", *[(f.get(k, none)).alias(k) for k in quality_metrics.FIELDS], F.lit(f["grade"]).alias("grade"))
    relevant = entry(category=F.lit("en"), channel=F.lit("stable"), grade=3).unionByName(entry(pathContains=F.concat(F.lit("/"), F.col("case_id").cast("string")), grade=2)).unionByName(entry(module=F.lit("@SCOPE/server"), grade=1))
    return quality_metrics.evaluate(cases, quality_metrics.judged(results, relevant), relevant)


_SUITE = """WITH res AS (SELECT * FROM (SELECT doc_id % 40 AS case_id, category, channel, api_package, path, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY sha256(doc_id::VARCHAR)) AS pos FROM c_documents WHERE doc_id % 3 = 0) WHERE pos <= 10),
ca AS (SELECT DISTINCT doc_id % 40 AS case_id FROM c_documents), f AS (
 SELECT case_id, pos, 1 AS item, 3 AS grade FROM res WHERE category = 'en' AND channel = 'stable' UNION ALL SELECT case_id, pos, 2, 2 FROM res WHERE contains(lower(path), '/' || case_id) UNION ALL SELECT case_id, pos, 3, 1 FROM res WHERE api_package = '@scope/server'),
o AS (SELECT case_id, item, grade, min(pos) AS pos FROM f GROUP BY ALL), pl AS (SELECT case_id, pos, max(grade) AS grade, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT case_id, min(pos) AS first_rank, sum(CASE WHEN pos <= 3 THEN n ELSE 0 END) AS at3, sum(CASE WHEN pos <= 5 THEN n ELSE 0 END) AS at5, sum(CASE WHEN pos <= 5 THEN (pow(2.0, grade) - 1) / log2(pos + 1) ELSE 0 END) AS dcg FROM pl GROUP BY case_id),
e AS (SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'exact' ELSE 'natural' END AS kind, CASE WHEN case_id % 3 = 0 THEN (case_id % 10 + 1)::INT END AS required, first_rank::INT AS first_rank, round(coalesce(1 / first_rank, 0), 4)::DOUBLE AS reciprocal_rank, round(coalesce(at3 / 3, 0), 4)::DOUBLE AS recall_at_3,
 round(coalesce(at5 / 3, 0), 4)::DOUBLE AS recall_at_5, round(coalesce(dcg / (7 + 3 / log2(3) + 1 / 2), 0), 4)::DOUBLE AS ndcg_at_5, case_id % 3 <> 0 OR coalesce(first_rank <= case_id % 10 + 1, false) AS required_passed FROM ca LEFT JOIN g USING (case_id))"""


def _entries(c: Corpus):
    none = F.lit(None).cast("string")
    given = {"category": F.lit("fr"), "pathContains": F.lit("DOCUMENTS/fr/1")}
    return c.spark.range(40).select(F.col("id").alias("case_id"), *[given.get(f, none).alias(f) for f in quality_metrics.FIELDS], F.lit(2).alias("grade"))


def _suite_file(c: Corpus):
    """A suite file searched and judged, one row per case."""
    _, _, cases, relevant = quality_metrics.load_suite(c.spark, os.path.join(os.path.dirname(os.path.abspath(__file__)), "samples", "suite.json"))
    numbered = cases.withColumn("query_id", F.xxhash64("case_id"))
    results = search.search(numbered.select("query_id", "query"), *_ids(c), SearchOptions(limit=10, max_chars=24_000))
    public = search.public(results, c.chunks, c.documents, c.sources).join(numbered.select("query_id", "case_id"), "query_id")
    return quality_metrics.evaluate(cases, quality_metrics.judged(public.select("case_id", "pos", "identifier", "source_id", "category", "channel", "api_package", "path"), relevant), relevant)


def _plan(spark, sf_dir):
    p = Y.plan_lookup(F.col("s"))
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "sid int, s string").select("sid", *[p[k].alias(k) for k in ("intent", "recommended_tool", "confidence", "search_query", "module", "fetch_id", "include_preview")], *[F.array_join(p[k], "|").alias(k) for k in ("identifiers", "keywords", "suggested_kinds")])


#: Candidates by formula: no query of two invented words shows an intent, so that part of the score is left out here.
_SCORED = f"""WITH {_bm('c_queries')}, rk AS (SELECT query_id, chunk_id, {_RANK} AS l FROM bm),
lx AS (SELECT query_id, chunk_id, l FROM rk WHERE l <= 50 UNION ALL SELECT f.query_id, f.chunk_id, f.pos FROM ({_FALLBACK}) f JOIN c_queries q USING (query_id) WHERE len(list_distinct({_MEANT})) > 1 AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.query_id = f.query_id)),
nm AS (SELECT query_id, query, regexp_replace(query, '\\s', '', 'g') AS nq, list_distinct({_MEANT}) AS terms FROM c_queries),
ex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS e FROM (SELECT query_id, chunk_id, min(place) AS place FROM (SELECT q.query_id, c.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {EXACT_ORDER}) AS place FROM {JOINED} JOIN nm q ON q.nq = i.normalized) WHERE place <= 120 GROUP BY ALL)),
bo AS (SELECT coalesce(ex.query_id, lx.query_id) AS query_id, coalesce(ex.chunk_id, lx.chunk_id) AS chunk_id, e, l FROM (SELECT * FROM ex WHERE e <= 30) ex FULL OUTER JOIN lx ON ex.query_id = lx.query_id AND ex.chunk_id = lx.chunk_id)
SELECT query_id, chunk_id, round(CASE WHEN e IS NOT NULL THEN 1000 - 5 * (e - 1) + 2 + coalesce(50.0::DOUBLE / l, 0) ELSE 100.0::DOUBLE / l END + {META} + CASE WHEN lower(identifier) = nq THEN 20 ELSE 0 END
 + 2.5 * len(list_filter(terms, lambda t: contains(lower(title), t))) + 0.75 * len(list_filter(terms, lambda t: contains(lower(d.path), t))), 3)::DOUBLE AS score, e IS NOT NULL AS exact
FROM bo JOIN nm USING (query_id) JOIN (SELECT chunk_id, document_id, title, identifier FROM c_chunks) c USING (chunk_id) JOIN (SELECT document_id, source_id, path, channel, lifecycle, stability FROM c_documents) d USING (document_id) JOIN (SELECT source_id, tier FROM c_sources) s USING (source_id)
WHERE NOT (d.channel = 'preview' OR stability IN ('beta', 'experimental', 'internal')) AND lifecycle NOT IN ('historical', 'removed') AND tier IN (1, 2, 3)"""

def _compared(c: Corpus):
    """Every word that is asked for first, every first word of a chunk, and a name that nothing has."""
    names = c.chunks.select("identifier").unionByName(c.queries.select(F.split("query", " ")[0].alias("identifier"))).unionByName(c.spark.createDataFrame([("no such name",)], "identifier string"))
    asked = names.filter("identifier is not null").select(X.normalize_identifier(F.col("identifier")).alias("identifier")).distinct()
    return versions.compare(asked.select(F.col("identifier").alias("query_id"), "identifier"), *_ids(c), "api", "1.1.0", "2.2.0")


def _side(version: str) -> str:
    order = f"i.is_primary DESC, s.tier, {CHANNEL_RANK.format('d')}, {LIFECYCLE_RANK.format('c')}, c.ordinal, c.chunk_id"
    return f"(SELECT normalized, chunk_id, content_hash, stability, lifecycle FROM (SELECT i.normalized, c.chunk_id, c.content_hash, c.stability, c.lifecycle, row_number() OVER (PARTITION BY i.normalized ORDER BY {order}) AS r FROM {JOINED} WHERE d.api_version = '{version}' AND d.channel <> 'preview' AND c.stability NOT IN ('beta', 'experimental', 'internal')) WHERE r = 1)"


_COMPARED = f"""SELECT n.id AS query_id, n.id AS normalized, CASE WHEN a.chunk_id IS NULL AND b.chunk_id IS NULL THEN 'not_found' WHEN a.chunk_id IS NULL THEN 'added' WHEN b.chunk_id IS NULL THEN 'removed' WHEN a.content_hash = b.content_hash AND a.stability = b.stability AND a.lifecycle = b.lifecycle THEN 'unchanged' ELSE 'changed' END AS status,
 coalesce(a.content_hash <> b.content_hash, false) AS content_changed, coalesce(a.stability <> b.stability, false) AS stability_changed, coalesce(a.lifecycle <> b.lifecycle, false) AS lifecycle_changed, false AS kind_changed, a.chunk_id AS old_chunk, b.chunk_id AS new_chunk,
 CASE WHEN a.chunk_id IS NULL AND b.chunk_id IS NULL THEN 'No indexed api evidence matched either requested version.' WHEN a.chunk_id IS NULL THEN 'No indexed api evidence matched old version 1.1.0.' WHEN b.chunk_id IS NULL THEN 'No indexed api evidence matched new version 2.2.0.' END AS warning
FROM (SELECT lower(identifier) AS id FROM c_chunks WHERE identifier IS NOT NULL UNION SELECT split_part(query, ' ', 1) FROM c_queries UNION SELECT 'nosuchname') n LEFT JOIN {_side('1.1.0')} a ON a.normalized = n.id LEFT JOIN {_side('2.2.0')} b ON b.normalized = n.id"""

PAIRS = {
    "compare_versions": (_c(_compared), duck(_COMPARED)),
    "postings": (_c(lambda c: lexical.postings(c.chunks).select("term", "chunk_id", "frequency")), duck(f"SELECT term, chunk_id, sum(w)::DOUBLE AS frequency FROM ({_P}) GROUP BY ALL")),
    "bm25": (_c(lambda c: lexical.bm25(c.asked, c.chunks).select("query_id", "chunk_id", F.round("score", 6).alias("score"))), duck(f"WITH {_BM} SELECT query_id, chunk_id, round(score, 6) AS score FROM bm")),
    "topk_bm25": (
        _c(lambda c: lexical.ranked(lexical.bm25(c.asked, c.chunks), 50).select("query_id", "chunk_id", "pos", F.round("score", 6).alias("score"))),
        duck(f"WITH {_BM} SELECT query_id, chunk_id, r::INT AS pos, round(score, 6) AS score FROM (SELECT *, {_RANK} AS r FROM bm) WHERE r <= 50"),
    ),
    "rank_lexical": (_c(lambda c: lexical.ranked(lexical.bm25(c.asked, c.chunks), 100).select("query_id", "chunk_id", "pos")), duck(f"WITH {_BM} SELECT query_id, chunk_id, r::INT AS pos FROM (SELECT *, {_RANK} AS r FROM bm) WHERE r <= 100")),
    "phrase_match": (
        _c(lambda c: lexical.phrase_match(c.asked, c.chunks)),
        duck(f"WITH {_BM} SELECT query_id, term AS phrase, chunk_id, f AS frequency FROM ph JOIN p USING (term)"),
    ),
    "fallback_lexical": (_c(lambda c: lexical.fallback(c.queries, c.chunks)), duck(_FALLBACK)),
    "search": (_c(lambda c: search.search(c.queries, *_ids(c))), None),
    "score_candidates": (_c(lambda c: search.candidates(c.queries, *_ids(c)).select("query_id", "chunk_id", F.round("score", 3).alias("score"), "exact")), duck(_SCORED)),
    "search_options": (_c(_optioned), None),
    "meta_bonus": (_c(_scored), duck(f"SELECT document_id, ({META})::INT AS points FROM {DOCS}")),
    "intent_bonus": (_c(_intent_bonus), duck(INTENT_SQL)),
    "filter_all": (
        _c(filter_all),
        duck(
            f"SELECT document_id FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '1' END AS wanted FROM c_documents) d JOIN c_sources s USING (source_id) WHERE NOT (d.channel = 'preview' OR stability IN ('beta', 'experimental', 'internal')) AND lifecycle NOT IN ('historical', 'removed') AND kind IN ('docs', 'api') AND tier IN (1, 2, 3) AND starts_with(lower(path), 'creator/documents/e') AND (wanted IS NULL OR api_version IS NULL OR starts_with(api_version, '1.'))"
        ),
    ),
    "filter_kinds": (_kept(lambda: Y.member_of(F.array(F.lit("api"), F.lit("code")), F.col("kind"))), duck("SELECT document_id FROM c_documents WHERE kind IN ('api', 'code')")),
    "filter_categories": (_optional(categories=("en", "fr")), duck("SELECT document_id FROM c_documents d JOIN c_sources s USING (source_id) WHERE category IN ('en', 'fr') AND " + _OPEN)),
    "filter_stabilities": (_optional(stabilities=("stable", "beta"), include_preview=True), duck("SELECT document_id FROM c_documents d JOIN c_sources s USING (source_id) WHERE stability IN ('stable', 'beta') AND tier <= 3 AND lifecycle NOT IN ('historical', 'removed')")),
    "filter_options": (
        _optional(kinds=("docs", "api"), source_id="src1", api_version="1", product_version="1.1", path_prefix="/CREATOR/", include_historical=True, tiers=(2, 4)),
        duck("SELECT document_id FROM c_documents d JOIN c_sources s USING (source_id) WHERE kind IN ('docs', 'api') AND source_id = 'src1' AND (api_version IS NULL OR api_version = '1' OR starts_with(api_version, '1.')) AND (product_version IS NULL OR product_version = '1.1') AND tier IN (2, 4) AND NOT (d.channel = 'preview' OR stability IN ('beta', 'experimental', 'internal'))"),
    ),
    "filter_tiers": (_kept(lambda: Y.tier_allowed(F.lit(None).cast("array<int>"), F.col("tier"))), duck("SELECT document_id FROM c_documents JOIN c_sources USING (source_id) WHERE tier IN (1, 2, 3)")),
    "filter_source": (_kept(lambda: Y.same_text(F.lit("STABLE"), F.col("channel")) & Y.same_text(F.lit("@Scope/Server"), F.col("api_package"))), duck("SELECT document_id FROM c_documents WHERE channel = 'stable' AND api_package = '@scope/server'")),
    "filter_path_prefix": (_kept(lambda: Y.path_under(F.lit("//Creator/Documents/fr"), F.col("path"))), duck("SELECT document_id FROM c_documents WHERE path LIKE 'creator/Documents/fr%'")),
    "filter_version": (_kept(lambda: Y.version_allowed(F.lit("1"), F.col("api_version"))), duck("SELECT document_id FROM c_documents WHERE api_version IS NULL OR starts_with(api_version, '1.')")),
    "filter_preview_inferred": (_kept(lambda: Y.preview_allowed(Y.preview_wanted(F.lit(None).cast("boolean"), F.col("title"), F.lit("Preview")), F.col("channel"), F.col("stability"))), duck("SELECT document_id FROM c_documents")),
    "budget_fetch": (
        _c(budget_fetch),
        duck(
            "SELECT document_id, chunk_id, CASE WHEN length(content) <= lft THEN content ELSE regexp_replace(substr(content, 1, (lft - 1)::BIGINT), '\\s+$', '') || '…' END AS content FROM (SELECT *, 1000 - coalesce(sum(length(content)) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM c_chunks) WHERE lft > 0"
        ),
    ),
    "choose_results": _chosen(10, 9800),
    "choose_results_tight": _chosen(6, 900),
    "running_char_budget": (
        _c(lambda c: c.chunks.withColumn("total", F.sum(F.least(F.length("content"), F.lit(1600))).over(Window.partitionBy("document_id").orderBy("ordinal"))).filter("total <= 9800").select("document_id", "chunk_id", "total")),
        duck("SELECT document_id, chunk_id, total::BIGINT AS total FROM (SELECT *, sum(least(length(content), 1600)) OVER (PARTITION BY document_id ORDER BY ordinal) AS total FROM c_chunks) WHERE total <= 9800"),
    ),
    "excerpt": (
        _c(lambda c: c.documents.select("doc_id", X.excerpt(F.col("text"), F.lit("the of and"), 400).alias("part"))),
        duck(
            "SELECT doc_id, CASE WHEN n <= 400 THEN text WHEN p IS NULL THEN regexp_replace(substr(text, 1, 399), '\\s+$', '') || '…' ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || trim(substr(text, b + 1, least(n, a + 400) - b), ' ' || chr(10) || chr(9) || chr(13)) || CASE WHEN least(n, a + 400) < n THEN '…' ELSE '' END END AS part "
            "FROM (SELECT *, CASE WHEN least(n, a + 400) = n THEN greatest(0, n - 400) ELSE a END AS b FROM (SELECT *, greatest(0, p - 1 - 120) AS a FROM (SELECT doc_id, text, length(text) AS n, list_min(list_filter([position('the' IN lower(text)), position('of' IN lower(text)), position('and' IN lower(text))], lambda x: x > 0)) AS p FROM documents)))"
        ),
    ),
    "knn_cosine": (
        _c(_knn),
        "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, round(1 - list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS far FROM q, embeddings) SELECT query_id, vec_id, r::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, vec_id) AS r FROM d) WHERE r <= 40",
    ),
    "embedding_text": (
        _c(lambda c: c.chunks.select("chunk_id", vectors.embedding_text(F.col("title"), F.col("identifier"), F.col("source_id"), F.col("content"), 600).alias("given"))),
        duck("SELECT chunk_id, substr(array_to_string(list_filter([title, identifier, source_id, content], lambda x: x IS NOT NULL AND x <> ''), chr(10)), 1, 600) AS given FROM c_chunks"),
    ),
    "embed": (_c(lambda c: vectors.embed(c.documents.select("doc_id", "text"), vectors.hashing_embedder(16)).select("doc_id", F.size("embedding").alias("dimensions"))), "SELECT doc_id, 16 AS dimensions FROM documents"),
    "vector_reuse": (
        _c(lambda c: vectors.reuse(c.documents.select(F.col("document_id").alias("chunk_id"), "content_hash"), c.documents.filter("doc_id % 3 = 0").select(F.col("document_id").alias("chunk_id"), "content_hash", F.array(F.lit(1.0)).alias("embedding"))).select("chunk_id", F.col("embedding").isNotNull().alias("reused"))),
        duck("SELECT document_id AS chunk_id, doc_id % 3 = 0 AS reused FROM c_documents"),
    ),
    "rrf_fuse": (
        _c(_rrf),
        duck(
            "WITH lx AS (SELECT category AS query_id, doc_id AS item, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS pos FROM c_documents WHERE doc_id % 3 < 2), sm AS (SELECT category AS query_id, doc_id AS item, row_number() OVER (PARTITION BY category ORDER BY content_hash, doc_id) AS pos FROM c_documents WHERE doc_id % 3 > 0) "
            "SELECT coalesce(lx.query_id, sm.query_id) AS query_id, coalesce(lx.item, sm.item) AS item, round(coalesce(0.55::DOUBLE / (60 + lx.pos), 0) + coalesce(0.45::DOUBLE / (60 + sm.pos), 0), 9) AS score FROM lx FULL OUTER JOIN sm ON lx.query_id = sm.query_id AND lx.item = sm.item"
        ),
    ),
    "fetch_adjacent": (
        _c(lambda c: fetch.fetch(_fetched(c), c.chunks, c.documents, before=2, after=1, max_chars=1500)),
        duck(
            f"WITH t AS ({_FETCHED}), x AS (SELECT request_id, 'chunk' AS target, c.document_id, c.chunk_id, c.ordinal, c.content FROM t JOIN c_chunks o ON o.chunk_id = t.id JOIN c_chunks c ON c.document_id = o.document_id AND c.ordinal BETWEEN o.ordinal - 2 AND o.ordinal + 1 "
            f"UNION ALL SELECT request_id, 'document', c.document_id, c.chunk_id, c.ordinal, c.content FROM t JOIN c_chunks c ON c.document_id = t.id), {_BUDGET}"
        ),
    ),
    "fetch_section": (
        _c(lambda c: fetch.fetch(_fetched(c), c.chunks, c.documents, mode="section", max_chars=1500)),
        duck(
            f"WITH t AS ({_FETCHED}), x AS (SELECT request_id, 'chunk' AS target, c.document_id, c.chunk_id, c.ordinal, c.content FROM t JOIN c_chunks o ON o.chunk_id = t.id JOIN c_chunks c ON c.document_id = o.document_id AND CASE WHEN len(o.heading_path) = 0 THEN c.ordinal = o.ordinal ELSE c.heading_path[1:least(2, len(o.heading_path))] = o.heading_path[1:2] END "
            f"UNION ALL SELECT request_id, 'document', c.document_id, c.chunk_id, c.ordinal, c.content FROM t JOIN c_chunks c ON c.document_id = t.id), {_BUDGET}"
        ),
    ),
    "fetch_targets": (
        _c(lambda c: fetch.targets(_fetched(c), c.chunks, c.documents).select("request_id", "target", "document_id", "error")),
        duck(f"SELECT request_id, CASE WHEN id LIKE 'chk_%' THEN 'chunk' WHEN id LIKE 'doc_%' AND length(id) = 28 THEN 'document' ELSE 'invalid' END AS target, coalesce(c.document_id, d.document_id) AS document_id, CASE WHEN id = 'doc_x' THEN 'INVALID_DOCUMENT_ID' WHEN coalesce(c.document_id, d.document_id) IS NULL THEN 'NOT_FOUND' END AS error FROM ({_FETCHED}) t LEFT JOIN c_chunks c ON c.chunk_id = t.id LEFT JOIN c_documents d ON d.document_id = t.id"),
    ),
    "near_duplicate": (_c(lambda c: duplicates.near_duplicates(c.documents)), duck(NEAR_SQL)),
    "relationships": (_c(_related), duck(_RELATED)),
    "traverse": (_c(_traverse), duck(TRAVERSE_SQL)),
    "derive_alias_chains": (_c(_chains), duck(CHAIN_SQL)),
    "quality_cases": (_c(_suite), duck(_SUITE + " SELECT * FROM e")),
    "quality_summary": (
        _c(lambda c: quality_metrics.summary(_suite(c))),
        duck(
            _SUITE
            + " SELECT *, required_passed = required_cases AS gate_passed, exact_top1 >= 0.95 AND natural_top3 >= 0.9 AND useful_top5 >= 0.95 AND required_passed = required_cases AS passed_targets FROM (SELECT count(*) AS queries, round(avg(reciprocal_rank), 4) AS mrr, round(avg(recall_at_3), 4) AS recall_at_3, round(avg(recall_at_5), 4) AS recall_at_5, round(avg(ndcg_at_5), 4) AS ndcg_at_5, "
            "round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (kind = 'exact'), 4) AS exact_top1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (kind = 'natural'), 4) AS natural_top3, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS useful_top5, count(required) AS required_cases, count(*) FILTER (required IS NOT NULL AND required_passed) AS required_passed FROM e)"
        ),
    ),
    "quality_suite": (_c(_suite_file), None),
    "relevance_match": (
        _c(lambda c: quality_metrics.judged(c.documents.select((F.col("doc_id") % 40).alias("case_id"), F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("identifier"), "source_id", "category", "channel", "api_package", "path"), _entries(c)).select("case_id", "pos", "grade")),
        duck("SELECT doc_id % 40 AS case_id, doc_id AS pos, 2 AS grade FROM c_documents WHERE category = 'fr' AND contains(lower(path), 'documents/fr/1')"),
    ),
    "plan_lookup": (_plan, None),
}
