"""The tables of the engine over the stand-in data, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X

WORDS = r"[\p{L}\p{N}]+"


@dataclass
class Corpus:
    """Lazy relations; nothing is computed before an action."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        rows = self.table("documents").select("source").distinct()
        return rows.select(
            F.col("source").alias("source_id"),
            F.concat(F.lit("Source "), F.col("source")).alias("name"),
            F.when(n % 3 == 0, "git").when(n % 3 == 1, "npm").otherwise("local").alias("source_type"),
            (n % 4 + 1).alias("tier"),
            F.when(n % 5 == 0, "preview").when(n % 5 == 1, "unknown").otherwise("stable").alias("channel"),
            F.concat(F.lit("https://example.org/"), F.col("source")).alias("repository"),
            F.concat(F.lit("rev"), n.cast("string")).alias("revision"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        path = F.concat(F.lit("creator/Documents/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
        d = F.col("doc_id")
        return self.table("documents").select(
            d,
            X.stable_public_id("doc", F.col("source"), path).alias("document_id"),
            F.col("source").alias("source_id"),
            path.alias("path"),
            F.substring("text", 1, 40).alias("title"),
            F.when(d % 13 == 0, "code").when(d % 13 == 1, "api").when(d % 13 == 2, "reference").otherwise("docs").alias("kind"),
            F.col("lang").alias("category"),
            F.when(n % 5 == 0, "preview").when(n % 5 == 1, "unknown").otherwise("stable").alias("channel"),
            F.when(d % 7 == 0, "beta").when(d % 7 == 1, "experimental").otherwise("stable").alias("stability"),
            F.when(d % 11 == 0, "deprecated").when(d % 11 == 1, "historical").otherwise("active").alias("lifecycle"),
            F.when(d % 4 > 0, F.concat((d % 3).cast("string"), F.lit("."), (d % 10).cast("string"), F.lit(".0"))).alias("api_version"),
            F.when(d % 6 == 0, F.lit("@scope/server")).alias("api_package"),
            F.when(d % 5 == 0, F.concat(F.lit("1."), (d % 3).cast("string"))).alias("product_version"),
            X.sha256_text(F.col("text")).alias("content_hash"),
            "text",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        lines = self.documents.select("doc_id", "document_id", "source_id", "stability", "lifecycle", "path", F.col("title").alias("heading"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
        return lines.filter(F.trim("content") != "").select(
            X.stable_public_id("chk", F.col("document_id"), F.col("ordinal"), F.sha2("content", 256)).alias("chunk_id"),
            "document_id",
            "doc_id",
            "source_id",
            "ordinal",
            F.substring("content", 1, 30).alias("title"),
            F.nullif(F.regexp_extract("content", WORDS, 0), F.lit("")).alias("identifier"),
            "content",
            X.sha256_text(F.col("content")).alias("content_hash"),
            "stability",
            "lifecycle",
            "heading",
            F.right("content", F.lit(12)).alias("aliases"),
            "path",
            F.when(F.col("ordinal") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("S"), F.floor(F.col("ordinal") / 6).cast("string")), F.concat(F.lit("P"), (F.col("ordinal") % 2).cast("string")))).alias("heading_path"),
        )

    @cached_property
    def identifiers(self) -> DataFrame:
        """Every word of a chunk names it; the first is the primary one, the third stands for a derived alias."""
        found = F.regexp_extract_all("content", F.lit(WORDS), F.lit(0))
        # outer, or Spark finds the words once more beforehand, to tell whether there are any
        rows = self.chunks.select("chunk_id", "document_id", F.posexplode_outer(F.array_distinct(found)).alias("pos", "identifier")).filter("pos IS NOT NULL")
        return rows.select(
            "chunk_id",
            "document_id",
            "identifier",
            F.lower("identifier").alias("normalized"),
            F.when(F.col("pos") == 0, 1).otherwise(0).alias("is_primary"),
            F.when(F.col("pos") == 2, "derived-chain").otherwise("exact").alias("alias_type"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """What a user might type: two words of each benchmark item."""
        words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 2), " ").alias("query"))

    @cached_property
    def asked(self) -> DataFrame:
        """The queries, and one more of each item with two words joined to one token, which makes them a phrase."""
        words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
        joined = self.table("benchmark").select((F.col("item_id") + 1_000_000).alias("query_id"), F.concat(F.get(words, F.lit(2)), F.lit("-"), F.get(words, F.lit(3))).alias("query"))
        return self.queries.unionByName(joined)

    @cached_property
    def edges(self) -> DataFrame:
        name = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
        customers = self.table("customer").select(name("Customer.", "c_custkey").alias("from_identifier"), F.lit("lives_in").alias("relation"), name("Nation.", "c_nationkey").alias("to_identifier"))
        suppliers = self.table("supplier").select(name("Supplier.", "s_suppkey").alias("from_identifier"), F.lit("ships_from").alias("relation"), name("Nation.", "s_nationkey").alias("to_identifier"))
        nations = self.table("nation").select(name("Nation.", "n_nationkey").alias("from_identifier"), F.lit("part_of").alias("relation"), name("Region.", "n_regionkey").alias("to_identifier"))
        return customers.unionByName(suppliers).unionByName(nations)

    @cached_property
    def versions(self) -> DataFrame:
        p = self.table("part")
        wanted = F.when(p.p_size % 4 == 0, (p.p_size % 3).cast("string")).when(p.p_size % 4 == 1, F.concat(F.lit("v"), (p.p_size % 3).cast("string"), F.lit("."), p.p_size.cast("string"))).when(p.p_size % 4 == 2, F.concat((p.p_size % 3).cast("string"), F.lit("."), p.p_size.cast("string"), F.lit("."), (p.p_partkey % 5).cast("string")))
        return p.select("p_partkey", wanted.alias("requested"), F.concat((p.p_size % 3).cast("string"), F.lit("."), p.p_size.cast("string"), F.lit("."), (p.p_partkey % 10).cast("string")).alias("actual"))

    def named(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("sources", "documents", "chunks", "identifiers", "queries", "asked", "edges", "versions")}


#: The same relations for DuckDB, by name.
CTES = {
    "c_sources": r"""SELECT DISTINCT source AS source_id, 'Source ' || source AS name, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'npm' ELSE 'local' END AS source_type,
  CAST(substr(source, 4) AS INT) % 4 + 1 AS tier, CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'preview' WHEN 1 THEN 'unknown' ELSE 'stable' END AS channel,
  'https://example.org/' || source AS repository, 'rev' || CAST(CAST(substr(source, 4) AS INT) AS VARCHAR) AS revision FROM documents""",
    "c_documents": r"""SELECT doc_id, 'doc_' || substr(sha256(concat(source, chr(0), path)), 1, 24) AS document_id, source AS source_id, path, substr(text, 1, 40) AS title,
  CASE doc_id % 13 WHEN 0 THEN 'code' WHEN 1 THEN 'api' WHEN 2 THEN 'reference' ELSE 'docs' END AS kind, lang AS category,
  CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'preview' WHEN 1 THEN 'unknown' ELSE 'stable' END AS channel,
  CASE doc_id % 7 WHEN 0 THEN 'beta' WHEN 1 THEN 'experimental' ELSE 'stable' END AS stability,
  CASE doc_id % 11 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'historical' ELSE 'active' END AS lifecycle,
  CASE WHEN doc_id % 4 > 0 THEN (doc_id % 3) || '.' || (doc_id % 10) || '.0' END AS api_version, CASE WHEN doc_id % 6 = 0 THEN '@scope/server' END AS api_package, CASE WHEN doc_id % 5 = 0 THEN '1.' || (doc_id % 3) END AS product_version,
  'sha256:' || sha256(text) AS content_hash, text FROM (SELECT *, 'creator/Documents/' || lang || '/' || doc_id || '.md' AS path FROM documents)""",
    "c_chunks": r"""SELECT 'chk_' || substr(sha256(concat(document_id, chr(0), CAST(ordinal AS VARCHAR), chr(0), sha256(content))), 1, 24) AS chunk_id, document_id, doc_id, source_id, ordinal, substr(content, 1, 30) AS title,
  nullif(regexp_extract(content, '[\p{L}\p{N}]+', 0), '') AS identifier, content, 'sha256:' || sha256(content) AS content_hash, stability, lifecycle, heading, right(content, 12) AS aliases, path, CASE WHEN ordinal % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['S' || (ordinal // 6), 'P' || (ordinal % 2)] END AS heading_path
  FROM (SELECT document_id, doc_id, source_id, stability, lifecycle, title AS heading, path, CAST(i - 1 AS INT) AS ordinal, l[i] AS content FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM c_documents))) WHERE trim(content, ' ') <> ''""",
    "c_identifiers": r"""SELECT chunk_id, document_id, w[p] AS identifier, lower(w[p]) AS normalized, CASE p WHEN 1 THEN 1 ELSE 0 END AS is_primary, CASE p WHEN 3 THEN 'derived-chain' ELSE 'exact' END AS alias_type
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM (SELECT chunk_id, document_id, list_transform(list_filter(list_transform(r, lambda x, i: CASE WHEN list_position(r, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x) AS w
  FROM (SELECT chunk_id, document_id, regexp_extract_all(content, '[\p{L}\p{N}]+') AS r FROM c_chunks)))""",
    "c_queries": r"""SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:2], ' ') AS query FROM benchmark""",
    "c_asked": r"""SELECT query_id, query FROM c_queries UNION ALL SELECT item_id + 1000000, w[3] || '-' || w[4] FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)""",
    "c_edges": r"""SELECT 'Customer.' || c_custkey AS from_identifier, 'lives_in' AS relation, 'Nation.' || c_nationkey AS to_identifier FROM customer
  UNION ALL SELECT 'Supplier.' || s_suppkey, 'ships_from', 'Nation.' || s_nationkey FROM supplier UNION ALL SELECT 'Nation.' || n_nationkey, 'part_of', 'Region.' || n_regionkey FROM nation""",
    "c_versions": r"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN (p_size % 3) || '' WHEN 1 THEN 'v' || (p_size % 3) || '.' || p_size WHEN 2 THEN (p_size % 3) || '.' || p_size || '.' || (p_partkey % 5) END AS requested,
  (p_size % 3) || '.' || p_size || '.' || (p_partkey % 10) AS actual FROM part""",
}
_NEEDS = {"c_chunks": ["c_documents"], "c_identifiers": ["c_documents", "c_chunks"], "c_asked": ["c_queries"]}


def duck(sql: str) -> str:
    """``sql`` with the CTEs that it names."""
    wanted: list[str] = []
    for name in CTES:
        if name in sql:
            wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[len('WITH'):]}"
    return f"WITH {head} {body}"
