"""Queries of scans, parsers, sinks, lookups, maintenance and streaming."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X
from tessella.operators import lexical, lookup, search, vectors
from tessella.operators.options import SearchOptions, query_error
from tessella.sources import build, files, identifiers, ingest, packages, parsers, sections, segments, sinks
from tessella.streaming import rate, refresh

from .corpus import Corpus, duck
from .relational import ASKED, EXACT_ORDER, JOINED
from .retrieval import _BM, _P, _RANK, FTS, _ids
from .scalars import SAMPLES, _values

SAMPLES_ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "samples")


def _c(f):
    return lambda spark, sf_dir: f(Corpus(spark, sf_dir))


def sample_files(spark):
    """The sample tree as rows, so that executors need no folder of the driver."""
    rows = []
    for folder, _, names in sorted(os.walk(SAMPLES_ROOT)):
        for n in sorted(names):
            with open(os.path.join(folder, n), encoding="utf-8") as f:
                rows.append((os.path.relpath(os.path.join(folder, n), SAMPLES_ROOT).replace(os.sep, "/"), f.read()))
    return spark.createDataFrame(rows, "path string, content string")


def _ingested(spark):
    """The sample tree through the whole chain, and a broken file that hinders none."""
    rows = sample_files(spark).unionByName(spark.createDataFrame([("pack/broken.json", "{")], "path string, content string"))
    given = rows.withColumn("source_id", F.lit("docs")).withColumn("api_version", F.when(F.col("path") == "src/main.ts", "3.0"))
    return ingest.ingest(given, spark.createDataFrame([("docs", "stable")], "source_id string, channel string"))


def _parsed(suffix: str):
    return lambda spark, sf_dir: parsers.parse_files(sample_files(spark).filter(F.endswith("path", F.lit(suffix)))).select("path", "ordinal", "chunk_type", "title", "content", "start_line", "end_line", "identifier", "stability", "lifecycle")


def _scratch(spark) -> str:
    """A folder of its own that driver and executors share: in spark.checkpoint.dir; only a local session without one makes a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _checkout(spark, sf_dir):
    root = tempfile.mkdtemp()
    os.makedirs(f"{root}/.git/refs/heads")
    for name, text in (("HEAD", "ref: refs/heads/main\n"), ("config", '[core]\n\tbare = false\n[remote "origin"]\n\turl = https://example.org/a/docs.git\n'), ("packed-refs", f"# pack\n{'ab' * 20} refs/heads/main\n")):
        with open(f"{root}/.git/{name}", "w") as f:
            f.write(text)
    head = files.git_head(root)
    shutil.rmtree(root)
    return spark.createDataFrame([(head["head_ref"], head["revision"], head["origin"])], "head_ref string, revision string, origin string")


def _published(c: Corpus):
    root = _scratch(c.spark)

    def check(tables):
        if tables["chunks"].isEmpty():
            raise ValueError("nothing to publish")

    sinks.publish(c.spark, root, {"sources": c.sources, "chunks": c.chunks.select("chunk_id", "document_id", "content_hash")}, check)
    tables = sinks.open_current(c.spark, root)
    return tables["chunks"].groupBy().agg(F.count("*").alias("chunks")).crossJoin(tables["sources"].agg(F.count("*").alias("sources")))


def _backup(c: Corpus):
    root, target = _scratch(c.spark), _scratch(c.spark)
    sinks.publish(c.spark, root, {"sources": c.sources})
    name = sinks.backup(c.spark, root, target, retain=2)
    return c.spark.read.parquet(f"{target}/{name}/sources").select("source_id")


def _commented(c: Corpus):
    """Events as JSON files with comments, commas too many and text that looks like a comment, parsed."""
    text = F.concat(F.lit('{ /* '), "event_type", F.lit(' */ "n": '), "event_id", F.lit(', // one, "x": 2\n "props": '), "props", F.lit(', "u": "//'), "user_id", F.lit('",}'))
    return parsers.parse_files(c.table("events").select(F.concat("event_id", F.lit(".json")).alias("path"), text.alias("content")))


def _headed(c: Corpus):
    """The documents as files with a head, parsed."""
    head = F.concat(F.lit('---\ntitle: "'), "category", F.lit(" "), "doc_id", F.lit('"\napi_version: '), F.col("doc_id") % 3, F.lit("."), F.col("doc_id") % 10, F.lit(".0\n---\n"), "text")
    return parsers.parse_files(c.documents.select("path", head.alias("content")))


def _outlined(c: Corpus):
    """The documents as Markdown: every third line a heading of some level, every eleventh a code fence."""
    o = F.col("doc_id")
    line = lambda x, i: F.when(i % 11 == 7, "```").when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), ((F.floor(i / 3) + o) % 4 + 1).cast("int")), F.lit(" "), x)).otherwise(x)
    return c.documents.select("path", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("content"))


#: A heading lies below an earlier one of a higher level if none of that level or a higher one stands between them.
_SECTIONS = r"""WITH ln AS (SELECT path, i - 1 AS o, len(l) AS n, CASE WHEN (i - 1) % 11 = 7 THEN '```' WHEN (i - 1) % 3 = 0 THEN repeat('#', (((i - 1) // 3 + doc_id) % 4 + 1)::INT) || ' ' || l[i] ELSE l[i] END AS s FROM (SELECT path, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, doc_id, string_split(text, chr(10)) AS l FROM c_documents))),
 f AS (SELECT *, count(*) FILTER (regexp_matches(s, '^\s*(```|~~~)')) OVER (PARTITION BY path ORDER BY o) AS k FROM ln),
 h AS (SELECT path, o, n, length(regexp_extract(s, '^#+')) AS lvl, trim(replace(replace(regexp_replace(s, '^#+\s+#*\s*', ''), '**', ''), '`', '')) AS title FROM f WHERE k % 2 = 0 AND regexp_matches(s, '^#{1,6}\s+.')),
 below AS (SELECT a.path, a.o, string_agg(g.title, ' > ' ORDER BY g.o) AS heading_path FROM h a JOIN h g ON g.path = a.path AND (g.o = a.o OR (g.o < a.o AND g.lvl < a.lvl AND NOT EXISTS (SELECT 1 FROM h k WHERE k.path = a.path AND k.o > g.o AND k.o < a.o AND k.lvl <= g.lvl))) GROUP BY a.path, a.o),
 begins AS (SELECT path, o, n, 'section' AS chunk_type, title FROM h UNION ALL SELECT path, -1, any_value(n), 'document', 'Document' FROM ln WHERE o < coalesce((SELECT min(h.o) FROM h WHERE h.path = ln.path), n) AND regexp_matches(s, '\S') GROUP BY path)
 SELECT path, (row_number() OVER (PARTITION BY path ORDER BY o) - 1)::INT AS ordinal, chunk_type, title, coalesce(heading_path, '') AS heading_path, greatest(o, 0)::INT + 1 AS start_line, coalesce(lead(o) OVER (PARTITION BY path ORDER BY o), n)::INT AS end_line FROM begins LEFT JOIN below USING (path, o)"""


def _packages(c: Corpus):
    """Brands as packages, their parts' versions as published ones, every third a beta; brands of even number are stable."""
    version = F.concat("actual", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-beta.1."), F.col("p_partkey") % 20, F.lit(".0"))).otherwise(""))
    rows = c.versions.join(c.table("part").select("p_partkey", F.col("p_brand").alias("name")), "p_partkey").select("name", version.alias("version"), "p_partkey").groupBy("name", "version").agg(F.min("p_partkey").alias("k"))
    at = F.concat(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("k") % 1000).cast("int")).cast("string"), F.lit("T00:00:00Z"))
    rows = rows.select("name", "version", at.alias("at"), F.col("version").contains("-").alias("pre"))
    newest = lambda pre: F.max(F.when(F.col("pre") == pre, F.struct("at", "version")))["version"]
    own = rows.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("version", F.struct(F.concat("name", F.lit(" "), "at").alias("description"))))).alias("versions"), F.map_from_entries(F.collect_list(F.struct("version", "at"))).alias("time"), newest(False).alias("latest"), newest(True).alias("beta"))
    metadata = F.to_json(F.struct("name", F.create_map(F.lit("latest"), "latest", F.lit("beta"), "beta").alias("dist-tags"), "versions", "time"))
    return own.select(F.lower(F.replace("name", F.lit("#"), F.lit("-"))).alias("source_id"), F.when(F.right("name", F.lit(1)).cast("int") % 2 == 0, "stable").otherwise("preview").alias("channel"), F.array(F.lit("latest"), F.lit("beta"), F.lit("next")).alias("tags"), metadata.alias("metadata"))


def _snapshot(c: Corpus):
    """The documents of all packages beside a manifest for each, and files of no manifest, opened again."""
    root = _scratch(c.spark)
    made = packages.rendered(packages.tagged(_packages(c)))
    packages.manifests(made).select("manifest").write.text(f"{root}/manifests")
    given = made.select("source_id", "path", "content").unionByName(c.documents.select("source_id", "path", F.col("text").alias("content")))
    return packages.opened(c.spark, f"{root}/manifests", given).select("source_id", "path", "api_version", "product_version", F.length("revision").alias("n"))


_PACKAGES = """WITH v AS (SELECT name, version, strftime(DATE '2020-01-01' + (min(k) % 1000)::INT, '%Y-%m-%d') AS day, contains(version, '-') AS pre FROM (SELECT p_brand AS name, p_partkey AS k, actual || CASE WHEN p_partkey % 3 = 0 THEN '-beta.1.' || (p_partkey % 20) || '.0' ELSE '' END AS version FROM c_versions JOIN part USING (p_partkey)) GROUP BY name, version),
 t AS (SELECT *, CASE WHEN pre THEN 'beta' ELSE 'latest' END AS tag, row_number() OVER (PARTITION BY name, pre ORDER BY day DESC, version DESC) AS r FROM v),
 n AS (SELECT name, string_agg(version, ' ' ORDER BY day DESC, version DESC) AS recent FROM t WHERE r <= 12 AND pre = (right(name, 1)::INT % 2 = 1) GROUP BY name)
 SELECT {} FROM t LEFT JOIN n USING (name) WHERE r = 1"""


def _plain_files(c: Corpus):
    """The documents as files of plain text."""
    return c.documents.select("doc_id", "source_id", F.regexp_replace("path", "md$", "txt").alias("path"), F.col("text").alias("content"))


def _rebuilt(c: Corpus):
    """Files to a published and checked index; what it holds of each source."""
    tables = build.rebuild(c.spark, _scratch(c.spark), _plain_files(c).drop("doc_id"), c.sources)
    chunks = tables["chunks"].join(tables["documents"].select("document_id", "source_id"), "document_id").groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    return tables["documents"].groupBy("source_id").agg(F.count("*").alias("documents")).join(chunks, "source_id")


def _refresh(c: Corpus):
    """Two batches of changed files through a stream into an index: new ones, others with another text, others deleted."""
    root = _scratch(c.spark)
    files = _plain_files(c)
    first = files.filter("doc_id % 3 <> 0").withColumn("at", F.lit(1).cast("long"))
    text = F.when(F.col("doc_id") % 10 != 7, F.when(F.col("doc_id") % 3 == 0, F.col("content")).otherwise(F.concat("content", F.lit(" changed"))))
    second = files.filter("doc_id % 3 = 0 OR doc_id % 9 = 1 OR doc_id % 10 = 7").withColumn("content", text).withColumn("at", F.lit(2).cast("long"))
    for rows in (first, second):
        rows.drop("doc_id").coalesce(1).write.mode("append").parquet(f"{root}/in")
    refresh.refresh(c.spark, f"{root}/in", f"{root}/index", f"{root}/state", c.sources, files_per_batch=1).awaitTermination()
    return segments.Store(c.spark, f"{root}/index").table("documents").select("source_id", "path", "content_hash")


def stored_index(c: Corpus) -> segments.Store:
    """The text index of all chunks, written by two runs, of which the second replaces a quarter of the documents and adds a quarter."""
    store = segments.Store(c.spark, _scratch(c.spark))
    ids = c.documents.select("doc_id", "document_id")
    for rest, gone in (("doc_id % 4 <> 0", None), ("doc_id % 4 < 2", ids.filter("doc_id % 4 = 1").select("document_id"))):
        store.commit({"documents": c.documents.filter(rest).drop("text"), "text": c.chunks.filter(rest)}, gone)
    return store


def _vector_tables(c: Corpus):
    """Stored vectors of first chunks (a document has one vector), and the queries' own."""
    chunk = c.chunks.groupBy("doc_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"))
    e = c.table("embeddings")
    stored = e.join(chunk, F.col("vec_id") == F.col("doc_id")).select("vec_id", "chunk_id", "embedding")
    asked = c.queries.select("query_id").join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return asked, stored


def _hybrid(c: Corpus, expected: int = 64):
    asked, stored = _vector_tables(c)
    about = vectors.meta(c.table("embeddings"), "stand-in", "1")
    return lookup.hybrid_or_lexical(lambda: vectors.require(about, "stand-in", expected, "1"), c.queries, asked, stored, *_ids(c))


def _semantic_guard(c: Corpus):
    """What the check says to several expectations."""
    about = vectors.meta(c.table("embeddings"), "m", "f")
    rows = []
    for name, wanted in (("fits", ("m", 64, "f")), ("model", ("x", 64, "f")), ("size", ("m", 32, "f")), ("stale", ("m", 64, "g"))):
        try:
            vectors.require(about, *wanted)
            rows.append((name, "ok"))
        except ValueError as e:
            rows.append((name, str(e).split(":")[0]))
    return c.spark.createDataFrame(rows, "name string, outcome string")


OPTION_SETS = (
    ("plain", {}, True), ("limit 0", {"limit": 0}, False), ("limit 11", {"limit": 11}, False), ("few chars", {"max_chars": 1999}, False), ("most chars", {"max_chars": 24_000}, True), ("eleven kinds", {"kinds": ("x",) * 11}, False),
    ("six stabilities", {"stabilities": ("x",) * 6}, False), ("tier 5", {"tiers": (5,)}, False), ("all tiers", {"tiers": (1, 2, 3, 4)}, True), ("long source", {"source_id": "x" * 101}, False), ("long version", {"product_version": "x" * 51}, False), ("long prefix", {"path_prefix": "x" * 501}, False),
)


def _validated(c: Corpus):
    rows = []
    for name, given, _ in OPTION_SETS:
        try:
            SearchOptions(**given)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return c.spark.createDataFrame(rows, "name string, accepted boolean")


def _words_asked(c: Corpus):
    return c.queries.select("query_id", F.split("query", " ")[0].alias("query"))


def quoted(c: Corpus):
    """The queries with their first word quoted, as one asks for an identifier; every third asks for an example."""
    words = F.split("query", " ")
    return c.queries.select("query_id", F.concat(F.lit("`"), words[0], F.lit("` "), F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.when(F.col("query_id") % 3 == 0, " example").otherwise("")).alias("query"))


def _first_terms(c: Corpus):
    return c.identifiers.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("normalized")), " ").alias("terms"))


_EXACT30 = f"SELECT a.query_id, i.normalized, c.chunk_id, row_number() OVER (PARTITION BY a.query_id ORDER BY {EXACT_ORDER}) AS r FROM {JOINED} JOIN {ASKED} a ON a.normalized = i.normalized"


def _definition_sql(version: str | None) -> str:
    """Up to three definitions of each first word, by another way than the operator's: flags on all of the first 30 hits."""
    score = f"CASE WHEN api_version IS NULL THEN -4 WHEN api_version = '{version}' THEN 30 ELSE 15 END" if version else "0"
    fits = f"(api_version IS NULL OR api_version = '{version}' OR starts_with(api_version, '{version}.'))" if version else "true"
    return f"""SELECT query_id, place::INT AS place, chunk_id, document_id, kind, channel, stability, lifecycle, NOT st AS preview_fallback FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, tier, pos, chunk_id) AS place FROM (
 SELECT *, max(ref) OVER (PARTITION BY query_id) AS any_ref FROM (SELECT *, max(st::INT) OVER (PARTITION BY query_id) AS any_st FROM (
 SELECT h.query_id, h.pos, c.chunk_id, c.document_id, d.kind, d.channel, c.stability, c.lifecycle, d.api_version, s.tier, (d.kind NOT IN ('code', 'example'))::INT AS ref, NOT (d.channel = 'preview' OR c.stability IN ('beta', 'experimental', 'internal')) AS st
 FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS pos FROM ({_EXACT30}) WHERE r <= 120 GROUP BY query_id, chunk_id) h JOIN c_chunks c USING (chunk_id) JOIN c_documents d USING (document_id) JOIN c_sources s ON s.source_id = d.source_id
 WHERE h.pos <= 30 AND c.lifecycle NOT IN ('historical', 'removed') AND {fits})) WHERE any_st = st::INT) WHERE any_ref = ref) WHERE place <= 3"""


def _examples_sql(without: str, preview: str, most: int) -> str:
    return f"""SELECT query_id, place::INT AS place, chunk_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY r) AS k FROM (
 SELECT a.query_id, e.* FROM {ASKED} a JOIN (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY tier, CASE channel WHEN 'stable' THEN 0 WHEN 'preview' THEN 1 ELSE 2 END, ordinal, chunk_id) AS r FROM (
 SELECT DISTINCT i.normalized, c.chunk_id, c.document_id, s.tier, d.channel, c.ordinal, c.stability, c.lifecycle FROM {JOINED} WHERE d.kind IN ('code', 'example'))) e ON e.normalized = a.normalized
 WHERE e.r <= 30 AND ({preview} OR NOT (e.channel = 'preview' OR e.stability IN ('beta', 'experimental', 'internal'))) AND e.lifecycle NOT IN ('historical', 'removed') {without})) WHERE k = 1) WHERE place <= {most}"""


ID_SQL = ", ".join(f"({i}, '{s}')" for i, s in enumerate(["chk", "doc"]))

PAIRS = {
    "scan_local_files": (lambda spark, sf_dir: files.scan(spark, SAMPLES_ROOT).select("path", "length"), None),
    "scan_documents": (lambda spark, sf_dir: files.with_metadata(parsers.parse_files(files.scan(spark, SAMPLES_ROOT)), spark.createDataFrame([("docs/guide.md", "1.2.0")], "path string, api_version string")).select("path", "ordinal", "title", "api_version"), None),
    "scan_git_checkout": (_checkout, None),
    "scan_git_source": (lambda spark, sf_dir: files.scan_checkout(spark, SAMPLES_ROOT, ["docs/**", "pack/**"], ["**/schema.json"], "https://example.org/a/docs.git", "main").select("path", "canonical_url"), None),
    "registry_file": (lambda spark, sf_dir: files.select_registry(files.load_registry(spark, f"{SAMPLES_ROOT}/registry.json"), False).select("id", "tier", "branch"), "SELECT 'docs' AS id, 1 AS tier, 'main' AS branch"),
    "npm_render": (
        lambda spark, sf_dir: files.render_package(Corpus(spark, sf_dir).versions.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.lit("latest").alias("tag"), F.col("actual").alias("version"), F.lit("About").alias("description"), F.create_map(F.lit("b"), F.col("actual")).alias("peers"), F.array("actual").alias("recent"))),
        duck("SELECT 'p' || p_partkey AS name, concat_ws(chr(10), '---', 'title: p' || p_partkey || ' latest', 'api_version: ' || actual, '---', '# p' || p_partkey, 'About', '## Peer dependencies', '- `b`: `' || actual || '`', '## Recent versions', '- `' || actual || '`') AS document FROM c_versions"),
    ),
    "package_tags": (
        _c(lambda c: packages.tagged(_packages(c)).select("name", "tag", "version", "track", "product_version", "path", F.array_join(F.transform("recent", lambda e: e["version"]), " ").alias("recent"), "description", "known")),
        duck(_PACKAGES.format("name, tag, version, CASE WHEN pre THEN split_part(version, '-', 1) || '-beta' ELSE version END AS track, CASE WHEN pre THEN split_part(version, '-beta.', 2) END AS product_version, 'metadata/' || name || '/' || tag || '.md' AS path, coalesce(recent, '') AS recent, name || ' ' || day || 'T00:00:00Z' AS description, true AS known")),
    ),
    "package_snapshot": (_c(_snapshot), duck(_PACKAGES.format("lower(replace(name, '#', '-')) AS source_id, 'metadata/' || name || '/' || tag || '.md' AS path, version AS api_version, CASE WHEN pre THEN split_part(version, '-beta.', 2) END AS product_version, 71 AS n"))),
    "npm_revision": (
        lambda spark, sf_dir: files.snapshot_revision(spark.createDataFrame([("b", "latest", "2.0.0"), ("a", "beta", "1.0.0")], "name string, tag string, version string")),
        """WITH n AS (SELECT name, sha256('[{"tag":"' || tag || '","version":"' || version || '"}]') AS h, substr(sha256(name), 1, 3) AS b FROM (VALUES ('a', 'beta', '1.0.0'), ('b', 'latest', '2.0.0')) t(name, tag, version)), w AS (SELECT b, sha256(string_agg(name || ' ' || h, chr(10) ORDER BY name)) AS h FROM n GROUP BY b) SELECT sha256(string_agg(b || ' ' || h, chr(10) ORDER BY b)) AS revision FROM w""",
    ),
    "publish_atomic": (_c(_published), duck("SELECT (SELECT count(*) FROM c_chunks) AS chunks, (SELECT count(*) FROM c_sources) AS sources")),
    "backup_copy": (_c(_backup), duck("SELECT source_id FROM c_sources")),
    "http_json_result": (
        _c(lambda c: c.documents.withColumn("error", F.when(F.col("doc_id") % 7 == 3, F.lit("no access to https://user:secret@host/x")).when(F.col("doc_id") % 7 == 4, F.lit("near SELECT * FROM t")))
            .select("document_id", X.json_result(F.struct("document_id", "kind"), F.when(F.col("doc_id") % 7 == 3, "FORBIDDEN").when(F.col("doc_id") % 7 == 4, "INTERNAL"), F.col("error")).alias("body"))),
        duck("""SELECT document_id, CASE doc_id % 7 WHEN 3 THEN '{"ok":false,"error":{"code":"FORBIDDEN","message":"no access to https://host/x"}}' WHEN 4 THEN '{"ok":false,"error":{"code":"INTERNAL","message":"near [redacted SQL]"}}' ELSE '{"ok":true,"result":{"document_id":"' || document_id || '","kind":"' || kind || '"}}' END AS body FROM c_documents"""),
    ),
    # parsers
    "parse_markdown": (_parsed(".md"), None),
    "parse_script_api": (_parsed("World.md"), None),
    "parse_json_doc": (_parsed(".json"), None),
    "schema_property_chunks": (_parsed("schema.json"), None),
    "parse_code": (_parsed(".ts"), None),
    "parse_plain": (_c(lambda c: c.documents.select("document_id", F.lit(0).alias("ordinal"), F.lit("document").alias("chunk_type"), F.col("text").alias("content"))), duck("SELECT document_id, 0 AS ordinal, 'document' AS chunk_type, text AS content FROM c_documents")),
    "ingest_document": (lambda spark, sf_dir: _ingested(spark)["documents"].select("path", "title", "kind", "category", "stability", "api_version", "product_version", F.array_join("identifiers", "|").alias("identifiers"), "chunks"), None),
    "ingest_identifiers": (lambda spark, sf_dir: _ingested(spark)["identifiers"].select("document_id", "identifier", "normalized", "identifier_kind", "is_primary"), None),
    "corpus_markdown": (_c(lambda c: parsers.parse_files(c.documents.select("path", F.col("text").alias("content"))).select("path", "ordinal", "chunk_type", "start_line", "end_line")), None),
    "markdown_sections_sql": (_c(lambda c: sections.sections(_outlined(c)).withColumn("heading_path", F.array_join("heading_path", " > "))), duck(_SECTIONS)),
    "json_entries": (_c(lambda c: c.table("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v")).select("event_id", "k", "v", F.concat(F.lit("/"), X.json_pointer_escape(F.col("k"))).alias("pointer"))), "SELECT event_id, k, json_extract_string(props, '$.' || k) AS v, '/' || k AS pointer FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"),
    "extract_identifiers": (lambda spark, sf_dir: spark.createDataFrame(list(enumerate(SAMPLES)), "sid int, s string").select("sid", F.array_join(X.extract_identifiers(F.col("s")), "|").alias("found")), None),
    "extract_code_identifiers": (lambda spark, sf_dir: spark.createDataFrame([(i,) for i in identifiers.code(open(f"{SAMPLES_ROOT}/src/main.ts").read())], "identifier string"), None),
    "extract_json_identifiers": (lambda spark, sf_dir: spark.createDataFrame([(i,) for i in identifiers.of_json(parsers.read_json(open(f"{SAMPLES_ROOT}/pack/entities/pig.json").read()))], "identifier string"), None),
    "jsonc_parse": (
        _c(lambda c: _commented(c).select("path", "content")),
        "SELECT event_id || '.json' AS path, '{' || chr(10) || '  \"n\": ' || event_id || ',' || chr(10) || '  \"props\": {' || chr(10) || '    \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '  },' || chr(10) || '  \"u\": \"//' || user_id || '\"' || chr(10) || '}' AS content FROM events",
    ),
    "front_matter": (
        _c(lambda c: _headed(c).filter("ordinal = 0").select("path", F.explode("attributes").alias("k", "v"))),
        duck("SELECT path, 'title' AS k, category || ' ' || doc_id AS v FROM c_documents UNION ALL SELECT path, 'api_version', (doc_id % 3) || '.' || (doc_id % 10) || '.0' FROM c_documents"),
    ),
    # arrays and sets
    "distinct_identifiers": (_c(lambda c: c.chunks.select("chunk_id", F.size(F.array_distinct(X.fts_tokens(F.col("content")))).alias("n"))), duck("SELECT chunk_id, len(list_distinct(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+')))::INT AS n FROM c_chunks")),
    "set_intersection_size": (
        _c(lambda c: c.chunks.select("chunk_id", F.size(F.array_intersect(X.fts_tokens(F.col("content")), X.fts_tokens(F.col("title")))).alias("n"))),
        duck("SELECT chunk_id, len(list_intersect(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+'), regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}]+')))::INT AS n FROM c_chunks"),
    ),
    "agg_alias_terms": (_c(_first_terms), duck("SELECT chunk_id, string_agg(DISTINCT normalized, ' ' ORDER BY normalized) AS terms FROM c_identifiers GROUP BY chunk_id")),
    "agg_doc_identifiers": (
        _c(lambda c: c.chunks.groupBy("document_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "identifier"))), lambda x: x["identifier"])), "|").alias("identifiers"))),
        duck("SELECT document_id, string_agg(identifier, '|' ORDER BY o) AS identifiers FROM (SELECT document_id, identifier, min(ordinal) AS o FROM c_chunks WHERE identifier IS NOT NULL GROUP BY ALL) GROUP BY document_id UNION ALL SELECT document_id, '' FROM c_chunks GROUP BY document_id HAVING count(identifier) = 0"),
    ),
    "agg_fingerprint": (
        _c(lambda c: sinks.fingerprint(c.chunks)),
        duck(
            "WITH f AS (SELECT substr(sha256(chunk_id), 1, 4) AS fine, sha256(string_agg(chunk_id || chr(0) || content_hash, chr(10) ORDER BY chunk_id || chr(0) || content_hash)) AS h, count(*) AS n FROM c_chunks GROUP BY 1), g AS (SELECT substr(fine, 1, 2) AS coarse, sha256(string_agg(fine || h, chr(10) ORDER BY fine || h)) AS h, sum(n) AS n FROM f GROUP BY 1) SELECT sha256(sha256(string_agg(coarse || h, chr(10) ORDER BY coarse || h)) || 'count:' || sum(n)) AS fingerprint FROM g"
        ),
    ),
    "fts_fields": (
        _c(lambda c: lexical.fields(c.chunks).select("chunk_id", *[F.array_join(f, " ").alias(f) for f in lexical.WEIGHTS])),
        duck("SELECT chunk_id, " + ", ".join(f"array_to_string({FTS.format(f)}, ' ') AS {f}" for f in lexical.WEIGHTS) + " FROM c_chunks"),
    ),
    "project_public_result": (
        _c(lambda c: search.public(c.chunks.filter("ordinal = 0").select(F.lit(1).alias("query_id"), "chunk_id", "document_id", (F.col("doc_id") / 7).cast("decimal(20,8)").alias("score"), F.lit(False).alias("exact")), c.chunks, c.documents, c.sources).withColumn("score", F.col("score").cast("double"))),
        duck("SELECT 1 AS query_id, chunk_id, document_id, round((c.doc_id / 7)::DECIMAL(20,8), 3)::DOUBLE AS score, false AS exact_match, c.title, identifier, c.stability, c.lifecycle, d.source_id, d.path, kind, category, d.channel, NULL AS canonical_url, NULL AS revision_url, api_package, api_version, product_version, s.name AS source_name, source_type, tier AS source_tier, repository, revision FROM c_chunks c JOIN c_documents d USING (document_id) JOIN c_sources s ON s.source_id = d.source_id WHERE ordinal = 0"),
    ),
    "validate_options": (_c(_validated), "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, _, ok in OPTION_SETS) + ") t(name, accepted)"),
    "validate_queries": (_c(lambda c: c.table("documents").select("doc_id", query_error(F.col("text")).alias("error"))), "SELECT doc_id, CASE WHEN text IS NULL OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 1 OR length(text) > 500 THEN 'query must have 1 to 500 characters' END AS error FROM documents"),
    "score_exact": (
        _c(lambda c: search.exact_hits(_words_asked(c), *_ids(c)).select("query_id", "chunk_id", (1000 - 5 * (F.col("pos") - 1) + 2 * F.col("primary")).alias("score"))),
        duck(f"SELECT query_id, chunk_id, 1000 - 5 * (pos - 1) + 2 AS score FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS pos FROM ({_EXACT30}) WHERE r <= 120 GROUP BY query_id, chunk_id) WHERE pos <= 30"),
    ),
    "version_bonus": (_c(lambda c: c.versions.select("p_partkey", (Y.version_score(F.col("requested"), F.col("actual")) + Y.version_score(F.lit(None).cast("string"), F.col("actual"))).alias("points"))), None),
    "merge_adjacent": (_c(lambda c: lookup.merge_only(search.candidates(c.queries, *_ids(c)).select("query_id", "chunk_id", "document_id", "ordinal", "content", "score", "exact", "tier"))), None),
    "select_results": (_c(lambda c: search.search(c.queries, *_ids(c), SearchOptions(limit=3, max_chars=2000)).select("query_id", "pos", "chunk_id", "truncated")), None),
    "hybrid_search": (_c(_hybrid), None),
    "semantic_optional": (_c(lambda c: _hybrid(c, expected=1).select("query_id", "pos", "chunk_id", "exact")), None),
    "get_definition": (_c(lambda c: lookup.definitions(_words_asked(c), *_ids(c), SearchOptions(api_version="1"))), duck(_definition_sql("1"))),
    "definition_report": (
        _c(lambda c: lookup.definition_report(_words_asked(c), lookup.definitions(_words_asked(c), *_ids(c)))),
        duck(f"SELECT q.query_id, coalesce(n, 0) AS definitions, coalesce(s, false) AS stable_definition_found, CASE WHEN fb THEN '{lookup.NO_STABLE}' WHEN n IS NULL THEN '{lookup.NOTHING}' END AS warning FROM c_queries q LEFT JOIN (SELECT query_id, count(*) AS n, bool_or(channel = 'stable' AND stability = 'stable' AND lifecycle = 'active') AS s, bool_or(preview_fallback) AS fb FROM ({_definition_sql(None)}) GROUP BY query_id) d USING (query_id)"),
    ),
    "definition_examples": (_c(lambda c: lookup.examples(_words_asked(c), *_ids(c))), duck(_examples_sql("", "false", 2))),
    "find_examples": (
        _c(lambda c: lookup.examples(_words_asked(c), *_ids(c), excluded=lookup.definitions(_words_asked(c), *_ids(c)), most=5)),
        duck("WITH de AS (" + _definition_sql(None) + "), wd AS (SELECT query_id, bool_or(channel = 'preview') AS pv FROM de GROUP BY query_id) " + _examples_sql("AND NOT EXISTS (SELECT 1 FROM de WHERE de.query_id = a.query_id AND de.chunk_id = e.chunk_id)", "coalesce((SELECT pv FROM wd WHERE wd.query_id = a.query_id), false)", 5)),
    ),
    "example_search": (_c(lambda c: lookup.find_examples(quoted(c), *_ids(c))), None),
    "semantic_guard": (_c(_semantic_guard), "SELECT * FROM (VALUES ('fits', 'ok'), ('model', 'SEMANTIC_MODEL_MISMATCH'), ('size', 'SEMANTIC_DIMENSION_MISMATCH'), ('stale', 'SEMANTIC_INDEX_STALE')) t(name, outcome)"),
    "semantic_meta": (_c(lambda c: vectors.meta(c.table("embeddings"), "m", "f")), "SELECT 'schema_version' AS key, '1' AS value UNION ALL SELECT 'model', 'm' UNION ALL SELECT 'core_fingerprint', 'f' UNION ALL SELECT 'dimensions', max(len(embedding))::VARCHAR FROM embeddings UNION ALL SELECT 'vectors', count(*)::VARCHAR FROM embeddings"),
    # maintenance and streams
    "rebuild_full": (_c(_rebuilt), duck("SELECT source_id, count(*) AS documents, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM c_documents GROUP BY source_id")),
    "stored_bm25": (
        _c(lambda c: lexical.ranked(lexical.bm25_stored(c.asked, stored_index(c)), 50).select("query_id", "chunk_id", "pos", F.round("score", 6).alias("score"))),
        duck(f"WITH {_BM} SELECT query_id, chunk_id, r::INT AS pos, round(score, 6) AS score FROM (SELECT *, {_RANK} AS r FROM bm) WHERE r <= 50"),
    ),
    "stored_postings": (
        _c(lambda c: stored_index(c).postings(c.asked.select(F.explode(X.fts_tokens(F.col("query"))).alias("term"))).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("frequency").alias("weight"), F.sum(F.size("places")).cast("long").alias("places"))),
        duck(f"SELECT term, count(DISTINCT chunk_id) AS chunks, sum(w)::DOUBLE AS weight, count(*) AS places FROM ({_P}) WHERE term IN (SELECT unnest({FTS.format('query').replace('{{', '{').replace('}}', '}')}) FROM c_asked) GROUP BY term"),
    ),
    "rate_limit_windows": (_c(lambda c: rate.rate_limited(c.table("events"), 1)), None),
    "tumbling_counts": (_c(lambda c: rate.tumbling_counts(c.table("events"))), "SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "incremental_refresh": (
        _c(_refresh),
        duck("SELECT source_id, regexp_replace(path, 'md$', 'txt') AS path, 'sha256:' || sha256(text || CASE WHEN doc_id % 3 <> 0 AND doc_id % 9 = 1 THEN ' changed' ELSE '' END) AS content_hash FROM c_documents WHERE doc_id % 10 <> 7"),
    ),
}
