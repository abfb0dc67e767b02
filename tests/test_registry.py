"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from tessella.operators import search
from tessella.operators.options import SearchOptions
from tessella.plans import registry
from tessella.plans.corpus import Corpus, duck

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(found):
    return Counter(tuple(map(plain, r)) for r in found)


def greedy(candidates, limit, budget):
    """The results of one query from its candidates, by the rules written down once more: (chunk_id, merged, excerpt length)."""
    ranked = sorted(candidates, key=lambda c: (-c.score, c.tier, c.chunk_id))
    place = {(c.document_id, c.ordinal): c for c in ranked}
    gone, entries = set(), []
    for c in ranked:
        if c.chunk_id in gone:
            continue
        beside = [place[k] for k in ((c.document_id, c.ordinal - 1), (c.document_id, c.ordinal + 1)) if k in place and place[k].chunk_id not in gone]
        group, chars = [c], len(c.content)
        for n in sorted(beside, key=lambda n: -n.score):
            if (n.score >= 12 or c.exact or n.exact) and chars + 2 + len(n.content) <= 3200:
                group.append(n)
                chars += 2 + len(n.content)
        group.sort(key=lambda n: n.ordinal)
        gone |= {n.chunk_id for n in group}
        entries.append((c, [n.chunk_id for n in group if n is not c], "\n\n".join(n.content for n in group)))
    taken, used = [], 0
    for c, merged, text in entries:
        if len(taken) == limit or budget - used < 200:
            break
        if not c.exact and sum(t[0].document_id == c.document_id for t in taken) > 1:
            continue
        about = lambda x, t: {"text": t, "channel": x.channel, "api_version": x.api_version, "product_version": x.product_version, "identifier": x.identifier}
        if any(search.similar(about(c, text), about(o, t)) for o, _, t, _ in taken):
            continue
        part = search.excerpt(text, c.query, min(2400 if merged else 1600, budget - used))
        used += len(part)
        taken.append((c, merged, text, part))
    return [(c.chunk_id, ",".join(m), part) for c, m, _, part in taken], len(taken) < len(entries)


def search_of(c, options, queries=None):
    want = []
    by_query = {}
    for r in search.candidates(queries or c.queries, c.identifiers, c.chunks, c.documents, c.sources, options).collect():
        by_query.setdefault(r.query_id, []).append(r)
    for q, rows_ in by_query.items():
        found, cut = greedy(rows_, options.limit, options.max_chars)
        want += [(q, i, chunk, merged, part, cut) for i, (chunk, merged, part) in enumerate(found, 1)]
    return sorted(want)


def same_search(spark, got):
    assert sorted((r.query_id, r.pos, r.chunk_id, r.merged, r.excerpt, r.truncated) for r in got) == search_of(Corpus(spark, SF), SearchOptions())


def few_results(spark, got):
    assert sorted((r.query_id, r.pos, r.chunk_id, r.truncated) for r in got) == [(q, i, chunk, cut) for q, i, chunk, _, _, cut in search_of(Corpus(spark, SF), SearchOptions(limit=3, max_chars=2000))]


def merged_candidates(spark, got):
    want = [w[:4] for w in search_of(Corpus(spark, SF), SearchOptions(limit=10, max_chars=24_000))]
    have = {(r.query_id, r.chunk_id): r.merged for r in got}
    assert all(have[q, chunk] == merged for q, _, chunk, merged in want) and len(have) == len(got)


def optioned(spark, got):
    assert got and all(r.channel == "preview" and r.stability in ("stable", "beta") and (r.api_version is None or r.api_version.startswith("1.")) for r in got)
    # the request for version 1 is worth 15 where it fits and costs 4 where nothing is known
    c = Corpus(spark, SF)
    plain_ = {(r.query_id, r.chunk_id): r.score for r in search.candidates(c.queries, c.identifiers, c.chunks, c.documents, c.sources, SearchOptions(channel="preview", include_historical=True, tiers=(1, 2, 3, 4), stabilities=("stable", "beta"), path_prefix="creator")).collect()}
    assert all(abs(r.score - plain_[r.query_id, r.chunk_id] - (15 if r.api_version else -4)) < 1e-3 for r in got)


def hybrid(spark, got):
    """The fused ranking by hand: reciprocal ranks of full text and neighbours, at most two per document, in the budget."""
    c = Corpus(spark, SF)
    words = {(r.query_id, r.chunk_id): (r.pos, r.exact) for r in search.search(c.queries, c.identifiers, c.chunks, c.documents, c.sources, SearchOptions(limit=10, max_chars=24_000)).collect()}
    from tessella.operators import vectors
    from tessella.plans.pipelines import _vector_tables

    asked, stored = _vector_tables(c)
    near = {(r.query_id, r.chunk_id): r.pos for r in vectors.knn_cosine(stored, asked).join(stored.select("vec_id", "chunk_id"), "vec_id").collect()}
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.pos)):
        key = (r.query_id, r.chunk_id)
        fused = (0.55 / (60 + words[key][0]) if key in words else 0) + (0.45 / (60 + near[key]) if key in near else 0)
        assert key in words or key in near
        assert r.exact or abs(r.score - round(fused * 100_000, 3)) < 2e-3
        by_query.setdefault(r.query_id, []).append(r)
    for results in by_query.values():
        assert [r.pos for r in results] == list(range(1, len(results) + 1)) and len(results) <= 5 and sum(len(r.excerpt) for r in results) <= 10_000
        scores = [(r.exact, r.score) for r in results if not r.exact]
        assert scores == sorted(scores, reverse=True)
        assert all(sum(o.document_id == r.document_id for o in results) <= 2 for r in results)


def worked_examples(spark, got):
    """Linked examples by the SQL of their own query, then the ranking by hand, five in all, each chunk once."""
    import re

    from tessella.plans import pipelines

    c, db = Corpus(spark, SF), duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    asked = {r.query_id: r.query for r in pipelines.quoted(c).collect()}
    named = {q for q, text in asked.items() if re.match(r"`[A-Za-z_$][A-Za-z0-9_$]+`", text)}
    want = {q: [] for q in asked}
    for q, place, chunk in sorted(db.execute(f"SELECT query_id, place, chunk_id FROM ({registry.ORACLE_SQL['find_examples']})").fetchall()):
        if q in named and place <= 2:
            want[q].append((chunk, True, None))
    worded = spark.createDataFrame([(q, t if t.endswith("example") else t + " example") for q, t in asked.items()], "query_id long, query string")
    for q, _, chunk, _, part, _ in search_of(c, SearchOptions(limit=10, kinds=("example", "code"), max_chars=24_000), worded):
        if chunk not in [w[0] for w in want[q]]:
            want[q].append((chunk, False, part))
    have = {q: [] for q in asked}
    for r in sorted(got, key=lambda r: (r.query_id, r.place)):
        have[r.query_id].append((r.chunk_id, r.linked, None if r.linked else r.excerpt))
        assert r.truncated == (len(want[r.query_id]) >= 5)
    assert have == {q: w[:5] for q, w in want.items()}
    assert any(w[1] for rows_ in have.values() for w in rows_) and any(not w[1] for rows_ in have.values() for w in rows_)


def without_vectors(spark, got):
    want = search_of(Corpus(spark, SF), SearchOptions())
    assert sorted((r.query_id, r.pos, r.chunk_id) for r in got) == [w[:3] for w in want]


def limited(spark, got):
    """Windows of a minute from a client's first request on, one request each."""
    state = {}
    for r in sorted(got, key=lambda r: (r.user_id, r.ms, r.event_id)):
        begin, n = state.get(r.user_id, (None, 0))
        begin, n = (r.ms, 0) if begin is None or r.ms - begin >= 60_000 else (begin, n)
        state[r.user_id] = (begin, n + 1)
        assert r.accepted == (n < 1) and r.retry_after == (0 if r.accepted else max(1, math.ceil((60_000 - (r.ms - begin)) / 1000)))
    assert len(got) == 1000


def version_points(spark, got):
    c = Corpus(spark, SF)
    part = {r.p_partkey: (r.requested, r.actual) for r in c.versions.collect()}

    def points(wanted, have):
        if wanted is None:
            return 0
        w = wanted.removeprefix("v").split(".")
        return 30 if wanted.removeprefix("v") == have else 15 if len(w) < 3 and have.split(".")[: len(w)] == w else -1000

    assert {r.p_partkey: r.points for r in got} == {k: points(*v) for k, v in part.items()}


def has(n, **some):
    """n rows, and for each column values that are among its own."""

    def check(spark, got):
        assert len(got) == n
        for column, values in some.items():
            assert set(values) <= {r[column] for r in got}, column

    return check


#: What the rows of queries without SQL must be.
FACTS = {
    "search": same_search, "select_results": few_results, "merge_adjacent": merged_candidates, "search_options": optioned, "hybrid_search": hybrid, "example_search": worked_examples, "semantic_optional": without_vectors, "rate_limit_windows": limited, "version_bonus": version_points,
    "quality_suite": has(2, kind=["exact", "natural"]),
    "plan_lookup": has(14, intent=["definition", "example"], recommended_tool=["get_definition", "search"]),
    "scan_local_files": has(8, path=["registry.json", "docs/guide.md", "src/main.ts", "x/ScriptAPI/demo/core/World.md"]),
    "scan_documents": has(22, api_version=["1.2.0", None]),
    "scan_git_checkout": has(1, head_ref=["refs/heads/main"], revision=["ab" * 20]),
    "scan_git_source": has(2, canonical_url=["https://example.org/a/docs/blob/main/docs/guide.md"]),
    "parse_markdown": has(9, title=["Document", "Blocks"]),
    "parse_script_api": has(6, chunk_type=["api-overview", "api-member"]),
    "parse_json_doc": has(8, title=["Block — name", "registry.json"]),
    "schema_property_chunks": has(3, identifier=["Block", "Block.name"]),
    "parse_code": has(4, title=["greet", "Point"]),
    "ingest_document": has(9, title=["registry.json", "notes.txt", "Guide to blocks"], api_version=["1.2.0", "3.0"], chunks=[0]),
    "ingest_identifiers": has(64, normalized=["world.trial", "demo:pig", "minecraft:entity"]),
    "corpus_markdown": has(200, chunk_type=["document"]),
    "extract_identifiers": has(14, found=["World.afterEvents.playerSpawn|World.afterEvents|playerSpawn"]),
    "extract_code_identifiers": has(16, identifier=["@minecraft/server", "@minecraft/server.world", "ui"]),
    "extract_json_identifiers": has(4, identifier=["minecraft:entity", "demo:pig"]),
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert rows(df.collect()) == rows(db.execute(f"SELECT {columns} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    else:
        FACTS[name](spark, df.collect())


def test_ctes_only_where_named():
    assert duck("SELECT 1") == "SELECT 1"
    assert duck("SELECT * FROM c_chunks").count(" AS (") == 2


def test_entry_without_session():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
