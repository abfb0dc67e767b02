"""The ranked search pipeline over batches of queries.

Candidates come from exact identifiers and full text; scores, filters and
bonuses are column expressions; only the greedy end (merging neighbours, leaving
out near duplicates, the character budget), which depends on what was accepted
before, runs in a grouped function, on at most 150 candidates of one query.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X

from . import lexical
from .keep import kept
from .options import SearchOptions, query_error

MERGE_CHARS, NEIGHBOUR_SCORE, RESULT_CHARS, MERGED_CHARS = 3200, 12, 1600, 2400
RESULTS = "query_id long, pos int, chunk_id string, document_id string, score double, exact boolean, merged string, excerpt string, truncated boolean"


def exact_hits(queries: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, limit: int = 30) -> DataFrame:
    """Chunks that carry the query as an identifier, ranked by lifecycle, stability, channel, tier, primacy, alias type and ordinal.

    A name is looked up once, however many queries ask for it.  Of the first 4 * limit
    identifiers (200 at most) each chunk counts once.  The names of few queries go to the identifiers,
    and what is found goes to the chunks, so that neither table is shuffled.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    asked = queries.select("query_id", X.normalize_identifier(F.col("query")).alias("normalized")).filter("normalized <> ''")
    found = identifiers.select("normalized", "is_primary", "alias_type", "chunk_id").join(lexical.bounded(asked.select("normalized").distinct(), queries), "normalized")
    rows = (
        lexical.sent(found)
        .join(chunks.select("chunk_id", "ordinal", "stability", "lifecycle", "document_id", F.col("identifier").isNotNull().alias("named")), "chunk_id")
        .join(documents.select("document_id", "source_id", "channel"), "document_id").join(sources.select("source_id", "tier"), "source_id")
    )
    rank = lambda c, names: Y.first_of([(F.col(c) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(len(names)))
    order = Window.partitionBy("normalized").orderBy(
        rank("lifecycle", ("active", "deprecated", "historical")), rank("stability", ("stable", "beta", "experimental")), rank("channel", ("stable", "preview")),
        "tier", F.desc("is_primary"), rank("alias_type", ("exact",)), "ordinal", "chunk_id",
    )
    first = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= min(200, 4 * limit)).groupBy("normalized", "chunk_id")
    # a chunk with a name of its own counts as primary whatever identifier found it
    first = first.agg(F.min(F.struct("at", F.when(F.col("named"), 1).otherwise(F.col("is_primary")).alias("primary"))).alias("m")).select("normalized", "chunk_id", "m.at", "m.primary")
    few = first.withColumn("pos", F.row_number().over(Window.partitionBy("normalized").orderBy("at"))).filter(F.col("pos") <= limit)
    return few.join(asked, "normalized").select("query_id", "chunk_id", "pos", "primary")


def candidates(queries: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Scored and filtered candidates of each query; texts are joined after the ranks are known.

    Queries may have a column ``module``: the package that a query's candidates must be of, where it is not null.
    """
    own = [c for c in ("module",) if c in queries.columns]
    queries = queries.filter(query_error(F.col("query")).isNull()).withColumn("query", X.js_trim(F.col("query")))
    exact = exact_hits(queries, identifiers, chunks, documents, sources, 50 if options.narrow or own else 30).withColumnRenamed("pos", "e")
    wide = 2 if options.narrow or own else 1
    hits = kept(lexical.ranked(lexical.bm25(queries, chunks), 50 * wide))
    none = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").filter(F.size(X.meaningful_terms(F.col("query"))) > 1)
    hits = hits.select("query_id", "chunk_id", "pos").unionByName(lexical.fallback(none, chunks, 15 * wide, 50 * wide).select("query_id", "chunk_id", "pos")).withColumnRenamed("pos", "l")
    both = exact.join(hits, ["query_id", "chunk_id"], "full_outer")
    base = F.when(F.col("e").isNotNull(), 1000 - 5.0 * (F.col("e") - 1) + 2 * F.col("primary") + F.coalesce(50.0 / F.col("l"), F.lit(0.0))).otherwise(100.0 / F.col("l"))
    rows = (
        lexical.bounded(both, queries).join(chunks.select("chunk_id", "document_id", "ordinal", "title", "identifier", "content", "stability", "lifecycle"), "chunk_id")
        .join(documents.select("document_id", "source_id", "path", "kind", "category", "channel", *[v for v in ("api_version", "product_version", "api_package") if v in documents.columns]), "document_id")
        .join(sources.select("source_id", "tier", "source_type"), "source_id").join(queries.select("query_id", "query", *own), "query_id")
    )
    for v in ("api_version", "product_version", "api_package"):
        if v not in rows.columns:
            rows = rows.withColumn(v, F.lit(None).cast("string"))
    c = {n: F.col(n) for n in rows.columns}
    intent = Y.intent_flags(c["query"])
    same = F.when(X.normalize_identifier(c["identifier"]) == X.normalize_identifier(c["query"]), 20.0).otherwise(0.0)
    score = base + Y.meta_bonus(c["tier"], c["lifecycle"], c["stability"], c["channel"]) + same + options.version_bonus(c) + Y.intent_bonus(intent, c, X.meaningful_terms(c["query"]))
    of_module = Y.same_text(c["module"], c["api_package"]) if own else F.lit(True)
    return rows.filter(options.allowed(c, c["query"]) & of_module).withColumn("score", score).withColumn("exact", F.col("e").isNotNull())


_WORDS = re.compile(r"[\w@.$:-]+")


def words_of(text: str) -> list[str]:
    return [w for w in _WORDS.findall(text.lower()) if len(w) > 1]


def similar(a: dict, b: dict, threshold: float = 0.9) -> bool:
    """Near-duplicate evidence: comparable, and alike in 3-word shingles."""
    for field in ("channel", "api_version", "product_version"):
        if a.get(field) and b.get(field) and a[field] != b[field]:
            return False
    if a["identifier"] and b["identifier"] and a["identifier"].lower() != b["identifier"].lower():
        return False
    x, y = words_of(a["text"]), words_of(b["text"])
    if not x or not y:
        return False
    if x == y:
        return True
    if min(len(x), len(y)) < 12 or min(len(x), len(y)) / max(len(x), len(y)) < 0.8:
        return False
    sx, sy = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (x, y))
    return len(sx & sy) / len(sx | sy) >= threshold


def merge_adjacent(ranked: list[dict]) -> list[dict]:
    """Each candidate in rank order takes its free neighbours (ordinal - 1, + 1) while the texts stay short; not sorted again."""
    place = {(c["document_id"], c["ordinal"]): c for c in ranked}
    used: set[str] = set()
    out = []
    for c in ranked:
        if c["chunk_id"] in used:
            continue
        near = [n for n in (place.get((c["document_id"], c["ordinal"] + d)) for d in (-1, 1)) if n and n["chunk_id"] not in used and (n["score"] >= NEIGHBOUR_SCORE or c["exact"] or n["exact"])]
        group, size = [c], len(c["content"])
        for n in sorted(near, key=lambda n: -n["score"]):
            if size + 2 + len(n["content"]) <= MERGE_CHARS:
                group.append(n)
                size += 2 + len(n["content"])
        others = [g for g in sorted(group, key=lambda g: g["ordinal"]) if g is not c]
        text = "\n\n".join(g["content"] for g in sorted(group, key=lambda g: g["ordinal"]))
        out.append(c | {"text": text, "merged": [g["chunk_id"] for g in others], "score": c["score"] + 0.1 * sum(g["score"] for g in others)})
        used.update(g["chunk_id"] for g in group)
    return out


def excerpt(content: str, query: str, most: int) -> str:
    """A window of at most ``most`` characters around the place where a query token first stands, or the head."""
    tokens = _WORDS.findall(query.lower())
    spot = re.search("|".join(map(re.escape, tokens)), content.lower()) if tokens else None
    if len(content) <= most:
        return content
    if not spot:
        return shortened(content, most)
    # three tenths of the window lie before the token, unless the text ends sooner
    begin = min(max(spot.start() - most * 3 // 10, 0), len(content) - most)
    window = content[begin : begin + most].strip()
    return "…" * (begin > 0) + window + "…" * (begin + most < len(content))


def shortened(text: str, most: int) -> str:
    """At most ``most`` characters, the last one an ellipsis if something was cut."""
    return text if len(text) <= most else text[: max(0, most - 1)].rstrip() + "…"


def select_results(ranked: list[dict], query: str, limit: int, budget: int) -> tuple[list[tuple[dict, str]], bool]:
    """Greedy choice in rank order: limit, two per document unless exact, no near duplicates, character budget."""
    chosen: list[tuple[dict, str]] = []
    per: dict[str, int] = {}
    size, cut = 0, False
    for c in ranked:
        if len(chosen) >= limit or budget - size < 200:
            cut = True
            break
        if per.get(c["document_id"], 0) >= 2 and not c["exact"]:
            continue
        if any(similar(c, o) for o, _ in chosen):
            cut = True
            continue
        part = excerpt(c["text"], query, min(MERGED_CHARS if c["merged"] else RESULT_CHARS, budget - size))
        chosen.append((c, part))
        size += len(part)
        per[c["document_id"]] = per.get(c["document_id"], 0) + 1
    return chosen, cut or len(ranked) > len(chosen)


def search(queries: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Ranked results of every query; queries without text, or of more than 500 characters, have none (``query_error`` tells why)."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = records(rows.sort_values(["score", "tier", "chunk_id"], ascending=[False, True, True]))
        chosen, cut = select_results(merge_adjacent(ordered), rows["query"].iloc[0], options.limit, options.max_chars)
        made = [(rows["query_id"].iloc[0], i + 1, c["chunk_id"], c["document_id"], round(c["score"], 3), bool(c["exact"]), ",".join(c["merged"]), text, cut) for i, (c, text) in enumerate(chosen)]
        return pd.DataFrame(made, columns=["query_id", "pos", "chunk_id", "document_id", "score", "exact", "merged", "excerpt", "truncated"])

    rows = candidates(queries, identifiers, chunks, documents, sources, options)
    return rows.select("query_id", "query", "chunk_id", "document_id", "ordinal", "content", "identifier", "api_version", "product_version", "channel", "tier", "score", "exact").groupBy("query_id").applyInPandas(finish, RESULTS)


def records(rows: pd.DataFrame) -> list[dict]:
    """Rows as dicts, missing texts as None."""
    out = rows.to_dict("records")
    for r in out:
        for field in ("identifier", "api_version", "product_version"):
            r[field] = r[field] if isinstance(r.get(field), str) else None
    return out


def public(results: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Results with all that is said of them in public; columns that a table lacks are null."""

    def of(table: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
        return table.select(key, *[(F.col(n) if n in table.columns else F.lit(None).cast("string")).alias(a) for n, a in names.items() if n != key])

    same = lambda *names: {n: n for n in names}
    c = of(chunks, "chunk_id", same("title", "identifier", "stability", "lifecycle"))
    d = of(documents, "document_id", same("source_id", "path", "kind", "category", "channel", "canonical_url", "revision_url", "api_package", "api_version", "product_version"))
    s = of(sources, "source_id", {"name": "source_name", "source_type": "source_type", "tier": "source_tier", "repository": "repository", "revision": "revision"})
    rows = results.join(c, "chunk_id").join(d, "document_id").join(s, "source_id")
    return rows.withColumn("score", F.round("score", 3)).withColumnRenamed("exact", "exact_match")
