"""Definitions, examples and hybrid retrieval over batches of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X

from . import search, vectors
from .keep import kept
from .lexical import bounded, sent
from .options import SearchOptions, query_error

EVIDENCE_CHARS = 1600
HYBRID = "query_id long, pos int, chunk_id string, document_id string, exact boolean, score double, excerpt string, truncated boolean"
NO_STABLE = "No current stable definition was found; returning preview/beta material as an explicit fallback."
NOTHING = "No definition was found for this exact identifier and requested version constraints."


def _details(hits: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    c = chunks.select("chunk_id", "document_id", "ordinal", "stability", "lifecycle", (F.col("chunk_type") if "chunk_type" in chunks.columns else F.lit(None).cast("string")).alias("chunk_type"))
    versions = [F.col(v) if v in documents.columns else F.lit(None).cast("string").alias(v) for v in ("api_version", "product_version")]
    return hits.join(c, "chunk_id").join(documents.select("document_id", "source_id", "kind", "channel", *versions), "document_id").join(sources.select("source_id", "tier"), "source_id")


def _fits(options: SearchOptions, preview: bool = False):
    """What preview, historical and version options leave of definitions and examples; neither is inferred from a query."""
    c = {n: F.col(n) for n in ("api_version", "product_version")}
    old = F.lit(bool(options.include_historical)) | ~F.col("lifecycle").isin("historical", "removed")
    return Y.preview_allowed(F.lit(preview or bool(options.include_preview)), F.col("channel"), F.col("stability")) & old & options.versions(c, Y.version_allowed, lambda a, b: a & b)


def _best(rows: DataFrame, options: SearchOptions, most: int = 3) -> DataFrame:
    """Reference-like rows if a request has any, by version score, tier, rank."""
    code = F.col("kind").isin("code", "example")
    any_reference = F.max((~code).cast("int")).over(Window.partitionBy("query_id"))
    pool = rows.withColumn("any", any_reference).filter((F.col("any") == 0) | ~code)
    order = Window.partitionBy("query_id").orderBy(F.desc(options.version_bonus({n: F.col(n) for n in ("api_version", "product_version")})), "tier", "pos", "chunk_id")
    return pool.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def definitions(queries: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Up to three definitions per request; preview material only where nothing else is left, and marked so."""
    rows = _details(bounded(search.exact_hits(queries, identifiers, chunks, documents, sources), queries), chunks, documents, sources)
    fits = rows.filter(_fits(options))
    both = _best(fits, options).withColumn("preview_fallback", F.lit(False))
    if not options.include_preview:
        # what the fallback may take: nothing historical, whatever the options say of that
        rest = rows.filter(_fits(replace(options, include_historical=False), preview=True)).join(fits.select("query_id").distinct(), "query_id", "left_anti")
        both = both.unionByName(_best(rest, options).withColumn("preview_fallback", F.lit(True)))
    return both.select("query_id", "place", "chunk_id", "document_id", "kind", "channel", "stability", "lifecycle", "preview_fallback")


def definition_report(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, definitions, stable_definition_found, warning) for every request."""
    stable = (F.col("channel") == "stable") & (F.col("stability") == "stable") & (F.col("lifecycle") == "active")
    per = found.groupBy("query_id").agg(F.count("*").alias("definitions"), F.bool_or(stable).alias("stable"), F.bool_or("preview_fallback").alias("fallback"))
    rows = queries.select("query_id").join(per, "query_id", "left")
    n = F.coalesce("definitions", F.lit(0))
    return rows.select("query_id", n.alias("definitions"), F.coalesce("stable", F.lit(False)).alias("stable_definition_found"), F.when(F.col("fallback"), NO_STABLE).when(n == 0, NOTHING).alias("warning"))


def examples(queries: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, excluded: DataFrame | None = None, most: int = 2, options: SearchOptions = SearchOptions()) -> DataFrame:
    """At most ``most`` code-like chunks per request, one per document; the first 30 are taken before filters.

    excluded: definitions (query_id, chunk_id, channel); a request whose definitions are preview
    material gets preview examples too.
    """
    asked = queries.select("query_id", X.normalize_identifier(F.col("query")).alias("normalized"))
    hits = sent(identifiers.join(bounded(asked.select("normalized").distinct(), queries), "normalized").select("normalized", "chunk_id").distinct())
    rows = _details(hits, chunks, documents, sources).filter(F.col("kind").isin("code", "example") | F.coalesce(F.col("chunk_type") == "code-block", F.lit(False)))
    channel = F.when(F.col("channel") == "stable", 0).when(F.col("channel") == "preview", 1).otherwise(2)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("normalized").orderBy("tier", channel, "ordinal", "chunk_id"))).filter("r <= 30").join(asked, "normalized")
    kept = first.withColumn("preview", F.lit(False))
    if excluded is not None:
        wide = excluded.groupBy("query_id").agg(F.bool_or(F.col("channel") == "preview").alias("preview"))
        kept = first.join(wide, "query_id", "left").withColumn("preview", F.coalesce("preview", F.lit(False))).join(excluded.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    kept = kept.filter(F.when(F.col("preview"), _fits(options, preview=True)).otherwise(_fits(options)))
    one = kept.withColumn("d", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("r"))).filter("d = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).filter(F.col("place") <= most).select("query_id", "place", "chunk_id", "document_id")


def find_examples(queries: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, options: SearchOptions = SearchOptions(), most: int = 5) -> DataFrame:
    """(query_id, place, chunk_id, document_id, linked, excerpt, truncated): examples of each request, at most ``most``.

    First those linked to the identifier that the request names, if any (two at most, none of which is one of its
    definitions), then code and examples as full-text search ranks them, where the request is taken
    with the word "example" unless it asks for one anyway; a chunk counts where it is seen first.  The package that a request
    names and its wish for previews hold where the options say nothing.  ``truncated``: ``most`` were found.
    Requests that ``query_error`` refuses have no rows; one that only the added word makes too long has linked examples alone.
    """
    plan = Y.plan_lookup(F.col("query"))
    asked = queries.filter(query_error(F.col("query")).isNull()).withColumn("query", X.js_trim(F.col("query"))).select("query_id", "query", plan.alias("p"))
    asked = kept(asked.select("query_id", "query", F.get("p.identifiers", F.lit(0)).alias("identifier"), "p.intent", "p.module", F.coalesce(F.lit(options.include_preview).cast("boolean"), "p.include_preview", F.lit(False)).alias("preview")))
    tables = (identifiers, chunks, documents, sources)
    linked = []
    for preview in (False, True):
        mine = replace(options, include_preview=preview)
        part = asked.filter((F.col("preview") == preview) & F.col("identifier").isNotNull()).select("query_id", F.col("identifier").alias("query"))
        linked.append(examples(part, *tables, excluded=definitions(part, *tables, mine), most=min(2, most), options=mine))
    linked = linked[0].unionByName(linked[1]).join(chunks.select("chunk_id", X.clip_ellipsis(F.col("content"), EVIDENCE_CHARS).alias("excerpt")), "chunk_id")

    worded = asked.withColumn("query", F.when(F.col("intent") == "example", F.col("query")).otherwise(F.concat("query", F.lit(" example"))))
    wide = replace(options, limit=10, kinds=("example", "code"), max_chars=24_000)
    plain = worded if options.api_package else worded.filter("module IS NULL")
    ranked = search.search(plain.select("query_id", "query"), *tables, wide)
    packaged = worded.filter("module IS NOT NULL").select("query_id", "query", "module")
    if not options.api_package and not packaged.isEmpty():  # the requests alone are read for this, the corpus is not
        ranked = ranked.unionByName(search.search(packaged, *tables, wide))
    both = linked.select("query_id", "chunk_id", "document_id", F.lit(True).alias("linked"), "excerpt", F.col("place").alias("at"))
    rest = ranked.join(linked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = both.unionByName(rest.select("query_id", "chunk_id", "document_id", F.lit(False).alias("linked"), "excerpt", F.col("pos").alias("at")))
    own = Window.partitionBy("query_id")
    first = both.withColumn("place", F.row_number().over(own.orderBy(F.desc("linked"), "at"))).filter(F.col("place") <= most)
    return first.select("query_id", "place", "chunk_id", "document_id", "linked", "excerpt", (F.count("*").over(own) >= most).alias("truncated"))


def hybrid(queries: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, options: SearchOptions = SearchOptions(), k: int = 40) -> DataFrame:
    """Full-text results fused with vector neighbours; exact matches stay first and keep their score, others have 100,000 times the fused one.

    query_vectors: (query_id, embedding); chunk_vectors: (vec_id, chunk_id, embedding).  Of what
    is ranked the greedy end keeps at most two per document (unless exact), no near
    duplicates of what was taken, and the character budget.
    """
    lexical = search.search(queries, identifiers, chunks, documents, sources, replace(options, limit=10, max_chars=24_000))
    lexical = lexical.select("query_id", "chunk_id", F.col("pos").alias("a"), "exact", F.col("excerpt").alias("found"), F.col("score").alias("own"))
    near = vectors.knn_cosine(chunk_vectors, query_vectors, k).join(chunk_vectors.select("vec_id", "chunk_id"), "vec_id").select("query_id", "chunk_id", F.col("pos").alias("b"))
    both = lexical.join(near, ["query_id", "chunk_id"], "full_outer").join(queries, "query_id")
    rows = bounded(both, queries).join(chunks.select("chunk_id", "document_id", "identifier", "content", "stability", "lifecycle"), "chunk_id")
    rows = rows.join(documents.select("document_id", "source_id", "path", "kind", "category", "channel", "api_package", "api_version", "product_version"), "document_id").join(sources.select("source_id", "tier", "source_type"), "source_id")
    c = {n: F.col(n) for n in rows.columns}
    intent = Y.intent_flags(c["query"])
    heavy, light = Y.fusion_weights(intent)
    exact = F.coalesce(c["exact"], F.lit(False))
    allowed = c["a"].isNotNull() | replace(options, product_version=None).allowed(c, c["query"])
    score = F.coalesce(heavy / (60 + c["a"]), F.lit(0.0)) + F.coalesce(light / (60 + c["b"]), F.lit(0.0)) + F.when(exact, 10.0).otherwise(0.0) + F.when(c["a"].isNull(), Y.semantic_intent_bonus(intent, c)).otherwise(0.0)
    text = F.coalesce("found", X.clip_ellipsis(F.col("content"), EVIDENCE_CHARS))
    ranked = rows.filter(allowed).select("query_id", "chunk_id", "document_id", "tier", "channel", "identifier", "api_version", "product_version", exact.alias("exact"), "own", score.alias("score"), text.alias("text"))

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        ordered = search.records(part.sort_values(["exact", "score", "tier", "chunk_id"], ascending=[False, False, True, True]))
        chosen, cut = fused_end(ordered, options.limit, options.max_chars)
        made = [(part["query_id"].iloc[0], i + 1, r["chunk_id"], r["document_id"], bool(r["exact"]), r["own"] if r["exact"] else round(r["score"] * 100_000, 3), t, cut) for i, (r, t) in enumerate(chosen)]
        return pd.DataFrame(made, columns=["query_id", "pos", "chunk_id", "document_id", "exact", "score", "excerpt", "truncated"])

    return ranked.groupBy("query_id").applyInPandas(finish, HYBRID)


def fused_end(ranked: list[dict], limit: int, budget: int) -> tuple[list[tuple[dict, str]], bool]:
    """The greedy end of a fused ranking: (result, text) pairs and whether anything was left out."""
    taken: list[tuple[dict, str]] = []
    for r in ranked:
        left = budget - sum(len(t) for _, t in taken)
        if len(taken) == limit or left < 200:
            break
        of_document = sum(o["document_id"] == r["document_id"] for o, _ in taken)
        if (of_document < 2 or r["exact"]) and not any(search.similar(r, o | {"text": t}) for o, t in taken):
            taken.append((r, search.shortened(r["text"], left)))
    return taken, len(taken) < len(ranked)


def hybrid_or_lexical(ready: Callable[[], None], queries: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, options: SearchOptions = SearchOptions(), k: int = 40) -> DataFrame:
    """``hybrid`` if ``ready`` (a check such as ``vectors.require``) raises nothing, else full-text search alone with the same columns."""
    try:
        ready()
    except (ValueError, LookupError):
        rows = search.search(queries, identifiers, chunks, documents, sources, options)
        return rows.select("query_id", "pos", "chunk_id", "document_id", "exact", "score", "excerpt", "truncated")
    return hybrid(queries, query_vectors, chunk_vectors, identifiers, chunks, documents, sources, options, k)


def merge_only(candidates: DataFrame) -> DataFrame:
    """Neighbour merging alone: (query_id, pos, chunk_id, merged)."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        ranked = rows.sort_values(["score", "tier", "chunk_id"], ascending=[False, True, True]).to_dict("records")
        made = [(r["query_id"], i + 1, r["chunk_id"], ",".join(r["merged"])) for i, r in enumerate(search.merge_adjacent(ranked))]
        return pd.DataFrame(made, columns=["query_id", "pos", "chunk_id", "merged"])

    return candidates.groupBy("query_id").applyInPandas(of, "query_id long, pos int, chunk_id string, merged string")
