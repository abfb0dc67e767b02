"""From files to the tables of the engine: documents, chunks and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X

from . import parsers

#: Attributes in a file's head that name a version, the first that is there counts.
API_VERSION = ("api_version", "api-version", "apiVersion")
PRODUCT_VERSION = ("product_version", "minecraft_version", "minecraft-version", "minecraftVersion")


def _attribute(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.col("attributes")[n], F.lit("")) for n in names])


def ingest(files: DataFrame, sources: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> dict[str, DataFrame]:
    """documents, chunks, identifiers and bad_files of (source_id, path, content, ...) files.

    sources: (source_id, channel, ...).  Versions given with a file (columns api_version,
    product_version) go before those of its head.  A document is experimental if all its
    chunks are.  All tables come from one parse: ``keep`` writes it (or gives it back as it
    is) before they are made of it; without that each table that is used parses again.
    """
    for name in ("api_version", "product_version"):
        files = files if name in files.columns else files.withColumn(name, F.lit(None).cast("string"))
    label = Y.classify_path(F.col("path"))
    about = files.join(F.broadcast(sources.select("source_id", "channel")), "source_id")  # a registry of few rows
    about = about.withColumn("label", label)
    about = about.select(
        "source_id", "path", X.stable_public_id("doc", F.col("source_id"), F.col("path")).alias("document_id"), F.col("label.kind").alias("kind"),
        Y.category_for_source(F.col("label.category"), F.col("source_id"), F.col("channel")).alias("category"), F.col("label.language").alias("language"), F.col("label.lifecycle").alias("document_lifecycle"),
        "channel", "api_version", "product_version", X.sha256_text(F.coalesce("content", F.lit(""))).alias("document_hash"), "content",
    )
    # a path may stand in several sources: the id goes through the parser as a folder around it
    parsed = keep(parsers.parse_files(about.select(F.concat_ws("/", "document_id", "path").alias("path"), "content")))
    parsed = parsed.withColumn("document_id", F.substring_index("path", "/", 1)).withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    chunks = parsers.good(parsed)
    heads = chunks.groupBy("document_id").agg(
        F.min_by("title", "ordinal").alias("first_title"), F.min_by("attributes", "ordinal").alias("attributes"), F.bool_and(F.col("stability") == "experimental").alias("experimental"), F.count("*").alias("n"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "identifiers"))), lambda x: x["identifiers"]))).alias("identifiers"),
    )
    title = F.when(F.col("language") == "markdown", F.coalesce(_attribute(("title",)), F.nullif("first_title", F.lit("Document")))).when(F.col("language") == "json", F.col("first_title"))
    documents = about.drop("content").join(heads, "document_id", "left").select(
        "document_id", "source_id", "path", F.coalesce(title, F.element_at(F.split("path", "/"), -1)).alias("title"), "kind", "category", "language", "channel",
        F.when(F.col("experimental"), "experimental").otherwise("stable").alias("stability"), F.col("document_lifecycle").alias("lifecycle"), F.col("document_hash").alias("content_hash"),
        F.coalesce("api_version", _attribute(API_VERSION)).alias("api_version"), F.coalesce("product_version", _attribute(PRODUCT_VERSION)).alias("product_version"),
        F.when(F.col("kind") == "api", Y.package_from_path(F.col("path"))).alias("api_package"),
        F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"), F.coalesce("n", F.lit(0)).alias("chunks"),
    )
    chunk_id = X.stable_public_id("chk", F.col("document_id"), F.col("ordinal"), F.sha2("content", 256))
    made = chunks.withColumn("chunk_id", chunk_id).withColumn("content_hash", X.sha256_text(F.col("content"))).drop("attributes")
    names = made.select("chunk_id", "document_id", F.col("identifier").alias("own"), F.explode("identifiers").alias("identifier"), "symbol_kind")
    own = F.coalesce(X.normalize_identifier(F.col("identifier")) == X.normalize_identifier(F.col("own")), F.lit(False))
    identifiers = names.select(
        "chunk_id", "document_id", "identifier", X.normalize_identifier(F.col("identifier")).alias("normalized"), X.identifier_leaf(F.col("identifier")).alias("leaf_name"),
        F.when(own, F.coalesce("symbol_kind", F.lit("unknown"))).otherwise("unknown").alias("identifier_kind"), own.cast("int").alias("is_primary"), F.lit("exact").alias("alias_type"),
    ).dropDuplicates(["chunk_id", "normalized"])
    return {"documents": documents, "chunks": made, "identifiers": identifiers, "bad_files": parsers.bad_files(parsed)}


def with_text_fields(chunks: DataFrame, documents: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``chunks`` with the six fields of the text index, by the names that it looks for.

    The identifier field holds all terms of the exact identifiers, the alias field the derived ones.
    """
    terms = identifiers.filter("alias_type = 'exact'").select("chunk_id", F.explode(X.identifier_search_terms(F.col("identifier"))).alias("t")).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("terms"))
    aliases = identifiers.filter("alias_type <> 'exact'").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("identifier")), " ").alias("aliases"))
    # chunks of the parse have the path of their document
    placed = chunks.drop("aliases") if "path" in chunks.columns else chunks.drop("aliases").join(documents.select("document_id", "path"), "document_id")
    rows = placed.join(terms, "chunk_id", "left").join(aliases, "chunk_id", "left")
    return rows.withColumn("name", F.col("identifier")).withColumn("identifier", F.coalesce("terms", F.col("identifier"))).withColumn("heading", F.array_join("heading_path", " ")).drop("terms")
