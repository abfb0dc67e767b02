"""What an identifier is in one version of the API or product, and what changed in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X

KINDS = {"api": "api_version", "product": "product_version"}
SNAPSHOT_CHARS = 4000


def snapshots(identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, kind: str, *versions: str, preview: bool = False) -> DataFrame:
    """The best evidence of every normalised name (normalized) in each of the versions (column version): primary first, then tier, channel, lifecycle, ordinal.

    All versions come from one reading of the identifiers, and what leaves it are the names in chunks of these versions.
    """
    rank = lambda c, order: Y.first_of([(F.col(c) == n, F.lit(i)) for i, n in enumerate(order)], F.lit(len(order)))
    d = documents.filter(F.col(KINDS[kind]).isin(*versions)).select("document_id", "source_id", "channel", F.col(KINDS[kind]).alias("version"))
    symbol = (F.col("symbol_kind") if "symbol_kind" in chunks.columns else F.lit(None).cast("string")).alias("symbol_kind")
    c = chunks.select("chunk_id", "document_id", "ordinal", "content_hash", "stability", "lifecycle", symbol, X.clip_ellipsis(F.col("content"), SNAPSHOT_CHARS).alias("content"))
    evidence = c.join(d, "document_id").join(sources.select("source_id", "tier"), "source_id")
    evidence = evidence if preview else evidence.filter(Y.preview_allowed(F.lit(False), F.col("channel"), F.col("stability")))
    rows = evidence.join(identifiers.select("normalized", "is_primary", "chunk_id"), "chunk_id")
    order = Window.partitionBy("normalized", "version").orderBy(F.desc("is_primary"), "tier", rank("channel", ("stable", "preview")), rank("lifecycle", ("active", "deprecated", "historical", "removed")), "ordinal", "chunk_id")
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def compare(requests: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, kind: str, old: str, new: str, preview: bool = False) -> DataFrame:
    """One row per request (query_id, identifier): status, what changed, the two chunks and a warning where a version has no evidence."""
    if kind not in KINDS:
        raise ValueError("kind must be api or product")
    for name, v in (("old", old), ("new", new)):
        if not 1 <= len(v.strip()) <= 100:
            raise ValueError(f"{name} must have 1 to 100 characters")
    asked = requests.select("query_id", X.normalize_identifier(F.col("identifier")).alias("normalized"))
    best = snapshots(identifiers, chunks, documents, sources, kind, old, new, preview=preview)
    fields = ("chunk_id", "content_hash", "stability", "lifecycle", "symbol_kind")
    side = lambda v, name: F.first(F.when(F.col("version") == v, F.struct(*fields)), ignorenulls=True).alias(name)
    rows = asked.join(best.groupBy("normalized").agg(side(old, "a"), side(new, "b")), "normalized", "left")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()

    def differs(field: str) -> Column:
        return a & b & ~F.col(f"a.{field}").eqNullSafe(F.col(f"b.{field}"))

    flags = {"content_changed": "content_hash", "stability_changed": "stability", "lifecycle_changed": "lifecycle", "kind_changed": "symbol_kind"}
    any_change = differs("content_hash") | differs("stability") | differs("lifecycle") | differs("symbol_kind")
    status = F.when(~a & ~b, "not_found").when(~a, "added").when(~b, "removed").when(any_change, "changed").otherwise("unchanged")
    said = lambda what: F.lit(f"No indexed {kind} evidence matched {what}.")
    warning = F.when(~a & ~b, said("either requested version")).when(~a, said(f"old version {old}")).when(~b, said(f"new version {new}"))
    return rows.select("query_id", "normalized", status.alias("status"), *[differs(f).alias(n) for n, f in flags.items()], F.col("a.chunk_id").alias("old_chunk"), F.col("b.chunk_id").alias("new_chunk"), warning.alias("warning"))
