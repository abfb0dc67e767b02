"""Evidence by public id: a chunk with its neighbours or its section, or a whole document, within a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X

# Bounds of the options.
CONTEXT, CHARS, SECTION_DEPTH = (0, 3), (1000, 24_000), 2


def check(mode: str, before: int, after: int, max_chars: int) -> None:
    if mode not in ("adjacent", "section"):
        raise ValueError("mode must be adjacent or section")
    for name, value in (("before", before), ("after", after)):
        if not CONTEXT[0] <= value <= CONTEXT[1]:
            raise ValueError(f"{name} must be {CONTEXT[0]} to {CONTEXT[1]}")
    if not CHARS[0] <= max_chars <= CHARS[1]:
        raise ValueError(f"max_chars must be {CHARS[0]} to {CHARS[1]}")


def within_budget(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """``rows`` of each ``by`` in order until ``most`` characters are spent, the last one clipped, with ``truncated``: whether anything was left out."""
    group = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.sum(F.length("content")).over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(by)
    left = rows.withColumn("_left", most - before).withColumn("truncated", F.sum(F.length("content")).over(whole) > most).filter("_left > 0")
    cut = F.concat(F.regexp_replace(F.substr(F.col("content"), F.lit(1), (F.col("_left") - 1).cast("int")), r"\s+$", ""), F.lit("…"))
    return left.withColumn("content", F.when(F.length("content") <= F.col("_left"), F.col("content")).otherwise(cut)).drop("_left")


def targets(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, target, document_id, ordinal, heading_path, error) of (request_id, id): what an id names, or why it names nothing."""
    asked = requests.select("request_id", X.js_trim(F.col("id")).alias("id"))
    kind = Y.id_kind(F.col("id"))
    named = chunks.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("of_chunk"), "ordinal", "heading_path")
    found = asked.withColumn("kind", kind).join(named, "id", "left").join(documents.select(F.col("document_id").alias("id"), F.lit(True).alias("is_document")), "id", "left")
    document = F.when(F.col("kind") == "chunk", F.col("of_chunk")).when((F.col("kind") == "document") & F.col("is_document"), F.col("id"))
    error = F.when(F.col("kind") == "invalid", "INVALID_DOCUMENT_ID").when(document.isNull(), "NOT_FOUND")
    return found.select("request_id", F.col("kind").alias("target"), document.alias("document_id"), F.when(F.col("kind") == "chunk", F.col("ordinal")).alias("at"), F.when(F.col("kind") == "chunk", F.col("heading_path")).alias("headings"), error.alias("error"))


def fetch(requests: DataFrame, chunks: DataFrame, documents: DataFrame, mode: str = "adjacent", before: int = 1, after: int = 1, max_chars: int = 12_000) -> DataFrame:
    """(request_id, target, document_id, chunk_id, ordinal, content, truncated) for requests (request_id, id); see ``targets`` for errors.

    A section is made of the chunks whose first two headings are the target's; a target
    without headings is its own section.  Neighbours come by equi-joins on their ordinals.
    """
    check(mode, before, after, max_chars)
    found = targets(requests, chunks, documents).filter("error is null")
    body = chunks.select("document_id", "chunk_id", "ordinal", "content", F.slice("heading_path", 1, SECTION_DEPTH).alias("own"))
    whole = found.filter("target = 'document'").join(body, "document_id")
    one = found.filter("target = 'chunk'")
    if mode == "adjacent":
        near = one.withColumn("ordinal", F.explode(F.sequence(F.col("at") - before, F.col("at") + after))).join(body, ["document_id", "ordinal"])
    else:
        # chunks of a section share as many headings as the target has, two at most
        depth = F.least(F.size("headings"), F.lit(SECTION_DEPTH))
        near = one.join(body, "document_id").filter(F.when(depth > 0, F.slice("own", F.lit(1), F.greatest(depth, F.lit(1))) == F.slice("headings", F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(F.col("ordinal") == F.col("at")))
    columns = ["request_id", "target", "document_id", "chunk_id", "ordinal", "content"]
    return within_budget(whole.select(*columns).unionByName(near.select(*columns)), "request_id", "ordinal", max_chars)
