"""A whole index from files, and the changes of a batch of files: one parse, written once, read by every table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph, maintenance
from tessella.operators.keep import kept

from . import ingest
from .segments import EDGES, Store, changes, valid


def _parsed(store: Store, files: DataFrame, sources: DataFrame, staging: str) -> dict[str, DataFrame]:
    """The tables of ``files``, written to ``staging``: the parse first, then what is made of it, as each is read several times."""

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store.folder.root}/{staging}/{name}")
        return store.spark.read.parquet(f"{store.folder.root}/{staging}/{name}")

    made = ingest.ingest(files, sources, lambda parsed: written(parsed, "parsed"))
    return {name: t if name == "bad_files" else written(t, name) for name, t in made.items()} | {"edges": store.spark.createDataFrame([], EDGES)}


def _with_text(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {**made, "text": ingest.with_text_fields(made["chunks"], made["documents"], made["identifiers"])}


def _derived(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    identifiers, edges = graph.derive_aliases(tables["identifiers"], tables["edges"], tables["chunks"], tables["documents"])
    return {**tables, "identifiers": kept(identifiers), "edges": kept(edges)}


def rebuild(spark: SparkSession, root: str, files: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The index of ``files`` (source_id, path, content), published once it is whole and valid; returns its tables.

    Each file is parsed once; files that cannot be parsed are the table bad_files.  A source
    without any file raises, and then, as on any other error, the last index stays.
    """
    maintenance.require_documents(sources, files)
    store, staging = Store(spark, root), f"staging-{uuid.uuid4().hex[:12]}"
    try:
        store.commit(_with_text(_derived(_parsed(store, files, sources, staging))), replace=True, validate=valid(sources))
    finally:
        store.folder.drop(staging)
    return store.tables()


def apply(spark: SparkSession, root: str, found: DataFrame, sources: DataFrame, note: dict | None = None) -> dict[str, int]:
    """Bring files (source_id, path, content; null content: deleted) into the index: what is as before is left alone, the rest is one segment.

    Aliases are derived anew over the whole index; documents that are not of this batch but whose
    aliases have changed by it are written again with them.  Returns how many documents were
    parsed, went or were touched in that way.
    """
    store, staging = Store(spark, root), f"staging-{uuid.uuid4().hex[:12]}"
    try:
        fresh, gone = changes(store, found)
        made = _parsed(store, fresh, sources, staging)
        rest = maintenance.removed(store.tables(), gone)
        every = _derived({n: made[n].unionByName(rest[n], allowMissingColumns=True) if n in rest else made[n] for n in ("documents", "chunks", "identifiers", "edges")})

        def derived(tables: dict[str, DataFrame]) -> DataFrame:
            names = tables["identifiers"].filter("alias_type = 'derived-chain'").select("chunk_id", F.lit("alias").alias("relation"), "identifier", F.lit("").alias("other"))
            return names.unionByName(tables["edges"].filter("relation IN ('property_type', 'alias_of')").select("chunk_id", "relation", F.col("from_identifier").alias("identifier"), F.col("to_identifier").alias("other")))

        touched = made["documents"].select("document_id").limit(0)
        if "identifiers" in rest:
            new, old = derived(every), derived(rest)
            differ = new.exceptAll(old).unionByName(old.exceptAll(new)).select("chunk_id").distinct()
            touched = kept(differ.join(rest["chunks"].select("chunk_id", "document_id"), "chunk_id").select("document_id").distinct())
        own = made["documents"].select("document_id").unionByName(touched)
        owned = lambda df: df.join(own, "document_id", "left_semi")
        chunks = owned(every["chunks"])
        ids = chunks.select("chunk_id")
        out = {"documents": owned(every["documents"]), "chunks": chunks, **{n: every[n].join(ids, "chunk_id", "left_semi") for n in ("identifiers", "edges")}}
        counts = {"parsed": made["documents"].count(), "gone": gone.count(), "touched": touched.count()}
        if any(counts.values()) or note:
            store.commit(_with_text(out) | {"bad_files": made["bad_files"]}, gone.unionByName(touched), note, valid(sources))
    finally:
        store.folder.drop(staging)
    return counts
