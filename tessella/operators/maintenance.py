"""Keeping the tables of an index: writes, comparison of runs, incremental update, validation, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

CHILDREN = ("chunks", "identifiers", "edges")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def removed(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys that are gone, and without what hangs on those: with a document go its chunks, with a chunk the edges read in it.

    A table without the key that has chunk_id follows the chunks.  An edge that several
    chunks give has a row for each, and stays until the last of them goes; edges that no chunk gives stay.
    """
    ids = gone.select(key).distinct()
    out = {name: t.join(ids, key, "left_anti") if key in t.columns else t for name, t in tables.items()}
    if key != "chunk_id" and "chunks" in tables and key in tables["chunks"].columns:
        lost = tables["chunks"].join(ids, key, "left_semi").select("chunk_id")
        out |= {name: t.join(lost, "chunk_id", "left_anti") for name, t in out.items() if key not in t.columns and "chunk_id" in t.columns}
    return out


def replaced(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with the documents of ``new`` and all that belongs to them in place of what was there: chunks, identifiers and edges go together."""
    gone = new["documents"].select("document_id")
    left = removed(tables, gone)
    return {name: t.unionByName(new[name], allowMissingColumns=True) if name in new else t for name, t in left.items()}


def cleared(meta: DataFrame) -> DataFrame:
    """What is left of the (k, v) notes of an index when it is emptied: its layout."""
    return meta.filter("k = 'schema_version'")


def noted(store: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(k, v) notes with those of ``new`` written over and those of ``gone`` (k) dropped."""
    out = upsert(store, new, ["k"])
    return out if gone is None else out.join(gone.select("k"), "k", "left_anti")


def unchanged_sources(new: DataFrame, old: DataFrame) -> DataFrame:
    """Sources (source_id, revision, input) that need no reading: revision and input identity are as before; a null is unlike anything."""
    same = (F.col("n.revision") == F.col("o.revision")) & (F.col("n.input") == F.col("o.input"))
    return new.alias("n").join(old.alias("o"), "source_id").filter(same).select("source_id")


def compared(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "path"), by: str = "content_hash") -> DataFrame:
    """(keys, status) of the documents of two runs: added, modified, deleted or unchanged."""
    o, n = old.select(*keys, F.col(by).alias("o"), F.lit(True).alias("was")), new.select(*keys, F.col(by).alias("n"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("o") == F.col("n"), "unchanged").otherwise("modified")
    return o.join(n, list(keys), "full_outer").select(*keys, status.alias("status"))


def counters(diff: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: how many documents have each status, and with the written chunks how many of these."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    row = diff.agg(*[of(s) for s in ("added", "modified", "deleted", "unchanged")])
    return row if chunks is None else row.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks_changed"))))  # two single rows


def require_documents(sources: DataFrame, documents: DataFrame) -> None:
    """Raise if a source that was read has no document at all: a failed scan must not empty it."""
    empty = sources.join(documents.select("source_id").distinct(), "source_id", "left_anti").select("source_id").limit(5).collect()
    if empty:
        raise ValueError(f"SOURCE_EMPTY: no documents of {', '.join(sorted(r.source_id for r in empty))}")


def update(old: dict[str, DataFrame], sources: DataFrame, documents: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables, counters, diff) of an incremental update.

    old: sources, documents, chunks, identifiers, edges; sources: the selected ones; documents: what
    their scan has found, with the columns of ``old``'s.  Only added and modified documents
    are parsed (``parse`` gives chunks, identifiers and edges of documents).  Documents that
    are gone, and sources that are no longer selected, go with all that belongs to them;
    what is said of unchanged documents is refreshed; aliases are derived anew if anything
    changed.  Write the tables with ``sinks.publish`` and ``validate`` as its check.
    """
    require_documents(sources, documents)
    diff = compared(old["documents"], documents).cache()
    key = ["source_id", "path"]
    changed = documents.join(diff.filter("status IN ('added', 'modified')").select(*key), key, "left_semi")
    gone = old["documents"].join(diff.filter("status IN ('modified', 'deleted')").select(*key), key, "left_semi").select("document_id")
    made = parse(changed)
    kept = removed({n: old[n] for n in CHILDREN}, gone)
    tables = {n: t.unionByName(made[n], allowMissingColumns=True) if n in made else t for n, t in kept.items()}
    # documents of both kinds are written as they were found now, so that unchanged ones have fresh URLs and revisions
    tables |= {"sources": sources, "documents": documents}
    if "identifier_kind" in tables["identifiers"].columns and diff.filter("status <> 'unchanged'").limit(1).count():
        tables["identifiers"], tables["edges"] = graph.derive_aliases(tables["identifiers"], tables["edges"], tables["chunks"], tables["documents"])
    return tables, counters(diff, made["chunks"]), diff


def validate(tables: dict[str, DataFrame], text_index: DataFrame | None = None) -> DataFrame:
    """One row: rows of each table, orphans (edges too, whose chunk is gone), rows the text index (chunk_id) lacks or has too many, repeated ids, errors and ok."""
    ids = {"sources": "source_id", "documents": "document_id", "chunks": "chunk_id"}

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    def orphans(child: str, parent: str) -> DataFrame:
        key = ids[parent]
        return tables[child].filter(F.col(key).isNotNull()).join(tables[parent].select(key), key, "left_anti")

    parts = [count(t, n) for n, t in tables.items() if n in (*ids, "identifiers", "edges")]
    parts += [count(orphans(c, p), f"orphan_{c}") for c, p in (("documents", "sources"), ("chunks", "documents"), ("identifiers", "chunks"), ("edges", "chunks")) if c in tables and p in tables and ids[p] in tables[c].columns]
    parts += [count(tables[n].groupBy(k).count().filter("count > 1"), f"repeated_{n}") for n, k in ids.items() if n in tables]
    if text_index is not None:
        parts += [count(text_index, "indexed"), count(tables["chunks"].join(text_index.select("chunk_id"), "chunk_id", "left_anti"), "missing_in_index"), count(text_index.join(tables["chunks"].select("chunk_id"), "chunk_id", "left_anti"), "orphans_in_index")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    wrong = F.filter(F.collect_list(F.when(F.col("name").rlike("^(orphan|repeated|missing)") & (F.col("n") > 0), F.concat("name", F.lit(": "), F.col("n").cast("string")))), lambda x: x.isNotNull())
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"), F.array_sort(wrong).alias("errors")).withColumn("ok", F.size("errors") == 0)


def require_valid(tables: dict[str, DataFrame]) -> None:
    """The check for ``sinks.publish``: raise what ``validate`` finds."""
    row = validate(tables).first()
    if not row.ok:
        raise ValueError("INDEX_INVALID: " + "; ".join(row.errors))


def logged(log: DataFrame, run: DataFrame, status: str, moment: Column) -> DataFrame:
    """``log`` (source_id, documents_changed, status, finished_at, run) and one row more for each source of ``run`` (source_id, path, status of ``compared``)."""
    number = F.coalesce(F.max("run"), F.lit(0)) + 1
    nth = log.agg(number.alias("run"))  # one row
    rows = run.filter("status <> 'unchanged'").groupBy("source_id").agg(F.count("*").alias("documents_changed")).crossJoin(F.broadcast(nth))
    return log.unionByName(rows.select("source_id", "documents_changed", F.lit(status).alias("status"), moment.alias("finished_at"), "run"), allowMissingColumns=True)


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per source: tier, channel, revision, numbers of documents, chunks and identifiers, share of duplicates, whether it is ready.

    A chunk is a duplicate if another source of the same or a lower tier number has the same content.
    """
    chunks = tables["chunks"].join(tables["documents"].select("document_id", "source_id"), "document_id") if "source_id" not in tables["chunks"].columns else tables["chunks"]
    per = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    placed = chunks.select("chunk_id", "content_hash", "source_id").join(tables["sources"].select("source_id", "tier"), "source_id")
    # the two smallest (tier, source) of a text tell for every source whether another one comes before it
    first = placed.groupBy("content_hash").agg(F.slice(F.array_sort(F.collect_set(F.struct("tier", "source_id"))), 1, 2).alias("low"))
    other = F.exists("low", lambda x: (x["source_id"] != F.col("source_id")) & (x["tier"] <= F.col("tier")))
    twice = placed.join(first, "content_hash").groupBy("source_id").agg(F.count(F.when(other, 1)).alias("duplicates"))
    named = tables["identifiers"].join(chunks.select("chunk_id", "source_id"), "chunk_id")
    rows = tables["sources"]
    for part in (per(tables["documents"], "documents"), per(chunks, "chunks"), per(named, "identifiers"), twice):
        rows = rows.join(part, "source_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    share = F.round(F.when(n("chunks") > 0, 100.0 * n("duplicates") / F.col("chunks")).otherwise(0.0), 2)
    return rows.select("source_id", "name", "tier", "channel", "revision", n("documents").alias("documents"), n("chunks").alias("chunks"), n("identifiers").alias("identifiers"), share.alias("duplicate_percent"), ((n("documents") > 0) & (n("chunks") > 0)).alias("ready"))


def prunable(names: DataFrame, retain: int) -> DataFrame:
    """(name) of dated backups beyond the newest ``retain``; names that are no date are nobody's to prune."""
    if not 1 <= retain <= 365:
        raise ValueError("retain must be 1 to 365")
    dated = names.filter(F.col("name").rlike(r"^\d{8}T\d{6}Z$")).select("name").distinct()
    newest = [r.name for r in dated.orderBy(F.desc("name")).limit(retain).collect()]  # at most 365 names
    return dated.filter(~F.col("name").isin(newest))


def action(version: Column, current: int) -> Column:
    """What to do with an index of some layout: open, migrate an older one, refuse a newer one or one that says nothing."""
    return F.when(version.isNull() | (version > current), "refuse").when(version == current, "open").otherwise("migrate")


def migrate(tables: dict[str, DataFrame], version: int, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], current: int) -> dict[str, DataFrame]:
    """``tables`` brought from ``version`` to ``current``, one step for each version; a missing step or a newer layout raises."""
    if version > current:
        raise ValueError(f"SCHEMA_NEWER: index has {version}, this engine {current}")
    for v in range(version, current):
        if v not in steps:
            raise ValueError(f"SCHEMA_MIGRATION_MISSING: no step from {v}")
        tables = steps[v](tables)
    return tables


def permits(requests: DataFrame, most: int) -> DataFrame:
    """(client, request_id, moment, active, accepted): how many requests of a client run when one begins, and whether it may.

    requests: (client, request_id, begin, end).  Numbers of running requests, as one pass over
    begins and ends in order; a request that is not accepted still counts until its end.
    """
    begins = requests.select("client", "request_id", F.col("begin").alias("moment"), F.lit(1).alias("delta"))
    ends = requests.select("client", "request_id", F.col("end").alias("moment"), F.lit(-1).alias("delta"))
    # an end frees its permit before a begin of the same moment asks for one
    order = Window.partitionBy("client").orderBy("moment", "delta", "request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = begins.unionByName(ends).withColumn("active", F.sum("delta").over(order)).filter("delta = 1")
    return rows.select("client", "request_id", "moment", "active", (F.col("active") <= most).alias("accepted"))
