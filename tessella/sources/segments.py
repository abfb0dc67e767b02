"""An index that grows by segments: what a run changes is written, and nothing else.

A segment holds the rows of the documents that one run has added or changed (documents,
chunks, identifiers, edges, postings) and the ids of documents that are replaced or
gone (``gone``).  One small file, CURRENT, lists the segments with a few sums; it is
renamed over the last one, so that a run appears at once and whole or not at all, with
whatever it notes of itself (as the number of a stream's batch).  A row counts unless
a later segment has its document among the gone ones.  ``compact`` makes one segment of all.

Postings lie in buckets of their term, in the order of terms, so that a search
reads the buckets of what is asked only.  A posting names its chunk by a number that the index
gives once; ``lengths`` says of each number the chunk, its document and its words.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions import text as X
from tessella.operators import lexical, maintenance
from tessella.operators.keep import kept, swept
from tessella.schema import SCHEMA_VERSION

from .sinks import Folder

TABLES = ("documents", "chunks", "identifiers", "edges")
EDGES = "from_identifier string, relation string, to_identifier string, chunk_id string"
BUCKETS = 64
#: Parts, at most, of the buckets whose postings are shuffled one after the other: a part is all that lies in shuffle files at a time. Bytes of a part at least.
PASSES, PART = 4, 16 << 20
#: Of the postings; 1 had the ids of chunk and document in each row.
LAYOUT = 2


class Store:
    """The segments of a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, Folder(spark, root), buckets

    def current(self) -> dict:
        """What CURRENT says; an empty index where there is none.  Another layout is refused."""
        if not self.folder.fs.exists(self.folder.path("CURRENT")):
            return {"segments": [], "schema_version": SCHEMA_VERSION, "layout": LAYOUT, "buckets": self.buckets, "next": 0}
        found = json.loads(self.folder.read("CURRENT"))
        if found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"schema version {found['schema_version']}, expected {SCHEMA_VERSION}")
        if found.get("layout", 1) != LAYOUT:
            raise ValueError(f"layout {found.get('layout', 1)} of postings, expected {LAYOUT}: rebuild the index")
        return found

    def _part(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(segment["schemas"][name])).parquet(f"{self.folder.root}/{segment['name']}/{name}")

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        """(document_id, dead): the last segment that replaces a document or drops it."""
        parts = [self._part(s, "gone").withColumn("nth", F.lit(k)) for k, s in enumerate(segments) if s["gone"]]
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("document_id").agg(F.max("nth").alias("dead"))

    def table(self, name: str, segments: list[dict] | None = None, only: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame | None:
        """The rows that count; ``only`` restricts what is read of each segment.  None where nothing was ever written."""
        segments = self.current()["segments"] if segments is None else segments
        dead, out = self._dead(segments), None
        for k, s in enumerate(segments):
            if name in s["schemas"]:
                rows = only(self._part(s, name))
                # rows of the last segment are all alive
                if dead is not None and k + 1 < len(segments) and "document_id" in rows.columns:
                    rows = rows.join(dead.filter(F.col("dead") > k).select("document_id"), "document_id", "left_anti")
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def tables(self) -> dict[str, DataFrame]:
        segments = self.current()["segments"]
        return {n: t for n in TABLES if (t := self.table(n, segments)) is not None}

    def corpus(self) -> tuple[int, float]:
        """(chunks, mean words of a chunk) of the text index."""
        segments = self.current()["segments"]
        n, total = (sum(s[k] - s[f"dead_{k}"] for s in segments) for k in ("n", "total"))
        return n, total / n if n else 0.0

    def numbered(self, terms: DataFrame) -> DataFrame:
        """(term, n, places) of ``terms`` (term), out of their buckets, also of chunks that count no more: at most ``buckets`` numbers reach the driver.

        Terms go to the postings, which stay where they lie; very many meet them in a join.
        """
        found = self.current()
        asked = lexical.sent(terms.select("term", bucket(found["buckets"])).distinct())
        which = [r.bucket for r in asked.select("bucket").distinct().collect()]
        rows = self._numbered(found["segments"], lambda df: df.filter(F.col("bucket").isin(which)).join(asked, ["bucket", "term"], "left_semi"))
        return rows.select("term", "n", "places", "bucket") if rows is not None else self.spark.createDataFrame([], "term string, n long, places array<int>, bucket int")

    def lengths(self, dead: bool = False) -> DataFrame:
        """(n, document_id, chunk_id, length) of the chunks that count; ``dead``: of all."""
        segments = self.current()["segments"]
        parts = [self._part(s, "lengths") for s in segments if "lengths" in s["schemas"]] if dead else [t for t in [self.table("lengths", segments)] if t is not None]
        out = None
        for rows in parts:
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "n long, document_id string, chunk_id string, length int")

    def postings(self, terms: DataFrame) -> DataFrame:
        """Postings of ``terms`` (term) that count, with their chunks."""
        rows = self.numbered(terms)
        # numbers of chunks that count no more have no row there
        return rows.join(self.lengths(), "n").select("term", "chunk_id", "document_id", "length", lexical.weight_of(F.col("places")).alias("frequency"), "places", "bucket")

    def _numbered(self, segments: list[dict], only: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame | None:
        """(n, term, places, bucket) of all segments, also of chunks that count no more."""
        parts, out = [only(self._part(s, "postings")) for s in segments if "postings" in s["schemas"]], None
        for rows in parts:
            out = rows if out is None else out.unionByName(rows)
        return out

    def _put_postings(self, rows: DataFrame, where: str, size: int) -> dict:
        """``size``: bytes of what ``rows`` are made of; a term which very many chunks have is in several files, by their numbers."""
        passes, salt = min(PASSES, size // PART + 1), F.pmod(F.shiftright("n", 33), F.lit(size // (16 * PART) + 1))
        for k in range(passes):
            part = rows.filter(F.col("bucket") % passes == k).repartition("bucket", salt).sortWithinPartitions("bucket", "term", "n")
            part.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{where}/postings")
        return rows.schema.jsonValue()

    def commit(self, made: dict[str, DataFrame], gone: DataFrame | None = None, note: dict | None = None, validate: Callable[[dict[str, DataFrame]], None] | None = None, replace: bool = False) -> str:
        """Write one segment of the rows of ``made``, drop the documents of ``gone`` (document_id), and point CURRENT to it.

        made: documents, chunks, identifiers, edges (the latter two with chunk_id), bad_files,
        and ``text``, the chunks with the fields of the text index; each written once.  ``validate`` sees all tables as they will be.  On any error nothing
        changes.  ``replace``: the new segment is the whole index.
        """
        found = self.current()
        segment = {"name": f"s{len(found['segments']):05d}-{uuid.uuid4().hex[:12]}", "schemas": {}, "gone": False}
        where = f"{self.folder.root}/{segment['name']}"
        old = [] if replace else found["segments"]

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{where}/{name}")
            segment["schemas"][name] = df.schema.jsonValue()
            return self._part(segment, name)

        try:
            with swept(self.spark):
                for name in ("documents", "chunks", "bad_files"):
                    if name in made:
                        put(name, made[name])
                for name in ("identifiers", "edges"):  # which go with the document of their chunk
                    if name in made:
                        put(name, made[name].drop("document_id").join(self._part(segment, "chunks").select("chunk_id", "document_id"), "chunk_id", "left"))
                segment |= {"n": 0, "total": 0, "dead_n": 0, "dead_total": 0}
                begin = found["next"]
                if "text" in made:
                    # written once, so that numbers stay what they are, and read for lengths and postings
                    lexical.places(made["text"]).withColumn("n", F.lit(begin) + F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{where}/staged")
                    staged = self.spark.read.parquet(f"{where}/staged")
                    lengths = put("lengths", staged.select("n", "document_id", "chunk_id", "length"))
                    rows = staged.select("n", F.explode("words").alias("word")).select("n", "word.*").withColumn("bucket", bucket(found["buckets"]))
                    segment["schemas"]["postings"] = self._put_postings(rows, where, self.folder.size(f"{segment['name']}/staged"))
                    self.folder.drop(f"{segment['name']}/staged")
                    segment |= self._sums(lengths)
                    begin = max(begin, (lengths.agg(F.max("n").alias("n")).first().n or 0) + 1)
                if gone is not None and old:
                    ids = put("gone", gone.select("document_id").distinct())
                    segment["gone"] = True
                    before = self.table("lengths", old, lambda df: df.join(ids, "document_id", "left_semi"))
                    segment |= {f"dead_{k}": v for k, v in self._sums(before).items()} if before is not None else {}
                segments = [*old, segment]
                if validate:
                    validate({n: t for n in TABLES if (t := self.table(n, segments)) is not None})
                self.folder.write("CURRENT", json.dumps({**{k: v for k, v in found.items() if k != "segments"}, **(note or {}), "next": begin, "segments": segments}))
        except BaseException:
            self.folder.drop(segment["name"])
            raise
        return segment["name"]

    @staticmethod
    def _sums(lengths: DataFrame) -> dict[str, int]:
        row = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        return {"n": row.n, "total": row.total}

    def compact(self) -> str:
        """One segment of all rows that count; the old ones stay until ``sweep``."""
        found = self.current()
        segment = {"name": f"s{len(found['segments']):05d}-{uuid.uuid4().hex[:12]}", "schemas": {}, "gone": False, "dead_n": 0, "dead_total": 0}
        where = f"{self.folder.root}/{segment['name']}"
        try:
            with swept(self.spark):
                for name in (*TABLES, "bad_files", "lengths"):
                    rows = self.table(name, found["segments"])
                    if rows is not None:
                        rows.write.parquet(f"{where}/{name}")
                        segment["schemas"][name] = rows.schema.jsonValue()
                rows = self._numbered(found["segments"])
                if rows is not None:
                    segment["schemas"]["postings"] = self._put_postings(rows.join(self._part(segment, "lengths").select("n"), "n", "left_semi"), where, sum(self.folder.size(f"{s['name']}/postings") for s in found["segments"] if "postings" in s["schemas"]))
                segment |= self._sums(self._part(segment, "lengths")) if "lengths" in segment["schemas"] else {"n": 0, "total": 0}
                self.folder.write("CURRENT", json.dumps({**found, "segments": [segment]}))
        except BaseException:
            self.folder.drop(segment["name"])
            raise
        return segment["name"]

    def sweep(self) -> list[str]:
        """Drop the folders of segments that CURRENT does not list: of runs that ended early, and from before a compaction."""
        have = {s["name"] for s in self.current()["segments"]}
        old = [n for n in self.folder.names() if n != "CURRENT" and n not in have]
        for n in old:
            self.folder.drop(n)
        return old


def bucket(buckets: int):
    return F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket")


def changes(store: Store, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to parse, ids of documents that go) of files (source_id, path, content; null content: deleted), one row of each, against what is stored."""
    new = found.select("source_id", "path", "content", X.stable_public_id("doc", F.col("source_id"), F.col("path")).alias("document_id"), X.sha256_text(F.col("content")).alias("hash"))
    have = store.table("documents")
    if have is None:
        return new.filter("content IS NOT NULL").select("source_id", "path", "content", "document_id"), new.select("document_id").limit(0)
    both = kept(new.join(have.select("document_id", "content_hash"), "document_id", "left").filter("NOT (hash <=> content_hash)"))
    gone = both.filter("content_hash IS NOT NULL").select("document_id")
    return both.filter("content IS NOT NULL").select("source_id", "path", "content", "document_id"), gone


def valid(sources: DataFrame) -> Callable[[dict[str, DataFrame]], None]:
    return lambda tables: maintenance.require_valid({"sources": sources, **tables})
