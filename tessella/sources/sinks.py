"""Writing tables: snapshots that appear at once, backups, fingerprints."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.maintenance import prunable
from tessella.schema import SCHEMA_VERSION


class Folder:
    """Files of a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole text at once under its name: written beside it and renamed over it.

        Without a checksum file beside it: a second rename could be seen apart from the first.
        """
        part, fs = self.path(f".{name}.{uuid.uuid4().hex}"), self.fs
        if is_instance_of(self.gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem"):
            checksum, fs = fs.getChecksumFile(self.path(name)), fs.getRawFileSystem()
            fs.delete(checksum, False)
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri() if self.path("").toUri().getScheme() else self.fs.getUri(), self.fs.getConf())
        over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = self.jvm.java.lang.Enum.valueOf(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
        context.rename(part, self.path(name), over)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path("")) if not x.getPath().getName().startswith("."))

    def size(self, name: str) -> int:
        """Bytes below a folder."""
        return self.fs.getContentSummary(self.path(name)).getLength()

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], validate: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Write all tables to a folder of their own, check them as written, then point CURRENT to it; on any error nothing changes."""
    version = f"v{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    folder = Folder(spark, root)
    try:
        for name, t in tables.items():
            t.write.parquet(f"{folder.root}/{version}/{name}")
        if validate:
            validate({name: spark.read.parquet(f"{folder.root}/{version}/{name}") for name in tables})
        folder.write("CURRENT", json.dumps({"version": version, "schema_version": SCHEMA_VERSION, "tables": sorted(tables)}))
    except BaseException:
        folder.drop(version)
        raise
    return version


def open_current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that CURRENT points to; another schema version is refused."""
    folder = Folder(spark, root)
    current = json.loads(folder.read("CURRENT"))
    if current["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {current['schema_version']}, expected {SCHEMA_VERSION}")
    return {name: spark.read.parquet(f"{folder.root}/{current['version']}/{name}") for name in current["tables"]}


def backup(spark: SparkSession, root: str, target: str, retain: int = 7) -> str:
    """Copy the current tables to a dated folder with a manifest; keep the newest ``retain`` and this one."""
    name = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    copy, rows = Folder(spark, f"{target.rstrip('/')}/{name}"), {}
    for table, df in open_current(spark, root).items():
        df.write.mode("overwrite").parquet(f"{copy.root}/{table}")
        # the footers of what was written know their rows
        rows[table] = spark.read.parquet(f"{copy.root}/{table}").count()
    copy.write("manifest.json", json.dumps({"created": name, "rows": rows}))
    folder = Folder(spark, target)
    for old in prunable(spark.createDataFrame([(n,) for n in folder.names()], "name string"), retain).collect():
        if old.name != name:
            folder.drop(old.name)
    return name


def fingerprint(chunks: DataFrame, digits: int = 4) -> DataFrame:
    """One row: a hash over all (chunk_id, content_hash) and their number.

    Rows are hashed in buckets of the id (16 ** digits of them: more digits for more chunks)
    and the buckets' hashes are hashed again, so that no task or row ever holds all chunks.
    """
    row = F.concat("chunk_id", F.lit("\0"), "content_hash")
    bucket = F.substring(F.sha2("chunk_id", 256), 1, digits)
    fine = chunks.groupBy(bucket.alias("fine")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    coarse = fine.groupBy(F.substring("fine", 1, 2).alias("coarse")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("fine", "h"))), "\n"), 256).alias("h"), F.sum("n").alias("n"))
    return coarse.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("coarse", "h"))), "\n"), 256).alias("h"), F.sum("n").alias("n")).select(F.sha2(F.concat("h", F.lit("count:"), F.col("n").cast("string")), 256).alias("fingerprint"))
