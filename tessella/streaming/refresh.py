"""A stream of changed files that keeps an index up to date, each batch exactly once.

A batch is compared with the index, parsed, validated and published as one segment,
and the number of the batch is part of the same pointer that publishes it.  A stream that
stops between writing and publishing leaves files nobody reads; one that stops after publishing
runs the batch again, which then is seen to be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources import build
from tessella.sources.segments import Store

CHANGES = "source_id string, path string, content string, at long"


def latest(rows: DataFrame) -> DataFrame:
    """Of several changes of one file the last (by ``at``; equal ones by content, a deletion first)."""
    order = Window.partitionBy("source_id", "path").orderBy(F.desc("at"), F.desc_nulls_last("content"))
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("source_id", "path", "content")


def apply_batch(spark: SparkSession, root: str, rows: DataFrame, batch: int, stream: str, sources: DataFrame) -> bool:
    """Bring one batch of changes into the index, unless it is there; whether it was brought."""
    done = Store(spark, root).current().get("streams", {})
    if done.get(stream, -1) >= batch:
        return False
    build.apply(spark, root, latest(rows), sources, {"streams": {**done, stream: batch}})
    return True


def refresh(spark: SparkSession, incoming: str, root: str, checkpoint: str, sources: DataFrame, stream: str = "refresh", files_per_batch: int | None = None) -> StreamingQuery:
    """Take in the changes (CHANGES) that lie as Parquet in ``incoming``, then end; called again it goes on where it was."""
    reader = spark.readStream.schema(CHANGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        given = own.createDataFrame(sources.collect(), sources.schema) if own is not sources.sparkSession else sources  # the registry of sources is small
        apply_batch(own, root, rows, batch, stream, given)

    return reader.parquet(incoming).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
