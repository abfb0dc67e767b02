"""Session helpers of the subpackage: checkpoints, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that one task joins.
EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only in local mode without that setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column (Spark's names know no case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Compute now, keep the rows in the shared folder, forget the lineage and drop the shuffle files that led to them.

    ``few``: a result that is small beside what it is made of goes to fewer files, four for
    each core; a task then works through its partitions one after the other.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    has_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, made under the setting
    finally:
        spark.conf.set(CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the checkpoints of steps nothing refers to any more, and give the driver's free memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library knows how
        ctypes.CDLL(None).malloc_trim(0)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars: each vertex with the smallest one that it reaches over them."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(x) for x in range(len(ids))])
    some = np.flatnonzero(top != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[top[some]])], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 50, most: int = EDGES) -> DataFrame:
    """Connected components of (a, b) long edges (cut before, as they are read twice): rows (id, component), component the smallest id; cut.

    Edges are dealt to tasks, ``most`` to each, which join what they see.  What
    several tasks have left goes through the two star contractions in turn (every vertex
    hands its larger, then its smaller neighbours to the smallest of them), which end after
    about log(n) rounds whatever the shape; each round is two aggregations, the
    edges are checkpointed and only a count and a sum reach the driver.  A vertex's
    neighbourhood is never gathered: the minimum is an aggregate that is joined back.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = max(1, -(-edges.count() // most))
    e = cut(e.repartition(tasks).mapInArrow(joined, "u long, v long"))
    seen = None
    for _ in range(rounds if tasks > 1 else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        nxt = cut(small)
        state = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        e = nxt
        release(edges.sparkSession)
        if state == seen:
            break
        seen = state
    # every remaining edge is (vertex, smallest of its component)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
