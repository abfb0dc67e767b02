"""Results that are used more than once."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files: they go with the job that needs them, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder of spark.checkpoint.dir; in local mode without one, persisted."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not where:
            return df.persist()
        spark.sparkContext.setCheckpointDir(where)
    with swept(spark):
        return df.select("*").checkpoint()  # a new plan, made under the setting
