"""Live updates: a file stream of scans that keeps the current scan and its changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.analytics import changes
from ..sources.store import exists

SCAN = "path string, hash string, revision long"


def watch(spark: SparkSession, folder: str, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Follow scans written as Parquet to ``folder``; each batch replaces the state and tells what changed.

    The state of a batch is a folder of its own, named by the batch, so that a batch that runs
    again after a failure gives the same result.
    """
    def update(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg({"revision": "max"}).withColumnRenamed("max(revision)", "revision")
        scan = batch.join(newest, ["path", "revision"]).select("path", "hash").distinct()
        before = spark.read.parquet(f"{state}/scan-{number - 1}") if number and exists(f"{state}/scan-{number - 1}") else scan.limit(0)
        scan.write.mode("overwrite").parquet(f"{state}/scan-{number}")
        after = spark.read.parquet(f"{state}/scan-{number}")
        found = changes(before, after)
        found.write.mode("overwrite").parquet(f"{state}/changes-{number}")
        if on_change:
            on_change(spark.read.parquet(f"{state}/changes-{number}"), number)

    return spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(folder).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
