"""The folder that all executors share, and steps that cut lineage in it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new one of this machine only in local runs that name none."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="graphspark-")


def stepper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Cuts lineage between the rounds of an iteration: a checkpoint in the folder all executors share."""
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint()
