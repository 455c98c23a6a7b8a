"""Helpers shared by the corpus operators: table access, working folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession

# Texts are handed to the kernels in slices of about this many bytes, so that a batch
# of very long texts needs no more memory than one of short ones.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's, or (in local runs without one) a new one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="graphspark-"))
    return context.getCheckpointDir()


def work_table(spark: SparkSession, df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the written table.

    Cuts lineage in a way that survives the loss of executors: the files are replicated
    by the shared store, not by a block manager.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def work_database(spark: SparkSession) -> str:
    """A database for managed tables in the shared folder; dropping it with CASCADE removes their files."""
    name = f"graphspark_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the strings of ``column`` in each add up to about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *columns: str) -> DataFrame:
    """Run ``kernel`` over Arrow batches of ``columns`` of ``df``; only these columns are read."""
    return df.select(*columns).mapInArrow(kernel, schema)


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and offset in its row of every element of a ragged array with these row lengths."""
    lengths = np.asarray(lengths, np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return rows, np.arange(len(rows)) - starts[rows]


def gather_ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lengths[i]]."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]

