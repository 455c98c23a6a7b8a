"""Graphs and their indexes on disk."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, symbols
from ..operators.lexical import build_index


def exists(path: str) -> bool:
    """Whether a file is there, on any file system that has a URI here."""
    store, name = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}")
    return store.get_file_info(name).type != fs.FileType.NotFound


def save(g: Graph, folder: str) -> None:
    """Nodes, edges and symbols as Parquet."""
    g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    symbols(g).write.mode("overwrite").parquet(f"{folder}/symbols")


def load(spark: SparkSession, *folders: str) -> Graph:
    """The graph in the first of the folders that holds one."""
    for folder in folders:
        if exists(f"{folder}/nodes/_SUCCESS") and exists(f"{folder}/edges/_SUCCESS"):
            return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))
    raise FileNotFoundError(", ".join(folders))


def content_hash(df: DataFrame) -> str:
    """A hash of the rows in any order: sums of row hashes, by partial aggregation."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    parts = [F.sum(F.xxhash64(F.lit(i), row).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return f"{got.n:x}-" + "-".join(f"{int(got[f'h{i}'] or 0) % (1 << 64):016x}" for i in range(2))


def graph_hash(g: Graph) -> str:
    return f"{content_hash(g.nodes)}.{content_hash(g.edges)}"


def cached_index(spark: SparkSession, g: Graph, folder: str) -> DataFrame:
    """The lexical index of a graph, built only where its hash has none."""
    path = f"{folder}/index-{graph_hash(g)}"
    if not exists(f"{path}/_SUCCESS"):
        build_index(g.nodes).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
