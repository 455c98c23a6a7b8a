"""Assembly of graphs: keyed merge, metrics, topology, set operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id
from ..schema import SYMBOL_KINDS


@dataclass(frozen=True)
class Graph:
    """Nodes (id, kind, name, path, package, ..) and edges (id, kind, src, dst, ..)."""

    nodes: DataFrame
    edges: DataFrame


def first_filled(column: str, order: str) -> Column:
    """The first value in order that is neither null nor empty; null when there is none."""
    return F.expr(f"min_by(`{column}`, `{order}`) FILTER (WHERE `{column}` IS NOT NULL AND CAST(`{column}` AS STRING) <> '')").alias(column)


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row an id: of every scalar the first filled value wins; rows without an id are dropped.

    An aggregate with partial combination, so an id that comes very often costs no more.
    """
    scalars = [c for c in nodes.columns if c not in ("id", order, "meta")]
    kept = nodes.filter(F.coalesce("id", F.lit("")) != "")
    merged = kept.groupBy("id").agg(*[first_filled(c, order) for c in scalars])
    return merged.join(merge_meta(kept.select("id", "meta", order), order), "id", "left") if "meta" in nodes.columns else merged


def merge_meta(rows: DataFrame, order: str) -> DataFrame:
    """(id, meta): all keys; of each key the last filled value, or the first row's where none is."""
    first = rows.groupBy("id").agg(F.min(order).alias("_first"))
    values = rows.select("id", F.col(order).alias("_o"), F.explode("meta").alias("key", "value")).join(first, "id")
    usable = values.filter((F.col("value") != "") | (F.col("_o") == F.col("_first")))
    rank = F.when(F.col("value") != "", F.col("_o")).otherwise(F.col("_o") - F.lit(1 << 40))
    last = usable.groupBy("id", "key").agg(F.max_by("value", rank).alias("value"))
    return last.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("meta"))


def merge_edges(edges: DataFrame, order: str) -> DataFrame:
    """One row an edge id; an edge without an id gets its content id, one without an end or kind is dropped."""
    whole = edges.filter((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != ""))
    own = whole.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", edge_id(F.col("kind"), F.col("src"), F.col("dst"))).otherwise(F.col("id")))
    first = own.groupBy("id").agg(*[F.min_by(c, order).alias(c) for c in ("kind", "src", "dst")])
    return first.join(merge_meta(own.select("id", "meta", order), order), "id", "left") if "meta" in edges.columns else first


def counts_by(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(count))


def metrics(g: Graph) -> dict[str, DataFrame]:
    """Histograms: nodes by kind, edges by kind, file nodes by language (in ``meta``)."""
    out = {"nodes_by_kind": counts_by(g.nodes, "kind"), "edges_by_kind": counts_by(g.edges, "kind")}
    if "meta" in g.nodes.columns:
        out["languages"] = counts_by(g.nodes.filter("kind = 'file'").withColumn("language", F.col("meta")["language"]).filter("language <> ''"), "language")
    return out


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(parent, child) of the folder tree over file paths; the parent of the outermost is ``.``."""
    parts = F.split(F.col(path), "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.when(i == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i - 1), "/")).alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("child")))
    return files.select(F.explode(chain).alias("c")).select("c.parent", "c.child").distinct()


def symbols(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*SYMBOL_KINDS))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def valid_edges(g: Graph) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = g.nodes.select("id")
    return g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(g.edges.columns)


def induced(g: Graph, ids: DataFrame) -> Graph:
    """The subgraph on a set of ids."""
    nodes = g.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return Graph(nodes, valid_edges(Graph(nodes, g.edges)))


def merge_workspaces(graphs: dict[str, Graph]) -> Graph:
    """Graphs under aliases: ids, paths and packages are prefixed, parallel edges fall together.

    An edge to an unknown node is an error: the anti join must be empty.
    """
    nodes, edges = None, None
    for at, (alias, g) in enumerate(sorted(graphs.items())):
        tag = lambda c, a=alias: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col(c)).otherwise(F.concat(F.lit(f"{a}/"), F.col(c)))
        n = g.nodes.select(F.concat(F.lit(f"{alias}::"), F.col("id")).alias("id"), "kind", "name", tag("path").alias("path"), tag("package").alias("package"), F.lit(at).alias("_o"))
        e = g.edges.select("kind", F.concat(F.lit(f"{alias}::"), F.col("src")).alias("src"), F.concat(F.lit(f"{alias}::"), F.col("dst")).alias("dst"), F.lit(at).alias("_o"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    merged = merge_edges(edges.withColumn("id", F.lit("")), "_o")
    return Graph(merge_nodes(nodes, "_o"), merged)
