"""The property graph that the relational and text tables describe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id
from ..operators.graph import Graph


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(scheme: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), (F.col(value) if isinstance(value, str) else value).cast("string"))


def _node(df: DataFrame, kind: str, id_: Column, name: Column, path: Column | None = None, package: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), (none if path is None else path).alias("path"), (none if package is None else package).alias("package"))


def _edge(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"))


def relational_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders."""
    t = {n: load(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = [
        _node(t["region"], "domain", _id("region", "r_regionkey"), F.col("r_name")),
        _node(t["nation"], "package", _id("nation", "n_nationkey"), F.col("n_name"), F.concat(F.lit("world/"), F.col("n_name"))),
        _node(t["customer"], "class", _id("customer", "c_custkey"), F.col("c_name"), None, _id("nation", "c_nationkey")),
        _node(t["supplier"], "module", _id("supplier", "s_suppkey"), F.col("s_name"), None, _id("nation", "s_nationkey")),
        _node(t["part"], "type", _id("part", "p_partkey"), F.col("p_name"), None, F.col("p_brand")),
        _node(t["orders"], "function", _id("order", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
    ]
    line = t["lineitem"]
    edges = [
        _edge(t["nation"], "contains", _id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        _edge(t["customer"], "contains", _id("nation", "c_nationkey"), _id("customer", "c_custkey")),
        _edge(t["supplier"], "contains", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")),
        _edge(t["orders"], "defines", _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        _edge(line.select("l_orderkey", "l_partkey").distinct(), "calls", _id("order", "l_orderkey"), _id("part", "l_partkey")),
        _edge(line.select("l_partkey", "l_suppkey").distinct(), "depends_on", _id("part", "l_partkey"), _id("supplier", "l_suppkey")),
    ]
    return Graph(reduce(DataFrame.unionAll, nodes), with_ids(reduce(DataFrame.unionAll, edges)))


def text_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Sources and documents, pages, conversations and their turns, users and event types."""
    docs, pages, turns, events = (load(spark, sf_dir, n) for n in ("documents", "pages", "conversations", "events"))
    own = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    following = turns.select("conv_id", "turn").withColumn("after", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("after IS NOT NULL")
    nodes = [
        _node(docs.select("source").distinct(), "dir", _id("src", "source"), F.col("source"), F.col("source")),
        _node(docs, "document", _id("document", "doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")), F.col("source")),
        _node(pages, "document", _id("page", "page_id"), F.col("url"), F.col("url")),
        _node(turns.select("conv_id").distinct(), "flow", _id("conv", "conv_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))),
        _node(turns, "step", _id("turn", own), F.col("role")),
        _node(events.select("event_type").distinct(), "concept", _id("event_type", "event_type"), F.col("event_type")),
        _node(events.select("user_id").distinct(), "step", _id("user", "user_id"), F.concat(F.lit("User "), F.col("user_id").cast("string"))),
    ]
    edges = [
        _edge(docs, "contains", _id("src", "source"), _id("document", "doc_id")),
        _edge(turns, "contains", _id("conv", "conv_id"), _id("turn", own)),
        _edge(following, "flows_to", _id("turn", own), _id("turn", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("after").cast("string")))),
        _edge(events.select("event_type", "user_id").distinct(), "affects", _id("event_type", "event_type"), _id("user", "user_id")),
    ]
    return Graph(reduce(DataFrame.unionAll, nodes), with_ids(reduce(DataFrame.unionAll, edges)))


def full_graph(spark: SparkSession, sf_dir: str) -> Graph:
    a, b = relational_graph(spark, sf_dir), text_graph(spark, sf_dir)
    return Graph(a.nodes.unionAll(b.nodes), a.edges.unionAll(b.edges))


def with_ids(edges: DataFrame) -> DataFrame:
    return edges.select(edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "kind", "src", "dst")
