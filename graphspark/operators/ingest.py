"""Enrichment: validation and application of fragments, carried-over rows after an update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph, merge_edges, merge_nodes


def violations(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(id, problem): everything that keeps a fragment from being applied."""

    def bad(df: DataFrame, condition, problem: str) -> DataFrame:
        return df.filter(condition).select("id", F.lit(problem).alias("problem"))

    def provenance(df: DataFrame) -> DataFrame:
        level = F.coalesce(F.col("meta")["confidence"], F.lit(""))
        lacks = lambda k: F.coalesce(F.col("meta")[k], F.lit("")) == ""
        return (
            bad(df, ~level.isin("extracted", "inferred"), "unknown confidence")
            .union(bad(df, (level == "extracted") & lacks("evidence"), "extracted without evidence"))
            .union(bad(df, (level == "inferred") & lacks("rationale"), "inferred without rationale"))
        )

    lacks = lambda df, *columns: df.filter(" OR ".join(f"coalesce({c}, '') = ''" for c in columns)).select("id", F.lit("missing field").alias("problem"))
    bare = lacks(nodes, "id", "kind", "name").union(lacks(edges, "kind", "src", "dst"))
    twice = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated node").alias("problem"))
    ids = known.select("id").union(nodes.select("id")).distinct()
    ends = edges.select("id", F.explode(F.array("src", "dst")).alias("end"))
    loose = ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti").select("id", F.lit("unknown end").alias("problem")).distinct()
    return provenance(nodes).union(provenance(edges)).union(bare).union(twice).union(loose)


def apply(g: Graph, nodes: DataFrame, edges: DataFrame, source: str) -> Graph:
    """The graph with a fragment merged in; what the graph had wins, and new rows carry their source."""
    stamp = lambda df: df.withColumn("meta", F.map_concat(F.map_filter("meta", lambda k, v: k != "source"), F.create_map(F.lit("source"), F.lit(source))))
    columns, ends = g.nodes.columns, g.edges.columns
    n = g.nodes.withColumn("_o", F.lit(0)).unionByName(stamp(nodes).select(*columns).withColumn("_o", F.lit(1)))
    e = g.edges.withColumn("_o", F.lit(0)).unionByName(stamp(edges).select(*ends).withColumn("_o", F.lit(1)))
    return Graph(merge_nodes(n, "_o"), merge_edges(e, "_o"))
