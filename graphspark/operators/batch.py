"""Batches of questions against one graph, whose index is written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .question import Options, retrieve
from .traverse import Step

ANSWER = "line long, id string, type string, error string"


def answer(g: Graph, requests: DataFrame, problems: DataFrame, options: Options = Options(), step: Step | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, nodes) for requests (line, id, question): a response a line, error or result; and the nodes of each result.

    ``problems`` are lines that could not be read (line, id, problem).  A request is a query of its own, so
    a batch is finite and its requests pass the driver; nodes and edges are read from what ``step`` has written.
    """
    spark = g.nodes.sparkSession
    if step:
        g = Graph(step(g.nodes), step(g.edges))
    said = [(r.line, r.id, "error", r.problem) for r in problems.collect()]
    found = []
    for r in requests.orderBy("line").collect():
        try:
            context = retrieve(g, r.question, options, step)
        except ValueError as error:
            said.append((r.line, r.id, "error", str(error)))
            continue
        said.append((r.line, r.id, "result", None))
        if context is not None:
            found.append(context.nodes.select(F.lit(r.id).alias("request"), "place", "id", "seed", "distance", "score", "tokens"))
    none = spark.createDataFrame([], "request string, place int, id string, seed boolean, distance int, score long, tokens int")
    return spark.createDataFrame(sorted(said), ANSWER), reduce(DataFrame.unionByName, found, none)
