"""Neighbourhoods, reachability by levels, shortest paths."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph

Step = Callable[[DataFrame], DataFrame]


def pairs_of(g: Graph, direction: str = "both", kinds: tuple[str, ...] | None = None, distinct: bool = True) -> DataFrame:
    """(a, b) steps along edges: out, in or both ways; each once, or (for walks, which do not mind) as often as edges stand."""
    own = g.edges if kinds is None else g.edges.filter(F.col("kind").isin(*kinds))
    out, into = own.select(F.col("src").alias("a"), F.col("dst").alias("b")), own.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = out if direction == "out" else into if direction == "in" else out.union(into)
    return steps.distinct() if distinct else steps


def distances(pairs: DataFrame, seeds: DataFrame, depth: int, step: Step | None = None) -> DataFrame:
    """(id, distance) of all that is within ``depth`` steps of ``seeds(id)``.

    One join a level; what is reached is reduced to distinct ids before it is compared with what
    was known, so a hub costs its neighbours once.
    """
    known = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    front = known.select("id")
    pairs = step(pairs) if step and depth > 1 else pairs  # made once, not once a level
    for d in range(1, depth + 1):
        reached = pairs.join(front, pairs["a"] == front["id"]).select(F.col("b").alias("id")).distinct()
        fresh = reached.join(known, "id", "left_anti")
        if step:
            fresh = step(fresh)
        known = known.union(fresh.withColumn("distance", F.lit(d)))
        front = fresh
    return known


def neighbours(g: Graph, id_: str) -> DataFrame:
    """(direction, kind, id, name): what is one edge away, out and in."""
    out = g.edges.filter(F.col("src") == id_).select(F.lit("out").alias("direction"), "kind", F.col("dst").alias("id"))
    into = g.edges.filter(F.col("dst") == id_).select(F.lit("in").alias("direction"), "kind", F.col("src").alias("id"))
    return out.union(into).distinct().join(g.nodes.select("id", "name"), "id").select("direction", "kind", "id", "name")


def impact(g: Graph, targets: DataFrame, depth: int = 2, step: Step | None = None) -> DataFrame:
    """Nodes within ``depth`` undirected steps of targets given by id, path or name."""
    keys = F.array(F.concat(F.lit("i"), "id"), F.concat(F.lit("p"), "path"), F.concat(F.lit("n"), F.lower("name")))
    asked = F.array(F.concat(F.lit("i"), "target"), F.concat(F.lit("p"), "target"), F.concat(F.lit("n"), F.lower("target")))
    wanted = targets.select(F.explode(asked).alias("key")).distinct()
    match = g.nodes.select("id", F.explode(keys).alias("key")).join(wanted, "key", "left_semi").select("id").distinct()
    return distances(pairs_of(g, distinct=False), match, depth, step).join(g.nodes.select("id"), "id", "left_semi")


def reverse_impact(g: Graph, seeds: DataFrame, depth: int, kinds: tuple[str, ...], step: Step | None = None) -> DataFrame:
    """What depends on the seeds, by the number of steps."""
    return distances(pairs_of(g, "in", kinds, distinct=False), seeds, depth, step)


def shortest_path(g: Graph, source: str, target: str, step: Step | None = None) -> tuple[str, list[str]]:
    """(mode, ids): along edges, or, where no such path is, along edges either way.

    Levels grow from the source until one is empty or holds the target.  Of several parents a node takes the one first reached, then
    the smaller id; only the path itself is collected.
    """
    step = step or (lambda df: df)
    if source == target:
        return "directed", [source]
    for mode, direction in (("directed", "out"), ("undirected_fallback", "both")):
        pairs = step(pairs_of(g, direction))
        known = front = step(g.nodes.filter(F.col("id") == source).select("id", F.lit("").alias("parent"), F.lit(0).alias("level"), F.lit("").alias("order")))
        for level in count(1):
            reached = pairs.join(front.select(F.col("id").alias("a"), F.concat("order", F.lit("\0"), "id").alias("order")), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("order", "a")).alias("m"))
            front = step(reached.join(known, "id", "left_anti").select("id", F.col("m.a").alias("parent"), F.lit(level).alias("level"), F.col("m.order").alias("order")))
            if not front.take(1):
                break
            known = step(known.union(front))
            if front.filter(F.col("id") == target).take(1):
                path = [target]
                while path[-1] != source:
                    path.append(known.filter(F.col("id") == path[-1]).select("parent").first()[0])
                return mode, path[::-1]
    return "none", []
