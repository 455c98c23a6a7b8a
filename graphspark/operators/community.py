"""Communities: edge weights, modularity moves by component, names, summaries, label transfer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import community_id
from ..functions.text import path_group
from ..schema import CONTAINER_KINDS, STRONG_KINDS
from .graph import Graph, first_per_key, valid_edges

# Resolution of the presets in hundredths, and the unit of weights.
RESOLUTION = {"coarse": 75, "balanced": 100, "fine": 150}
UNIT = 1024
PASSES = 50
SMALL, MERGED = 4, 8


def edge_weight(kind: Column) -> Column:
    return F.when(kind.isin(*STRONG_KINDS), F.lit(3)).otherwise(F.lit(1)).cast("bigint") * UNIT


def down_weight(weight: Column, degree: Column, threshold: int) -> Column:
    """Edges at a node above the threshold lose weight in proportion, whole numbers, 1 at least."""
    less = F.greatest(F.lit(1).cast("bigint"), F.floor(weight * threshold / degree).cast("bigint"))
    return F.when(degree > threshold, less).otherwise(weight) if threshold >= 0 else weight


def weighted_edges(g: Graph, threshold: int) -> DataFrame:
    """(src, dst, kind, weight) of edges between different nodes, hubs taken into account."""
    own = valid_edges(g).filter("src <> dst")
    n = own.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    both = own.join(n.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(n.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    once = down_weight(edge_weight(F.col("kind")), F.col("ds"), threshold)
    return both.withColumn("weight", once).withColumn("weight", down_weight(F.col("weight"), F.col("dd"), threshold)).select("src", "dst", "kind", "weight")


def components(pairs: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 100) -> DataFrame:
    """(id, component): connected parts, by spreading the smallest id and jumping over known labels."""
    both = step(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(pairs.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    label = step(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lower = label.join(near, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        far = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = step(lower.join(far, "component").select("id", F.least("component", "further").alias("component"), "old"))
        label = new.select("id", "component")
        if not new.filter("component <> old").take(1):
            return label
    raise RuntimeError("components did not settle")


def local_moves(ids: list[str], src: np.ndarray, dst: np.ndarray, weight: np.ndarray, twice_total: int, resolution: int, coarse: bool) -> list[int]:
    """Label (the place of a node) of every node of one component; ``ids`` ascend.

    Nodes are visited in order; each takes the neighbouring label with the best gain, of equals
    the smallest, until a visit of all changes nothing.  Whole numbers only.
    """
    n = len(ids)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    degree = [sum(x.values()) for x in near]
    label, total = list(range(n)), list(degree)
    for _ in range(PASSES):
        moved = False
        for i in range(n):
            if not degree[i]:
                continue
            here = label[i]
            total[here] -= degree[i]
            gain: dict[int, int] = {here: 0}
            for j, w in near[i].items():
                gain[label[j]] = gain.get(label[j], 0) + w
            best = max(gain, key=lambda c: (gain[c] * twice_total * 100 - total[c] * degree[i] * resolution, -c))
            label[i] = best
            total[best] += degree[i]
            moved |= best != here
        if not moved:
            break
    if coarse:
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(label):
            groups.setdefault(c, []).append(i)
        for c in sorted(groups):
            own = groups[c]
            if not 0 < len(own) < SMALL:
                continue
            pull: dict[int, int] = {}
            for i in own:
                for j, w in near[i].items():
                    if label[j] != c:
                        pull[label[j]] = pull.get(label[j], 0) + w
            open_ = [t for t in pull if groups[t] and len(own) + len(groups[t]) <= MERGED]
            if open_:
                to = max(open_, key=lambda t: (pull[t], -t))
                for i in own:
                    label[i] = to
                groups[to] += own
                groups[c] = []
    return label


def assign(g: Graph, step: Callable[[DataFrame], DataFrame], threshold: int, preset: str = "balanced") -> DataFrame:
    """(id, community): stable ids of the communities of all nodes.

    The moves of a component depend on the rest of the graph only through the total weight and
    the hub threshold, so components are clustered apart, each in one task.  A node without
    edges is a community of its own.
    """
    edges = step(weighted_edges(g, threshold))
    twice = int(edges.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) * 2
    part = step(components(edges, step))
    rows = edges.join(part.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", "weight")
    resolution, coarse = RESOLUTION[preset], preset == "coarse"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)]))
        src, dst = np.searchsorted(ids, pdf["src"].to_numpy(object)), np.searchsorted(ids, pdf["dst"].to_numpy(object))
        label = local_moves(ids.tolist(), src, dst, pdf["weight"].to_numpy(), twice, resolution, coarse)
        return pd.DataFrame({"id": ids, "label": ids[label]})

    found = rows.groupBy("component").applyInPandas(kernel, "id string, label string")
    every = g.nodes.select("id").join(found, "id", "left").withColumn("label", F.coalesce("label", "id"))
    return stable_ids(every)


def stable_ids(labels: DataFrame) -> DataFrame:
    """(id, community) from (id, label): the id of a community is a hash of its members."""
    named = labels.groupBy("label").agg(community_id(F.collect_list("id")).alias("community"))
    return labels.join(named, "label").select("id", "community")


def names(nodes: DataFrame) -> DataFrame:
    """(community, label): the leading folders of the members, or a common name, or the first member."""
    group = nodes.withColumn("g", path_group(F.col("path"), F.col("kind")))
    weight = F.when(F.col("kind").isin(*CONTAINER_KINDS, "dir"), 3).otherwise(1)
    votes = group.filter("g <> ''").groupBy("community", "g").agg(F.sum(weight).alias("n"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "g"))
    two = votes.withColumn("r", place).filter("r <= 2").groupBy("community").agg(*[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("g", "n")])
    second = (F.col("g2") != "root") & (F.col("n2") * 100 >= F.col("n1") * 70)
    by_path = two.filter("g1 <> 'root'").select("community", F.when(second, F.concat_ws(" + ", "g1", "g2")).otherwise(F.col("g1")).alias("by_path"))
    anchors = nodes.filter(F.col("kind").isin("package", "module", "class", "interface", "domain", "flow")).withColumn("a", F.trim("name")).filter("a NOT IN ('', '.')").groupBy("community", "a").agg(F.count(F.lit(1)).alias("n"))
    by_name = first_per_key(anchors, ["community"], [F.desc("n"), F.col("a")]).select("community", F.col("a").alias("by_name"))
    first = nodes.groupBy("community").agg(F.min_by(F.struct("kind", "name"), "id").alias("f"))
    kind = F.replace(F.col("f.kind"), F.lit("_"), F.lit(" "))
    alone = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1000), F.lit(" · "), F.col("f.name"))
    return first.join(by_path, "community", "left").join(by_name, "community", "left").select("community", F.coalesce("by_path", "by_name", alone).alias("label"))


def summaries(nodes: DataFrame) -> DataFrame:
    """(community, size, kinds): the three most common kinds, as ``kind:n`` in order."""
    kinds = nodes.groupBy("community", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "kind"))
    top = kinds.withColumn("r", order).filter("r <= 3").groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "kind", "n"))), lambda x: F.concat_ws(":", x["kind"], x["n"].cast("string"))), ",").alias("kinds"))
    size = kinds.groupBy("community").agg(F.sum("n").alias("size"))
    return size.join(top, "community")


def overlaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new, both, either): sizes of the common part and the union of communities that share nodes."""
    old, new = before.select("id", F.col("community").alias("old")), after.select("id", F.col("community").alias("new"))
    shared = old.join(new, "id").groupBy("old", "new").agg(F.count(F.lit(1)).alias("both"))
    n_old, n_new = old.groupBy("old").agg(F.count(F.lit(1)).alias("no")), new.groupBy("new").agg(F.count(F.lit(1)).alias("nn"))
    return shared.join(n_old, "old").join(n_new, "new").select("old", "new", "both", (F.col("no") + F.col("nn") - F.col("both")).alias("either"))


def remap(before: DataFrame, after: DataFrame) -> DataFrame:
    """(new, old, status, both, either): which old label a community takes over.

    Pairs of which the common part is two fifths of the union or more take part; a community in
    which several such pairs meet takes none.  Then each old community goes to the new one it
    overlaps most: with one pair a new community, that is the first in order of each old one.
    """
    able = overlaps(before, after).filter("both * 5 >= either * 2")
    single = able.join(able.groupBy("new").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("new"), "new", "left_semi")
    # Fractions are compared as decimals of whole products, not as floats.
    share = (F.col("both").cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)") / F.col("either").cast("decimal(19,0)")).cast("decimal(38,9)")
    best = first_per_key(single.withColumn("_s", share), ["old"], [F.desc("_s"), F.col("new")]).drop("_s")
    status = F.when(F.col("old") == F.col("new"), "stable").when(F.expr("both * 10 >= either * 7"), "remapped").otherwise("provisional")
    return best.select("new", "old", status.alias("status"), "both", "either")
