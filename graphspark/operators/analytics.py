"""Degrees, fan, entry points, views, change detection, cycles and call flows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import IMPACT_KINDS, SYMBOL_KINDS
from .graph import Graph, first_per_key


def degrees(g: Graph) -> DataFrame:
    """(id, degree): ends of edges at an id; a self-loop counts twice, unknown ends count too."""
    return g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def central_nodes(g: Graph, limit: int = 20) -> DataFrame:
    """Nodes by degree, then id; nodes without edges have degree 0."""
    ranked = g.nodes.join(degrees(g), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.orderBy(F.desc("degree"), "id").limit(limit).select("id", "kind", "name", "degree")


def high_fan(g: Graph, incoming: bool, limit: int = 20) -> DataFrame:
    """Symbols and imports by the number of edges that come in, or go out."""
    end = "dst" if incoming else "src"
    fan = g.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    own = g.nodes.filter(F.col("kind").isin(*SYMBOL_KINDS, "import"))
    return own.join(fan, "id").orderBy(F.desc("degree"), "id").limit(limit).select("id", "kind", "degree")


def core_packages(g: Graph) -> DataFrame:
    ranked = g.nodes.filter("kind = 'package'").join(degrees(g), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.select("id", "path", "degree", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "path", "id")).alias("place"))


def top_imports(g: Graph, kind: str = "imports", target: str = "import", limit: int = 20) -> DataFrame:
    """Targets by the number of edges of a kind that point to them."""
    n = g.edges.filter(F.col("kind") == kind).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.nodes.filter(F.col("kind") == target).join(n, "id").orderBy(F.desc("n"), "name", "id").limit(limit).select("id", "name", "n")


def entry_points(g: Graph) -> DataFrame:
    """main.go files, functions named main and nodes marked as entry points."""
    base = F.element_at(F.split("path", "/"), -1)
    entry = ((F.col("kind") == "file") & (base == "main.go")) | ((F.col("kind") == "function") & (F.col("name") == "main"))
    if "meta" in g.nodes.columns:
        entry = entry | (F.coalesce(F.col("meta")["entrypoint"], F.lit("")) == "true")
    return g.nodes.filter(entry)


def reading_order(g: Graph, limit: int = 12) -> DataFrame:
    """Entry points, then packages by degree; every node once."""
    first = entry_points(g).select("id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("rank"))
    then = core_packages(g).select("id", F.lit(1).alias("part"), F.col("place").cast("bigint").alias("rank"))
    once = first_per_key(first.union(then), ["id"], [F.col("part"), F.col("rank")])
    return once.orderBy("part", "rank", "id").limit(limit).select("id", "part", "rank")


def nearest_rank(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """The nearest-rank percentile."""
    return df.agg(F.expr(f"CAST(percentile_disc({share}) WITHIN GROUP (ORDER BY {column}) AS BIGINT)").alias(name))


def hub_threshold(g: Graph, floor: int = 50) -> DataFrame:
    """The larger of ``floor`` and the 99th percentile of the degree of all nodes; a self-loop counts once."""
    ends = g.edges.select(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst")).alias("e")).select(F.explode("e").alias("id"))
    n = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    every = g.nodes.select("id").join(n, "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return nearest_rank(every, "degree", 0.99, "p").select(F.greatest(F.lit(floor).cast("bigint"), F.coalesce("p", F.lit(0))).alias("threshold"))


def community_hub_threshold(g: Graph, floor: int = 50) -> DataFrame:
    """As hub_threshold, over nodes that have a neighbour, self-loops left out."""
    ends = g.edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("id"))
    n = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nearest_rank(n, "degree", 0.99, "p").select(F.greatest(F.lit(floor).cast("bigint"), F.coalesce("p", F.lit(0))).alias("threshold"))


# Node kinds of the workflow views, how many of the most central nodes join them, and which show no edges.
VIEW_KINDS = {
    "tech": ("package", "module", "schema", "table", "view"),
    "understand": ("domain", "flow", "step", "concept"),
    "learn": ("tour",),
    "docs": ("document", "section", "concept"),
    "pdf": ("document", "section", "concept"),
    "schema": ("schema", "table", "view", "column", "index"),
}
VIEW_CENTRAL = {"understand": 20, "learn": 30}
VIEW_WITHOUT_EDGES = ("tech",)


def workflow_view(g: Graph, view: str) -> Graph:
    """Nodes of a view's kinds, with some of the most central ones, and the edges among them."""
    from .graph import induced

    chosen = F.col("kind").isin(*VIEW_KINDS[view])
    if view == "pdf" and "meta" in g.nodes.columns:
        chosen = chosen | ((F.col("kind") == "file") & (F.coalesce(F.col("meta")["language"], F.lit("")) == "pdf"))
    if view in VIEW_CENTRAL:  # a fixed few ids
        chosen = chosen | F.col("id").isin(*[r.id for r in central_nodes(g, VIEW_CENTRAL[view]).collect()])
    nodes = g.nodes.filter(chosen)
    found = induced(g, nodes.select("id"))
    return Graph(nodes, found.edges.limit(0) if view in VIEW_WITHOUT_EDGES else found.edges)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): changed (new, or with another hash) and removed."""
    both = before.select("path", F.col("hash").alias("_b")).join(after.select("path", F.col("hash").alias("_a")), "path", "full_outer")
    kind = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull() | (F.col("_a") != F.col("_b")), "changed")
    return both.select("path", kind.alias("change")).filter("change IS NOT NULL")


def same_scan(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two scans have the same paths and hashes."""
    x, y = a.select("path", "hash"), b.select("path", "hash")
    return x.exceptAll(y).union(y.exceptAll(x)).agg((F.count(F.lit(1)) == 0).alias("same"))


def same_scans(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, same) for several scans at once: whether paths and hashes agree; repeated rows count."""
    each = lambda df, n: df.groupBy(by, "path", "hash").agg(F.sum(F.lit(n)).alias("n"))
    left = each(a, 1).unionByName(each(b, -1)).groupBy(by, "path", "hash").agg(F.sum("n").alias("n"))
    return left.groupBy(by).agg(F.bool_and(F.col("n") == 0).alias("same"))


def fresh_enrichment(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of rows (id, hashes: map of path to hash) of which every source still has its hash."""
    each = rows.select("id", F.explode("hashes").alias("path", "old"))
    held = each.join(files.select("path", "hash"), "path", "left").groupBy("id").agg(F.bool_and(F.coalesce(F.col("old") == F.col("hash"), F.lit(False))).alias("ok"))
    return held.filter("ok").select("id")


def batches(paths: DataFrame, by: list[Column], size: int) -> DataFrame:
    """Sorted paths in tasks of a fixed size within each group."""
    names = [f"g{i}" for i in range(len(by))]
    keyed = paths.select(*[c.alias(n) for c, n in zip(by, names, strict=True)], "path")
    n = F.row_number().over(Window.partitionBy(*names).orderBy("path"))
    return keyed.withColumn("batch", F.floor((n - 1) / size).cast("int")).groupBy(*names, "batch").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def strong_components(spark: SparkSession, pairs: DataFrame, step, most_rounds: int = 100) -> DataFrame:
    """(id, component) of nodes on cycles of ``pairs(src, dst)``; the component is its smallest id.

    Nodes that cannot be on a cycle are peeled off first.  Then, round by round, the smallest id
    that reaches a node and the smallest it reaches are spread to the end; where both agree a
    component is found and leaves.  ``step`` writes a frame and reads it back.
    """
    left = step(pairs.filter("src <> dst").select("src", "dst").distinct())
    loops = step(pairs.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    done = None
    for _ in range(most_rounds):
        size = left.count()
        while True:
            kept = step(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            n = kept.count()
            left = kept
            if n == size:
                break
            size = n
        if not size:
            break
        forward, backward = _spread(left, "src", "dst", step), _spread(left, "dst", "src", step)
        both = step(forward.withColumnRenamed("low", "f").join(backward.withColumnRenamed("low", "b"), "id"))
        found = both.filter("f = b").select("id", F.col("f").alias("component"))
        done = found if done is None else done.union(found)
        labels = both.filter("f <> b")
        s, d = labels.select(F.col("id").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), labels.select(F.col("id").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        left = step(left.join(s, "src").join(d, "dst").filter("f1 = f2 AND b1 = b2").select("src", "dst"))
    else:
        raise RuntimeError("strong components did not settle")
    return loops if done is None else done.union(loops.join(done.select("id"), "id", "left_anti"))


def _spread(pairs: DataFrame, a: str, b: str, step) -> DataFrame:
    """(id, low): the smallest id from which a node is reached along a -> b."""
    low = step(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("low", F.col("id")))
    while True:
        new = pairs.join(low, pairs[a] == low["id"]).groupBy(F.col(b).alias("id")).agg(F.min("low").alias("via"))
        after = step(low.join(new, "id", "left").select("id", F.least("low", "via").alias("new"), "low"))
        if not after.filter("new <> low").take(1):
            return low
        low = after.select("id", F.col("new").alias("low"))


def concrete_cycles(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(component, cycle): of each strong component one way round, found depth first from its smallest id, smaller ids first.

    ``pairs``: distinct src, dst; ``components``: id, component.  A component is one group, as its order of
    search is one; a node without a way back to the start is left once and for all, so a search is linear
    where no dead end is met twice.
    """
    member = components.select(F.col("id").alias("src"), "component")
    other = components.select(F.col("id").alias("dst"), F.col("component").alias("_c"))
    inside = pairs.join(member, "src").join(other, "dst").filter("component = _c").select("component", "src", "dst").distinct()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict[str, list[str]] = {}
        for a, b in sorted(zip(pdf["src"], pdf["dst"], strict=True)):
            ways.setdefault(a, []).append(b)
        start = min(ways)
        path, on, left = [start], {start}, [iter(ways[start])]
        while left:
            step = next(left[-1], None)
            if step is None:
                left.pop()
                on.discard(path.pop())
            elif step == start:
                return pd.DataFrame({"component": [pdf["component"].iloc[0]], "cycle": [" -> ".join([*path, start])]})
            elif step not in on:
                path.append(step)
                on.add(step)
                left.append(iter(ways.get(step, ())))
        return pd.DataFrame({"component": [], "cycle": []})

    return inside.groupBy("component").applyInPandas(kernel, "component string, cycle string")


def limited_neighbours(near: DataFrame, most: int) -> DataFrame:
    """Of an explanation's rows (direction, kind, id) the first ``most``: what goes out first, then what comes in."""
    return near.orderBy(F.when(F.col("direction") == "out", 0).otherwise(1), "kind", "id").limit(most)


def contributing_files(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths of files that some node stands in, or that the evidence of a node or edge names, with or without a line."""
    proof = lambda df: df.select(F.coalesce(F.col("meta")["evidence"], F.lit("")).alias("evidence")).filter("evidence <> ''")
    told = proof(nodes).union(proof(edges)).distinct()
    # Every prefix of evidence that ends before a colon may be a path.
    parts = F.split("evidence", ":")
    named = told.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))).alias("path"))
    return files.select("path").distinct().join(nodes.select("path").union(named).distinct(), "path", "left_semi")


def import_pairs(g: Graph) -> DataFrame:
    """Distinct resolved import edges among files, packages and modules."""
    ids = g.nodes.filter(F.col("kind").isin("file", "package", "module")).select("id")
    own = resolved(g.edges).filter("kind = 'imports'")
    return own.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def resolved(df: DataFrame) -> DataFrame:
    """Rows that are not marked as unresolved."""
    return df.filter(F.coalesce(F.col("meta")["resolved"], F.lit("")) != "false") if "meta" in df.columns else df


def call_flows(g: Graph, length: int = 6, flows: int = 10) -> DataFrame:
    """Representative call chains from entry points, then roots, then callers of many.

    Only resolved calls between resolved symbols that have a path count.  From each seed the
    chain goes to the callee that itself calls most and is not in it yet.  The first ``flows``
    seeds that call another symbol make a flow each; their chains grow together, one join a step.
    """
    symbols = resolved(g.nodes).filter(F.col("kind").isin(*SYMBOL_KINDS) & (F.coalesce("path", F.lit("")) != ""))
    ids = symbols.select("id")
    calls = resolved(g.edges).filter("kind = 'calls'").select("src", "dst").distinct()
    calls = calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"), F.bool_or(F.col("src") != F.col("dst")).alias("others"))
    into = calls.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    main = F.col("name") == "main"
    if "meta" in symbols.columns:
        main = main | (F.coalesce(F.col("meta")["entrypoint"], F.lit("")) == "true")
    seeds = out.join(into, "id", "left").join(symbols.select("id", main.alias("entry")), "id")
    rank = F.when(F.col("entry"), 0).when(F.col("called").isNull(), 1).otherwise(2)
    chains = seeds.filter("others").orderBy(rank, F.desc("out"), "id").limit(flows).select(F.array("id").alias("chain"), F.col("id").alias("seed"))
    weighed = calls.join(out.withColumnRenamed("id", "dst"), "dst", "left").withColumn("w", F.coalesce("out", F.lit(0))).select("src", "dst", "w")
    for _ in range(length - 1):
        last = chains.withColumn("src", F.element_at("chain", -1))
        # One best callee a chain: the largest (w, then smallest id) by a partial aggregate.
        ways = last.join(weighed, "src").filter(~F.array_contains("chain", F.col("dst")))
        best = ways.groupBy("seed").agg(F.min(F.struct(-F.col("w"), F.col("dst").alias("dst"))).alias("m")).select("seed", F.col("m.dst").alias("dst"))
        chains = chains.join(best, "seed", "left").withColumn("chain", F.when(F.col("dst").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("dst")))).drop("dst")
    return chains.select("seed", F.array_join("chain", " -> ").alias("flow"))


def impact_edges(g: Graph) -> DataFrame:
    return g.edges.filter(F.col("kind").isin(*IMPACT_KINDS))
