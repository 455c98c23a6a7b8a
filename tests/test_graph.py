"""Operators on the small graphs whose results are known, and the catalog against its SQL."""

import os
import random

import duckdb
import numpy as np
import pytest
from graphspark.functions import text as T
from graphspark.operators import affected as AF
from graphspark.operators import analytics as A
from graphspark.operators import anchors as AN
from graphspark.operators import community as C
from graphspark.operators import evaluate as E
from graphspark.operators import graph as G
from graphspark.operators import question as Q
from graphspark.operators import retrieve as R
from graphspark.operators import reviews as P
from graphspark.operators import traverse as V
from graphspark.sources import extract as X
from graphspark.sources import references as Y
from graphspark.sources import scan as N
from graphspark.sources.tables import with_ids
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def graph(spark, edges, kinds=None):
    ids = sorted({x for e in edges for x in e[1:]})
    nodes = spark.createDataFrame([(i, (kinds or {}).get(i, "function"), i, None, None) for i in ids], "id string, kind string, name string, path string, package string")
    return G.Graph(nodes, with_ids(spark.createDataFrame(edges, "kind string, src string, dst string")))


def step(df):
    return df.checkpoint()


def test_two_triangles_are_two_communities(spark):
    g = graph(spark, [("calls", a, b) for a, b in ("ab", "bc", "ca", "xy", "yz", "zx")])
    found = {r.id: r.community for r in C.assign(g, step, 50).collect()}
    assert len({found[x] for x in "abc"}) == 1 and len({found[x] for x in "xyz"}) == 1 and found["a"] != found["x"]


def test_moves_are_those_of_the_whole_graph():
    """Components clustered apart give what a plain loop over the whole graph gives."""
    r = random.Random(1)
    for preset in ("coarse", "balanced", "fine"):
        for _ in range(30):
            n = 14
            pairs = [(a, b, r.choice((1024, 3072))) for a in range(n) for b in range(a + 1, n) if a // 7 == b // 7 and r.random() < 0.35]
            twice = 2 * sum(w for _, _, w in pairs)
            if not pairs:
                continue
            whole = C.local_moves(list(range(n)), *map(np.array, zip(*pairs, strict=True)), twice, C.RESOLUTION[preset], preset == "coarse")
            for part in (range(7), range(7, 14)):
                own = [(a - part[0], b - part[0], w) for a, b, w in pairs if a in part]
                if own:
                    apart = C.local_moves(list(part), *map(np.array, zip(*own, strict=True)), twice, C.RESOLUTION[preset], preset == "coarse")
                    assert [whole[i] for i in part] == [x + part[0] for x in apart]


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ({"o": "abcd"}, {"n": "abcde"}, {("n", "o", "remapped")}),
        ({"o": "abc"}, {"n": "abx"}, {("n", "o", "provisional")}),
        ({"o": "abc"}, {"n": "axy"}, set()),
        ({"o": "abcdef"}, {"n": "abcd", "m": "ef"}, {("n", "o", "provisional")}),
        ({"o": "ab", "p": "cd"}, {"n": "abcd"}, set()),
        ({"o": "ab"}, {"o": "ab"}, {("o", "o", "stable")}),
    ],
)
def test_remap(spark, old, new, want):
    frame = lambda d: spark.createDataFrame([(x, c) for c, xs in d.items() for x in xs], "id string, community string")
    assert {(r.new, r.old, r.status) for r in C.remap(frame(old), frame(new)).collect()} == want


def test_walks(spark):
    g = graph(spark, [("calls", "root", "a"), ("calls", "root", "b"), ("calls", "a", "a1"), ("calls", "b", "b1")])
    order = lambda **k: [r.id for r in R.context(g, ["root"], depth=3, direction="out", **k).orderBy("place").collect()]
    assert order() == ["root", "a", "b", "a1", "b1"]
    assert order(depth_first=True) == ["root", "a", "a1", "b", "b1"]


def test_fan_out_counts_new_nodes_only():
    near = {"s": [("x", 1), ("t", 1)], "t": [("x", 1), ("p", 1), ("q", 1)]}
    assert R.walk(near, ["s"], 3, 2, -1, 100, False) == [("s", 0), ("x", 1), ("t", 1), ("p", 2), ("q", 2)]
    assert R.walk({"s": [("h", 60)], "h": [("z", 1)]}, ["s"], 3, 4, 50, 100, False) == [("s", 0), ("h", 1)]


@pytest.mark.parametrize("depth_first", [False, True])
def test_context_writes_what_it_touches_only(spark, depth_first):
    """A walk like that over all steps of the graph, of which no more is written than stands about the seeds."""
    r = random.Random(5)
    near = {(r.choice(("calls", "contains")), f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(30)}
    far = [("calls", f"x{i}", f"y{i}") for i in range(500)]
    g = graph(spark, sorted(near) + far)
    rows, ways = g.edges.collect(), {}
    for e in rows:
        ways.setdefault(e.src, []).append((e.dst, e))
        if e.src != e.dst:
            ways.setdefault(e.dst, []).append((e.src, e))
    degree = {a: len(steps) for a, steps in ways.items()}
    listed = {a: [(b, degree[b]) for b, e in sorted(steps, key=lambda s: (R.EDGE_RANK[s[1].kind], degree[s[0]], s[0], s[1].id))] for a, steps in ways.items()}
    written = []

    def counted(df):
        out = df.checkpoint()
        written.append(out.count())
        return out

    seeds = ["n1", "gone", "n2"]
    found = R.context(g, seeds, depth=3, hub=6, fan=2, depth_first=depth_first, step=counted).orderBy("place").collect()
    assert [(x.id, x.distance) for x in found] == R.walk(listed, seeds, 3, 2, 6, 2000, depth_first)
    assert max(written) <= 2 * len(near)


def test_pack_passes_over_what_does_not_fit(spark):
    nodes = spark.createDataFrame([("a", "k", "n" * 30, None, None), ("b", "k", "n" * 300, None, None), ("c", "k", "n", None, None)], "id string, kind string, name string, path string, package string")
    walked = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("c", 2, 1)], "id string, place int, distance int")
    assert [r.id for r in R.pack(walked, nodes, budget=40).orderBy("place").collect()] == ["a", "c"]


def test_affinity_records_more_than_the_frontier(spark):
    leaves = [f"l{i}" for i in range(6)]
    g = graph(spark, [("contains", "h", x) for x in leaves] + [("calls", "l0", "z"), ("calls", "l5", "y")])
    found = {r.id: r.affinity for r in R.affinity(g, spark.createDataFrame([("h",)], "id string"), frontier=2, step=step).collect()}
    # l5 has a value but is not among the two that hand theirs on, so y has none.
    assert found == pytest.approx({"h": 1.0, "z": 12**-0.5} | dict.fromkeys(leaves, 6**-0.5))


def test_paths(spark):
    g = graph(spark, [("calls", "b", "a"), ("calls", "a", "c"), ("calls", "c", "d"), ("calls", "a", "x"), ("calls", "x", "d")])
    assert V.shortest_path(g, "b", "d", step=step) == ("directed", ["b", "a", "c", "d"])
    assert V.shortest_path(g, "a", "b", step=step) == ("undirected_fallback", ["a", "b"])
    assert V.shortest_path(g, "a", "nowhere", step=step)[0] == "none"


def test_long_directed_path(spark):
    chain = [f"n{i:02}" for i in range(15)]
    g = graph(spark, [("calls", a, b) for a, b in zip(chain, chain[1:], strict=False)] + [("calls", chain[-1], chain[0])])
    assert V.shortest_path(g, chain[0], chain[-1], step=step) == ("directed", chain)


def test_strong_components(spark):
    r = random.Random(3)
    for _ in range(3):
        pairs = [(str(r.randrange(12)), str(r.randrange(12))) for _ in range(16)]
        reach = {a: {a} for a in map(str, range(12))}
        for _ in range(12):
            for a, b in pairs:
                for x in reach.values():
                    if a in x:
                        x.add(b)
        want = {}
        for a in reach:
            mates = {b for b in reach if b in reach[a] and a in reach[b]}
            if len(mates) > 1 or (a, a) in pairs:
                want[a] = min(mates)
        found = A.strong_components(spark, spark.createDataFrame(pairs, "src string, dst string"), step)
        assert {x.id: x.component for x in found.collect()} == want


def test_call_flow(spark):
    g = graph(spark, [("calls", "main", "load"), ("calls", "load", "store"), ("calls", "self", "self"), ("calls", "main", "gone"), ("calls", "gone", "far"), ("calls", "doc", "main")], {"doc": "document"})
    nodes = g.nodes.withColumn("path", F.lit("a.go")).withColumn("meta", F.when(F.col("id") == "gone", F.create_map(F.lit("resolved"), F.lit("false"))))
    found = A.call_flows(G.Graph(nodes, g.edges))
    # A call of itself, an unresolved symbol and a caller that is no symbol make no flow.
    assert sorted(tuple(r) for r in found.collect()) == [("load", "load -> store"), ("main", "main -> load -> store")]
    assert A.call_flows(g).count() == 0  # nodes without a path


def test_views(spark):
    kinds = {"p": "package", "f": "file", "t": "table", "c": "column", "s": "section", "d": "document", "x": "function", "o": "domain", "u": "tour"}
    g = graph(spark, [("contains", "p", "f"), ("contains", "t", "c"), ("contains", "d", "s"), ("calls", "x", "o"), ("contains", "t", "u"), ("contains", "p", "t")], kinds)
    view = lambda name: (sorted(r.id for r in A.workflow_view(g, name).nodes.collect()), sorted((r.src, r.dst) for r in A.workflow_view(g, name).edges.collect()))
    assert view("tech") == (["p", "t"], []) and view("docs") == (["d", "s"], [("d", "s")]) and view("schema") == (["c", "t"], [("t", "c")])
    # Central nodes fill these up: here all there are.
    assert len(view("understand")[0]) == len(view("learn")[0]) == 9 and len(view("learn")[1]) == 6


def test_checks(spark):
    cases = [
        ([], "unknown"),
        ([("SUCCESS", "", "")], "passing"),
        ([("", "completed", "neutral"), ("", "requested", "")], "passing"),
        ([("", "COMPLETED", "STARTUP_FAILURE")], "failing"),
        ([("", "queued", ""), ("success", "", "")], "pending"),
        ([("", "in_progress", ""), ("error", "", "")], "failing"),
        ([("strange", None, None)], "passing"),
    ]
    rows = spark.createDataFrame(cases, "checks array<struct<state: string, status: string, conclusion: string>>, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", P.check_summary(F.col("checks"))).collect())


def test_reviews(spark):
    files = spark.createDataFrame([(1, "auth/a.go"), (2, "auth/b.go"), (3, "./auth/a.go"), (3, "twice.go"), (1, "twice.go"), (2, "new.go")], "number int, path string")
    nodes = spark.createDataFrame([("f1", "file", "auth/a.go", "c1"), ("f2", "file", "auth/b.go", "c1"), ("f3", "file", "twice.go", "c2"), ("f4", "file", "twice.go", "c2"), ("x", "function", "auth/b.go", "c9")], "id string, kind string, path string, community string")
    mapped = P.mapped_files(files, nodes)
    rows = P.conflicts(mapped).collect()
    assert {(r.a, r.b, r.risk, *r.files, *r.communities) for r in rows} == {(1, 3, "file", "auth/a.go", "c1"), (1, 2, "community", "c1"), (2, 3, "community", "c1")}
    g = graph(spark, [("defines", "f1", "x"), ("calls", "y", "x"), ("calls", "z", "y"), ("calls", "w", "z"), ("calls", "x", "callee")])
    more = spark.createDataFrame([(i, "function", i, "", "") for i in ("x", "y", "z", "w", "callee")] + [("f1", "file", "f1", "auth/a.go", "c1")], "id string, kind string, name string, path string, community string")
    requests = spark.createDataFrame([(1, []), (2, None)], "number int, checks array<struct<state: string, status: string, conclusion: string>>")
    found = {r.number: (r.ci, r.changed, r.mapped, r.communities, r.affected) for r in P.analyze(G.Graph(more, g.edges), requests, files, step=step).collect()}
    assert found == {1: ("unknown", 2, 1, 1, 4), 2: ("unknown", 2, 0, 0, 0)}  # f1, x, y, z; w is too far, callee is not affected


def test_conflicts_of_all_orders(spark):
    """Against a plain loop over the whole tables; the highest orders have conflicts too."""
    import __spark_entry__ as entry
    import pyarrow.parquet as pq

    community = {r["p_partkey"]: f"{r['p_type']}-{r['p_brand']}" for r in pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_type", "p_brand"]).to_pylist()}
    files, groups = {}, {}
    for r in pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).to_pylist():
        files.setdefault(r["l_orderkey"], set()).add(f"part/{r['l_partkey']}")
        if r["l_partkey"] in community:
            groups.setdefault(r["l_orderkey"], set()).add(community[r["l_partkey"]])
    want = {}
    for a in files:
        for b in files:
            if a < b and (both := files[a] & files[b] or groups.get(a, set()) & groups.get(b, set())):
                want[a, b] = "file" if files[a] & files[b] else "community" if both else ""
    rows = entry.queries()["pr_conflicts"](spark, SF).collect()
    shared = {}
    for r in rows:
        shared.setdefault((r.kind, r.shared), []).append((r.number, r.requests))
    assert all(n == len(x) for x in shared.values() for _, n in x)
    got = {}
    for kind in ("community", "file"):
        for (k, _), x in shared.items():
            if k == kind:
                numbers = sorted(n for n, _ in x)
                got |= {(a, b): kind for i, a in enumerate(numbers) for b in numbers[i + 1 :]}
    assert got == want and max(b for _, b in got) > 400


def test_affected_begins_at_definitions(spark):
    edges = [("contains", "pkg", "f1"), ("contains", "pkg", "f2"), ("defines", "f1", "a"), ("defines", "f1", "b"), ("defines", "f2", "c"), ("calls", "x", "b"), ("calls", "y", "b"), ("calls", "z", "c"), ("calls", "u", "x"), ("calls", "b", "callee")]
    g = graph(spark, edges, {"pkg": "package", "f1": "file", "f2": "file"})
    targets = spark.createDataFrame([("pkg",), ("f1",), ("x",)], "target string")
    begin = lambda limit: {t: [r.id for r in sorted(AF.bootstrap(g, targets, limit).filter(F.col("target") == t).collect(), key=lambda r: r.place)] for t in ("pkg", "f1", "x")}
    assert begin(8) == {"pkg": ["pkg", "f1", "b", "f2", "c", "a"], "f1": ["f1", "b", "a"], "x": ["x"]}
    assert begin(4)["pkg"] == ["pkg", "f1", "b", "a"] and begin(2) == {"pkg": ["pkg"], "f1": ["f1", "b"], "x": ["x"]}
    found = {(r.target, r.id): r.distance for r in AF.affected(g, targets, 2, step=step).collect()}
    assert {i: d for (t, i), d in found.items() if t == "f1"} == {"f1": 0, "b": 0, "a": 0, "x": 1, "y": 1, "u": 2}
    assert {i: d for (t, i), d in found.items() if t == "x"} == {"x": 0, "u": 1}
    with pytest.raises(ValueError, match="mixed"):
        AF.affected_direction(("affects", "calls"))


def test_question_to_context(spark):
    edges = [("calls", "root", "critical"), ("calls", "critical", "deep"), *(("calls", "root", f"noise{i:02}") for i in range(20)), ("imports", "other", "root")]
    g = graph(spark, edges)
    nodes = g.nodes.withColumn("name", F.when(F.col("id") == "root", "parse config").when(F.col("id") == "critical", "load config").otherwise(F.col("id"))).withColumn("path", F.concat("id", F.lit(".go")))
    g = G.Graph(nodes, g.edges)
    found = Q.retrieve(g, "where is the config parsed by parse", Q.Options(max_nodes=10), step=step)
    rows = found.nodes.orderBy("place").collect()
    assert rows[0].id == "root" and rows[0].seed and {"critical", "deep"} <= {r.id for r in rows} and len(rows) <= 10
    stats = found.stats.first()
    assert stats.pruned > 0 and "branch_limit" in stats.reasons and stats.tokens <= 2000
    assert found.edges.orderBy("place").first().src == "root" and found.edges.count() <= 8
    assert Q.retrieve(g, "where is the config parsed by parse", Q.Options(max_nodes=100, fan=32), step=step).stats.first().pruned == 0
    # A relation that is asked for filters edges; the direction is preferred.
    asked = Q.retrieve(g, "who imports parse config", Q.Options(), step=step)
    assert [r.id for r in asked.nodes.orderBy("place").collect()] == ["root", "other"] and [r.kind for r in asked.edges.collect()] == ["imports"]
    assert Q.retrieve(g, "zebra", step=step) is None
    for bad, text in ((Q.Options(depth=9), "depth"), (Q.Options(relations=("cites",)), "cites"), (Q.Options(budget=5), "budget")):
        with pytest.raises(ValueError, match=text):
            Q.retrieve(g, "parse", bad)
    hit = Q.affected_context(g, "load config", Q.Options(depth=2), step=step)
    assert [r.id for r in hit.nodes.orderBy("place").collect()] == ["critical", "root", "other"]
    with pytest.raises(ValueError, match="not found"):
        Q.affected_context(g, "nobody")


def test_anchors(spark):
    text = """Why does this fail?
import React, { useState as state, type Ref } from 'lib/react-dom'
const { readFile: read, join } = require("node-fs")
from pkg.mod.sub import (alpha,
   beta as gamma)
import static com.acme.Tool.runAll;
import os.path as osp, sys
call parseConfig and snake_case but not plain Words"""
    found = AN.anchors(spark, text)
    assert {"react", "use state", "state", "ref", "read file", "read", "join", "alpha", "beta", "gamma", "run all", "osp", "path", "sys", "parse config", "snake case"} == set(found.names)
    assert found.inline == ("parse config", "snake case") and found.paths == ("com acme tool", "lib react dom", "node fs", "os path", "pkg mod sub")
    assert found.count() == 14 + 5 and found.count(True) == 16 + 5 and AN.anchors(spark, "nothing here").count(True) == 0
    g = graph(spark, [("calls", "a", "b"), ("calls", "c", "b")])
    nodes = g.nodes.withColumn("name", F.when(F.col("id") == "a", "parseConfig").when(F.col("id") == "b", "config parser for config").otherwise("other")).withColumn("path", F.when(F.col("id") == "c", "src/pkg/mod/x.py"))
    ranked, _ = Q.ranked_nodes(G.Graph(nodes, g.edges), ["config"], ["config"], AN.Anchors(("parse config",), (), ("pkg mod",)))
    rows = {r.id: r for r in ranked.collect()}
    assert rows["a"].anchored and rows["a"].score > 100_000 and not rows["c"].anchored and 20_000 <= rows["c"].score < 100_000 and rows["b"].score < 20_000
    assert Q.pick_seeds(ranked, {"config": 1.0}, 3) == ["a"]


def test_packing_has_two_phases():
    import pandas as pd

    nodes = pd.DataFrame([{"id": f"n{i}", "cost": 100 if i == 1 else 10, "via": f"e{i}" if i else None} for i in range(12)])
    edges = pd.DataFrame([{"id": f"e{i}", "src": "n0", "dst": f"n{i}", "cost": 5} for i in range(1, 12)])
    shown, explained, left = Q.packed(nodes, edges, Q.Options(budget=128, max_nodes=10), "", 10, 8)
    # 65 % of 110 on nodes, passing over n1, then edges, then nodes that still fit.
    assert [r["id"] for r in shown][:7] == ["n0", "n2", "n3", "n4", "n5", "n6", "n7"]
    assert len(explained) <= 8 and left["omitted"] >= 3 and left["reasons"] == ["max_nodes", "token_budget"] and left["tokens"] <= 120
    assert all(r["via"] is None or r["via"] in {e["id"] for e in explained} for r in shown)


def test_texts_of_lines(spark):
    rows = spark.createDataFrame([("a\x00b\n c",), ("x" * 401,), ("é" * 100,), ('q"\\',)], "t string")
    got = [tuple(r) for r in rows.select(T.safe_text(F.col("t")), T.safe_text_bytes(F.col("t"), 64), T.quote_field(F.col("t")), T.compact_id(F.col("t"))).collect()]
    assert got[0][0] == "a b c" and got[0][3] == '"a\\x00b\\n c"'
    assert got[1][0] == "x" * 399 + "…" and got[1][1] == "x" * 61 + "…"
    assert got[2][1] == "é" * 30 + "…" and got[3][2] == '"q\\"\\\\"'


def test_references_by_scope(spark):
    d = "path string, language string, kind string, name string, qualified string, start long, end long, line int, role string, partial boolean"
    defs = spark.createDataFrame(
        [
            ("a.ts", "typescript", "class", "Box", None, 0, 100, 1, None, False),
            ("a.ts", "typescript", "function", "open", None, 10, 20, 2, None, False),
            ("a.ts", "typescript", "function", "open", None, 30, 40, 3, None, False),
            ("a.ts", "typescript", "function", "open", None, 30, 35, 3, None, True),
            ("b.ts", "typescript", "function", "shut", None, 0, 10, 1, None, False),
            ("c.ts", "typescript", "function", "lone", None, 0, 10, 1, None, False),
        ],
        d,
    )
    own = Y.definitions(defs)
    assert sorted(r.id for r in own.collect()) == ["tree-symbol://typescript#a.ts#class#Box", "tree-symbol://typescript#a.ts#method#Box.open#overload-1", "tree-symbol://typescript#a.ts#method#Box.open#overload-2", "tree-symbol://typescript#b.ts#function#shut", "tree-symbol://typescript#c.ts#function#lone"]
    refs = spark.createDataFrame([("a.ts", "typescript", "calls", n, r, 15, 2, 1) for n, r in (("shut", ""), ("lone", "x"), ("lone", ""), ("open", ""), ("b.Box", ""))], "path string, language string, kind string, name string, receiver string, start long, line int, col int")
    uses = spark.createDataFrame([("a.ts", "typescript", "./b", None, "import", None, 1), ("a.ts", "typescript", "./nowhere", None, "import", None, 2)], "path string, language string, name string, source string, kind string, alias string, line int")
    files = spark.createDataFrame([("a.ts",), ("b.ts",), ("c.ts",)], "path string")
    found = Y.imports(uses, files)
    assert {r.name: r.target for r in found.collect()} == {"./b": "b.ts", "./nowhere": None}
    rows = Y.resolve_references(refs, own, Y.names(own, found)).collect()
    assert {r.src for r in rows} == {"tree-symbol://typescript#a.ts#method#Box.open#overload-1"}
    assert sorted((r.name, r.scope or "") for r in rows) == [("b.Box", "same file"), ("lone", ""), ("lone", "language"), ("open", ""), ("shut", "imported file")]
    paths = spark.createDataFrame([("src/a.py", "python", "..pkg.mod"), ("src/a.rs", "rust", "crate::x::y"), ("x/a.ts", "typescript", "../lib/b.js"), ("a.c", "c", "h/b.h")], "path string, language string, name string")
    assert [r[0] for r in paths.select(Y.import_paths(F.col("path"), F.col("language"), F.col("name"))).collect()] == [["src/pkg/mod.py", "src/pkg/mod/__init__.py", "pkg/mod.py", "pkg/mod/__init__.py"], ["src/x/y.rs", "src/x/y/mod.rs", "x/y.rs", "x/y/mod.rs"], ["lib/b.js"], ["h/b.h"]]


def test_fragment_of_all_documents(spark):
    import __spark_entry__ as entry
    import pyarrow.parquet as pq

    ids = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).column(0).to_pylist()
    lacks = {(f"note://{i}", "inferred without rationale") for i in ids if i % 20} | {(f"note://{i}", "extracted without evidence") for i in ids if i % 60 == 0}
    want = lacks | {(f"e{i}", "unknown end") for i in ids if i * 3 not in set(ids)}
    found = [(r.id, r.problem) for r in entry.queries()["fragment_validate"](spark, SF).collect()]
    assert len(found) == len(want) and set(found) == want
    rows = [tuple(r) for r in entry.queries()["fragment_apply"](spark, SF).select("id", "kind", "source").collect()]
    assert sorted(rows) == sorted([(f"note://{i}", "concept", "test") for i in ids] + [(f"document://{i}", "document", None) for i in ids])


def test_spans(spark):
    spans = spark.createDataFrame([("f", 1, 3), ("f", 4, 6), ("f", 9, 9)], "path string, start int, end int")
    assert sorted(tuple(r) for r in E.merge_intervals(spans, ["path"]).select("start", "end").collect()) == [(1, 6), (9, 9)]
    other = spark.createDataFrame([("f", 5, 9)], "path string, start int, end int")
    assert E.line_overlap(spans, other, ["path"]).first().common == 3


def test_sql_foreign_keys_and_views():
    facts = list(
        X.sql_facts(
            """CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL);
            CREATE TABLE orders (id INT, user_id INT REFERENCES users(id), FOREIGN KEY (id) REFERENCES accounts (key));
            -- FROM comments
            CREATE MATERIALIZED VIEW v AS WITH c AS (SELECT ';' FROM users) SELECT * FROM c JOIN orders ON true, generate_series(1, 2);
            CREATE UNIQUE INDEX i ON users (name); ALTER TABLE ONLY users ADD FOREIGN KEY (name) REFERENCES names(n);"""
        )
    )
    assert [f[:3] for f in facts if f[0] == "column"] == [("column", "users", "id"), ("column", "users", "name"), ("column", "orders", "id"), ("column", "orders", "user_id")]
    assert {f[1:] for f in facts if f[0] == "foreign"} == {("orders", "user_id", "users", "id"), ("orders", "id", "accounts", "key"), ("users", "name", "names", "n")}
    assert {f[3] for f in facts if f[0] in ("from", "join")} == {"users", "orders"} and ("unique index", "i", "", "users", "") in facts


def test_markdown_fences():
    facts = list(X.markdown_facts("# A\n```\n# no\n~~~\n```\n## B [x](y.md)\n"))
    assert facts == [("section 1", "A", 1), ("section 2", "B [x](y.md)", 6), ("link", "y.md", 6)]
    assert list(X.markdown_facts("   ### In #\n#no\n####### seven\n# \n")) == [("section 3", "In", 1)]


def test_outline_of_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["# Title 0\n```\n# no heading [x](y)\n~~~\n```\n[see](doc.md)\n", "no marks", None, "", "words\n" * 5000 + "## End\n[a](b) [c](d)\n### More"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.sections, r.links) for r in entry.queries()["markdown_outline"](spark, str(tmp_path)).collect()}
    assert found == {0: (1, 1), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (2, 2)}


def test_ignore_rules(spark):
    names = ("a.log", "d/a.log", "keep.log", "build/x.go", "src/build/y.go", "docs/a/b.txt", "docs/b.txt", "foo/bar", "foo/x/bar", "d/deep.txt", "d/keep.txt", "#h", "tmp/z.go", "sub/tmp")
    entries = spark.createDataFrame([(p, "file") for p in names] + [(p, "dir") for p in ("build", "src/build", "tmp")], "path string, kind string")
    lines = ["# c", "*.log", "!keep.log", "/build/", "docs/**/b.txt", "foo/**/bar", r"\#h", "tmp/"]
    files = spark.createDataFrame([(".gitignore", "\r\n".join(lines)), ("d/.gitignore", "*.txt\n!keep.txt"), ("d/big.txt", "*")], "path string, content string")
    found = {r.path for r in N.git_ignored(entries, N.ignore_rules(files)).collect()}
    assert found == {"a.log", "d/a.log", "build", "docs/a/b.txt", "docs/b.txt", "foo/bar", "foo/x/bar", "d/deep.txt", "#h", "tmp"}


def test_scan_and_total(spark, tmp_path):
    texts = {"a.py": "x = 1\n", "run": "#!/usr/bin/env -u HOME -S A=1 python3 -x\n", "deno": "#!/usr/bin/deno\n", "prod.pem": "K=1", "b.bin": "zz", ".hidden.sh": "ls", "node_modules/x.js": "1", "secrets/a.py": "1", "big.py": "x" * 300, ".gitignore": "gone/\n", "gone/a.py": "1", "src/.env.local": "A=1"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    files, ignored = N.scan(spark, f"file://{tmp_path}", most_file=200)
    assert {r.path: r.language for r in files.collect()} == {"a.py": "python", "run": "python", "deno": "javascript", ".hidden.sh": "shell"}
    want = {"prod.pem": "secret-like key material", "b.bin": "unsupported file type", "node_modules/": "default ignored directory", "secrets/": "sensitive credential directory", "big.py": "over max file size", ".gitignore": "unsupported file type", "gone/": "gitignored", "src/.env.local": "secret-like environment file", "link.py": "symbolic link"}
    assert {r.path: r.reason for r in ignored.collect()} == want
    sizes = spark.createDataFrame([("a", 5), ("b", 9), ("c", 4), ("a/z", 1), ("a-b", 1)], "path string, size long")
    assert sorted(r.path for r in N.within_total(sizes, 10).collect()) == ["a", "a-b", "a/z"]
    assert sorted(r.path for r in N.within_total(sizes, 20).collect()) == ["a", "a-b", "a/z", "b", "c"]
    (tmp_path / ".aws").mkdir()
    assert [tuple(r) for r in N.scan(spark, f"file://{tmp_path}/.aws")[1].collect()] == [(".", "inside sensitive credential directory")]


def test_merge_keeps_first_scalars_and_last_meta(spark):
    rows = spark.createDataFrame([("x", "", {"a": "1", "b": ""}, 1), ("x", "k", {"a": ""}, 2), ("x", "l", {"a": "3", "c": ""}, 3), ("", "z", {}, 4)], "id string, kind string, meta map<string,string>, o int")
    (r,) = G.merge_nodes(rows, "o").collect()
    assert (r.id, r.kind, r.meta) == ("x", "k", {"a": "3", "b": ""})


def normal(rows, columns):
    return sorted(str(tuple(r[c] for c in sorted(columns))) for r in rows)


def test_catalog_against_sql(spark):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    found, oracles = entry.queries(), entry.oracle_sql()
    for name in oracles:
        if name.startswith("op") and name[2].isdigit():
            continue  # beside the corpus operators
        df = found[name](spark, SF)
        out = con.sql(oracles[name])
        assert set(df.columns) == set(out.columns), name
        mine = [r.asDict() for r in df.collect()]
        theirs = [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]
        assert normal(mine, df.columns) == normal(theirs, df.columns), name
