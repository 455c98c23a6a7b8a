"""Pages, bundles, lines, projects and kept facts."""

import json

import pytest
from graphspark.operators import graph as G
from graphspark.sources import bundle as B
from graphspark.sources import store as ST
from graphspark.sources.tables import with_ids
from pyspark.sql import functions as F


def small(spark):
    nodes = spark.createDataFrame([("a", "function", "</script><b>", "a.go", "p"), ("b", "file", "b\tx", "b.go", None)], "id string, kind string, name string, path string, package string")
    return G.Graph(nodes, with_ids(spark.createDataFrame([("calls", "a", "b")], "kind string, src string, dst string")))


def test_bundle(spark, tmp_path):
    g, folder = small(spark), f"file://{tmp_path}/share"
    with pytest.raises(FileNotFoundError):
        B.check_bundle(folder)
    B.share(g, folder)
    B.check_bundle(folder)
    text = (tmp_path / "share/graph.html").read_text()
    assert text.count("</script>") == 2 and "<\\/script><b>" in text
    held = json.loads((tmp_path / "share/graph.json").read_text())
    manifest = json.loads((tmp_path / "share/manifest.json").read_text())
    assert [n["id"] for n in held["nodes"]] == ["a", "b"] and (manifest["nodes"], manifest["edges"], manifest["containsRawSource"]) == (2, 1, False)
    with pytest.raises(ValueError, match="more than 1"):
        B.graph_json(g, 1)
    found = spark.createDataFrame([("b", 5), ("a", 9)], "id string, score long")
    assert [r.line for r in B.search_lines(found, g.nodes).orderBy("place").collect()] == ["9\tfunction\ta.go\ta", "5\tfile\tb.go\tb"]
    row = spark.createDataFrame([(7, "t\n", "passing", True, "APPROVED"), (8, "u", "unknown", False, "")], "n int, t string, ci string, d boolean, r string")
    assert [r[0] for r in row.select(B.pull_request_line(F.col("t"), F.col("n"), F.col("ci"), F.col("d"), F.col("r"))).collect()] == ["#7 t [ci=passing, draft, review=approved]", "#8 u [ci=unknown]"]


def test_registry(spark, tmp_path):
    path, folder = f"file://{tmp_path}/projects.json", f"file://{tmp_path}/one"
    assert B.registry(path) == {} and not B.unregister(path, "x")
    ST.save(small(spark), folder)
    B.register(spark, path, "one", folder)
    B.register(spark, path, "another", folder)
    assert list(B.registry(path)) == ["another", "one"]
    merged = G.merge_workspaces(B.registered_graphs(spark, path))
    assert merged.nodes.filter("id = 'one::a'").count() == 1
    with pytest.raises(ValueError, match="invalid"):
        B.register(spark, path, " one", folder)
    with pytest.raises(FileNotFoundError):
        B.register(spark, path, "two", f"file://{tmp_path}/nothing")
    assert B.unregister(path, "one") and B.unregister(path, "another")
    with pytest.raises(ValueError, match="no projects"):
        B.registered_graphs(spark, path)
    for text in ('{"version": 2}', '{"version": 1, "projects": [{"alias": "a", "graphDir": "relative"}]}', '{"version": 1, "projects": [{"alias": "a", "graphDir": "/x"}, {"alias": "a", "graphDir": "/x"}]}'):
        (tmp_path / "projects.json").write_text(text)
        with pytest.raises(ValueError):
            B.registry(path)


def test_kept_facts(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/facts", []

    def analyze(new):
        asked.append(sorted(r.path for r in new.select("path").collect()))
        return new.filter("path <> 'none'").select("path", F.length("hash").alias("fact"))

    def facts(*rows, version="1"):
        files = spark.createDataFrame(rows, "path string, hash string")
        return sorted(tuple(r) for r in B.cached_facts(spark, files, folder, "lines", version, "/root", analyze).collect())

    assert facts(("a", "x"), ("b", "yy"), ("none", "z")) == [("a", 1), ("b", 2)]
    assert facts(("a", "x"), ("b", "yyy"), ("none", "z")) == [("a", 1), ("b", 3)]
    assert facts(("a", "x")) == [("a", 1)] and facts(("a", "x"), ("b", "yyy")) == [("a", 1), ("b", 3)]
    assert facts(("a", "x"), version="2") == [("a", 1)]
    assert asked == [["a", "b", "none"], ["b"], [], ["b"], ["a"]]
