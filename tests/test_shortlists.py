"""Orders of candidates against plain loops, and descriptions of communities."""

import random

import pytest
from graphspark.functions import text as T
from graphspark.operators import describe as D
from graphspark.operators import shortlist as H
from pyspark.sql import functions as F


def by_loop(rows, prefix, reserve, slot):
    """Places by the rule, one candidate after another; rows: (lexical, rescued)."""
    n = len(rows)
    if n <= prefix:
        return list(range(n))
    order = list(range(prefix))
    behind = range(prefix, n)
    early = min(max(0, reserve - min(reserve, sum(rows[i][1] for i in behind))), max(0, slot - 1))
    for chosen, most in (
        ([i for i in behind if not rows[i][0] and not rows[i][1]], lambda left: min(early, left)),
        ([i for i in behind if rows[i][1]], lambda left: left),
    ):
        took = chosen[: most(reserve)]
        order += took
        reserve -= len(took)
    order += [i for i in behind if i not in order and not rows[i][0]][:reserve]
    return order + [i for i in range(n) if i not in order]


def test_graph_slots(spark):
    r = random.Random(2)
    groups = [[(r.random() < 0.6, r.random() < 0.2) for _ in range(r.randint(1, 14))] for _ in range(60)]
    rows = spark.createDataFrame([(g, i, lexical, rescued) for g, x in enumerate(groups) for i, (lexical, rescued) in enumerate(x)], "g int, place int, lexical boolean, rescued boolean").withColumn("was", F.col("place"))
    for prefix, reserve, slot in ((4, 3, 1), (4, 3, 3), (2, 5, 2), (16, 8, 1)):
        found = {}
        for row in H.graph_slots(rows, ["g"], prefix, reserve, slot).orderBy("g", "place").collect():
            found.setdefault(row.g, []).append(row.was)
        assert found == {g: by_loop(x, prefix, reserve, slot) for g, x in enumerate(groups)}


def test_budgets():
    assert [H.adaptive_budget(*x) for x in ((700, 5, 1), (2000, 0, 0), (2000, 1, 1), (2000, 2, 1), (2000, 10, 1), (2000, 99, 1), (900, 99, 1))] == [700, 2000, 1200, 800, 1000, 1400, 900]


def test_promoted_and_diversified(spark):
    walked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, place int")
    ranked = spark.createDataFrame([("c", 1), ("x", 2), ("y", 3)], "id string, rank int")
    assert [r.id for r in H.promoted(walked, ranked, 2).orderBy("place").collect()] == ["c", "x", "a", "b"]
    rows = spark.createDataFrame([("q", i, k, n) for i, (k, n) in enumerate([("file", "a"), ("file", "a"), ("function", "f()"), ("function", "f"), ("function", "F"), ("class", "f")])], "q string, place int, kind string, name string").withColumn("was", F.col("place"))
    assert [r.was for r in H.diversified(rows, ["q"]).orderBy("place").collect()] == [0, 2, 3, 5, 1, 4]


def test_descriptions(spark):
    nodes = spark.createDataFrame([("a", {"community": "c1", "own": "x"}), ("b", {"community": "c2"}), ("c", None)], "id string, meta map<string,string>")
    rows = lambda *x: spark.createDataFrame(x, "community string, description string, rationale string")
    found = {r.id: r.meta for r in D.described(nodes, rows(("c1", " d ", "r")), " s ").collect()}
    assert found == {"a": {"community": "c1", "own": "x", "communityDescription": "d", "communityDescriptionSource": "s", "communityDescriptionConfidence": "inferred", "communityDescriptionRationale": "r"}, "b": {"community": "c2"}, "c": None}
    for given, source, version, problem in (
        (rows(("c9", "d", "r")), "s", 1, "not in the graph"),
        (rows(("c1", "d", " ")), "s", 1, "rationale is required"),
        (rows(("c1", "d", "r"), (" c1", "e", "r")), "s", 1, "repeated community"),
        (rows(("c1", "d" * 2001, "r")), "s", 1, "too long"),
        (rows(("c1", "d", "r")), " ", 1, "source is required"),
        (rows(("c1", "d", "r")), "s", 2, "unsupported version"),
        (rows(("c1", "d", "r")).limit(0), "s", 1, "at least one"),
    ):
        with pytest.raises(ValueError, match=problem):
            D.described(nodes, given, source, version)
    assert {r.id: r.meta for r in D.removed(nodes).collect()} == {"a": {"own": "x"}, "b": None, "c": None}


def test_bounded_texts(spark):
    mark = T.TRUNCATED
    texts = ["short", "x" * 400, "é" * 200, "line one\n" + "y" * 250 + "\n" + "z" * 100, "a\n" + "z" * 400]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.bound_text(F.col("t"), 100)).collect()]
    room = 300 - len(mark)
    assert got == ["short", "x" * room + mark, "é" * (room // 2) + mark, "line one\n" + "y" * 250 + mark if 259 <= room else ("line one\n" + "y" * 300)[:room] + mark, ("a\n" + "z" * 400)[:room] + mark]


def test_paths_that_match(spark):
    rows = [("file://a/b.py", "b.py", True), ("./a/b.py", "a/b.py", True), ("xb.py", "b.py", False), ("", "b.py", False), ("a\\b.py", "/a/b.py", True), ("b.py", "a/b.py", False)]
    df = spark.createDataFrame(rows, "p string, g string, want boolean").withColumn("got", T.paths_match(F.col("p"), F.col("g")))
    assert all(r.got == r.want for r in df.collect())
