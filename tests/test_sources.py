"""Strict sources, answers and batches."""

import json

import pytest
from graphspark.operators import batch
from graphspark.operators import evaluate as E
from graphspark.operators import graph as G
from graphspark.operators import ingest as I
from graphspark.operators.question import Options
from graphspark.sources import jsonl as J
from graphspark.sources.tables import with_ids

GOOD = {"id": "a", "dataset": "d", "question": "q", "expectedNodeIds": ["n"]}


def written(tmp_path, text):
    (tmp_path / "lines.jsonl").write_text(text)
    return f"file://{tmp_path}/lines.jsonl"


@pytest.mark.parametrize(
    ("line", "problem"),
    [
        ("{", "invalid JSON"),
        ("[1]", "not an object"),
        (json.dumps(GOOD | {"extra": 1}), "unknown field 'extra'"),
        ('{"id": "a", "id": "b"}', "duplicate field 'id'"),
        (json.dumps(GOOD | {"question": 3}), "question is not of type string"),
        (json.dumps(GOOD | {"question": " "}), "requires id"),
        (json.dumps(GOOD | {"expectedKeyFacts": ["f", " "]}), "expectedKeyFacts cannot contain an empty value"),
        (json.dumps(GOOD | {"expectedNodeIds": ["f", "f"]}), "expectedNodeIds contains duplicate value 'f'"),
        (json.dumps(GOOD), "duplicate id a"),
    ],
)
def test_cases(spark, tmp_path, line, problem):
    with pytest.raises(ValueError, match=f"line 3: {problem}"):
        J.load(spark, written(tmp_path, json.dumps(GOOD) + "\n\n" + line + "\n"), J.CASES)


def test_cases_and_answers_that_are_right(spark, tmp_path):
    rows = J.load(spark, written(tmp_path, json.dumps(GOOD) + "\n  \n" + json.dumps(GOOD | {"id": "b", "expectedNodeIds": [], "expectedEvidence": ["e"]})), J.CASES)
    assert [(r.line, r.id) for r in rows.orderBy("line").collect()] == [(1, "a"), (3, "b")]
    with pytest.raises(ValueError, match="no lines"):
        J.load(spark, written(tmp_path, "\n"), J.CASES)
    answers = J.load(spark, written(tmp_path, '{"id": "a", "correct": true, "costUsd": 1}\n{"id": "b", "keyFactsFound": []}'), J.ANSWERS)
    assert [(r.correct, r.costUsd) for r in answers.orderBy("line").collect()] == [(True, 1.0), (None, None)]
    for bad in ('{"id": "a"}', '{"id": "a", "correct": true, "inputTokens": -1}', '{"id": "a", "correct": true, "costUsd": NaN}', '{"id": "a", "correct": 1}'):
        assert J.parsed(bad, J.ANSWERS)[1]


def test_answers_must_match(spark):
    cases = spark.createDataFrame([("a", "d", ["f", "g"]), ("b", "d", [])], "id string, dataset string, facts array<string>")
    records = lambda *rows: spark.createDataFrame(rows, "id string, correct boolean, found array<string>")
    total = {r.dataset: (r.records, r.accuracy, r.coverage) for r in E.answers(cases, records(("a", True, ["f"]), ("b", False, None))).collect()}
    assert total == {"d": (2, 0.5, 0.5), None: (2, 0.5, 0.5)}
    for rows, problem in (((("x", True, None),), "matches no case"), ((("a", True, None), ("a", True, None)), "repeated record"), ((("a", None, ["h"]),), "unexpected fact"), ((("b", None, []),), "expects no facts")):
        with pytest.raises(ValueError, match=problem):
            E.answers(cases, records(*rows))


def test_fragment(spark, tmp_path):
    meta = {"confidence": "extracted", "evidence": "app.py:1"}
    head = {"version": 1, "source": "s", "sourcePaths": ["app.py"], "nodes": [{"id": "n", "kind": "function", "name": "f", "meta": meta}], "edges": [{"kind": "defines", "from": "file://app.py", "to": "n", "meta": meta}]}
    source, paths, nodes, edges = J.fragment(spark, written(tmp_path, json.dumps(head, indent=1)))
    known = spark.createDataFrame([("file://app.py",)], "id string")
    assert source == "s" and [r.path for r in paths.collect()] == ["app.py"] and I.violations(nodes, edges, known).count() == 0
    for change, problem in (({"version": 2}, "version 2"), ({"source": " "}, "source is required"), ({"sourcePaths": []}, "sourcePaths"), ({"nodes": [{"id": "n", "kind": "k", "meta": meta}]}, "requires id, kind and name")):
        with pytest.raises(ValueError, match=problem):
            J.fragment(spark, written(tmp_path, json.dumps(head | change)))


def test_pull_requests(spark, tmp_path):
    rows = [{"number": 2, "title": " t ", "files": [{"path": "a.go", "additions": 1, "deletions": 0}], "statusCheckRollup": [{"state": "SUCCESS"}], "reviewDecision": "APPROVED"}, {"number": 1, "title": "u", "files": []}]
    requests, files = J.pull_requests(spark, written(tmp_path, json.dumps(rows)))
    assert sorted((r.number, r.title, r.draft, r.review) for r in requests.collect()) == [(1, "u", False, ""), (2, "t", False, "approved")]
    assert [tuple(r) for r in files.collect()] == [(2, "a.go")]


def test_batch(spark):
    nodes = spark.createDataFrame([(x, "function", x, None, None) for x in ("parse", "load")], "id string, kind string, name string, path string, package string")
    g = G.Graph(nodes, with_ids(spark.createDataFrame([("calls", "parse", "load")], "kind string, src string, dst string")))
    raw = spark.createDataFrame([(1, '{"id": "x", "question": "parse", "more": 1}'), (2, "{"), (3, '{"id": "y", "question": ""}'), (4, '{"id": "z", "question": "zebra"}'), (5, "")], "line long, value string")
    said, found = batch.answer(g, *J.read(raw, J.REQUESTS), Options(depth=1), step=lambda df: df.checkpoint())
    assert [(r.line, r.type) for r in said.orderBy("line").collect()] == [(1, "result"), (2, "error"), (3, "error"), (4, "result")]
    assert [(r.request, r.id) for r in found.orderBy("place").collect()] == [("x", "parse"), ("x", "load")]
