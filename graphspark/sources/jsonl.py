"""Strict lines of JSON: evaluation cases, answers and batch requests; and the JSON of fragments and pull requests.

A line with an unknown or repeated field, a value of another type or a missing one is told, not
guessed; so is an id that stands on several lines.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRING, STRINGS, FLAG, WHOLE, NUMBER = "string", "array<string>", "boolean", "long", "double"


@dataclass(frozen=True)
class Lines:
    """What lines of a kind hold: fields with their types, and a check that names what is wrong with a line, or nothing."""

    fields: dict[str, str]
    check: Callable[[dict], str]
    lenient: bool = False  # unknown fields are passed over


def _case(row: dict) -> str:
    if any(not (row.get(k) or "").strip() for k in ("id", "dataset", "question")) or not (row.get("expectedNodeIds") or row.get("expectedEvidence")):
        return "requires id, dataset, question, and expectedNodeIds or expectedEvidence"
    return next((p for k in ("expectedNodeIds", "expectedEvidence", "expectedKeyFacts") if (p := _listed(row, k))), "")


def _answer(row: dict) -> str:
    if not (row.get("id") or "").strip():
        return "requires id"
    if row.get("correct") is None and row.get("keyFactsFound") is None:
        return "requires correct or keyFactsFound"
    if any((row.get(k) or 0) < 0 for k in ("inputTokens", "outputTokens", "toolTokens", "costUsd")):
        return "counts and costs cannot be negative"
    return _listed(row, "keyFactsFound")


def _request(row: dict) -> str:
    return "" if (row.get("id") or "").strip() and (row.get("question") or "").strip() else "request requires non-empty id and question"


def _listed(row: dict, name: str) -> str:
    values = row.get(name) or []
    if any(not v.strip() for v in values):
        return f"{name} cannot contain an empty value"
    return next((f"{name} contains duplicate value {v!r}" for i, v in enumerate(values) if v in values[:i]), "")


CASES = Lines({"id": STRING, "dataset": STRING, "question": STRING, "expectedNodeIds": STRINGS, "expectedEvidence": STRINGS, "expectedKeyFacts": STRINGS}, _case)
ANSWERS = Lines({"id": STRING, "correct": FLAG, "keyFactsFound": STRINGS, "inputTokens": WHOLE, "outputTokens": WHOLE, "toolTokens": WHOLE, "costUsd": NUMBER, "model": STRING, "judge": STRING, "runId": STRING}, _answer)
REQUESTS = Lines({"id": STRING, "question": STRING, "traceNodeIds": STRINGS}, _request, lenient=True)


def _fits(value: object, kind: str) -> bool:
    whole = isinstance(value, int) and not isinstance(value, bool)
    if value is None:
        return True
    if kind == STRINGS:
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    return {STRING: isinstance(value, str), FLAG: isinstance(value, bool), WHOLE: whole, NUMBER: whole or isinstance(value, float)}[kind]


def parsed(text: str, lines: Lines) -> tuple[dict, str]:
    """The fields of a line, and what is wrong with it."""
    twice: list[str] = []

    def once(pairs: list[tuple[str, object]]) -> dict:
        names = [k for k, _ in pairs]
        twice.extend(n for i, n in enumerate(names) if n in names[:i])
        return dict(pairs)

    def no_number(name: str) -> None:
        raise ValueError(name)

    try:
        row = json.loads(text, object_pairs_hook=once, parse_constant=no_number)
    except ValueError:
        return {}, "invalid JSON"
    if not isinstance(row, dict):
        return {}, "not an object"
    if twice and not lines.lenient:
        return {}, f"duplicate field {twice[0]!r}"
    if not lines.lenient and (unknown := [k for k in row if k not in lines.fields]):
        return {}, f"unknown field {unknown[0]!r}"
    row = {k: v for k, v in row.items() if k in lines.fields}
    if wrong := [k for k, v in row.items() if not _fits(v, lines.fields[k])]:
        return {}, f"{wrong[0]} is not of type {lines.fields[wrong[0]]}"
    return row, lines.check(row)


def read(raw: DataFrame, lines: Lines) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a table of lines (line, value): the fields and the line; and line, id, problem."""
    names = list(lines.fields)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for line, value in zip(frame["line"], frame["value"], strict=True):
                if (value or "").strip():
                    row, problem = parsed(value, lines)
                    out.append([line, problem, *(row.get(n) for n in names)])
            made = pd.DataFrame(out, columns=["line", "problem", *names], dtype=object)
            yield made

    schema = "line long, problem string, " + ", ".join(f"{n} {k}" for n, k in lines.fields.items())
    both = raw.select(F.col("line").cast("long").alias("line"), "value").mapInPandas(kernel, schema)
    first = both.filter("problem = ''").groupBy("id").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    told = both.join(first, "id", "left").withColumn("problem", F.when(F.col("line") > F.col("_first"), F.concat(F.lit("duplicate id "), "id")).otherwise(F.col("problem")))
    return told.filter("problem = ''").select("line", *names), told.filter("problem <> ''").select("line", "id", "problem")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a file of lines, numbered from 1; the file is read as one text, so it is one of a dataset's size."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return whole.select((F.col("line") + 1).alias("line"), "value")


def load(spark: SparkSession, path: str, lines: Lines) -> DataFrame:
    """The rows of a file; a ValueError tells the first line that is wrong, or that there is none."""
    rows, problems = read(numbered(spark, path), lines)
    wrong = problems.orderBy("line").first()
    if wrong is not None:
        raise ValueError(f"line {wrong.line}: {wrong.problem}")
    if not rows.take(1):
        raise ValueError("no lines")
    return rows


NODE = "struct<id: string, kind: string, name: string, path: string, package: string, meta: map<string, string>>"
EDGE = "struct<id: string, kind: string, from: string, to: string, meta: map<string, string>>"
FRAGMENT = f"version int, source string, sourcePaths array<string>, nodes array<{NODE}>, edges array<{EDGE}>"
CHECK = "struct<name: string, context: string, state: string, status: string, conclusion: string>"
REVIEW = f"number int, title string, url string, headRefName string, baseRefName string, isDraft boolean, reviewDecision string, files array<struct<path: string, additions: int, deletions: int>>, statusCheckRollup array<{CHECK}>"


def fragment(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """(source, paths, nodes, edges) of a fragment's JSON; a ValueError where its head is wrong or a row lacks what it needs."""
    whole = spark.read.json(path, schema=FRAGMENT, multiLine=True)
    head = whole.select("version", F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.coalesce(F.size("sourcePaths"), F.lit(0)).alias("paths"), F.exists(F.coalesce("sourcePaths", F.array().cast("array<string>")), lambda p: F.trim(p) == "").alias("blank"), (F.coalesce(F.size("nodes"), F.lit(0)) + F.coalesce(F.size("edges"), F.lit(0))).alias("rows")).first()
    if head is None or head.version != 1:
        raise ValueError(f"unsupported fragment version {head.version if head else None}")
    if not head.source:
        raise ValueError("fragment source is required")
    if head.blank or (head.rows > 0 and head.paths < 1):
        raise ValueError("fragment sourcePaths are required, none of them empty")
    nodes = whole.select(F.explode("nodes").alias("n")).select("n.*")
    edges = whole.select(F.explode("edges").alias("e")).select("e.id", "e.kind", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.meta")
    lacks = lambda df, *columns: df.filter(" OR ".join(f"coalesce({c}, '') = ''" for c in columns)).take(1)
    if lacks(nodes, "id", "kind", "name") or lacks(edges, "kind", "src", "dst"):
        raise ValueError("a node requires id, kind and name, an edge kind, from and to")
    return head.source, whole.select(F.explode("sourcePaths").alias("path")), nodes, edges


def pull_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(requests, files) of a list of pull requests: number, title, draft, review, checks; and number, path."""
    whole = spark.read.json(path, schema=REVIEW, multiLine=True)
    requests = whole.select("number", F.trim("title").alias("title"), F.coalesce("isDraft", F.lit(False)).alias("draft"), F.lower(F.coalesce("reviewDecision", F.lit(""))).alias("review"), F.col("statusCheckRollup").alias("checks"))
    return requests, whole.select("number", F.explode("files").alias("f")).select("number", "f.path")
