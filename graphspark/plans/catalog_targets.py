"""Queries about targets and the intent of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intent as N
from ..operators import resolve as Z
from ..operators import traverse as V
from ..sources import tables as S
from . import sql
from .catalog import query

QUESTIONS = (
    "who calls Order 5",
    "What does the part depend on?",
    "which suppliers are affected by and what does it affect",
    "modules imported by the region",
    "why is the sky blue",
    "members contained in a nation",
    "callers of part and dependencies of part",
)

VALUES = ", ".join("('" + q.replace("'", "''") + "')" for q in QUESTIONS)
HITS = " || ".join(f"CASE WHEN list_has_any(w, {sql.strings(hints.split())}) THEN list_filter({sql.strings(kinds)}, lambda k: list_contains(e, k)) ELSE [] END" for hints, kinds in N.HINTS)
SAYS = {name: " OR ".join(f"contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ')" for p in phrases) for name, phrases in (("i", N.INCOMING), ("o", N.OUTGOING))}


@query(
    "infer_relations",
    f"WITH {sql.RELATIONAL}, q AS (SELECT question, {sql.tokens('question')} AS w, (SELECT list(DISTINCT kind) FROM edges) AS e FROM (VALUES {VALUES}) t(question)) SELECT question, array_to_string(list_sort(list_distinct({HITS})), ',') AS relations FROM q",
)
def infer_relations(spark, d):
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    return N.understand(asked, S.relational_graph(spark, d).edges).select("question", F.array_join("relations", ",").alias("relations"))


@query(
    "infer_direction",
    f"WITH q AS (SELECT question, {sql.tokens('question')} AS w FROM (VALUES {VALUES}) t(question)), s AS (SELECT question, ({SAYS['i']}) AS i, ({SAYS['o']}) AS o, list_has_any(w, {sql.strings(N.DIRECTED)}) AS n FROM q) SELECT question, CASE WHEN NOT n OR i = o THEN '' WHEN i THEN 'in' ELSE 'out' END AS direction FROM s",
)
def infer_direction(spark, d):
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    return asked.select("question", N.direction(F.col("question")).alias("direction"))


TARGETS = ("customer://3", "world/NATION_4", "NATION_7", "red widget", "nobody")


@query(
    "resolve_target",
    f"""WITH {sql.RELATIONAL}, t AS (SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in TARGETS)}) t(target)),
    h AS (SELECT target, id, 0 AS stage FROM nodes JOIN t ON id = target UNION ALL SELECT target, id, 1 FROM nodes JOIN t ON path = target UNION ALL SELECT target, id, 2 FROM nodes JOIN t ON name = target),
    b AS (SELECT target, min(stage) AS stage FROM h GROUP BY target), x AS (SELECT target, count(DISTINCT id) AS n, min(id) AS id FROM h JOIN b USING (target, stage) GROUP BY target)
    SELECT target, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN id END AS id FROM t LEFT JOIN x USING (target)""",
)
def resolve_target(spark, d):
    return Z.resolve_all(S.relational_graph(spark, d), spark.createDataFrame([(t,) for t in TARGETS], "target string")).select("target", "status", "id")


@query("typed_neighbors", f"WITH {sql.RELATIONAL}, x AS (SELECT DISTINCT 'out' AS direction, kind, dst AS id FROM edges WHERE src = 'nation://1' UNION SELECT 'in', kind, src FROM edges WHERE dst = 'nation://1') SELECT direction, x.kind, n.kind AS node_kind, count(*) AS n FROM x JOIN nodes n USING (id) GROUP BY ALL")
def typed_neighbors(spark, d):
    g = S.relational_graph(spark, d)
    near = V.neighbours(g, "nation://1").join(g.nodes.select("id", F.col("kind").alias("node_kind")), "id")
    return near.groupBy("direction", "kind", "node_kind").agg(F.count(F.lit(1)).alias("n"))
