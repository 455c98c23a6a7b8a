"""What a question asks for: edge kinds and direction, for whole tables of questions at once."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Words that ask for kinds of edges.
HINTS = (
    ("call calls called calling caller callers callee callees invoke invokes invoked invocation", ("calls",)),
    ("import imports imported module modules dependency dependencies depend depends", ("imports", "depends_on")),
    ("inherit inherits extend extends implement implements", ("inherits", "implements")),
    ("reference references referenced type types parameter parameters argument arguments return returns returned", ("references", "uses_type")),
    ("test tests tested", ("tested_by",)),
    ("define defines defined contain contains member members field fields", ("defines", "contains")),
    ("cite cites citation explain rationale why", ("cites", "explains")),
    ("flow flows impact impacts affect affects affected", ("flows_to", "affects")),
)
# Words of relations with a direction, and phrases that tell it.
DIRECTED = (
    "call calls called caller import imports imported reference references referenced use uses used depend depends "
    "dependency dependencies implement implements inherit inherits affect affects flow flows"
).split()
INCOMING = (
    "who calls", "what calls", "which calls", "called by", "callers of", "who imports", "what imports", "which imports",
    "imported by", "who references", "what references", "which references", "referenced by", "who uses", "what uses",
    "which uses", "used by", "who depends", "what depends", "which depends", "dependents of", "implemented by",
    "inherited by", "affected by",
)
OUTGOING = ("what does", "which does", "how does", "calls from", "imports from", "references from", "depends on", "dependencies of")


def relations(question: Column, present: list[str]) -> Column:
    """Sorted edge kinds that a question's words ask for, among those that the graph has."""
    words = T.tokens(question)
    found = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, hints.split()))), F.array(*[F.lit(k) for k in kinds if k in present]).cast("array<string>")).otherwise(F.array().cast("array<string>")) for hints, kinds in HINTS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def direction(question: Column) -> Column:
    """``in`` or ``out``; empty where no relation is named or both or no phrases are there."""
    words, text = T.tokens(question), T.normalized(question)
    says = lambda phrases: reduce(or_, [T.has_phrase(text, F.lit(p)) for p in phrases])
    into, out = says(INCOMING), says(OUTGOING)
    named = F.arrays_overlap(words, F.array(*map(F.lit, DIRECTED)))
    return F.when(~named | (into == out), "").when(into, "in").otherwise("out")


def understand(questions: DataFrame, edges: DataFrame, column: str = "question") -> DataFrame:
    """Adds ``relations`` and ``direction``; the graph's edge kinds are few and read first."""
    present = [r.kind for r in edges.select("kind").distinct().collect()]
    return questions.withColumn("relations", relations(F.col(column), present)).withColumn("direction", direction(F.col(column)))
