"""Facts from source texts: Markdown outlines and links, SQL definitions and lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..operators.graph import first_per_key

LINK = re.compile(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)[^)]*\)")
#: A single sign at the end is dropped.
HEADING = re.compile(r"(#{1,6}) (.*?)\s*#?\s*$")
FENCE = re.compile(r"\s*(`{3}|~{3})")


def markdown_facts(text: str) -> Iterator[tuple[str, str, int]]:
    """(fact, value, line): sections with their level and links; fenced lines are passed over until the same mark closes them."""
    open_mark = ""
    for number, line in enumerate(text.split("\n"), 1):
        m = FENCE.match(line)
        if m:
            mark = m[1][0]
            if not open_mark:
                open_mark = mark
            elif open_mark == mark:
                open_mark = ""
            continue
        if open_mark:
            continue
        if (h := HEADING.match(line.strip())) and h[2]:
            yield f"section {len(h[1])}", h[2], number
        for m in LINK.finditer(line):
            yield "link", m[1], number


WORD = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*)'
NAME = rf"{WORD}(?:\s*\.\s*{WORD})*"
CREATE_TABLE = re.compile(rf"\s*create\s+(?:global\s+|local\s+|temp(?:orary)?\s+|unlogged\s+|external\s+)*table\s+(?:if\s+not\s+exists\s+)?({NAME})", re.I)
CREATE_VIEW = re.compile(rf"\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?({NAME})", re.I)
CREATE_INDEX = re.compile(rf"\s*create\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({NAME})\s+on\s+({NAME})", re.I)
ALTER = re.compile(rf"\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({NAME})", re.I)
FOREIGN = re.compile(rf"foreign\s+key\s*\(([^)]*)\)\s*references\s+({NAME})\s*(?:\(([^)]*)\))?", re.I)
INLINE = re.compile(rf"\breferences\s+({NAME})\s*(?:\(([^)]*)\))?", re.I)
READS = re.compile(rf"\b(from|join)\s+(?:only\s+|lateral\s+)?({NAME})(\s*\()?", re.I)
CTE = re.compile(rf"(?:\bwith\s+(?:recursive\s+)?|,\s*)({WORD})\s*(?:\([^)]*\)\s*)?as\s+(?:not\s+materialized\s+|materialized\s+)?\(", re.I)
NOT_COLUMNS = ("constraint", "primary", "foreign", "unique", "check", "exclude", "key", "index", "like")
TYPE_END = re.compile(r"\b(?:not|null|default|primary|unique|references|check|constraint|collate|generated|auto_increment|on)\b", re.I)


def plain_sql(text: str) -> str:
    """The text with comments and string literals blanked, lengths kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"--[^\n]*|/\*.*?\*/|(\$\w*\$).*?\1|'(?:[^']|'')*'", blank, text, flags=re.S)


def canonical(name: str) -> str:
    """A name with its quotes off; unquoted parts in lower case."""
    parts = re.findall(WORD, name)
    return ".".join(p[1:-1] if p[0] in '"`[' else p.lower() for p in parts)


def outer(text: str, start: int) -> str:
    """What stands inside the bracket that opens at or behind ``start``."""
    a = text.find("(", start)
    depth = 0
    for i in range(a, len(text)) if a >= 0 else ():
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return text[a + 1 : i]
    return ""


def pieces(text: str, mark: str) -> list[str]:
    """``text`` cut at marks outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == mark and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def sql_facts(text: str) -> Iterator[tuple[str, str, str, str, str]]:
    """(fact, object, column, target, target column): tables, columns, views, indexes, foreign keys, reads."""
    for statement in pieces(plain_sql(text), ";"):
        if m := CREATE_TABLE.match(statement):
            table = canonical(m[1])
            yield "table", table, "", "", ""
            for item in pieces(outer(statement, m.end()), ","):
                words = item.split()
                if not words:
                    continue
                if words[0].lower() in NOT_COLUMNS:
                    yield from foreign(table, item)
                    continue
                own = re.match(rf"\s*({WORD})\s*(.*)", item, re.S)
                if own:
                    column = canonical(own[1])
                    yield "column", table, column, " ".join(TYPE_END.split(own[2])[0].lower().split()), ""
                    if r := INLINE.search(own[2]):
                        yield "foreign", table, column, canonical(r[1]), canonical(r[2] or "")
        elif m := CREATE_VIEW.match(statement):
            view = canonical(m[1])
            yield "view", view, "", "", ""
            body = statement[m.end() :]
            local = {canonical(c[1]) for c in CTE.finditer(body)}
            for r in READS.finditer(body):
                name = canonical(r[2])
                if not r[3] and name not in local:
                    yield r[1].lower(), view, "", name, ""
        elif m := CREATE_INDEX.match(statement):
            yield "unique index" if m[1] else "index", canonical(m[2]), "", canonical(m[3]), ""
        elif m := ALTER.match(statement):
            yield from foreign(canonical(m[1]), statement[m.end() :])


def foreign(table: str, text: str) -> Iterator[tuple[str, str, str, str, str]]:
    for m in FOREIGN.finditer(text):
        ours = [canonical(c) for c in m[1].split(",")]
        theirs = [canonical(c) for c in (m[3] or "").split(",")]
        for i, c in enumerate(ours):
            yield "foreign", table, c, canonical(m[2]), theirs[i] if i < len(theirs) else ""


def markdown(files: DataFrame) -> DataFrame:
    """(path, fact, value, line) of files (path, text)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *f) for p, t in zip(pdf["path"], pdf["text"], strict=True) for f in markdown_facts(t or "")]
            yield pd.DataFrame(rows, columns=["path", "fact", "value", "line"]).astype({"line": "int32"})

    return files.select("path", "text").mapInPandas(kernel, "path string, fact string, value string, line int")


def markdown_graph(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from facts and files (path): documents that files define, their sections, and the documents they cite."""
    document = content_id("document", F.col("path"))
    line = F.col("line").cast("string")
    section, ref = content_id("section", F.col("path"), line), content_id("document-ref", F.col("value"))
    own = files.select("path").distinct().withColumn("line", F.lit(1))
    sections = facts.filter(F.col("fact").startswith("section"))
    links = facts.filter("fact = 'link' AND value <> ''")
    none = F.lit(None).cast("string")
    nodes = own.select(document.alias("id"), F.lit("document").alias("kind"), F.col("path").alias("name"), "path", "line")
    nodes = nodes.unionByName(sections.select(section.alias("id"), F.lit("section").alias("kind"), F.col("value").alias("name"), "path", "line"))
    nodes = nodes.unionByName(links.select(ref.alias("id"), F.lit("document").alias("kind"), F.col("value").alias("name"), none.alias("path"), F.lit(None).cast("int").alias("line")).distinct())
    edges = own.select(F.lit("defines").alias("kind"), F.concat(F.lit("file://"), "path").alias("src"), document.alias("dst"), "path", "line")
    edges = edges.unionByName(sections.select(F.lit("contains").alias("kind"), document.alias("src"), section.alias("dst"), "path", "line"))
    cited = links.select(F.lit("cites").alias("kind"), document.alias("src"), ref.alias("dst"), "path", "line")
    return nodes, edges.unionByName(cited.groupBy("kind", "src", "dst", "path").agg(F.min("line").alias("line")))


def sql_graph(facts: DataFrame, scope: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of SQL facts: schemas, tables, views, columns and indexes, and what refers to what.

    A schema is the folder of its files, or ``scope`` of the path; names are resolved inside it.  The
    first statement that creates an object gives its place; columns of later ones are added.
    """
    folder = F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    f = facts.withColumn("scope", folder if scope is None else scope)
    order = F.struct("path", "place")
    schema = content_id("schema", F.col("scope"))
    table = lambda c, k: content_id(k, F.col("scope"), F.col(c))
    objects = f.filter(F.col("fact").isin("table", "view")).groupBy("scope", F.col("object").alias("full")).agg(F.min_by(F.struct("fact", "path", "place"), order).alias("o")).select("scope", "full", "o.*")
    objects = objects.withColumn("id", F.when(F.col("fact") == "view", table("full", "view")).otherwise(table("full", "table")))
    base = lambda c: F.element_at(F.split(c, r"\."), -1)
    by_base = objects.groupBy("scope", base(F.col("full")).alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("only"), F.min("id").alias("only_id")).filter("n = 1").drop("n")

    def found(rows: DataFrame, column: str, name: str) -> DataFrame:
        """Adds the id of the object that ``column`` names, by its full name or else its only like-named one."""
        exact = objects.select("scope", F.col("full").alias(column), F.col("id").alias("_exact"))
        near = rows.join(exact, ["scope", column], "left").withColumn("base", base(F.col(column))).join(by_base, ["scope", "base"], "left")
        one = F.when(~(F.col(column).contains(".") & F.col("only").contains(".")), F.col("only_id"))
        return near.withColumn(name, F.coalesce("_exact", one)).drop("_exact", "only", "only_id", "base")

    column_id = lambda owner, c: content_id("column", F.col(owner), F.col(c))
    columns = f.filter("fact = 'column'").groupBy("scope", "object", "col").agg(F.min_by(F.struct("path", "place"), order).alias("o")).select("scope", F.col("object").alias("full"), "col", "o.*")
    columns = columns.join(objects.select("scope", "full", F.col("id").alias("owner")), ["scope", "full"])
    indexes = found(f.filter(F.col("fact").isin("index", "unique index")), "target", "owner").withColumn("id", content_id("index", F.col("scope"), F.col("object"), F.col("target")))
    files = f.select("scope", "path").distinct()
    node = lambda df, i, kind, name, path: df.select(i.alias("id"), kind.alias("kind"), name.alias("name"), path.alias("path"))
    nodes = node(files.select("scope").distinct(), schema, F.lit("schema"), F.col("scope"), F.col("scope"))
    nodes = nodes.unionByName(node(objects, F.col("id"), F.col("fact"), F.col("full"), F.col("path"))).unionByName(node(columns, column_id("owner", "col"), F.lit("column"), F.col("col"), F.col("path")))
    nodes = nodes.unionByName(node(indexes.dropDuplicates(["id"]), F.col("id"), F.lit("index"), F.col("object"), F.col("path")))
    edge = lambda df, kind, src, dst, how="": df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(how).alias("how") if isinstance(how, str) else how.alias("how"))
    edges = edge(files, "defines", F.concat(F.lit("file://"), "path"), schema).unionByName(edge(objects, "contains", schema, F.col("id"))).unionByName(edge(columns, "contains", F.col("owner"), column_id("owner", "col")))
    edges = edges.unionByName(edge(indexes, "contains", F.coalesce("owner", schema), F.col("id")).distinct())
    foreign_keys = found(found(f.filter("fact = 'foreign'"), "object", "ours"), "target", "theirs").filter("ours IS NOT NULL AND theirs IS NOT NULL")
    edges = edges.unionByName(edge(foreign_keys, "references", F.col("ours"), F.col("theirs"), "foreign_key").distinct())
    named = columns.select("owner", "col")
    both = foreign_keys.join(named.withColumnRenamed("owner", "ours"), ["ours", "col"], "left_semi").join(named.select(F.col("owner").alias("theirs"), F.col("col").alias("target_col")), ["theirs", "target_col"], "left_semi")
    edges = edges.unionByName(edge(both, "references", column_id("ours", "col"), column_id("theirs", "target_col"), "foreign_key").distinct())
    reads = found(found(f.filter(F.col("fact").isin("from", "join")), "object", "ours"), "target", "theirs").filter("ours IS NOT NULL AND theirs IS NOT NULL")
    return nodes, edges.unionByName(edge(reads, "references", F.col("ours"), F.col("theirs"), F.col("fact")).distinct())


def sql(files: DataFrame) -> DataFrame:
    """(path, place, fact, object, col, target, target_col) of files (path, text)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *f) for p, t in zip(pdf["path"], pdf["text"], strict=True) for i, f in enumerate(sql_facts(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "place", "fact", "object", "col", "target", "target_col"]).astype({"place": "int32"})

    return files.select("path", "text").mapInPandas(kernel, "path string, place int, fact string, object string, col string, target string, target_col string")


def resolve(facts: DataFrame) -> DataFrame:
    """(object, fact, col, target, target_col, resolved): references to the object meant.

    By the full name first, then by the last part where only one object ends in it and at most
    one of the two names is qualified; otherwise not resolved.  Two equi-joins on name tables.
    """
    objects = first_per_key(facts.filter(F.col("fact").isin("table", "view")), ["object"], [F.col("path"), F.col("place")]).select(F.col("object").alias("full"))
    base = lambda c: F.element_at(F.split(c, r"\."), -1)
    refs = facts.filter(F.col("fact").isin("foreign", "from", "join")).select("object", "fact", "col", "target", "target_col")
    exact = refs.join(objects.withColumn("hit", F.col("full")), F.col("target") == F.col("full"), "left").drop("full")
    by_base = objects.groupBy(base(F.col("full")).alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("only")).filter("n = 1")
    near = exact.withColumn("base", base(F.col("target"))).join(by_base, "base", "left")
    plain = ~(F.col("target").contains(".") & F.col("only").contains("."))
    return near.select("object", "fact", "col", F.coalesce("hit", F.when(plain, F.col("only")), "target").alias("target"), "target_col", (F.col("hit").isNotNull() | (plain & F.col("only").isNotNull())).alias("resolved"))
