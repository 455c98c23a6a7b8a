"""Names resolved to definitions: tables of definitions, references, imports and heritage become graph rows.

The tables come from any parser; no syntax is read here.  Resolution is a cascade of equi-joins on
aggregated name tables: definitions of the same file, of the files it imports, of the language.
The first of them that knows a name decides, and only if it knows it once.

Columns.  definitions: path, language, kind, name, qualified, start, end, line, role, partial.
references: path, language, kind (of edge), name, receiver, start, line, col.  imports: path, language,
name, source, kind, alias, line.  heritage: path, language, name, parent, line, col.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..operators.evaluate import enclosing
from ..operators.graph import first_per_key

# Kinds that hold others, ranks of kinds, languages whose qualified calls are not looked up everywhere.
CONTAINERS = ("class", "interface", "struct")
CALLABLE = ("function", "method")
SCRIPTS = ("javascript", "typescript", "tsx")
# Endings tried behind an import path.
SCRIPT_ENDINGS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx")
SAME_FILE, IMPORTED, ANYWHERE = "same file", "imported file", "language"


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "^[\"'`]+|[\"'`]+$", "")


def name_key(name: Column) -> Column:
    """The last part of a dotted or pathed name."""
    clean = clean_name(name)
    return F.coalesce(F.nullif(F.regexp_extract(clean, r"[.:#/]([^.:#/]+)$", 1), F.lit("")), clean)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def definitions(rows: DataFrame) -> DataFrame:
    """Definitions once each, qualified by the narrowest type around them, with ids that do not depend on lines.

    Of several at one place with one name, whole ones go before partial ones, those with a role
    before others, then types, then callables, then the longer.  A function inside a type is a
    method.  Overloads of one name are numbered in source order.
    """
    rank = F.when(F.col("kind").isin(*CONTAINERS), 3).when(F.col("kind").isin(*CALLABLE), 2).otherwise(1)
    keyed = rows.filter("name <> ''").withColumn("key", name_key(F.col("name")))
    once = first_per_key(keyed, ["path", "start", "key"], [F.col("partial").cast("int"), F.desc((F.coalesce("role", F.lit("")) != "").cast("int")), F.desc(rank), F.desc("end"), F.col("name")])
    own = once.withColumn("_d", F.struct("start", "name", "kind", "end"))
    around = once.filter(F.col("kind").isin(*CONTAINERS)).select("path", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("name").alias("_n"), F.struct("start", "name", "kind", "end").alias("_c"))
    inside = own.select("path", "_d", "start", "end").join(around, "path").filter("_s <= start AND _e >= end").filter(F.col("_c") != F.col("_d"))
    narrowest = inside.groupBy("path", "_d").agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("width"), F.col("_s"), F.col("_n").alias("holder"))).alias("m")).select("path", "_d", F.col("m.holder").alias("holder"))
    joined = own.join(narrowest, ["path", "_d"], "left")
    given = F.regexp_replace(F.replace(F.regexp_replace(clean_name(F.coalesce("qualified", F.lit(""))), r"\s+", ""), F.lit("::"), F.lit(".")), r"^\.+|\.+$", "")
    full = F.when(given == "", F.col("name")).otherwise(given)
    joined = joined.withColumn("qualified", F.when(F.col("holder").isNotNull() & (full == F.col("name")), F.concat("holder", F.lit("."), "name")).otherwise(full))
    joined = joined.withColumn("kind", F.when(F.col("holder").isNotNull() & (F.col("kind") == "function"), "method").otherwise(F.col("kind")))
    same = Window.partitionBy("path", "kind", "qualified")
    joined = joined.withColumn("_of", F.count(F.lit(1)).over(same)).withColumn("_n", F.row_number().over(same.orderBy("start", "name")))
    overload = F.when(F.col("_of") > 1, F.concat(F.lit("overload-"), F.col("_n").cast("string"))).otherwise("")
    return joined.withColumn("id", content_id("tree-symbol", F.col("language"), F.col("path"), F.col("kind"), F.col("qualified"), overload)).drop("_d", "_of", "_n", "holder")


def import_paths(path: Column, language: Column, name: Column) -> Column:
    """The files that an import may mean, by the rules of its language."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    below = lambda p: F.when(folder == "", p).otherwise(F.concat(folder, F.lit("/"), p))
    many = lambda bases, ends: F.array(*[F.concat(b, F.lit(e)) for b in bases for e in ends])
    script = below(name)
    bare = ~F.regexp_like(F.regexp_replace(script, "^.*/", ""), F.lit(r"\.[^./]+$"))
    module = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    crate = F.replace(F.regexp_replace(F.regexp_replace(name, "^crate::", ""), "^self::", ""), F.lit("::"), F.lit("/"))
    none = F.array().cast("array<string>")
    found = (
        F.when(language.isin(*SCRIPTS), F.when(~name.startswith("."), none).when(bare, F.concat(F.array(script), many([script], SCRIPT_ENDINGS))).otherwise(F.array(script)))
        .when(language == "python", F.when(module == "", none).otherwise(many([below(module), module], (".py", "/__init__.py"))))
        .when(language == "rust", many([below(crate), crate, F.concat(F.lit("src/"), crate)], (".rs", "/mod.rs")))
        .when(language.isin("c", "cpp"), F.array(below(name), name))
        .otherwise(none)
    )
    return F.array_distinct(F.transform(found, normal_path))


def normal_path(path: Column) -> Column:
    """A relative path without ``.``, ``..`` and doubled slashes, as far as folders are there to leave."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return F.when(part.isin("", "."), kept).when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    return F.when(F.size(parts) > 0, F.array_join(F.aggregate(F.transform(parts, lambda p: F.when(p == "", ".").otherwise(p)), empty, lambda k, p: F.when(F.size(k) == 0, F.when(p == ".", k).otherwise(F.array(p))).otherwise(step(k, p))), "/"))


def imports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the one known file (files: path) that they mean, null where there is none or several."""
    name = F.coalesce(F.nullif(clean_name(F.coalesce("name", F.lit(""))), F.lit("")), clean_name(F.coalesce("source", F.lit(""))))
    own = rows.filter(F.coalesce("kind", F.lit("")) != "package").withColumn("name", name).filter("name <> ''")
    asked = own.select("path", "language", "name").distinct()
    each = asked.withColumn("target", F.explode(import_paths(F.col("path"), F.col("language"), F.col("name"))))
    known = each.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    only = known.groupBy("path", "language", "name").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return own.join(only, ["path", "language", "name"], "left")


@dataclass(frozen=True)
class Names:
    """How often each scope knows a name, and the id where it does once."""

    same: DataFrame  # path, key
    imported: DataFrame  # path, key
    anywhere: DataFrame  # language, key


def names(defs: DataFrame, known_imports: DataFrame) -> Names:
    def counted(df: DataFrame, scope: str, label: str) -> DataFrame:
        return df.groupBy(scope, "key").agg(F.count(F.lit(1)).alias(f"{label}_n"), F.min("id").alias(f"{label}_id"))

    own = defs.select("path", "language", "key", "id")
    opened = known_imports.filter("target IS NOT NULL").select("path", "target").distinct()
    through = opened.join(own.select(F.col("path").alias("target"), "key", "id"), "target").select("path", "key", "id")
    return Names(counted(own, "path", "same"), counted(through, "path", "imported"), counted(own, "language", "anywhere"))


def looked_up(rows: DataFrame, known: Names, everywhere: Column) -> DataFrame:
    """Adds ``to`` (null where not one) and ``scope`` to rows (path, language, key)."""
    joined = rows.join(known.same, ["path", "key"], "left").join(known.imported, ["path", "key"], "left").join(known.anywhere, ["language", "key"], "left")
    scope = F.when(F.col("same_n") > 0, SAME_FILE).when(F.col("imported_n") > 0, IMPORTED).when(everywhere & (F.col("anywhere_n") > 0), ANYWHERE)
    to = F.when(F.col("same_n") > 0, F.when(F.col("same_n") == 1, F.col("same_id"))).when(F.col("imported_n") > 0, F.when(F.col("imported_n") == 1, F.col("imported_id")))
    to = to.when(everywhere & (F.col("anywhere_n") == 1), F.col("anywhere_id"))
    return joined.withColumn("scope", scope).withColumn("to", to).drop("same_n", "same_id", "imported_n", "imported_id", "anywhere_n", "anywhere_id")


def resolve_references(refs: DataFrame, defs: DataFrame, known: Names) -> DataFrame:
    """(kind, src, dst, resolved, scope, name, path, line): an edge a reference, from the narrowest definition around it or its file.

    A call through a receiver in a script language is not looked up beyond imported files.
    """
    own = refs.filter("name <> ''").withColumn("key", name_key(F.col("name")))
    everywhere = ~((F.col("kind") == "calls") & (F.coalesce("receiver", F.lit("")) != "") & F.col("language").isin(*SCRIPTS))
    found = looked_up(own, known, everywhere)
    spans = defs.select("path", "start", "end", F.col("id").alias("name"))
    around = enclosing(own.select("path", F.col("start").alias("offset")).distinct(), spans, "path").select("path", F.col("offset").alias("start"), F.col("name").alias("caller"))
    found = found.join(around, ["path", "start"], "left")
    text = lambda c: F.col(c).cast("string")
    lost = F.when(F.col("kind") == "calls", content_id("tree-unresolved-call", F.col("language"), F.col("path"), text("line"), text("col"), F.col("name"))).otherwise(content_id("tree-unresolved-reference", F.col("language"), F.col("path"), text("line"), text("col"), F.col("name")))
    return found.select("kind", F.coalesce("caller", file_id(F.col("path"))).alias("src"), F.coalesce("to", lost).alias("dst"), F.col("to").isNotNull().alias("resolved"), F.when(F.col("to").isNotNull(), F.col("scope")).alias("scope"), "name", "path", "line")


def resolve_heritage(rows: DataFrame, defs: DataFrame, known: Names) -> DataFrame:
    """(kind, src, dst, resolved, scope, name, path, line): an edge from a type that its file defines once to its parent."""
    child = known.same.filter("same_n = 1").select("path", F.col("key").alias("child_key"), F.col("same_id").alias("src"))
    own = rows.withColumn("child_key", name_key(F.col("name"))).join(child, ["path", "child_key"]).withColumn("key", name_key(F.col("parent")))
    found = looked_up(own, known, F.lit(True))
    lost = content_id("tree-unresolved-type", F.col("language"), F.col("path"), F.col("line").cast("string"), F.col("col").cast("string"), F.col("parent"))
    return found.select(F.lit("inherits").alias("kind"), "src", F.coalesce("to", lost).alias("dst"), F.col("to").isNotNull().alias("resolved"), F.when(F.col("to").isNotNull(), F.col("scope")).alias("scope"), F.col("parent").alias("name"), "path", "line")


def import_edges(known: DataFrame) -> DataFrame:
    """(kind, src, dst, resolved, scope, name, path, line): files to the files, or else the names, that they import."""
    to = F.coalesce(file_id(F.col("target")), content_id("tree-import", F.col("language"), F.col("name")))
    return known.select(F.lit("imports").alias("kind"), file_id(F.col("path")).alias("src"), to.alias("dst"), F.col("target").isNotNull().alias("resolved"), F.lit(None).cast("string").alias("scope"), "name", "path", "line")


def graph_of(defs: DataFrame, refs: DataFrame, import_rows: DataFrame, heritage: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed files: definitions and what could not be resolved; all edges, with the files' own ``defines``."""
    own = definitions(defs)
    known_imports = imports(import_rows, files)
    known = names(own, known_imports)
    edges = resolve_references(refs, own, known).unionByName(resolve_heritage(heritage, own, known)).unionByName(import_edges(known_imports))
    none = F.lit(None).cast("string")
    holds = own.select(F.lit("defines").alias("kind"), file_id(F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit(True).alias("resolved"), none.alias("scope"), "name", "path", "line")
    symbols = own.select("id", "kind", "name", "path", "line")
    what = F.when(F.col("kind") == "calls", "function").when(F.col("kind") == "imports", "import").otherwise("type")
    lost = edges.filter("NOT resolved").select(F.col("dst").alias("id"), what.alias("kind"), "name", F.when(F.col("kind") != "imports", F.col("path")).alias("path"), F.when(F.col("kind") != "imports", F.col("line")).alias("line"))
    return symbols.unionByName(lost).dropDuplicates(["id"]), edges.unionByName(holds)
