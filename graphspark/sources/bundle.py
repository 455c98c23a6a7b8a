"""What leaves the engine: pages, bundles, lines of results; and what it keeps: projects, facts of files."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import Graph
from ..operators.report import markdown
from ..schema import SYMBOL_KINDS
from .store import exists, load, save

PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title><h1>Graph</h1><input id="q" placeholder="name"><ul id="out"></ul>
<script id="data" type="application/json">@@DATA@@</script>
<script>const g=JSON.parse(document.getElementById("data").textContent),o=document.getElementById("out");
document.getElementById("q").oninput=e=>{o.textContent="";for(const n of g.nodes.filter(n=>n.name.toLowerCase().includes(e.target.value.toLowerCase())).slice(0,200)){const l=document.createElement("li");l.textContent=n.kind+" "+n.name+" "+(n.path||"");o.append(l)}}</script>
"""
BUNDLE = ("graph.json", "report.md", "graph.html", "manifest.json")
MOST_ROWS = 1 << 20


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def graph_json(g: Graph, most: int = MOST_ROWS) -> str:
    """A graph as one JSON text, for a browser; a ValueError where it has more than ``most`` rows."""
    rows = lambda df: [r[0] for r in df.orderBy("id").limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    nodes, edges = rows(g.nodes), rows(g.edges)
    if max(len(nodes), len(edges)) > most:
        raise ValueError(f"more than {most} nodes or edges: choose a part of the graph")
    return '{"nodes":[' + ",".join(nodes) + '],"edges":[' + ",".join(edges) + "]}"


def page(g: Graph) -> str:
    """A page that holds its data; an end tag inside the data does not end it."""
    return PAGE.replace("@@DATA@@", graph_json(g).replace("</script", r"<\/script"))


def share(g: Graph, folder: str, now: datetime | None = None) -> None:
    """Graph, report, page and manifest in a folder (a URI); no source text is among them."""
    store, name = _open(folder)
    store.create_dir(name)
    whole = json.loads(graph_json(g))
    manifest = {"format": "graph-share", "version": 1, "generatedAt": (now or datetime.now(UTC)).isoformat(), "nodes": len(whole["nodes"]), "edges": len(whole["edges"]), "containsRawSource": False}
    texts = (json.dumps(whole), markdown(g), page(g), json.dumps(manifest, indent=2) + "\n")
    for file, text in zip(BUNDLE, texts, strict=True):
        with store.open_output_stream(f"{name}/{file}") as out:
            out.write(text.encode())


def check_bundle(folder: str) -> None:
    """A FileNotFoundError names the first file that a bundle lacks."""
    for file in BUNDLE:
        if not exists(f"{folder}/{file}"):
            raise FileNotFoundError(f"{folder}/{file}")


def search_lines(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place, line) of search results (id, score): score, kind, label and id, with control characters neutralised."""
    from pyspark.sql import Window

    own = found.join(nodes.select("id", F.col("kind").alias("_k"), F.col("name").alias("_n"), "path"), "id")
    label = T.result_label(F.col("_k"), F.col("_n"), F.col("path"), F.lit(0), SYMBOL_KINDS)
    line = F.concat_ws("\t", F.col("score").cast("string"), F.col("_k"), T.safe_text(label), T.compact_id(F.col("id")))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1  # search results are few
    return own.select(place.alias("place"), line.alias("line"))


def pull_request_line(title: Column, number: Column, ci: Column, draft: Column, review: Column) -> Column:
    """``#7 title [ci=passing, draft, review=approved]``."""
    state = F.concat_ws(", ", F.concat(F.lit("ci="), ci), F.when(draft, "draft"), F.when(F.coalesce(review, F.lit("")) != "", F.concat(F.lit("review="), F.lower(review))))
    return F.concat(F.lit("#"), number.cast("string"), F.lit(" "), T.safe_text(title), F.lit(" ["), state, F.lit("]"))


# --- projects ------------------------------------------------------------------------------


def registry(path: str) -> dict[str, str]:
    """Aliases and graph folders of a registry file, none where there is no file; a ValueError where it is wrong."""
    if not exists(path):
        return {}
    store, name = _open(path)
    with store.open_input_stream(name) as f:
        held = json.loads(f.read())
    if held.get("version") != 1:
        raise ValueError(f"unsupported registry version {held.get('version')}")
    out: dict[str, str] = {}
    for project in held.get("projects", []):
        alias, folder = project.get("alias", ""), project.get("graphDir", "")
        if not _alias(alias) or alias in out:
            raise ValueError(f"{'repeated' if alias in out else 'invalid'} project alias {alias!r}")
        if "://" not in folder and not folder.startswith("/"):
            raise ValueError(f"the folder of {alias!r} is not absolute")
        out[alias] = folder
    return out


def _alias(alias: str) -> bool:
    return bool(alias) and alias == alias.strip() and all(c.isalnum() or c in "-_." for c in alias)


def write_registry(path: str, projects: dict[str, str]) -> None:
    store, name = _open(path)
    rows = [{"alias": a, "graphDir": projects[a]} for a in sorted(projects)]
    with store.open_output_stream(name) as out:
        out.write(json.dumps({"version": 1, "projects": rows}, indent=2).encode())


def register(spark: SparkSession, path: str, alias: str, folder: str) -> dict[str, str]:
    """Adds or replaces a project, if its folder holds a graph."""
    if not _alias(alias):
        raise ValueError(f"invalid project alias {alias!r}")
    load(spark, folder)
    projects = registry(path) | {alias: folder}
    write_registry(path, projects)
    return projects


def unregister(path: str, alias: str) -> bool:
    """Whether the project was there."""
    projects = registry(path)
    there = projects.pop(alias, None) is not None
    if there:
        write_registry(path, projects)
    return there


def registered_graphs(spark: SparkSession, path: str) -> dict[str, Graph]:
    projects = registry(path)
    if not projects:
        raise ValueError("the registry has no projects")
    return {a: load(spark, folder) for a, folder in sorted(projects.items())}


# --- facts of files ------------------------------------------------------------------------


def fact_key(analyzer: str, version: str, root: str) -> Column:
    """What a file's facts depend on: the analyzer, its version, the tree, and the file's path and hash."""
    return F.sha2(F.concat_ws("\0", F.lit(version), F.lit(analyzer), F.lit(root), "path", "hash"), 256)


def cached_facts(spark: SparkSession, files: DataFrame, folder: str, analyzer: str, version: str, root: str, analyze: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of files (path, hash, ..), of which only those without kept facts are analyzed.

    ``analyze`` takes the files that are new and gives facts with their ``path``.  What a key has is kept
    for files without facts too.  The kept facts, less what no file uses, are written beside the old
    ones and then put in their place; they can be made again, so nothing is lost if that is cut off.
    """
    keyed = files.withColumn("key", fact_key(analyzer, version, root))
    fresh = lambda new: new.select("path", "key").join(analyze(new.drop("key")).withColumn("held", F.lit(True)), "path", "left")
    if not exists(f"{folder}/_SUCCESS"):
        fresh(keyed).write.mode("overwrite").parquet(folder)
    else:
        known = spark.read.parquet(folder)
        kept = known.join(keyed.select("key"), "key", "left_semi")
        added = fresh(keyed.join(known.select("key").distinct(), "key", "left_anti"))
        kept.unionByName(added).write.mode("overwrite").parquet(f"{folder}.new")
        store, name = _open(folder if ":" in folder.split("/")[0] else f"file://{folder}")
        store.delete_dir(name)
        store.move(f"{name}.new", name)
    return spark.read.parquet(folder).filter("held").drop("key", "held")
