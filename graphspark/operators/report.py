"""A report of a graph as Markdown, from frames of a few rows each."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import analytics as A
from .graph import Graph, metrics


def markdown(g: Graph, title: str = "Graph report") -> str:
    """Sections: counts, entry points, packages, fan, imports, reading order, call flows."""
    out = [f"# {title}", ""]

    def section(name: str, lines: list[str]) -> None:
        out.extend([f"## {name}", *(lines or ["- None found"]), ""])

    for name, df in metrics(g).items():
        key = df.columns[0]
        section(name.replace("_", " ").capitalize(), [f"- `{r[key]}`: {r.n}" for r in df.orderBy(F.desc("n"), key).limit(50).collect()])
    section("Entry points", [f"- `{r.id}`" for r in A.entry_points(g).orderBy("id").limit(20).collect()])
    section("Core packages", [f"- `{r.path or r.id}` ({r.degree} edges)" for r in A.core_packages(g).orderBy("place").limit(20).collect()])
    section("High fan-in", [f"- `{r.id}` ({r.degree} edges)" for r in A.high_fan(g, True).collect()])
    section("High fan-out", [f"- `{r.id}` ({r.degree} edges)" for r in A.high_fan(g, False).collect()])
    section("Top imports", [f"- `{r.name}` ({r.n} files)" for r in A.top_imports(g).collect()])
    section("Suggested reading order", [f"{i}. `{r.id}`" for i, r in enumerate(A.reading_order(g).collect(), 1)])
    section("Key call flows", [f"- {r.flow}" for r in A.call_flows(g).collect()])
    return "\n".join(out)
