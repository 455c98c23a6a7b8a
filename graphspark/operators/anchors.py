"""Names and paths that a question spells out: imports of several languages, and identifiers in mixed case."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical as L

# What an exact name and a path add to a score, by the weight of their words.
NAME_BONUS, PATH_BONUS = 100_000.0, 20_000.0
SCRIPT_IMPORT = re.compile(r"""(?m)^\s*import\s+(?:type\s+)?([^'";]+?)\s+from\s+['"]([^'"]+)['"]""")
REQUIRE = re.compile(r"""(?m)^\s*(?:const|let|var)\s+([^=;]+?)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)""")
IDENTIFIER = re.compile(r"[\w$]+")
MIXED = re.compile(r"[_$]|[^\W_A-Z][A-Z]")


@dataclass(frozen=True)
class Anchors:
    """Normalised names, those of them that stand in prose, and paths, sorted."""

    names: tuple[str, ...]
    inline: tuple[str, ...]
    paths: tuple[str, ...]

    def count(self, inline: bool = False) -> int:
        return len(self.names) - (0 if inline else len(self.inline)) + len(self.paths)


def _listed(text: str, between: str = " as ") -> list[str]:
    """Names of a list with new names for some; both names count."""
    return [name for item in text.split(",") for name in item.strip(" \t()\\{}").split(between)]


def _script_names(clause: str) -> list[str]:
    """Names of an import clause: a default, a namespace's new name, and those in braces."""
    out = []
    for part in re.findall(r"\{[^}]*\}|[^,{}]+", clause):
        part = part.strip()
        if part.startswith("{"):
            out += [re.sub(r"^type\s+", "", name.strip()) for name in _listed(part[1:-1])]
        else:
            out += [part.partition(" as ")[2]] if part.startswith("*") else [part]
    return out


def spelled_out(question: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(names, names in prose, paths of two words or more, paths of modules), as they stand."""
    names, inline, paths, modules = [], [], [], []
    for m in SCRIPT_IMPORT.finditer(question):
        names += _script_names(m[1])
        modules.append(m[2])
    for m in REQUIRE.finditer(question):
        inner = m[1].strip()
        names += [n for item in inner.strip("{}").split(",") for n in item.split(":")] if inner.startswith("{") else [inner]
        modules.append(m[2])
    # A list of imported names may go on in brackets or behind a backslash.
    joined = re.sub(r"(?m)^(\s*from\s[^\n]*\simport\s*\()([^)]*)", lambda m: m[1] + m[2].replace("\n", " "), question)
    for raw in re.sub(r"\\\r?\n", " ", joined).split("\n"):
        line = raw.strip()
        if SCRIPT_IMPORT.match(line):
            continue
        if m := re.match(r"from\s+(\S+)\s+import\s+(.*)", line):
            paths.append(m[1])
            names += _listed(m[2])
        elif m := re.match(r"import\s+(static\s+)?(.*)", line):
            for item in m[2].split(",") if not m[1] else [m[2]]:
                dotted, _, alias = item.partition("//")[0].strip().rstrip(";").strip().partition(" as ")
                parts = dotted.strip(" .*").split(".")
                names += [alias, parts[-1]]
                paths.append(".".join(parts[:-1] if m[1] and len(parts) > 1 else parts))
        else:
            inline += [w for w in IDENTIFIER.findall(line) if MIXED.search(w)]
    return names, inline, paths, modules


def anchors(spark: SparkSession, question: str) -> Anchors:
    """What a question spells out, normalised by the same expression as the index."""
    names, inline, paths, modules = spelled_out(question)
    rows = [(kind, v.strip(" \t(){}[].*")) for kind, values in enumerate((names, inline, paths, modules)) for v in values if v.strip(" \t(){}[].*")]
    if not rows:
        return Anchors((), (), ())
    clean: list[set[str]] = [set(), set(), set(), set()]
    for r in spark.createDataFrame(rows, "kind int, value string").select("kind", T.normalized(F.col("value")).alias("value")).collect():
        if r.value and (r.kind != 2 or " " in r.value):
            clean[r.kind].add(r.value)
    return Anchors(tuple(sorted(clean[0] | clean[1])), tuple(sorted(clean[1] - clean[0])), tuple(sorted(clean[2] | clean[3])))


def weights(index: DataFrame, found: Anchors) -> dict[str, float]:
    """The summed weight of the words of each anchor, one at least."""
    words = sorted({w for a in (*found.names, *found.paths) for w in a.split(" ")})
    if not words:
        return {}
    each = dict(zip(words, L.idf(words, L.statistics(index, words)), strict=True))
    return {a: max(1.0, sum(each[w] for w in a.split(" "))) for a in (*found.names, *found.paths)}


def bonus(found: Anchors, weight: dict[str, float]) -> tuple[Column, Column]:
    """What anchors add to a node's score, and whether its name is one; over an index's words."""
    name, path, package = (F.array_join(f"{f}_words", " ") for f in ("name", "path", "package"))
    named = name.isin(*found.names) if found.names else F.lit(False)
    score = F.lit(0.0)
    for n in found.names:
        score = score + F.when(name == n, NAME_BONUS * weight[n]).otherwise(0.0)
    first = None
    for p in found.paths:
        hit = T.has_phrase(path, F.lit(p)) | T.has_phrase(package, F.lit(p))
        first = F.when(hit, PATH_BONUS * weight[p]) if first is None else first.when(hit, PATH_BONUS * weight[p])
    return (score if first is None else score + first.otherwise(0.0)), named
