"""Content-derived identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.concat(kind, F.lit("://"), F.substring(F.sha1(F.concat(kind, nul, src, nul, dst)), 1, 24))


def content_id(scheme: str, *parts: Column) -> Column:
    """``scheme://a#b``: trimmed parts, empty ones left out."""
    kept = F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p != "")
    return F.concat(F.lit(f"{scheme}://"), F.array_join(kept, "#"))


def community_id(members: Column) -> Column:
    """``c-`` and eight digits of the hash of the sorted members, each ended by a NUL."""
    nul = F.char(F.lit(0))
    return F.concat(F.lit("c-"), F.substring(F.sha2(F.concat(F.array_join(F.sort_array(members), "\0"), nul), 256), 1, 8))
