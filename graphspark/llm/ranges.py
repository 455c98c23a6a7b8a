"""Cutting a table into ranges of an integer key, with a bounded number of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: No table is cut into more ranges; they get larger beyond.
MOST_RANGES = 1 << 14


def key_bounds(df: DataFrame, key: str, rows: int, least: int = 1) -> list[int]:
    """Ascending lower bounds of the second and later ranges, each of about ``rows`` rows, or MOST_RANGES ranges.

    Only the key column is read.  The driver holds one number for each range.
    """
    n, low = df.agg(F.count(F.lit(1)), F.min(key)).first()
    parts = min(MOST_RANGES, max(least, -(-n // rows)))
    if low is None or parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, cuts, max(10_000, 20 * parts))).first()[0]
    return sorted(set(found) - {low})


def range_of(key: str, bounds: list[int]) -> Column:
    """Number of the range of a key; nulls are in range 0.

    A short list is searched by nested conditions.  A longer one is first narrowed by an
    equal-width grid, so that a row compares its key with the few bounds of its cell.
    """

    def search(low: int, high: int) -> Column:  # bounds[low:high] are undecided
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) >= bounds[mid], search(mid + 1, high)).otherwise(search(low, mid))

    if len(bounds) <= 64:
        return search(0, len(bounds))
    width = max(1, -(-(bounds[-1] - bounds[0] + 1) // len(bounds)))
    cells: list[list[int]] = [[] for _ in bounds]
    for b in bounds:
        cells[(b - bounds[0]) // width].append(b)
    base = _running(cells)
    cell = F.least(F.greatest(F.floor((F.col(key) - bounds[0]) / width), F.lit(0)), F.lit(len(cells) - 1)).cast("int") + 1
    own = F.element_at(F.array(*[F.array(*[F.lit(b).cast("long") for b in c]).cast("array<long>") for c in cells]), cell)
    found = F.element_at(F.array(*map(F.lit, base)), cell) + F.size(F.filter(own, lambda b: b <= F.col(key)))
    return F.coalesce(found, F.lit(0)).cast("int")


def _running(cells: list[list[int]]) -> list[int]:
    out, n = [], 0
    for c in cells:
        out.append(n)
        n += len(c)
    return out
