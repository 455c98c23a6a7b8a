"""Ranked candidates put in order for a short answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized

# Places of the lexical prefix and of the reserve behind it, copies of a name, bounds of the budget.
PREFIX, RESERVE, SAME_FILE_SLOT, COPIES = 16, 8, 1, 2
BUDGET_LEAST, BUDGET_MOST, BUDGET_BASE, BUDGET_STEP, BUDGET_PROSE, BUDGET_UNCERTAIN = 800, 1400, 700, 30, 2000, 1200


def eligible(nodes: DataFrame) -> Column:
    """Folders, imports and what is not resolved are no candidates."""
    fine = ~F.col("kind").isin("import", "dir")
    return fine & (F.coalesce(F.col("meta")["resolved"], F.lit("")) != "false") if "meta" in nodes.columns else fine


def adaptive_budget(most: int, candidates: int, anchors: int) -> int:
    """A budget by what a question names: more for prose, less where few candidates are sure."""
    if most <= BUDGET_LEAST:
        return most
    wanted = BUDGET_PROSE if not anchors else max(BUDGET_LEAST, min(BUDGET_MOST, BUDGET_BASE + BUDGET_STEP * candidates)) if candidates > 1 else BUDGET_UNCERTAIN
    return min(most, wanted)


def diversified(rows: DataFrame, by: list[str], copies: int = COPIES) -> DataFrame:
    """Rows (by, place, kind, name) with new places: of one kind and name ``copies`` first (one of files), the others behind all."""
    same = normalized(F.regexp_replace("name", r"\(\)$", ""))
    n = F.row_number().over(Window.partitionBy(*by, "kind", "_same").orderBy("place"))
    late = rows.withColumn("_same", same).withColumn("_late", n > F.when(F.col("kind") == "file", min(1, copies)).otherwise(copies))
    late = late.withColumn("_late", F.col("_late") & F.lit(copies > 0))
    return late.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_late", "place")) - 1).drop("_same", "_late")


def graph_slots(rows: DataFrame, by: list[str], prefix: int = PREFIX, reserve: int = RESERVE, slot: int = SAME_FILE_SLOT) -> DataFrame:
    """Rows (by, place, lexical, rescued) with new places: behind the prefix some that the graph alone has found.

    First as many of them as leave room for rescued ones (``slot`` - 1 at most), then the rescued, then
    further ones, ``reserve`` in all; then the rest in order.
    """
    part = Window.partitionBy(*by)
    behind = F.col("place") >= prefix
    own = rows.withColumn("_r", F.coalesce("rescued", F.lit(False)) & behind).withColumn("_g", ~F.coalesce("lexical", F.lit(False)) & ~F.coalesce("rescued", F.lit(False)) & behind)
    own = own.withColumn("_rescues", F.sum(F.col("_r").cast("int")).over(part))
    early = F.least(F.greatest(F.lit(0), reserve - F.least(F.lit(reserve), F.col("_rescues"))), F.lit(max(0, slot - 1)))
    own = own.withColumn("_early", early).withColumn("_gn", F.when(F.col("_g"), F.sum(F.col("_g").cast("int")).over(part.orderBy("place"))))
    own = own.withColumn("_rn", F.when(F.col("_r"), F.sum(F.col("_r").cast("int")).over(part.orderBy("place"))))
    own = own.withColumn("_taken", F.greatest(F.lit(0), F.least(F.col("_early"), F.sum(F.col("_g").cast("int")).over(part))))
    first = F.col("_gn") <= F.col("_early")
    own = own.withColumn("_first", F.coalesce(first, F.lit(False))).withColumn("_second", F.coalesce(F.col("_rn") <= reserve - F.col("_taken"), F.lit(False)))
    own = own.withColumn("_open", reserve - F.col("_taken") - F.least(F.col("_rescues"), reserve - F.col("_taken")))
    # A rescued row that found no place counts as one of the graph, if the graph has found it.
    more = behind & ~F.col("_first") & ~F.col("_second") & ~F.coalesce("lexical", F.lit(False))
    own = own.withColumn("_mn", F.when(more, F.sum(more.cast("int")).over(part.orderBy("place")))).withColumn("_third", F.coalesce(F.col("_mn") <= F.col("_open"), F.lit(False)))
    rank = F.when(~behind, 0).when(F.col("_first"), 1).when(F.col("_second"), 2).when(F.col("_third"), 3).otherwise(4)
    few = F.max("place").over(part) < prefix
    own = own.withColumn("_rank", F.when(few, 0).otherwise(rank)).withColumn("place", F.row_number().over(part.orderBy("_rank", "place")) - 1)
    return own.select(*rows.columns)


def promoted(walked: DataFrame, ranked: DataFrame, most: int = 128) -> DataFrame:
    """(id, place): the best ranked ids (id, rank), ``most`` at most, then the walk's (id, place) that are not among them."""
    head = ranked.orderBy("rank", "id").limit(most).select("id", F.lit(0).alias("part"), F.col("rank").alias("at"))
    tail = walked.join(head.select("id"), "id", "left_anti").select("id", F.lit(1).alias("part"), F.col("place").alias("at"))
    return head.union(tail).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "at", "id")) - 1).select("id", "place")
