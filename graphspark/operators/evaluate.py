"""Scoring of retrieval: hits, ranks, spans, aggregates, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_path, normalized, paths_match


def score(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Per case: recall, precision, reciprocal rank, and recall and precision of evidence.

    ``cases``: id, dataset, expected (ids), and may have evidence (ids).  ``found``: id, ids in order, and
    may have edges (ids, evidence too), tokens and truncated.  Repeated hits count each time, in recall
    (over the distinct expected ids) as in precision; the rank is of the first hit.  Expected ids stand
    for evidence where a case has none; a case that expects evidence alone is scored by it.
    """
    empty = F.array().cast("array<string>")
    has = lambda df, c: F.coalesce(F.col(c), empty) if c in df.columns else empty
    own = cases.select("id", "dataset", F.coalesce("expected", empty).alias("expected"), has(cases, "evidence").alias("evidence"))
    got = found.select("id", "ids", has(found, "edges").alias("edges"), *[c for c in ("tokens", "truncated") if c in found.columns])
    both = own.join(got, "id", "left").withColumn("ids", F.coalesce("ids", empty))
    shown = F.concat("ids", F.coalesce("edges", empty))
    proof = F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.col("expected"))
    alone = F.size("expected") == 0

    def hits(ids, wanted):
        flags = F.transform(ids, lambda x: F.array_contains(wanted, x))
        n = F.size(F.filter(flags, lambda x: x))
        first = F.array_position(flags, True)
        expected = F.size(F.array_distinct(wanted))
        some = expected > 0
        return (
            F.when(some, n / expected).otherwise(0.0),
            F.when(some & (F.size(ids) > 0), n / F.size(ids)).otherwise(0.0),
            F.when(some & (first > 0), 1 / first).otherwise(0.0),
        )

    by_id, by_proof = hits(F.col("ids"), F.col("expected")), hits(shown, proof)
    main = [F.when(alone, p).otherwise(i).alias(n) for n, i, p in zip(("recall", "precision", "reciprocal_rank"), by_id, by_proof, strict=True)]
    return both.select("id", "dataset", *main, by_proof[0].alias("evidence_recall"), by_proof[1].alias("evidence_precision"), *[c for c in ("tokens", "truncated") if c in found.columns])


def aggregate(scores: DataFrame) -> DataFrame:
    """Means by dataset and, with a null dataset, over all; one pass with grouping sets.

    With tokens, their mean, their nearest-rank middle and recall per thousand of them; with truncated, its share.
    """
    means = [F.avg(c).alias(c) for c in ("recall", "precision", "reciprocal_rank", "evidence_recall", "evidence_precision") if c in scores.columns]
    more = [F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY recall)").alias("recall_p95")]
    if "tokens" in scores.columns:
        per = lambda c: F.avg(F.when(F.col("tokens") > 0, F.col(c) * 1000 / F.col("tokens")).otherwise(0.0))
        more += [F.avg("tokens").alias("tokens"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY tokens)").alias("tokens_p50"), per("recall").alias("recall_per_1k"), per("evidence_recall").alias("evidence_per_1k")]
    if "truncated" in scores.columns:
        more.append(F.avg(F.col("truncated").cast("int")).alias("truncation_rate"))
    return scores.rollup("dataset").agg(F.count(F.lit(1)).alias("cases"), *means, *more)


def identifiers(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case: whether an identifier was found, the first rank, its reciprocal, and the share of identifiers found.

    ``items``: case, rank, name, path.  ``gold``: case, identifier, and paths (where it stands).  An item
    is a hit by its normalised name, or by a path that ends in one of the identifier's.
    """
    wanted = gold.filter(normalized(F.col("identifier")) != "").select("case", "identifier", normalized(F.col("identifier")).alias("key"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths")).distinct()
    own = items.select("case", "rank", normalized(F.col("name")).alias("name"), "path")
    by_name = own.join(wanted, (own["case"] == wanted["case"]) & (own["name"] == wanted["key"])).select(own["case"], "rank", "identifier")
    last = lambda c: F.element_at(F.split(canonical_path(c), "/"), -1)
    each = wanted.select("case", "identifier", F.explode("paths").alias("gold")).withColumn("file", last(F.col("gold")))
    by_path = own.withColumn("file", last(F.coalesce("path", F.lit("")))).join(each, ["case", "file"]).filter(paths_match(F.col("path"), F.col("gold"))).select("case", "rank", "identifier")
    found = by_name.union(by_path).groupBy("case").agg(F.min("rank").alias("rank"), F.count_distinct("identifier").alias("n"))
    total = gold.select("case").distinct().join(wanted.groupBy("case").agg(F.count_distinct("identifier").alias("of")), "case", "left").join(found, "case", "left")
    return total.select("case", F.coalesce(F.col("n") > 0, F.lit(False)).alias("hit"), "rank", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("n") / F.col("of"), F.lit(0.0)).alias("recall"))


def funnel(traces: DataFrame, by: str = "case") -> DataFrame:
    """How far the traced nodes of each case came: any ranked, seeded, traversed, walked, candidate, returned; and why others were dropped."""
    at = lambda c: F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    why = F.array_sort(F.collect_set(F.when(F.coalesce("dropped", F.lit("")) != "", F.col("dropped"))))
    return traces.groupBy(by).agg(at("lexical_rank").alias("ranked"), flag("seeded").alias("seeded"), flag("traversed").alias("traversed"), at("walk_rank").alias("walked"), at("candidate_rank").alias("candidate"), at("returned_rank").alias("returned"), why.alias("dropped"))


def stale(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, expected): expected ids that no node has."""
    each = cases.select("id", F.explode("expected").alias("expected"))
    return each.join(nodes.select(F.col("id").alias("expected")), "expected", "left_anti").select("id", "expected").distinct()


def gate(overall: DataFrame, minimum: dict[str, float]) -> DataFrame:
    """(metric, value, minimum) of the metrics that are below their minimum."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("minimum")) for m, v in minimum.items()])
    return overall.select(F.explode(pairs).alias("x")).select("x.*").filter("value < minimum")


def answer_problems(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(id, problem): records that no case has, that stand twice, or that found a fact their case does not expect."""
    twice = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated record").alias("problem"))
    loose = records.join(cases.select("id"), "id", "left_anti").select("id", F.lit("matches no case").alias("problem"))
    own = records.join(cases.select("id", "facts"), "id")
    extra = own.filter(F.size(F.array_except(F.coalesce("found", F.array().cast("array<string>")), F.coalesce("facts", F.array().cast("array<string>")))) > 0)
    bare = own.filter(F.col("found").isNotNull() & (F.size(F.coalesce("facts", F.array().cast("array<string>"))) == 0)).select("id", F.lit("its case expects no facts").alias("problem"))
    return twice.union(loose).union(extra.select("id", F.lit("found an unexpected fact").alias("problem"))).union(bare)


def answers(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Accuracy over judged records and coverage of key facts over scored ones, by dataset and over all.

    ``answer_problems`` tells what must not be there; a ValueError names the first of them.
    """
    wrong = answer_problems(cases, records).orderBy("id").first()
    if wrong is not None:
        raise ValueError(f"answer {wrong.id!r}: {wrong.problem}")
    own = cases.select("id", "dataset", "facts").join(records, "id")
    found = F.size(F.array_intersect("facts", "found"))
    coverage = F.when((F.size("facts") > 0) & F.col("found").isNotNull(), found / F.size("facts"))
    judged = own.select("dataset", F.col("correct").cast("int").alias("correct"), coverage.alias("coverage"))
    return judged.rollup("dataset").agg(F.count(F.lit(1)).alias("records"), F.avg("correct").alias("accuracy"), F.avg("coverage").alias("coverage"))


def merge_intervals(spans: DataFrame, by: list[str]) -> DataFrame:
    """Intervals (start, end, whole numbers) that overlap or touch, as one; gaps and islands."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return opens.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def line_overlap(wanted: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, common): lines that both sets of intervals cover."""
    a, b = merge_intervals(wanted, by), merge_intervals(found, by)
    both = a.select(*by, F.col("start").alias("s1"), F.col("end").alias("e1")).join(b, by).filter("s1 <= end AND start <= e1")
    return both.groupBy(*by).agg(F.sum(F.least("e1", "end") - F.greatest("s1", "start") + 1).alias("common"))


def enclosing(points: DataFrame, spans: DataFrame, by: str, bucket: int = 256) -> DataFrame:
    """Each point (by, offset) with the narrowest span (by, start, end, name) around it.

    An interval join: spans are filed under every bucket they touch and points under their own,
    so the join has an equality besides the range.
    """
    filed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    near = points.withColumn("_b", F.floor(F.col("offset") / bucket)).join(filed, [by, "_b"]).filter("start <= offset AND offset < end")
    return near.groupBy(by, "offset").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "start", "name")).alias("m")).select(by, "offset", F.col("m.name").alias("name"))
