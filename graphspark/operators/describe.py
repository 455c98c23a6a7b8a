"""Communities written to nodes' meta data, and descriptions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of meta data that communities own, and those among them that describe one.
DESCRIPTION_KEYS = ("communityDescription", "communityDescriptionSource", "communityDescriptionConfidence", "communityDescriptionRationale")
COMMUNITY_KEYS = ("community", "communityName", "communitySize", "communityGranularity", "communityHubThreshold", "communityLabel", "communityLabelStatus", "communityLabelOverlap", "communityPreviousId", *DESCRIPTION_KEYS)
MOST_SOURCE, MOST_TEXT, MOST_RATIONALE = 200, 2_000, 2_000


def _meta() -> Column:
    return F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>"))


def _with(meta: Column, added: dict[str, Column]) -> Column:
    kept = F.map_filter(meta, lambda k, v: ~k.isin(*added))
    return F.map_concat(kept, F.create_map(*[x for k, v in added.items() for x in (F.lit(k), v)]))


def removed(nodes: DataFrame) -> DataFrame:
    """Nodes without what communities wrote; meta data that becomes empty is null."""
    rest = F.map_filter(_meta(), lambda k, v: ~k.isin(*COMMUNITY_KEYS))
    return nodes.withColumn("meta", F.when(F.size(rest) > 0, rest))


def stamped(nodes: DataFrame, assigned: DataFrame, granularity: str, hub: int) -> DataFrame:
    """Nodes with their community (assigned: id, community, name, size).

    A node that moves loses the description and the label of its old community; a label that
    stays is kept.
    """
    own = nodes.join(assigned.select("id", F.col("community").alias("_c"), F.col("name").alias("_n"), F.col("size").alias("_s")), "id")
    moved = F.coalesce(_meta()["community"], F.lit("")) != F.col("_c")
    fresh = moved | (F.coalesce(_meta()["communityLabel"], F.lit("")) == "")
    drop = F.when(moved, F.array(*map(F.lit, DESCRIPTION_KEYS))).otherwise(F.array().cast("array<string>"))
    stale = F.when(fresh, F.array(F.lit("communityLabelOverlap"), F.lit("communityPreviousId"))).otherwise(F.array().cast("array<string>"))
    base = F.map_filter(_meta(), lambda k, v: ~F.array_contains(F.concat(drop, stale), k))
    added = {"community": F.col("_c"), "communityName": F.col("_n"), "communitySize": F.col("_s").cast("string"), "communityGranularity": F.lit(granularity), "communityHubThreshold": F.lit(str(hub))}
    plain = _with(base, added)
    labelled = _with(plain, {"communityLabel": F.col("_n"), "communityLabelStatus": F.lit("deterministic")})
    return own.withColumn("meta", F.when(fresh, labelled).otherwise(plain)).select(*nodes.columns)


def description_problems(rows: DataFrame, nodes: DataFrame, version: int, source: str) -> DataFrame:
    """(community, problem): what keeps descriptions (community, description, rationale) from being applied."""
    spark = rows.sparkSession
    head = [(None, "unsupported version")] * (version != 1) + [(None, "source is required")] * (not source.strip()) + [(None, "source is too long")] * (len(source.strip().encode()) > MOST_SOURCE)
    trimmed = rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("community", "description", "rationale")])
    bad = lambda condition, problem: trimmed.filter(condition).select("community", F.lit(problem).alias("problem"))
    found = spark.createDataFrame(head, "community string, problem string")
    for condition, problem in (
        (F.col("community") == "", "community is required"),
        (F.col("description") == "", "description is required"),
        (F.octet_length("description") > MOST_TEXT, "description is too long"),
        (F.col("rationale") == "", "rationale is required"),
        (F.octet_length("rationale") > MOST_RATIONALE, "rationale is too long"),
    ):
        found = found.union(bad(condition, problem))
    twice = trimmed.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("community", F.lit("repeated community").alias("problem"))
    known = nodes.select(_meta()["community"].alias("community")).filter("community <> ''").distinct()
    loose = trimmed.filter("community <> ''").join(known, "community", "left_anti").select("community", F.lit("not in the graph").alias("problem"))
    return found.union(twice).union(loose)


def described(nodes: DataFrame, rows: DataFrame, source: str, version: int = 1) -> DataFrame:
    """Nodes with the description of their community; a ValueError where there are problems or no descriptions."""
    wrong = description_problems(rows, nodes, version, source).first()
    if wrong is not None or not rows.take(1):
        raise ValueError(f"{wrong.community or 'descriptions'}: {wrong.problem}" if wrong is not None else "at least one description is required")
    told = rows.select(F.trim("community").alias("_c"), F.trim("description").alias("_d"), F.trim("rationale").alias("_r"))
    own = nodes.withColumn("_c", _meta()["community"]).join(told, "_c", "left")
    added = {"communityDescription": F.col("_d"), "communityDescriptionSource": F.lit(source.strip()), "communityDescriptionConfidence": F.lit("inferred"), "communityDescriptionRationale": F.col("_r")}
    return own.withColumn("meta", F.when(F.col("_d").isNull(), F.col("meta")).otherwise(_with(_meta(), added))).select(*nodes.columns)
