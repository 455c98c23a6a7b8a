"""Ranked lexical search over nodes: BM25F over five fields with name bonuses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import SYMBOL_KINDS

# Field weights, saturation, length normalisation and bonuses.
FIELDS = {"name": 5.0, "path": 2.0, "package": 2.0, "id": 1.0, "meta": 1.0}
K1, B = 1.2, 0.75
EXACT_PHRASE, PREFIX_PHRASE, EXACT_NAME, QUALIFIED_NAME = 10_000.0, 1_000.0, 1_000.0, 10_000.0
COMPOUND_NAME, PREFIX_NAME, INSIDE_NAME, INSIDE_SOURCE, INSIDE_META = 1_000.0, 100.0, 1.0, 0.5, 0.25
LONG_QUERY, LONG_QUERY_SHARE = 6, 0.25


def build_index(nodes: DataFrame) -> DataFrame:
    """One row a node: id, kind, name and for each field its words and their number (1 at least)."""
    fields = {f: F.coalesce(F.col(f), F.lit("")) for f in ("name", "path", "package", "id")}
    fields["meta"] = T.searchable_meta(F.col("meta")) if "meta" in nodes.columns else F.lit("")
    words = nodes.select("id", "kind", "name", *[T.tokens(c).alias(f"{f}_words") for f, c in fields.items()])
    return words.select("*", *[F.greatest(F.lit(1), F.size(f"{f}_words")).alias(f"{f}_length") for f in FIELDS])


def terms_of(spark: SparkSession, question: str) -> tuple[list[str], list[str]]:
    """Search terms and all words of a question, by the same expressions as the index."""
    row = spark.range(1).select(T.query_terms(F.lit(question)).alias("t"), T.tokens(F.lit(question)).alias("w")).first()
    return list(row.t), list(row.w)


def statistics(index: DataFrame, terms: list[str]) -> dict:
    """Number of nodes, average lengths and for each term its document frequency: one scan, one row."""
    has = [F.greatest(*[F.array_contains(f"{f}_words", t).cast("int") for f in FIELDS]) for t in terms]
    inside = [F.array_join("name_words", " ").contains(t).cast("int") for t in terms]
    row = index.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{f}_length").alias(f) for f in FIELDS], *[F.sum(c).alias(f"d{i}") for i, c in enumerate(has)], *[F.sum(c).alias(f"s{i}") for i, c in enumerate(inside)]).first()
    return row.asDict()


def idf(terms: list[str], stats: dict) -> list[float]:
    import math

    return [math.log(1 + max(1, stats["n"]) / (1 + (stats[f"d{i}"] or stats[f"s{i}"] or 0))) for i in range(len(terms))]


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns) if columns else F.lit(0.0)


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def score(index: DataFrame, terms: list[str], words: list[str], stats: dict) -> DataFrame:
    """The index with ``score`` and ``matched``; a single projection over it."""
    weight = idf(terms, stats)
    name, ident = F.array_join("name_words", " "), F.array_join("id_words", " ")
    texts = {f: F.array_join(f"{f}_words", " ") for f in ("path", "package", "id", "meta")}
    phrase = " ".join(terms)
    top = max([1.0, *weight])
    score_ = F.when((name == phrase) | (ident == phrase), EXACT_PHRASE * top).when(name.startswith(phrase) | ident.startswith(phrase), PREFIX_PHRASE * top).otherwise(0.0)
    exact_scale = LONG_QUERY_SHARE if len(terms) > LONG_QUERY else 1.0
    parts, tiered, matched = [score_], [], []
    for t, w in zip(terms, weight, strict=True):
        exact, prefix, inside = name == t, name.startswith(t), name.contains(t)
        before = [words[i - 1] for i, x in enumerate(words) if x == t and i]
        qualified = F.arrays_overlap("package_words", F.array(*map(F.lit, before))) & F.col("kind").isin(*SYMBOL_KINDS) if before else F.lit(False)
        tiered.append(F.when(exact, EXACT_NAME * exact_scale * w).when(prefix, PREFIX_NAME * w).otherwise(0.0))
        parts.append(F.when(exact & qualified, QUALIFIED_NAME * w).otherwise(0.0))
        parts.append(F.when(~prefix & inside, INSIDE_NAME * w).otherwise(0.0))
        tf = _sum([_count(f"{f}_words", t) / (1 - B + B * F.col(f"{f}_length") / max(1.0, stats[f] or 0.0)) * fw for f, fw in FIELDS.items()])
        near = texts["path"].contains(t) | texts["package"].contains(t) | texts["id"].contains(t)
        in_meta = texts["meta"].contains(t)
        parts.append(F.when(tf > 0, w * (tf * (K1 + 1)) / (tf + K1)).otherwise(F.when(near, INSIDE_SOURCE * w).otherwise(0.0) + F.when(in_meta, INSIDE_META * w).otherwise(0.0)))
        matched.append((inside | (tf > 0) | near | in_meta).cast("int"))
    distinct = F.array_distinct("name_words")
    weights = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*map(F.lit, weight)))
    whole = (F.size(distinct) > 1) & (F.size(distinct) <= len(terms)) & (F.size(F.array_except(distinct, F.array(*map(F.lit, terms)))) == 0)
    parts.append(F.when(whole, COMPOUND_NAME * F.aggregate(distinct, F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at(weights, x), F.lit(0.0)))).otherwise(0.0))
    scored = index.withColumn("matched", _sum(matched)).withColumn("_plain", _sum(parts)).withColumn("_tier", _sum(tiered))
    cover = F.col("matched") / len(terms)
    total = F.col("_plain") + F.col("_tier") * cover * cover
    if len(terms) > 1:
        total = total * (0.5 + cover * cover)
    return scored.withColumn("score", total).drop("_plain", "_tier")


def touched(terms: list[str]) -> Column:
    """Whether a node has some term, whole or as a part, in some field; no other has a score."""
    anywhere = F.concat_ws(" ", *[F.array_join(f"{f}_words", " ") for f in FIELDS])
    return reduce(lambda a, b: a | b, [anywhere.contains(t) for t in terms], F.lit(False))


def search(spark: SparkSession, nodes: DataFrame, question: str, limit: int = 25, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best nodes: score down, shorter names first, then id.  Scores are in thousandths, 1 at least.

    ``step`` writes the index and reads it back, so that words are cut once for statistics and scores.
    """
    terms, words = terms_of(spark, question)
    index = build_index(nodes)
    if not terms:
        return index.limit(0).select("id", "kind", "name", F.lit(0).cast("bigint").alias("score"))
    index = step(index) if step else index
    ranked = score(index.filter(touched(terms)), terms, words, statistics(index, terms)).filter("score > 0")
    return ranked.orderBy(F.desc("score"), F.length("name"), "id").limit(limit).select("id", "kind", "name", F.greatest(F.lit(1), F.round(F.col("score") * 1000).cast("bigint")).alias("score"))


def term_frequencies(nodes: DataFrame) -> DataFrame:
    """(id, field, term, tf) in long form."""
    index = build_index(nodes)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_words").alias("words")) for f in FIELDS])
    return index.select("id", F.explode(fields).alias("x")).select("id", "x.field", F.explode("x.words").alias("term")).groupBy("id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(nodes: DataFrame) -> DataFrame:
    """(term, df): number of nodes with a term in any field."""
    return term_frequencies(nodes).select("id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def trigram_candidates(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Ids with all three-character runs of some term in their name: postings joined with the terms'."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select("term", T.trigrams(F.col("term")).alias("g")).select("term", F.size("g").alias("need"), F.explode("g").alias("gram"))
    postings = nodes.select("id", F.explode(T.trigrams(T.normalized(F.col("name")))).alias("gram"))
    hits = postings.join(F.broadcast(wanted), "gram").groupBy("id", "term", "need").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter("n = need").select("id", "term")
