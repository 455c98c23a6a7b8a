"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept.  All but the last return the columns of
``documents``; the last returns ids and digests of the final texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from graphspark.llm import pieces, pii, positional, simhash, toxicity
from graphspark.llm.common import table, work_table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document the chain rejects as toxic go; rows without a key are judged by their text too."""
    chain = toxicity.learn(docs, toxicity.label_categories(table(spark, sf_dir, "labels")), ["junk", "toxic"])
    return toxicity.keep(docs, chain, "toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row of the smallest doc_id stays; rows are judged by their own texts."""
    return simhash.one_near_copy(spark, docs, most=4, width=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose text a twentieth or more of the words stand in benchmark passages go, whatever their key."""
    rows = work_table(spark, docs.withColumn("_graphspark_row", F.monotonically_increasing_id()), "numbered-rows")
    found = positional.contamination(spark, rows.select(F.col("_graphspark_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), width=13, share=20)
    gone = found.filter("contaminated").select(F.col("doc_id").alias("_graphspark_row"))
    return rows.join(gone, "_graphspark_row", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars follows the new text."""
    clean = pii.redact(docs, pii.trained())
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, their counts and digests, decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.round_trip(docs, model))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("pieces", encode_pieces),
]

#: No SQL can express trained models and tokenizers; a brute-force version stands in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work_table(spark, docs, f"stage-{k}-{name}")
    return docs
