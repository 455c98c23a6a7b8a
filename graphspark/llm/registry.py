"""The queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import katz, pieces, pii, positional, repeats, simhash, sketches, token_counts, token_files, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, share=20)
    return positional.digest(found)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, toxicity.learn(docs, toxicity.label_categories(labels), ["junk", "toxic"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.as_hex(simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), most=4, width=4))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.scores(spark, katz.hold_out(docs), "held")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.over_limit(counts, 1024)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.round_trip(table(spark, sf_dir, "documents"), model))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(spark, table(spark, sf_dir, "documents"), least=200))


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.digest(sketches.likeness(table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    shards = token_files.write(spark, table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, folder, shards)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.trained()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_katz": op4_katz,
    "op5_token_counts": op5_token_counts,
    "op6_pieces": op6_pieces,
    "op7_repeats": op7_repeats,
    "op8_sketches": op8_sketches,
    "op9_token_files": op9_token_files,
    "op10_pii": op10_pii,
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS t FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS t FROM benchmark),
s AS (SELECT item, t, least(13, len(t)) AS k FROM b WHERE len(t) > 0),
w AS (SELECT DISTINCT item, k, array_to_string(t[i : i + k - 1], ' ') AS p FROM (SELECT item, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM s)),
k AS (SELECT DISTINCT k FROM w),
o AS (SELECT doc_id, i, k, array_to_string(t[i : i + k - 1], ' ') AS p FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM d, k WHERE len(t) >= k)),
m AS (SELECT doc_id, i, k, item FROM o JOIN w USING (k, p)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
