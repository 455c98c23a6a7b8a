"""Toxicity by a classifier chain of linear models.

The categories are predicted one behind the other; each model sees the words of the text and the
probabilities of the categories before it.  For training, those probabilities come from models
that have not seen the text (out of fold), so that later links learn from predictions of the
quality they will get.

The models are fitted on the driver on at most ``most_labelled`` labelled rows, the ones with the
smallest hash of their key; everything else runs over all rows.  A text is described by its
distinct words and their beginnings, hashed, so that forms of one stem share evidence.

Defined results: null and empty texts have no words and get the models' base rates; rows without
a key and rows that share one are scored each, by their own texts; of rows that share a labelled
key the text with the smallest hash is learned from; labels of unknown documents, without a key
or null are not used, and of several labels of one key the greatest counts; a category without
both classes among the labels gets its base rate; ties of features are kept in order of their
hashes; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices, texts_of

HASH_BITS = 22
STEMS = (4, 5, 6)
FOLDS = 5
MOST_FEATURES = 4096
LEAST_DOCS = 5
STEPS = 200
DECAY = 3e-4
WORD_ENTRIES = 200_000
#: Lower-cases A-Z and turns ASCII characters other than letters into spaces.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def distinct_words(text: str) -> set[bytes]:
    return set(text.encode().translate(LETTERS).split())


def features(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings."""
    chars = word.decode(errors="replace")
    parts = [b"=" + word, *(chars[:n].encode() for n in STEMS if len(chars) >= n)]
    return [xxhash.xxh32_intdigest(p) >> (32 - HASH_BITS) for p in parts]


@dataclass(frozen=True)
class Link:
    """One model of the chain: sparse weights, weights of the size and earlier probabilities, threshold."""

    name: str
    ids: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    threshold: float


class Rows:
    """Texts as a ragged array of feature hashes."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, sizes: np.ndarray):
        self.flat, self.lengths, self.sizes = flat, lengths, sizes
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    def pick(self, keep: np.ndarray) -> Rows:
        return Rows(self.flat[np.repeat(keep, self.lengths)], self.lengths[keep], self.sizes[keep])

    def dense(self, earlier: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(self.lengths)), np.log1p(self.sizes), earlier])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray, name: str) -> Link:
    """Logistic regression on the features that tell the classes apart best."""
    n, p = len(y), float(y.mean()) if len(y) else 0.0
    dense = rows.dense(earlier)
    if not 0 < p < 1:
        flat = np.zeros(dense.shape[1])
        flat[0] = 35.0 if p else -35.0
        return Link(name, np.zeros(0, np.int64), np.zeros(0), flat, 0.5)
    # Feature hashes of a training row are distinct, so these count texts.
    there = np.bincount(rows.flat, minlength=1 << HASH_BITS)
    in_class = np.bincount(rows.flat, weights=y[rows.row], minlength=1 << HASH_BITS)
    ids = np.flatnonzero(there >= LEAST_DOCS)
    there, in_class = there[ids], in_class[ids]
    z = (in_class - there * p) / np.sqrt(np.maximum(there * p * (1 - p) * (1 - there / (n + 1)), 1e-9))
    best = np.sort(np.argsort(-np.abs(z), kind="stable")[:MOST_FEATURES])
    best = best[z[best] != 0]
    ids = ids[best]
    table = np.full(1 << HASH_BITS, -1, np.int32)
    table[ids] = np.arange(len(ids))
    column = table[rows.flat]
    row, column = rows.row[column >= 0], column[column >= 0]
    scale = np.maximum(dense.std(0), 1e-6)
    scale[0] = 1.0
    x = dense / scale
    w, v = np.zeros(len(ids)), np.zeros(x.shape[1])
    v[0] = np.log(p / (1 - p))
    weight = np.where(y > 0, 0.5 / p, 0.5 / (1 - p)) / n
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, v)]
    for step in range(1, STEPS + 1):
        score = np.bincount(row, weights=w[column], minlength=n) + x @ v
        error = (sigmoid(score) - y) * weight
        for value, grad, (m1, m2) in ((w, np.bincount(column, weights=error[row], minlength=len(ids)) + DECAY * w, moments[0]), (v, x.T @ error, moments[1])):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad**2 - m2)
            value -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Link(name, ids, w, v / scale, 0.5)


def predict(link: Link, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    score = rows.dense(earlier) @ link.dense
    if len(link.ids) and len(rows.flat):
        place = np.minimum(np.searchsorted(link.ids, rows.flat), len(link.ids) - 1)
        known = link.ids[place] == rows.flat
        once = np.unique(rows.row[known].astype(np.int64) * len(link.ids) + place[known])
        score += np.bincount(once // len(link.ids), weights=link.weights[once % len(link.ids)], minlength=len(score))
    return sigmoid(score)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest F1 on out-of-fold probabilities, midway between two of them."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


def train(rows: Rows, labels: np.ndarray, names: list[str], fold: np.ndarray) -> list[Link]:
    """The chain over the columns of ``labels`` (nan: not known)."""
    earlier, chain = np.zeros((len(fold), 0)), []
    for k, name in enumerate(names):
        y = labels[:, k]
        known = ~np.isnan(y)
        out = np.zeros(len(fold))
        for f in range(FOLDS):
            own, rest = fold == f, (fold != f) & known
            if own.any():
                out[own] = predict(fit(rows.pick(rest), earlier[rest], y[rest], name), rows.pick(own), earlier[own])
        link = fit(rows.pick(known), earlier[known], y[known], name)
        if known.any() and 0 < y[known].mean() < 1:
            link = Link(link.name, link.ids, link.weights, link.dense, best_threshold(out[known], y[known]))
        chain.append(link)
        earlier = np.column_stack([earlier, out])
    return chain


class WordFeatures:
    """Feature hashes of the distinct words met so far."""

    def __init__(self) -> None:
        self.seen: dict[bytes, bytes] = {}

    def rows(self, texts: list[str]) -> Rows:
        cut = [distinct_words(t) for t in texts]
        if len(self.seen) > WORD_ENTRIES:
            self.seen.clear()
        for w in set().union(*cut).difference(self.seen):
            self.seen[w] = np.array(features(w), np.int32).tobytes()
        each = [np.unique(np.frombuffer(b"".join(map(self.seen.__getitem__, c)), np.int32)) for c in cut]
        flat = np.concatenate([np.zeros(0, np.int32), *each])
        return Rows(flat, np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(map(len, cut), np.int64, len(cut)))


class Scorer:
    """Weights of the distinct words met so far: only words with a known feature are kept apart."""

    def __init__(self, chain: list[Link]):
        self.chain = chain
        self.known = set(np.concatenate([link.ids for link in chain]).tolist()) if chain else set()
        self.seen: dict[bytes, bytes] = {}

    def score(self, texts: list[str]) -> np.ndarray:
        cut = [distinct_words(t) for t in texts]
        if len(self.seen) > WORD_ENTRIES:
            self.seen.clear()
        for w in set().union(*cut).difference(self.seen):
            self.seen[w] = np.array([f for f in features(w) if f in self.known], np.int32).tobytes()
        each = [b"".join(map(self.seen.__getitem__, c)) for c in cut]
        flat = np.frombuffer(b"".join(each), np.int32)
        rows = Rows(flat, np.fromiter(map(len, each), np.int64, len(each)) // 4, np.fromiter(map(len, cut), np.int64, len(cut)))
        earlier = np.zeros((len(texts), 0))
        for link in self.chain:
            earlier = np.column_stack([earlier, predict(link, rows, earlier)])
        return earlier


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", most_labelled: int = 8000) -> list[Link]:
    """Fit a chain on labelled documents; ``categories`` are 0/1 columns of ``labels``."""
    wanted = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).cast("double").alias(f"_y{i}") for i, c in enumerate(categories)])
    wanted = wanted.orderBy(F.xxhash64(key), key).limit(most_labelled)
    # At most most_labelled short rows: a proven bound for the broadcast.
    joined = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(wanted), key)
    names = [f"_y{i}" for i in range(len(categories))]
    # Of rows that repeat a key one is learned from, so the driver gets at most most_labelled rows.
    joined = joined.groupBy(key, *names).agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures()
        for batch in text_slices(batches, "_text"):
            texts = texts_of(batch, "_text")
            rows = words.rows(texts)
            folds = [xxhash.xxh32_intdigest(t.encode()) % FOLDS for t in texts]  # copies share a fold
            ends = np.concatenate([[0], np.cumsum(rows.lengths)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(folds, pa.int32()), pa.array(rows.sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.flat)), *(batch.column(c) for c in names)],
                ["key", "fold", "size", "flat", *names],
            )

    schema = f"key {dict(docs.dtypes)[key]}, fold int, size long, flat array<int>, " + ", ".join(f"{c} double" for c in names)
    got = joined.select(key, "_text", *names).mapInArrow(kernel, schema).toArrow().sort_by([("key", "ascending"), ("fold", "ascending"), ("size", "ascending")]).combine_chunks()
    lists = got.column("flat").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not got.num_rows:
        return train(Rows(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros((0, len(names))), categories, np.zeros(0, np.int64))
    lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = Rows(lists.flatten().to_numpy(), lengths, got.column("size").to_numpy())
    y = np.column_stack([got.column(c).to_numpy().astype(float) for c in names])
    return train(rows, y, categories, got.column("fold").to_numpy().astype(np.int64))


def classify(docs: DataFrame, chain: list[Link], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, for each category its probability ``p_<name>``, and whether it is at its threshold."""
    names = [link.name for link in chain]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in text_slices(batches, text):
            p = scorer.score(texts_of(batch, text))
            flags = [pa.array(p[:, k] >= link.threshold) for k, link in enumerate(chain)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(chain))), *flags], [key, *(f"p_{n}" for n in names), *names])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, " + ", ".join(f"p_{n} double" for n in names) + ", " + ", ".join(f"{n} boolean" for n in names)
    return map_texts(docs, kernel, schema, key, text)


def keep(docs: DataFrame, chain: list[Link], category: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are below the threshold of a category, with all their columns."""
    place = [link.name for link in chain].index(category)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in text_slices(batches, text):
            yield batch.filter(pa.array(scorer.score(texts_of(batch, text))[:, place] < chain[place].threshold))

    return docs.mapInArrow(kernel, docs.schema)


def label_categories(labels: DataFrame) -> DataFrame:
    """The two categories of the labels table: junk (quality 0) and toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic").cast("int").alias("toxic"))
