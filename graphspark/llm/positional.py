"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: a block of documents (about BLOCK_BYTES of text) has one row,
with its terms, and for each term the ascending word positions at which it stands, delta coded.
Positions count through the block, with one position left free behind every document, so that
no phrase reaches across documents.  A query needs no shuffle of postings: every block answers
for its own documents, and only the (document, item) hits leave it.

A phrase is matched from its rarest term in the block: the lists are taken in order of length,
shifted by the term's place in the phrase and intersected, until nothing is left.  A benchmark of
any size is matched in slices of SLICE_BYTES, each of which reads the written index again.

Defined results: null, empty and word-less texts have no words and no hits; a word-less item
has no windows; keys may be of any type, null or repeated, and each row is a document of its own;
items with one id share it, null ids count as the empty string; other columns, whatever their
names, are ignored; empty tables give no rows, or documents without hits.
"""

from __future__ import annotations

from collections.abc import Container, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, runs, text_slices, texts_of, work_table

BLOCK_BYTES = 6 << 20
#: Bytes of benchmark text that are matched in one reading of the index.
SLICE_BYTES = 16 << 20
#: Bytes that are part of words, lower case: digits, letters and all bytes of characters above 0x7F.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode().translate(WORD_BYTES).split()


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length coding of unsigned numbers below 2**63, seven bits a byte, and where each code ends."""
    most = int(values.max(initial=0))
    if most < 0x80:
        return values.astype(np.uint8), np.arange(1, len(values) + 1)
    rest = values.astype(np.uint32 if most < 1 << 32 else np.uint64)
    width = np.ones(len(rest), np.uint8)
    for bits in range(7, 63, 7):
        if most >> bits == 0:
            break
        width += rest >= 1 << bits
    ends = np.cumsum(width, dtype=np.int64)
    out, at = np.empty(int(ends[-1]), np.uint8), ends - width
    while len(rest):  # only what has further bytes goes on
        more = rest >= 0x80
        out[at] = (rest & 0x7F).astype(np.uint8) | more.view(np.uint8) << 7
        has = np.flatnonzero(more)
        at, rest = at[has] + 1, rest[has] >> 7
    return out, ends


def pack(values: np.ndarray) -> bytes:
    """Numbers coded one behind the other."""
    return coded(values)[0].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    at = np.concatenate([[0], ends[:-1] + 1])
    byte, shift = raw[at], 0
    out = (byte & 0x7F).astype(np.int64)
    has = np.flatnonzero(byte >= 0x80)
    at = at[has]
    while len(has):
        at, shift = at + 1, shift + 7
        byte = raw[at]
        out[has] |= (byte & 0x7F).astype(np.int64) << shift
        more = np.flatnonzero(byte >= 0x80)
        has, at = has[more], at[more]
    return out


def block_row(texts: list[str]) -> dict:
    """The index of one block of documents."""
    cut = [words(t) for t in texts]
    number = {w: i for i, w in enumerate(set().union(*cut))}
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = np.fromiter((number[w] for c in cut for w in c), np.uint32, int(lengths.sum()))
    position = np.arange(len(flat)) + np.repeat(np.arange(len(cut)), lengths)
    order = np.argsort(flat, kind="stable")
    count = np.bincount(flat, minlength=len(number))
    position = position[order]
    delta = np.diff(position, prepend=0)
    first = np.cumsum(count) - count
    delta[first] = position[first]
    size = np.ones(len(delta), np.int64)
    for bits in (7, 14, 21, 28):
        size += delta >= 1 << bits
    ends = np.concatenate([[0], np.cumsum(size)])
    return {
        "starts": starts,
        "lengths": lengths,
        "terms": b" ".join(number),
        "ends": ends[np.cumsum(count)].astype("<u4").tobytes(),
        "postings": pack(delta),
    }


class Block:
    """An index row opened for queries."""

    def __init__(self, row: dict, wanted: Container[bytes] | None = None):
        ends = np.concatenate([[0], np.frombuffer(row["ends"], "<u4")]).tolist()
        self.data, self.cache = row["postings"], {}
        self.at = {t: (ends[i], ends[i + 1]) for i, t in enumerate(row["terms"].split()) if wanted is None or t in wanted}
        self.ids = row["doc_ids"]
        self.hash = xxhash.xxh3_128_hexdigest(row["postings"] + row["terms"] + repr((row["starts"], self.ids.to_pylist())).encode())
        self.starts, self.lengths = np.asarray(row["starts"], np.int64), np.asarray(row["lengths"], np.int64)

    def list(self, term: bytes) -> np.ndarray:
        """Positions of a term."""
        if term not in self.cache:
            a, b = self.at[term]
            self.cache[term] = np.cumsum(unpack(self.data[a:b]))
        return self.cache[term]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Positions at which the terms, all of which the block has, stand one behind the other."""
        spans = sorted((self.at[t][1] - self.at[t][0], k, t) for k, t in enumerate(terms))
        found = self.list(spans[0][2]) - spans[0][1]
        for _, k, t in spans[1:]:
            if not len(found):
                break
            other = self.list(t)
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k]
        return found

    def near(self, terms: list[bytes], within: int) -> np.ndarray:
        """Positions of the rarest term with all other terms at most ``within`` words away, in its document."""
        spans = sorted((self.at[t][1] - self.at[t][0], t) for t in set(terms) if t in self.at)
        if len(spans) < len(set(terms)) or not spans:
            return np.zeros(0, np.int64)
        found = self.list(spans[0][1])
        doc = self.document(found)
        for _, t in spans[1:]:
            other = self.list(t)
            low = np.maximum(found - within, self.starts[doc])
            high = np.minimum(found + within, self.starts[doc] + self.lengths[doc])
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            found, doc = found[keep], doc[keep]
        return found

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def index_schema(kind: str) -> str:
    return f"doc_ids array<{kind}>, starts array<long>, lengths array<long>, terms binary, ends binary, postings binary"


def index_batch(row: dict, ids: list[pa.Array]) -> pa.RecordBatch:
    own = pa.concat_arrays(ids)
    columns = {"doc_ids": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)}
    columns |= {c: pa.array([row[c]], pa.list_(pa.int64())) for c in ("starts", "lengths")}
    columns |= {c: pa.array([row[c]], pa.binary()) for c in ("terms", "ends", "postings")}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all whole texts, one row for each block of documents; keys of any type."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in text_slices(batches, text):
            ids.append(batch.column(key))
            texts += texts_of(batch, text)
            size += sum(map(len, texts[-batch.num_rows :]))
            if size >= BLOCK_BYTES:
                yield index_batch(block_row(texts), ids)
                ids, texts, size = [], [], 0
        if ids:
            yield index_batch(block_row(texts), ids)

    return map_texts(docs, kernel, index_schema(dict(docs.dtypes)[key]), key, text)


class Windows:
    """All windows of ``width`` words of a slice of items; a shorter item is one window.

    The items' words stand one behind the other as numbers of distinct terms, so that a block
    finds the few windows of which it has every term without looking at windows one by one.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        items = [(i, w) for i, w in items if w]
        number: dict[bytes, int] = {}
        for _, w in items:
            for t in w:
                number.setdefault(t, len(number))
        self.names, self.terms, self.number = [i for i, _ in items], list(number), number
        lengths = np.array([len(w) for _, w in items], np.int64)
        self.flat = np.fromiter((number[t] for _, w in items for t in w), np.int32, int(lengths.sum()))
        begin, each = np.cumsum(lengths) - lengths, np.maximum(lengths - width + 1, 1)
        item, offset = runs(each)
        self.start, self.item, self.width = (begin[item] + offset).astype(np.int32), item.astype(np.int32), np.minimum(lengths, width)[item].astype(np.int32)

    def matches(self, block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, width, positions) of the windows that stand in a block."""
        here = np.zeros(len(self.terms), bool)
        here[[self.number[t] for t in block.at]] = True
        missing = np.concatenate([[0], np.cumsum(~here[self.flat])])
        for w in np.flatnonzero(missing[self.start + self.width] == missing[self.start]).tolist():
            a, n = int(self.start[w]), int(self.width[w])
            found = block.phrase([self.terms[t] for t in self.flat[a : a + n].tolist()])
            if len(found):
                yield int(self.item[w]), n, found


def _blocks(batches: Iterator[pa.RecordBatch], wanted: Container[bytes]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({c: batch.column(c)[i].values if c == "doc_ids" else batch.column(c)[i].as_py() for c in batch.schema.names}, wanted)


def phrase_hits(index: DataFrame, windows: Windows) -> DataFrame:
    """(place, doc_id, n_words, n_hit, spans, items) of each indexed document: words inside any match, as runs of them, and the items.

    ``place`` tells the rows of an index apart: the block and the document in it.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, windows.number):
            span = int(block.starts[-1] + block.lengths[-1]) + 2
            edge = np.zeros(span, np.int64)
            items: list[set[int]] = [set() for _ in range(len(block.ids))]
            for item, width, found in windows.matches(block):
                np.add.at(edge, found, 1)
                np.add.at(edge, found + width, -1)
                for d in np.unique(block.document(found)).tolist():
                    items[d].add(item)
            covered = np.cumsum(edge) > 0
            hit = np.concatenate([[0], np.cumsum(covered)])
            n_hit = hit[block.starts + block.lengths] - hit[block.starts]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
            spans: list[list[dict]] = [[] for _ in range(len(block.ids))]
            for a, b, d in zip(turns[::2].tolist(), turns[1::2].tolist(), block.document(turns[::2]).tolist(), strict=True):
                spans[d].append({"a": a - int(block.starts[d]), "b": b - int(block.starts[d])})
            names = [sorted({windows.names[i] for i in x}) for x in items]
            place = pa.array([f"{block.hash}/{i}" for i in range(len(block.ids))])
            columns = [place, block.ids, pa.array(block.lengths), pa.array(n_hit), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "doc_id", "n_words", "n_hit", "spans", "items"])

    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return index.mapInArrow(kernel, f"place string, doc_id {kind}, n_words long, n_hit long, spans array<struct<a: long, b: long>>, items array<string>")


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def proximity_hits(index: DataFrame, queries: list[tuple[str, list[bytes]]], within: int) -> DataFrame:
    """(doc_id, item, n): places where all terms of an item stand within so many words of its rarest."""
    wanted = {t for _, terms in queries for t in terms}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, wanted):
            rows = []
            for item, terms in queries:
                docs, n = np.unique(block.document(block.near(terms, within)), return_counts=True)
                if len(docs):
                    rows.append(pa.RecordBatch.from_arrays([block.ids.take(pa.array(docs)), pa.array([item] * len(docs)), pa.array(n)], ["doc_id", "item", "n"]))
            yield from rows

    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return index.mapInArrow(kernel, f"doc_id {kind}, item string, n long")


def slices(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text", most: int = SLICE_BYTES) -> Iterator[Windows]:
    """The windows of every item, in slices of about ``most`` bytes of text that the driver holds one at a time.

    An empty benchmark is one slice without windows.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-size // most))
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Windows([(i, words(t)) for i, t in own.collect()], width)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, most: int = SLICE_BYTES, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, the items matched, and whether at least 1/share of its words are hit.

    The index is written once and read again for each slice of the benchmark; with several slices a
    document's hits are put together from those that have any.
    """
    index = work_table(spark, build_index(docs, key), "positional-index")
    found = [phrase_hits(index, w) for w in slices(benchmark, width, most=most)]
    hits = found[0]
    if len(found) > 1:
        some = work_table(spark, reduce(DataFrame.unionByName, [f.filter("n_hit > 0").select("place", "spans", "items") for f in found]), "window-hits")
        each = some.groupBy("place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
        merged = F.aggregate("spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")))
        rows = hits.select("place", "doc_id", "n_words")
        hits = rows.join(each.select("place", merged["n"].alias("n_hit"), "items"), "place", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    hits = hits.select("doc_id", "n_words", "n_hit", "items")
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
