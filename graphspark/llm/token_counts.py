"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts are cut into chunks (white space and the word behind it); a pre-token never reaches
across such a cut, so the count of a text is the sum over its chunks.  The distinct new
chunks of a slice are split into pre-tokens, and all distinct pre-tokens are merged together
as ragged numpy arrays: in each round every sequence applies its own lowest-rank pair at all
places at once, until no sequence has a known pair.  The surviving symbols are counted.

Defined results: null and empty texts have no tokens; repeated rows are counted each; other
columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather_ragged, map_texts, runs, text_slices, texts_of

# The Unicode White_Space characters, and the pre-token pattern of byte-level BPE.
SPACE = "\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
CACHE_ENTRIES = 700_000
SLOT_BITS = 20
SLOT_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-in characters of byte-level BPE, mapped to their bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merge ranks of one tokenizer file as sorted arrays; counts the symbols of byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.first[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # Two direct-address tables; the second holds the pairs that lost their slot in the first.
        self.slots = [np.zeros(1 << SLOT_BITS, np.int32) for _ in SLOT_FACTORS]
        rest = np.arange(len(self.keys))
        for slots, factor in zip(self.slots, SLOT_FACTORS, strict=True):
            slots[self.slot(self.keys[rest], factor)] = rest
            rest = rest[slots[self.slot(self.keys[rest], factor)] != rest]
        self.crowded = self.keys[rest]
        self.crowded_at = rest

    @staticmethod
    def slot(pair: np.ndarray, factor: int) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - SLOT_BITS)

    def look_up(self, pair: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted merge table, or -1."""
        at = self.slots[0][self.slot(pair, SLOT_FACTORS[0])]
        miss = np.flatnonzero(self.keys[at] != pair)
        again = self.slots[1][self.slot(pair[miss], SLOT_FACTORS[1])]
        again = np.where(self.keys[again] == pair[miss], again, -1)
        for key, place in zip(self.crowded, self.crowded_at, strict=True):
            again[pair[miss] == key] = place
        at[miss] = again
        return at

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that each word ends with."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        live = np.arange(len(words))  # words that may still merge, in order
        keep = lengths > 1
        symbols = gather_ragged(symbols, (np.cumsum(lengths) - lengths)[keep], lengths[keep])
        live, lengths = live[keep], lengths[keep]
        while len(live):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            place = self.look_up(symbols[:-1] * self.size + symbols[1:])
            place[ends[:-1] - 1] = -1  # no pair across two words
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1] = np.where(place >= 0, self.rank[place], NO_RANK)
            best = np.minimum.reduceat(rank, starts)
            row, _ = runs(lengths)
            hit = (rank == best[row]) & (rank != NO_RANK)
            # In a run of overlapping pairs ("aaa") every second one merges, from the left.
            index = np.arange(len(hit))
            opens = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.maximum.accumulate(np.where(opens, index, 0))
            hit &= (index - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.made[place[at]]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            lengths = lengths - np.bincount(row[at], minlength=len(lengths))
            symbols = symbols[left]
            done = (best == NO_RANK) | (lengths == 1)
            if done.any():
                out[live[done]] = lengths[done]
                starts = np.cumsum(lengths) - lengths
                symbols = gather_ragged(symbols, starts[~done], lengths[~done])
                live, lengths = live[~done], lengths[~done]
        return out


class TokenCounter:
    """Counts tokens of texts, remembering the counts of chunks it has seen."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.special = re.compile("|".join(map(re.escape, self.merger.specials))) if self.merger.specials else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.seen: dict[str, int] = {}

    def learn(self, chunks: list[str]) -> None:
        words = [self.pre_token.findall(c) for c in chunks]
        ids: dict[str, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64)
        counts = self.merger.count([w.encode() for w in ids])
        rows = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        total = np.bincount(rows, weights=counts[flat], minlength=len(words)).astype(np.int64)
        self.seen.update(zip(chunks, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            cut.append(CHUNK.findall(text) if len(parts) == 1 else [c for p in parts for c in CHUNK.findall(p)])
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        new = list(set().union(*cut).difference(self.seen))
        if new:
            self.learn(new)
        return [n + sum(map(self.seen.__getitem__, c)) for n, c in zip(extra, cut, strict=True)]


@cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, ``n_bytes`` (UTF-8) and ``n_tokens``.

    No begin, end or added special tokens; special strings inside a text are one token each,
    as the tokenizer library treats them by default.
    """
    kind = dict(docs.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path)
        for batch in text_slices(batches, text):
            texts = texts_of(batch, text)
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), size, pa.array(tokens.count(texts), pa.int64())], [key, "n_bytes", "n_tokens"])

    return map_texts(docs, kernel, f"`{key}` {kind}, n_bytes long, n_tokens long", key, text)


def over_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
