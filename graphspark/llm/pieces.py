"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model reaches from a character into a following white-space marker, so BPE
never merges across the start of a marked word.  Each task keeps a table of the distinct
marked words it has met, has the library segment each of them once, and puts the ids of a
text together from its words by position.

Defined results: null counts as the empty text, whose ids are the end id alone and whose
decoding is empty; repeated rows are encoded each; other columns are ignored; an empty table
gives an empty table.  A model in which a piece crosses a marker, or that rewrites text before
segmenting, is refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import map_texts, text_slices, texts_of

MARK = "▁"
MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_ENTRIES = 200_000


class ChunkTable:
    """Ids of the distinct marked words met so far."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model rewrites texts, so words cannot be segmented one by one")
        if any(MARK in p.piece.lstrip(MARK) or p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("a piece crosses a white-space marker")
        if spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError("not a BPE model")
        self.end = self.model.eos_id()
        self.plain = [None if p.type in (kinds.BYTE, kinds.UNKNOWN) else "" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ") for p in spec.pieces]
        self.ids: dict[str, bytes] = {}
        self.alone = self.model.piece_to_id(MARK)
        if self.alone == self.model.unk_id():
            raise ValueError("the white-space marker is no piece")

    def words(self, text: str) -> list[str]:
        """The marked words of a text; joined they give the text with its leading marker."""
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            return MARKED.findall(marked)
        return [MARK + w for w in marked.split(MARK)[1:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and the number of ids of each."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.ids) > TABLE_ENTRIES:
            self.ids.clear()
        new = list(set().union(*cut).difference(self.ids))
        if new:
            # The library puts the first marker there itself, but not before nothing.
            got = self.model.encode([w[1:] for w in new], num_threads=1)
            self.ids.update((w, array("i", x).tobytes()) for w, x in zip(new, got, strict=True))
            if MARK in self.ids:
                self.ids[MARK] = array("i", [self.alone]).tobytes()
        end = array("i", [self.end]).tobytes()
        each = [b"".join([*map(self.ids.__getitem__, words), end]) for words in cut]
        return np.frombuffer(b"".join(each), np.int32), np.fromiter(map(len, each), np.int64, len(each)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; byte pieces are left to the library."""
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:
            return self.model.decode(ids)
        return text.removeprefix(" ")


@cache
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key and ``ids`` (array of int, with the end id)."""
    kind = dict(docs.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in text_slices(batches, text):
            flat, lengths = table.encode(texts_of(batch, text))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [key, "ids"])

    return map_texts(docs, kernel, f"`{key}` {kind}, ids array<int>", key, text)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """Adds ``decoded``, the text that the library's decode gives for ``ids``."""
    kind = dict(encoded.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [table.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("ids"), pa.array(texts, pa.string())], [key, "ids", "decoded"])

    return encoded.select(key, "ids").mapInArrow(kernel, f"`{key}` {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``ids`` and ``decoded`` of each row: encode and decode in one pass, with one table a task."""
    kind = dict(docs.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in text_slices(batches, text):
            flat, lengths = table.encode(texts_of(batch, text))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            texts = [table.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids, pa.array(texts, pa.string())], [key, "ids", "decoded"])

    return map_texts(docs, kernel, f"`{key}` {kind}, ids array<int>, decoded string", key, text)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of encoded and decoded texts."""
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
