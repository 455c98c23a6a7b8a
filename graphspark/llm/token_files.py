"""Binary files of token ids with a minimal perfect hash index.

A store is a folder of shard files in ascending key order, directory files and a
``manifest.json``.  A shard:

    magic "TOKSHRD1", then 8 little-endian uint64: rows, ids, id width, slots, levels,
    words of level bits, distinct keys, null keys
    raw ids of all rows, one behind the other
    rows + 1 uint64   where each row's ids start, counted in ids
    rows int64        keys, ascending; null keys come first and are stored as 0
    levels uint64     bits of each level of the hash
    words uint64      the levels' bits
    slots uint32      row of the key in each slot
    slots uint32      fingerprint of that key

A directory file holds the keys of one hash bucket: magic "TOKDIRS1", 3 uint64 (slots, levels,
words), levels and words as above, and for each slot the number of its shard and a fingerprint
(uint32 each).  A key is looked up in constant time, however many shards there are: its hash
names the directory file, whose perfect hash names the shard, whose perfect hash names the row.
At each level of a perfect hash the key's bit is looked at; where it is set, the number of set
bits before is the slot.  The fingerprint tells keys that are not there, up to one in 2**32.

Keys are integers.  Defined results: null and empty texts have the end id alone; null keys are
stored first and cannot be looked up; of rows with one key, the lookup gives the first in order
of their ids; other columns, whatever their names, are ignored; an empty table makes a store
without shards.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather_ragged, map_texts, runs, shared_dir, text_slices
from .ranges import key_bounds

MAGIC = b"TOKSHRD1"
HEAD = struct.Struct("<8Q")
WORD_ENTRIES = 400_000
SLICE = 4 << 20
#: Shards are closed at this many bytes of ids, or rows.
SHARD_BYTES = 32 << 20
SHARD_ROWS = 1 << 16
DIRECTORY_KEYS = 1 << 20
DIRECTORY = b"TOKDIRS1"
DIRECTORY_HEAD = struct.Struct("<3Q")
DIRECTORY_SEED = 7_777_777
OPEN_SHARDS = 64
WORDS_A_CALL = 256
BETWEEN = "\x01"
#: White space, by one reading or another, that is not ASCII white space.
ODD_SPACE = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


class WordTable:
    """Ids of the distinct words met so far, as the library gives them; words are cut at ASCII white space."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        # A special string could reach across white space, and other white space may be cut at too:
        # such texts go to the library whole.
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[{ODD_SPACE}]", *specials])
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # Words are encoded many at a time with a control character as a word between them; its
        # one id can come from nothing else.
        alone = self.library.encode(BETWEEN, add_special_tokens=False).ids
        self.between = alone[0] if len(alone) == 1 else None

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words without special strings, some hundred words a call."""
        if self.between is None:
            return self.whole(words)
        out = []
        lines = [words[at : at + WORDS_A_CALL] for at in range(0, len(words), WORDS_A_CALL)]
        texts = [f" {BETWEEN} ".join(x) for x in lines]
        for line, got in zip(lines, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int64)
            ends = np.append(np.flatnonzero(ids == self.between), len(ids)).tolist()
            if len(ends) != len(line):  # a word holds the control character itself
                out += self.whole(line)
                continue
            raw, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
            out += [raw[a * width : b * width] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.ids) > WORD_ENTRIES:  # words of the last but one filling that were met again stay
            self.older, self.ids = self.ids, {}
        new = []
        for w in words:
            if w not in self.ids:
                if w in self.older:
                    self.ids[w] = self.older[w]
                else:
                    new.append(w)
        if new:
            self.ids.update(zip(new, self.words([w.decode() for w in new]), strict=True))
        return list(map(self.ids.__getitem__, words))

    def encode(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The raw ids of each text, null as empty, with ``end`` behind."""
        # A slice is copied first, so that its values begin where the buffers do.
        own = pc.fill_null(pa.concat_arrays([texts, texts.slice(0, 0)]).cast(pa.large_string()), "")
        odd = pc.match_substring_regex(own, self.odd).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", own))
        flat = lists.flatten()
        full = pc.not_equal(flat, "")
        row, _ = runs(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        count = np.bincount(row[full.to_numpy(zero_copy_only=False)], minlength=len(own))
        table = flat.filter(full).dictionary_encode()
        distinct = raw_values(table.dictionary)
        whole = self.whole([own[int(i)].as_py() for i in np.flatnonzero(odd)])
        # Parts of all texts in order: their words, or the whole text, and the end.
        parts = [*self.known(distinct), end, *whole]
        count = np.where(odd, 1, count)
        line, offset = runs(count + 1)
        part = np.full(len(line), len(distinct), np.int64)
        inner = offset < count[line]
        of_odd = odd[line]
        part[inner & ~of_odd] = table.indices.to_numpy()
        part[inner & of_odd] = len(distinct) + 1 + np.arange(len(whole))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        data = np.frombuffer(b"".join(parts), self.kind)
        out = gather_ragged(data, (np.cumsum(size) - size)[part], size[part])
        ends = np.concatenate([[0], np.cumsum(np.bincount(line, weights=size[part], minlength=len(own)).astype(np.int64) * self.kind.itemsize)])
        return pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


def raw_values(words: pa.Array) -> list[bytes]:
    """The bytes of each value of a large string array."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset).tolist()
    raw = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@cache
def word_table(path: str, width: int) -> WordTable:
    return WordTable(path, width)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of integer keys."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Cascade of bit arrays: at each level the keys that hash to a place alone keep it."""

    def __init__(self, levels: np.ndarray, words: np.ndarray):
        self.levels, self.words = levels, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.offsets = np.cumsum(levels) - levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` must be distinct."""
        left, levels, words = keys, [], []
        while len(left):
            bits = -(-2 * len(left) // 64) * 64
            place = (mixed(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(place, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            levels.append(bits)
            left = left[~alone[place]]
        return cls(np.array(levels, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1; a key that was not there at building may get any slot."""
        out = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = (mixed(keys[todo], level) % np.uint64(bits)).astype(np.int64) + int(self.offsets[level])
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.before[place >> 6] + np.bitwise_count(lower))[hit]
            todo = todo[~hit]
        return out


def shard_bytes(keys: np.ndarray, nulls: int, payload: list[bytes], width: int) -> bytes:
    """One shard; keys ascend, the first ``nulls`` are null."""
    lengths = np.fromiter(map(len, payload), np.int64, len(payload)) // width
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    distinct, first = np.unique(keys[nulls:], return_index=True)
    table = PerfectHash.build(distinct)
    slots = table.slot(distinct)
    row_of, mark = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    row_of[slots], mark[slots] = first + nulls, fingerprint(distinct)
    head = HEAD.pack(len(keys), int(starts[-1]), width, len(distinct), len(table.levels), len(table.words), len(distinct), nulls)
    parts = [MAGIC, head, *payload, starts.tobytes(), keys.astype("<i8").tobytes(), table.levels.astype("<u8").tobytes(), table.words.astype("<u8").tobytes(), row_of.tobytes(), mark.tobytes()]
    return b"".join(parts)


class Shard:
    """A shard opened for keyed access: the index is read at once, ids on demand."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        self.rows, self.n_ids, self.width, slots, levels, words, _, self.nulls = HEAD.unpack(self.file.read_at(HEAD.size, 8))
        self.data = 8 + HEAD.size
        index = self.file.read_at(self.file.size(), self.data + self.n_ids * self.width)
        at = 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, n, at)
            at += out.nbytes
            return out

        self.starts = take(self.rows + 1, "<u8").astype(np.int64)
        self.keys = take(self.rows, "<i8")
        self.hash = PerfectHash(take(levels, "<u8").astype(np.int64), take(words, "<u8"))
        self.row_of, self.mark = take(slots, "<u4"), take(slots, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, or -1."""
        keys = np.asarray(keys, np.int64)
        if not len(self.row_of):
            return np.full(len(keys), -1)
        slot = self.hash.slot(keys)
        there = (slot >= 0) & (self.mark[slot] == fingerprint(keys))
        return np.where(there, self.row_of[slot].astype(np.int64), -1)

    def ids(self, row: int) -> np.ndarray:
        start, end = int(self.starts[row]), int(self.starts[row + 1])
        return np.frombuffer(self.file.read_at((end - start) * self.width, self.data + start * self.width), f"<u{self.width}")

    def all_ids(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.n_ids * self.width, self.data), f"<u{self.width}")


def directory_bytes(keys: np.ndarray, shards: np.ndarray) -> bytes:
    """One directory file; ``keys`` are distinct."""
    table = PerfectHash.build(keys)
    slots = table.slot(keys)
    shard_of, mark = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    shard_of[slots], mark[slots] = shards, fingerprint(keys)
    head = DIRECTORY_HEAD.pack(len(keys), len(table.levels), len(table.words))
    return b"".join([DIRECTORY, head, table.levels.astype("<u8").tobytes(), table.words.astype("<u8").tobytes(), shard_of.tobytes(), mark.tobytes()])


class Directory:
    """A directory file opened: the shard of each of its keys."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as f:
            data = f.read()
        if data[:8] != DIRECTORY:
            raise ValueError(f"{path} is no directory of token ids")
        slots, levels, words = DIRECTORY_HEAD.unpack_from(data, 8)
        at = 8 + DIRECTORY_HEAD.size
        bits = np.frombuffer(data, "<u8", levels, at).astype(np.int64)
        self.hash = PerfectHash(bits, np.frombuffer(data, "<u8", words, at + 8 * levels))
        self.shard_of = np.frombuffer(data, "<u4", slots, at + 8 * (levels + words))
        self.mark = np.frombuffer(data, "<u4", slots, at + 8 * (levels + words) + 4 * slots)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the shard of each key, or -1."""
        if not len(self.mark):
            return np.full(len(keys), -1)
        slot = self.hash.slot(keys)
        there = (slot >= 0) & (self.mark[slot] == fingerprint(keys))
        return np.where(there, self.shard_of[slot].astype(np.int64), -1)


def directory_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys, DIRECTORY_SEED) % np.uint64(n)).astype(np.int64)


class TokenStore:
    """Keyed access to a written store: three reads a key, two where the directory file is known."""

    def __init__(self, folder: str):
        store, name = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{name}/manifest.json") as f:
            manifest = json.loads(f.read())
        self.folder, self.shards, self.directories = folder, manifest["shards"], manifest["directories"]
        self.opened = lru_cache(OPEN_SHARDS)(lambda file: Shard(f"{folder}/{file}"))
        self.listed = lru_cache(OPEN_SHARDS)(lambda file: Directory(f"{folder}/{file}"))

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key, or None."""
        if not self.directories:
            return None
        own = np.array([key], np.int64)
        number = int(self.listed(self.directories[int(directory_of(own, len(self.directories))[0])]).find(own)[0])
        if number < 0 or number >= len(self.shards):
            return None
        shard = self.opened(self.shards[number]["file"])
        row = int(shard.find(own)[0])
        return shard.ids(row) if row >= 0 else None


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, key: str = "doc_id", text: str = "text", bounds: list[int] | None = None) -> DataFrame:
    """The key and ``ids``, the raw little-endian ids of the text and the end id; with ``bounds``, the number of the key's range before them."""
    kind = dict(docs.dtypes)[key]
    edges = None if bounds is None else np.array(bounds, np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_table(tokenizer_path, width), np.array([end_id], f"<u{width}").tobytes()
        for batch in text_slices(batches, text, SLICE):
            ids = words.encode(batch.column(text), end)
            if edges is None:
                yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])
            else:
                keys = batch.column(key).cast(pa.int64())
                part = np.searchsorted(edges, pc.fill_null(keys, -(1 << 63)).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys, ids], ["part", "key", "ids"])

    return map_texts(docs, kernel, f"`{key}` {kind}, ids binary" if edges is None else "part int, key long, ids binary", key, text)


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", rows: int = 4096) -> list[dict]:
    """Write a store of ``docs`` to ``folder`` (a URI) and return its manifest's shards.

    The table is cut into key ranges of about ``rows`` rows, 2**14 of them at most, and a range into
    shards of SHARD_BYTES; a task holds one shard in memory, however many rows share a key.  A task
    that runs again writes other file names, and the manifest, written last, lists only files of
    tasks that ended.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"keys are integers, {key} is {dict(docs.dtypes)[key]}")
    width = id_width(tokenizer_path)
    bounds = key_bounds(docs, key, rows)
    dealt = encode(docs, tokenizer_path, end_id, width, key, text, bounds).repartition(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "ids")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = fs.FileSystem.from_uri(folder)
        at, made, size, keys, payload = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nulls = sum(k is None for k in keys)
            array = np.array([k or 0 for k in keys], np.int64)
            file = f"shard-{at:06d}-{made:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{name}/{file}") as out:
                out.write(shard_bytes(array, nulls, payload, width))
            row = {"part": at, "piece": made, "file": file, "rows": len(keys), "ids": size // width}
            return pa.RecordBatch.from_pylist([row], SHARD)

        for batch in batches:
            for part, k, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if keys and (part != at or size >= SHARD_BYTES or len(keys) >= SHARD_ROWS):
                    yield close()
                    made, size, keys, payload = (made + 1 if part == at else 0), 0, [], []
                at = part
                keys.append(k)
                payload.append(x)
                size += len(x)
        if keys:
            yield close()

    store, name = fs.FileSystem.from_uri(folder)
    store.create_dir(name)
    made = dealt.mapInArrow(kernel, "part int, piece int, file string, rows long, ids long")
    shards = sorted((r.asDict() for r in made.collect()), key=lambda s: (s["part"], s["piece"]))  # one row a shard
    before = 0
    for s in shards:
        s["start"] = before
        before += s["ids"]
    directories = write_directories(spark, folder, shards)
    with store.open_output_stream(f"{name}/manifest.json") as out:
        out.write(json.dumps({"width": width, "shards": shards, "directories": directories}).encode())
    return shards


def write_directories(spark: SparkSession, folder: str, shards: list[dict]) -> list[str]:
    """Directory files of the keys in all shards, by hash bucket; a key in several shards is in the first."""
    n = -(-sum(s["rows"] for s in shards) // DIRECTORY_KEYS)
    if not n:
        return []

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(f"{folder}/{file}")
                keys = np.unique(shard.keys[shard.nulls :])
                yield pa.RecordBatch.from_arrays([pa.array(directory_of(keys, n).astype(np.int32)), pa.array(keys, pa.int64()), pa.array(np.full(len(keys), number, np.int64))], ["bucket", "key", "shard"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = fs.FileSystem.from_uri(folder)
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        bucket, key, shard = (rows.column(c).to_numpy() for c in ("bucket", "key", "shard"))
        for b in np.unique(bucket).tolist():
            own = bucket == b
            order = np.lexsort((shard[own], key[own]))
            keys, first = np.unique(key[own][order], return_index=True)
            file = f"keys-{b:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{name}/{file}") as out:
                out.write(directory_bytes(keys, shard[own][order][first]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([file])], ["bucket", "file"])

    listed = spark.createDataFrame([(s["file"], i) for i, s in enumerate(shards)], "file string, number long").repartition(min(len(shards), 1 << 14))
    dealt = listed.mapInArrow(keys_of, "bucket int, key long, shard long").repartition(n, "bucket")
    files = {r.bucket: r.file for r in dealt.mapInArrow(kernel, "bucket int, file string").collect()}
    if not files:
        return []
    missing = [b for b in range(n) if b not in files]
    store, name = fs.FileSystem.from_uri(folder)
    for b in missing:  # a bucket without keys
        files[b] = f"keys-{b:06d}-empty.tok"
        with store.open_output_stream(f"{name}/{files[b]}") as out:
            out.write(directory_bytes(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return [files[b] for b in range(n)]


SHARD = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("file", pa.string()), ("rows", pa.int64()), ("ids", pa.int64())])


def read(spark: SparkSession, folder: str, shards: list[dict], key: str = "doc_id") -> DataFrame:
    """One row for each stored row, from the files: key, ``start``, ``n_tokens``, ``ids_crc32``.

    Every key is looked up in the index, and its row must be the first with this key.
    """
    listed = spark.createDataFrame([(s["file"], s["start"]) for s in shards], "file string, start long")
    if shards:
        listed = listed.repartition(len(shards))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                shard = Shard(f"{folder}/{file}")
                known = shard.keys[shard.nulls :]
                first = shard.find(known) if len(known) else known
                if not np.array_equal(first - shard.nulls, np.searchsorted(known, known)):
                    raise ValueError(f"the index of {file} does not give its keys")
                wide = shard.all_ids().astype("<u4")
                ends = shard.starts
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                keys = pa.array(shard.keys, pa.int64(), mask=np.arange(shard.rows) < shard.nulls)
                yield pa.RecordBatch.from_arrays([keys, pa.array(ends[:-1] + start), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(kernel, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    base = shared_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/tokens-{uuid.uuid4().hex}"
