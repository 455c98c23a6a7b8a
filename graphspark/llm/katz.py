"""Language-model scores by Katz backoff over words, of any order (three words by default).

Counts of n-grams are discounted by Good-Turing, each order by its own counts of counts; what a
history loses is given to the words not seen behind it, in proportion to their probability
behind the history without its first word, with weights that make every distribution sum to one
over the known words and one unknown word.  A token is evaluated from the longest history down.

The corpus is read once into blocks of word numbers, stored in a table bucketed by block.  Words
get dense numbers, common ones small.  For each order a block sends its distinct n-grams to the
partitions of that order's table as sorted, delta-coded numbers, with their counts and the counts
of their lower order, and gets back in the same order what it needs to know; no model is copied
to all workers.  N-grams are dealt by their history; those of a history that stands in more than
one of HOT tokens are dealt one by one and only their sums meet.  There are fewer than HOT such
histories at any size, so their sums are the only part of a model that a driver sees.

Blocks grow with the square root of the corpus, so that a message from a block to a partition
keeps some hundred n-grams.  Words are told apart by 64-bit hashes (two of 10^8 words are taken
for one with odds of 3 in 10,000); a model holds up to 2^31 - 2 different words (order 3; fewer
at higher orders) and refuses more.

Defined results: null and empty texts are a single end token; repeated rows, and rows that share
a key, are scored each and count as often as they stand; rows without a key take part in
training; without training rows every probability that a token needs is that of the unknown
word; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, text_slices, work_database, work_table
from .positional import coded, pack, unpack

BLOCK_TOKENS = 5 << 16
#: N-grams that a message should hold in the mean.
MESSAGE = 64
#: Blocks whose load a partition of a table has.
LOAD = 1.25
#: Counts above this are not discounted.
CUT = 5
#: A history with more than one in so many tokens is dealt by n-gram.
HOT = 1 << 14


def discounts(n: list[int]) -> list[float]:
    """Factors for counts 1 .. CUT from the numbers of items seen once, twice, .. CUT + 1 times.

    Good-Turing up to the largest cut at which all factors lie between 0 and 1; where the counts
    of counts allow none, absolute discounting.
    """
    n = [0, *n]
    for cut in range(CUT, 0, -1):
        if not all(n[r] for r in range(1, cut + 2)):
            continue
        a = (cut + 1) * n[cut + 1] / n[1]
        if a >= 1:
            continue
        found = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, cut + 1)]
        if all(0 < d < 1 for d in found):
            return found + [1.0] * (CUT - cut)
    less = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    less = min(max(less, 0.05), 0.95)
    return [(r - less) / r for r in range(1, CUT + 1)]


class Words:
    """The lowest order: probabilities by count, and that of the unknown word."""

    def __init__(self, total: int, n: list[int]):
        self.total = total
        self.factors = np.array([0.0, *discounts(n), 1.0])
        lost = sum((1 - self.factors[r]) * r * n[r - 1] for r in range(1, CUT + 1))
        if total == 0:
            self.unknown, self.scale = 1.0, 0.0
        elif lost > 0:
            self.unknown, self.scale = lost / total, 1.0 / total
        else:
            self.unknown, self.scale = 1 / (total + 1), 1 / (total + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        seen = count * self.factors[np.minimum(count, CUT + 1)] * self.scale
        return np.where(count > 0, seen, self.unknown)


class Order:
    """What is known of one order above words: its factors and the sums of its hot histories.

    Probability of a seen n-gram: its count, times the factor of the count, by the history's
    ``base``: the history's count, and one more where no word behind it is discounted.  Unseen
    words share what is lost (one, where nothing is), by their lower-order probability.
    """

    def __init__(self, n: list[int], hot: np.ndarray, few: np.ndarray, mass: np.ndarray):
        self.factors = np.array([0.0, *discounts(n), 1.0])
        self.hot, self.few, self.mass = hot, few, mass

    def seen(self, count: np.ndarray, base: np.ndarray) -> np.ndarray:
        return count * self.factors[np.minimum(count, CUT + 1)] / np.maximum(base, 1)

    def base(self, total: np.ndarray, least: np.ndarray) -> np.ndarray:
        return total + (self.factors[least] >= 1)

    def weight(self, few: np.ndarray, mass: np.ndarray, base: np.ndarray) -> np.ndarray:
        lost = (few * (1 - self.factors[1 : CUT + 1]) * np.arange(1, CUT + 1)).sum(1)
        return np.where(lost > 0, lost, 1) / np.maximum(base, 1) / np.maximum(1 - mass, 1e-300)


def least_count(few: np.ndarray) -> np.ndarray:
    """The smallest count behind each history, CUT + 1 for all above CUT."""
    return np.where((few > 0).any(1), (few > 0).argmax(1) + 1, CUT + 1)


# --- blocks --------------------------------------------------------------------------------


def planes(ids: np.ndarray) -> bytes:
    """Word numbers as bytes, all low bytes first: common words have small numbers, so the rest is mostly zero."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, lower-cased A-Z and cut at ASCII blanks, and how many each text has."""
    # A slice is copied first: lower-casing reads values that do not begin at the buffer's start wrongly.
    own = pa.concat_arrays([texts, texts.slice(0, 0)]).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    held = full.to_numpy(zero_copy_only=False)
    text, _ = runs(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return flat.filter(full), np.bincount(text[held], minlength=len(texts))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of the bytes of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))


def blocks_of(docs: DataFrame, key: str, text: str, held: str, most: int) -> DataFrame:
    """Blocks of documents: word numbers in order of frequency, the words' hashes and training counts."""
    kind = dict(docs.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = size = 0
        keys, flags, sizes, flat = [], [], [], []

        def close() -> pa.RecordBatch:
            vocab = pa.concat_arrays([pa.array([""], pa.large_string()), *flat]).dictionary_encode()
            counts = np.concatenate(sizes)
            row, offset = runs(counts)
            tokens = np.zeros(len(row), np.int32)  # the end token has number 0
            tokens[offset < counts[row] - 1] = vocab.indices.to_numpy()[1:]
            order = np.argsort(-np.bincount(tokens, minlength=len(vocab.dictionary)), kind="stable")
            new = np.empty(len(order), np.int32)
            new[order] = np.arange(len(order))
            tokens = new[tokens]
            flag = pa.concat_arrays(flags)
            own = np.bincount(tokens[~flag.to_numpy(zero_copy_only=False)[row]], minlength=len(order))
            hashes = word_hashes(vocab.dictionary)[order]
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            one = lambda x: pa.array([x], pa.binary())
            as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out = [pa.array([(part << 32) + made], pa.int64()), as_list(pa.concat_arrays(keys)), as_list(flag), one(counts.astype("<u4").tobytes()), one(hashes.tobytes()), one(pack(own)), one(planes(tokens))]
            return pa.RecordBatch.from_arrays(out, ["block", "keys", "held", "sizes", "vocab", "counts", "tokens"])

        for batch in text_slices(batches, "t", 1 << 19):
            found, n = words_of(batch.column("t"))
            keys.append(batch.column("k"))
            flags.append(batch.column("held"))
            sizes.append(n + 1)
            flat.append(found)
            size += int(n.sum()) + len(n)
            if size >= most:
                yield close()
                made, size = made + 1, 0
                keys, flags, sizes, flat = [], [], [], []
        if keys:
            yield close()

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    return source.mapInArrow(kernel, f"block long, keys array<{kind}>, held array<boolean>, sizes binary, vocab binary, counts binary, tokens binary")


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(n)).astype(np.uint16 if n < 1 << 16 else np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(values: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """Numbers coded, cut behind the first ``upto[i]`` of them."""
    data, ends = coded(values)
    return raw_cut(data, np.concatenate([[0], ends])[upto])


def raw_cut(data: np.ndarray, upto: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), upto.tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def sealed(*parts: bytes) -> bytes:
    """Parts of a message as one compressed value."""
    body = struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)
    return len(body).to_bytes(4, "little") + pa.compress(body, "zstd", asbytes=True)


def unsealed(value: bytes) -> list[bytes]:
    body = pa.decompress(memoryview(value)[4:], int.from_bytes(value[:4], "little"), "zstd", asbytes=True)
    n = int.from_bytes(body[:4], "little")
    ends = list(itertools.accumulate(struct.unpack_from(f"<{n}I", body, 4), initial=4 + 4 * n))
    return [body[a:b] for a, b in itertools.pairwise(ends)]


def opened_all(rows: list[dict]) -> list[tuple[bytes, ...]]:
    """The parts of all messages: all first parts, all second parts, .."""
    return list(zip(*(unsealed(r["data"]) for r in rows), strict=True))


def run_of(first: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the number of its run, from where runs begin."""
    out = np.zeros(n, np.int32)
    out[first] = 1
    return np.cumsum(out, dtype=np.int32) - 1


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before; at ``first`` the value itself."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def summed(delta: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The reverse of ``steps``, for runs of these sizes."""
    total = np.cumsum(delta)
    sizes = sizes[sizes > 0]
    first = np.cumsum(sizes) - sizes
    return total - (total[first] - delta[first])[run_of(first, len(delta))]


def numbers(parts: tuple[bytes, ...]) -> np.ndarray:
    """All numbers of several codes."""
    return unpack(b"".join(parts))


def held_by(parts: tuple[bytes, ...]) -> np.ndarray:
    """How many numbers each of several codes holds."""
    ends = np.flatnonzero(np.frombuffer(b"".join(parts), np.uint8) < 0x80)
    return np.diff(np.searchsorted(ends, np.cumsum([len(x) for x in parts])), prepend=0)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, none negative, in order, and the number of each value among them.

    Where a value and its place fit into 64 bits, both are sorted as one number, which takes a
    fraction of the time of a sort of places.
    """
    low = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + low > 64:
        return np.unique(values, return_inverse=True)
    both = values.astype(np.uint64)
    both <<= low
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    place = (both & ((1 << low) - 1)).view(np.int64)
    both >>= low
    first = changes(both)
    at = np.empty(len(values), np.int32)
    at[place] = np.cumsum(first, dtype=np.int32) - 1
    return both[first].view(np.int64), at


def by_place(place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``which``, numbers in ascending order, by the place of each and then as given; and their places."""
    low = len(place).bit_length()
    both = place[which].astype(np.uint32 if int(place.max(initial=0)).bit_length() + low <= 32 else np.uint64)
    both <<= low
    both |= which.astype(both.dtype)
    both.sort()
    return (both & ((1 << low) - 1)).astype(np.int64), (both >> low).astype(place.dtype)


class Level:
    """The distinct n-grams of a block for one order, sorted by (history, word), and what is known of them."""


def numbered(row: dict, n: int, bits: int) -> dict:
    """A block with the model's numbers and counts of its words instead of their hashes.

    Words unknown to the model become one word, with the greatest number; local numbers of words
    are in the order of their numbers in the model.
    """
    vocab, tokens = np.frombuffer(row["vocab"], np.uint64), from_planes(row["tokens"])
    ids, counts = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
    by = np.argsort(bucket_of(vocab, n), kind="stable")
    c, number = opened_all(sorted(row["r1"], key=lambda r: r["bucket"]))
    counts[by], ids[by] = numbers(c), numbers(number)
    ids[counts == 0] = (1 << bits) - 1
    ids, local = np.unique(ids, return_inverse=True)
    count = np.zeros(len(ids), np.int64)
    count[local] = counts
    return {"words": sealed(pack(np.diff(ids, prepend=0)), pack(count)), "ends": int(counts[tokens[-1]]), "tokens": planes(local[tokens])}


class Block:
    """A numbered block opened.  Local numbers of n-grams are in their order in the model; history 0 is the start of a text."""

    def __init__(self, row: dict, n: int, bits: int):
        self.block, self.n, self.bits = row["block"], n, bits
        ids, count = unsealed(row["words"])
        self.ids, self.count = np.cumsum(unpack(ids)), unpack(count)
        self.token, self.ends = from_planes(row["tokens"]), row["ends"]  # ends: texts learned from
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        doc, offset = runs(self.sizes)
        self.doc, self.offset = doc.astype(np.int32), offset.astype(np.int32)
        self.train = ~np.asarray(row["held"], bool)[doc]

    def level(self, below: Level | None, hot_above: int) -> Level:
        """N-grams of the next order.  ``below``: the order before, with its reply; None for pairs."""
        x = Level()
        gram, count, key = (below.at, below.count, self.keys(below)) if below else (self.token, self.count, self.ids)
        x.history = np.zeros(len(gram), np.int32)
        x.history[1:] = gram[:-1] + 1
        x.history[self.offset == 0] = 0
        x.total = np.concatenate([[self.ends], count])
        history_key = np.concatenate([[0], key])
        width = len(self.ids).bit_length()
        grams, at = distinct(x.history.astype(np.int64) << width | self.token)
        x.at = at.astype(np.int32, copy=False)
        h, w = (grams >> width).astype(np.int32), (grams & ((1 << width) - 1)).astype(np.int32)
        del grams, at
        x.hot = x.total > hot_above
        place = bucket_of(mixed(history_key.astype(np.uint64)), self.n)[h]
        one = np.flatnonzero(x.hot[h])
        place[one] = bucket_of(mixed(history_key[h[one]].astype(np.uint64) ^ mixed(self.ids[w[one]].astype(np.uint64))), self.n)
        x.order, x.place = by_place(place, np.flatnonzero((x.total > 0)[h]))
        x.h, x.history_key = h[x.order], history_key
        x.head = np.flatnonzero(changes(x.h) | changes(x.place))
        x.history_of, x.word_of = h, w
        return x

    def keys(self, x: Level) -> np.ndarray:
        """The n-grams' numbers in the model, each that of its history and then that of its word."""
        return (x.history_key << self.bits)[x.history_of] | self.ids[x.word_of]

    def message(self, x: Level, below: Level | None) -> pa.RecordBatch | None:
        """One row for each partition of the order's table that has any of the n-grams."""
        if not len(x.order):
            return None
        own = np.bincount(x.at[self.train], minlength=len(x.history_of))[x.order]
        lower = np.empty(len(x.history_of), np.int32)
        lower[x.at] = below.at if below else self.token
        lower = lower[x.order]
        first = np.flatnonzero(changes(x.place))
        upto = np.append(first[1:], len(x.place))
        runs_upto = np.searchsorted(x.head, upto)
        run_first = np.concatenate([[0], runs_upto[:-1]])
        size = np.diff(np.append(x.head, len(x.h)))
        parts = [
            cut(steps(x.history_key[x.h[x.head]], run_first), runs_upto),
            cut(2 * size + x.hot[x.h[x.head]], runs_upto),
            cut(steps(self.ids[x.word_of[x.order]], x.head), upto),
            cut(own, upto),
            cut((below.count if below else self.count)[lower], upto),
            cut(below.base[below.history_of[lower[x.head]]], runs_upto) if below else [b""] * len(upto),
        ]
        return sent(x.place[first], self.block, map(sealed, *parts))

    def answered(self, x: Level, replies: list[dict], known: Order) -> Level:
        """Adds counts of the n-grams, bases of the histories, and weights of those that a word needs."""
        c, low, few_of, mass_of = opened_all(sorted(replies, key=lambda r: r["bucket"])) or [()] * 4
        c = numbers(c)
        x.count = np.zeros(len(x.history_of), np.int64)
        x.count[x.order] = c
        head_h = x.h[x.head]
        least = np.full(len(x.total), CUT + 1)
        least[head_h] = np.frombuffer(b"".join(low), np.uint8)
        wanted = head_h[needed(c, x.head, x.hot[head_h])]
        few, mass = numbers(few_of).reshape(-1, CUT), np.frombuffer(b"".join(mass_of), float)
        hot = np.unique(head_h[x.hot[head_h]])
        spot = np.searchsorted(known.hot, x.history_key[hot])
        least[hot] = least_count(known.few[spot])
        x.base = known.base(x.total, least)
        x.weight = np.zeros(len(x.total))
        x.weight[wanted] = known.weight(few, mass, x.base[wanted])
        x.weight[hot] = known.weight(known.few[spot], known.mass[spot], x.base[hot])
        del x.order, x.place, x.h, x.head
        return x

    def values(self, levels: list[Level], known: list[Order], lowest: Words) -> np.ndarray:
        """Probability of every token.  A lower order is asked only for the tokens that the one above has not seen."""

        def behind(k: int, which: np.ndarray) -> np.ndarray:
            if not k:
                return lowest.p(self.count)[self.token[which]]
            x = levels[k - 1]
            out = known[k - 1].seen(x.count, x.base[x.history_of])[x.at[which]]
            if len(rest := np.flatnonzero(out == 0)):
                # Where nothing is known of a history, the lower order's probability stands.
                which = which[rest]
                out[rest] = np.where(x.total == 0, 1.0, x.weight)[x.history[which]] * behind(k - 1, which)
            return out

        return behind(len(levels), np.arange(len(self.token)))


def needed(c: np.ndarray, head: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which runs hold a word that is unseen behind their history, so that its weight is asked for."""
    return (np.minimum.reduceat(c, head) == 0) & ~hot if len(head) else np.zeros(0, bool)


def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after another, from batches sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values if c == "keys" else batch.column(c)[i].as_py() for c in batch.schema.names}


def sent(buckets: np.ndarray, block: int, data: Iterator[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), block)), pa.array(list(data), pa.binary())], ["bucket", "block", "data"])


def dealt(messages: DataFrame, n: int) -> DataFrame:
    return messages.repartition(n, "bucket").sortWithinPartitions("bucket", "block")


def reply(n: int, **columns: object) -> pa.RecordBatch:
    arrays = []
    for f in REPLY:
        x = columns.get(f.name)
        arrays.append(pa.nulls(n, f.type) if x is None else pa.array(x, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=REPLY)


def count_words(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Counts and numbers of the words of a bucket: the place by falling count, times n, and the bucket."""
    for rows in each_bucket(batches):
        hashes, counts = opened_all(rows)
        words, at = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)
        total = np.bincount(at, weights=numbers(counts), minlength=len(words)).astype(np.int64)
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(words))
        bucket, upto = rows[0]["bucket"], np.cumsum([len(x) // 8 for x in hashes])
        ids = ids * n + bucket + 1
        ids[total == 0] = 0
        count = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
        yield reply(1, bucket=[bucket], stats=[[int(total.sum()), int((total > 0).sum()), *count[1 : CUT + 2].tolist(), int(ids.max(initial=0))]])
        yield reply(len(rows), bucket=[bucket] * len(rows), block=[r["block"] for r in rows], data=list(map(sealed, cut(total[at], upto), cut(ids[at], upto))))


def count_grams(batches: Iterator[pa.RecordBatch], below: Order | None, lowest: Words) -> Iterator[pa.RecordBatch]:
    """The table of one order, bucket after bucket: counts of n-grams and, by history, what weights are made of."""
    for rows in each_bucket(batches):
        keys, lengths, words, own, lower, bases = opened_all(rows)
        per, run = held_by(keys), numbers(lengths)
        key = summed(numbers(keys), per)
        hot, run = run & 1 > 0, run >> 1
        head, own_n = np.cumsum(run) - run, numbers(own)
        hist, of_run = distinct(key)
        word = summed(numbers(words), run)
        width = int(word.max(initial=0)).bit_length()
        grams, at = distinct(np.repeat(of_run.astype(np.int64) << width, run) | word)
        c = np.bincount(at, weights=own_n, minlength=len(grams)).astype(np.int64)
        of, seen = grams >> width, c > 0
        low = np.zeros(len(grams), np.int64)
        low[at] = numbers(lower)
        if below is None:
            p = lowest.p(low)
        else:
            base = np.ones(len(hist), np.int64)
            base[of_run] = numbers(bases)
            p = below.seen(low, base[of])
        few = np.stack([np.bincount(of[c == r], minlength=len(hist)) for r in range(1, CUT + 1)], 1)
        mass = np.bincount(of[seen], weights=p[seen], minlength=len(hist))
        count = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)
        bucket = rows[0]["bucket"]
        yield reply(1, bucket=[bucket], stats=[[int(c.sum()), int(seen.sum()), *count[1 : CUT + 2].tolist(), 0]])
        is_hot = np.zeros(len(hist), bool)
        is_hot[of_run] = hot
        if len(j := np.flatnonzero(is_hot)):
            yield reply(len(j), bucket=[bucket] * len(j), h=hist[j], stats=few[j].tolist(), part=mass[j])
        c_all = c[at]
        want = needed(c_all, head, hot)
        runs_upto = np.cumsum(per)
        upto = np.concatenate([[0], np.cumsum(run)])[runs_upto]
        want_upto = np.concatenate([[0], np.cumsum(want)])[runs_upto]
        yield reply(
            len(rows),
            bucket=[bucket] * len(rows),
            block=[r["block"] for r in rows],
            data=list(
                map(
                    sealed,
                    cut(c_all, upto),
                    raw_cut(least_count(few)[of_run].astype(np.uint8), runs_upto),
                    cut(few[of_run[want]].reshape(-1), CUT * want_upto),
                    raw_cut(mass[of_run[want]].view(np.uint8), 8 * want_upto),
                )
            ),
        )


# --- the model -----------------------------------------------------------------------------


def scores(spark: SparkSession, docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """One row for each row of ``docs``; rows with a true ``held`` column are scored but not learned from.

    Columns: key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score, both log10.  ``order`` is the number of words in the longest n-grams, two or more.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    space, kind = work_database(spark), dict(docs.dtypes)[key]

    def stored(df: DataFrame, name: str, by: str) -> DataFrame:
        df.write.bucketBy(parts, by).option("compression", "zstd").saveAsTable(f"{space}.{name}")
        return spark.table(f"{space}.{name}")

    def replied(df: DataFrame, name: str) -> DataFrame:
        """Replies by block, next to the blocks; sums anywhere."""
        to = F.coalesce(F.col("block"), F.xxhash64("bucket", "h"))
        out = stored(df.withColumn("to", to).repartition(parts, "to"), name, "to")
        # The files of a finished shuffle, as large as the messages, stay until the driver collects its garbage.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        return out

    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    most = max(BLOCK_TOKENS, math.isqrt(MESSAGE * size // 5))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // (10 * most))
    blocks = stored(blocks_of(docs, key, text, held, most), "blocks", "block")
    n = max(1, math.ceil(blocks.count() / LOAD))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            vocab, counts = np.frombuffer(row["vocab"], np.uint64), unpack(row["counts"])
            at = bucket_of(vocab, n)
            by = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[by].astype(np.int64), prepend=-1))
            upto = np.append(first[1:], len(by))
            yield sent(at[by][first], row["block"], map(sealed, raw_cut(vocab[by].view(np.uint8), 8 * upto), cut(counts[by], upto)))

    asked = blocks.select("block", "vocab", "counts").mapInArrow(ask_words, ASK_SQL)
    words = replied(dealt(asked, n).mapInArrow(lambda b: count_words(b, n), REPLY_SQL), "replies1")
    places = [F.coalesce(F.sum(F.element_at("stats", i + 1)), F.lit(0)) for i in range(CUT + 3)]
    total, vocabulary, *ones, greatest = words.filter("stats IS NOT NULL").agg(*places, F.max(F.element_at("stats", CUT + 4))).first()
    bits = ((greatest or 0) + 1).bit_length()  # for the number of a word; all ones is the unknown word
    if bits * (order - 1) > 62:
        raise ValueError(f"{vocabulary} different words are too many for histories of {order - 1} words")
    lowest, limit = Words(total, ones), total // HOT

    def joined(base: DataFrame, numbered_replies: dict[int, DataFrame]) -> DataFrame:
        out = base
        for k, r in numbered_replies.items():
            own = r.filter("block IS NOT NULL").groupBy("to").agg(F.collect_list(F.struct("bucket", "data")).alias(f"r{k}"))
            out = out.join(own, out["block"] == own["to"], "left").drop("to")
        return out

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [numbered(row, n, bits) for row in rows_of(iter([batch]))]
            new = [pa.array([m[c] for m in made], t) for c, t in (("words", pa.binary()), ("ends", pa.int64()), ("tokens", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "keys", "held", "sizes")), *new], ["block", "keys", "held", "sizes", "words", "ends", "tokens"])

    found = joined(blocks, {1: words}).select("block", "keys", "held", "sizes", "vocab", "tokens", "r1")
    fresh = found.mapInArrow(renumber, f"block long, keys array<{kind}>, held array<boolean>, sizes binary, words binary, ends long, tokens binary")
    blocks = stored(fresh, "numbered", "block")
    for used in ("blocks", "replies1"):
        spark.sql(f"DROP TABLE {space}.{used}")

    def opened(row: dict, known: list[Order]) -> tuple[Block, list[Level]]:
        b, levels = Block(row, n, bits), []
        del row["words"], row["tokens"]
        for i, k in enumerate(known):
            x = b.level(levels[-1] if levels else None, limit)
            levels.append(b.answered(x, row.pop(f"r{i + 2}") or [], k))
        return b, levels

    known: list[Order] = []
    replies: dict[int, DataFrame] = {}
    for k in range(2, order + 1):

        def ask(batches: Iterator[pa.RecordBatch], known: tuple = tuple(known)) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                b, levels = opened(row, list(known))
                below = levels[-1] if levels else None
                if (rows := b.message(b.level(below, limit), below)) is not None:
                    yield rows

        def count(batches: Iterator[pa.RecordBatch], below: Order | None = known[-1] if known else None) -> Iterator[pa.RecordBatch]:
            return count_grams(batches, below, lowest)

        asked = joined(blocks, replies).drop("keys").mapInArrow(ask, ASK_SQL)
        replies[k] = replied(dealt(asked, n).mapInArrow(count, REPLY_SQL), f"replies{k}")
        ones = replies[k].filter("stats IS NOT NULL AND h IS NULL").agg(*places).first()[2:]
        # Sums of the hot histories: fewer than HOT rows.
        sums = [F.sum(F.element_at("stats", i + 1)).alias(f"s{i}") for i in range(CUT)]
        rows = replies[k].filter("h IS NOT NULL").groupBy("h").agg(*sums, F.sum("part").alias("part")).orderBy("h").collect()
        few = np.array([[r[f"s{i}"] for i in range(CUT)] for r in rows], np.int64).reshape(-1, CUT)
        known.append(Order(list(ones), np.array([r["h"] for r in rows], np.int64), few, np.array([r["part"] for r in rows], float)))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b, levels = opened(row, known)
            size, each = len(b.sizes), b.count[b.token]
            summed_up = lambda x: np.bincount(b.doc, weights=x, minlength=size)
            own = [pa.array(b.sizes), pa.array(summed_up(each > 0).astype(np.int64)), pa.array(np.full(size, total, np.int64))]
            own += [pa.array(summed_up(np.log10((b.count + 1) / (total + vocabulary + 1))[b.token])), pa.array(summed_up(np.log10(b.values(levels, known, lowest))))]
            yield pa.RecordBatch.from_arrays([row["keys"], pa.array(row["held"], pa.bool_()), *own], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = joined(blocks, replies).mapInArrow(evaluate, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = work_table(spark, out, "katz-scores")
    spark.sql(f"DROP DATABASE {space} CASCADE")
    return out


ASK_SQL = "bucket int, block long, data binary"
REPLY = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.int64())), ("h", pa.int64()), ("part", pa.float64())])
REPLY_SQL = "bucket int, block long, data binary, stats array<long>, h long, part double"


def hold_out(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``held``: the crc32 of the key as text leaves 2 modulo 7; rows without a key are not held out."""
    return docs.withColumn("held", F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False)))
