"""Removal of repeated byte strings with longest-previous-factor arrays.

``lpf`` gives, for every position of a text, the longest string that starts there and also at an
earlier position: in suffix order the nearest smaller positions on either side (previous and next
smaller values) are the only candidates, and the common prefixes with them decide.  Read from the
right end it gives later copies too.  Positions with a factor of ``least`` bytes start a repeat.

Over a corpus the suffixes are first dealt to groups that hold all copies of a string.  Every
window of ``least`` bytes names an anchor: of its GRAM-byte strings the one with the smallest
hash.  Equal windows name equal anchors at equal places, so windows of different anchors never
need comparing.  Consecutive windows with one anchor make a run.  Runs with equal bytes are
repeats as a whole and are counted, not sorted.  Where an anchor has runs with different bytes,
its distinct runs are put into suffix order to ``least`` bytes and their factors found.  An
anchor with more than GROUP distinct runs is not sorted in one task: its windows are counted by
their hash, partly before the shuffle.

Defined results: null counts as the empty text; texts shorter than ``least`` keep all bytes;
rows with equal texts are copies of each other; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs as ragged
from .common import text_slices, work_table

GRAM = 64
GROUP = 4096
HEAVY = 4096
SLICE = 2 << 20
BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 24


# --- factors of one text -------------------------------------------------------------------


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling, and the rank of every position."""
    n = len(text)
    rank = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    step, order = 1, np.argsort(rank, kind="stable")
    while n:
        key = rank * (n + 257) + np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        if new[-1] == n - 1:
            break
        step *= 2
    return order, rank - 1


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the previous and the next smaller value, or -1 and n, by pointer jumping."""
    n = len(values)
    padded = np.concatenate([values, [np.iinfo(np.int64).min]])
    before = np.arange(n) - 1
    todo = np.arange(n)
    while (todo := todo[(before[todo] >= 0) & (padded[before[todo]] > values[todo])]).size:
        before[todo] = before[before[todo]]
    after = np.arange(n) + 1
    todo = np.arange(n)
    while (todo := todo[(after[todo] < n) & (padded[np.minimum(after[todo], n)] > values[todo])]).size:
        after[todo] = after[after[todo]]
    return before, after


def common_prefix(text: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, all compared together."""
    raw = np.frombuffer(text + b"\0", np.uint8)
    n, out, live = len(text), np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        live = live[(np.maximum(x, y) < n) & (raw[np.minimum(x, n)] == raw[np.minimum(y, n)])]
        out[live] += 1
    return out


def lpf(text: bytes) -> np.ndarray:
    """For every position, the length of the longest earlier factor that starts there too."""
    order, _ = suffix_array(text)
    before, after = smaller_neighbours(order)
    out = np.zeros(len(text), np.int64)
    for other, has in ((before, before >= 0), (after, after < len(order))):
        at = order[has]
        out[at] = np.maximum(out[at], common_prefix(text, at, order[other[has]]))
    return out


# --- factors of groups of windows ----------------------------------------------------------


def truncated_order(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts whose first ``least`` bytes occur twice, in suffix order to that depth, with their class.

    Sorted word by word from the left; a start that is alone with its prefix can have no factor
    and leaves.  Ties keep the order of ``starts``.
    """
    live = np.arange(len(starts))
    label = np.zeros(len(starts), np.int64)
    for depth in range(0, least, 8):
        at = starts[live] + min(depth, least - 8)
        word = data[at[:, None] + np.arange(8)].view(">u8").reshape(-1).astype(np.uint64)
        order = np.lexsort((word, label))
        word, label, live = word[order], label[order], live[order]
        fresh = np.concatenate([[True], (word[1:] != word[:-1]) | (label[1:] != label[:-1])])
        label = np.cumsum(fresh) - 1
        shared = np.bincount(label, minlength=len(label))[label] > 1
        live, label = live[shared], label[shared]
        if not len(live):
            break
    order = np.lexsort((live, label))
    return live[order], label[order]


def factors(places: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place in suffix order has a factor before it, and one behind it.

    ``places`` stand in suffix order, ``label`` tells equal prefixes.  The nearest smaller places on
    either side are the only candidates for the longest earlier factor, the nearest greater ones
    for the longest later one; it is as long as the order is deep where the labels agree.
    """
    out = []
    for values in (places, -places):
        found = np.zeros(len(places), bool)
        before, after = smaller_neighbours(values)
        for other, has in ((before, before >= 0), (after, after < len(places))):
            found[has] |= label[other[has]] == label[has]
        out.append(found)
    return out[0], out[1]


def factor_starts(contents: list[bytes], spans: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, start, earlier) of window starts with a factor of ``least`` bytes elsewhere.

    The contents stand one behind the other; factor arrays over their windows, cut off at
    ``least``, are read from both ends.  ``earlier`` tells that a factor stands before a window.
    """
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    base = np.cumsum(sizes) - sizes
    row, offset = ragged(np.asarray(spans, np.int64))
    data = np.frombuffer(b"".join(contents), np.uint8)
    live, label = truncated_order(data, base[row] + offset, least)
    if not len(live):
        return row[:0], offset[:0], np.zeros(0, bool)
    earlier, later = factors(live, label)
    keep = earlier | later
    return row[live[keep]], offset[live[keep]], earlier[keep]


# --- windows, anchors and runs of texts ----------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_held[0]):
        out = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(factor, len(p), 1 << 64))])
            out.append(p)
        _held[:] = out
    return _held[0][:n], _held[1][:n]


_held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_VALUES = np.array([pow(0xD6E8FEB86659FD93, i + 3, 1 << 64) for i in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def window_runs(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window, windows, place of the anchor, hash of the bytes) of all runs.

    ``data`` holds texts one behind the other, ``ends`` where each ends.
    """
    n, width = len(data), least - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return (none.view(np.uint64), none, none, none, none, none.view(np.uint64))
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:n], out=prefix[1:])
    grams = _mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    smallest = (grams & ~low) | (place & low)
    reach = 1
    while 2 * reach <= width:  # minimum over windows of doubling width
        smallest = np.minimum(smallest[:-reach], smallest[reach:])
        reach *= 2
    if reach < width:
        smallest = np.minimum(smallest[: len(smallest) - (width - reach)], smallest[width - reach :])
    count = n - least + 1
    start = np.arange(count)
    anchor = start + ((smallest[:count] - start.astype(np.uint64)) & low).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:count]
    inside = start + least <= ends[text]
    change = np.ones(count, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    span = np.diff(np.append(first, count))
    keep = inside[first]
    first, span = first[keep], span[keep]
    end = first + span - 1 + least
    content = _mix((prefix[end] - prefix[first]) * inverse[first])
    begin = np.concatenate([[0], ends[:-1]])[text[first]]
    return grams[anchor[first]], text[first], first - begin, span, anchor[first] - first, content


def text_key(text: Column) -> list[Column]:
    """Equal for equal texts: two hashes and the size."""
    return [F.xxhash64(text).alias("k"), F.xxhash64(F.lit(7), text).alias("k2"), F.octet_length(text).alias("n")]


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, column):
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def corpus_runs(docs: DataFrame, least: int) -> DataFrame:
    """The runs of all texts: anchor ``h``, text key, first window ``at``, ``span``, anchor place ``off``, bytes' hash ``c``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "t"):
            raw = batch.column("t").cast(pa.binary())
            texts = [x.as_py() for x in raw]
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            h, text, at, span, off, c = window_runs(np.frombuffer(b"".join(texts), np.uint8), ends, least)
            if len(h):
                keys = [batch.column(x).take(pa.array(text)) for x in ("k", "k2", "n")]
                ints = [pa.array(x.astype(np.int32)) for x in (at, span, off)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *keys, *ints, pa.array(c.view(np.int64))], ["h", "k", "k2", "n", "at", "span", "off", "c"])

    source = docs.filter(F.octet_length("t") >= least).select("t", *text_key(F.col("t")))
    return source.mapInArrow(kernel, "h long, k long, k2 long, n int, at int, span int, off int, c long")


def repeated_windows(spark: SparkSession, docs: DataFrame, least: int, group: int = GROUP, order: DataFrame | None = None) -> DataFrame:
    """(k, k2, n, a, b): byte ranges of texts that are covered by strings that stand elsewhere too.

    With ``order`` (k, k2, n, d0: the place of each text), only strings that stand before count: in a text
    of a smaller place, or earlier in the same text.
    """
    kind = ["h", "off", "span", "c"]
    key = ["k", "k2", "n"]
    found = work_table(spark, corpus_runs(docs, least), "runs")
    anchors = found.groupBy("h").agg(F.count(F.lit(1)).alias("runs"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("off").alias("o0"), F.max("off").alias("o1"), F.min("span").alias("s0"), F.max("span").alias("s1"))
    shared = anchors.filter("runs > 1").select("h", "runs", F.expr("c0 <> c1 OR o0 <> o1 OR s0 <> s1").alias("mixed"))
    # Occurrences at anchors that stand twice; equal texts make equal rows, counted as copies.  Anchors of
    # more than one in HEAVY runs are fewer than HEAVY: they are broadcast, and their runs stay where they are.
    shared = work_table(spark, shared.select("*", (F.col("runs") > found.count() // HEAVY).alias("heavy")), "shared-anchors")
    heavy = F.broadcast(shared.filter("heavy").select("h", "mixed"))
    rest = found.join(F.broadcast(shared.filter("heavy").select("h")), "h", "left_anti").join(shared.filter("NOT heavy").select("h", "mixed"), "h")
    both = found.join(heavy, "h").unionByName(rest)
    occur = work_table(spark, both.groupBy(*kind, "mixed", *key, "at").agg(F.count(F.lit(1)).alias("copies")), "shared-runs")
    if order is not None:
        occur = work_table(spark, occur.join(order, key), "placed-runs")
    rank = F.struct("d0", "at")
    chosen = [F.min(F.struct(*key, "at")).alias("first")] if order is None else [F.min_by(F.struct(*key, "at"), rank).alias("first"), F.min(rank).alias("rank")]
    kinds = work_table(spark, occur.groupBy(*kind, "mixed").agg(F.sum("copies").alias("copies"), *chosen), "run-kinds")
    whole = kinds.filter("copies > 1").select(*kind, F.lit(0).alias("a"), F.col("span").alias("b"))

    # The bytes of one run of each kind, where an anchor has several kinds.
    wanted = kinds.filter("mixed").select(*kind, "copies", "first.*").groupBy(*key).agg(F.collect_list(F.struct(*kind, "copies", "at")).alias("runs"))
    texts = docs.select("t", *text_key(F.col("t")))
    one = texts.join(wanted, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()  # of copies of a text in this task one is enough
        for batch in text_slices(batches, "t"):
            rows = []
            keys = zip(*(batch.column(x).to_pylist() for x in key), strict=True)
            for text, t, listed in zip(keys, batch.column("t").cast(pa.binary()), batch.column("runs").to_pylist(), strict=True):
                if text in done:
                    continue
                done.add(text)
                raw = t.as_py()
                rows += [r | {"content": raw[r["at"] : r["at"] + r["span"] - 1 + least]} for r in listed]
            yield pa.RecordBatch.from_pylist(rows, CONTENT)

    sizes = kinds.filter("mixed").groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    bytes_of = one.select("t", *key, "runs").mapInArrow(cut, "h long, off int, span int, c long, copies long, content binary").dropDuplicates(kind)
    contents = work_table(spark, bytes_of.join(sizes.filter(F.col("kinds") > group), "h", "left"), "run-bytes")

    only_earlier = order is not None

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            h = t.column("h").to_numpy()
            change = np.flatnonzero(h[1:] != h[:-1]) + 1
            end = t.num_rows if final else int(change[-1]) if len(change) else 0
            if end < t.num_rows:
                held.extend(t.slice(end).to_batches())
            if not end:
                return
            # The anchor's own bytes are part of every window, so groups sorted together stay apart.
            part = t.slice(0, end)
            row, start, earlier = factor_starts(part.column("content").to_pylist(), part.column("span").to_pylist(), least)
            if only_earlier:
                row, start = row[earlier], start[earlier]
            by = np.lexsort((start, row))
            row, start = row[by], start[by]
            if len(row):
                opens = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
                at = np.flatnonzero(opens)
                last = np.append(at[1:], len(row)) - 1
                picked = part.select(kind).take(pa.array(row[at])).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(picked.column(x).combine_chunks() for x in kind), pa.array(start[at].astype(np.int32)), pa.array((start[last] + 1).astype(np.int32))], [*kind, "a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SLICE:
                yield from flush(False)
                size = 0
        if held:
            yield from flush(True)

    if only_earlier:  # groups stand in the order of their first places
        contents = work_table(spark, contents.join(kinds.select(*kind, "rank"), kind), "placed-bytes")
    usual = contents.filter("kinds IS NULL").repartition("h").sortWithinPartitions("h", *(["rank"] if only_earlier else ["off", "c"])).select(*kind, "content")
    sorted_out = usual.mapInArrow(factors, "h long, off int, span int, c long, a int, b int")
    # Very common anchors: windows are counted, each with the place of the anchor in it.
    placed = ["rank"] if only_earlier else []
    windows = contents.filter("kinds IS NOT NULL").select(*kind, *placed, F.explode(F.sequence(F.lit(0), F.col("span") - 1)).alias("a"), "content")
    piece = F.substring(F.col("content"), F.col("a") + 1, F.lit(least))
    windows = windows.select(*kind, *placed, "a", (F.col("off") - F.col("a")).alias("d"), F.xxhash64(piece).alias("w"), F.xxhash64(F.lit(7), piece).alias("w2"))
    same = windows.groupBy("h", "d", "w", "w2")
    if only_earlier:
        head = same.agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("rank", "a")).alias("_head")).filter("_n > 1")
        again = windows.join(head, ["h", "d", "w", "w2"]).filter(F.struct("rank", "a") != F.col("_head")).select(*kind, "a", (F.col("a") + 1).alias("b"))
        parts = work_table(spark, sorted_out.unionByName(again), "repeated-windows")
        joined = occur.join(kinds.select(*kind, "rank"), kind).withColumn("_later", F.struct("d0", "at") != F.col("rank"))
        later = joined.filter("_later").select(*key, F.col("at").alias("a"), (F.col("at") + F.col("span") - 1 + least).alias("b"))
        own = joined.filter("NOT _later").select(*kind, *key, "at").join(parts, kind)
        return later.unionByName(own.select(*key, (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") - 1 + least).alias("b")))
    common = same.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    counted = windows.join(common, ["h", "d", "w", "w2"]).select(*kind, "a", (F.col("a") + 1).alias("b"))

    parts = work_table(spark, whole.unionByName(sorted_out).unionByName(counted), "repeated-windows")
    return occur.join(parts, kind).select(*key, (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") - 1 + least).alias("b"))


CONTENT = pa.schema([("h", pa.int64()), ("off", pa.int32()), ("span", pa.int32()), ("c", pa.int64()), ("copies", pa.int64()), ("content", pa.binary())])


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that meet or overlap become one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(spark: SparkSession, docs: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text", keep_first: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the key, ``kept`` (bytes), ``spans`` (removed byte ranges), ``n_bytes``.

    Every byte covered by a string of ``least`` bytes that also starts anywhere else goes; with
    ``keep_first``, only if it also starts before: in a row of a smaller key (null first), or earlier in
    the row.  Then of rows with equal texts all but those of the smallest key go as a whole, if they
    have ``least`` bytes; rows that share key and text count as one.
    """
    if least < GRAM + 8:
        raise ValueError(f"least must be {GRAM + 8} or more")
    place = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"))
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"), place.alias("d"))
    keyed = own.select(key, "t", "d", *text_key(F.col("t")))
    order = work_table(spark, keyed.groupBy("k", "k2", "n").agg(F.min("d").alias("d0")), "text-places") if keep_first else None
    marks = repeated_windows(spark, own.select("t"), least, order=order)
    per_text = work_table(spark, marks.groupBy("k", "k2", "n").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "repeated-ranges")
    both = keyed.join(per_text, ["k", "k2", "n"], "left")
    if order is not None:
        every = F.when(F.col("n") >= least, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))))
        both = both.join(order, ["k", "k2", "n"]).withColumn("ranges", F.when(F.col("d") == F.col("d0"), F.col("ranges")).otherwise(every))
    both = both.select(key, "t", "ranges")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "t"):
            kept, spans, sizes = [], [], []
            for t, listed in zip(batch.column("t").cast(pa.binary()), batch.column("ranges").to_pylist(), strict=True):
                raw, at, left = t.as_py(), 0, []
                gone = joined_ranges([(r["a"], r["b"]) for r in listed or []])
                for a, b in gone:
                    left.append(raw[at:a])
                    at = b
                kept.append(b"".join([*left, raw[at:]]))
                spans.append([{"a": a, "b": b} for a, b in gone])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(sizes, pa.int64())], [key, "kept", "spans", "n_bytes"])

    return both.mapInArrow(kernel, f"`{key}` {dict(docs.dtypes)[key]}, kept binary, spans array<struct<a: int, b: int>>, n_bytes long")


def keep_first(text: bytes, least: int) -> bytes:
    """One text without the later copies of its repeats: a byte goes if a string of ``least`` bytes over it has an earlier factor."""
    start = np.flatnonzero(lpf(text) >= least)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + least, -1)
    return np.frombuffer(text, np.uint8)[np.cumsum(edge[:-1]) == 0].tobytes()


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
