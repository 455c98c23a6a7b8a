"""SimHash near-duplicates by the generalised pigeonhole principle.

Two 64-bit fingerprints within ``most`` differing bits, cut into m groups of bits, must for any
thresholds T_i >= -1 with sum most - m + 1 be within T_i on some group i.  Bits that vary
together are put into the same group; the thresholds of every cut into 1 .. most + 1 groups are
allocated by dynamic programming on candidate counts estimated from histograms of all
fingerprints, and the cheapest plan is taken.  Every distinct fingerprint is filed under its
value of each group with T_i >= 0 and probes the values within T_i of it; what meets in a bucket
is verified by the number of differing bits.

A bucket gives a spanning forest of its verified links, never its pairs.  A bucket of more than
CHUNK members is cut into chunks, each pair of chunks being a bucket of its own, so that no task
holds an unbounded group and no link is lost.  Components are found over links of distinct
fingerprints.

Defined results: null, empty and word-less texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; equal texts share a fingerprint; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, runs, text_slices, texts_of, work_table
from .components import connected_components

BITS = 64
SEED = 42
CHUNK = 8192
#: Bits of a group whose joint distribution is counted; further bits are taken as independent.
SEEN_BITS = 12
#: Cost of one filed or probing row, in verified candidate pairs.
ROW_COST = 100.0
BLOCK_ROWS = 1 << 18
BLOCK_PAIRS = 1 << 21


def fingerprint(text: str, width: int = 4) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the shingles of ``width`` words."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, only ASCII white space separates
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[min(width, len(words)) - 1 :]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """The key and ``fp``, the fingerprint as a signed long."""
    kind = dict(docs.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            fp = np.array([fingerprint(t, width) for t in texts_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fp)], [key, "fp"])

    return map_texts(docs, kernel, f"`{key}` {kind}, fp long", key, text)


@dataclass(frozen=True)
class Plan:
    """Groups of bits, and the threshold of each (-1: not used)."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def grouped(correlation: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size; bits that vary together meet in a group."""
    sizes = [BITS // m + (i < BITS % m) for i in range(m)]
    left, out = set(range(BITS)), []
    for size in sizes:
        strength = {b: sum(correlation[b, c] for c in left if c != b) for b in left}
        group = [max(sorted(left), key=lambda b: strength[b])]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: sum(correlation[b, c] for c in group))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def extract(fp: np.ndarray, bits: list[int] | tuple[int, ...]) -> np.ndarray:
    """The values of a group of bits, packed."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def within(counts: np.ndarray, same: np.ndarray, most: int) -> list[float]:
    """Estimated ordered pairs at distance 0, up to 1, .. up to ``most`` on a group of bits.

    ``counts``: members by their value of the first bits; ``same``: for each further bit the
    share of pairs that agree on it.
    """
    spectrum = counts.astype(float)
    step = 1
    while step < len(spectrum):
        x = spectrum.reshape(-1, 2, step)
        spectrum = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], 1).reshape(-1)
        step *= 2
    pairs = spectrum**2
    step = 1
    while step < len(pairs):
        x = pairs.reshape(-1, 2, step)
        pairs = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], 1).reshape(-1)
        step *= 2
    by_distance = np.bincount(np.bitwise_count(np.arange(len(pairs), dtype=np.uint64)), weights=pairs / len(pairs))
    for p in same:
        by_distance = np.append(by_distance * p, 0) + np.append(0, by_distance * (1 - p))
    return np.cumsum(np.append(by_distance, np.zeros(most + 1))[: most + 1]).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds (-1 is free) with this sum and the least summed cost, by dynamic programming."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                new = (cost + (row[t] if t >= 0 else 0.0), (*chosen, t))
                if used + t not in after or new < after[used + t]:
                    after[used + t] = new
        best = after
    return best[total]


def make_plan(fps: DataFrame, most: int) -> Plan:
    """Statistics over all rows of ``fps``; what reaches the driver has a fixed size for each task or less."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            x = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
            for at in range(0, len(x), 1 << 20):
                total += x[at : at + (1 << 20)].T @ x[at : at + (1 << 20)]
        row, col = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(row.reshape(-1)), pa.array(col.reshape(-1)), pa.array(total.reshape(-1))], ["i", "j", "n"])

    sums = np.zeros((BITS + 1, BITS + 1))
    for r in fps.select("fp").mapInArrow(moments, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        sums[r.i, r.j] = r.n
    n = max(1.0, sums[BITS, BITS])
    mean = sums[BITS, :BITS] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    correlation = np.abs((sums[:BITS, :BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread))
    cuts = {m: grouped(correlation, m) for m in range(1, most + 2)}
    listed = [(m, i, g) for m, groups in cuts.items() for i, g in enumerate(groups)]

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(listed), 1 << SEEN_BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, (_, _, g) in enumerate(listed):
                counts[k] += np.bincount(extract(fp, g[:SEEN_BITS]).astype(np.int64), minlength=1 << SEEN_BITS)
        k, v = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(counts[k, v])], ["k", "v", "n"])

    counts = np.zeros((len(listed), 1 << SEEN_BITS), np.int64)
    for r in fps.select("fp").mapInArrow(histograms, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        counts[r.k, r.v] = r.n
    agree = mean**2 + (1 - mean) ** 2
    plans = []
    for m, groups in cuts.items():
        costs = []
        for g, c in zip(groups, (counts[k] for k, x in enumerate(listed) if x[0] == m), strict=True):
            pairs = within(c, agree[g[SEEN_BITS:]], most)
            rows = [n * sum(comb(len(g), d) for d in range(t + 1)) for t in range(most + 1)]
            costs.append([ROW_COST * r + p for r, p in zip(rows, pairs, strict=True)])
        cost, thresholds = allocate(costs, most - m + 1)
        plans.append(Plan(tuple(map(tuple, groups)), thresholds, cost))
    return min(plans, key=lambda p: p.cost)


def signatures(fps: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, fp, probe): under which values of which groups a fingerprint is filed, and which it probes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, (g, t) in enumerate(zip(plan.groups, plan.thresholds, strict=True)):
                for d in range(t + 1):
                    value = extract(fp, g)
                    for flip in combinations(range(len(g)), d):
                        mask = np.uint64(sum(1 << i for i in flip))
                        size = len(fp)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(size, part, np.int32)), pa.array((value ^ mask).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(size, d > 0))],
                            ["part", "value", "fp", "probe"],
                        )

    return fps.select("fp").mapInArrow(kernel, "part int, value long, fp long, probe boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (stars) of the graph with these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    has = label != np.arange(len(nodes))
    return nodes[has], nodes[label[has]]


def verified(fp: np.ndarray, probe: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links inside consecutive buckets of these sizes, as spanning forests of bounded blocks.

    Two probes of a bucket are not compared: one of them is filed where the other probes.
    """
    starts = np.cumsum(sizes) - sizes
    after = np.repeat(starts + sizes, sizes) - np.arange(len(fp)) - 1  # members behind each in its bucket
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK_PAIRS, "right")) - 1)
        row, offset = runs(after[at:to])
        left = row + at
        right = left + 1 + offset
        ok = (np.bitwise_count(fp[left] ^ fp[right]) <= most) & ~(probe[left] & probe[right]) & (fp[left] != fp[right])
        if ok.any():
            yield forest(fp[left[ok]], fp[right[ok]])
        at = to


def links(spark: SparkSession, fps: DataFrame, plan: Plan, most: int) -> DataFrame:
    """(a, b): links that span each bucket's components."""
    rows = signatures(fps, plan)
    hot = work_table(spark, rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK), "hot-buckets")
    cut = rows.join(hot, ["part", "value"], "left").withColumn("g", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    # A chunk meets each chunk, itself included, in a cell of its own.
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("chunk", chunk)
    cells = cut.select("part", "value", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "fp", "probe")
    dealt = cells.repartition("part", "value", "x", "y").sortWithinPartitions("part", "value", "x", "y", "fp")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            ids = [t.column(c).to_numpy() for c in ("part", "value", "x", "y")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], 0)) + 1
            end = t.num_rows if final else int(change[-1]) if len(change) else 0  # the last bucket may go on
            if end < t.num_rows:
                held.extend(t.slice(end).to_batches())
            if end:
                edges = np.concatenate([[0], change[change < end], [end]])
                fp, probe = t.column("fp").to_numpy()[:end].view(np.uint64), t.column("probe").to_numpy(zero_copy_only=False)[:end]
                for a, b in verified(fp, probe, np.diff(edges), most):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from flush(False)
                rows = 0
        if held:
            yield from flush(True)

    return dealt.mapInArrow(kernel, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, most: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, ``fp`` and ``component_id``, the smallest key reachable."""
    marked = work_table(spark, fingerprints(docs, key, text, width), "fingerprints")
    distinct = work_table(spark, marked.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    plan = make_plan(distinct, most)
    roots = work_table(spark, connected_components(spark, links(spark, distinct, plan, most)), "roots")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = work_table(spark, member.select("fp", "root").join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(of_fp, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key names its component in ``found``, the result of near_duplicates.

    Of rows that repeat such a key, the first in order of the other columns stays.  Rows
    without a key cannot be named and stay.
    """
    kept = found.groupBy(key).agg(F.count(F.lit(1)).alias("_graphspark_n"), F.max(F.col(key) == F.col("component_id")).alias("_graphspark_k")).filter("_graphspark_k").select(key, "_graphspark_n")
    chosen = docs.join(kept, key)
    alone = chosen.filter("_graphspark_n = 1").select(docs.columns)
    order = [F.col(c).asc_nulls_first() for c in docs.columns if c != key]
    first = chosen.filter("_graphspark_n > 1").withColumn("_graphspark_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_graphspark_at = 1").select(docs.columns)
    return alone.unionByName(first).unionByName(docs.filter(F.col(key).isNull()))


def one_near_copy(spark: SparkSession, docs: DataFrame, most: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows whose texts are in one component of near copies, one stays: that of the smallest key, null last.

    Decided by the texts alone, so rows that repeat a key with other texts are apart.  Of rows
    with the same key the first in order of the other columns stays.  Equal texts are reduced
    to one row before they meet, and components likewise, in part before each shuffle.
    """
    same, row = "_graphspark_text", F.struct(*docs.columns)
    others = [F.col(c) for c in docs.columns if c not in (key, text)]

    def first(df: DataFrame, by: str) -> DataFrame:
        order = F.struct(F.col(key).isNull(), F.col(key), *others, F.col(same))
        return df.groupBy(by).agg(F.min_by(F.struct(row.alias("row"), F.col(same).alias("same")), order).alias("_graphspark_first"))

    hashed = docs.withColumn(same, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    texts = work_table(spark, first(hashed, same).select("_graphspark_first.row.*", same), "distinct-texts")
    found = near_duplicates(spark, texts, most, width, same, text).select(same, F.col("component_id").alias("_graphspark_component"))
    return first(texts.join(found, same), "_graphspark_component").select("_graphspark_first.row.*")


def as_hex(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
