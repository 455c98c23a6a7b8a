"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is an ascending array of the k smallest distinct 64-bit hashes of the word shingles of
a text.  Sketches of parts merge into the sketch of their union, and two sketches estimate
resemblance, containment and the number of distinct shingles.

A word is a run of characters other than ASCII white space, lower-cased; a shingle is ``width``
words; a text of fewer words, but not none, is one shingle.

Defined results: null counts as the empty text, whose sketch is empty; two empty sketches have
likeness 1, an empty and another 0; repeated rows have equal sketches; rows with one key follow
each other in order of their texts, rows without a key come first; other columns are ignored;
an empty table gives an empty table; a table of one row is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import key_bounds, range_of

SIZE = 128
WIDTH = 5


def with_sketch(df: DataFrame, text: str, out: str, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """``df`` with the bottom-k sketch of a text column.

    Words are hashed once, in a projection of their own that the optimizer keeps apart because
    it is used several times; a shingle is the hash of its words' hashes.
    """
    words = F.filter(F.split(F.lower(text), "[ \t-\r]+"), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    return hashed.withColumn(out, bottom(shingles(F.col("_words"), width), k)).drop("_words")


def shingles(hashed: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes; of all of them where there are fewer."""
    n = F.size(hashed)
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.aggregate(hashed, F.lit(42).cast("bigint"), lambda a, h: F.xxhash64(a, h))))
    # The word hash at i is passed on by position: the array without its last words, zipped with
    # the arrays that begin one, two, .. words later.
    rows = F.transform(F.slice(hashed, F.lit(1), F.greatest(n - (width - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashed, i + d) for d in range(1, width)]))
    return F.when(n < width, whole).otherwise(rows)


def bottom(hashes: Column, k: int = SIZE) -> Column:
    """The k smallest distinct values, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, by: list[str], column: str = "sketch", k: int = SIZE) -> DataFrame:
    """Sketches of groups of parts: the k smallest distinct hashes of each group.

    The hashes of a group are distinct after partial aggregation; a group is cut into salted
    parts first, whose sketches are then merged, so a hot group is never in one task as a whole.
    """
    salted = df.select(*by, F.pmod(F.hash(column), F.lit(64)).alias("_salt"), F.explode(column).alias("_h")).distinct()
    part = salted.groupBy(*by, "_salt").agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias("_part"))
    return part.groupBy(*by).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_part")))), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of common shingles among all of two texts (0 to 1)."""

    def of(both: Column) -> Column:
        common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))

    # The union is bound to a name, so that it is made once.
    return F.element_at(F.transform(F.array(merge(a, b, k)), of), 1)


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    union = distinct_shingles(merge(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / own))


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(df: DataFrame, key: str, columns: list[str], rows: int = 4096) -> DataFrame:
    """``df`` with ``next_<column>``: the values of the next row by key; the first row follows the last.

    The table is cut into key ranges, each a window partition of its own.  The first rows of a
    range are also sent to the range before it, as a guest behind its last row, and those of the
    first range to the last.
    """
    bounds = key_bounds(df, key, rows)
    held = df.withColumn("_range", range_of(key, bounds).cast("int"))
    # One row a range reaches the driver: its smallest key.
    firsts = sorted((r["_range"], r["low"], r["nulls"]) for r in held.groupBy("_range").agg(F.min(key).alias("low"), F.max(F.col(key).isNull()).alias("nulls")).collect())
    held = held.withColumn("_guest", F.lit(0))
    if firsts:
        # Of a first key's rows one is enough: the first in order, found by a small aggregate.
        first = F.lit(False)
        for _, low, nulls in firsts[:1]:
            first = F.col(key).isNull() if nulls else F.col(key) == low
        if len(firsts) > 1:
            first = first | F.col(key).isin([low for _, low, _ in firsts[1:]])
        before = {r: firsts[i - 1][0] for i, (r, _, _) in enumerate(firsts)}
        target = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_range"))
        places = F.when(first, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")), F.struct(target.alias("r"), F.lit(1).alias("g")))).otherwise(
            F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")))
        )
        held = held.withColumn("_place", F.explode(places)).withColumn("_range", F.col("_place.r")).withColumn("_guest", F.col("_place.g")).drop("_place")
    order = Window.partitionBy("_range").orderBy("_guest", F.col(key).asc_nulls_first(), *columns)
    for c in columns:
        held = held.withColumn(f"next_{c}", F.lead(c).over(order))
    return held


def likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Sketches of every text and of its edited text, and how alike they are.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all)
    of the next document's text.
    """
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    held = with_next(own, key, ["t"]).withColumn("n_chars", F.length("t").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_t", F.lit(1), half))
    held = with_sketch(held, "t", "fp", k, width)
    order = Window.partitionBy("_range").orderBy("_guest", F.col(key).asc_nulls_first(), "t")
    held = held.withColumn("next_fp", F.lead("fp").over(order)).filter("_guest = 0").withColumn("edited", edited)
    held = with_sketch(held, "edited", "edited_fp", k, width)
    return held.select(key, "n_chars", "edited", "fp", "edited_fp", resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
