"""Text functions of the lexical index, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query does not search for.
STOP_WORDS = (
    "a about all an and any are be been being but can could did do does for from had has have here how in into is its "
    "may might must not of off on onto or shall should some that the their them there these they this those to was were "
    "what when where which who whom whose why will with without work working works would"
).split()

# Metadata keys that are not searched.
HIDDEN_META = (
    "confidence evidence rationale hash sourcehash sourcehashes resolved line path size community communitysize "
    "communitygranularity communityhubthreshold communitylabelstatus communitylabeloverlap communitypreviousid "
    "communitydescriptionsource communitydescriptionconfidence communitydescriptionrationale"
).split()

EAST_ASIAN = r"^[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]+$"


def tokens(value: Column) -> Column:
    """Lower-case words; identifiers are cut at case changes; East Asian words add their pairs of characters."""
    parted = F.regexp_replace(value, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    words = F.filter(F.split(F.lower(F.regexp_replace(parted, r"[^\p{L}\p{Nd}]+", " ")), " "), lambda w: w != "")

    def widened(w: Column) -> Column:
        pairs = F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(F.rlike(w, F.lit(EAST_ASIAN)), F.concat(F.array(w), pairs)).otherwise(F.array(w))

    return F.flatten(F.transform(words, widened))


def normalized(value: Column) -> Column:
    return F.array_join(tokens(value), " ")


def query_terms(value: Column) -> Column:
    """Distinct words of two characters or more (or East Asian) that are no stop words, unless none would be left."""
    found = F.filter(F.array_distinct(tokens(value)), lambda w: (F.length(w) >= 2) | F.rlike(w, F.lit(EAST_ASIAN)))
    kept = F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))
    return F.when(F.size(kept) == 0, found).otherwise(kept)


def trigrams(value: Column) -> Column:
    """Distinct runs of three characters; a shorter text is one."""
    n = F.length(value)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(value, i, F.lit(3))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(runs)


def searchable_meta(meta: Column) -> Column:
    """``key value`` pairs by key, without the hidden keys."""
    shown = F.map_filter(meta, lambda k, v: ~F.lower(k).isin(*HIDDEN_META))
    pairs = F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.coalesce(F.array_join(pairs, " "), F.lit(""))


def mixed_case(value: Column) -> Column:
    return F.rlike(value, F.lit(r"[_$]|[\p{Ll}\p{Nd}]\p{Lu}"))


def has_phrase(value: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``value`` as whole words."""
    return F.instr(F.concat(F.lit(" "), value, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0


def token_estimate(value: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(value) + 2) / 3).cast("int")


def safe_text(value: Column, most: int = 400) -> Column:
    """Control characters become spaces, runs of spaces one; beyond ``most`` characters the last that stay are an ellipsis."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, r"\p{Cc}", " "), r"(?U)\s+", " "))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 1), F.lit("…"))).otherwise(plain)


def safe_text_bytes(value: Column, most: int) -> Column:
    """``safe_text`` cut to ``most`` UTF-8 bytes at a character, with an ellipsis of three of them."""
    plain = safe_text(value)
    # Four candidates for the longest prefix: a character has at most four bytes.
    raw, room = F.encode(plain, "UTF-8"), most - 3

    def starts(i: int) -> Column:  # whether a character begins behind i bytes
        byte = F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int")
        return (byte < 0x80) | (byte >= 0xC0)

    cut = F.lit("")
    for i in range(max(0, room - 3), room + 1):
        cut = F.when(starts(i), F.decode(F.substring(raw, 1, i), "UTF-8")).otherwise(cut) if i > 0 else cut
    return F.when(F.octet_length(plain) <= most, plain).otherwise(F.lit("") if room < 0 else F.concat(cut, F.lit("…")))


def compact_id(value: Column) -> Column:
    """The identifier itself, or quoted with escapes where it holds control characters."""
    codes = {chr(n): f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" for n in (*range(0x20), *range(0x7F, 0xA0))}
    codes |= {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    escaped = F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(F.regexp_like(value, F.lit(r"\p{Cc}")), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def quote_field(value: Column) -> Column:
    """``safe_text`` in double quotes, quotes and backslashes escaped."""
    plain = F.replace(F.replace(safe_text(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), plain, F.lit('"'))


TRUNCATED = "\nTRUNCATED\treason=mcp_token_budget\n"


def bound_text(value: Column, budget: int) -> Column:
    """The text in three bytes a token: cut at a character, and at a line's end if one is in the later half, with a mark behind."""
    most = max(0, 3 * budget - len(TRUNCATED))
    cut = F.lit("")
    raw = F.encode(value, "UTF-8")
    for back in range(3, -1, -1):  # the longest of the last four prefixes that ends at a character
        n = most - back
        if n > 0:
            byte = F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int")
            cut = F.when((byte < 0x80) | (byte >= 0xC0), F.decode(F.substring(raw, 1, n), "UTF-8")).otherwise(cut)
    lines = F.substring_index(cut, "\n", -1)
    upto = F.octet_length(cut) - F.octet_length(lines) - 1
    whole = F.when((F.instr(cut, "\n") > 0) & (upto >= F.floor(F.octet_length(cut) / 2)), F.substr(cut, F.lit(1), F.length(cut) - F.length(lines) - 1)).otherwise(cut)
    return F.when(F.octet_length(value) <= 3 * budget, value).otherwise(F.concat(whole, F.lit(TRUNCATED)))


def display_name(kind: Column, name: Column, path: Column, package: Column) -> Column:
    """A file's path, a symbol in its package, or the name."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    owned = kind.isin("function", "method", "type", "struct", "interface")
    return F.when(has(path) & (kind == "file"), path).when(has(package) & owned, F.concat(package, F.lit("."), name)).otherwise(name)


def report_label(kind: Column, name: Column, path: Column, package: Column, symbols: tuple[str, ...]) -> Column:
    """How a report names a node: paths of files and packages, path and name of symbols."""
    has = F.coalesce(path, F.lit("")) != ""
    return F.when(has & kind.isin("file", "package"), path).when(has & kind.isin(*symbols), F.concat(path, F.lit(":"), name)).otherwise(display_name(kind, name, path, package))


def result_label(kind: Column, name: Column, path: Column, line: Column, symbols: tuple[str, ...]) -> Column:
    """How a result names a node: path, line and name of symbols, else the path, else the name."""
    has = F.coalesce(path, F.lit("")) != ""
    return F.when(has & (line > 0) & kind.isin(*symbols), F.concat(path, F.lit(":"), line.cast("string"), F.lit(" "), name)).when(has, path).otherwise(name)


def canonical_path(value: Column) -> Column:
    """A path without scheme, leading dots and slashes."""
    plain = F.trim(F.replace(value, F.lit("\\"), F.lit("/")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "^file://", ""), r"^(\./)+", ""), "^/+", "")


def paths_match(predicted: Column, gold: Column) -> Column:
    """Whether a path is the one looked for, or ends in it."""
    p, g = canonical_path(predicted), canonical_path(gold)
    return (p != "") & (g != "") & ((p == g) | p.endswith(F.concat(F.lit("/"), g)))


def markdown_text(value: Column) -> Column:
    """One line with the signs of Markdown escaped."""
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"\s+", " ")), r"([\\`*_\[\]<>|])", r"\\$1")


def clean_path(value: Column) -> Column:
    """Forward slashes, no leading ``./``, no doubled or trailing slashes."""
    path = F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"/(\./)+|/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"(?<=.)/$", "")


# Folders below which a further folder names the group.
GROUP_ROOTS = ("internal", "pkg", "cmd", "src", "app", "lib", "packages", "testdata")
GROUP_MIDDLES = ("features", "modules", "services", "packages")


def path_group(path: Column, kind: Column) -> Column:
    """The leading folders of a node's path that name its community; a file at the top is in ``root``."""
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^\./", ""), "^/+|/+$", "")
    folder = F.when(kind.isin("dir", "package", "module"), whole).when(F.instr(whole, "/") == 0, F.lit("root")).otherwise(F.regexp_replace(whole, "/[^/]*$", ""))
    parts = F.split(folder, "/")

    def first(n: int) -> Column:
        return F.array_join(F.slice(parts, 1, n), "/")

    group = F.when((F.size(parts) > 2) & F.get(parts, F.lit(1)).isin(*GROUP_MIDDLES), first(3)).when((F.size(parts) > 1) & parts[0].isin(*GROUP_ROOTS), first(2)).otherwise(first(1))
    return F.when(whole.isin("", "."), F.lit("")).otherwise(group)
