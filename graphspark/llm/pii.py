"""Personal data by fixed patterns and a linear-chain conditional random field.

The base kinds (email, ip, card, phone) are found by pattern and check.  The field reads every
token of every text.  Its features are the shape of a token, its case and character pattern, its
length, its first letters, whether white space stands before it, words that announce something
(a closed list), all of these for two neighbours on either side, and pairs of shape classes.  It
is trained from a small labelled table and decoded by Viterbi over padded numpy batches.  A chain
ends at a line break, before a capitalised word behind a full stop, and, from CHAIN tokens on,
between two plain words.  A found span grows to the end of the run of glued letters and digits
it stands in.  Its spans are added where no base span stands, as kinds of their own
(likely_email, .., national_id, secret), so base results never change.

Defined results: null counts as the empty text, without spans; repeated rows and repeated or
null keys are judged each; other columns, whatever their names, are ignored (``redact`` keeps
them); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, runs, text_slices, texts_of
from .pii_examples import labelled

BASE = ("email", "ip", "card", "phone")
ADDED = ("likely_email", "likely_ip", "likely_card", "likely_phone", "national_id", "secret")
KINDS = (*BASE, *ADDED)
TAGS = ("", "email", "ip", "card", "phone", "national_id", "secret")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A leftmost match always starts where a run of digits does, so other starts are not tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: White space and the token behind it, so that the tokens of a text cover it up to trailing space.
TOKEN = re.compile(r"\s*(?:[^\W_]+|[^\w\s]|_+)")
OFFSETS = (-2, -1, 0, 1, 2)
CELLS = 1 << 16
CHAIN = 64
MEMO = 1 << 18
#: An added span of a kind holds this many digits at least, a secret this many characters.
DIGITS = {"phone": 7, "national_id": 6}
SECRET = 6
GLUE = frozenset("-_./+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- tokens --------------------------------------------------------------------------------

#: Words that announce personal data.
CUES = frozenset("token tokens password passwd pwd pass passphrase secret key apikey api auth bearer credential credentials tel call phone mobile fax card visa mail email contact host ip addr address server ssn dni nino social security tax id insurance".split())
#: First letters of keys that their makers mark.
HEADS = frozenset(("AKIA", "ASIA", "AIza", "eyJh"))
#: Letters alone up to this length are described by pattern and length only.
SHORT = 12
VOWELS = "aeiouy"
HEX = "0123456789abcdef"
SIGNS = ".,:;@/\\-_=+()\"'#$%&*<>[]{}|~!?^`"
CLASSES = 64


@cache
def coarse(core: str) -> int:
    """Shape class of a token, below CLASSES; 0 is the edge of a chain."""
    if not core[0].isalnum():
        return 2 + SIGNS.index(core[0]) if core[0] in SIGNS else 1
    first = 2 + len(SIGNS)
    n = len(core)
    if core.isdigit():
        return first + (n - 1 if n < 5 else 4 if n < 9 else 5 if n < 12 else 6)
    if core.lower() in CUES:
        return first + 7
    if any(c.isdigit() for c in core):
        return first + (8 if n < 4 else 9 if n < 9 else 10 if n < 16 else 11)
    if core.islower():
        return first + (12 if n < 16 else 13)
    if core.isupper():
        return first + (14 if n < 5 else 15)
    return first + (16 if core[1:].islower() else 17)


def pattern(core: str) -> str:
    """Kinds of characters in order, equal neighbours as one, cut at eight."""
    out = ""
    for c in core[:24]:
        kind = "9" if c.isdigit() else "A" if c.isupper() else "a"
        if not out or out[-1] != kind:
            out += kind
    return out[:8]


def features(token: str) -> list[str]:
    """Names of a token's features; a closed set of shapes, lengths, patterns and announcing words."""
    core = token.lstrip()
    spaced = "s" if len(core) < len(token) else "g"
    out = ["bias", f"spaced {spaced}", f"class {coarse(core)}", f"class {coarse(core)} {spaced}"]
    if not core[0].isalnum():
        return [*out, f"sign {core[0]}"]
    low, n = core.lower(), len(core)
    if low in CUES:
        return [*out, f"cue {low}"]
    out += [f"pattern {pattern(core)}", f"length {min(n, 48) if core.isdigit() or n > 12 else n // 4}"]
    if n <= SHORT and core.isalpha():
        return out
    out.append(f"digits {min(sum(c.isdigit() for c in core), 24)}")
    if not core.isdigit():
        vowels = sum(map(low.count, VOWELS))
        hexed = not low.strip(HEX)
        out += [f"vowels {4 * vowels // n}", f"hex {hexed} {min(n // 8, 6)}", f"last {pattern(core[-2:])}"]
        if n >= 16 or "A" in pattern(core)[1:]:
            out.append(f"head {pattern(core[:4])} {core[:4] if core[:4] in HEADS else ''}")
    return out


@dataclass(frozen=True)
class Field:
    """Weights: of token features by place and tag, of pairs of shape classes, of neighbouring tags (the last row is the start)."""

    names: dict[str, int]
    token: np.ndarray  # offsets x (features + 1) x tags; the last feature is that of unknown ones and edges
    pair: np.ndarray  # 3 x CLASSES**2 x tags: with the token before, with that behind, of both neighbours
    step: np.ndarray  # (tags + 1) x tags


class Table:
    """The kinds of tokens met so far: tokens with the same features and flags are one; number 0 is the edge of a chain."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.features: list[list[str]] = [[]]
        self.rows: list[tuple[int, bool, bool, bool, bool]] = [(0, False, False, False, False)]

    def add(self, tokens: set[str]) -> None:
        for t in tokens:
            if t in self.number:
                continue
            core = t.lstrip()
            space, n = t[: len(t) - len(core)], len(core)
            line = "\n" in space or "\r" in space
            if n <= SHORT and core.isalpha() and (core.islower() or core.istitle()) and core.lower() not in CUES:
                # Words: what their features are made of, without making them.
                kind = (line, space != "", core.islower(), n)
            else:
                kind = (line, space != "", core)
            found = self.kinds.setdefault(kind, len(self.rows))
            self.number[t] = found
            if found == len(self.rows):
                plain = core.isalpha() and len(core) <= 12 and core.lower() not in CUES
                self.rows.append((coarse(core), line, core in ".!?", space != "" and plain and core[0].isupper() and core[1:].islower(), space != "" and plain))
                self.features.append(features(t))


def cuts(types: np.ndarray, line: np.ndarray, stop: np.ndarray, title: np.ndarray, plain: np.ndarray) -> list[int]:
    """Where the chains of a text begin."""
    breaks = line[types].copy()
    breaks[1:] |= stop[types[:-1]] & title[types[1:]]
    breaks[0] = True
    at = np.flatnonzero(breaks)
    if np.diff(np.append(at, len(types))).max() <= CHAIN:
        return at.tolist()
    loose = plain[types]
    loose[1:] &= loose[:-1].copy()
    loose[0] = False
    ways, out = np.flatnonzero(loose), []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(types)], strict=True):
        while True:
            out.append(a)
            i = int(np.searchsorted(ways, a + CHAIN))
            if i == len(ways) or ways[i] >= b:
                break
            a = int(ways[i])
    return out


# --- the field -----------------------------------------------------------------------------


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of chains with two places of padding on either side, and the chains' lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    x = np.zeros((len(rows), int(lengths.max(initial=0)) + 4), np.int64)
    row, offset = runs(lengths)
    if len(row):
        x[row, offset + 2] = np.concatenate(rows)
    return x, lengths


def emissions(token: np.ndarray, pair: np.ndarray, x: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """``token``: offsets x tokens x tags, the sums of the tokens' features."""
    n = x.shape[1] - 4
    score = token[0][x[:, :n]]
    for k in range(1, len(OFFSETS)):
        score += token[k][x[:, k : k + n]]
    for k, at in enumerate(pairs_of(classes[x])):
        score += pair[k][at]
    return score


def pairs_of(c: np.ndarray) -> list[np.ndarray]:
    n = c.shape[1] - 4
    before, own, behind = c[:, 1 : 1 + n], c[:, 2 : 2 + n], c[:, 3 : 3 + n]
    return [before * CLASSES + own, own * CLASSES + behind, before * CLASSES + behind]


def undecided(score: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which chains may have a best path other than all zeros.

    Against all zeros, a run of other tags gains at each token at most what its best tag scores more
    than 0, and in steps at most the best way in and out, and the best way on for each further
    token.  Where at every token this is below zero, by way in and out as by way on, no run gains.
    """
    k = score.shape[2]
    best = score[:, :, 1].copy()
    for t in range(2, k):
        np.maximum(best, score[:, :, t], out=best)
    best -= score[:, :, 0]
    best[np.arange(score.shape[1]) >= lengths[:, None]] = -np.inf
    still = step[0, 0]
    enter = max((step[0, 1:] - still).max(), (step[k, 1:] - step[k, 0]).max())
    leave, on = max(0.0, (step[1:k, 0] - still).max()), (step[1:k, 1:] - still).max()
    return best.max(1, initial=-np.inf) >= -max(enter + leave, on) - 1e-3


def viterbi(score: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags of each chain; places behind its end are 0."""
    rows, n, k = score.shape
    if not rows:
        return np.zeros((rows, n), np.int8)
    back = np.zeros((rows, n, k), np.int8)
    now = score[:, 0] + step[k]
    for i in range(1, n):
        ways = now[:, :, None] + step[None, :k]
        back[:, i] = ways.argmax(1)
        new = ways.max(1) + score[:, i]
        now = np.where((i < lengths)[:, None], new, now)
    tags = np.zeros((rows, n), np.int8)
    last = now.argmax(1)
    index = np.arange(rows)
    for i in range(n - 1, -1, -1):
        inside = i < lengths
        tags[inside, i] = last[inside]
        if i:
            last = np.where(inside, back[index, i, last], last)
    return tags


def expectations(score: np.ndarray, step_to: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tags of every place, expected steps, and the summed log partition, by forward-backward."""
    rows, n, k = score.shape
    inside = np.arange(n) < lengths[:, None]
    step = step_to[:k]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

    ahead = np.zeros((rows, n, k))
    ahead[:, 0] = score[:, 0] + step_to[k]
    for i in range(1, n):
        ahead[:, i] = np.where(inside[:, i, None], lse(ahead[:, i - 1, :, None] + step, 1) + score[:, i], ahead[:, i - 1])
    total = lse(ahead[:, -1], 1)
    behind = np.zeros((rows, n, k))
    for i in range(n - 2, -1, -1):
        behind[:, i] = np.where(inside[:, i + 1, None], lse(step[None] + (score[:, i + 1] + behind[:, i + 1])[:, None, :], 2), 0)
    tags = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
    steps = np.zeros((k + 1, k))
    steps[k] = tags[:, 0].sum(0)
    for i in range(1, n):
        pair = np.exp(ahead[:, i - 1, :, None] + step + (score[:, i] + behind[:, i])[:, None, :] - total[:, None, None])
        steps[:k] += pair[inside[:, i]].sum(0)
    return tags, steps, float(total.sum())


def tokens_of(text: str) -> tuple[list[str], np.ndarray]:
    """The tokens with the white space before them, and where their letters and signs start and end."""
    found = TOKEN.findall(text)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    size = np.fromiter((len(t.lstrip()) for t in found), np.int64, len(found))
    return found, np.stack([end - size, end], 1)


def train(table: list[tuple[str, list[Span]]], rounds: int = 100, decay: float = 3e-5) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole small table."""
    seen, rows, gold = Table(), [], []
    for text, spans in table:
        words, at = tokens_of(text)
        if not words:
            continue
        y = np.zeros(len(words), np.int64)
        for kind, a, b in spans:
            y[(at[:, 0] >= a) & (at[:, 1] <= b)] = TAGS.index(kind)
        seen.add(set(words))
        rows.append(np.array([seen.number[w] for w in words]))
        gold.append(y)
    names: dict[str, int] = {}
    listed = [[names.setdefault(f, len(names)) for f in x] for x in seen.features]
    listed[0] = [len(names)]
    of, _ = runs(np.array([len(x) for x in listed]))
    flat, size = np.concatenate([np.array(x, np.int64) for x in listed]), len(names) + 1
    classes = np.array([r[0] for r in seen.rows])
    k = len(TAGS)
    want_step, parts = np.zeros((k + 1, k)), []
    by_length = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    for first in range(0, len(rows), -(-len(rows) // 6)):
        own = by_length[first : first + -(-len(rows) // 6)]
        x, lengths = padded([rows[i] for i in own])
        inside = np.arange(x.shape[1] - 4) < lengths[:, None]
        want = np.zeros((*inside.shape, k))
        for i, y in enumerate(gold[j] for j in own):
            want[i, np.arange(len(y)), y] = 1
            want_step[k, y[0]] += 1
            np.add.at(want_step, (y[:-1], y[1:]), 1)
        parts.append((x, lengths, inside, want))
    seen_at = [np.concatenate([x[:, j : j + m.shape[1]][m] for x, _, m, _ in parts]) for j in range(len(OFFSETS))]
    pair_at = [np.concatenate([pairs_of(classes[x])[j][m] for x, _, m, _ in parts]) for j in range(3)]
    weights = [np.zeros((len(OFFSETS), size, k)), np.zeros((3, CLASSES**2, k)), np.zeros((k + 1, k))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for r in range(1, rounds + 1):
        sums = np.stack([np.add.reduceat(w[flat], np.flatnonzero(np.diff(of, prepend=-1))) for w in weights[0]])
        grads = [np.zeros_like(weights[0]), np.zeros_like(weights[1]), -want_step / len(rows)]
        missed = []
        for x, lengths, inside, want in parts:
            tags, steps, _ = expectations(emissions(sums, weights[1], x, classes), weights[2], lengths)
            missed.append((tags - want)[inside] / len(rows))
            grads[2] += steps / len(rows)
        miss = np.concatenate(missed)
        for t in range(k):
            for j in range(len(OFFSETS)):
                by_token = np.bincount(seen_at[j], weights=miss[:, t], minlength=len(listed))
                grads[0][j, :, t] = np.bincount(flat, weights=by_token[of], minlength=size)
            for j in range(3):
                grads[1][j, :, t] = np.bincount(pair_at[j], weights=miss[:, t], minlength=CLASSES**2)
        for w, g, (m1, m2) in zip(weights, grads, moments, strict=True):
            g += decay * w
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g**2 - m2)
            w -= 0.1 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Field(names, *(w.astype(np.float32) for w in weights))


def trained() -> Field:
    return train(labelled())


def grown(text: str, a: int, b: int) -> tuple[int, int]:
    """A span up to the ends of the run of letters, digits and signs between them that it stands in."""
    while b < len(text) and (text[b].isalnum() or (text[b] in GLUE and b + 1 < len(text) and text[b + 1].isalnum())):
        b += 1
    while a > 0 and (text[a - 1].isalnum() or (text[a - 1] in GLUE and a > 1 and text[a - 2].isalnum())):
        a -= 1
    return a, b


def checked(text: str, tag: str, a: int, b: int) -> list[Span]:
    """The span as an added one, if it holds what its kind must; secrets are cut at white space."""
    part = text[a:b]
    if tag == "secret":
        return [("secret", a + m.start(), a + m.end()) for m in re.finditer(r"\S+", part) if len(m[0]) >= SECRET]
    digits, letters = sum(c.isdigit() for c in part), any(c.isalpha() for c in part)
    if tag == "email":
        fine = "@" in part
    elif tag == "ip":
        fine = digits >= 4 and part.count(".") >= 3
    elif tag == "card":
        fine = digits >= 12 and not letters and luhn("".join(c for c in part if c in "0123456789"))
    else:
        fine = digits >= DIGITS[tag] and (tag == "national_id" or not letters)
    return [(tag if tag in ADDED else f"likely_{tag}", a, b)] if fine else []


class Finder:
    """Finds the spans of batches of texts."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.table = Table()
        self.known = 0
        self.token = np.zeros((len(OFFSETS), 0, len(TAGS)), np.float32)

    def learn(self, tokens: set[str]) -> None:
        """Adds the weights of tokens met for the first time."""
        if len(self.table.number) + len(tokens) > MEMO:
            self.clear()
        self.table.add(tokens)
        if len(self.table.rows) > self.known:
            other = self.field.token.shape[1] - 1
            listed = [[self.field.names.get(f, other) for f in x] or [other] for x in self.table.features[self.known :]]
            sizes = np.array([len(x) for x in listed])
            flat = np.concatenate([np.array(x) for x in listed])
            new = np.stack([np.add.reduceat(w[flat], np.cumsum(sizes) - sizes) for w in self.field.token])
            self.token = np.concatenate([self.token, new], 1)
            self.known = len(self.table.rows)
            columns = list(zip(*self.table.rows, strict=True))
            self.classes, self.flags = np.array(columns[0]), [np.array(c) for c in columns[1:]]

    def added(self, texts: list[str]) -> list[list[Span]]:
        """What the field finds in each text."""
        out: list[list[Span]] = [[] for _ in texts]
        found = [TOKEN.findall(t) for t in texts]
        self.learn(set().union(*found))
        number = self.table.number.__getitem__
        jobs: list[tuple] = []
        ends: dict[int, np.ndarray] = {}
        for i, words in enumerate(found):
            types = np.fromiter(map(number, words), np.int64, len(words))
            if len(types):
                at = cuts(types, *self.flags)
                jobs += [(b - a, i, a, types[a:b]) for a, b in zip(at, [*at[1:], len(types)], strict=True)]
        jobs.sort(key=lambda j: j[0])
        at = 0
        while at < len(jobs):
            to = at + 1
            while to < len(jobs) and (to + 1 - at) * jobs[to][0] <= CELLS:
                to += 1
            x, lengths = padded([j[3] for j in jobs[at:to]])
            score = emissions(self.token, self.field.pair, x, self.classes)
            open_ = np.flatnonzero(undecided(score, self.field.step, lengths))
            tags = viterbi(score[open_], self.field.step, lengths[open_])
            for r in np.flatnonzero(tags.any(1)).tolist():
                n, i, first, _ = jobs[at + int(open_[r])]
                y = tags[r, :n]
                if i not in ends:
                    ends[i] = np.cumsum(np.fromiter(map(len, found[i]), np.int64, len(found[i])))
                edges = np.flatnonzero(np.diff(y)) + 1
                for s, e in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
                    if y[s]:
                        a, b = int(ends[i][first + s]) - len(found[i][first + s].lstrip()), int(ends[i][first + e - 1])
                        a, b = grown(texts[i], a, b)
                        out[i] += checked(texts[i], TAGS[y[s]], a, b)
            at = to
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Base spans by kind and start, then the added ones, also by kind and start."""
        out = []
        for text, more in zip(texts, self.added(texts), strict=True):
            base = base_spans(text)
            free: list[Span] = []
            for s in sorted(more, key=lambda s: (s[1], -s[2])):
                if not any(s[1] < b and a < s[2] for _, a, b in base) and not (free and s[1] < free[-1][2]):
                    free.append(s)
            out.append(base + sorted(free, key=lambda s: (ADDED.index(s[0]), s[1])))
        return out


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``spans``: kind, start and end (exclusive) in code points."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in text_slices(batches, text):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in finder.spans(texts_of(batch, text))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(kind))], [key, "spans"])

    return map_texts(docs, kernel, f"`{key}` {dict(docs.dtypes)[key]}, spans {SPANS}", key, text)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; spans that meet are replaced as one."""
    joined: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in joined:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` masked; null texts stay null, other columns stay as they are."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in text_slices(batches, text):
            texts = texts_of(batch, text)
            new = [masked(t, s) if s else t for t, s in zip(texts, finder.spans(texts), strict=True)]
            clean = pa.array(new, batch.column(text).type, mask=np.asarray(batch.column(text).is_null()))
            yield batch.set_column(batch.schema.get_field_index(text), text, clean)

    return docs.mapInArrow(kernel, docs.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def listed(kinds: tuple[str, ...] | None):
        chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans")
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return found.select(key, *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(None).alias("spans"))
