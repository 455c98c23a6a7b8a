"""A small labelled table of sentences with personal data, made by rule from a fixed seed.

Marked parts are written [[kind:text]].
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable

# Sentence frames; {x} is filled by a generator below, {w} by a plain word, {p} by some.
FRAMES = (
    "{p} {email} {p}",
    "{p} write to {email}, {p}.",
    "{p} | {email} | {w}",
    "mail: {email}",
    "{w}: <{email}> {p}",
    "{p} {ip} {p}",
    "{w} host {ip}: {w}",
    "{ip} {p}",
    "{p}, {w} {card} {p}",
    "card {card}.",
    "{p} card number: {card}, {p}",
    "{card} {ip} {w}",
    "{p} {phone} {p}",
    "tel. {phone} {w}",
    "{p} call {phone}, {p}",
    "phone: {phone}",
    "{p} ({phone}) {w}",
    "{p} token = \"{secret}\" {p}",
    "{p} token={secret}",
    "{p} token={secret} {p}",
    "{w} api_key: {secret}",
    "API_KEY={secret}",
    "export {W}_TOKEN={secret}",
    "\"api_key\": \"{secret}\", \"{w}\": {small}",
    "auth: bearer {secret} {p}",
    "{p} {key} {p}",
    "{key}",
    "key {key}, {p}",
    "password = \"{secret}\" {w}",
    "{p} password: {pw} {p}",
    "password: {pw}",
    "{p} pwd={pw} {p}",
    "{w} password is {pw}, {p}",
    "passwd={pw}",
    "{w}:{w} password=\"{pw}\"",
    "{p} {natid} {p}",
    "{w} {natid}, {p}",
    "{p} id {natid} {w}",
    "NINO: {natid}",
    "SSN {natid}",
    "{p} SSN: {natid}, {p}",
    "{w} social security {natid}.",
    "DNI {natid} {p}",
    "{w} tax id {natid} {p}",
    # Nothing personal.
    "{p} {year} {p}",
    "{p} {small} {p} {small} {w}.",
    "{p} {decimal} {p}",
    "{p}, {w} {version} {p}",
    "{w} on {day} {p}",
    "{w} ({year}), {w} {small}.",
    "{p} costs ${decimal} {w}",
    "{w} chapter {small}: {p}",
    "{w} @ {p}",
    "{w}{small}{w} {p}",
    "{p} {big} {w}",
    "{w} \"{w}\" = {small} {w}",
    "{w}### {w}*** {w}&&& {w}$$$ {small} {w}%%%",
    "{w}*** token = \"{secret}\"### {w}&&& {w}%%% {w}***",
    "{w}### {w}*** {phone}&&& {w}### {w}%%%",
    "{p} {time} {p} {time}",
    "{p} {year}-{year} {p}, {small}-{small} {w}",
    "{p} {url} {p}",
    "see {url}",
    "{p} {file} {p} {file}",
    "{p} {uuid} {p}",
    "the password {p} and the token {p}",
    "a secret {p}, the key {p}.",
    "password {w} {p}",
    "{w}: {p}, key: {w} {p}",
    "{W} {W} {p}. {W} {p} {W}-{w} {p}!",
    "{p}; {p} - {p} / {p}? {W}",
    "{w}={small}; {w} += {w}[{small}] // {p}",
    "def {w}({w}, {w}={small}): return {w}.{w}({w})",
    "{w}_{w} = {w}.{w}.{w}({small}, '{w}')",
    "{p} {long} {p} {long}",
    "{p} https {w} id {small} {p}",
    "{W}{W}{w} {p} {w}{W} {p}",
    "{p} {year}/{small} {p} no. {small}{w} {p}",
    "{big} {big} {big} {p} {small} x {small}",
    "{U}!! {U}!! {U}, {U}!! {U}!! {U}",
    "{U} {U} {U}. {U}! {U} {U}, {U}",
    "{W}!! {w}!! {w}!! {w}? {w}...",
    "{p} {day} {p} {small}. {W} {year} {p}",
    "{p} {small} {small} {small} {p} {year} {year}",
    "{w} --{w} {small} -{w} --{w}={w} {w}",
    "{w} -{w} --api-key {secret} -{w} {file}",
    "{p}\n{p}",
    "{p} {p} {p}",
)
# Surroundings in which any of the kinds may stand; {x} is the kind's place.
PLACES = ("{p} ({x}) {w}", "{p}, {x}, {p}", "{W} {x}; {p}", "{w}: {x}\n{p}", "{p} \"{x}\" {w}", "{x}", "{w}={x}", "{p} {w} {x} {w} {year}", "{p}. {x}. {W} {p}")
FRAMES += tuple(place.replace("{x}", "{" + kind + "}") for kind in ("email", "ip", "card", "phone", "natid", "key") for place in PLACES)
# The same surroundings, and numbers that are nobody's.
FRAMES += tuple(place.replace("{x}", "{" + kind + "}") for kind in ("day", "version", "decimal", "file", "long", "row") for place in PLACES)
MARKED = re.compile(r"\[\[(\w+):([^\]]*)\]\]")
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices(string.digits, k=n))


def _word(r: random.Random) -> str:
    w = "".join(r.choices("etaoinshrdlucmfwypvbgkéèüñó", k=r.randint(1, 12)))
    return r.choice((w, w, w, w, w.capitalize(), w + ",", w + "."))


def _card(r: random.Random) -> str:
    """Sixteen digits that pass the check, in one piece or in fours."""
    body = _digits(r, 15)
    total = sum(sum(divmod(int(c) * (1 + (i + 1) % 2), 10)) for i, c in enumerate(reversed(body)))
    whole = body + str(-total % 10)
    sign = r.choice(("", "", "-", " ", ".", "/"))
    return sign.join(whole[i : i + 4] for i in range(0, 16, 4))


def _bare(r: random.Random) -> str:
    return _word(r).strip(".,").lower()


def _secret(r: random.Random) -> str:
    letters = r.choice(("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", LOWER + string.digits))
    return r.choice(letters[:10]) + "".join(r.choices(letters, k=r.choice((15, 19, 23, 31, 39)))) + r.choice(letters[:10])


def _key(r: random.Random) -> str:
    """Keys that are told by themselves: a known head, or much mixed text."""
    mixed = string.ascii_letters + string.digits
    return r.choice(
        (
            lambda: "AKIA" + "".join(r.choices(UPPER + string.digits, k=16)),
            lambda: r.choice(("ghp_", "gho_", "glpat-", "npm_")) + "".join(r.choices(mixed, k=r.choice((20, 36)))),
            lambda: r.choice(("sk-", "sk_live_", "pk_live_", "rk-")) + "".join(r.choices(mixed, k=r.choice((24, 32, 48)))),
            lambda: "xoxb-" + _digits(r, 11) + "-" + "".join(r.choices(mixed, k=24)),
            lambda: "".join(r.choices(mixed, k=40)),
        )
    )()


def _password(r: random.Random) -> str:
    w = "".join(_bare(r) for _ in range(3))[:14].ljust(6, "k")
    return r.choice((w, w + _digits(r, 2), w.capitalize() + "!" + _digits(r, 1), "".join(r.choices(string.ascii_letters + string.digits, k=r.randint(8, 14)))))


def _national(r: random.Random) -> str:
    return r.choice(
        (
            lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
            lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
            lambda: f"{''.join(r.choices(UPPER, k=2))} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {r.choice('ABCD')}",
            lambda: _digits(r, 8) + r.choice(UPPER),
            lambda: f"{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}",
        )
    )()


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"{r.choice(('+1 ', '+49 ', '', ''))}({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}"))


def _fill(r: random.Random, kind: str) -> str:
    small = str(r.randint(0, 999))
    made: dict[str, Callable[[], str]] = {
        "w": lambda: _word(r),
        "W": lambda: _bare(r).capitalize(),
        "U": lambda: _bare(r).upper() or "A",
        "p": lambda: " ".join(_word(r) for _ in range(r.randint(1, 9))),
        "email": lambda: f"[[email:{_bare(r)}{r.choice(('', '.', '_', '-'))}{r.choice(('', small, _bare(r)))}@{r.choice(('mail', 'post', 'corp', _bare(r)))}{r.choice(('', small))}.{r.choice(('example', 'site', 'co'))}.{r.choice(('com', 'org', 'de'))}]]",
        "ip": lambda: f"[[ip:{'.'.join(str(r.randint(0, 255)) for _ in range(4))}]]",
        "card": lambda: f"[[card:{_card(r)}]]",
        "phone": lambda: f"[[phone:{_phone(r)}]]",
        "secret": lambda: f"[[secret:{_secret(r)}]]",
        "key": lambda: f"[[secret:{_key(r)}]]",
        "pw": lambda: f"[[secret:{_password(r)}]]",
        "natid": lambda: f"[[national_id:{_national(r)}]]",
        "year": lambda: str(r.randint(1700, 2050)),
        "small": lambda: small,
        "decimal": lambda: f"{r.randint(0, 9999)}.{r.randint(0, 99)}",
        "version": lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        "day": lambda: f"{r.randint(1900, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        "time": lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
        "big": lambda: f"{r.randint(1, 999)},{r.randint(0, 999):03d}",
        "row": lambda: _digits(r, r.randint(9, 20)),
        "long": lambda: "".join(_bare(r) for _ in range(3)),
        "url": lambda: f"https://{r.choice(('www.', ''))}{_bare(r)}.{r.choice(('com', 'org'))}/{_bare(r)}/{_bare(r)}-{small}{r.choice(('', '.html', '?id=' + small))}",
        "file": lambda: f"{_bare(r)}{r.choice(('_', '-', ''))}{small}.{r.choice(('png', 'txt', 'csv', 'py'))}",
        "uuid": lambda: "-".join("".join(r.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
    }
    return made[kind]()


def labelled(rows: int = 2200, seed: int = 7, frames: tuple[str, ...] = FRAMES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) rows."""
    r, out = random.Random(seed), []
    for i in range(rows):
        marked = re.sub(r"\{(\w+)\}", lambda m: _fill(r, m[1]), frames[i % len(frames)])
        text, spans, at = "", [], 0
        for m in MARKED.finditer(marked):
            text += marked[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + marked[at:], spans))
    return out
