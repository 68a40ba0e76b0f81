"""Personal data: fixed base patterns, then candidates judged by boosted trees.

Generators with high recall propose spans that may overlap: all sub-runs of
digit groups in any layout, addresses with spelled-out or spaced signs, runs of
colon groups, dotted quads with bracketed dots.  Boosted trees score each
proposal by its format (groups, signs, checksum) and its context (words around
it, neighbouring characters and groups); those that reach their kind's
calibrated threshold are added, best first, where they overlap no base span and
no better addition.

No table marks personal data, so the trees are trained on examples that
:func:`examples` writes: personal data in layouts drawn at random (numbers of
groups, their lengths, signs between them) that the base patterns miss, and
look-alikes such as dates, versions, prices, order numbers, clock times,
hardware addresses and columns of numbers.  A threshold is the lowest at which,
on examples kept from training, at least ``PRECISION`` of what is selected is
personal data.

Work grows in proportion to the text: base patterns start at the edges of runs
of characters or at their sign, a digit group begins at most nineteen proposals
(it has that many digits), and overlaps are looked up in a map of the text.

Spans are code points, end exclusive.  Defined results: null counts as an empty
text and has no spans; texts of any length are read whole; of proposals that
score alike the first by kind name, then start, goes first; rows that repeat an
id each get their row; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylace.llm.arrow import map_rows
from waylace.llm.boosting import BoostedTrees, fit_boosted
from waylace.llm.spans import Span, Taken, joined

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
#: No threshold is lower than this, however well the kept examples are told apart.
LEAST_THRESHOLD = 0.5
SEED = 11
EXAMPLES = 6_000
_CONTEXT = 32
_MOST_DIGITS = 19

_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_LABELS = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

_SIGN = re.compile(r"\x20?[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]\x20?|\x20(?:at|AT)\x20|\x20@\x20?|@\x20|&#0?64;|_at_|-at-")
_NAME_END = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}$")
_DOT = r"(?:\x20?[(\[{<]\x20?(?:dot|DOT|\.)\x20?[)\]}>]\x20?|\x20(?:dot|DOT)\x20|_dot_|-dot-|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_SPELLED_DOT = re.compile(r"[(\[{<]\x20?(?:dot|\.)|[\x20_-]dot", re.IGNORECASE)
_GROUP = re.compile(r"[0-9]++")
_GAP = re.compile(r"[)]?[\x20\xa0./\u2010\u2011-]{0,3}[(]?")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z]|:[0-9A-Za-z:])")
_QUAD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20\.\x20|\.)[0-9]{1,3}){3}(?![0-9A-Za-z])")
_NOT_BRACKETS = re.compile(r"[^()]+")
_WORDS = re.compile(r"[^\W\d_]+[.#]?")

#: Words that go beside a kind, by kind; fixed values.
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "reach", "kontakt", "correo", "courriel", "schreib"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "client", "gateway", "ping", "router", "connect"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "karte", "kreditkarte", "carte", "tarjeta", "paid", "pay", "charge", "diners"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "dial", "telefon", "whatsapp", "ring", "text", "hotline", "handy", "number", "nummer", "mobil", "appel", "llam", "ll\u00e1m", "ruf", "t\u00e9l", "m\u00f3vil", "sms"),
}
#: Words that go before look-alikes; fixed values.
COUNTER_CUES = ("version", "order", "invoice", "date", "page", "pages", "isbn", "issn", "price", "section", "total", "no.", "id", "time", "year", "line", "ref", "code", "serial", "mac", "sku", "article", "chapter", "rows", "values", "between", "sum", "ticket", "build")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Addresses by their sign: the run of name characters before it and the labels after it."""
    out: list[Span] = []
    at, sign = 0, text.find("@")
    while sign >= 0:
        name = text[at:sign]
        start = at + len(name.rstrip(_NAME))
        host = _LABELS.match(text, sign + 1) if start < sign else None
        if host:
            out.append(("email", start, host.end()))
        at = host.end() if host else sign + 1
        sign = text.find("@", at)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind, then start."""
    out = _emails(text)
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_part_fits(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGITS.sub("", m[0])
            if 16 <= len(digits) <= _MOST_DIGITS and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _number_spans(text: str) -> list[Span]:
    """Every sub-run of consecutive digit groups with the digits of a phone or card number and closed brackets."""
    out: list[Span] = []
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (first, _) in enumerate(groups):
        start = first - (text[first - 1 : first] == "(")
        n = 0
        for j in range(i, len(groups)):
            a, b = groups[j]
            n += b - a
            if n > _MOST_DIGITS or (j > i and not _GAP.fullmatch(text, groups[j - 1][1], a)):
                break
            if n < 7:
                continue
            unclosed = _NOT_BRACKETS.sub("", text[first:b]).replace("()", "")
            if unclosed not in ("", ")") or unclosed and start == first:
                continue
            begin = start if unclosed else first
            if n <= 15:
                out.append(("phone", begin, b))
            if 13 <= n:
                out.append(("card", begin, b))
    return out


def candidates(text: str) -> list[Span]:
    """Proposals of all generators; they may overlap."""
    out: list[Span] = []
    for m in _SIGN.finditer(text):
        host = _HOST.match(text, m.end())
        if host is None or (m[0].strip().lower() == "at" and not _SPELLED_DOT.search(host[0])):
            continue
        name = _NAME_END.search(text, max(0, m.start() - 64), m.start())
        if name is not None:
            out.append(("email", name.start(), host.end()))
    if _DIGITS.search(text):
        out += _number_spans(text)
        out += [("ip", *m.span()) for m in _QUAD.finditer(text)]
    if "::" in text or text.count(":") > 4:
        out += [("ip", *m.span()) for m in _COLONS.finditer(text)]
    return out


def _is_ip(s: str) -> bool:
    try:
        ipaddress.ip_address(re.sub(r"\x20?[\[({]?\x20?(?:\.|dot)\x20?[\])}]?\x20?", ".", s) if ":" not in s else s)
    except ValueError:
        return False
    return True


_BESIDE = re.compile(r"([0-9]{1,20})[)]?[\x20\xa0./\u2010\u2011-]{1,3}[(]?$")
_AFTER = re.compile(r"[\x20\xa0./\u2010\u2011-]{1,3}[(]?([0-9]{1,20})")


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal as small numbers."""
    kind, a, b = span
    s = text[a:b]
    digits = _NOT_DIGITS.sub("", s)
    groups = [len(g) for g in _GROUP.findall(s)]
    words = _WORDS.findall(text[max(0, a - _CONTEXT) : a].lower())[-4:]
    after = _WORDS.findall(text[b : b + _CONTEXT].lower())[:4]
    signs = "".join(c for c in s if not c.isalnum())
    left, right = text[a - 1 : a], text[b : b + 1]
    beside = _BESIDE.search(text, max(0, a - 26), a)
    beyond = _AFTER.match(text, b)
    cues = CUES[kind]
    return [
        float(KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(groups[0]) if groups else 0.0,
        float(groups[-1]) if groups else 0.0,
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(bool(digits) and luhn(digits)),
        float("(" in s),
        float(s.count("-")),
        float(s.count(".")),
        float(s.count("/")),
        float(s.count(" ")),
        float(len(set(signs))),
        float(any(w.startswith(cues) for w in words)),
        float(any(w.startswith(cues) for w in after)),
        float(any(w in COUNTER_CUES for w in words)),
        float(bool(words) and words[-1] in COUNTER_CUES),
        float(left.isalnum() or left in ("$", "#", "\u20ac", "-", "/", ".", "_") and left != ""),
        float(right.isalnum() or right in ("%", "\u20ac", "_", "/", "-") and right != ""),
        float(s[:1] == "0"),
        float(s[:2] == "00"),
        float(digits[:2] in ("19", "20")),
        float(s.count(":")),
        float("::" in s),
        float(kind == "ip" and _is_ip(s)),
        float(kind == "email" and bool(re.search(r"[(\[{<]\x20?(?:at|@)|&#|_at_|-at-", s, re.IGNORECASE))),
        float(bool(_SPELLED_DOT.search(s))),
        float(digits[0]) if digits else -1.0,
        float(len(beside[1])) if beside else 0.0,
        float(len(beyond[1])) if beyond else 0.0,
        float(len(set(groups))),
        float(kind == "email" and "@" in s),
    ]


_KINDS_WRITTEN = ("email", "ip", "card", "phone", "phone", "phone")
#: Examples in which each kind and as many look-alikes are written once.
_ROUND = 2 * len(_KINDS_WRITTEN)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _write_short_phone(r: random.Random) -> str:
    """Three, three and four digits, in one layout of several."""
    area, rest = _digits(r, 3), f"{_digits(r, 3)}{r.choice(['-', '-', '.', ' '])}{_digits(r, 4)}"
    return r.choice([f"({area}) {rest}", f"({area}) {rest}", f"({area}){rest}", f"{area}-{rest}", f"{area}.{rest}", f"{area} {rest}", f"1-{area}-{rest}", f"1 ({area}) {rest}", f"{area}/{rest}"])


def _write_phone(r: random.Random) -> str:
    """A number of seven to fourteen digits in groups; with an area in brackets, a trunk zero, a country code, or none."""
    sign = r.choice([" ", " ", "-", "-", ".", "/", " - "])
    if r.random() < 0.3:
        return _write_short_phone(r)
    head = r.choice(["0" + _digits(r, r.randint(1, 4)), "00" + _digits(r, 2), "00" + _digits(r, 2) + sign + _digits(r, r.randint(1, 4)), f"(0{_digits(r, r.randint(2, 4))})", _digits(r, r.randint(2, 4))])
    groups = [_digits(r, r.randint(2, 4)) for _ in range(r.randint(1, 4))] if r.random() < 0.7 else [_digits(r, r.randint(5, 8))]
    while sum(map(len, groups)) + len(_NOT_DIGITS.sub("", head)) > 14:
        groups.pop()
    while sum(map(len, groups)) + len(_NOT_DIGITS.sub("", head)) < 8:
        groups.append(_digits(r, 2))
    inner = sign if len(sign) == 1 and r.random() < 0.7 else " "
    return head + r.choice([sign, " " if head[-1] == ")" else sign]) + inner.join(groups)


def _write_card(r: random.Random) -> str:
    size = r.choice([13, 14, 15, 15, 16, 16])
    body = r.choice({13: ["4"], 14: ["36", "38", "30"], 15: ["34", "37"], 16: ["4", "51", "55", "6011"]}[size])
    body += _digits(r, size - 1 - len(body))
    number = next(body + c for c in "0123456789" if luhn(body + c))
    if size == 16:  # the base pattern has it with single spaces, hyphens or none
        sign = r.choice([".", "  ", "/", " - ", "\xa0"])
        return sign.join(number[k : k + 4] for k in range(0, 16, 4))
    sign = r.choice([" ", "-", "."])
    return number if r.random() < 0.4 else sign.join([number[:4], number[4:10], number[10:]] if size < 16 and size > 13 else [number[:4], number[4:7], number[7:10], number[10:]])


def _letters(r: random.Random, low: int, high: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))


def _write_email(r: random.Random) -> str:
    name = _letters(r, 2, 9) + r.choice(["", "", f".{_letters(r, 3, 8)}", f"_{_letters(r, 3, 6)}", str(r.randint(1, 99))])
    b, e = r.choice(["()", "[]", "{}", "<>"])
    gap = r.choice(["", " "])
    at, dot = r.choice([(f"{gap}{b}at{e}{gap}", f"{gap}{b}dot{e}{gap}"), (" at ", " dot "), (f"{gap}{b}at{e}{gap}", "."), (f"{gap}{b}AT{e}{gap}", f"{gap}{b}DOT{e}{gap}"), (" @ ", "."), ("&#64;", "."), (f"{b}@{e}", "."), ("_at_", "_dot_"), ("-at-", "."), (f"{gap}{b}at{e}{gap}", f"{b}.{e}"), (" AT ", " DOT ")])
    host = _letters(r, 3, 9) + (dot + _letters(r, 3, 9) if r.random() < 0.2 else "")
    return f"{name}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu', 'example'])}"


def _write_ip(r: random.Random) -> str:
    g = lambda: f"{r.randrange(1 << 16):x}"
    if r.random() < 0.4:
        dots = r.choice([["[.]"] * 3, ["(.)"] * 3, [".", ".", "[.]"], ["[.]", ".", "."], [" . "] * 3, [" [.] "] * 3, ["[dot]"] * 3, ["(dot)"] * 3, ["{.}"] * 3])
        quad = [str(r.randrange(256)) for _ in range(4)]
        return quad[0] + "".join(d + q for d, q in zip(dots, quad[1:], strict=True))
    head, tail = r.randint(1, 4), r.randint(1, 3)
    first = r.choice(["2001", "fe80", "fd00", "2a02", "fc00", g()])
    return r.choice([":".join(g() for _ in range(8)), ":".join([first, *(g() for _ in range(head))]) + "::" + ":".join(g() for _ in range(tail)), f"{first}::{r.randint(1, 99)}", f"::{g()}:{g()}"])


def _write_other(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    month, day, year = f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}", str(r.randint(1900, 2100))
    sign = r.choice([" ", ", ", " ", "; "])
    return r.choice(
        [
            f"{year}-{month}-{day}",
            f"{day}.{month}.{year}",
            f"{day}/{month}/{year} {d(2)}:{d(2)}",
            f"{year}-{r.randint(1900, 2100)}",
            f"{year}{month}{day}{d(6)}",
            f"{d(1)}.{d(2)}.{d(3)}.{d(5)}",
            d(r.randint(7, 20)),
            d(r.randint(7, 20)),
            f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            f"{d(4)} {d(4)}",
            f"{d(4)}-{d(4)}",
            f"{d(2)} {d(3)} {d(3)}",
            f"{d(1)} {d(3)} {d(3)} {d(3)}",
            f"{d(3)}.{d(3)}.{d(3)}",
            f"{d(1)}.{d(1)} {d(2)} {d(4)}",
            f"{d(2)}.{d(4)} {d(2)}.{d(4)}",
            f"{d(2)}.{d(1)} - {d(2)}.{d(1)}",
            sign.join(d(r.randint(1, 5)) for _ in range(r.randint(3, 9))),
            " ".join(str(r.randint(1900, 2030)) for _ in range(r.randint(2, 5))),
            f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
            f"{d(4)}.{d(4)}.{d(4)}.{d(4)}",
            f"{d(4)} {d(6)} {d(5)}",
            f"{month}:{d(2)}:{d(2)}:{d(2)}",
            f"{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}",
            ":".join(f"{r.randrange(256):02x}" for _ in range(r.choice([5, 6, 6, 7]))),
            f"{_letters(r, 3, 6)}::{_letters(r, 3, 6)}",
            f"{d(3)}.{d(2)}.{d(1)}.{r.randint(256, 999)}",
            f"{d(1)}[{d(1)}][{d(1)}].{d(2)}",
            f"look at {_letters(r, 3, 6)}.Then",
            "was at once dot and",
            f"arrive [at] {_letters(r, 3, 6)}.Go",
            f"$ 12 @ {_letters(r, 2, 5)}",
            f"@ {_letters(r, 3, 6)}.Next",
        ]
    )


def _write_neighbour(r: random.Random, kind: str, body: str) -> tuple[str, bool, str]:
    """What may follow a number, whether it is of the kind itself, and what is between them."""
    short = re.search(r"[0-9]{3}[ .-][0-9]{4}$", body)
    other = _write_card(r) if kind == "card" else _write_short_phone(r) if short else _write_phone(r)
    day = f"{r.randint(1900, 2100)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    beside, own = r.choice([(other, True), (other, True), (day, False), (f"{r.randint(1, 12):02}/{r.randint(20, 39)}", False), (str(r.randint(1, 99)), False)])
    fixed = kind == "card" or short or own and other[0] == "("
    return beside, own, r.choice([" ", ", ", " "] if fixed else [", ", "; ", " or ", "\n"])


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[Span], set[Span]]]:
    """``2 * n`` written sentences with the proposals in them and those that are personal data."""
    r = random.Random(seed)
    filler = ["lorem", "the", "of", "and", "river", "ouon", "que", "der", "was", "then", "it", "here", "to", "me", "us", "my", "please", "under", "on", "le", "bei"]
    write = {"phone": _write_phone, "card": _write_card, "email": _write_email, "ip": _write_ip}
    out = []
    for i in range(2 * n):
        good = i % 2 == 0
        kind = _KINDS_WRITTEN[i // 2 % len(_KINDS_WRITTEN)] if good else ""
        body = write[kind](r) if good else _write_other(r)
        words = [r.choice(filler) for _ in range(4)]
        late = ""
        sure = kind in ("email", "ip") or bool(re.match(r"(?:1 )?[(]|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$", body))
        if good and r.random() < (0.7 if sure else 0.95):
            cue = r.choice(CUES[kind]) + r.choice(["", "", "e", "s"])
            if r.random() < 0.85:
                words.insert(r.randint(2, 4), cue + r.choice([":", "", ".", ""]))
            else:
                late = f"{r.choice(filler)} {cue} "
        elif not good and r.random() < 0.6:
            words.append(r.choice(COUNTER_CUES) + r.choice([":", "", ""]))
        start = " ".join(words) + r.choice([" ", " ", ": ", " ", "\n"])
        text = f"{start}{body}{r.choice([' ', ', ', '. ', chr(10), ' ('])}{late}{' '.join(r.choice(filler) for _ in range(4))}"
        true = {(kind, len(start), len(start) + len(body))} if good else set()
        if kind in ("phone", "card") and r.random() < 0.5:
            beside, own, sign = _write_neighbour(r, kind, body)
            at = len(start) + len(body) + len(sign)
            text = f"{start}{body}{sign}{beside}{text[at - len(sign) :]}"
            true |= {(kind, at, at + len(beside))} if own else set()
        base = Taken(text, base_spans(text))
        out.append((text, [span for span in candidates(text) if not base.overlaps(span)], true))
    return out


@dataclass(frozen=True)
class PiiModel:
    trees: BoostedTrees
    thresholds: tuple[float, ...]


@lru_cache(maxsize=1)
def trained_model() -> PiiModel:
    """Trained on two of three examples, thresholds set on what is selected in the third."""
    written = examples()
    rows = [(features(text, span), float(span in true)) for n, (text, spans, true) in enumerate(written) if n // _ROUND % 3 for span in spans]
    trees = fit_boosted(np.array([x for x, _ in rows]), np.array([y for _, y in rows]), rounds=80, depth=5)
    picked: dict[str, list[tuple[float, bool]]] = {kind: [] for kind in KINDS}
    for text, _, true in (w for n, w in enumerate(written) if n // _ROUND % 3 == 0):
        for p, span in chosen(text, base_spans(text), trees, [0.0] * len(KINDS)):
            picked[span[0]].append((p, span in true))
    thresholds = []
    for kind in KINDS:
        score, mark = (np.array(c) for c in zip(*picked[kind], strict=True))
        fine = [t for t in np.unique(score).tolist() if mark[score >= t].mean() >= PRECISION]
        thresholds.append(max(LEAST_THRESHOLD, min(fine)) if fine else 1.1)
    return PiiModel(trees, tuple(thresholds))


_AT_ONCE = 4_096


def chosen(text: str, base: list[Span], trees: BoostedTrees, thresholds: Sequence[float]) -> list[tuple[float, Span]]:
    """Proposals that reach their threshold and overlap nothing better, best first."""
    proposed = candidates(text)
    if not proposed:
        return []
    taken = Taken(text, base)
    free = [span for span in proposed if not taken.overlaps(span)]
    scored = []
    for at in range(0, len(free), _AT_ONCE):
        some = free[at : at + _AT_ONCE]
        p = trees.probabilities(np.array([features(text, span) for span in some]))
        scored += [(-q, span) for q, span in zip(p.tolist(), some, strict=True) if q >= thresholds[KINDS.index(span[0])]]
    out = []
    for q, span in sorted(scored):
        if not taken.overlaps(span):
            taken.add(span)
            out.append((-q, span))
    return out


def added_spans(text: str, base: list[Span], model: PiiModel) -> list[Span]:
    """What the trees add to the base spans."""
    return [span for _, span in chosen(text, base, model.trees, model.thresholds)]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def all_spans(text: str, model: PiiModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the additions; both by kind, then start."""
    base = base_spans(text)
    more = added_spans(text, base, model)
    return base, _ordered(base + more) if more else base


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``spans`` as (kind, start, end) and ``redacted`` text."""
    model = trained_model()

    def make():
        def row(doc_id, text):
            if text is None:
                return doc_id, [], None
            spans = all_spans(text, model)[1]
            return doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in spans], redacted(text, spans)

        return row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), make, "doc_id long, spans array<struct<kind string, start int, end int>>, redacted string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (or run of overlapping spans) replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, all ``spans`` as text and their number ``n_spans``."""
    model = trained_model()

    def make():
        def row(doc_id, text):
            base, spans = all_spans(text or "", model)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            return (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans))

        return row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
