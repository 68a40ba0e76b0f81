"""Secret scans: fixed base patterns, then structural confirmation.

Base kinds are found by pattern alone.  Beyond them, runs that could be base64
or hex are decoded and reported only if their bytes have the structure of a
secret: a DER private key (a sequence whose nested lengths fit exactly and
whose members are those of PKCS#1, PKCS#8 or SEC1), an OpenSSH private key
(magic and length-prefixed fields), or a signed token (a JSON header with an
algorithm, a JSON object, and a signature, joined by dots).  Random text of
the same alphabet decodes to bytes without that structure and is left alone.

Work grows in proportion to the text: tokens are found run by run, wrapped
base64 is decoded once for each of its four alignments, and overlaps are looked
up in a map of the text.

Spans are code points, end exclusive.  Defined results: null counts as an empty
text and has no spans; texts of any length are read whole; rows that repeat an
id each get their row; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylace.llm.arrow import map_rows
from waylace.llm.spans import Span, Taken, joined

BASE_KINDS = ("assign", "access", "hex")
#: key: a private key in an encoding; token: a signed token
KINDS = (*BASE_KINDS, "key", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so a check of length changes nothing
_MIN_ASSIGN, _MIN_ACCESS = 12, 18

_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_UPPER_HEX = re.compile(r"[0-9A-Fa-f]{80,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]++|\\++[nrt])++)-----END \1-----")
_ESCAPED = re.compile(r"\\+[nrt]|\s")
#: Lines of base64, joined by line ends or their escapes; an escape's letter begins none.
_LINES = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nr]))[A-Za-z0-9+/_-]{40,}(?:[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*[A-Za-z0-9+/_-]+)+")
_LINE = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nr]))[A-Za-z0-9+/_-]+")
_PART = re.compile(r"[A-Za-z0-9_-]*+")
#: Fewest characters of a token's header, claims and signature.
_LEAST_PARTS = (8, 4, 16)
_MAGIC = b"openssh-key-v1\0"


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _der(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """``(tag, begin, end)`` of the values that fill ``data[at:end]`` exactly, or None."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or end - at < width:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if size > end - at:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_key(data: bytes | memoryview) -> bool:
    """Whether the bytes are a private key as PKCS#1, PKCS#8, SEC1 or OpenSSH lay it out."""
    if bytes(data[: len(_MAGIC)]) == _MAGIC:
        at = len(_MAGIC)
        for _ in range(3):  # cipher, derivation, its options
            if len(data) - at < 4:
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return len(data) - at >= 4 and int.from_bytes(data[at : at + 4], "big") >= 1
    if len(data) < 32 or data[0] != 0x30:
        return False
    outer = _der(data)
    if outer is None or len(outer) != 1:
        return False
    inner = _der(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    version = bytes(data[inner[0][1] : inner[0][2]])
    if tags[0] != 0x02 or version not in (b"\0", b"\1"):
        return False
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8: algorithm, then the key
        algorithm = _der(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1] == 0x04:  # SEC1
        return inner[1][2] - inner[1][1] >= 16
    return (len(tags) >= 9 or len(tags) == 6) and set(tags[:9]) == {0x02}  # PKCS#1, or the six numbers of DSA


#: Public keys that an OpenSSH file may name; its format allows one.
_MOST_KEYS = 64


def _key_size(data: bytes | memoryview) -> int | None:
    """Bytes of the private key that may begin ``data``, by its own lengths; None if there is none."""
    if bytes(data[: len(_MAGIC)]) == _MAGIC:
        at, left = len(_MAGIC), 3  # cipher, derivation, its options
        while left:
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
            if at + 4 > len(data):
                return None
        left = int.from_bytes(data[at : at + 4], "big") + 1  # public keys, then the private part
        if left > _MOST_KEYS:
            return None
        at += 4
        while left:
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
        return at
    if len(data) < 6 or data[0] != 0x30:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    if width > 4:
        return None
    size = int.from_bytes(data[2 : 2 + width], "big") if width else data[1]
    return 2 + width + size if data[2 + width : 3 + width] == b"\2" else None  # each form begins with its version


def _wrapped_keys(text: str) -> list[Span]:
    """Keys in base64 without armour whose lines end where their own lengths say."""
    out: list[Span] = []
    for m in _LINES.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        ends = list(accumulate(b - a for a, b in lines))
        joined_lines = "".join(text[a:b] for a, b in lines)
        decoded: dict[int, memoryview] = {}
        free = 0
        for i, (a, b) in enumerate(lines):
            at = ends[i] - (b - a)
            if b - a < 40 or a < free:
                continue
            shift = at % 4
            if shift not in decoded:
                decoded[shift] = memoryview(_unbase64(joined_lines[shift : len(joined_lines) - (len(joined_lines) - shift) % 4]) or b"")
            data = decoded[shift][at // 4 * 3 :]
            size = _key_size(data)
            if size is None:
                continue
            chars = at + (8 * size + 5) // 6
            k = bisect_left(ends, chars, i)
            # the last bytes may lie beyond the last whole group of four characters
            if k < len(lines) and ends[k] == chars and is_private_key(data[:size] if len(data) >= size else _unbase64(joined_lines[at:chars]) or b""):
                end = lines[k][1]
                free = end + min(2, len(text[end : end + 2]) - len(text[end : end + 2].lstrip("=")))
                out.append(("key", a, free))
    return out


def _unbase64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_json_object(part: str) -> dict | None:
    raw = _unbase64(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, body: str, signature: str) -> bool:
    """Whether three dotted parts are a token with an algorithm, claims and a signature."""
    head = _is_json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _is_json_object(body) is not None and bool(_unbase64(signature))


def _signed_tokens(text: str) -> list[Span]:
    """Three dotted runs whose first holds ``eyJ``, the start of an encoded object."""
    out: list[Span] = []
    at = text.find("eyJ")
    while at >= 0:
        parts, end = [], at
        for least in _LEAST_PARTS:
            begin, end = end, _PART.match(text, end).end()
            parts.append(text[begin:end])
            if end - begin < least or len(parts) < len(_LEAST_PARTS) and text[end : end + 1] != ".":
                break
            end += len(parts) < len(_LEAST_PARTS)
        else:
            if is_signed_token(*parts):
                out.append(("token", at, end))
            at = text.find("eyJ", end)
            continue
        at = text.find("eyJ", at + max(1, len(parts[0])))  # what follows may be a header itself
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Spans that decoding confirms, by start."""
    out: list[Span] = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            data = _unbase64(_ESCAPED.sub("", m[2]))
            if data is not None and (is_private_key(data) or m[1].startswith("ENCRYPTED") and _der(data)):
                out.append(("key", *m.span()))
    out += _signed_tokens(text)
    wrapped, runs = _wrapped_keys(text), list(_RUN.finditer(text))
    if not wrapped and not runs:
        return _ordered(out)
    taken = Taken(text, out)
    for span in wrapped:
        if not taken.overlaps(span):
            taken.add(span)
            out.append(span)
    for m in runs:
        if taken.map[m.start()]:
            continue
        data = _unbase64(m[0])
        if data is not None and is_private_key(data):
            out.append(("key", *m.span()))
        elif _UPPER_HEX.fullmatch(m[0]) and len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            out.append(("key", *m.span()))
    return _ordered(out)


def all_spans(text: str) -> list[Span]:
    """Base spans and confirmed ones."""
    return _ordered(base_spans(text) + confirmed_spans(text))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind, start, end)."""

    def make():
        return lambda doc_id, text: (doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(text or "")])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), make, "doc_id long, spans array<struct<kind string, start int, end int>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex`` of base spans, ``base_sha256``, all ``spans`` as text and their number ``n_spans``."""

    def make():
        def row(doc_id, text):
            text = text or ""
            base = base_spans(text)
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            more = confirmed_spans(text)
            return (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(_ordered(base + more) if more else base), len(base) + len(more))

        return row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")
