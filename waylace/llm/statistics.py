"""Statistics of a text's words and lines, shared by the quality operators.

Words are runs of bytes other than space and 0x09-0x0D.  Everything is counted
on UTF-8 bytes; numbers of characters are numbers of code points.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_FOLLOW = bytes(range(0x80, 0xC0))
_LEAD = bytes(range(0xC0, 0x100))
_ENDS = frozenset(b"!#*$%&|<>")
WINDOW = 5
#: From this many words windows are named by sorting and not held as tuples.
_LONG = 50_000

#: What the base rules use, then what is learned from.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "mean_word_chars",
    "symbol_share",
    "upper_share",
    "digit_share",
    "bang_per_word",
    "bar_per_word",
    "dup_line_share",
    "repeat_word_share",
    "distinct_word_share",
    "top_word_share",
    "short_word_share",
    "marked_word_share",
    "stop_mark_per_word",
    "lines_per_word",
    "wide_char_share",
)


def _count(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) < _LONG:
        windows = list(zip(*(words[k : k + n] for k in range(width)), strict=True))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        hits = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=n)
    else:
        names: dict[bytes, int] = {}
        one = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
        named = one[:n]
        for k in range(1, width):  # a window's name: that of its first k words, and the next word
            named = np.unique(named * len(names) + one[k : k + n], return_inverse=True)[1]
        hits = np.bincount(named)[named] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hits)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(raw: bytes | None) -> tuple[list[int], list[float]]:
    """Values of COUNTS and of FEATURES; all are finite, for empty texts too."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    wide = _count(raw, _LEAD)
    chars = len(raw) - _count(raw, _FOLLOW)
    word_chars = chars - _count(raw, _SPACE)
    symbols = _count(raw, _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    tally = Counter(words)
    upper, lower = _count(raw, _UPPER), _count(raw, _LOWER)
    per_word, per_char = max(n, 1), max(word_chars, 1)
    features = [
        math.log1p(n),
        word_chars / per_word,
        symbols / per_char,
        upper / max(upper + lower, 1),
        _count(raw, _DIGITS) / per_char,
        raw.count(b"!") / per_word,
        raw.count(b"|") / per_word,
        dup_lines / max(len(lines), 1),
        repeats / per_word,
        len(tally) / per_word,
        max(tally.values(), default=0) / per_word,
        sum(len(w) <= 3 for w in words) / per_word,
        sum(w[-1] in _ENDS for w in words) / per_word,
        _count(raw, b".,") / per_word,
        len(lines) / per_word,
        wide / per_char,
    ]
    return [n, word_chars, symbols, dup_lines, repeats], features
