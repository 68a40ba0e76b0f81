"""Splitting texts into the pre-tokens of byte-level vocabularies."""

from __future__ import annotations

import re
from collections.abc import Callable

#: How byte-level vocabularies split texts; a fixed value of that public format.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same for texts within Latin-1, with its letters and numbers written out.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTER}{_NUMBER}]+| ?[{_NUMBER}]+|\s+(?!\S)|\s+")
#: White space to Python's own engine but not to the pattern.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def splitter(pattern: str = BYTE_LEVEL_PATTERN) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens."""
    import regex

    general = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL_PATTERN:
        return general
    latin = _LATIN.findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return general(text) if any(c in text for c in _SEPARATORS) else latin(text)

    return split


class Memo(dict):
    """Values of a function by key; a key that is missing is computed and kept."""

    def __init__(self, compute: Callable[[str], object]):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> object:
        value = self[key] = self.compute(key)
        return value
