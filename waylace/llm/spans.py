"""Spans of a text: (kind, start, end), in code points, end exclusive."""

from __future__ import annotations

Span = tuple[str, int, int]


class Taken:
    """Which characters of a text lie in a span."""

    def __init__(self, text: str, spans: list[Span]):
        self.map = bytearray(len(text))
        for span in spans:
            self.add(span)

    def add(self, span: Span) -> None:
        self.map[span[1] : span[2]] = b"\1" * (span[2] - span[1])

    def overlaps(self, span: Span) -> bool:
        return self.map.find(1, span[1], span[2]) >= 0


def joined(spans: list[Span]) -> str:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
