"""Spans in texts: their order, digests and replacement. Positions are code points, ends exclusive."""

from __future__ import annotations

import hashlib
from typing import NamedTuple


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the place of the kind in the list."""
    place = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s.start, place[s.kind], s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, names the stretch."""
    out, at = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if merged and s.start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], s.end)
        else:
            merged.append([s.kind, s.start, s.end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])
