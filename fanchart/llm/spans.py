"""Spans of identifiers and secrets in a text: (kind number, start, end), code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable

Span = tuple[int, int, int]


def written(spans: Iterable[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{kinds[k]}:{start}:{end}" for start, k, end in sorted((s, k, e) for k, s, e in spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def added(base: list[Span], more: Iterable[Span]) -> list[Span]:
    """Those of ``more`` that overlap no base span of their kind and no earlier added one of it."""
    taken: dict[int, list[tuple[int, int]]] = {}
    for k, start, end in sorted(base):
        taken.setdefault(k, []).append((start, end))
    out = []
    for k, start, end in sorted(set(more), key=lambda s: (s[1], s[0], -s[2])):
        own = taken.setdefault(k, [])
        at = bisect_left(own, (start, end))
        if (at == 0 or own[at - 1][1] <= start) and (at == len(own) or own[at][0] >= end):
            own.insert(at, (start, end))
            out.append((k, start, end))
    return out
