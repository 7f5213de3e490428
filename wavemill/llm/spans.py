"""Spans of text: what two lists of them have to do with each other, in one sweep."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

Span = tuple[int, int, int]


def covered(spans: Iterable[Span]) -> list[tuple[int, int]]:
    """The stretches (start, end) that spans of (kind, start, end) cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def apart(candidates: Iterable[Span], taken: Iterable[Span]) -> Iterator[Span]:
    """Those of ``candidates``, which come in order of their starts, that share no character with ``taken``."""
    stretches, at = covered(taken), 0
    for k, s, e in candidates:
        while at < len(stretches) and stretches[at][1] <= s:
            at += 1
        if at == len(stretches) or e <= stretches[at][0]:
            yield k, s, e
