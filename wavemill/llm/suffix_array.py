"""Suffix arrays of byte strings in numpy: Larsson and Sadakane's refinement, Kasai's common prefixes, merging of runs."""

from __future__ import annotations

import numpy as np

#: Bytes sorted by at once in the first step.
FIRST = 8


def _leading(text: np.ndarray) -> np.ndarray:
    """The first eight bytes of every suffix as one number, zeros after the end."""
    key = np.zeros(len(text), np.uint64)
    for k in range(FIRST):
        part = text[k:].astype(np.uint64) << np.uint64(8 * (FIRST - 1 - k))
        key[: len(part)] |= part
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a byte string in their order.

    A group number is the place of the group's last suffix in the order.  Each step sorts what is left of the groups
    by the group that follows as far on as has been sorted, so that the sorted length doubles; groups of one are
    left alone.  A suffix that ends is smaller than one that goes on.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    key = _leading(text)
    order = np.argsort(key)
    fresh = np.empty(n, bool)
    fresh[:1] = True
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    # The padding equals bytes of zero: suffixes that end in the first step are told apart by their length.
    short = np.flatnonzero(order > n - FIRST)
    if len(short):
        order, fresh = _by_length(order, fresh, n)
    group = np.zeros(n + 1, np.int64)  # one more than the place; 0 is the end of the text
    last = _last_of(fresh)
    group[order] = last + 1
    todo = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    h = FIRST
    while len(todo):
        at = order[todo]
        behind = group[np.minimum(at + h, n)]
        combined = (last[todo].astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        turn = np.argsort(combined)
        order[todo] = at[turn]
        combined = combined[turn]
        fresh[todo[1:]] = combined[1:] != combined[:-1]
        fresh[todo[0]] = True
        last = _last_of(fresh)
        group[order[todo]] = last[todo] + 1
        todo = todo[~(fresh[todo] & np.append(fresh[1:], True)[todo])]
        h *= 2
    return order


def _last_of(fresh: np.ndarray) -> np.ndarray:
    """For each place the last one of its group."""
    n = len(fresh)
    ends = np.append(np.flatnonzero(fresh)[1:] - 1, n - 1)
    return np.repeat(ends, np.diff(np.append(np.flatnonzero(fresh), n)))


def _by_length(order: np.ndarray, fresh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In groups of equal padded starts, what ends first comes first."""
    number = np.cumsum(fresh)
    left = np.minimum(n - order, FIRST)
    turn = np.lexsort((left, number))
    order, number, left = order[turn], number[turn], left[turn]
    fresh = np.ones(n, bool)
    fresh[1:] = (number[1:] != number[:-1]) | (left[1:] != left[:-1])
    return order, fresh


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lane: int = 512) -> np.ndarray:
    """Length in common with the suffix before, by places in the order, up to ``most``; 0 for the first.

    Kasai's rule: from one position of the text to the next the common length falls by one at most.  Lanes of
    ``lane`` positions follow it side by side, each from zero: in a step a lane finds one more equal byte or goes on.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(0, n, lane)
    stop = np.minimum(at + lane, n)
    length = np.zeros(len(at), np.int64)
    out = np.zeros(n + 1, np.int32)
    padded = np.append(text, np.zeros(1, text.dtype))
    while len(at):
        mine, other = at + length, before[at] + length
        ok = (length < most) & (before[at] >= 0) & (mine < n) & (other < n)
        ok &= padded[np.minimum(mine, n)] == padded[np.minimum(other, n)]
        rest = np.flatnonzero(~ok)
        out[at[rest]] = length[rest]
        length += 1
        length[rest] = np.maximum(length[rest] - 2, 0)
        at[rest] += 1
        left = at < stop
        if not left.all():
            at, stop, length = at[left], stop[left], length[left]
    return out[order]


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """The keys that two or more sorted runs of distinct keys hold, sorted.

    Each run is looked up by binary search in what came before it and put in where it belongs.
    """
    seen, shared = runs[0], runs[0][:0]
    for run in runs[1:]:
        place = np.searchsorted(seen, run)
        held = (place < len(seen)) & (seen[np.minimum(place, len(seen) - 1)] == run) if len(seen) else np.zeros(len(run), bool)
        if held.any():
            shared = np.union1d(shared, run[held])
        seen = np.insert(seen, place[~held], run[~held])
    return shared
