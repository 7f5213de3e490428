"""Suffix trees by Ukkonen's method and common extensions in constant time.

A tree is built symbol by symbol, toured by Euler's rule, and a range-minimum table over the string depths of the tour
gives the depth of the lowest common ancestor of two leaves: the longest common extension of two suffixes.  Queries
come in arrays.  Memory grows with the string: some 600 bytes a symbol while a tree is built, 60 afterwards.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16


class RangeMinimum:
    """Minima of ranges of a fixed array: running minima inside blocks, a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK) * BLOCK
        self.values = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        grid = self.values.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            step, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))

    def query(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of each range, both ends included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.back[low], self.ahead[high])
        same = np.flatnonzero(first == last)
        if len(same):
            at, end = low[same], high[same]
            best = self.values[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, end)
                best = np.minimum(best, self.values[at])
            out[same] = best
        span = last - first - 1
        for level in range(len(self.table)):
            some = np.flatnonzero((span >= 1 << level) & (span < 2 << level))
            if len(some):
                t = self.table[level]
                out[some] = np.minimum(out[some], np.minimum(t[first[some] + 1], t[last[some] - (1 << level)]))
        return out


def _ukkonen(s: list[int], size: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Edges ``node * size + symbol -> child``, edge starts, edge ends (-1: a leaf's) and leaves in order of their suffix."""
    edges: dict[int, int] = {}
    start, end, link, leaves = [0], [0], [0], []
    node, edge, length, waiting = 0, 0, 0, 0
    for i, c in enumerate(s):
        last = 0
        waiting += 1
        while waiting:
            if length == 0:
                edge = i
            key = node * size + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                end.append(-1)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                long = (i + 1 if end[child] < 0 else end[child]) - at
                if length >= long:
                    edge += long
                    length -= long
                    node = child
                    continue
                if s[at + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                edges[key] = split
                edges[split * size + c] = split + 1
                edges[split * size + s[at + length]] = child
                leaves.append(split + 1)
                start += (at, i)
                end += (at + length, -1)
                link += (0, 0)
                start[child] = at + length
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node == 0 and length > 0:
                length -= 1
                edge = i - waiting + 1
            else:
                node = link[node]
    return edges, start, end, leaves


class SuffixTree:
    """The suffix tree of symbols 1 and up; a closing symbol 0, smaller than all, is added."""

    def __init__(self, symbols: np.ndarray):
        s = [*symbols.tolist(), 0]
        self.n, size = len(s) - 1, int(symbols.max(initial=0)) + 1
        edges, start, end, leaves = _ukkonen(s, size)
        nodes = len(start)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        kids = np.fromiter(edges.values(), np.int64, len(edges))
        del edges
        order = np.argsort(keys)
        self.parent, self.symbol, self.kids = keys[order] // size, keys[order] % size, kids[order]
        self.bounds = np.searchsorted(self.parent, np.arange(nodes + 1))
        self.leaves = np.asarray(leaves)
        self.suffix = np.full(nodes, -1, np.int64)
        self.suffix[self.leaves] = np.arange(self.n + 1)
        tour, first = self._tour(start, end)
        self.first = first[self.leaves]
        self.minimum = RangeMinimum(tour)

    def _tour(self, start: list[int], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """String depths in the order of an Euler tour, and where each node is met first."""
        bounds, kids, n = self.bounds.tolist(), self.kids.tolist(), self.n + 1
        depth, first, tour = [0] * len(start), [0] * len(start), []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            first[v] = len(tour)
            tour.append(depth[v])
            low, high = bounds[v], bounds[v + 1]
            for at in range(high - 1, low - 1, -1):
                w = kids[at]
                depth[w] = depth[v] + (n if end[w] < 0 else end[w]) - start[w]
                if at < high - 1:
                    stack.append(~v)
                stack.append(w)
        return np.asarray(tour, np.int32), np.asarray(first)

    def ranks(self, reverse: bool = False) -> np.ndarray:
        """Rank of each suffix in the order of symbols or, ``reverse``, their inverse; the closing symbol is smallest in both."""
        if not reverse:
            return np.argsort(np.argsort(self.first))
        order = np.lexsort((np.where(self.symbol == 0, np.iinfo(np.int64).min, -self.symbol), self.parent))
        bounds, kids, suffix = self.bounds.tolist(), self.kids[order].tolist(), self.suffix.tolist()
        found, stack = [], [0]
        while stack:
            v = stack.pop()
            if suffix[v] >= 0:
                found.append(suffix[v])
            else:
                stack += kids[bounds[v] : bounds[v + 1]][::-1]
        out = np.empty(len(found), np.int64)
        out[found] = np.arange(len(found))
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j``, different places up to the end, have in common."""
        a, b = self.first[i], self.first[j]
        return self.minimum.query(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)
