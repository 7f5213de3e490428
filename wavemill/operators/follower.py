"""The attack and release follower by blocks that do not wait for each other.

With an attack above the release a step of the follower takes the larger of two rising lines in the level before it, so
a block of samples is a convex, piecewise-linear function of the level it starts from: the upper envelope of lines, one for
each number of attacks.  (With an attack below the release it is the lower envelope.)  Blocks give their
lines, the level is carried over the blocks of a channel by these, and every block runs from its own start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Samples followed in one row of a block's matrix, and rows that blocks of one length are followed in side by side.
CHUNK, SIDE = 64, 4096


class Follower:
    def __init__(self, attack: float, release: float):
        if not (0 <= attack <= 1 and 0 <= release <= 1):
            raise ValueError("rates lie between 0 and 1")
        self.up, self.down = attack, release
        self.sign = 1.0 if attack >= release else -1.0
        self.pick = np.maximum if attack >= release else np.minimum

    def slopes(self, m: int) -> np.ndarray:
        """Slopes of the lines of ``m`` samples, by the number of attacks."""
        k = np.arange(m + 1)
        return (1 - self.up) ** k * (1 - self.down) ** (m - k)

    def lines(self, v: np.ndarray) -> np.ndarray:
        """Intercepts (rows, samples + 1) of the lines of each row of magnitudes."""
        rows, m = v.shape
        c = np.zeros((rows, m + 1))
        for t in range(m):
            x = v[:, t : t + 1]
            attacked = (1 - self.up) * c[:, : t + 1] + self.up * x
            c[:, : t + 1] = (1 - self.down) * c[:, : t + 1] + self.down * x
            c[:, 1 : t + 1] = self.pick(c[:, 1 : t + 1], attacked[:, :t])
            c[:, t + 1] = attacked[:, t]
        return c

    def _corners(self, s: np.ndarray, c: np.ndarray, low: float, high: float) -> list[float]:
        """Where the lines that hold between ``low`` and ``high`` meet, in order."""
        best = lambda y: int(np.argmax(self.sign * (s * y + c)))
        out, stack = [], [(best(low), low, best(high), high)]
        while stack:
            i, a, j, b = stack.pop()
            if i == j or s[i] == s[j]:
                continue
            y = (c[i] - c[j]) / (s[j] - s[i])
            if not a < y < b:
                continue
            k = best(y)
            if k in (i, j) or abs(s[k] * y + c[k] - s[i] * y - c[i]) <= 1e-15 * abs(c[k]):
                out.append(y)
            else:
                stack += [(k, y, j, b), (i, a, k, y)]
        return sorted(out)

    def ends(self, v: np.ndarray, top: float) -> tuple[float, float]:
        """The levels after a block that starts from 0 and from ``top``: what it may start from only gives levels between."""
        y = np.array([0.0, top])
        for s, c in self._rows(v):
            y = self.pick.reduce(s[:, None] * y + c[:, None], axis=0)
        return float(y[0]), float(y[1])

    def shape(self, v: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """The level after a block by the level before it, between two bounds: the corners of a piecewise-linear function.

        Levels draw together, so bounds from the block before are close, corners few, and those that fall on each other go.
        """
        return self._shape(self._rows(v), low, high)

    def _shape(self, rows, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.array([low, high]), np.array([low, high])
        for s, c in rows:
            if y[0] < y[-1]:
                corners = self._corners(s, c, y[0], y[-1])
                if corners:
                    at = np.searchsorted(y, corners)
                    x, y = np.insert(x, at, np.interp(corners, y, x)), np.insert(y, at, corners)
            y = self.pick.reduce(s[:, None] * y + c[:, None], axis=0)
            same = (y[1:-1] == y[:-2]) & (y[1:-1] == y[2:])
            if same.any():
                keep = np.concatenate([[True], ~same, [True]])
                x, y = x[keep], y[keep]
        return x, y

    def _rows(self, v: np.ndarray):
        """Slopes and intercepts of each chunk in order."""
        whole = len(v) // CHUNK * CHUNK
        s = self.slopes(CHUNK)
        for c in self.lines(v[:whole].reshape(-1, CHUNK)):
            yield s, c
        if whole < len(v):
            yield self.slopes(len(v) - whole), self.lines(v[None, whole:])[0]

    @staticmethod
    def alike(blocks) -> Iterator[tuple[list[int], np.ndarray]]:
        """Blocks of one length as the rows of a matrix, with their places; a bounded number of chunks at a time."""
        places: dict[int, list[int]] = {}
        for i, v in enumerate(blocks):
            places.setdefault(len(v), []).append(i)
        for n, at in places.items():
            some = max(1, SIDE // max(1, -(-n // CHUNK)))
            for low in range(0, len(at), some):
                part = at[low : low + some]
                yield part, np.array([np.asarray(blocks[i], float) for i in part]).reshape(len(part), n)

    def _columns(self, v: np.ndarray):
        """Slopes and, for each block of a matrix, intercepts of each chunk in order."""
        rows, n = v.shape
        whole = n // CHUNK * CHUNK
        if whole:
            s, c = self.slopes(CHUNK), self.lines(v[:, :whole].reshape(-1, CHUNK)).reshape(rows, -1, CHUNK + 1)
            for j in range(c.shape[1]):
                yield s, c[:, j]
        if whole < n:
            yield self.slopes(n - whole), self.lines(v[:, whole:])

    def all_ends(self, blocks, tops) -> np.ndarray:
        """``ends`` of every block, (blocks, 2)."""
        out = np.zeros((len(blocks), 2))
        for at, v in self.alike(blocks):
            y = np.stack([np.zeros(len(at)), np.array([tops[i] for i in at], float)], axis=1)
            for s, c in self._columns(v):
                y = self.pick.reduce(s * y[:, :, None] + c[:, None, :], axis=2)
            out[at] = y
        return out

    def all_shapes(self, blocks, lows, highs) -> list[tuple[np.ndarray, np.ndarray]]:
        """``shape`` of every block."""
        out = [None] * len(blocks)
        for at, v in self.alike(blocks):
            columns = list(self._columns(v))
            for row, i in enumerate(at):
                out[i] = self._shape(((s, c[row]) for s, c in columns), lows[i], highs[i])
        return out

    def all_output(self, blocks, levels) -> list[np.ndarray]:
        """``output`` of every block."""
        out = [None] * len(blocks)
        for at, v in self.alike(blocks):
            rows, n = v.shape
            level, starts = np.array([levels[i] for i in at], float), []
            for s, c in self._columns(v):
                starts.append(level)
                level = self.pick.reduce(s * level[:, None] + c, axis=1)
            if not starts:
                out_rows = v
            else:
                grid = np.zeros((rows, len(starts) * CHUNK))
                grid[:, :n] = v
                now, grid = np.stack(starts, axis=1).ravel(), grid.reshape(-1, CHUNK)
                for t in range(min(CHUNK, n)):
                    x = grid[:, t]
                    now = now + np.where(x > now, self.up, self.down) * (x - now)
                    grid[:, t] = now
                out_rows = grid.reshape(rows, -1)[:, :n]
            for row, i in enumerate(at):
                out[i] = out_rows[row]
        return out

    def output(self, v: np.ndarray, level: float) -> np.ndarray:
        """Levels at all samples of a block: chunks start from the level their lines give, then run side by side."""
        rows = -(-len(v) // CHUNK)
        levels = np.empty(rows)
        for n, (s, c) in enumerate(self._rows(v)):
            levels[n] = level
            level = float(self.pick.reduce(s * level + c))
        grid = np.zeros((rows, CHUNK))
        grid.ravel()[: len(v)] = v
        out = np.empty_like(grid)
        for t in range(CHUNK):
            x = grid[:, t]
            levels = levels + np.where(x > levels, self.up, self.down) * (x - levels)
            out[:, t] = levels
        return out.ravel()[: len(v)]


def greedy_shape(pos: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block of candidates makes of the last one taken before it: ``(bounds, exits)``.

    Of candidates in order each is taken that lies more than ``distance`` after the last one taken.  A candidate leads to the
    first one beyond its distance, so chains from different starts join.  Who enters at the first candidate at or after
    ``bounds[i]`` leaves with ``exits[i]`` taken last.
    """
    nxt = np.searchsorted(pos, pos + distance, side="right").tolist()
    exits = pos.tolist()
    for i in range(len(exits) - 1, -1, -1):
        if nxt[i] < len(exits):
            exits[i] = exits[nxt[i]]
    exits = np.array(exits, np.int64)
    # Only a candidate within the distance of the block's first can be missed by who enters.
    head = max(1, int(np.searchsorted(pos, pos[0] + distance, side="right")) + 1)
    exits, bounds = exits[:head], pos[:head]
    change = np.append(True, exits[1:] != exits[:-1])
    # A run of candidates with one exit is known by the candidate before it.
    bounds = np.append(np.iinfo(np.int64).min, bounds[:-1] + 1)[change]
    return bounds, exits[change]


def greedy_exit(bounds: np.ndarray, exits: np.ndarray, last_pos: int, last: int, distance: int) -> int:
    """The last one taken after a block whose last candidate is ``last_pos``, from the last one taken before it."""
    if last_pos <= last + distance:
        return last
    return int(exits[np.searchsorted(bounds, last + distance + 1, side="right") - 1])


def greedy_taken(pos: np.ndarray, last: int, distance: int) -> np.ndarray:
    """The candidates of a block that are taken."""
    nxt = np.searchsorted(pos, pos + distance, side="right").tolist()
    i, out = int(np.searchsorted(pos, last + distance, side="right")), []
    while i < len(nxt):
        out.append(i)
        i = nxt[i]
    return pos[out]
