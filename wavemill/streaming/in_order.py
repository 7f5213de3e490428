"""State that follows the rows of a key in the order of their times, however they arrive.

Rows wait in a map state, in blocks of neighbouring steps of time.  When the watermark has passed a step no row of it can come
any more; a timer then releases it: its rows are sorted, followed, and removed.  So a shuffled stream gives the result of
the sorted one.  Of a key that waits long, hot ones included, only the blocks that hold the step at work are in memory: for
each batch that wrote some, ``ROWS`` rows, or those of one step.  A key that is silent for long ends: its state
goes, by a timer too.

Every call to the state goes to another process, and most keys have few rows in a batch.  So one value holds all that is known
of a key, its waiting blocks and its timer too; it is read and written once a call, and rows are arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEAST = -(1 << 62)
#: Rows from which on a block ends with the step it is in.
ROWS = 4096


def microseconds(interval: str) -> int:
    """An interval like ``10 seconds`` or ``1 day``."""
    n, unit = interval.split()
    # Microseconds in each unit.
    units = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
    return int(n) * units[unit.rstrip("s")]


@dataclass
class _Past:
    """What is known of a key."""

    state: tuple
    #: The last time followed, the time up to which steps are released, the next part's number and the timer that is set.
    last: int = LEAST
    done: int = LEAST
    part: int = 0
    timer: int = LEAST
    #: First step and part of each block that waits.
    blocks: list[tuple[int, int]] = field(default_factory=list)


class TimeOrdered(StatefulProcessor):
    """Rows ``us`` (microseconds) and ``columns``, given to ``follow`` in time order.

    ``wait=False`` is for rows that are complete when they arrive, as windows that the watermark has closed: they are
    only sorted.  Subclasses give the state of a new key, follow sorted rows, and say what the end of a key gives.
    """

    def __init__(self, columns: dict[str, str], step: str = "1 second", idle: str = "1 day", wait: bool = True):
        self.columns, self.step, self.idle, self.wait = columns, microseconds(step), microseconds(idle), wait

    def begin(self) -> tuple:
        raise NotImplementedError

    def follow(self, key: Any, state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, Any]]:
        raise NotImplementedError

    def end(self, key: Any, state: tuple) -> dict[str, Any]:
        return {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {float: "double", int: "long"}
        fields = ", ".join(f"s{i} {kinds[type(v)]}" for i, v in enumerate(self.begin()))
        self.past = handle.getValueState("past", f"{fields}, last long, done long, part long, timer long, steps array<long>, parts array<long>")
        self.waiting = handle.getMapState("waiting", "first long, part long", ", ".join(f"{c} array<{t}>" for c, t in {"us": "long", **self.columns}.items()))

    def _load(self) -> _Past:
        known = self.past.get()
        if known is None:
            return _Past(self.begin())
        *state, last, done, part, timer, steps, parts = known
        return _Past(tuple(state), last, done, part, timer, list(zip(steps, parts, strict=True)))

    def _keep(self, past: _Past) -> None:
        """Write what is known, with one timer: at the end of the first waiting step or, if none waits, where the key's silence ends it."""
        if past.blocks:
            us = (min(past.blocks)[0] + 1) * self.step
        else:
            us = self._closes(past.last + self.idle) if past.last > LEAST else None
        timer = LEAST if us is None else -(-us // 1000)
        if timer != past.timer:
            if past.timer > LEAST:
                self.handle.deleteTimer(past.timer)
            if timer > LEAST:
                self.handle.registerTimer(timer)
        steps, parts = [b[0] for b in past.blocks], [b[1] for b in past.blocks]
        self.past.update((*past.state, past.last, past.done, past.part, timer, steps, parts))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        past = self._load()
        for batch in rows:
            us = batch["us"].to_numpy()
            order = np.argsort(us, kind="stable")
            order = order[us[order] >= past.done]
            data = [batch[c].to_numpy()[order] for c in ("us", *self.columns)]
            steps, low = data[0] // self.step, 0
            while low < len(steps):
                # At least so many rows, up to the end of a step.
                high = int(steps.searchsorted(steps[min(low + ROWS, len(steps)) - 1], side="right"))
                self._put([c[low:high] for c in data], past)
                low = high
        if not self.wait:
            yield from self._release(key, past, None)
        self._keep(past)

    def _put(self, rows: list[np.ndarray], past: _Past) -> None:
        block = (int(rows[0][0]) // self.step, past.part)
        self.waiting.updateValue(block, tuple(c.tolist() for c in rows))
        past.blocks.append(block)
        past.part += 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, past = timerValues.getCurrentWatermarkInMs() * 1000, self._load()
        if self.wait:
            yield from self._release(key, past, now)
        if past.last > LEAST and self._closes(past.last + self.idle) <= now and not past.blocks:
            yield from self._output(key, [self.end(key, past.state)])
            if past.timer > LEAST:
                self.handle.deleteTimer(past.timer)
            self.past.clear()
        else:
            self._keep(past)

    def _closes(self, us: int) -> int:
        """The end of the step that a time lies in."""
        return (us // self.step + 1) * self.step

    def _release(self, key: Any, past: _Past, until: int | None) -> Iterator[pd.DataFrame]:
        """Follow the steps that end by ``until``, all if it is None.

        Blocks are read as time reaches them, and rows are followed up to where the next block begins.
        """
        ready = sorted(b for b in past.blocks if until is None or (b[0] + 1) * self.step <= until)
        end = 1 << 62 if until is None else until // self.step * self.step
        held = None
        for n, block in enumerate(ready):
            rows = [np.array(c) for c in self.waiting.getValue(block)]
            self.waiting.removeKey(block)
            past.blocks.remove(block)
            held = rows if held is None else [np.concatenate(c) for c in zip(held, rows, strict=True)]
            order = np.argsort(held[0], kind="stable")
            held = [c[order] for c in held]
            upto = min(ready[n + 1][0] * self.step, end) if n + 1 < len(ready) else end
            now = int(held[0].searchsorted(upto))
            if now:
                yield from self._output(key, self._follow(key, past, [c[:now] for c in held]))
                held = [c[now:] for c in held]
        if held is not None and len(held[0]):
            self._put(held, past)
        if self.wait:
            past.done = max(past.done, end)

    def _follow(self, key: Any, past: _Past, rows: list[np.ndarray]) -> list[dict[str, Any]]:
        """Follow sorted rows; a silence longer than allowed ends what was before it."""
        us, out = rows[0], []
        edges = [0, *(np.flatnonzero(np.diff(us) > self.idle) + 1).tolist(), len(us)]
        for low, high in zip(edges, edges[1:], strict=False):
            if past.last > LEAST and int(us[low]) - past.last > self.idle:
                out.append(self.end(key, past.state))
                past.state = self.begin()
            past.state, some = self.follow(key, past.state, {n: c[low:high] for n, c in zip(("us", *self.columns), rows, strict=True)})
            past.last = int(us[high - 1])
            out.append(some)
        return out

    def _output(self, key: Any, parts: list[dict[str, Any]]) -> Iterator[pd.DataFrame]:
        """One frame of parts that are given as columns."""
        parts = [p for p in parts if len(next(iter(p.values()), ()))]
        if parts:
            columns = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            yield pd.DataFrame({"key": [key[0]] * len(next(iter(columns.values()))), **columns})

    def close(self) -> None:
        pass


def ordered_by_key(rows: DataFrame, processor: TimeOrdered, output: str) -> DataFrame:
    """What ``processor`` gives for rows with ``key``, ``us``, its columns and a column with a watermark."""
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key {kind}, {output}", outputMode="Append", timeMode="EventTime")
