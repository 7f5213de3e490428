"""Monitors of signal streams ``(key, ts timestamp, value double)`` as Structured Streaming queries."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.scalar import dbfs, lufs_from_power
from wavemill.streaming.in_order import TimeOrdered, ordered_by_key


class _RelativeGate(TimeOrdered):
    """Keeps the sum and number of each key's windows above the absolute gate."""

    def __init__(self, below: float, **times: Any):
        super().__init__({"start": "long", "n": "long", "power": "double", "lufs": "double", "loud": "boolean"}, wait=False, **times)
        self.share = 10 ** (-below / 10)

    def begin(self) -> tuple:
        return 0.0, 0

    def follow(self, key: Any, state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, Any]]:
        total, n = state
        gated = []
        for power, loud in zip(rows["power"], rows["loud"], strict=True):
            if loud:
                total, n = total + power, n + 1
            gated.append(bool(loud and power > self.share * total / n))
        return (total, n), {**rows, "gated": gated}


def stream_loudness(stream: DataFrame, window: str = "400 milliseconds", slide: str = "100 milliseconds", late: str = "1 second", gate: float = -70.0, below: float = 10.0, step: str = "10 seconds", idle: str = "1 day") -> DataFrame:
    """Mean power and loudness of sliding windows; ``loud`` tells whether a window passes the absolute gate, ``gated`` whether it also passes the relative one.

    The relative gate lies ``below`` LU under the mean power of the key's loud windows so far, this one included.  Windows
    close when the watermark, ``late`` behind the latest time seen, passes them; rows later than that are dropped.  They
    are gated in the order of their ends, those of ``step`` at a time.  A key without windows for ``idle`` starts anew.
    """
    w = stream.withWatermark("ts", late).groupBy("key", F.window("ts", window, slide).alias("w")).agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count(F.lit(1)).alias("n"))
    lufs = lufs_from_power(F.col("power"))
    at = F.window_time("w").alias("at")
    w = w.select("key", at, F.unix_micros("w.end").alias("us"), F.unix_micros("w.start").alias("start"), "n", "power", lufs_from_power(F.col("power")).alias("lufs"))
    gated = ordered_by_key(w.withColumn("loud", F.col("lufs") > gate), _RelativeGate(below, step=step, idle=idle), "us long, start long, n long, power double, lufs double, loud boolean, gated boolean")
    return gated.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("us").alias("end"), "n", "power", "lufs", "loud", "gated")


def stream_block_levels(stream: DataFrame, block: str = "3 seconds", late: str = "1 second") -> DataFrame:
    """Peak and RMS of tumbling blocks; rows later than the watermark are dropped."""
    w = stream.withWatermark("ts", late).groupBy("key", F.window("ts", block).alias("w")).agg(F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return w.select("key", F.col("w.start").alias("start"), "n", "peak", "rms", dbfs(F.col("peak")).alias("peak_dbfs"), dbfs(F.col("rms")).alias("rms_dbfs"))


def stream_dropouts(stream: DataFrame, silent: float = 1e-3, gap: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """Sessions of sound by key, closed after ``gap`` without a sample above ``silent``: dropouts lie between them."""
    s = stream.where(F.abs("value") > silent).withWatermark("ts", late)
    w = s.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return w.select("key", F.col("w.start").alias("start"), "last", F.col("w.end").alias("silent_from"), "n")


class _Envelope(TimeOrdered):
    """Follows the magnitude of each key."""

    def __init__(self, attack: float, release: float, **times: Any):
        super().__init__({"value": "double"}, **times)
        self.rates = attack, release

    def begin(self) -> tuple:
        return (0.0,)

    def follow(self, key: Any, state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, Any]]:
        (e,), (up, down), out = state, self.rates, []
        for v in np.abs(rows["value"]).tolist():
            e += (up if v > e else down) * (v - e)
            out.append(e)
        return (e,), {"us": rows["us"], "envelope": out}


def stream_envelope(stream: DataFrame, attack: float = 0.01, release: float = 0.0001, late: str = "1 second", step: str = "1 second", idle: str = "1 day") -> DataFrame:
    """``(key, ts, envelope)``: the attack and release follower carried over the rows of a key in time order.

    Rows wait until the watermark, ``late`` behind the latest time seen, has passed the ``step`` they lie in; later ones
    and null values are dropped.  A key silent for more than ``idle`` starts anew.
    """
    rows = stream.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "value").where("value is not null")
    out = ordered_by_key(rows, _Envelope(attack, release, step=step, idle=idle), "us long, envelope double")
    return out.select("key", F.timestamp_micros("us").alias("ts"), "envelope")


class _ClipRuns(TimeOrdered):
    """Keeps each key's open run; it ends at a row below the threshold or after a silence."""

    def __init__(self, thr: float, least: int, **times: Any):
        super().__init__({"value": "double"}, **times)
        self.thr, self.least = thr, least

    def begin(self) -> tuple:
        return 0, 0, 0

    def _rows(self, runs: list[tuple]) -> dict[str, Any]:
        runs = [r for r in runs if r[2] >= self.least]
        return {c: [r[i] for r in runs] for i, c in enumerate(("start", "last", "n"))}

    def follow(self, key: Any, state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, Any]]:
        run, out = state, []
        for us, hit in zip(rows["us"].tolist(), (np.abs(rows["value"]) >= self.thr).tolist(), strict=True):
            if hit:
                run = (run[0], us, run[2] + 1) if run[2] else (us, us, 1)
            elif run[2]:
                out.append(run)
                run = self.begin()
        return run, self._rows(out)

    def end(self, key: Any, state: tuple) -> dict[str, Any]:
        return self._rows([state])


def stream_clip_runs(stream: DataFrame, thr: float = 0.99, min_run: int = 3, late: str = "1 second", step: str = "1 second", idle: str = "5 seconds") -> DataFrame:
    """``(key, start, last, n)`` of runs at or above ``thr`` in the time order of a key's rows.

    Rows wait until the watermark, ``late`` behind the latest time seen, has passed the ``step`` they lie in; later ones
    and null values are dropped.  A silence of more than ``idle`` ends a run.
    """
    rows = stream.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "value").where("value is not null")
    out = ordered_by_key(rows, _ClipRuns(thr, min_run, step=step, idle=idle), "start long, last long, n int")
    return out.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n")
