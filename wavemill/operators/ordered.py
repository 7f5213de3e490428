"""Operators that follow the order of samples: filters, runs, transients, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from wavemill.functions.scalar import amp_db
from wavemill.operators.blocks import BLOCK, CH, neighbours, with_halo, with_whole
from wavemill.operators.kernel import packed
from wavemill.operators.follower import Follower, greedy_exit, greedy_shape, greedy_taken


def pre_emphasis(samples: DataFrame, c: float = 0.97) -> DataFrame:
    """x less c times the sample before; the first stays."""
    n = neighbours(samples.select(*CH, "idx", "x"), "x", [-1])
    return n.select(*CH, "idx", F.when(F.col("x_m1").isNull(), F.col("x")).otherwise(F.col("x") - c * F.col("x_m1")).alias("x"))


def zero_crossing_rate(samples: DataFrame) -> DataFrame:
    n = neighbours(samples.select(*CH, "idx", "x"), "x", [-1])
    crossed = F.avg(F.when(F.col("x_m1").isNotNull(), ((F.col("x") >= 0) != (F.col("x_m1") >= 0)).cast("double")))
    return n.groupBy(*CH).agg(F.coalesce(crossed, F.lit(0.0)).alias("zcr"))


def to_blocks(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(track_id, ch, block_no, x array<double>)`` with samples in order."""
    b = F.floor(F.col("idx") / block).alias("block_no")
    packed = samples.groupBy(*CH, b).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    return packed.select(*CH, "block_no", F.transform("s", lambda e: e["x"]).alias("x"))


def from_blocks(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    return blocks.select(*CH, "block_no", F.posexplode("x").alias("i", "x")).select(*CH, (F.col("block_no") * block + F.col("i")).alias("idx"), "x")


class _Linear:
    """A linear recursive filter, ``step(x, state) -> (y, state)``, as matrix products over chunks of a block.

    Outputs and end states of all chunks from zero state are one product each; only the states at the chunks' starts
    are then followed, one small product for each chunk.
    """

    def __init__(self, step, order: int, chunk: int = 64):
        self.order, self.chunk = order, chunk
        free = np.array([self._response(step, np.zeros(chunk), e) for e in np.eye(order)], dtype=object)
        self.by_state = np.array([y for y, _ in free]).T
        self.power = np.array([s for _, s in free]).T
        hit = [self._response(step, e, np.zeros(order)) for e in np.eye(chunk)]
        self.by_input, self.into = np.array([y for y, _ in hit]), np.array([s for _, s in hit])
        self.one = np.array([step(0.0, e)[1] for e in np.eye(order)]).T

    @staticmethod
    def _response(step, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = []
        for v in x:
            out, s = step(v, s)
            y.append(out)
        return np.array(y), np.array(s)

    def _starts(self, ends: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.empty((len(ends) + 1, self.order))
        out[0] = s
        for i, e in enumerate(ends):
            out[i + 1] = self.power @ out[i] + e
        return out

    def _chunks(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, (-len(x) % self.chunk, 0)).reshape(-1, self.chunk)

    def end(self, x: np.ndarray) -> np.ndarray:
        """The state after a block from zero state; zeros put before it change nothing."""
        return self._starts(self._chunks(x) @ self.into, np.zeros(self.order))[-1]

    def output(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        whole = len(x) // self.chunk * self.chunk
        parts = x[:whole].reshape(-1, self.chunk)
        starts = self._starts(parts @ self.into, s)
        y = parts @ self.by_input + starts[:-1] @ self.by_state.T
        rest = x[whole:]
        tail = np.pad(rest, (0, self.chunk - len(rest))) @ self.by_input + self.by_state @ starts[-1]
        return np.concatenate([y.ravel(), tail[: len(rest)]])

    def carry(self, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """State before each block: the state after a block of n is the n-th power of one step on it, plus the block's own end."""
        s, out, powers = np.zeros(self.order), [], {}
        for n, e in zip(lengths.tolist(), ends, strict=True):
            out.append(s)
            if n not in powers:
                powers[n] = np.linalg.matrix_power(self.one, n)
            s = powers[n] @ s + e
        return np.array(out)


def _affine(blocks: DataFrame, step, order: int) -> DataFrame:
    """Apply a linear recursive filter exactly: blocks give their end from zero state, states are carried, blocks run from them.

    Blocks are independent but for their states, a few numbers each, which are scanned by channel.
    """
    f = _Linear(step, order)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[*CH, "block_no"]].assign(n=[len(x) for x in p.x], e=[f.end(np.asarray(x, float)).tolist() for x in p.x])

    def scan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block_no")
        return p[[*CH, "block_no"]].assign(s=f.carry(p.n.to_numpy(), np.array(p.e.tolist())).tolist())

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[*CH, "block_no"]].assign(x=[f.output(np.asarray(x, float), np.asarray(s, float)) for x, s in zip(p.x, p.s, strict=True)])

    kind = dict(blocks.dtypes)
    key = ", ".join(f"{c} {kind[c]}" for c in [*CH, "block_no"])
    states = blocks.mapInPandas(ends, f"{key}, n long, e array<double>").groupBy(*CH).applyInPandas(scan, f"{key}, s array<double>")
    return blocks.join(states, [*CH, "block_no"]).select(*CH, "block_no", "x", "s").mapInPandas(out, f"{key}, x array<double>")


def _carried(effects: DataFrame, by: str, start, step, name: str, schema: str) -> DataFrame:
    """What is carried into each block of ``effects(track_id, ch, by, ...)``: ``start`` at first, then ``step(carried, ...)`` of the block before.

    A task streams through its channels in order and holds one value, however many channels there are or long they be.
    """
    rest = [c for c in effects.columns if c not in (*CH, by)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, start
        for p in batches:
            given = []
            for track, ch, *effect in zip(*(p[c] for c in [*CH, *rest]), strict=True):
                if (track, ch) != key:
                    key, now = (track, ch), start
                given.append(now)
                now = step(now, *effect)
            yield p[[*CH, by]].assign(**{name: given})

    return effects.repartition(*CH).sortWithinPartitions(*CH, by).mapInPandas(run, schema)


def de_emphasis(blocks: DataFrame, c: float = 0.97) -> DataFrame:
    """y = x + c times the y before, exact across blocks."""

    def step(x: float, s: np.ndarray):
        y = x + c * s[0]
        return y, [y]

    return _affine(blocks, step, 1)


def k_coefficients(rate: float) -> list[tuple[list[float], list[float]]]:
    """Biquads of loudness weighting: fixed at 48 kHz, by design formulas at other rates."""
    if abs(rate - 48_000) < 1:
        # Fixed values of the published loudness filter at 48 kHz.
        return [([1.53512485958697, -2.69169618940638, 1.19839281085285], [1.0, -1.69065929318241, 0.73248077421585]), ([1.0, -2.0, 1.0], [1.0, -1.99004745483398, 0.99007225036621])]
    # Shelf frequency, gain and quality, then high-pass frequency.
    f0, gain, q, f1 = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 38.13547087602444
    amp, w = 10 ** (gain / 40), 2 * math.pi * f0 / rate
    cos, side = math.cos(w), 2 * math.sqrt(amp) * math.sin(w) / (2 * q)
    up, down = amp + 1, amp - 1
    shelf_b = [amp * (up + down * cos + side), -2 * amp * (down + up * cos), amp * (up + down * cos - side)]
    shelf_a = [up - down * cos + side, 2 * (down - up * cos), up - down * cos - side]
    w = 2 * math.pi * f1 / rate
    cos, alpha = math.cos(w), math.sin(w) / math.sqrt(2)
    high_b, high_a = [(1 + cos) / 2, -(1 + cos), (1 + cos) / 2], [1 + alpha, -2 * cos, 1 - alpha]
    return [([v / a[0] for v in b], [v / a[0] for v in a]) for b, a in ((shelf_b, shelf_a), (high_b, high_a))]


def k_weight(blocks: DataFrame, rate: float) -> DataFrame:
    """Loudness weighting: two cascaded second-order filters, exact across blocks."""
    (b1, a1), (b2, a2) = k_coefficients(rate)

    def step(x: float, s: np.ndarray):
        p, q, r, t = s
        u = b1[0] * x + p
        w = b2[0] * u + r
        return w, [b1[1] * x - a1[1] * u + q, b1[2] * x - a1[2] * u, b2[1] * u - a2[1] * w + t, b2[2] * u - a2[2] * w]

    return _affine(blocks, step, 4)


def envelope(blocks: DataFrame, attack: float = 0.01, release: float = 0.0001, smooth: int = 0, block: int = BLOCK) -> DataFrame:
    """Peak follower: moves towards the magnitude at one rate up and another down; then, if asked, the mean of ``smooth`` samples.

    No block waits for another.  Each tells where it leaves from the lowest and from the highest level its channel can
    have; so the level that its successor starts from lies between two close bounds, and for these the successor
    gives its whole effect on the level, a few numbers.  The levels at all starts are then carried over those
    numbers, and blocks run from them.  ``block`` is the size of the blocks, which smoothing needs.
    """
    f = Follower(attack, release)
    kind = dict(blocks.dtypes)
    key = ", ".join(f"{c} {kind[c]}" for c in [*CH, "block_no"])
    blocks = blocks.select(*CH, "block_no", F.transform("x", F.abs).alias("x"))
    # The highest magnitude of a channel meets its blocks by block, so that no channel's samples are dealt to one task.
    tops = blocks.select(*CH, "block_no", F.max(F.array_max("x")).over(W.partitionBy(*CH)).alias("top"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = f.all_ends(p.x.tolist(), p.top.tolist())
            yield p[[*CH, "block_no"]].assign(low=got[:, 0], high=got[:, 1])

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = f.all_shapes(p.x.tolist(), p.low.tolist(), p.high.tolist())
            yield p[[*CH, "block_no"]].assign(at=[g[0].tolist() for g in got], to=[g[1].tolist() for g in got])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[*CH, "block_no"]].assign(x=f.all_output(p.x.tolist(), p.level.tolist()))

    before = W.partitionBy(*CH).orderBy("block_no")
    bounds = blocks.join(tops, [*CH, "block_no"]).mapInPandas(ends, f"{key}, low double, high double")
    bounds = bounds.select(*CH, "block_no", *(F.coalesce(F.lag(c).over(before), F.lit(0.0)).alias(c) for c in ("low", "high")))
    effects = blocks.join(bounds, [*CH, "block_no"]).mapInPandas(shapes, f"{key}, at array<double>, to array<double>")
    levels = _carried(effects, "block_no", 0.0, lambda level, at, to: float(np.interp(level, at, to)), "level", f"{key}, level double")
    out = blocks.join(levels, [*CH, "block_no"]).mapInPandas(run, f"{key}, x array<double>")
    if not smooth:
        return out
    # Dealt by block, so that the counts of a channel that smoothing joins do not keep it in one task.
    smoothed = moving_average(from_blocks(out, block), smooth).withColumn("block_no", F.floor(F.col("idx") / block)).repartition(*CH, "block_no")
    packed = smoothed.groupBy(*CH, "block_no").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    return packed.select(*CH, "block_no", F.transform("s", lambda e: e["x"]).alias("x"))


def moving_average(samples: DataFrame, w: int) -> DataFrame:
    """Mean of a window of w samples around each, with part windows at the head and tail.

    Channels shorter than w stay.  For an even w the middle windows hold w + 1 samples less sample w of
    the channel, over w: what a running sum gives that starts at w samples and steps half a window ahead.
    """
    if w <= 0:
        return samples.select(*CH, "idx", "x")
    h = w // 2
    near = with_halo(samples.select(*CH, "idx", "x"), h, h, max(BLOCK, h))
    near = with_whole(near, CH, {"n": (F.sum, F.lit(1)), "fixed": (F.max, F.when(F.col("idx") == 2 * h, F.col("x")))})
    near = near.withColumn("span", F.sum("x").over(W.partitionBy(*CH, "__b").orderBy("idx").rowsBetween(-h, h)))
    near = near.where(F.col("__b") == F.col("__own"))
    left, right = F.least(F.col("idx"), F.lit(h)), F.least(F.col("n") - 1 - F.col("idx"), F.lit(h))
    mean = F.col("span") / (left + right + 1)
    if w % 2 == 0:
        mean = F.when((F.col("idx") >= h) & (F.col("idx") < F.col("n") - h), (F.col("span") - F.col("fixed")) / w).otherwise(mean)
    return near.select(*CH, "idx", F.when(F.col("n") < w, F.col("x")).otherwise(mean).alias("x"))


def clip_runs(samples: DataFrame, thr: float = 0.99, min_run: int = 3, block: int = BLOCK) -> DataFrame:
    """``(track_id, ch, start, end, n)`` of maximal runs at or above ``thr``, end exclusive.

    Islands are found within blocks first; those that touch at block edges are joined on the few
    block-level rows.
    """
    hit = samples.where(F.abs("x") >= thr).select(*CH, "idx", F.floor(F.col("idx") / block).alias("b"))
    w = W.partitionBy(*CH, "b").orderBy("idx")
    isles = hit.withColumn("g", F.col("idx") - F.row_number().over(w)).groupBy(*CH, "b", "g").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))
    inner = (F.col("start") % block != 0) & (F.col("end") % block != 0)
    edge = isles.where(~inner)
    o = W.partitionBy(*CH).orderBy("start")
    fresh = F.coalesce((F.lag("end").over(o) != F.col("start")).cast("int"), F.lit(1))
    joined = edge.withColumn("f", fresh).withColumn("k", F.sum("f").over(o)).groupBy(*CH, "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = isles.where(inner).select(*CH, "start", "end").unionByName(joined.select(*CH, "start", "end"))
    return runs.withColumn("n", F.col("end") - F.col("start")).where(F.col("n") >= min_run)


def intersample_peaks(samples: DataFrame, thr: float = 0.99) -> DataFrame:
    """Triples whose parabola peaks above 1 between samples that stay below ``thr``."""
    n = neighbours(samples.select(*CH, "idx", "x"), "x", [-1, 1])
    a, b, c = F.col("x_m1"), F.col("x"), F.col("x_p1")
    off = F.try_divide(a - c, 2 * (a - 2 * b + c))
    peak = b - 0.25 * (a - c) * off
    return n.groupBy(*CH).agg(F.count_if((F.abs(off) < 1) & (F.abs(peak) > 1) & (F.abs(b) < thr)).alias("peaks"))


def temporal_histogram(regions: DataFrame, tracks: DataFrame, bins: int = 100) -> DataFrame:
    """``(track_id, ch, bin, value)``: regions that touch each of ``bins`` equal parts of a channel, over the largest.

    ``tracks`` has ``(track_id, ch, n)``; bins without regions have no row.
    """
    w = F.col("n_all") / bins
    r = regions.join(tracks.select(*CH, F.col("n").cast("double").alias("n_all")), CH)
    first, last = F.floor(F.col("start") / w), F.least(F.ceil(F.col("end") / w), F.lit(bins)) - 1
    hits = r.where(first <= last).select(*CH, F.explode(F.sequence(first, last)).alias("bin")).groupBy(*CH, "bin").agg(F.count(F.lit(1)).alias("c"))
    return hits.select(*CH, F.col("bin").cast("int").alias("bin"), (F.col("c") / F.max("c").over(W.partitionBy(*CH))).alias("value"))


def frame_boundary_rate(samples: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The frame size at whose boundaries samples jump most often; of equal rates the first size."""
    n = neighbours(samples.select(*CH, "idx", "x"), "x", [-1])
    total = samples.groupBy(*CH).agg(F.count(F.lit(1)).alias("n"))
    d = n.select(*CH, "idx", F.abs(F.col("x") - F.col("x_m1")).alias("d")).where("d > 0.01")
    size = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("size")) for i, s in enumerate(sizes)]))
    at = d.select("*", size.alias("s")).where((F.col("idx") % F.col("s.size") == 0) & (F.col("idx") > 0))
    per = at.groupBy(*CH, "s").agg(F.count(F.lit(1)).alias("hits"), F.avg("d").alias("mean")).join(total, CH)
    per = per.withColumn("rate", F.try_divide(F.col("hits"), F.floor(F.col("n") / F.col("s.size"))))
    best = F.row_number().over(W.partitionBy(*CH).orderBy(F.desc("rate"), "s.k"))
    return per.withColumn("o", best).where("o = 1").select(*CH, F.col("s.size").alias("frame_size"), "hits", F.col("mean").alias("mean_jump"), "rate")


def autocorrelation(samples: DataFrame, max_lag: int, block: int = BLOCK) -> DataFrame:
    """``(track_id, ch, lag, r)`` over the energy; 0 for silence.

    Each block is correlated with itself and the ``max_lag`` samples after it by padded transforms; the results are summed over blocks.
    """

    def correlate(x: np.ndarray) -> tuple[int, np.ndarray]:
        own = x[:size]
        n = 1 << (len(own) + max_lag).bit_length()
        r = np.fft.irfft(np.conj(np.fft.rfft(own, n)) * np.fft.rfft(x, n), n)[: max_lag + 1]
        r[0] = own @ own
        return len(own), r

    size = max(block, max_lag)
    parts = packed(samples, size, max_lag, correlate, (StructField("n", LongType()), StructField("r", ArrayType(DoubleType()))))
    sums = parts.select(*CH, "n", F.posexplode("r").alias("lag", "s")).groupBy(*CH, "lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    energy = sums.where("lag = 0").select(*CH, F.col("s").alias("e"))
    r = F.when(F.col("e") < 1e-10, 0.0).otherwise(F.col("s") / F.col("e"))
    return sums.where("lag < n").join(energy, CH).select(*CH, "lag", r.alias("r"))


def downsample_mean(samples: DataFrame, factor: int) -> DataFrame:
    return samples.groupBy(*CH, F.floor(F.col("idx") / factor).alias("idx")).agg(F.avg("x").alias("x"))


def sinc_weights(factor: int, taps: int) -> np.ndarray:
    """(2 * taps + 1, factor - 1): weight of the sample o - taps places from the one at or before an output, for each phase."""
    o, phase = np.arange(-taps, taps + 1)[:, None], np.arange(1, factor)[None, :]
    t = phase / factor - o
    return np.where(np.abs(t) <= taps, np.sinc(t) * 0.5 * (1 + np.cos(np.pi * t / taps)), 0.0)


def upsample_sinc(samples: DataFrame, factor: int, taps: int = 32, gain: str = "unity", block: int = BLOCK) -> DataFrame:
    """Windowed-sinc interpolation: originals are kept, others are weighted means of 2 * taps neighbours.

    ``gain`` is ``unity``, or ``reference`` for ``factor`` times that.  A block with ``taps`` samples more at both
    sides is one product with the weights of all phases.
    """
    w, block = sinc_weights(factor, taps), max(block, taps)
    scale = float(factor) if gain == "reference" else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for track, ch, b, first, x in zip(p["track_id"], p["ch"], p["b"], p["first"], p["x"], strict=True):
                x = np.asarray(x, float)
                low = int(b * block - first)
                high = min(len(x), low + block)
                # Missing samples count nowhere: neither in the sums nor in the weights.
                padded, there = (np.pad(v, taps) for v in (x, np.ones(len(x))))
                for s in range(low, high, 8192):
                    e = min(s + 8192, high)
                    near, has = (np.lib.stride_tricks.sliding_window_view(v[s : e + 2 * taps], 2 * taps + 1) for v in (padded, there))
                    total = has @ np.abs(w)
                    y = np.where(total > 1e-10, near @ w / np.where(total > 1e-10, total, 1) * scale, 0.0)
                    out = np.concatenate([x[s:e, None], y], axis=1).ravel()
                    yield pd.DataFrame({"track_id": track, "ch": ch, "idx": (first + s) * factor + np.arange(len(out)), "x": out})

    spread = with_halo(samples.select(*CH, "idx", "x"), taps, taps, block)
    packed = spread.groupBy(*CH, F.col("__b").alias("b")).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    rows = packed.where(F.exists("s", lambda e: F.floor(e["idx"] / block) == F.col("b")))
    rows = rows.select(*CH, "b", F.col("s")[0]["idx"].alias("first"), F.transform("s", lambda e: e["x"]).alias("x"))
    kind = dict(samples.dtypes)
    return rows.mapInPandas(run, f"track_id {kind['track_id']}, ch {kind['ch']}, idx long, x double")


def true_peak(samples: DataFrame, taps: int = 16, gain: str = "unity") -> DataFrame:
    """Sample peak and four-times oversampled peak in decibels, and interpolated values over 1."""
    up = upsample_sinc(samples, 4, taps, gain)
    new = F.col("idx") % 4 != 0
    a = up.groupBy(*CH).agg(F.max(F.when(~new, F.abs("x"))).alias("p"), F.max(F.abs("x")).alias("t"), F.count_if(new & (F.abs("x") > 1)).alias("overs"))
    db = lambda c: F.when(F.col(c) > 0, F.greatest(F.lit(-100.0), 20 * F.log10(c))).otherwise(-100.0)
    return a.select(*CH, db("p").alias("sample_peak_db"), db("t").alias("true_peak_db"), "overs")


def _greedy(candidates: DataFrame, min_distance: int) -> DataFrame:
    """Of candidates ``(track_id, ch, pos)`` in order, those more than ``min_distance`` after the last taken (0 at first).

    In a block each candidate points to the first one beyond its distance; where the chains of pointers leave the block, by
    where they enter it, is a few numbers.  The last one taken before each block is carried over these, and blocks
    follow their own chain from it.  A run of near candidates may so lie in any number of tasks.
    """
    span = max(BLOCK, 16 * min_distance)
    kind = dict(candidates.dtypes)
    key = ", ".join(f"{c} {kind[c]}" for c in CH)
    blocks = candidates.groupBy(*CH, F.floor(F.col("pos") / span).alias("b")).agg(F.array_sort(F.collect_list(F.col("pos").cast("long"))).alias("p"))

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            got = [greedy_shape(np.asarray(p, np.int64), min_distance) for p in t["p"]]
            yield t[[*CH, "b"]].assign(end=[p[-1] for p in t["p"]], bounds=[g[0].tolist() for g in got], exits=[g[1].tolist() for g in got])

    def leave(last: int, end: int, bounds: np.ndarray, exits: np.ndarray) -> int:
        return greedy_exit(np.asarray(bounds), np.asarray(exits), int(end), last, min_distance)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            taken = [greedy_taken(np.asarray(p, np.int64), last, min_distance) for p, last in zip(t["p"], t["last"], strict=True)]
            yield t[CH].loc[np.repeat(t.index, [len(x) for x in taken])].assign(pos=np.concatenate(taken) if taken else [])

    effects = blocks.mapInPandas(shapes, f"{key}, b long, end long, bounds array<long>, exits array<long>")
    carried = _carried(effects, "b", 0, leave, "last", f"{key}, b long, last long")
    return blocks.join(carried, [*CH, "b"]).mapInPandas(follow, f"{key}, pos {kind['pos']}")


def find_transients(env: DataFrame, threshold: float, min_distance: int, mode: str = "rise", hop: int = 32) -> DataFrame:
    """``(track_id, ch, pos)`` from envelope samples: ``rise`` of ``hop`` maxima in decibels, or a ``step`` between samples.

    The rise form is meant for an envelope smoothed over 64 samples, ``envelope(..., smooth=64)``.
    """
    if mode == "step":
        n = neighbours(env.select(*CH, "idx", "x"), "x", [-1])
        return _greedy(n.where(F.col("x") - F.col("x_m1") > threshold).select(*CH, F.col("idx").alias("pos")), min_distance)
    h = env.groupBy(*CH, F.floor(F.col("idx") / hop).alias("h")).agg(F.max(amp_db(F.col("x"))).alias("m"), F.count(F.lit(1)).alias("n"))
    h = neighbours(h, "m", [-1], at="h", wholes={"total": (F.sum, F.col("n"))})
    rise = h.where((F.col("m") - F.col("m_m1") > threshold) & (F.col("h") * hop < F.col("total") - hop))
    return _greedy(rise.select(*CH, (F.col("h") * hop).alias("pos")), min_distance)


def pre_echo_events(samples: DataFrame, transients: DataFrame, window: int, least: int = 4096) -> DataFrame:
    """Energy before each transient over that after it, and how many transients show an echo before.

    Each transient is matched with the samples of its two windows through the blocks of ``window`` they lie in.
    """
    t = transients.where(F.col("pos") > window).select(*CH, "pos")
    cells = t.withColumn("c", F.explode(F.sequence(F.floor((F.col("pos") - window) / window), F.floor((F.col("pos") + window - 1) / window))))
    s = samples.select(*CH, "idx", "x", F.floor(F.col("idx") / window).alias("c"))
    m = s.join(cells, [*CH, "c"]).where((F.col("idx") >= F.col("pos") - window) & (F.col("idx") < F.col("pos") + window))
    before = F.col("idx") < F.col("pos")
    e = F.col("x") * F.col("x")
    r = m.groupBy(*CH, "pos").agg(F.avg(F.when(before, e)).alias("pre"), F.avg(F.when(~before, e)).alias("post"), F.max(F.when(~before, F.abs("x"))).alias("amplitude"))
    r = r.withColumn("ratio", F.when(F.col("post") > 1e-10, F.col("pre") / F.col("post")).otherwise(0.0))
    echo = (F.col("ratio") > 0.01) & (F.col("ratio") < 0.3)
    long_enough = samples.groupBy(*CH).count().where(F.col("count") >= least).select(*CH)
    found = r.groupBy(*CH).agg(F.count_if(echo).alias("echoes"), F.avg(F.when(echo, F.col("ratio"))).alias("level"))
    all_ = transients.groupBy(*CH).agg(F.count(F.lit(1)).alias("transients")).join(long_enough, CH, "left_semi")
    a = all_.join(found, CH, "left").select(*CH, "transients", F.coalesce("echoes", F.lit(0)).alias("echoes"), F.coalesce("level", F.lit(0.0)).alias("level"))
    return a.withColumn("score", F.col("echoes") / F.col("transients")).withColumn("evidence", F.col("score") > 0.3)
