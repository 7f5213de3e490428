"""Frames of long channels by blocks: strided views of a block and its halo, worked on in batches.

Each sample is dealt once, with its block, and a second time if the block before needs it for its last frames; frames are views of
the block's samples and are never rows of samples.  What is made of them, as a transform, comes in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from wavemill.functions.windows import window_array
from wavemill.operators.blocks import BLOCK, CH, with_halo

#: Values of frames held at once, and bins up to which a table of sines beats the whole transform.
HELD, FEW = 1 << 22, 64
#: Frames whose sums a task holds before it hands them on.
OPEN = 1 << 13
Make = Callable[[np.ndarray], np.ndarray]


def _edges(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any column; nulls are equal."""
    n = len(columns[0])
    out = np.zeros(max(0, n - 1), bool)
    for c in columns:
        differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        null = pc.is_null(c).to_numpy(zero_copy_only=False)
        out |= differ.astype(bool) | (null[1:] != null[:-1])
    return np.flatnonzero(out) + 1


def packed(samples: DataFrame, block: int = BLOCK, ahead: int = 0, make: Callable[[np.ndarray], tuple] | None = None, columns: tuple[StructField, ...] = ()) -> DataFrame:
    """``(track_id, ch, block_no, x)``: the samples of each block in order and up to ``ahead`` of those that follow.

    With ``make``, ``(track_id, ch, block_no, columns)`` of what it gives for a block: a task then holds one block, where
    a table of blocks would come to the next step in batches of many.
    """
    rows = with_halo(samples.select(*CH, "idx", "x"), 0, ahead, block).select(*CH, F.col("__b").alias("block_no"), "idx", "x")
    rows = rows.repartition(*CH, "block_no").sortWithinPartitions(*CH, "block_no", "idx").drop("idx")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> pa.RecordBatch:
            x = np.concatenate(parts)
            made = (x,) if make is None else make(x)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) if isinstance(v, np.ndarray) else pa.array([v]) for v in made]
            return pa.record_batch([*key, *lists], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            keys, x = [b.column(i) for i in range(3)], b.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *_edges(keys).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                now = [c.slice(low, 1) for c in keys]
                if key is not None and any(not a.equals(c) for a, c in zip(key, now, strict=True)):
                    yield close()
                    parts = []
                key = now
                parts.append(x[low:high].copy())
        if key is not None:
            yield close()

    fields = columns if make else (StructField("x", ArrayType(DoubleType())),)
    names = [*CH, "block_no", *(f.name for f in fields)]
    return rows.mapInArrow(pack, StructType([*(rows.schema[c] for c in [*CH, "block_no"]), *fields]))


def framed(
    samples: DataFrame, size: int, hop: int, make: Make, out: str, plan: str = "hop", count: int = 40, length: int | None = None, most: int | None = None, block: int = BLOCK
) -> DataFrame:
    """``(track_id, ch, frame_no, start_idx, out)``: what ``make`` gives for frames of ``size`` samples, a row for a row.

    ``hop``: frames each ``hop`` samples, at most ``most`` of them.  ``spread``: ``count`` frames evenly over channels
    of two frames and more.  A frame counts if the ``length`` samples from its start, ``size`` if not given, are there.
    """
    reach = length or size
    block = max(block, reach)
    if plan == "hop" and most is not None:
        # Samples beyond the last frame are in none.
        samples = samples.where(F.col("idx") < (most - 1) * hop + reach)
    blocks = packed(samples, block, reach - 1)
    if plan != "hop":
        total = samples.groupBy(*CH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * size)
        blocks = blocks.join(total, CH)
    else:
        blocks = blocks.withColumn("n", F.lit(0).cast("long"))

    def starts(block_no: int, here: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and places of the frames that start in a block, of which so many samples are there."""
        base, own = block_no * block, min(here, block)
        step, last = (hop, most) if plan == "hop" else ((n - size) // count, count)
        if step == 0:
            number = np.arange(count) if block_no == 0 else np.arange(0)
        else:
            number = np.arange(-(-base // step), (base + own - 1) // step + 1)
        number = number[: None if last is None else max(0, last - int(number[0]))] if len(number) else number
        place = number * step - base
        fits = place + reach <= here
        return number[fits], place[fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(3)[i].values.to_numpy(zero_copy_only=False)
                block_no = b.column(2)[i].as_py()
                number, place = starts(block_no, len(x), b.column(4)[i].as_py())
                if not len(number):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(x, size)
                some = max(1, HELD // size)
                for low in range(0, len(number), some):
                    at = place[low : low + some]
                    made = np.ascontiguousarray(make(view[at]), float)
                    m, width = made.shape
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * width, pa.int32()), pa.array(made.ravel()))
                    same = [b.column(c).slice(i, 1).take(pa.array(np.zeros(m, np.int64))) for c in (0, 1)]
                    yield pa.record_batch([*same, pa.array(number[low : low + some]), pa.array(at + block_no * block), lists], names=[*CH, "frame_no", "start_idx", out])

    schema = StructType([*(blocks.schema[c] for c in CH), StructField("frame_no", LongType()), StructField("start_idx", LongType()), StructField(out, ArrayType(DoubleType()))])
    return blocks.mapInArrow(run, schema)


def magnitudes(size: int, window: str = "hann", sym: bool = True, bins: tuple[int, int] | None = None) -> Make:
    """Magnitudes of the transform's bins from ``bins[0]`` up to ``bins[1]``, all of them if not given.

    Few bins are products with a table of their sines, many a whole transform of which the rest is dropped.
    """
    shape = window_array(window, size, sym)
    low, high = bins or (0, size // 2 + 1)
    if high - low <= FEW:
        angle = 2 * np.pi * ((np.arange(size)[:, None] * np.arange(low, high)) % size) / size
        cos, sin = np.cos(angle) * shape[:, None], np.sin(angle) * shape[:, None]
        return lambda frames: np.hypot(frames @ cos, frames @ sin)
    return lambda frames: np.abs(np.fft.rfft(frames * shape, axis=1))[:, low:high]


@lru_cache(maxsize=2)
def _waves(size: int, window: str, sym: bool, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of some bins under a window, a row for each sample of a frame."""
    angle = 2 * np.pi * ((np.arange(size)[:, None] * np.arange(low, high)) % size) / size
    shape = window_array(window, size, sym)[:, None]
    return np.cos(angle) * shape, np.sin(angle) * shape


def summed_bins(samples: DataFrame, size: int, hop: int, bins: tuple[int, int], window: str = "hann", sym: bool = False, length: int | None = None) -> DataFrame:
    """``(track_id, ch, frame_no, k, mag)`` of a few bins of the frames each ``hop`` samples, as ``framed`` with ``magnitudes``.

    A bin is a sum over samples, so tasks add up what they hold of a frame wherever samples lie, and only these sums are
    shuffled.  Samples may come in any order; the closer neighbours lie, the fewer sums there are.
    """
    reach = length or size
    low, high = bins

    def touched(idx: np.ndarray) -> list[int]:
        """Numbers of the frames that hold any of some samples in order."""
        near = np.unique(idx // hop)
        back = np.arange((reach - 1) // hop + 1)
        numbers = np.unique(near[:, None] - back)
        starts = numbers[numbers >= 0] * hop
        held = np.searchsorted(idx, starts + reach) > np.searchsorted(idx, starts)
        return (starts[held] // hop).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cos, sin = _waves(size, window, sym, low, high)
        sums, types = {}, []

        def flush() -> pa.RecordBatch:
            keys, found = list(sums), list(sums.values())
            sums.clear()
            wide = pa.array(np.arange(len(keys) + 1) * (high - low), pa.int32())
            lists = [pa.ListArray.from_arrays(wide, pa.array(np.concatenate([f[i] for f in found]))) for i in (1, 2)]
            cols = [pa.array([k[0] for k in keys], types[0]), pa.array([k[1] for k in keys], types[1]), pa.array([k[2] for k in keys], pa.int64()), pa.array([f[0] for f in found], pa.int64())]
            return pa.record_batch([*cols, *lists], names=[*CH, "frame_no", "held", "re", "im"])

        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(i).type for i in (0, 1)]
            track, ch = (b.column(i).dictionary_encode(null_encoding="encode") for i in (0, 1))
            code = track.indices.to_numpy().astype(np.int64) * len(ch.dictionary) + ch.indices.to_numpy()
            idx, x = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            step = np.diff(code)
            if not ((step > 0) | ((step == 0) & (np.diff(idx) > 0))).all():
                order = np.lexsort((idx, code))
                code, idx, x = code[order], idx[order], x[order]
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                t, c = divmod(int(code[first]), len(ch.dictionary))
                key = (track.dictionary[t].as_py(), ch.dictionary[c].as_py())
                own, values = idx[first:last], x[first:last]
                for f in touched(own):
                    a, m, e = np.searchsorted(own, (f * hop, f * hop + size, f * hop + reach)).tolist()
                    m = min(m, e)
                    if m > a and own[m - 1] - own[a] == m - 1 - a:
                        at = slice(int(own[a]) - f * hop, int(own[m - 1]) - f * hop + 1)
                    else:
                        at = own[a:m] - f * hop
                    had = sums.get((*key, f))
                    if had is None:
                        had = sums[(*key, f)] = [0, np.zeros(high - low), np.zeros(high - low)]
                    had[0] += e - a
                    had[1] += values[a:m] @ cos[at]
                    had[2] += values[a:m] @ sin[at]
                    if len(sums) >= OPEN:
                        yield flush()
        if sums:
            yield flush()

    rows = samples.select(*CH, F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"))
    lists = [StructField(n, ArrayType(DoubleType())) for n in ("re", "im")]
    pieces = rows.mapInArrow(run, StructType([*(rows.schema[c] for c in CH), StructField("frame_no", LongType()), StructField("held", LongType()), *lists]))
    parts = pieces.select(*CH, "frame_no", "held", F.posexplode(F.arrays_zip("re", "im")).alias("k", "part"))
    bins_of = parts.groupBy(*CH, "frame_no", "k").agg(F.sum("held").alias("held"), F.sum("part.re").alias("re"), F.sum("part.im").alias("im"))
    return bins_of.where(F.col("held") == reach).select(*CH, "frame_no", (F.col("k") + low).alias("k"), F.hypot("re", "im").alias("mag"))
