"""Mel filterbanks, cepstra, their statistics, fingerprints and similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.operators.blocks import neighbours, numbered

PRESETS = {
    "default": {"n_mels": 40, "n_mfcc": 13, "size": 2048, "hop": 512, "f_min": 20.0, "f_max": 0.0},
    "codec": {"n_mels": 64, "n_mfcc": 20, "size": 4096, "hop": 1024, "f_min": 20.0, "f_max": 0.0},
    "fingerprint": {"n_mels": 40, "n_mfcc": 13, "size": 2048, "hop": 512, "f_min": 300.0, "f_max": 8000.0},
}
LIFTER = 22


def _mel(hz: float) -> float:
    return 2595 * math.log10(1 + hz / 700)


def mel_filterbank(spark: SparkSession, n_mels: int, size: int, rate: float, f_min: float = 20.0, f_max: float = 0.0) -> DataFrame:
    """``(m, k, w)``: the non-zero weights of triangular filters; a table fixed by the arguments."""
    top = f_max or rate / 2
    edges = [700 * (10 ** ((_mel(f_min) + (_mel(top) - _mel(f_min)) * i / (n_mels + 1)) / 2595) - 1) * size / rate for i in range(n_mels + 2)]
    rows = []
    for m in range(n_mels):
        a, b, c = edges[m : m + 3]
        for k in range(size // 2 + 1):
            w = (k - a) / (b - a) if a <= k <= b and b - a > 1e-10 else (c - k) / (c - b) if b < k <= c and c - b > 1e-10 else 0.0
            if w > 0:
                rows.append((m, k, w))
    return spark.createDataFrame(rows, "m int, k int, w double")


def mel_energies(spectra: DataFrame, bank: DataFrame, n_mels: int) -> DataFrame:
    """``(track_id, frame_no, m, e)``: filtered power; filters without a bin have energy 0."""
    e = spectra.join(F.broadcast(bank), "k").groupBy("track_id", "frame_no", "m").agg(F.sum(F.col("mag") * F.col("mag") * F.col("w")).alias("e"))
    frames = spectra.select("track_id", "frame_no").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n_mels - 1))))
    return frames.join(e, ["track_id", "frame_no", "m"], "left").select("track_id", "frame_no", "m", F.coalesce("e", F.lit(0.0)).alias("e"))


def dct_table(spark: SparkSession, n_mels: int, n_mfcc: int, lifter: int = LIFTER) -> DataFrame:
    """``(c, m, d)``: an orthonormal cosine transform, liftered."""
    rows = []
    for c in range(n_mfcc):
        scale = math.sqrt((1 if c == 0 else 2) / n_mels) * (1 + lifter / 2 * math.sin(math.pi * c / lifter))
        rows += [(c, m, scale * math.cos(math.pi * c * (2 * m + 1) / (2 * n_mels))) for m in range(n_mels)]
    return spark.createDataFrame(rows, "c int, m int, d double")


def mfcc(spectra: DataFrame, rate: float, size: int, n_mels: int = 40, n_mfcc: int = 13, f_min: float = 20.0, f_max: float = 0.0) -> DataFrame:
    """``(track_id, frame_no, c, v)`` from magnitudes: two products with small sparse matrices, as joins."""
    spark = spectra.sparkSession
    e = mel_energies(spectra, mel_filterbank(spark, n_mels, size, rate, f_min, f_max), n_mels)
    logs = e.withColumn("l", F.log(F.greatest("e", F.lit(1e-10))))
    return logs.join(F.broadcast(dct_table(spark, n_mels, n_mfcc)), "m").groupBy("track_id", "frame_no", "c").agg(F.sum(F.col("l") * F.col("d")).alias("v"))


def deltas(m: DataFrame, n: int = 2, value: str = "v") -> DataFrame:
    """``(track_id, frame_no, c, v)``: slopes over n frames to both sides, ends held.

    Frames are numbered and met in blocks, so no window spans a track.
    """
    keys = ["track_id", "c"]
    placed = numbered(m.select(*keys, "frame_no", F.col(value).alias("v")), keys, ["frame_no"], F.floor(F.col("frame_no") / 4096))
    ends = m.groupBy(*keys).agg(F.min_by(value, "frame_no").alias("first"), F.max_by(value, "frame_no").alias("last"))
    near = neighbours(placed, "v", [o for o in range(-n, n + 1) if o], keys=keys).join(ends, keys)
    total = F.lit(0.0)
    for k in range(1, n + 1):
        total = total + k * (F.coalesce(F.col(f"v_p{k}"), F.col("last")) - F.coalesce(F.col(f"v_m{k}"), F.col("first")))
    return near.select("track_id", "frame_no", "c", (total / (2.0 * sum(k * k for k in range(1, n + 1)))).alias("v"))


def mfcc_stats(m: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """``(track_id, c, mean, std, skew, kurt, delta_mean, delta_std)``: population moments, excess kurtosis."""
    s = F.stddev_pop("v")
    a = m.groupBy("track_id", "c").agg(
        F.avg("v").alias("mean"), s.alias("std"), F.when(F.pow(s, F.lit(3.0)) < 1e-15, 0.0).otherwise(F.skewness("v")).alias("skew"), F.when(F.pow(s, F.lit(4.0)) < 1e-15, 0.0).otherwise(F.kurtosis("v")).alias("kurt")
    )
    if d is None:
        return a.withColumns({"delta_mean": F.lit(None).cast("double"), "delta_std": F.lit(None).cast("double")})
    return a.join(d.groupBy("track_id", "c").agg(F.avg("v").alias("delta_mean"), F.stddev_pop("v").alias("delta_std")), ["track_id", "c"], "left")


def fingerprint(stats: DataFrame) -> DataFrame:
    """``(track_id, features, dimension)``: the statistics of all coefficients, one kind after the other."""
    names = ["mean", "std", "skew", "kurt", "delta_mean", "delta_std"]
    packed = stats.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("c", *names))).alias("s"))
    f = F.concat(*[F.array_compact(F.transform("s", _field(n))) for n in names])
    return packed.select("track_id", f.alias("features"), F.size(f).alias("dimension"))


def _field(name: str):
    return lambda x: x[name]


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """Of two columns of vectors; 0 where lengths differ or a vector is zero."""
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (na < 1e-15) | (nb < 1e-15), 0.0).otherwise(_dot(a, b) / (na * nb))


def euclid(a: str, b: str) -> Column:
    """Of two columns of vectors; infinite where lengths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(F.sqrt(d))


def _dealt(a: DataFrame, b: DataFrame, block: int):
    """Both sides of rows ``(id, v)`` cogrouped by pairs of blocks, every row of ``a`` with every row of ``b`` once."""
    left, right = (x.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v")) for x in (a, b))
    m, n = (-(-x.count() // block) or 1 for x in (left, right))
    mine, other = (lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    left, right = left.select("id", "v", mine(m).alias("i"), other(n).alias("j")), right.select("id", "v", mine(n).alias("j"), other(m).alias("i"))
    return left.groupBy("i", "j").cogroup(right.select("id", "v", "i", "j").groupBy("i", "j"))


def _ids(a: DataFrame, b: DataFrame) -> str:
    return f"a_id {a.schema['id'].dataType.simpleString()}, b_id {b.schema['id'].dataType.simpleString()}"


#: Rows of a block that meet the other block at once.
ROWS = 256


def _best(top_k: int):
    """Function over two blocks of ``(id, v)``: the nearest of the second to each row of the first, some rows at a time."""

    def unit(x: np.ndarray) -> np.ndarray:
        z = np.sqrt((x * x).sum(axis=1))
        return x / np.where(z < 1e-15, np.inf, z)[:, None]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, b_ids = left["id"].combine_chunks(), right["id"].combine_chunks()
        mine, theirs = a_ids.to_numpy(zero_copy_only=False), b_ids.to_numpy(zero_copy_only=False)
        order = np.argsort(theirs, kind="stable")
        at, place = _rows_by_length(left), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        two = {k: (place[_rows_by_length(right)[k]], unit(v)) for k, (_, v) in _by_length(right).items()}
        one = {k: unit(v) for k, (_, v) in _by_length(left).items() if k in two}
        rows, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for low in range(0, len(mine), ROWS):
            s = np.zeros((min(ROWS, len(mine) - low), len(theirs)))
            for k, x in one.items():
                first, last = np.searchsorted(at[k], (low, low + ROWS))
                s[np.ix_(at[k][first:last] - low, two[k][0])] = x[first:last] @ two[k][1].T
            s[np.equal.outer(mine[low : low + ROWS], theirs[order])] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :top_k]
            i, j = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
            ok = s[i, j] > -np.inf
            rows.append(i[ok] + low)
            found.append(order[j[ok]])
            scores.append(s[i, j][ok])
        i, j = np.concatenate(rows), np.concatenate(found)
        return pa.table({"a_id": a_ids.take(pa.array(i)), "b_id": b_ids.take(pa.array(j)), "similarity": pa.array(np.concatenate(scores))})

    return run


def cosine_pairs(a: DataFrame, b: DataFrame, top_k: int, block: int = 4096) -> DataFrame:
    """``(a_id, b_id, similarity, rank)``: for each row of the stated set ``a`` its nearest of ``b``, itself left out.

    Blocks of both are multiplied, a few rows at a time, each pair of blocks keeps the best of each row, and only these are ranked.  Similarity
    is 0 where lengths differ or a vector is zero; rows with a null take no part.
    """

    s = _dealt(a, b, block).applyInArrow(_best(top_k), f"{_ids(a, b)}, similarity double")
    # Products of one vector in blocks of different shapes may differ in the last place.
    near = W.partitionBy("a_id").orderBy(F.desc(F.round("similarity", 12)), "b_id")
    return s.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top_k)


#: Pivots of the first level, of a cell that is split again, and vector lengths that have pivots; what is broadcast follows from these.
PIVOTS, MORE_PIVOTS, LENGTHS = 256, 64, 8
#: Parts of a side that meet all parts of the other, a task for each pair of parts, at most.
PARTS = 64


def euclid_pairs(a: DataFrame, b: DataFrame, max_dist: float, block: int = 4096, method: str = "blocks") -> DataFrame:
    """``(a_id, b_id, distance)`` within ``max_dist``, exactly.

    ``blocks``: a stated set ``a`` against all of ``b`` by pairs of blocks.  ``cells``: for two large sides; see ``metric_cells``.
    Vectors of a length whose cells would save under half of the pairs are compared all with all by ``_crossed``, which copies no rows.
    """
    dealt = lambda x, y: _dealt(x, y, block).applyInArrow(_near(max_dist), f"{_ids(a, b)}, distance double")
    if method != "cells":
        return dealt(a, b)
    left, right, plan = metric_cells(a, b, max_dist, block)
    plan = plan.persist()
    all_with_all = {r["d"]: (r["parts_a"], r["parts_b"]) for r in _close(a, b, plan, block).collect()}  # at most LENGTHS
    close = list(all_with_all)
    mine, other = (lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    key = ["d", "cell", "i", "j"]
    # At most LENGTHS * PIVOTS * MORE_PIVOTS cells, and one for each other length; rows copied to cells are never the smaller side.
    cells = F.broadcast(plan.where(~F.col("d").isin(close)).select("d", "cell", "m", "n"))
    left = left.join(cells, ["d", "cell"]).select("d", "cell", "id", "v", mine("m").alias("i"), other("n").alias("j"))
    right = right.join(cells, ["d", "cell"]).select("d", "cell", "id", "v", mine("n").alias("j"), other("m").alias("i"))
    found = left.groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(_near(max_dist), f"{_ids(a, b)}, distance double")
    if not close:
        return found
    rest = [_crossed(a, b, d, *parts, max_dist, block) for d, parts in all_with_all.items()]
    return reduce(DataFrame.unionByName, rest if plan.where(~F.col("d").isin(close)).isEmpty() else [found, *rest])


def _close(a: DataFrame, b: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """``(d, parts_a, parts_b)``: lengths of vectors for which no pivot helps, as cells would save under half of the pairs, and the parts of each side."""
    cost = plan.where("cell >= 0").groupBy("d").agg(F.sum(F.col("rows_a").cast("double") * F.col("rows_b")).alias("pairs"))
    for x, n in ((a, "all_a"), (b, "all_b")):
        cost = cost.join(x.where("id is not null and v is not null").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias(n)), "d")
    return cost.where(2 * F.col("pairs") > F.col("all_a").cast("double") * F.col("all_b")).select("d", *(F.least(F.lit(PARTS), F.ceil(F.col(f"all_{x}") / block)).cast("int").alias(f"parts_{x}") for x in "ab"))


def _crossed(a: DataFrame, b: DataFrame, d: int, parts_a: int, parts_b: int, max_dist: float, block: int) -> DataFrame:
    """All rows of ``a`` with all of ``b`` whose vectors have ``d`` values.

    Each side is shuffled once and packed, a row for each block of vectors, and packed rows meet in a Cartesian product, which
    reads parts of one side again for each part of the other and writes nothing: disk follows the rows, not their pairs.
    """

    def packed(x: DataFrame, parts: int, ids: str, flat: str) -> DataFrame:
        rows = x.where((F.size("v") == d) & F.col("id").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"))
        return rows.repartition(parts).mapInArrow(_packed(block), f"{ids} array<{x.schema['id'].dataType.simpleString()}>, {flat} array<double>")

    both = packed(a, parts_a, "a_ids", "a").hint("shuffle_replicate_nl").crossJoin(packed(b, parts_b, "b_ids", "b"))
    return both.mapInArrow(_near_blocks(d, max_dist), f"{_ids(a, b)}, distance double")


def _packed(block: int):
    """Function over rows ``(id, v)``: a row of ids and values for each ``block`` of them."""

    def row(rows: pa.Table) -> pa.RecordBatch:
        cols = [rows["id"].combine_chunks(), pc.list_flatten(rows["v"].combine_chunks())]
        return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols], names=["ids", "flat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            more = pa.table({"id": b.column(0), "v": b.column(1)})
            held = more if held is None else pa.concat_tables([held, more])
            while len(held) >= block:
                yield row(held.slice(0, block))
                held = held.slice(block)
        if held is not None and len(held):
            yield row(held)

    return run


def _near_blocks(d: int, max_dist: float):
    """Function over rows of two blocks ``(ids, values, ids, values)``: their pairs within ``max_dist``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ai, av, bi, bv = (b.column(c)[k].values for c in range(4))
                av, bv = (x.to_numpy(zero_copy_only=False).reshape(-1, d) for x in (av, bv))
                for x, y, dist in _within(ai, av, bi, bv, max_dist):
                    found = pa.record_batch([x, y, pa.array(dist)], names=["a_id", "b_id", "distance"])
                    yield found.filter(pc.not_equal(x, y))

    return run


def metric_cells(a: DataFrame, b: DataFrame, max_dist: float, block: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides as ``(d, cell, id, v)`` such that rows within ``max_dist`` meet in exactly one cell, and ``(d, cell, rows_a, rows_b, m, n)``, rows and blocks of each.

    Rows of ``b`` lie in the cell of their nearest pivot, rows of ``a`` in each cell that they may have a partner in: those
    whose border, the plane midway between two pivots, is within ``max_dist``, and whose farthest row is within reach of
    it.  Pivots are a sample of ``b`` of bounded size, its rows of smallest hashes; cells of more than a block are split
    by pivots of their own.  Large cells that remain are compared by pairs of blocks.
    """
    left, right = (x.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("d")) for x in (a, b))
    usual = [r["d"] for r in right.where("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()]
    pivots: dict[tuple[int, int], np.ndarray] = {}
    for d in usual:
        some = right.where(F.col("d") == d).orderBy(F.xxhash64("id")).limit(PIVOTS).select("v").collect()
        pivots[d, -1] = np.unique(np.array([r["v"] for r in some]), axis=0)
    ids = {x: x.schema["id"].dataType.simpleString() for x in (left, right)}
    home = right.mapInArrow(_to_cells(pivots, {}, None, 0), f"d int, cell long, id {ids[right]}, v array<double>, far double")
    counted = lambda x, reach, limit, level: x.mapInArrow(_to_cells(pivots, reach, limit, level, bare=True), "d int, cell long, n long, far double").groupBy("d", "cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    sizes = counted(right, {}, None, 0).where("cell >= 0")
    first = sizes.collect()  # at most LENGTHS * PIVOTS rows
    reach = {(r["d"], r["cell"]): r["far"] for r in first}
    large = [(r["d"], r["cell"], max(1, r["n"] // (2 * MORE_PIVOTS))) for r in first if r["n"] > block]
    if large:
        # Of each large cell a sample by hash, thinned to about twice the pivots before it is ranked.
        wanted = home.join(F.broadcast(a.sparkSession.createDataFrame(large, "d int, cell long, rate long")), ["d", "cell"])
        drawn = wanted.where(F.pmod(F.xxhash64(F.lit(1), "id"), "rate") == 0)
        few = drawn.withColumn("k", F.row_number().over(W.partitionBy("d", "cell").orderBy(F.xxhash64("id")))).where(F.col("k") <= MORE_PIVOTS)
        for r in few.groupBy("d", "cell").agg(F.collect_list("v").alias("v")).collect():
            pivots[r["d"], r["cell"]] = np.unique(np.array(r["v"]), axis=0)
    schema = "d int, cell long, id {}, v array<double>, far double"
    home = right.mapInArrow(_to_cells(pivots, {}, None, 1), schema.format(ids[right]))
    for r in counted(right, {}, None, 1).where("cell >= 0").collect():
        reach[r["d"], r["cell"]] = r["far"]
    away = left.mapInArrow(_to_cells(pivots, reach, max_dist, 1), schema.format(ids[left]))
    rows = lambda x, n: x.select("d", "cell", F.col("n").alias(n))
    plan = rows(counted(left, reach, max_dist, 1), "rows_a").join(F.broadcast(rows(counted(right, {}, None, 1), "rows_b")), ["d", "cell"])
    plan = plan.withColumns({k: F.ceil(F.col(c) / block).cast("int") for k, c in (("m", "rows_a"), ("n", "rows_b"))})
    return away.drop("far"), home.drop("far"), plan


def _to_cells(pivots: dict[tuple[int, int], np.ndarray], reach: dict[tuple[int, int], float], max_dist: float | None, level: int, bare: bool = False):
    """Rows ``(id, v, d)`` with their cell: the nearest, or with ``max_dist`` each that may hold a row so near.

    A cell has the number of its pivot at the first level, that of a split one follows below it; -1 is for lengths
    without pivots.  ``bare``: numbers of rows and their farthest by cell instead of rows.
    """
    wide = MORE_PIVOTS + 1

    def deal(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, pivots and distances: the nearest of each row, or all that are within reach."""
        d2 = np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T), 0)
        near = d2.argmin(axis=1)
        if max_dist is None:
            return np.arange(len(x)), near, np.sqrt(d2[np.arange(len(x)), near])
        between = np.sqrt(np.maximum((p * p).sum(axis=1)[near][:, None] + (p * p).sum(axis=1) - 2 * (p[near] @ p.T), 0))
        least = d2[np.arange(len(x)), near][:, None]
        row, cell = np.nonzero(d2 - least <= 2 * max_dist * between + 1e-9 * (1 + d2))
        return row, cell, np.sqrt(d2[row, cell])

    def within(cells: np.ndarray, far: np.ndarray, d: int) -> np.ndarray:
        """Whether the farthest row of a cell can be within reach of rows so far from its pivot."""
        if max_dist is None:
            return np.ones(len(cells), bool)
        limits = np.array([reach.get((d, int(c)), -np.inf) for c in cells.tolist()])
        return far <= limits + max_dist + 1e-9 * (1 + far)

    cells_of = _counts if bare else _cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 2048) for i in range(0, big.num_rows, 2048)):
                t = pa.table({"id": b.column(0), "v": b.column(1)})
                for d, rows in _rows_by_length(t).items():
                    some = t.take(pa.array(rows)).combine_chunks()
                    if (d, -1) not in pivots:
                        n = len(rows)
                        yield cells_of(some, np.arange(n), d, np.full(n, -1), np.zeros(n))
                        continue
                    x = pc.list_flatten(some["v"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, d)
                    row, first, far = deal(x, pivots[d, -1])
                    if level == 0:
                        yield cells_of(some, row, d, first * wide, far)
                        continue
                    ok = within(first * wide, far, d)
                    row, first, far = row[ok], first[ok], far[ok]
                    for c in np.unique(first).tolist():
                        at = np.flatnonzero(first == c)
                        inner = pivots.get((d, c * wide))
                        if inner is None:
                            yield cells_of(some, row[at], d, np.full(len(at), c * wide), far[at])
                            continue
                        mine, second, near = deal(x[row[at]], inner)
                        cells = c * wide + 1 + second
                        ok = within(cells, near, d)
                        yield cells_of(some, row[at][mine[ok]], d, cells[ok], near[ok])

    return run


def _cells(rows: pa.Table, at: np.ndarray, d: int, cell: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    some = rows.take(pa.array(at)).combine_chunks()
    cols = [pa.array(np.full(len(at), d), pa.int32()), pa.array(cell.astype(np.int64)), some["id"].combine_chunks(), some["v"].combine_chunks(), pa.array(far)]
    return pa.record_batch(cols, names=["d", "cell", "id", "v", "far"])


def _counts(rows: pa.Table, at: np.ndarray, d: int, cell: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    found, place, n = np.unique(cell.astype(np.int64), return_inverse=True, return_counts=True)
    most = np.zeros(len(found))
    np.maximum.at(most, place, far)
    return pa.record_batch([pa.array(np.full(len(found), d), pa.int32()), pa.array(found), pa.array(n), pa.array(most)], names=["d", "cell", "n", "far"])


def _rows_by_length(t: pa.Table) -> dict[int, np.ndarray]:
    n = pc.list_value_length(t["v"]).to_numpy()
    return {int(k): np.flatnonzero(n == k) for k in set(n.tolist()) if k}


def _by_length(t: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of a block for each length of vector."""
    v, n = t["v"].combine_chunks(), pc.list_value_length(t["v"]).to_numpy()
    ids = t["id"].combine_chunks()
    return {int(k): (ids.filter(pa.array(n == k)), pc.list_flatten(v.filter(pa.array(n == k))).to_numpy(zero_copy_only=False).reshape(-1, k)) for k in set(n.tolist()) if k}


def _within(ai: pa.Array, av: np.ndarray, bi: pa.Array, bv: np.ndarray, max_dist: float) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids and distances of the pairs of two blocks within ``max_dist``, some rows at a time."""
    a2, b2, most = (av * av).sum(axis=1), (bv * bv).sum(axis=1), max_dist * max_dist
    # The product only narrows, with room for its rounding; differences decide.  Short numbers do where squares neither leave their range nor vanish.
    kind = np.float32 if 1e-20 < most < 1e30 and max(a2.max(initial=0), b2.max(initial=0)) < 1e30 else np.float64
    room = max(1e-9, 4 * (av.shape[1] + 2) * float(np.finfo(kind).eps))
    left = np.column_stack([av, (room - 1) / 2 * a2, np.ones(len(av))]).astype(kind)
    right = np.column_stack([bv, np.ones(len(bv)), (room - 1) / 2 * b2]).astype(kind).T.copy()
    least = kind(-(1 + room) / 2 * most - (0 if kind is np.float32 else room))
    for low in range(0, len(av), 256):
        x = av[low : low + 256]
        i, j = np.divmod(np.flatnonzero(left[low : low + 256] @ right >= least), len(bv))
        for at in range(0, len(i), 65536):
            u, w = i[at : at + 65536], j[at : at + 65536]
            d = np.sqrt(((x[u] - bv[w]) ** 2).sum(axis=1))
            near = d <= max_dist
            yield ai.take(pa.array(u[near] + low)), bi.take(pa.array(w[near])), d[near]


def _near(max_dist: float):
    """Function over two blocks of ``(id, v)``: their pairs within ``max_dist``, vectors of one length each time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, b_ids, found = [left["id"].combine_chunks().slice(0, 0)], [right["id"].combine_chunks().slice(0, 0)], [np.empty(0)]
        one, two = _by_length(left), _by_length(right)
        for k in one.keys() & two.keys():
            for x, y, d in _within(*one[k], *two[k], max_dist):
                a_ids.append(x)
                b_ids.append(y)
                found.append(d)
        out = pa.table({"a_id": pa.chunked_array(a_ids), "b_id": pa.chunked_array(b_ids), "distance": pa.array(np.concatenate(found))})
        return out.filter(pc.not_equal(out["a_id"], out["b_id"]))

    return run


def mfcc_lossy_finding(stats: DataFrame, frames: DataFrame, variant: str = "current") -> DataFrame:
    """Lossy findings from steady high coefficients; ``frames`` has ``(track_id, n_frames)``."""
    base, low, dlim = (2.5, 0.15, 0.7) if variant == "current" else (2.2, -1.0, 0.6)
    high = stats.where("c >= 5").groupBy("track_id").agg(F.avg("std").alias("std"), F.avg("delta_std").alias("d"), F.avg(F.abs("kurt")).alias("kurt"))
    a = high.join(frames, "track_id").where((F.col("n_frames") >= 10) & (F.col("std") < base) & (F.col("std") >= low) & (F.coalesce("d", F.lit(0.0)) < dlim))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.3), (base - F.col("std")) / base))
    conf = F.when(F.col("kurt") < 0.5, F.least(F.lit(1.0), conf + 0.15)).otherwise(conf)
    return a.select("track_id", F.col("std").alias("high_std"), F.col("kurt").alias("mean_abs_kurt"), conf.alias("confidence"), F.when(conf > 0.75, "high").otherwise("medium").alias("severity"))
