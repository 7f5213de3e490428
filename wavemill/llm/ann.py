"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled into the unit ball and get one coordinate more, so that largest inner product and
least distance agree.  Each of ``tables`` hash tables has ``width``-wide cells over Gaussian projections, the more
of them the more rows there are, so that buckets stay small.  A query visits, in each table, its own cell
and then cells displaced by one step in some projections, in order of the summed squared distances to the cell
borders that are crossed, which is the order of estimated success.  How many it visits is measured:
as many as a bounded sample of queries, held against all rows, needs for the recall asked for.  Where the most
allowed does not reach it there are fewer projections, and in the end all rows, so recall does not fall with size.
Candidates of all tables are ranked by the exact measure.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from wavemill.llm.columns import column
from wavemill.llm.store import Store

#: Rows of (candidates, queries) that meet in one cell of work, about.
BLOCK, QUERY_BLOCK = 1 << 14, 1 << 12
#: Cells above the block size that are broadcast; a plain join is used beyond.
SMALL_PLAN = 100_000
#: Probes in each table at most, and sampled queries from which their number is measured.
MOST_PROBES, SAMPLE = 2048, 48
#: Pairs that a task holds before it cuts them to the best of each query.
HELD = 1 << 20


@functools.lru_cache(maxsize=16)
def displacements(hashes: int, n: int) -> np.ndarray:
    """(n, 2 * hashes) flags: sets of border crossings that promise most, by the expected order of the distances.

    Column j is the j-th nearest border of a query.  The other border of the same projection is
    column 2 * hashes - 1 - j; no set holds both.
    """
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out = [np.zeros(2 * m, bool)]
    heap = [(expected[0], (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - i in chosen for i in chosen):
            out.append(np.isin(np.arange(2 * m), chosen))
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + expected[last + 1], (*chosen, last + 1)))
    return np.array(out)


class Hashing:
    """The projections of all tables, drawn from a seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.a = rng.standard_normal((dim + 1, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.mix = rng.integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and places within the cell, both (rows, tables, hashes)."""
        at = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def keys(self, cell: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cell * self.mix).sum(axis=-1)

    def probes(self, cell: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """(rows, n) keys of the cells that queries visit in one table, most promising first.

        The sets of crossings that promise most in general, eight times as many as asked for, are put in the order of
        each query's own distances; there are 3 ** hashes cells at most.
        """
        sets = displacements(self.hashes, 8 * n)
        cost = np.concatenate([place, 1 - place], axis=1) ** 2
        order = np.argsort(cost, axis=1, kind="stable")
        total = np.take_along_axis(cost, order, axis=1) @ sets.T
        best = np.argsort(total, axis=1, kind="stable")[:, :n]
        step = self.mix[order % self.hashes] * np.where(order < self.hashes, -1, 1)
        with np.errstate(over="ignore"):
            return self.keys(cell)[:, None] + np.stack([np.where(sets[b], s, 0).sum(axis=1) for b, s in zip(best, step, strict=True)])


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows as candidates: scaled by the largest norm, with the coordinate that fills them up to 1."""
    x = x / largest
    return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]


def aimed(q: np.ndarray) -> np.ndarray:
    """Rows as queries: of length 1, with nothing in the last coordinate."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return np.c_[q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros(len(q))]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of vectors without null or non-finite components that are not zero; single precision stays as it is."""
    kind = vectors.schema[vector_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = column(vector_col).cast("array<float>" if narrow else "array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(column(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _best(k: int, dim: int):
    """Function over rows sorted by cell, queries first, then by bucket: the k best of each query in each cell."""

    class Cell:
        """Queries of one cell, with the buckets they visit, and the best pairs so far."""

        def __init__(self):
            self.vectors, self.names, self.visits = [], [], []
            self.found, self.held, self.floor = [], 0, None

        def ready(self) -> None:
            self.q, self.ids = np.concatenate(self.vectors), np.concatenate(self.names)
            sizes = [len(v) for v in self.visits]
            flat, owner = np.concatenate(self.visits), np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((owner, flat))
            self.bucket, self.owner = flat[order], owner[order]
            self.floor = np.full(len(self.q), -np.inf)

        def take(self, buckets: np.ndarray, names: np.ndarray, x: np.ndarray) -> None:
            if self.floor is None:
                self.ready()
            starts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                low, high = np.searchsorted(self.bucket, buckets[s], "left"), np.searchsorted(self.bucket, buckets[s], "right")
                for at in range(low, high, 512):
                    self.score(np.unique(self.owner[at : min(at + 512, high)]), names[s:e], x[s:e])

        def score(self, who: np.ndarray, names: np.ndarray, x: np.ndarray) -> None:
            s = self.q[who] @ x.T
            s[self.ids[who, None] == names[None, :]] = -np.inf
            if s.shape[1] >= k:
                self.floor[who] = np.maximum(self.floor[who], -np.partition(-s, k - 1, axis=1)[:, k - 1])
            floor = self.floor[who]
            i, j = np.nonzero((s >= (floor - 1e-9 * np.abs(floor) - 1e-300)[:, None]) & (s > -np.inf))
            if len(i):
                # The measure itself, summed in one fixed order whatever the block.
                self.found.append((who[i], names[j], (self.q[who[i]] * x[j]).sum(axis=1)))
                self.held += len(i)
            if self.held > HELD:
                self.cut()

        def cut(self) -> None:
            who, what, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
            last = rank == k - 1
            self.floor[who[last]] = np.maximum(self.floor[who[last]], score[last])
            ok = rank < k
            self.found, self.held = [(who[ok], what[ok], score[ok])], 0

        def close(self) -> Iterator[pa.RecordBatch]:
            if self.found:
                self.cut()
                who, what, score = self.found[0]
                yield pa.record_batch([pa.array(self.ids[who]), pa.array(what), pa.array(score)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, Cell()
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(4)], axis=1)
            kind, bucket, name, vec, visits = np.asarray(b.column(4)), np.asarray(b.column(5)), np.asarray(b.column(6)), _matrix(b.column(7), dim), b.column(8)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if key != (now := tuple(keys[s].tolist())):
                    yield from cell.close()
                    key, cell = now, Cell()
                cut = s + int((kind[s:e] == 0).sum())
                if cut > s:
                    cell.vectors.append(vec[s:cut])
                    cell.names.append(name[s:cut])
                    cell.visits += [np.asarray(v.values) for v in visits.slice(s, cut - s)]
                if e > cut and cell.names:
                    cell.take(bucket[cut:e], name[cut:e], vec[cut:e])
        yield from cell.close()

    return run


def _blocks(index: DataFrame, probes: DataFrame, k: int, dim: int) -> DataFrame:
    """Best of each query of ``probes(t, g, id, v, visits)`` in the buckets it visits of ``index(t, g, bucket, id, v)``.

    Buckets come in groups ``g``, so that a query's vector travels once to a group and not to each bucket; large
    groups are split into blocks on both sides.
    """
    key = ["t", "g"]
    plan = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(probes.groupBy(*key).agg(F.count(F.lit(1)).alias("p")), key)
    plan = plan.select(*key, F.ceil(F.col("n") / (2 * BLOCK)).cast("int").alias("xs"), F.ceil(F.col("p") / QUERY_BLOCK).cast("int").alias("qs"))
    plan = plan.where("xs > 1 or qs > 1")
    large = plan.count()
    if large:
        plan = F.broadcast(plan) if large <= SMALL_PLAN else plan
        one = F.coalesce(F.col("xs"), F.lit(1)), F.coalesce(F.col("qs"), F.lit(1))
        index, probes = index.join(plan, key, "left"), probes.join(plan, key, "left")
    else:
        one = F.lit(1), F.lit(1)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none, no = F.lit(0).cast("long").alias("bucket"), F.array().cast("array<bigint>").alias("visits")
    right = index.select(*key, own(one[0]).alias("x"), each(one[1]).alias("q"), F.lit(1).alias("kind"), "bucket", "id", "v", no)
    left = probes.select(*key, each(one[0]).alias("x"), own(one[1]).alias("q"), F.lit(0).alias("kind"), none, "id", "v", "visits")
    cell = [*key, "x", "q"]
    both = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "kind", "bucket")
    found = both.mapInArrow(_best(k, dim), "query_id long, vec_id long, score double")
    # The same pair from several tables has the same score, and so the same dense rank.
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def _everywhere(rows: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """Best of each query in all rows, as one bucket that is split into blocks."""
    zero = F.lit(0).cast("long")
    one = [F.lit(-1).alias("t"), zero.alias("g")]
    return _blocks(rows.select(*one, zero.alias("bucket"), "id", "v"), asked.select(*one, "id", "v", F.array(zero).alias("visits")), k, dim)


def exact(rows: DataFrame, names: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``(query_id, vec_id, score, v)``: the k nearest of all ``rows(id, v)`` to a few queries that every task holds."""
    dim = queries.shape[1]
    kind = dict(rows.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = np.asarray(b.column(0)), _matrix(b.column(1), dim)
            s = queries @ x.T
            s[names[:, None] == ids[None, :]] = -np.inf
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            flat = pa.array(at.ravel())
            cols = [pa.array(np.repeat(names, at.shape[1])), b.column(0).take(flat), pa.array(np.take_along_axis(s, at, axis=1).ravel()), b.column(1).take(flat)]
            yield pa.record_batch(cols, names=["query_id", "vec_id", "score", "v"])

    near = rows.select("id", "v").mapInArrow(run, f"query_id long, vec_id long, score double, v {kind}").where(F.col("score") > float("-inf"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("n", best).where(F.col("n") <= k).drop("n")


def settings(make: Callable[[int], Hashing], hashes: int, rows: DataFrame, asked: DataFrame, largest: float, k: int, recall: float) -> tuple[Hashing, int] | None:
    """Hashing and probes in each table that give ``SAMPLE`` of the queries the recall; None if only all rows give it.

    From ``hashes`` projections on: the fewest probes, a power of two up to ``MOST_PROBES``.  Where these do not do, buckets
    are too small for the vectors, and projections are left out, one after the other.
    """
    some = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    names, queries = np.array([r["id"] for r in some], np.int64), np.array([r["v"] for r in some], np.float64)
    near = exact(rows, names, queries, k).collect()
    if not near:
        return make(hashes), 1
    of = {n: i for i, n in enumerate(names.tolist())}
    who = np.array([of[r["query_id"]] for r in near])
    found = np.array([r["v"] for r in near], np.float64)
    for count in range(hashes, 0, -1):
        hashing = make(count)
        keys = hashing.keys(hashing.cells(lifted(found, largest))[0])
        cell, place = hashing.cells(aimed(queries))
        rank = np.full(len(near), MOST_PROBES)
        for t in range(hashing.tables):
            visits = hashing.probes(cell[:, t], place[:, t], MOST_PROBES)
            hit = visits[who] == keys[:, t, None]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
        n = 1
        while n <= MOST_PROBES:
            if (rank < n).mean() >= recall:
                return hashing, n
            n *= 2
    return None


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 4,
    hashes: int | None = None,
    width: float = 2.0,
    probes: int | None = None,
    recall: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query, nearest first.

    ``queries`` are rows of the same form (all of ``vectors`` if not given); a row with the query's own
    id is no candidate.  Score is the inner product in double precision, ties go to the smaller
    id.  ``hashes`` follows from the number of rows if not given, at most, and is lowered with ``probes`` measured for
    ``recall`` on a sample of queries; where no setting reaches it, all rows are compared.  Vectors that are null, zero, or hold nulls or non-finite components take no part, nor
    do those of another length than most (of equally frequent lengths, the larger).  Of rows with one id the
    smallest vector counts, as query and as candidate.  Of equal vectors with different ids only the k + 1
    smallest ids can be among the nearest of any query, so the rest never enters the tables.  A query
    that found fewer than k in its buckets is held against all rows.  Other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    store = Store(spark, "ann")
    rows = usable(vectors, id_col, vector_col)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("sq"))
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not top:
        return spark.createDataFrame([], schema)
    dim, largest, count = top[0]["dim"], float(np.sqrt(top[0]["sq"])), top[0]["n"]
    one = lambda df: df.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = store.keep(one(rows if queries is None else usable(queries, id_col, vector_col)), "queries")
    copy = W.partitionBy("v").orderBy("id")
    rows = store.keep(one(rows).withColumn("n", F.row_number().over(copy)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    make = lambda n: Hashing(dim, tables, n, width, seed)
    most = hashes or max(4, int(np.log2(count)) - 7)
    chosen = (make(most), probes) if probes else settings(make, most, rows, asked, largest, k, recall)
    kind = dict(rows.dtypes)["v"]
    if dict(asked.dtypes)["v"] != kind:
        kind = "array<double>"
        rows, asked = (df.withColumn("v", F.col("v").cast(kind)) for df in (rows, asked))
    if chosen is None:
        return _everywhere(rows, asked, k, dim).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    hashing, visited = chosen
    groups = -(-count // BLOCK)

    def into_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hashing.keys(hashing.cells(lifted(_matrix(b.column(1), dim), largest))[0])
            for t in range(tables):
                yield pa.record_batch([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(keys[:, t] % groups), pa.array(keys[:, t]), b.column(0), b.column(1)], names=["t", "g", "bucket", "id", "v"])

    def into_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 128) for i in range(0, big.num_rows, 128)):
                if not b.num_rows:
                    continue
                cell, place = hashing.cells(aimed(_matrix(b.column(1), dim)))
                for t in range(tables):
                    keys = hashing.probes(cell[:, t], place[:, t], visited)
                    who, flat = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel()
                    order = np.lexsort((flat, flat % groups, who))
                    who, flat = who[order], flat[order]
                    new = np.r_[True, (who[1:] != who[:-1]) | (flat[1:] != flat[:-1])]
                    who, flat = who[new], flat[new]
                    g = flat % groups
                    starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (g[1:] != g[:-1])])
                    at = pa.array(who[starts])
                    visits = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(flat)].astype(np.int32)), pa.array(flat))
                    yield pa.record_batch([pa.array(np.full(len(starts), t, np.int32)), pa.array(g[starts]), b.column(0).take(at), b.column(1).take(at), visits], names=["t", "g", "id", "v", "visits"])

    index = rows.mapInArrow(into_tables, f"t int, g long, bucket long, id long, v {kind}")
    probed = asked.mapInArrow(into_probes, f"t int, g long, id long, v {kind}, visits array<bigint>")
    found = store.keep(_blocks(index, probed, k, dim), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = store.keep(asked.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"), "short")
    if not short.isEmpty():
        rest = _everywhere(rows, short, k, dim)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
