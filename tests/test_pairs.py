import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.operators import cepstra
from wavemill.plans import registry

DATA = "/root/testdata/sf0.001"


def test_pairs_by_blocks_are_all_pairs(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(150, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[75:] = v[:75] + r.normal(size=(75, 64)) * r.uniform(0.05, 0.2, (75, 1))
    v[3] = v[4]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1.0, 0.0]), (901, [1.0, 0.5]), (902, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(x.a_id, x.b_id): x.distance for x in cepstra.euclid_pairs(df, df, 1.1, method="blocks", block=40).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    want = {(i, j): d[i, j] for i in range(150) for j in range(150) if i != j and d[i, j] <= 1.1} | {(900, 901): 0.5, (901, 900): 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_the_query_covers_all_rows(spark):
    v = np.array([x.embedding for x in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()], float)
    ids = [x.vec_id for x in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").orderBy("vec_id").collect()]
    d = np.array([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in v])
    i, j = np.nonzero((d <= 1.1) & ~np.eye(len(v), dtype=bool))
    got = {(x.a_id, x.b_id) for x in registry.queries()["euclid_pairs_cells"](spark, DATA).collect()}
    assert got == {(ids[a], ids[b]) for a, b in zip(i, j, strict=True)}


def clustered(spark, n, seed=0, centres=40, dim=16):
    """Rows in clusters of a fixed number, so that a cluster grows with the table, and a few far from all."""
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    v = c[r.integers(0, centres, n)] + r.normal(size=(n, dim)) * 0.15
    v[: n // 50] = r.normal(size=(n // 50, dim)) * 2
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("block", [20, 4096])
def test_cells_are_exact(spark, monkeypatch, block):
    """Small blocks split cells again; copies, rows between pivots and several lengths are there."""
    monkeypatch.setattr(cepstra, "PIVOTS", 12)
    monkeypatch.setattr(cepstra, "MORE_PIVOTS", 5)
    monkeypatch.setattr(cepstra, "LENGTHS", 1)
    v, df = clustered(spark, 600)
    more = [(1000 + i, v[i].tolist()) for i in range(30)] + [(2000, [1.0, 0.0]), (2001, [1.0, 0.2]), (2002, None), (2003, [])]
    df = df.unionByName(spark.createDataFrame(more, "id long, v array<double>"))
    for limit in (0.3, 0.9):
        got = [(x.a_id, x.b_id) for x in cepstra.euclid_pairs(df, df, limit, block=block, method="cells").collect()]
        ids, w = [*range(600), *range(1000, 1030)], np.concatenate([v, v[:30]])
        d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(axis=2))
        want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= limit), strict=True) if i != j} | {(2000, 2001), (2001, 2000)}
        assert len(got) == len(set(got)) and set(got) == want


def share(spark, n, block):
    """Share of all pairs that meet in cells."""
    _, df = clustered(spark, n)
    left, right, _ = cepstra.metric_cells(df, df, 0.4, block)
    count = lambda x, c: x.groupBy("d", "cell").agg(F.count("*").alias(c))
    return count(left, "m").join(count(right, "n"), ["d", "cell"]).agg(F.sum(F.col("m") * F.col("n"))).first()[0] / n**2


def test_few_pairs_are_compared(spark):
    shares = [share(spark, n, 200) for n in (1000, 4000, 16_000)]
    print("share of pairs", shares)
    assert all(s < 0.06 for s in shares) and shares[2] < shares[0] * 1.5


def test_uniform_vectors_are_not_copied_to_every_cell(spark, monkeypatch):
    """Where no pivot helps rows meet by blocks, and no side of copied rows is ever broadcast."""
    monkeypatch.setattr(cepstra, "PIVOTS", 40)
    v = np.random.default_rng(8).normal(size=(700, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1.0, 0.0]), (901, [1.0, 0.5])], "id long, v array<double>")
    _, _, plan = cepstra.metric_cells(df, df, 1.1)
    assert plan.where("d = 64").agg(F.sum("rows_a")).first()[0] > 20 * 700
    assert 64 in [r.d for r in cepstra._close(df, df, plan, 4096).collect()]
    got = [(r.a_id, r.b_id) for r in cepstra.euclid_pairs(df, df, 1.1, method="cells").collect()]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 1.1), strict=True) if i != j} | {(900, 901), (901, 900)}
    assert len(got) == len(set(got)) and set(got) == want
    _, near = clustered(spark, 400)
    tree = cepstra.euclid_pairs(near, near, 0.4, method="cells")._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in tree


def test_memory_of_cosine_blocks_follows_a_few_rows():
    """Two whole blocks are never a matrix of all their products; short, zero and longer vectors are there."""
    v = np.random.default_rng(9).normal(size=(2000, 8))
    v[5] = 0
    left = pa.table({"id": np.arange(2000), "v": [*v[:1999].tolist(), [1.0, 2.0]]})
    right = left.slice(1000).append_column("n", pa.nulls(1000)).select(["id", "v"]).take(np.random.default_rng(1).permutation(1000))
    right = pa.concat_tables([right, left.slice(0, 1000)])
    tracemalloc.start()
    got = cepstra._best(5)(left, right).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000 and len(got) == 10_000
    norm = np.linalg.norm(v, axis=1)
    u = v / np.where(norm < 1e-15, np.inf, norm)[:, None]
    s = u @ u.T
    s[1999], s[:, 1999] = 0, 0
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert [r["b_id"] for r in got] == want.ravel().tolist()
    assert np.allclose([r["similarity"] for r in got], np.take_along_axis(s, want, axis=1).ravel())


def test_pairs_of_all_with_all_write_no_copies(spark):
    """Rows are shuffled once, whatever the number of blocks; odd lengths, nulls and text ids are there."""
    v = np.random.default_rng(12).normal(size=(500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [f"r{i}" for i in range(500)]
    odd = [("p", [1.0, 0.0]), ("q", [1.0, 0.5]), ("n", None), (None, v[0].tolist())]
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in zip(ids, v, strict=True)), *odd], "id string, v array<double>")
    pairs = cepstra.euclid_pairs(df, df, 1.1, block=40, method="cells")
    got = {(r.a_id, r.b_id): r.distance for r in pairs.collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    want = {(ids[i], ids[j]): d[i, j] for i, j in zip(*np.nonzero(d <= 1.1), strict=True) if i != j} | {("p", "q"): 0.5, ("q", "p"): 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    tree = pairs._jdf.queryExecution().optimizedPlan().toString()
    crossed = tree[tree.index("Join Cross") :]
    assert "Generate explode" not in crossed and "RepartitionByExpression" not in crossed and crossed.count("Repartition 13") == 2


@pytest.mark.parametrize("scale", [1e-15, 1e-6, 1.0, 1e6, 1e17])
def test_narrowing_loses_no_pair(scale):
    r = np.random.default_rng(3)
    a, step = r.normal(size=(600, 24)), r.normal(size=(600, 24))
    b = a + step / np.linalg.norm(step, axis=1, keepdims=True) * r.choice([0.2, 1 - 1e-12, 1 + 1e-9, 3], (600, 1))
    a, b, ids = a * scale, b * scale, pa.array(np.arange(600))
    for limit in (scale, 0.0):
        found = {(i, j) for x, y, _ in cepstra._within(ids, a, ids, b, limit) for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)}
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= limit), strict=True)}
