import numpy as np
import pytest

from wavemill.llm import ann

DATA = "/root/testdata/sf0.01"


def exact(ids, x, queries, k=20):
    out = {}
    for q in queries:
        score = (x[ids.index(q)] * x).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def test_recall_against_brute_force(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = v.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    queries = [i for i in ids if i % 20 == 0]
    want = exact(ids, x, queries)
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in queries:
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(s == pytest.approx((x[ids.index(q)] * x[ids.index(i)]).sum(), abs=1e-12) for _, i, s in found)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize(("most", "hashes"), [(4, 12), (1, 9)])
def test_recall_is_held_when_probes_do_not_do(spark, monkeypatch, most, hashes):
    """With few probes allowed projections are left out, and with one of them all rows are compared in the end."""
    monkeypatch.setattr(ann, "MOST_PROBES", most)
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = v.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    queries = [i for i in ids if i % 20 == 0]
    want = exact(ids, x, queries)
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), hashes=hashes).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {w[0] for w in want[q]}) for q in queries) >= 0.9 * 20 * len(queries)


def test_no_setting_reaches_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "settings", lambda *a: None)
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(list(range(300)), x, [20, 40])
    got = {}
    for row in ann.nearest(df, df.where("vec_id in (20, 40)")).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_few_rows_copies_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 0.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as bucket")
    got = [(r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 0.5), (3, 3, -1.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_copies_of_one_vector_are_ranked_by_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(i, [3.0, 2.0, float(i % 7)]) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(df, df.where("vec_id in (50, 3)")).where("query_id = 50").orderBy("rank").collect()]
    x = np.array([r[1] for r in rows])
    assert got == [i for i, _ in exact([r[0] for r in rows], x, [50])[50]]


def test_probes_come_in_order_of_cost():
    h = ann.Hashing(8, 2, 3, 1.0, 1)
    cell, place = h.cells(ann.aimed(np.random.default_rng(1).standard_normal((1, 8))))
    keys = h.probes(cell[:, 0], place[:, 0], 27)[0].tolist()
    costs = []
    for key in keys:
        best = []
        for step in np.ndindex(3, 3, 3):
            d = np.array(step) - 1
            if int(h.keys(cell[0, 0] + d)) == key:
                p = place[0, 0]
                best.append(sum((p[i] if d[i] < 0 else 1 - p[i]) ** 2 for i in range(3) if d[i]))
        costs.append(min(best))
    assert len(set(keys)) == 27 and costs == sorted(costs) and costs[0] == 0


def seen_and_recall(x, probes=None):
    """Share of rows in the visited buckets, and recall, of a query set as the operator would choose them."""
    n = len(x)
    h = ann.Hashing(x.shape[1], 4, max(4, int(np.log2(n)) - 7), 2.0, 7)
    keys = h.keys(h.cells(ann.lifted(x, float(np.sqrt((x * x).sum(axis=1).max()))))[0])
    at = np.arange(0, n, max(20, n // 40))
    cell, place = h.cells(ann.aimed(x[at]))
    seen = np.zeros((len(at), n), bool)
    for t in range(4):
        visits = h.probes(cell[:, t], place[:, t], probes)
        for i, v in enumerate(visits):
            seen[i] |= np.isin(keys[:, t], v)
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    return seen.mean(), np.take_along_axis(seen, best, axis=1).mean(), len(np.unique(keys[:, 0]))


def test_buckets_shrink_as_rows_grow_and_clusters_need_few_probes():
    r = np.random.default_rng(3)
    sizes = []
    for n in (500, 2000, 50_000):
        x = r.standard_normal((n, 64))
        sizes.append(n / seen_and_recall(x / np.linalg.norm(x, axis=1, keepdims=True), 1)[2] / n)
    assert sizes[0] > sizes[1] > 10 * sizes[2]
    centres = r.standard_normal((200, 64))
    x = np.repeat(centres, 100, axis=0) + 0.1 * r.standard_normal((20_000, 64))
    seen, recall, _ = seen_and_recall(x / np.linalg.norm(x, axis=1, keepdims=True), 16)
    assert recall > 0.9 and seen < 0.3


def test_repeated_ids_count_as_their_smallest_vector(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [0.5, 0.0]), (3, [0.2, 2.0])]
    want = [(1, 2, 0.5), (2, 3, 2.0)]
    for parts in (1, 2, 5):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = [(r["vec_id"], r.score) for r in ann.nearest(df, df.where("vec_id = 1")).orderBy("rank").collect()]
        assert sorted(got) == sorted(x[1:] for x in want)
