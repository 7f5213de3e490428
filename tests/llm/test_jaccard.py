import itertools
import random

import corpus_pipeline
import pytest

from wavemill.llm import jaccard


def plain(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def texts(n=160, seed=7):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdé", k=r.randint(2, 6))) for _ in range(300)]
    passage = r.choices(vocab, k=40)
    out = [None, "", " \t\n", "one", "One", "two words", "A b c d e"]
    for _ in range(n // 8):
        base = r.choices(vocab, k=r.randint(5, 250)) + passage * r.randint(0, 1)
        out.append(" ".join(base))
        for _ in range(7):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(copy) // 30)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append("\n".join(copy[r.choice([0, 0, len(copy) // 12]) :]))
    return out


def components(ids, sets):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return [low[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("how", [{}, {"dense": 2, "block": 3000}])
def test_classes_match_all_pairs(spark, how):
    ts = texts()
    ids = random.Random(3).sample(range(1000), len(ts))
    sets = [plain(t) for t in ts]
    df = spark.createDataFrame(list(zip(ids, ts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(df, **how).collect()}
    assert got == dict(zip(ids, components(ids, sets), strict=True))
    linked = sum(0.8 <= similarity(a, b) < 0.9 for a, b in itertools.combinations(sets, 2))
    assert linked > 20


def test_the_stage_drops_copies_of_similarity_0_8(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[20] = near[60] = "x"
    for i in range(10, 100, 20):
        far[i] = "y"
    assert similarity(plain(" ".join(base)), plain(" ".join(near))) >= 0.8 > similarity(plain(" ".join(base)), plain(" ".join(far)))
    df = spark.createDataFrame([(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(far)), (None, " ".join(base))], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.dedup_documents(spark, df, "").collect()) == [0, 5, 7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_copies(df).count() == 0 and jaccard.keep_one(df).count() == 0


def test_a_large_group_of_near_copies_is_not_compared_all_against_all(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[r.randrange(1, 119)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(900, " ".join(base[:60] + [f"y{i}" for i in range(60)]))]
    placed = {}
    keep = jaccard.Store.keep

    def watched(self, df, name):
        placed[name] = keep(self, df, name)
        return placed[name]

    monkeypatch.setattr(jaccard.Store, "keep", watched)
    got = {x.doc_id: x.component_id for x in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), dense=16, block=8_000).collect()}
    assert got == {**{i: 0 for i in range(400)}, 900: 900}
    # About 25 blocks; all pairs of them would be 25 rows for each text.
    assert placed["placed"].count() < 2 * len(rows) and placed["pivots"].count() < 2 * len(rows)


def test_the_covering_search_links_near_copies_first(spark, monkeypatch):
    """Pairs whose fingerprints are near are linked by them, after a check on whole sets, and are not compared again."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(900)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "x"])), (2, " ".join(["y", *base[1:]]))]
    rows += [(10 + i, " ".join(r.choices(base, k=200))) for i in range(5)]
    kept = {}
    keep = jaccard.Store.keep

    def watched(self, df, name):
        kept[name] = keep(self, df, name)
        return kept[name]

    monkeypatch.setattr(jaccard.Store, "keep", watched)
    got = {x.doc_id: x.component_id for x in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, **{10 + i: 10 + i for i in range(5)}}
    near = {f for _, t in rows[:3] for f in [jaccard._digest(jaccard.shingles(t.encode()))]}
    assert {f for e in kept["linked"].collect() for f in (e.u, e.v)} == near
    assert kept["placed"].count() == 0


def test_masked_fingerprints_of_the_stage_are_not_broadcast(spark, monkeypatch):
    plans, keep = {}, jaccard.Store.keep

    def watched(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(jaccard.Store, "keep", watched)
    df = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string")
    corpus_pipeline.dedup_documents(spark, df, "").count()
    assert "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]


def test_sets_that_share_passages_are_no_group(spark, monkeypatch):
    """Shingles of passages that the sample of a large table does not show as common chain no sets together; near copies among them are found."""
    r = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(20)] for k in range(10)]
    rows = []
    for i in range(300):
        own = [f"d{i}w{j}" for j in range(r.choice([60, 70, 80]))]
        rows.append([*passages[i % 10], *own, *passages[r.randrange(10)]])
    for i in range(0, 300, 20):
        copy = list(rows[i])
        copy[len(copy) // 2] = f"x{i}"
        rows.append(copy)
    placed, keep = {}, jaccard.Store.keep

    def watched(self, df, name):
        placed[name] = keep(self, df, name)
        return placed[name]

    none = (jaccard.np.empty(0, jaccard.np.uint64), jaccard.np.empty(0, jaccard.np.int64))
    monkeypatch.setattr(jaccard, "_common", lambda rows, n: none)
    monkeypatch.setattr(jaccard.Store, "keep", watched)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.near_copies(df).collect()}
    sets = [plain(" ".join(t)) for t in rows]
    assert got == dict(enumerate(components(list(range(len(rows))), sets))) and sum(k != v for k, v in got.items()) == 15
    assert placed["placed"].count() <= 30


def test_bitmaps_of_several_lengths_bound_the_difference():
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    ts = [" ".join(base[: r.randint(20, 300)] + [f"z{i}x{j}" for j in range(r.choice([0, 0, 3, 60]))]) for i in range(120)]
    sets = [jaccard.shingles(t.encode()) for t in ts]
    near = jaccard._Maps(jaccard.np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets])
    assert len(near.places) > 2
    for i, a in enumerate(sets):
        marked = near(i)
        for j, b in enumerate(sets):
            n, m = len(a), len(b)
            want = 9 * jaccard.least_difference(jaccard.bitmap(a), jaccard.bitmap(b)) <= n + m and jaccard.similar(min(n, m), n, m)
            assert marked[j] == want
            assert want or not jaccard.similar(len(jaccard.np.intersect1d(a, b)), n, m)
