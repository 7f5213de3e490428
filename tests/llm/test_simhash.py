import itertools
import random

import pytest
import xxhash

from wavemill.llm import simhash
from wavemill.llm.graph import connected_components
from wavemill.llm.store import Store


def plain(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def texts(n=120, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdé", k=r.randint(2, 6))) for _ in range(300)]
    out = [None, "", " \t\n", "one", "One", "two words", "A b c d e"]
    for _ in range(n // 4):
        base = r.choices(vocab, k=r.randint(3, 250))
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append("\n".join(copy))
    return out


def test_fingerprint_is_the_definition():
    for t in texts():
        assert simhash.simhash(None if t is None else t.encode()) == plain(t)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    t = texts()[-1] * 3
    want = simhash.simhash(t.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.simhash(t.encode()) == want == plain(t)


def test_masks_cover_every_small_set_of_positions():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    r = random.Random(1)
    for _ in range(20_000):
        flips = sum(1 << i for i in r.sample(range(64), 4))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("dense", [16384, 2])
def test_components_match_all_pairs(spark, dense):
    r, ts = random.Random(3), texts()
    ids = r.sample(range(1000), len(ts))
    ids[9], ids[10] = None, ids[11]
    df = spark.createDataFrame(list(zip(ids, ts, ["x"] * len(ts), strict=True)), "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, dense=dense).collect()
    fps = [plain(t) for t in ts]
    want = components(ids, fps)
    assert sorted(((g.doc_id or -1, g.fp & (1 << 64) - 1, g.component_id) for g in got), key=str) == sorted(((i or -1, f, c) for i, f, c in zip(ids, fps, want, strict=True)), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_one_document_of_each_class_stays(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "other words here now then"), (2, "other words here now then"), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect()) == [(0, "a b c d e"), (1, "a b c d e"), (2, "other words here now then")]


def test_components_of_chains_and_stars(spark):
    r = random.Random(9)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    edges = chain + star + [(7, 7), (9, 8), (8, 9)]
    r.shuffle(edges)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long"), Store(spark, "t")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 500 for i in range(500, 560)) and got[9] == got[8] == 8 and 7 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long"), Store(spark, "t")).count() == 0


def test_keep_smallest_with_shared_ids(spark):
    """Ids that go, ids of several rows, both at once, null ids and a clashing column."""
    docs = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "c", 2), (3, "b", 3), (4, "b", 4), (4, "z", 5), (None, "a", 6), (5, None, 7), (5, "q", 8)], "doc_id long, text string, stays int")
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (4, 3), (None, 1), (5, 5), (5, 5)], "doc_id long, component_id long")
    got = simhash.keep_smallest(docs, classes, "doc_id", "text")
    assert got.columns == docs.columns
    assert sorted(r.stays for r in got.collect()) == [0, 3, 6, 7]


def test_a_row_for_each_mask_is_never_broadcast(spark, monkeypatch):
    """Spark takes rows of an explode for as few as its source's, so the plan has to say how masked rows are joined."""
    plans, keep = {}, Store.keep

    def watched(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Store, "keep", watched)
    df = spark.range(200).selectExpr("id % 50 * 7 AS fp")
    simhash.links(df.distinct(), Store(spark, "t")).count()
    assert "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]
