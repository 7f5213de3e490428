"""Runs of words against brute force: the search, its parts, and the registered query."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import periodic, queries
from wavemill.llm.suffix_tree import RangeMinimum, SuffixTree

DATA = "/root/testdata/sf0.001"


def plain_runs(w, min_length=24, min_exponent=3):
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(min_length, min_exponent * q):
                found.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def strings(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        k, n = r.choice([1, 2, 3, 5]), r.randint(0, 70)
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 2)):
            a, p, m = r.randrange(n + 1), r.randint(1, 12), r.randint(0, n)
            for i in range(a + p, min(n, a + p + m)):
                w[i] = w[i - p]
        yield w


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (4, 2), (9, 3), (12, 4)])
def test_runs(least, exponent):
    for w in strings(least, 400):
        assert periodic.word_runs(w, least, exponent) == plain_runs(w, least, exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_extensions_and_ranks(w):
    n, tree = len(w), SuffixTree(np.asarray(w) + 1)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    i, j = i[i < j], j[i < j]
    common = [next(k for k in range(n + 1) if b + k >= n or w[a + k] != w[b + k]) for a, b in zip(i, j, strict=True)]
    assert tree.extension(i, j).tolist() == common
    for reverse in (False, True):
        order = sorted(range(n + 1), key=lambda k: [-x if reverse else x for x in w[k:]])
        assert np.argsort(tree.ranks(reverse)).tolist() == order


def test_range_minimum():
    r = np.random.default_rng(0)
    for n in (1, 15, 16, 17, 400):
        x = r.integers(0, 50, n)
        a, b = np.sort(r.integers(0, n, (2, 300)), axis=0)
        assert RangeMinimum(x).query(a, b).tolist() == [x[s : e + 1].min() for s, e in zip(a, b, strict=True)]


def test_stretches_leave_ordinary_text_out():
    r = np.random.default_rng(1)
    w = r.integers(0, 400, 30_000)
    w[5000:5030], w[25_000:25_030] = w[100:130], w[100:130]  # far copies are no runs
    w[9000:9100] = np.tile(w[9000:9010], 10)
    assert [(a <= 9000, b >= 9100, b - a < 150) for a, b in periodic.stretches(w.astype(np.uint64), 24, 3)] == [(True, True, True)]


def test_deep_and_long_runs():
    assert periodic.word_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    assert periodic.word_runs([i % 16_000 for i in range(50_000)]) == [(0, 50_000, 16_000)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            w[i] = w[a + (i - a) % p]
    runs = plain_runs(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(kept))


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 12000 or text is null")
    more = [(900_000 + i, " ".join(f"w{x}" for x in w)) for i, w in enumerate(strings(3, 150))] + [(None, "a b " * 40), (7, "x " * 30), (7, "x " * 30), (8, None), (9, ""), (10, " \x0b\n")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic(spark, str(tmp_path)).collect()
    want = sorted(((r.doc_id, *expected(r.doc_id, r.text)) for r in rows.collect()), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want and sum(r.n_runs > 0 for r in got) > 20
