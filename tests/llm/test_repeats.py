"""Repeated byte strings against brute force: suffix arrays, anchors, shards, and the registered query."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import queries, repeats
from wavemill.llm.suffix_array import common_prefixes, merge_runs, suffix_array

DATA = "/root/testdata/sf0.001"


def byte_strings(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        n, k = r.randint(1, 300), r.choice([1, 2, 4, 255])
        t = bytes(r.randrange(k) for _ in range(n))
        yield t + t[r.randrange(n) :] * r.randint(0, 3)


def test_suffix_arrays_and_prefixes():
    for t in byte_strings(0, 150):
        data = np.frombuffer(t, np.uint8)
        order = suffix_array(data)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for most, lane in ((10**6, 7), (12, 512)):
            got = common_prefixes(data, order, most, lane).tolist()
            want = [0] + [next(k for k in range(len(t) + 1) if k == most or t[a + k : a + k + 1] != t[b + k : b + k + 1] or not t[a + k : a + k + 1]) for a, b in zip(order, order[1:], strict=False)]
            assert got == want


def test_runs_are_merged():
    r = np.random.default_rng(0)
    for n in (1, 2, 5):
        runs = [np.unique(r.integers(0, 60, r.integers(0, 30))) for _ in range(n)]
        times = Counter(x for run in runs for x in run.tolist())
        assert merge_runs(runs).tolist() == sorted(x for x, k in times.items() if k > 1)


def test_stretches_hold_every_string_once(monkeypatch):
    """Each string of a text lies in the stretch of one anchor, and equal strings have equal hashes; long texts are cut."""
    monkeypatch.setattr(repeats, "BLOCK", 1500)
    r = random.Random(1)
    part = bytes(r.randrange(97, 105) for _ in range(700))
    texts = [b"x" * 500, part, b"?" + part[100:600], b"short", b"", bytes(r.randrange(2) for _ in range(5000)), part * 5, b"y" * 199 + b"z"]
    seen, hashes = Counter(), {}
    for data, ends, parts in repeats._blocks(texts, 200):
        h, start, end = repeats.anchors(data, ends, 200)
        for x, s, e in zip(h.tolist(), start.tolist(), end.tolist(), strict=True):
            p = int(np.searchsorted(ends, s, side="right"))
            text, begin = parts[p]
            at = s - (int(ends[p - 1]) if p else 0) + begin
            assert data[s:e].tobytes() == texts[text][at : at + e - s]
            for k in range(at, at + e - s - 199):
                seen[text, k] += 1
                assert hashes.setdefault(texts[text][k : k + 200], x) == x
    assert seen == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 199))


def plain_kept(texts, length=200):
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        yield bytes(np.frombuffer(t, np.uint8)[~flags]), int(flags.sum()), int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())


def check(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in ("k1", "spans", "h", "start", "a.b")})
    df.write.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_repeats(spark, str(folder)).collect()), key=str)
    texts = [(t or "").encode() for _, t in rows]
    want = sorted(((i, len(t), n, k, hashlib.sha256(left).hexdigest()) for (i, _), t, (left, n, k) in zip(rows, texts, plain_kept(texts), strict=True)), key=str)
    assert got == want
    return got


def shared_texts(seed, count=60):
    """Passages in changing surroundings, copies, near copies, periodic stretches, and text of more than one byte a character."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeäß☃\0") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (30, 45, 60, 100)] + ["=" * 300, "ab " * 120]
    for i in range(count):
        t = prose(r.randint(0, 40)) + r.choice(["", " "]) + r.choice(passages) + prose(r.randint(0, 40))
        if i % 7 == 0:
            t = passages[3] + passages[0] + passages[3]
        yield i, t
    yield from [(1, passages[1]), (1, passages[1]), (None, passages[2]), (90, None), (91, ""), (92, "x" * 199), (93, "y" * 200), (94, "z" * 201), (95, "q" * 5000)]


@pytest.mark.parametrize("seed", range(2))
def test_query_on_shared_passages(spark, tmp_path, seed):
    assert sum(r[2] > 0 for r in check(spark, list(shared_texts(seed)), tmp_path)) > 40


def test_split_hashes_are_merged(spark, tmp_path, monkeypatch):
    """A hash with many different stretches is dealt to several shards, whose strings meet in sorted runs."""
    monkeypatch.setattr(repeats, "SPLIT", 3)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    check(spark, list(shared_texts(5, 120)), tmp_path)
    r = random.Random(2)
    core = "the same thirty-two bytes and more of them, " * 2
    rows = [(i, f"{r.random()} {i % 9} some words {core} {i % 7} other words {'and so on ' * 9}{r.random()}") for i in range(200)]
    check(spark, rows, tmp_path / "core")


def test_query_on_the_driver_table(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 20000 or text is null").collect()]
    check(spark, rows, tmp_path)


def test_long_text(spark, tmp_path):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh \n") for _ in range(1_300_000))
    check(spark, [(1, long), (2, "ü" + long[1_048_400:1_048_900]), (3, "a" * 2000)], tmp_path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_repeats(spark, str(tmp_path)).collect() == []


def test_near_copies_make_rows_in_proportion(spark, tmp_path, monkeypatch):
    """Very many near copies of one text give a few rows for each of their stretches, not one for each of their strings."""
    monkeypatch.setattr(repeats, "SPLIT", 20)
    made, keep = Counter(), repeats.Store.keep

    def counted(self, df, name):
        table = keep(self, df, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(repeats.Store, "keep", counted)
    r = random.Random(7)
    words = [f"{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(240):
        w = list(words)
        for _ in range(3):
            w[r.randrange(120)] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(spark, rows, tmp_path)
    later = {n: k for n, k in made.items() if n not in ("again", "anchors", "stretches")}
    assert sum(later.values()) < 15 * made["stretches"], made
