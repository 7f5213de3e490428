"""The follower and the choice of transients by blocks against plain loops over whole channels."""

import numpy as np
import pytest

from wavemill.operators import follower, ordered
from wavemill.operators.follower import Follower, greedy_exit, greedy_shape, greedy_taken

RATES = [(0.01, 0.0001), (0.5, 0.1), (0.2, 0.01), (0.1, 0.3), (1.0, 0.0), (0.3, 0.3), (0.0, 0.0)]


@pytest.fixture
def many_tasks(spark):
    """Small shuffles keep their partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def followed(v, level, attack, release):
    out = []
    for x in np.abs(v).tolist():
        level += (attack if x > level else release) * (x - level)
        out.append(level)
    return np.array(out)


@pytest.mark.parametrize(("attack", "release"), RATES)
def test_blocks_are_functions_of_their_level(attack, release):
    r, f = np.random.default_rng(1), Follower(attack, release)
    for n in (1, 5, 63, 64, 65, 640, 700):
        v = np.abs(r.normal(size=n) * r.choice([0, 1e-3, 1], n)) if n % 2 else np.abs(np.sin(np.arange(n) / 7))
        low, high = f.ends(v, 3.0)
        assert np.allclose([low, high], [followed(v, e, attack, release)[-1] for e in (0.0, 3.0)], atol=1e-12)
        at, to = f.shape(v, 0.0, 3.0)
        for e in r.uniform(0, 3, 20):
            want = followed(v, e, attack, release)
            assert abs(np.interp(e, at, to) - want[-1]) < 1e-12 and np.allclose(f.output(v, e), want, atol=1e-12)


def test_levels_draw_together():
    """Between the bounds that the block before leaves, a block of usual length has but a few corners."""
    v = np.abs(np.sin(np.arange(65_536) / 40) * np.sin(np.arange(65_536) / 3000))
    f = Follower(0.01, 0.0001)
    assert len(f.shape(v, *f.ends(v, v.max()))[0]) < 50


def channel(spark, x):
    return spark.createDataFrame([("t", 0, i, float(v)) for i, v in enumerate(x)], "track_id string, ch int, idx long, x double")


@pytest.mark.parametrize(("attack", "release", "smooth"), [(0.2, 0.01, 0), (0.01, 0.0001, 64)])
def test_one_channel_over_many_tasks(spark, many_tasks, attack, release, smooth):
    x = np.random.default_rng(2).normal(size=5000) * np.repeat([0.1, 1, 0.01, 0.5, 0], 1000)
    got = ordered.envelope(ordered.to_blocks(channel(spark, x), 100), attack, release, smooth, 100)
    assert got.selectExpr("spark_partition_id() AS p").distinct().count() > 1
    rows = sorted(ordered.from_blocks(got, 100).collect(), key=lambda r: r.idx)
    want = followed(x, 0.0, attack, release)
    if smooth:
        want = np.array([want[max(0, i - 32) : i + 33].mean() if i < 32 or i >= len(want) - 32 else (want[i - 32 : i + 33].sum() - want[64]) / 64 for i in range(len(want))])
    assert np.allclose([r.x for r in rows], want, atol=1e-9)


def plain_greedy(pos, last, distance):
    out = []
    for p in pos:
        if p > last + distance:
            out.append(p)
            last = p
    return out, last


def test_pointers_of_a_block():
    r = np.random.default_rng(3)
    for _ in range(400):
        pos, d, last = np.unique(r.integers(100, 100 + r.integers(1, 200), r.integers(1, 60))), int(r.integers(0, 40)), int(r.integers(-50, 100))
        taken, end = plain_greedy(pos.tolist(), last, d)
        bounds, exits = greedy_shape(pos, d)
        assert greedy_taken(pos, last, d).tolist() == taken
        assert greedy_exit(bounds, exits, int(pos[-1]), last, d) == end


def test_one_run_over_many_blocks(spark, many_tasks, monkeypatch):
    """Every place is a candidate, so that all of them are one run; its blocks are followed in different tasks."""
    monkeypatch.setattr(ordered, "BLOCK", 1000)
    x = np.cumsum(np.ones(20_000))
    found = ordered.find_transients(channel(spark, x), 0.5, 37, mode="step")
    assert found.selectExpr("spark_partition_id() AS p").distinct().count() > 1
    assert sorted(r.pos for r in found.collect()) == plain_greedy(range(1, 20_000), 0, 37)[0]


def test_blocks_side_by_side_are_single_blocks(monkeypatch):
    """Blocks of any lengths, followed in matrices of a few rows, give what each gives alone; equal lengths share their steps."""
    monkeypatch.setattr(follower, "SIDE", 5)
    r = np.random.default_rng(6)
    blocks = [np.abs(r.normal(size=n)) for n in (16, 16, 64, 3, 16, 200, 64, 128, 16, 16, 16, 200, 1)]
    for attack, release in ((0.01, 0.0001), (0.3, 0.05), (0.05, 0.3)):
        f = follower.Follower(attack, release)
        top = [float(r.uniform(1, 4)) for _ in blocks]
        low = [float(r.uniform(0, 0.5)) for _ in blocks]
        assert np.array_equal(f.all_ends(blocks, top), [f.ends(v, t) for v, t in zip(blocks, top)])
        for got, v, a, b in zip(f.all_shapes(blocks, low, top), blocks, low, top):
            want = f.shape(v, a, b)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        for got, v, a in zip(f.all_output(blocks, low), blocks, low):
            assert np.array_equal(got, f.output(v, a))
    monkeypatch.undo()
    calls = []
    lines = follower.Follower.lines
    monkeypatch.setattr(follower.Follower, "lines", lambda self, v: calls.append(v.shape) or lines(self, v))
    follower.Follower(0.01, 0.0001).all_output([np.ones(16)] * 1000, [0.0] * 1000)
    assert calls == [(1000, 16)]


def test_channels_stream_through_a_task(spark):
    """What is carried crosses batches and starts anew with a channel; no channel is a group of its own."""
    rows = spark.range(2000).selectExpr("concat('t', id % 7) AS track_id", "cast(id % 3 AS int) AS ch", "id AS b", "id + 1 AS n")
    df = ordered._carried(rows, "b", 0, lambda now, n: now + int(n), "before", "track_id string, ch int, b long, before long")
    want, sums = {}, {}
    for i in range(2000):
        key = (f"t{i % 7}", i % 3)
        want[(*key, i)] = sums.get(key, 0)
        sums[key] = want[(*key, i)] + i + 1
    assert {(r.track_id, r.ch, r.b): r.before for r in df.collect()} == want
    env = spark.range(50).selectExpr("'a' AS track_id", "0 AS ch", "id AS idx", "cast(id % 9 AS double) AS x")
    for plan in (ordered.find_transients(env, 0.5, 3, mode="step"), ordered.envelope(ordered.to_blocks(env, 16))):
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()
