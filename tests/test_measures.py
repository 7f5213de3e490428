"""Measures over long channels, text lookups and reports against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from wavemill.operators import evaluate, levels, lsb, ordered
from wavemill.sources import reports


def channel(spark, x, name="t"):
    return spark.createDataFrame([(name, 0, i, float(v)) for i, v in enumerate(x)], "track_id string, ch int, idx long, x double")


def test_many_lags_over_many_blocks(spark):
    x = np.random.default_rng(0).normal(size=5000)
    df = channel(spark, x).unionByName(channel(spark, x[:40], "short")).unionByName(channel(spark, np.zeros(30), "silent"))
    got = {(r.track_id, r.lag): r.r for r in ordered.autocorrelation(df, 1200, block=1300).collect()}
    want = {("t", k): (x[: len(x) - k] @ x[k:]) / (x @ x) for k in range(1201)} | {("short", k): (x[: 40 - k] @ x[k:40]) / (x[:40] @ x[:40]) for k in range(40)} | {("silent", k): 0.0 for k in range(30)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_periods_late_in_a_channel_count(spark):
    """The whole channel is looked at; the short analysis sees its beginning only."""
    n, late = 60_000, 45_000
    i = F.col("id")
    q = F.when(i < late, F.pmod(F.xxhash64("id"), F.lit(256))).otherwise(F.pmod(F.xxhash64(i % 512), F.lit(256)))
    ints = spark.range(n).select(F.lit("t").alias("track_id"), F.lit(0).alias("ch"), i.alias("idx"), q.cast("int").alias("q"), F.lit(0.0).alias("x"))
    whole, first = lsb.lsb_periodicity(ints, gain=1.0).first().periodicity, lsb.lsb_periodicity(ints, gain=1.0, span=10, cap=65_536).first().periodicity
    v = np.array([r.q for r in ints.orderBy("idx").select("q").collect()]) & 255
    assert abs(whole - max((v[p:] == v[:-p]).mean() for p in lsb.PERIODS)) < 1e-9 and whole > 0.2
    assert abs(first - max(m if (m := (v[p : 10 * p] == v[: 9 * p]).mean()) > 0.01 else 0 for p in lsb.PERIODS)) < 1e-9 and first < 0.05


def test_sketch_is_within_its_error(spark):
    x = np.random.default_rng(1).normal(size=20_000)
    for accuracy in (100, 1000):
        low = 10 ** (levels.quality_metrics(channel(spark, x), exact=False, accuracy=accuracy).first().noise_floor / 20)
        assert abs((np.abs(x) < low).sum() - 200) <= 20_000 / accuracy + 1
    assert levels.quality_metrics(channel(spark, np.zeros(50)), exact=False).first().noise_floor == -96.0


def test_genres_by_automaton_and_by_join(spark, monkeypatch):
    tokens = spark.createDataFrame([(3, "jazz", "Jazz"), (1, "acid jazz", "Acid"), (2, "zz", "Zz"), (9, None, "none")], "priority int, token string, genre string")
    texts = ["smooth jazz", "acid jazz", "buzz", "rock", None, "", "ACID JAZZ", "ré jazz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, name string").withColumn("genre_hint", F.lit(1))
    want = ["Zz", "Acid", "Zz", "Unknown", "Unknown", "Unknown", "Unknown", "Zz"]
    got = evaluate.genre_lookup(df, "name", tokens, "id")
    assert [r.genre for r in got.orderBy("id").collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    every = evaluate.genre_lookup(df, "name", tokens.unionByName(spark.createDataFrame([(8, "", "Rest")], tokens.schema)), "id")
    assert [r.genre for r in every.orderBy("id").collect()] == ["Zz", "Acid", "Zz", "Rest", "Unknown", "Rest", "Rest", "Zz"]
    monkeypatch.setattr(evaluate, "TOKENS", 2)
    assert [r.genre for r in evaluate.genre_lookup(df, "name", tokens, "id").orderBy("id").collect()] == want


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"file":"a"}'), (2, '{"file":"b","dynamic_range":{"dr":7}}')], "track_id long, report string")
    for _ in range(2):  # written again, not added to
        reports.write_report(rows, str(tmp_path / "r"))
    got = reports.read_report(spark, str(tmp_path / "r"), "struct<file: string, dynamic_range: struct<dr: long>>").select("r.*").collect()
    assert sorted((r.file, r.dynamic_range and r.dynamic_range.dr) for r in got) == [("a", None), ("b", 7)]


def test_order_statistics_of_close_and_odd_values(spark):
    r = np.random.default_rng(5)
    groups = {"close": 1 + r.integers(0, 1000, 4000) * 1e-9, "one": np.full(50, 3.0), "wide": r.normal(size=3000) * 10.0 ** r.integers(-9, 9, 3000), "odd": np.array([np.inf, -np.inf, 0.0, -0.0, 1.0, np.nan]), "single": np.array([2.5])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("close", None)], "g string, v double")
    for share in (0.0, 0.01, 0.5, 0.999):
        got = {x.g: x.out for x in levels.order_statistic(df, ["g"], "v", F.floor(F.col("n") * share), "out").collect()}
        want = {g: np.sort(x)[int(len(x) * share)] for g, x in groups.items()}
        assert got.keys() == want.keys() and all(got[g] == want[g] or (np.isnan(got[g]) and np.isnan(want[g])) for g in want)
