"""Frames by blocks against plain slices, few bins against whole transforms, and hum analysis under its presets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions.windows import window_array
from wavemill.operators import hum, kernel, spectra
from wavemill.plans import registry


def table(spark, channels):
    rows = [(t, c, i, float(v)) for (t, c), x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "track_id string, ch int, idx long, x double").orderBy(F.rand(1))


@pytest.mark.parametrize(("size", "hop"), [(16, 4), (16, 16), (50, 7), (10, 25)])
def test_frames_cross_blocks(spark, size, hop):
    r = np.random.default_rng(size)
    channels = {("a", 0): r.normal(size=333), ("a", 1): r.normal(size=size), ("b", 0): r.normal(size=size - 1), ("c", 0): r.normal(size=101)}
    got = kernel.framed(table(spark, channels), size, hop, np.asarray, "x", block=50).collect()
    want = {(t, c, f): (f * hop, x[f * hop : f * hop + size]) for (t, c), x in channels.items() for f in range((len(x) - size) // hop + 1 if len(x) >= size else 0)}
    assert {(r.track_id, r.ch, r.frame_no) for r in got} == want.keys() and len(got) == len(want)
    assert all(r.start_idx == want[r.track_id, r.ch, r.frame_no][0] and np.array_equal(r.x, want[r.track_id, r.ch, r.frame_no][1]) for r in got)


def test_spread_frames_and_limits(spark):
    r = np.random.default_rng(0)
    channels = {("a", 0): r.normal(size=1000), ("b", 0): r.normal(size=40), ("c", 0): r.normal(size=30)}
    got = kernel.framed(table(spark, channels), 20, 0, np.asarray, "x", "spread", 8, block=100).collect()
    want = {(t, f): f * ((len(x) - 20) // 8) for (t, _), x in channels.items() if len(x) >= 40 for f in range(8)}
    assert {(r.track_id, r.frame_no): r.start_idx for r in got} == want
    assert all(np.array_equal(r.x, channels[r.track_id, 0][r.start_idx : r.start_idx + 20]) for r in got)
    few = kernel.framed(table(spark, channels), 20, 5, np.asarray, "x", most=3, length=30, block=100).collect()
    assert {(r.track_id, r.frame_no) for r in few} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", 0)}


def test_few_bins_are_those_of_the_whole_transform():
    x = np.random.default_rng(1).normal(size=(5, 4096))
    whole = np.abs(np.fft.rfft(x * window_array("hann", 4096, False), axis=1))
    for low, high in ((10, 40), (0, 341), (2000, 2049)):
        assert np.allclose(kernel.magnitudes(4096, "hann", False, (low, high))(x), whole[:, low:high], atol=1e-9)


def test_bins_summed_over_scattered_samples(spark, monkeypatch):
    """Samples in any order and any number of partitions give the bins of whole frames, and are not shuffled."""
    monkeypatch.setattr(kernel, "OPEN", 7)
    r = np.random.default_rng(5)
    channels = {("a", 0): r.normal(size=700), ("a", 1): r.normal(size=130), (None, 0): r.normal(size=257), ("b", 0): r.normal(size=63)}
    for size, hop, length in ((64, 32, 64), (64, 50, 100), (64, 100, 64)):
        rows = table(spark, channels).repartition(5)
        df = kernel.summed_bins(rows, size, hop, (3, 20), length=length)
        got = {(x.track_id, x.ch, x.frame_no, x.k): x.mag for x in df.collect()}
        want = {}
        for (t, c), x in channels.items():
            for f in range((len(x) - length) // hop + 1 if len(x) >= length else 0):
                m = np.abs(np.fft.rfft(x[f * hop : f * hop + size] * window_array("hann", size, False)))
                want |= {(t, c, f, k): m[k] for k in range(3, 20)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_hum_trace_shuffles_sums_not_samples(spark):
    n = 300_000
    s = spark.range(n).select(F.lit("t").alias("track_id"), F.lit(0).alias("ch"), F.col("id").alias("idx"), F.sin(F.col("id") * 0.02).alias("x"))
    base = spark.createDataFrame([("t", 50.0)], "track_id string, base double")
    tree = hum.hum_trace(s, base, 16_384, "fast")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in tree and "REPARTITION_BY_COL" not in tree


def test_median_of_frames_is_the_median_of_spectra(spark):
    channels = {("a", 0): np.random.default_rng(2).normal(size=3000), ("b", 0): np.random.default_rng(3).normal(size=600)}
    frames = spectra.frame_magnitudes(table(spark, channels), 256, 64, "hann", plan="spread")
    want = {(r.track_id, r.k): r.db for r in spectra.median_power_db(frames.select("track_id", "frame_no", F.posexplode("mag").alias("k", "mag")), 256).collect()}
    got = {(r.track_id, r.k): r.db for r in spectra.median_of_frames_db(frames, 256).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("preset", list(hum.PRESETS))
def test_presets_on_a_long_track(spark, preset):
    """The trace and the spectrum agree with whole transforms of the same frames."""
    n, size, hop = 200_000, hum.PRESETS[preset]["size"], hum.PRESETS[preset]["hop"]
    rate = size  # bins of 1 Hz; wider ones hold no bin within 1 Hz of the target
    i = np.arange(n)
    x = 0.3 * np.sin(2 * np.pi * 60 * i / rate) + 0.1 * np.sin(2 * np.pi * 120 * i / rate) + 1e-3 * np.random.default_rng(4).normal(size=n)
    rows = spark.range(n).select(F.lit("t").alias("track_id"), F.lit(0).alias("ch"), F.col("id").alias("idx"))
    values = spark.createDataFrame([(int(b), x[b * 1000 : (b + 1) * 1000].tolist()) for b in range(200)], "b long, v array<double>")
    s = rows.join(values, F.floor(F.col("idx") / 1000) == F.col("b")).select("track_id", "ch", "idx", F.get("v", (F.col("idx") % 1000).cast("int")).alias("x"))
    starts = [f * hop for f in range(min(32, n // hop)) if f * hop + size <= n]
    whole = np.array([np.abs(np.fft.rfft(x[a : a + size] * window_array("blackman_harris", size, False))) for a in starts]).sum(axis=0) / min(32, n // hop)
    got = {r.k: r.mag for r in hum.hum_spectrum(s, rate, preset).collect()}
    assert len(got) == int(np.ceil(500 * size / rate)) and all(abs(m - whole[k]) < 1e-7 * (1 + whole[k]) for k, m in got.items())
    base = spark.createDataFrame([("t", 60.0)], "track_id string, base double")
    trace = sorted(hum.hum_trace(s, base, rate, preset).collect(), key=lambda r: r.t)
    res, want = rate / size, []
    for f in range((n - rate) // (rate // 2) + 1):
        m = np.abs(np.fft.rfft(x[f * (rate // 2) : f * (rate // 2) + size] * window_array("hann", size, False)))
        c, reach = int(120 / res), int(1 / res)
        want.append((c - reach + int(np.argmax(m[c - reach : c + reach])) + 0.5) * res / 2)
    assert [round(r.freq, 9) for r in trace] == [round(v, 9) for v in want] and all(r.confidence > 0.3 for r in trace)
    r = hum.hum_analysis(s, rate, preset).first()
    assert r.base == 60 and r.points == len(trace) and r.region == "NorthAmerica" and r.detected and r.traced == (preset != "sensitive")


@pytest.mark.parametrize("preset", list(hum.PRESETS))
def test_hum_queries(spark, preset):
    r = registry.queries()[f"hum_analysis_{preset}"](spark, "/root/testdata/sf0.001").collect()
    assert [x.base for x in r] == [50.0]
