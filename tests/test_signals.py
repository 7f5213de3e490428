"""Synthetic signals with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import cepstra, evaluate, findings, hum, levels, lsb, ordered, spectra
from wavemill.functions.windows import window_array, window_table


def signal(spark, values, track="t", ch=0):
    return spark.createDataFrame([(track, ch, i, float(v)) for i, v in enumerate(values)], "track_id string, ch int, idx long, x double")


def values(df, col="x"):
    return [r[col] for r in df.orderBy("idx").collect()]


RATE = 1000


def test_sine_crest_is_three_decibels(spark):
    x = 0.8 * np.sin(2 * np.pi * 50 * np.arange(4 * RATE) / RATE)
    r = levels.level_stats(signal(spark, x)).first()
    assert abs(r.crest_db - 3.01) < 0.1


def test_dynamic_range_of_loud_and_quiet_blocks(spark):
    t = np.arange(3 * RATE) / RATE
    x = np.concatenate([(0.9 if k % 2 == 0 else 0.01) * np.sin(2 * np.pi * 40 * t) for k in range(6)])
    r = levels.tt_dr(signal(spark, x), 3 * RATE).first()
    assert abs(r.dr_db - 3.01) < 0.05 and r.blocks == 6


def test_short_and_silent_channels(spark):
    assert levels.tt_dr(signal(spark, [0.5, -0.5]), 10).first().blocks == 1
    quiet = levels.tt_dr(signal(spark, [0.0] * 40), 10).first()
    assert quiet.dr_db == 0.0 and quiet.blocks == 4
    assert levels.integrated_loudness(signal(spark, [0.0] * 100), 5).first().lufs == -70.0


def test_empty_tables_give_no_rows(spark):
    e = signal(spark, [])
    for df in (levels.level_stats(e), levels.tt_dr(e, 10), ordered.clip_runs(e), ordered.pre_emphasis(e), ordered.intersample_peaks(e), levels.quality_metrics(e)):
        assert df.count() == 0


def filtered(x, rate):
    for b, a in ordered.k_coefficients(rate):
        y, z1, z2 = [], 0.0, 0.0
        for v in x:
            o = b[0] * v + z1
            z1, z2 = b[1] * v - a[1] * o + z2, b[2] * v - a[2] * o
            y.append(o)
        x = y
    return x


@pytest.mark.parametrize("rate", [48_000, 44_100])
def test_weighting_is_exact_across_blocks(spark, rate):
    x = np.random.default_rng(1).standard_normal(500) * 0.1
    got = values(ordered.from_blocks(ordered.k_weight(ordered.to_blocks(signal(spark, x), 64), rate), 64))
    assert np.allclose(got, filtered(x.tolist(), rate), atol=1e-10)


def test_impulse_response_of_weighting_dies_out(spark):
    got = values(ordered.from_blocks(ordered.k_weight(ordered.to_blocks(signal(spark, [1.0] + [0.0] * 999), 256), 48_000), 256))
    assert max(map(abs, got)) < 10 and sum(v * v for v in got[900:]) < 1e-4


def test_recursions_across_blocks(spark):
    x = np.random.default_rng(2).uniform(-1, 1, 300)
    y, last = [], 0.0
    for v in x:
        last = v + 0.97 * last
        y.append(last)
    assert np.allclose(values(ordered.from_blocks(ordered.de_emphasis(ordered.to_blocks(signal(spark, x), 50)), 50)), y)
    e, out = 0.0, []
    for v in np.abs(x):
        e += (0.01 if v > e else 0.0001) * (v - e)
        out.append(e)
    assert np.allclose(values(ordered.from_blocks(ordered.envelope(ordered.to_blocks(signal(spark, x), 50)), 50)), out)


def test_clip_runs_across_blocks(spark):
    x = [0.0] * 5 + [1.0] * 20 + [0.0] + [1.0, 1.0] + [0.0] * 3 + [-1.0] * 3
    for block in (4, 7, 1000):
        got = sorted((r.start, r.end) for r in ordered.clip_runs(signal(spark, x), block=block).collect())
        assert got == [(5, 25), (31, 34)]


def test_neighbours_do_not_depend_on_the_block(spark):
    from wavemill.operators.blocks import neighbours

    s = signal(spark, range(40)).select("track_id", "ch", "idx", "x")
    want = neighbours(s, "x", [-3, 2], block=1000).orderBy("idx").collect()
    assert neighbours(s, "x", [-3, 2], block=5).orderBy("idx").collect() == want
    assert want[0].x_m3 is None and want[5].x_m3 == 2.0 and want[5].x_p2 == 7.0


def moving(x, w):
    """The running sum as it is defined: starts at w samples, adds half a window ahead, drops behind."""
    n, h, out = len(x), w // 2, []
    if n < w or w == 0:
        return list(x)
    total = sum(x[:w])
    for i in range(h):
        out.append(sum(x[: i + h + 1]) / (i + h + 1))
    for i in range(h, n - h):
        if i > h:
            total += x[i + h] - x[i - h - 1]
        out.append(total / w)
    for i in range(n - h, n):
        out.append(sum(x[i - h :]) / (n - i + h))
    return out[:n]


@pytest.mark.parametrize("w", [1, 2, 3, 4, 5, 8, 50])
def test_moving_average(spark, w):
    x = np.random.default_rng(3).uniform(-1, 1, 30).tolist()
    assert np.allclose(values(ordered.moving_average(signal(spark, x), w)), moving(x, w))


def test_bit_entropies(spark):
    ints = signal(spark, range(256)).withColumn("q", F.col("idx").cast("int"))
    assert lsb.lsb_bit_entropy(ints).first().entropy == pytest.approx(1.0)
    assert lsb.lsb_nibble_entropy(ints).first().entropy == pytest.approx(1.0)
    assert lsb.lsb_byte_entropy(ints, normalize=False).first().entropy > 7.9
    assert lsb.lsb_byte_entropy(ints.withColumn("q", F.lit(3))).first().entropy == 0.0


def test_padded_sixteen_bits_are_seen(spark):
    x = np.random.default_rng(4).integers(-30000, 30000, 3000) / 32768
    s = signal(spark, x).withColumn("q", F.round(F.col("x") * 8388608).cast("int"))
    assert lsb.trailing_zero_profile(s).first().ratio_8_plus == 1.0
    votes = spark.createDataFrame([("t", 0, 16, 0.98)] * 3 + [("t", 0, 24, 0.4)], "track_id string, ch int, bits int, conf double")
    r = lsb.vote_bit_depth(votes, 24).first()
    assert r.actual_bits == 16


def test_windows(spark):
    for kind in ("hann", "hamming", "blackman", "blackman_harris", "rect", "flat_top"):
        got = [r.w for r in window_table(spark, kind, 16).orderBy("n").collect()]
        assert np.allclose(got, window_array(kind, 16))
    assert np.allclose([r.w for r in window_table(spark, "kaiser", 16, True, 8.6).orderBy("n").collect()], np.kaiser(16, 8.6))


def test_dft_is_the_fft(spark):
    x = np.random.default_rng(5).standard_normal(64)
    f = spark.createDataFrame([(1, 0, x.tolist())], "track_id int, frame_no int, x array<double>")
    for window in ("rect", "hann"):
        a = [r.mag for r in spectra.fft_magnitude(f, 64, window, method="dft").orderBy("k").collect()]
        b = [r.mag for r in spectra.fft_magnitude(f, 64, window, method="fft").orderBy("k").collect()]
        assert np.allclose(a, b) and np.allclose(a, np.abs(np.fft.rfft(x * window_array(window, 64))))


def comb(top, rate=44_100, n=32_768):
    t = np.arange(n) / rate
    return 0.3 * sum(np.sin(2 * np.pi * 100 * h * t + h) / math.sqrt(h) for h in range(1, int(top / 100) + 1))


def test_cutoff_of_a_harmonic_comb(spark):
    found = []
    for top in (16_000, 21_900):
        s = signal(spark, comb(top) + np.random.default_rng(6).standard_normal(32_768) * 1e-6)
        f = spectra.frame(s, 8192, 0, plan="spread40")
        spectrum = spectra.averaged_spectrum_db(spectra.fft_magnitude(f, 8192, "blackman_harris"))
        found.append(spectra.detect_cutoff(spectrum, 44_100, 8192).first().cutoff_hz)
    assert 14_000 < found[0] < 18_000 and (found[1] is None or found[1] > 20_000)


def test_mfcc_against_numpy(spark):
    x = np.random.default_rng(7).standard_normal((4, 64))
    f = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "track_id int, frame_no int, x array<double>")
    got = cepstra.mfcc(spectra.dft(f, 64), 16_000, 64, 12, 6).orderBy("frame_no", "c").collect()
    bank = np.zeros((12, 33))
    for r in cepstra.mel_filterbank(spark, 12, 64, 16_000).collect():
        bank[r.m, r.k] = r.w
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    logs = np.log(np.maximum(power @ bank.T, 1e-10))
    m = np.arange(12)
    want = [[logs[i] @ np.cos(np.pi * c * (2 * m + 1) / 24) * math.sqrt((1 if c == 0 else 2) / 12) * (1 + 11 * math.sin(math.pi * c / 22)) for c in range(6)] for i in range(4)]
    assert np.allclose([r.v for r in got], np.ravel(want))


def test_similarity_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [2.0, 0.0]), (2, [1.0], [1.0, 2.0]), (3, [0.0, 0.0], [1.0, 1.0])], "i int, a array<double>, b array<double>")
    got = rows.select("i", cepstra.cosine("a", "b").alias("c"), cepstra.euclid("a", "b").alias("e")).orderBy("i").collect()
    assert [r.c for r in got] == [1.0, 0.0, 0.0] and got[1].e == math.inf and got[0].e == 1.0


def test_hum_of_fifty_hertz(spark):
    rate, size = 2000, 2000
    t = np.arange(4 * rate) / rate
    x = 0.001 * np.sin(2 * np.pi * 50 * t) + 0.0005 * np.sin(2 * np.pi * 100 * t) + 0.00025 * np.sin(2 * np.pi * 150 * t) + np.random.default_rng(8).standard_normal(len(t)) * 1e-6
    m = spectra.fft_magnitude(spectra.frame(signal(spark, x), size, 1000), size, "hann", sym=False)
    spectrum = hum.hires_spectrum(m, rate / size, 7)
    base = hum.base_frequency(spectrum, rate / size)
    assert base.first().base == 50.0 and base.first().confidence > 0.3
    h = hum.hum_harmonics(spectrum, base, rate, rate / size)
    assert h.where("confidence > 0.5").count() >= 2
    trace = hum.track_frequency(m, base, rate, size)
    assert trace.count() == 7 and abs(trace.first().freq - 50.25) < 0.01
    assert hum.enf_summary(h, trace, base).first().detected


def test_true_peak_of_a_sine_between_samples(spark):
    x = np.sin(2 * np.pi * np.arange(200) / 4 + np.pi / 4)
    r = ordered.true_peak(signal(spark, x), gain="reference").first()
    assert r.sample_peak_db == pytest.approx(-3.01, abs=0.01) and r.true_peak_db > -3.0


def test_transients_and_echo(spark):
    x = [0.001] * 3000 + [0.9] * 2000
    t = ordered.find_transients(signal(spark, x), 0.1, 100, mode="step")
    assert [r.pos for r in t.collect()] == [3000]
    r = ordered.pre_echo_events(signal(spark, x), t, 20).first()
    assert r.transients == 1 and r.echoes == 0


def test_strict_and_tolerant_scores(spark):
    rows = [(True, [], True, [], "Pass"), (True, [], False, ["a"], "FalsePositive"), (False, ["a"], True, [], "FalseNegative"), (False, [], False, ["b"], "Pass"), (False, ["a"], False, ["b"], "WrongDefectType"), (False, ["a"], False, ["a", "b"], "ExtraDefects"), (False, ["a", "b"], False, ["a"], "PassWithWarning"), (False, ["a"], False, ["a"], "Pass")]
    df = spark.createDataFrame(rows, "should_pass boolean, expected array<string>, is_clean boolean, found array<string>, want string")
    assert all(r.result == r.want for r in evaluate.score_strict(df).collect())
    rows = [(True, None, [], ["t"], False, ["t"], "PassWithExtra"), (False, "a", ["b"], [], False, ["b"], "PassWithAlternative"), (False, "a", [], [], False, ["a", "x"], "PassWithExtra"), (False, "a", [], [], False, ["x"], "WrongDefectType")]
    df = spark.createDataFrame(rows, "should_be_clean boolean, primary_defect string, alternative_defects array<string>, tolerated_extras array<string>, is_clean boolean, found array<string>, want string")
    assert all(r.result == r.want for r in evaluate.score_tolerant(df).collect())


def test_reports_that_cannot_be_read_are_clean(spark):
    df = spark.createDataFrame([("{oops",), ('{"verdict": {"genuine": false}, "detections": [{"severity": "high", "defect_type": {"UpsampledLossyTranscode": {"codec": "aac"}}}]}',), (None,)], "j string")
    got = evaluate.normalize_findings(df, "j").collect()
    assert (got[0].is_clean, got[0].found) == (True, []) and (got[1].is_clean, got[1].found) == (False, ["Upsampled", "AacTranscode"]) and got[2].is_clean


def test_profiles(spark):
    f = spark.createDataFrame([("t", "SpectralCutoff", 0.9), ("t", "PreEcho", 0.5), ("t", "Unknown", 0.4)], "track_id string, detector string, confidence double")
    got = {r.detector: r for r in findings.apply_profile(f, "podcast").collect()}
    assert set(got) == {"Unknown"} and got["Unknown"].adjusted == pytest.approx(0.2)
    table, sensitivity = findings.custom_profile(spark, "standard", 5.0, {"PreEcho": 0.5}, suppressed=("SpectralCutoff",))
    got = {r.detector: r for r in findings.apply_profile(f, "custom", table, sensitivity).collect()}
    assert sensitivity == 2.0 and got["SpectralCutoff"].suppressed and got["PreEcho"].adjusted == pytest.approx(0.5)
