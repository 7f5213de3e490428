"""Mains hum: harmonics, their frequency over time, jumps and dropouts.

A track's spectrum is ``(track_id, k, mag)`` with ``res`` Hz for each bin; a trace is
``(track_id, t, freq, confidence, strength_db)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.operators.kernel import framed, magnitudes, summed_bins

# Transform length, hop, least ratio in decibels and frames of a trace of each preset.
PRESETS = {
    "default": {"size": 32_768, "hop": 8192, "min_snr_db": 3.0, "min_frames": 10},
    "sensitive": {"size": 65_536, "hop": 8192, "min_snr_db": 1.5, "min_frames": 10},
    "fast": {"size": 16_384, "hop": 8192, "min_snr_db": 3.0, "min_frames": 5},
}
TOLERANCE = 0.5
# Bands in Hz that hold no harmonic of 50 or 60 Hz.
QUIET = ((70, 90), (130, 150), (190, 210), (250, 280))


def hires_spectrum(spectra: DataFrame, res: float, planned: int, max_hz: float = 500.0) -> DataFrame:
    """Mean magnitude over the frames that were planned, up to a frequency."""
    return spectra.where(F.col("k") * res < max_hz).groupBy("track_id", "k").agg((F.sum("mag") / planned).alias("mag"))


def hum_spectrum(samples: DataFrame, rate: int, preset: str = "default", max_hz: float = 500.0) -> DataFrame:
    """``(track_id, k, mag)`` of the bins below ``max_hz``: the mean over frames of a long transform, as ``hires_spectrum``.

    The bins are all that leaves the transform.  A track is planned a frame for each hop, 32 at most, and must hold two transforms.
    """
    size, hop = PRESETS[preset]["size"], PRESETS[preset]["hop"]
    make = magnitudes(size, "blackman_harris", False, (0, math.ceil(max_hz * size / rate)))
    frames = framed(samples, size, hop, make, "mag", most=32)
    planned = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * size)
    planned = planned.select("track_id", F.least(F.floor(F.col("n") / hop), F.lit(32)).alias("planned"))
    bins = frames.select("track_id", F.posexplode("mag").alias("k", "mag")).groupBy("track_id", "k").agg(F.sum("mag").alias("mag"))
    return bins.join(planned, "track_id").select("track_id", "k", (F.col("mag") / F.col("planned")).alias("mag"))


def hum_trace(samples: DataFrame, base: DataFrame, rate: int, preset: str = "default", window_s: float = 1.0) -> DataFrame:
    """What ``track_frequency`` gives, from samples: of each frame only the bins near twice 50 and 60 Hz are computed.

    A trace of fewer than two frames is none.
    """
    size, frame = PRESETS[preset]["size"], int(window_s * rate)
    if frame < size:
        return track_frequency(spectrum_frames(samples.limit(0), size, rate, (0, 1)), base, rate, size, window_s)
    res = rate / size
    # A peak lies within 1 Hz, its flanks within 3 Hz of the target.
    bins = (max(0, math.floor(97 / res) - 2), min(size // 2, math.ceil(123 / res) + 2))
    spectra = spectrum_frames(samples, size, rate, bins, frame).persist()
    several = spectra.groupBy("track_id").agg(F.max("frame_no").alias("last")).where("last >= 1").select("track_id")
    return track_frequency(spectra.join(several, "track_id", "left_semi"), base, rate, size, window_s)


def spectrum_frames(samples: DataFrame, size: int, rate: int, bins: tuple[int, int], frame: int | None = None) -> DataFrame:
    """``(track_id, frame_no, k, mag)`` of some bins of the first ``size`` samples of frames that start each half frame."""
    frame = frame or size
    return summed_bins(samples, size, frame // 2, bins, length=frame).select("track_id", "frame_no", "k", "mag")


def hum_analysis(samples: DataFrame, rate: int, preset: str = "default") -> DataFrame:
    """The whole analysis of recordings under a preset: ``enf_summary`` with the number of jumps and dropouts.

    The bins of the spectrum and of the trace's frames, all that is left of the samples, are persisted for the steps that read them.  Tracks shorter than two transforms, or without a base, have no row.
    """
    p, res = PRESETS[preset], rate / PRESETS[preset]["size"]
    spectrum = hum_spectrum(samples, rate, preset).persist()
    base = base_frequency(spectrum, res).where("confidence >= 0.3")
    trace = hum_trace(samples, base, rate, preset)
    summary = enf_summary(hum_harmonics(spectrum, base, rate, res), trace, base, p["min_snr_db"])
    events = enf_anomalies(trace).groupBy("track_id").agg(F.count(F.lit(1)).alias("anomalies"))
    points = trace.groupBy("track_id").agg(F.count(F.lit(1)).alias("points"))
    out = summary.join(points, "track_id", "left").join(events, "track_id", "left").fillna(0, ["points", "anomalies"])
    return out.withColumn("traced", F.col("points") >= p["min_frames"])


def _energy(base: float, res: float, n: int = 4) -> Column:
    """Over the bins of a group: root of the squared peaks within 2 Hz of the first harmonics."""
    reach, total = int(2 / res), F.lit(0.0)
    for h in range(1, n + 1):
        c = int(base * h / res)
        peak = F.coalesce(F.max(F.when((F.col("k") >= max(0, c - reach)) & (F.col("k") < c + reach), F.col("mag"))), F.lit(0.0))
        total = total + peak * peak
    return F.sqrt(total)


def _quiet(res: float) -> Column:
    inside = F.lit(False)
    for low, high in QUIET:
        inside = inside | ((F.col("k") >= int(low / res)) & (F.col("k") < int(high / res)))
    return inside


def _upper_median(values: Column) -> Column:
    """Of the non-null values in a group's bins, whose number the bands of a spectrum bound; null if there are none."""
    m = F.array_sort(F.collect_list(values))
    return F.get(m, F.floor(F.size(m) / 2).cast("int"))


def harmonic_energy(spectrum: DataFrame, base: float, res: float, n: int = 4) -> DataFrame:
    """``(track_id, energy)``: root of the squared peaks within 2 Hz of the first harmonics."""
    return spectrum.groupBy("track_id").agg(_energy(base, res, n).alias("energy"))


def hum_noise_floor(spectrum: DataFrame, res: float) -> DataFrame:
    """``(track_id, floor)``: upper median of the magnitudes in the quiet bands; tracks without such bins have no row."""
    return spectrum.where(_quiet(res)).groupBy("track_id").agg(_upper_median(F.col("mag")).alias("floor"))


def base_frequency(spectrum: DataFrame, res: float) -> DataFrame:
    """``(track_id, base, confidence)``: 50 or 60 Hz by the ratio of energy to the floor; 50 and 0 where it is weak."""
    e = spectrum.groupBy("track_id").agg(_energy(50.0, res).alias("e50"), _energy(60.0, res).alias("e60"), _upper_median(F.when(_quiet(res), F.col("mag"))).alias("floor"))
    ratio = lambda c: F.when(F.col("floor") > 0, F.col(c) / F.col("floor")).otherwise(0.0)
    e = e.withColumns({"s50": ratio("e50"), "s60": ratio("e60")})
    is50, is60 = (F.col("s50") > F.col("s60")) & (F.col("s50") > 2), (F.col("s60") > F.col("s50")) & (F.col("s60") > 2)
    conf = lambda c: F.least(F.lit(0.95), F.col(c) / (F.col("s50") + F.col("s60") + 0.1))
    return e.select("track_id", F.when(is60, 60.0).otherwise(50.0).alias("base"), F.when(is50, conf("s50")).when(is60, conf("s60")).otherwise(0.0).alias("confidence"))


def peak_near(spectrum: DataFrame, targets: DataFrame, res: float, tol: float) -> DataFrame:
    """``(track_id, target, freq, strength, snr)`` for rows ``(track_id, target)``: the largest bin near each target over its flanks' upper median.

    A target meets only the bins of its own window; other columns of ``targets`` stay.
    """
    reach = int(tol / res)
    keys = ["track_id", "target"]
    t = targets.withColumn("c", F.floor(F.col("target") / res))
    last = spectrum.groupBy("track_id").agg((F.max("k") + 1).alias("bins"))
    t = t.join(last, "track_id", "left").withColumns({"s": F.greatest(F.lit(0), F.col("c") - reach), "e": F.least(F.col("c") + reach, F.col("bins"))})
    low, high = F.greatest(F.lit(0), F.col("s") - 2 * reach), F.least(F.col("e") + 2 * reach, F.col("bins"))
    wanted = t.where("e > s").select(*keys, "s", "e", F.explode(F.sequence(low, high - 1)).alias("k"))
    j = wanted.join(spectrum.select("track_id", "k", "mag"), ["track_id", "k"])
    core = (F.col("k") >= F.col("s")) & (F.col("k") < F.col("e"))
    peak = j.groupBy(*keys).agg(F.max(F.when(core, F.col("mag"))).alias("strength"), F.max_by("k", F.when(core, F.struct("mag", -F.col("k")))).alias("k"), F.min("s").alias("start"), _upper_median(F.when(~core, F.col("mag"))).alias("floor"))
    peak = peak.withColumn("k", F.when(F.col("strength") > 0, F.col("k")).otherwise(F.col("start")))
    a = t.join(peak, keys, "left")
    f = F.coalesce("floor", F.lit(0.001))
    found = F.col("strength").isNotNull()
    return a.select(*targets.columns, F.when(found, (F.col("k") + 0.5) * res).otherwise(F.col("target")).alias("freq"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.when(found & (f > 0), F.col("strength") / f).otherwise(0.0).alias("snr"))


def _confidence(snr: Column) -> Column:
    return F.when(snr > 10, 0.95).when(snr > 5, 0.7 + (snr - 5) * 0.05).when(snr > 2, 0.4 + (snr - 2) * 0.1).when(snr > 0, snr * 0.2).otherwise(0.0)


def hum_harmonics(spectrum: DataFrame, base: DataFrame, rate: int, res: float) -> DataFrame:
    """``(track_id, n, expected, freq, strength_db, snr_db, confidence)`` of up to eight harmonics below half the rate."""
    n = F.explode(F.sequence(F.lit(1), F.lit(8)))
    t = base.select("track_id", "base", n.alias("n")).withColumn("target", F.col("base") * F.col("n")).where(F.col("target") < rate / 2 - 10)
    p = peak_near(spectrum, t, res, TOLERANCE * 2)
    db = F.when(F.col("strength") > 0, 20 * F.log10("strength")).otherwise(-120.0)
    return p.select("track_id", "n", F.col("target").alias("expected"), "freq", db.alias("strength_db"), F.when(F.col("snr") > 0, 10 * F.log10("snr")).otherwise(-60.0).alias("snr_db"), _confidence(F.col("snr")).alias("confidence"))


def track_frequency(spectra: DataFrame, base: DataFrame, rate: int, size: int, window_s: float = 1.0) -> DataFrame:
    """A trace from frames' spectra: half the peak within 1 Hz of twice the base.

    Frames start each half window; those shorter than ``size`` are skipped, so a window below ``size``
    samples yields nothing.
    """
    frame = int(window_s * rate)
    if frame < size:
        spectra = spectra.limit(0)
    key = F.concat_ws(":", F.col("track_id").cast("string"), F.col("frame_no").cast("string"))
    frames = spectra.select(key.alias("track_id"), "k", "mag")
    targets = spectra.select("track_id", "frame_no").distinct().join(base, "track_id").select("track_id", "frame_no", (F.col("base") * 2).alias("target"))
    p = peak_near(frames, targets.select(key.alias("track_id"), "target"), rate / size, 1.0).withColumnRenamed("track_id", "__key").drop("target")
    out = targets.withColumn("__key", key).join(p, "__key")
    t = (F.col("frame_no") * (frame // 2) + frame / 2) / rate
    conf = F.when(F.col("snr") > 5, 0.9).when(F.col("snr") > 2, 0.6).otherwise(0.3)
    return out.select("track_id", t.alias("t"), (F.col("freq") / 2).alias("freq"), conf.alias("confidence"), F.when(F.col("strength") > 0, 20 * F.log10("strength")).otherwise(-120.0).alias("strength_db"))


def enf_jumps(trace: DataFrame) -> DataFrame:
    """``(track_id, start, duration, kind, severity)`` of jumps over 0.1 Hz and three deviations between sure neighbours."""
    sure = trace.where("confidence > 0.5").groupBy("track_id").agg(F.stddev_pop("freq").alias("sd"), F.count(F.lit(1)).alias("good"))
    w = W.partitionBy("track_id").orderBy("t")
    p = trace.withColumns({"pf": F.lag("freq").over(w), "pt": F.lag("t").over(w), "pc": F.lag("confidence").over(w)}).join(sure.where("good >= 3"), "track_id")
    d = F.abs(F.col("freq") - F.col("pf"))
    hit = p.where((F.col("confidence") >= 0.5) & (F.col("pc") >= 0.5) & (d > 0.1) & (d > 3 * F.col("sd")))
    return hit.select("track_id", F.col("pt").alias("start"), (F.col("t") - F.col("pt")).alias("duration"), F.lit("frequency_jump").alias("kind"), F.least(F.lit(1.0), d / 0.5).alias("severity"))


def enf_dropouts(trace: DataFrame) -> DataFrame:
    """The same of runs of weak, unsure points longer than half a second that a good point ends; short traces have none."""
    enough = trace.groupBy("track_id").agg(F.count_if(F.col("confidence") > 0.5).alias("good")).where("good >= 3")
    w = W.partitionBy("track_id").orderBy("t")
    weak = (F.col("confidence") < 0.3) & (F.col("strength_db") < -60)
    p = trace.join(enough, "track_id", "left_semi").withColumn("weak", weak)
    p = p.withColumn("g", F.sum((~F.col("weak")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("t").over(w)).withColumn("last", ~F.lead("weak").over(w))
    runs = p.where("weak").groupBy("track_id", "g").agg(F.min("t").alias("start"), F.max(F.when(F.col("last"), F.col("next"))).alias("end")).where("end is not null")
    d = F.col("end") - F.col("start")
    return runs.where(d > 0.5).select("track_id", "start", d.alias("duration"), F.lit("signal_dropout").alias("kind"), F.least(F.lit(1.0), d / 5).alias("severity"))


def enf_anomalies(trace: DataFrame) -> DataFrame:
    return enf_jumps(trace).unionByName(enf_dropouts(trace))


def enf_summary(harmonics: DataFrame, trace: DataFrame, base: DataFrame, min_snr_db: float = 3.0) -> DataFrame:
    """One row for each track with a base: detection, confidence, ratio, stability and region."""
    p = F.when(F.col("snr_db") > -30, F.pow(F.lit(10.0), F.col("snr_db") / 10))
    h = harmonics.groupBy("track_id").agg(F.sum(p).alias("p"), F.count_if(F.col("confidence") > 0.5).alias("half"), F.count_if(F.col("confidence") > 0.6).alias("strong"))
    sure = F.when(F.col("confidence") > 0.5, F.col("freq"))
    t = trace.groupBy("track_id").agg(F.count(sure).alias("valid"), F.avg(sure).alias("m"), F.stddev_pop(sure).alias("s"))
    a = base.where("confidence >= 0.3").select("track_id", "base").join(h, "track_id", "left").join(t, "track_id", "left").fillna(0, ["half", "strong", "valid"])
    snr = F.when(F.col("p") > 0, 10 * F.log10("p")).otherwise(-100.0)
    a = a.withColumn("snr_db", snr)
    stable = F.when(F.col("valid") >= 3, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("s") / F.col("m") * 500))).otherwise(0.0)
    step = lambda c, *rungs: _rungs(F.col(c), rungs)
    conf = F.least(F.lit(1.0), F.col("strong") / 4) * 0.4 + step("snr_db", (10, 0.3), (5, 0.2), (2, 0.1)) + step("valid", (20, 0.3), (10, 0.2), (5, 0.1))
    return a.select(
        "track_id", "base", ((F.col("half") >= 2) & (F.col("snr_db") > min_snr_db)).alias("detected"), F.least(F.lit(0.95), conf).alias("confidence"), "snr_db", stable.alias("stability"),
        F.when(F.col("base") == 50, "Europe").otherwise("NorthAmerica").alias("region"),
    )


def _rungs(c: Column, rungs: tuple) -> Column:
    out = F.when(F.lit(False), 0.0)
    for above, value in rungs:
        out = out.when(c > above, value)
    return out.otherwise(0.0)
