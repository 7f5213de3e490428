"""Frames, spectra, cutoffs, codec signatures and resampling traces.

Frames are ``(track_id, frame_no, x array<double>)``, magnitudes ``(track_id, frame_no, k, mag)``, and a
track's spectrum is ``(track_id, k, db)``.  ``rate`` is in Hz and ``size`` the transform's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions.windows import window_array, window_table
from wavemill.operators.blocks import CH, neighbours
from wavemill.operators.kernel import framed, magnitudes
from wavemill.operators.levels import order_statistic

RATES = (44_100, 48_000, 88_200, 96_000, 176_400, 192_000)
HIGHER_RATES = (88_200, 96_000, 176_400, 192_000, 352_800, 384_000)
# Codec, bitrate in kbit/s, typical cutoff and tolerance in Hz.
CODECS = [
    ("MP3", 64, 11000.0, 1000.0), ("MP3", 96, 14000.0, 1000.0), ("MP3", 128, 16000.0, 1000.0), ("MP3", 160, 17500.0, 1000.0), ("MP3", 192, 18500.0, 1000.0), ("MP3", 224, 19000.0, 1000.0), ("MP3", 256, 19500.0, 1000.0), ("MP3", 320, 20500.0, 1000.0),
    ("AAC", 96, 14000.0, 1000.0), ("AAC", 128, 15500.0, 1000.0), ("AAC", 160, 17000.0, 1000.0), ("AAC", 192, 18000.0, 1000.0), ("AAC", 256, 19000.0, 1000.0), ("AAC", 320, 20000.0, 1000.0),
    ("Opus", 48, 12000.0, 500.0), ("Opus", 64, 14000.0, 1000.0), ("Opus", 96, 18000.0, 1000.0), ("Opus", 128, 20000.0, 1000.0), ("Opus", 192, 20000.0, 500.0),
    ("Vorbis", 80, 14000.0, 1000.0), ("Vorbis", 112, 16000.0, 1000.0), ("Vorbis", 160, 18000.0, 1000.0), ("Vorbis", 192, 19000.0, 1000.0), ("Vorbis", 256, 20000.0, 500.0),
]
# Upper cutoff in Hz, codec, bitrate of a band.
BANDS = {
    "current": [(11000, "mp3", 64), (14000, "mp3", 128), (16000, "mp3", 192), (18000, "aac", 256), (19500, "aac", 320), (20500, "mp3", 320)],
    "earlier": [(11025, "mp3", 64), (14000, "mp3", 128), (16000, "mp3", 192), (18000, "mp3", 256), (20000, "aac", 320)],
}
T = ["track_id"]


def frame(samples: DataFrame, size: int, hop: int, plan: str = "hop", count: int = 40) -> DataFrame:
    """``(track_id, ch, frame_no, start_idx, x)``: full frames each ``hop``, or ``count`` spread over the channel."""
    return framed(samples, size, hop, np.asarray, "x", plan, count)


def frame_magnitudes(samples: DataFrame, size: int, hop: int, window: str = "hann", sym: bool = True, plan: str = "hop", count: int = 40, bins: tuple[int, int] | None = None) -> DataFrame:
    """``(track_id, ch, frame_no, start_idx, mag)``: frames and their transforms in one pass, all bins or those from ``bins[0]`` up to ``bins[1]``."""
    return framed(samples, size, hop, magnitudes(size, window, sym, bins), "mag", plan, count)


def median_of_frames_db(frames: DataFrame, size: int) -> DataFrame:
    """What ``median_power_db`` gives, from rows with ``mag`` of a plan that bounds the frames of a track, 40 as a rule."""

    def run(t: pa.Table) -> pa.Table:
        power = (np.stack([np.asarray(m) for m in t["mag"].to_pylist()]) / size) ** 2
        m = np.sort(power, axis=0)[len(power) // 2]
        db = np.where(m > 1e-20, 10 * np.log10(np.maximum(m, 1e-300)), -200.0)
        return pa.table({"track_id": t["track_id"].combine_chunks().take(pa.array(np.zeros(len(db), np.int64))), "k": pa.array(np.arange(len(db)), pa.int32()), "db": db})

    kind = frames.schema["track_id"].dataType.simpleString()
    return frames.select("track_id", "mag").groupBy("track_id").applyInArrow(run, f"track_id {kind}, k int, db double")


def dft(frames: DataFrame, size: int, window: str = "rect", sym: bool = True) -> DataFrame:
    """Magnitudes of bins 0 to size / 2 as a join with a fixed table of sines and an aggregation; for short frames."""
    spark = frames.sparkSession
    w = window_table(spark, window, size, sym)
    bins = spark.range(size // 2 + 1).select(F.col("id").cast("int").alias("k"))
    angle = 2 * math.pi * ((F.col("n") * F.col("k")) % size) / size
    table = w.crossJoin(bins).select("n", "k", (F.col("w") * F.cos(angle)).alias("c"), (F.col("w") * F.sin(angle)).alias("s"))
    points = frames.select("track_id", "frame_no", F.posexplode("x").alias("n", "x"))
    sums = points.join(F.broadcast(table), "n").groupBy("track_id", "frame_no", "k").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    return sums.select("track_id", "frame_no", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def fft_arrays(frames: DataFrame, size: int, window: str = "hann", sym: bool = True) -> DataFrame:
    """``frames`` with ``mag``, the magnitudes of bins 0 to size / 2, transformed a batch of frames at a time."""
    shape = window_array(window, size, sym)
    keys = [f for f in frames.schema if f.name != "x"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.zeros((len(p), size))
            for i, x in enumerate(p.x):
                m[i, : min(size, len(x))] = np.asarray(x)[:size]
            yield p[[f.name for f in keys]].assign(mag=list(np.abs(np.fft.rfft(m * shape, axis=1))))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), "mag array<double>"])
    return frames.mapInPandas(run, schema)


def fft_magnitude(frames: DataFrame, size: int, window: str = "hann", sym: bool = True, method: str = "auto") -> DataFrame:
    """``(track_id, frame_no, k, mag)``: ``dft`` up to 64 points, ``fft_arrays`` beyond, or as told; the two agree to rounding."""
    if method == "dft" or (method == "auto" and size <= 64):
        return dft(frames, size, window, sym)
    return fft_arrays(frames, size, window, sym).select("track_id", "frame_no", F.posexplode("mag").alias("k", "mag"))


def median_power_db(spectra: DataFrame, size: int) -> DataFrame:
    """Upper median over a track's frames of the power of each bin, in decibels; bounded by the frames of a plan."""
    p = spectra.select("track_id", "k", F.pow(F.col("mag") / size, F.lit(2.0)).alias("p"))
    m = order_statistic(p, ["track_id", "k"], "p", F.floor(F.col("n") / 2), "m")
    return m.select("track_id", "k", F.when(F.col("m") > 1e-20, 10 * F.log10("m")).otherwise(-200.0).alias("db"))


def spectrogram(spectra: DataFrame, size: int) -> DataFrame:
    """Decibels of every frame and bin."""
    return spectra.select("track_id", "frame_no", "k", F.when(F.col("mag") > 1e-10, 20 * F.log10(F.col("mag") / size)).otherwise(-200.0).alias("db"))


def averaged_spectrum_db(spectra: DataFrame, smooth: int = 8) -> DataFrame:
    """Mean magnitude of each bin in decibels, smoothed over neighbouring bins."""
    m = spectra.groupBy("track_id", "k").agg(F.avg("mag").alias("m")).withColumn("d", F.when(F.col("m") > 1e-10, 20 * F.log10("m")).otherwise(-120.0))
    return m.select("track_id", "k", F.avg("d").over(W.partitionBy("track_id").orderBy("k").rowsBetween(-(smooth // 2), smooth // 2)).alias("db"))


def _bins(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumn("bins", F.count(F.lit(1)).over(W.partitionBy("track_id")))


def _peak(low: int, high: int) -> Column:
    return F.max(F.when((F.col("k") >= low) & (F.col("k") < high), F.col("db"))).over(W.partitionBy("track_id"))


def detect_cutoff(spectrum: DataFrame, rate: int, size: int, span: int = 40, need: int = 32) -> DataFrame:
    """``(track_id, cutoff_hz)``: the first stretch from 10 kHz up where most bins lie 25 dB below the peak of 2 to 8 kHz.

    Null where the reference band is silent, the spectrum is short or the drop is within 5 % of half the rate.
    """
    res, half = rate / size, rate / 2
    s = _bins(spectrum).withColumn("ref", _peak(math.ceil(2000 / res), math.floor(8000 / res)))
    below = (F.col("db") < F.col("ref") - 25).cast("int")
    w = W.partitionBy("track_id").orderBy("k")
    s = s.withColumn("below", below).withColumn("c", F.sum("below").over(w.rowsBetween(0, span - 1)))
    first = F.min(F.when(F.col("below") == 1, F.col("k"))).over(w.rowsBetween(0, span - 1))
    start = math.ceil(10_000 / res)
    s = s.withColumn("first", first).withColumn("hit", (F.col("k") >= start) & (F.col("k") <= F.col("bins") - span) & (F.col("c") >= need))
    last = F.col("k") == F.col("bins") - span
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.max("ref").alias("ref"), F.min_by(F.when(last, F.col("k")).otherwise(F.col("first")), F.when(F.col("hit"), F.col("k"))).alias("bin"))
    usable = (F.col("bins") >= 100) & (F.col("ref") >= -80) & (F.lit(start + span) < F.col("bins")) & (F.lit(math.floor(8000 / res)) < F.col("bins"))
    hz = F.col("bin") * res
    return a.select("track_id", F.when(usable & (hz < half * 0.95), hz).alias("cutoff_hz"))


def rolloff_steepness(spectrum: DataFrame, cutoffs: DataFrame, rate: int, size: int) -> DataFrame:
    """``(track_id, rolloff)``: twice the drop from ``bin`` to the bin half an octave higher, 0 near the edges."""
    res = rate / size
    c = cutoffs.select("track_id", "bin", F.ceil(F.col("bin") * res * 1.414 / res).alias("up"))
    s = _bins(spectrum).join(c, "track_id")
    s = s.withColumn("up", F.least(F.col("up"), F.col("bins") - 1))
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.max("bin").alias("bin"), F.max("up").alias("up"), F.max(F.when(F.col("k") == F.col("bin"), F.col("db"))).alias("a"), F.max(F.when(F.col("k") == F.col("up"), F.col("db"))).alias("b"))
    edge = (F.col("bin") >= F.col("bins") - 20) | (F.col("bin") < 20) | (F.col("up") <= F.col("bin"))
    return a.select("track_id", F.when(edge, 0.0).otherwise(F.greatest(F.lit(0.0), 2 * (F.col("a") - F.col("b")))).alias("rolloff"))


def _at(hz: float, res: float) -> int:
    """First bin at or above a frequency."""
    return math.ceil(hz / res)


def cutoff_energy_drop(spectrum: DataFrame, rate: int, size: int, need: int = 30) -> DataFrame:
    """``(track_id, cutoff_hz, rolloff, conf)`` by the first run of ``need`` bins 25 dB below the reference peak."""
    res, half = rate / size, rate / 2
    s = _bins(spectrum).withColumn("ref", _peak(_at(2000, res), _at(8000, res)))
    w = W.partitionBy("track_id").orderBy("k").rowsBetween(-(need - 1), 0)
    s = s.withColumn("c", F.sum((F.col("db") < F.col("ref") - 25).cast("int")).over(w))
    hit = F.when((F.col("c") == need) & (F.col("k") >= _at(10_000, res) + need - 1), F.col("k"))
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.min(hit).alias("end"), F.min_by(F.col("ref") - F.col("db"), hit).alias("drop"))
    found = a.withColumn("bin", F.col("end") - need + 1)
    r = rolloff_steepness(spectrum, found.where("bin is not null"), rate, size)
    j, ok = found.join(r, "track_id", "left"), F.col("bin").isNotNull() & (F.col("bins") >= 100)
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.4), F.col("drop") / 40))
    return j.select("track_id", F.when(ok, F.col("bin") * res).otherwise(half).alias("cutoff_hz"), F.when(ok, F.col("rolloff")).otherwise(0.0).alias("rolloff"), F.when(ok, conf).when(F.col("bins") < 100, 0.0).otherwise(0.3).alias("conf"))


def cutoff_derivative(spectrum: DataFrame, rate: int, size: int, span: int = 10) -> DataFrame:
    """The same by the steepest fall over ``span`` bins to both sides, from 10 kHz up; the first of equals."""
    res, half = rate / size, rate / 2
    w = W.partitionBy("track_id").orderBy("k")
    s = _bins(spectrum).withColumn("slope", (F.lead("db", span).over(w) - F.lag("db", span).over(w)) / (2 * span * res))
    ok = F.when((F.col("k") >= _at(10_000, res) + span) & (F.col("k") < F.col("bins") - span), F.struct("slope", "k"))
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.min(ok).alias("m"))
    d = F.col("m.slope")
    hit = (d < -0.003) & (F.col("bins") >= 50)
    return a.select(
        "track_id", F.when(hit, F.col("m.k") * res).otherwise(half).alias("cutoff_hz"), F.when(hit, F.least(-d * 6000, F.lit(200.0))).otherwise(0.0).alias("rolloff"),
        F.when(hit, F.least(F.lit(0.85), F.greatest(F.lit(0.3), -d * 200))).when(F.col("bins") < 50, 0.0).otherwise(0.2).alias("conf"),
    )


def cutoff_noise_floor(spectrum: DataFrame, rate: int, size: int) -> DataFrame:
    """The same by the last bin 15 dB above the noise floor, the 20th percentile of the top tenth of bins."""
    res, half = rate / size, rate / 2
    s = _bins(spectrum).withColumn("ref", _peak(_at(2000, res), _at(8000, res)))
    top = s.where(F.col("k") >= F.floor(F.col("bins") * 9 / 10))
    floor = order_statistic(top, T, "db", F.floor(F.col("n") / 5), "floor")
    s = s.join(floor, "track_id")
    above = F.when((F.col("k") >= _at(10_000, res)) & (F.col("db") > F.col("floor") + 15), F.col("k"))
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.max("ref").alias("ref"), F.max("floor").alias("floor"), F.max(above).alias("last"))
    a = a.withColumn("bin", F.coalesce("last", F.col("bins") - 1))
    j = a.join(rolloff_steepness(spectrum, a, rate, size), "track_id")
    near = F.col("bin") * res > half * 0.95
    conf = F.least(F.lit(0.8), F.greatest(F.lit(0.3), (F.col("ref") - F.col("floor")) / 50))
    return j.select("track_id", F.when(near, half).otherwise(F.col("bin") * res).alias("cutoff_hz"), F.when(near, 0.0).otherwise(F.col("rolloff")).alias("rolloff"), F.when(near, 0.25).otherwise(conf).alias("conf"))


def cutoff_multimethod(methods: DataFrame, rate: int) -> DataFrame:
    """One cutoff from the rows of the three methods: their weighted mean if they agree, else the most confident, less sure."""
    half = rate / 2
    c = F.col("conf")
    best = F.max_by(F.struct("cutoff_hz", "rolloff", "conf"), F.struct("conf", "cutoff_hz"))
    a = methods.groupBy("track_id").agg((F.max("cutoff_hz") - F.min("cutoff_hz")).alias("spread"), F.sum("conf").alias("w"), F.sum(F.col("cutoff_hz") * c).alias("wc"), F.sum(F.col("rolloff") * c).alias("wr"), best.alias("b"))
    agree, thin = F.col("spread") < half * 0.08, F.col("w") < 0.01
    pick = lambda x, y, z: F.when(agree & thin, x).when(agree, y).otherwise(z)
    return a.select(
        "track_id", pick(F.lit(half), F.try_divide(F.col("wc"), F.col("w")), F.col("b.cutoff_hz")).alias("cutoff_hz"), pick(F.lit(0.0), F.try_divide(F.col("wr"), F.col("w")), F.col("b.rolloff")).alias("rolloff"),
        pick(F.lit(0.1), F.least(F.lit(0.95), F.col("w") / 3), F.col("b.conf") * 0.7).alias("conf"),
    )


def cutoff_methods(spectrum: DataFrame, rate: int, size: int, need: int = 30, span: int = 10) -> DataFrame:
    """``(track_id, method, cutoff_hz, rolloff, conf)``: all three methods in one pass over a track's bins, counted from 0 without gaps.

    One set of windows and one aggregation, which also keeps the levels of the track's spectrum, size / 2 + 1 of them at
    most, to look the floor, the last bin above it and the rolloffs up.
    """
    res, half = rate / size, rate / 2
    w = W.partitionBy("track_id").orderBy("k")
    s = _bins(spectrum).withColumn("ref", _peak(_at(2000, res), _at(8000, res)))
    s = s.withColumn("c", F.sum((F.col("db") < F.col("ref") - 25).cast("int")).over(w.rowsBetween(-(need - 1), 0)))
    s = s.withColumn("slope", (F.lead("db", span).over(w) - F.lag("db", span).over(w)) / (2 * span * res))
    hit = F.when((F.col("c") == need) & (F.col("k") >= _at(10_000, res) + need - 1), F.col("k"))
    steep = F.when((F.col("k") >= _at(10_000, res) + span) & (F.col("k") < F.col("bins") - span), F.struct("slope", "k"))
    levels = F.transform(F.array_sort(F.collect_list(F.struct("k", "db"))), lambda e: e["db"])
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.max("ref").alias("ref"), F.min(hit).alias("end"), F.min_by(F.col("ref") - F.col("db"), hit).alias("drop"), F.min(steep).alias("m"), levels.alias("a"))
    top = F.array_sort(F.slice("a", F.floor(F.col("bins") * 9 / 10).cast("int") + 1, F.col("bins").cast("int")))
    a = a.withColumn("top", top).withColumn("floor", F.get("top", F.floor(F.size("top") / 5).cast("int")))
    above = F.array_max(F.transform("a", lambda x, i: F.when((i >= _at(10_000, res)) & (x > F.col("floor") + 15), i)))
    a = a.withColumns({"first": (F.col("end") - need + 1).cast("int"), "last": F.coalesce(above, F.col("bins") - 1).cast("int")})

    def rolloff(name: str) -> Column:
        bin_ = F.col(name)
        up = F.least(F.ceil(bin_ * res * 1.414 / res), F.col("bins") - 1).cast("int")
        edge = (bin_ >= F.col("bins") - 20) | (bin_ < 20) | (up <= bin_)
        return F.when(edge, 0.0).otherwise(F.greatest(F.lit(0.0), 2 * (F.get("a", bin_) - F.get("a", up))))

    fell = F.col("first").isNotNull() & (F.col("bins") >= 100)
    d = F.col("m.slope")
    falls = (d < -0.003) & (F.col("bins") >= 50)
    near = F.col("last") * res > half * 0.95
    rows = [
        ("energy_drop", F.when(fell, F.col("first") * res).otherwise(half), F.when(fell, rolloff("first")).otherwise(0.0), F.when(fell, F.least(F.lit(0.95), F.greatest(F.lit(0.4), F.col("drop") / 40))).when(F.col("bins") < 100, 0.0).otherwise(0.3)),
        ("derivative", F.when(falls, F.col("m.k") * res).otherwise(half), F.when(falls, F.least(-d * 6000, F.lit(200.0))).otherwise(0.0), F.when(falls, F.least(F.lit(0.85), F.greatest(F.lit(0.3), -d * 200))).when(F.col("bins") < 50, 0.0).otherwise(0.2)),
        ("noise_floor", F.when(near, half).otherwise(F.col("last") * res), F.when(near, 0.0).otherwise(rolloff("last")), F.when(near, 0.25).otherwise(F.least(F.lit(0.8), F.greatest(F.lit(0.3), (F.col("ref") - F.col("floor")) / 50)))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), c.alias("cutoff_hz"), r.alias("rolloff"), f.alias("conf")) for n, c, r, f in rows]))
    return a.select("track_id", each.alias("x")).select("track_id", "x.*")


def codec_table(spark) -> DataFrame:
    """Fixed signature rows, in order of precedence."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CODECS)], "o int, codec string, bitrate int, typical double, tolerance double")


def match_codec(cutoffs: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """``(track_id, codec, bitrate, score)``: the best signature near the cutoff; tracks without one have no row."""
    table = F.broadcast(signatures if signatures is not None else codec_table(cutoffs.sparkSession))
    far = F.abs(F.col("cutoff_hz") - F.col("typical"))
    c = cutoffs.where("cutoff_hz <= 20500 and rolloff >= 5").join(table, far < F.col("tolerance"))
    c = c.withColumn("score", 0.7 * (1 - far / F.col("tolerance")) + 0.3 * F.least(F.lit(1.0), F.col("rolloff") / 60))
    return c.withColumn("r", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("score"), "o"))).where("r = 1").select("track_id", "codec", "bitrate", "score")


def estimate_codec(cutoff: Column, table: str = "current") -> Column:
    """``struct<codec, bitrate>`` by cutoff bands."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("codec"), F.lit(0).alias("bitrate")))
    for top, codec, bitrate in BANDS[table]:
        out = out.when(cutoff < top, F.struct(F.lit(codec).alias("codec"), F.lit(bitrate).alias("bitrate")))
    return out.otherwise(F.struct(F.lit("unknown").alias("codec"), F.lit(0).alias("bitrate")))


def transcode_verdict(cutoffs: DataFrame, rate: int) -> DataFrame:
    half = rate / 2
    r = F.col("cutoff_hz") / half
    yes = (r < 0.95) & (F.col("rolloff") > 10) & (F.col("conf") > 0.4)
    text = F.when(yes, F.format_string("Frequency cutoff at %.0f Hz (%.1f%% of Nyquist) with %.0f dB/oct rolloff", "cutoff_hz", r * 100, "rolloff")).otherwise(F.format_string("Full frequency response to %.0f Hz (%.1f%% of Nyquist)", "cutoff_hz", r * 100))
    return cutoffs.select("track_id", yes.alias("is_transcode"), F.when(yes, F.col("conf")).otherwise(F.greatest(F.lit(0.5), 1 - F.col("conf") * 0.5)).alias("confidence"), r.alias("cutoff_ratio"), text.alias("reason"))


def spectral_cutoff_finding(cutoffs: DataFrame, rate: int, table: str = "current") -> DataFrame:
    """Findings of tracks whose spectrum is cut off."""
    r = F.col("cutoff_hz") / (rate / 2)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.95 - r) / 0.3))
    conf = F.when(r < 0.6, F.least(F.lit(1.0), conf + 0.15)).otherwise(conf)
    e = estimate_codec(F.col("cutoff_hz"), table)
    kind = F.when(e["codec"] == "mp3", "Mp3Transcode").when(e["codec"] == "aac", "AacTranscode").when(e["codec"] == "opus", "OpusTranscode").when(e["codec"].isin("ogg", "vorbis"), "OggVorbisTranscode").otherwise("LossyTranscode")
    severity = F.when(r < 0.5, "critical").when(r < 0.7, "high").when(r < 0.85, "medium").otherwise("low")
    return cutoffs.where(r < 0.95).select("track_id", kind.alias("defect_type"), e["bitrate"].alias("estimated_bitrate"), F.col("cutoff_hz").cast("int").alias("cutoff_hz"), conf.alias("confidence"), severity.alias("severity"))


def resampling_finding(spectrum: DataFrame, rate: int, size: int, rates: tuple[int, ...] = RATES) -> DataFrame:
    """``(track_id, original_rate, confidence, quality)`` where the level falls sharply at half of a lower rate."""
    res = rate / size
    m = math.ceil(500 / res)
    lower = [(o, r, int(r / 2 / res)) for o, r in enumerate(rates) if r < rate]
    if not lower:
        return spectrum.limit(0).select("track_id", F.lit(0).alias("original_rate"), F.lit(0.0).alias("confidence"), F.lit("").alias("quality"))
    s = _bins(spectrum)
    agg = [F.max("bins").alias("bins")]
    for _, r, b in lower:
        lo, top = F.least(F.lit(b + m), F.col("bins") - 1), F.least(F.lit(b + 4 * m), F.col("bins"))
        agg.append(F.avg(F.when((F.col("k") >= max(0, b - 4 * m)) & (F.col("k") < max(0, b - m)), F.col("db"))).alias(f"lo{r}"))
        agg.append(F.avg(F.when((F.col("k") >= lo) & (F.col("k") < top), F.col("db"))).alias(f"hi{r}"))
    wide = s.groupBy("track_id").agg(*agg)
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(r).alias("r"), F.lit(b).alias("b"), F.col(f"lo{r}").alias("lo"), F.col(f"hi{r}").alias("hi")) for o, r, b in lower]))
    c = wide.select("track_id", "bins", rows.alias("c")).select("track_id", "bins", "c.*").where("b < bins and lo > -90 and lo - hi > 20")
    c = c.withColumn("drop", F.col("lo") - F.col("hi")).withColumn("confidence", F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.col("drop") / 60)))
    quality = F.when(F.col("drop") > 50, "Poor").when(F.col("drop") > 35, "Moderate").otherwise("Good")
    best = F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("confidence"), "o"))
    return c.withColumn("q", best).where("q = 1").select("track_id", F.col("r").alias("original_rate"), "confidence", quality.alias("quality"))


def imaging_nulls(spectrum: DataFrame, rate: int, size: int, rates: tuple[int, ...] = RATES) -> DataFrame:
    """``(track_id, original_rate, confidence)`` where nulls stand at multiples of half of a lower rate; the first rate wins."""
    res, half = rate / size, rate / 2
    radius = math.ceil(200 / res)
    places = [(o, r, h, int(r / 2 * h / res)) for o, r in enumerate(rates) if 10_000 <= r / 2 < half for h in range(1, 5) if r / 2 * h < half - 500]
    if not places:
        return spectrum.limit(0).select("track_id", F.lit(0).alias("original_rate"), F.lit(0.0).alias("confidence"))
    p = F.broadcast(spectrum.sparkSession.createDataFrame(places, "o int, r int, h int, b int"))
    near = (F.col("k") >= F.greatest(F.lit(0), F.col("b") - 4 * radius)) & (F.col("k") < F.col("b") + 4 * radius)
    j = _bins(spectrum).join(p, near).where("b < bins")
    core = (F.col("k") >= F.col("b") - radius) & (F.col("k") < F.col("b") + radius)
    e = j.groupBy("track_id", "o", "r", "h").agg(F.min(F.when(core, F.col("db"))).alias("low"), F.avg("db").alias("around"))
    c = e.groupBy("track_id", "o", "r").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("around") - F.col("low") > 15).alias("nulls")).where("n >= 2 and nulls / n >= 0.5")
    c = c.withColumn("confidence", F.least(F.lit(0.85), F.greatest(F.lit(0.3), F.col("nulls") / F.col("n") * 0.8)))
    return c.groupBy("track_id").agg(F.min_by("r", "o").alias("original_rate"), F.min_by("confidence", "o").alias("confidence"))


def upsampling_shelf(spectrum: DataFrame, rate: int, size: int, variant: str = "current") -> DataFrame:
    """``(track_id, original_rate, gap_db, confidence)`` where nothing is left above half of a lower rate."""
    res = rate / size
    roots = RATES[:4] if variant == "current" else RATES
    share = 0.01 if variant == "current" else 0.001
    starts = [(o, r, int(r / 2 / res + 0.5)) for o, r in enumerate(roots) if r < rate]
    if not starts:
        return spectrum.limit(0).select("track_id", F.lit(0).alias("original_rate"), F.lit(0.0).alias("gap_db"), F.lit(0.0).alias("confidence"))
    p = F.pow(F.lit(10.0), F.col("db") / 10)
    agg = [F.max("bins").alias("bins")]
    for _, r, b in starts:
        agg.append(F.avg(F.when((F.col("k") >= (b // 2 if variant == "current" else 0)) & (F.col("k") < b), p)).alias(f"lo{r}"))
        agg.append(F.avg(F.when(F.col("k") >= b, p)).alias(f"hi{r}"))
    wide = _bins(spectrum).groupBy("track_id").agg(*agg)
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(r).alias("r"), F.lit(b).alias("b"), F.col(f"lo{r}").alias("lo"), F.col(f"hi{r}").alias("hi")) for o, r, b in starts]))
    c = wide.select("track_id", "bins", rows.alias("c")).select("track_id", "bins", "c.*").where("bins >= 64 and b < bins - 4 and lo > 1e-14").withColumn("ratio", F.col("hi") / F.col("lo"))
    c = c.where(F.col("ratio") < share).withColumn("gap", -10 * F.log10(F.greatest("ratio", F.lit(1e-15))))
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.4), (F.col("gap") - 20) / 30)) if variant == "current" else 1 - 1000 * F.col("ratio")
    c = c.withColumn("confidence", conf)
    return c.groupBy("track_id").agg(F.min_by("r", "o").alias("original_rate"), F.min_by("gap", "o").alias("gap_db"), F.min_by("confidence", "o").alias("confidence"))


def downsampling_rolloff(spectrum: DataFrame, rate: int, size: int) -> DataFrame:
    """``(track_id, original_rate, drop_db, knee_hz, confidence)`` where the top of the spectrum falls off steeply."""
    res, half = rate / size, rate / 2
    cut = lambda p: F.floor(F.col("bins") * p / 100)
    inside = lambda a, b: (F.col("k") >= cut(a)) & (F.col("k") < cut(b))
    s = _bins(spectrum).withColumn("ref", F.avg(F.when(inside(60, 80), F.col("db"))).over(W.partitionBy("track_id")))
    a = s.groupBy("track_id").agg(F.max("bins").alias("bins"), F.max("ref").alias("ref"), F.avg(F.when(inside(85, 98), F.col("db"))).alias("end"), F.min(F.when(inside(85, 98) & (F.col("db") < F.col("ref") - 20), F.col("k"))).alias("knee"))
    a = a.withColumn("drop_db", F.col("ref") - F.col("end")).where((F.col("drop_db") > 30) & (F.col("bins") >= 64) & (cut(98) > cut(85) + 4))
    knee = F.coalesce("knee", cut(85)) * res
    up = next((r for r in HIGHER_RATES if r > rate), None)
    origin = F.when((F.abs(knee - half) < half * 0.15) & F.lit(up is not None), F.lit(up)).otherwise(2 * rate)
    return a.select("track_id", origin.cast("int").alias("original_rate"), "drop_db", knee.alias("knee_hz"), F.least(F.lit(0.85), F.greatest(F.lit(0.3), (F.col("drop_db") - 30) / 30)).alias("confidence"))


def noise_shaping_slope(spectrum: DataFrame, rate: int, size: int) -> DataFrame:
    """``(track_id, slope)``: how far the mean level from 16 kHz up exceeds that below 10 kHz, over 20 dB; 0 up to 6 dB."""
    res = rate / size
    a = spectrum.groupBy("track_id").agg(F.avg(F.when(F.col("k") < int(10_000 / res), F.col("db"))).alias("lo"), F.avg(F.when(F.col("k") >= int(16_000 / res), F.col("db"))).alias("hi"))
    d = F.col("hi") - F.col("lo")
    return a.select("track_id", F.when(d > 6, F.least(F.lit(1.0), d / 20)).otherwise(0.0).alias("slope"))


def band_flatness(spectra: DataFrame, low: int, high: int) -> DataFrame:
    """``(track_id, flatness, band_db, frames)``: mean over frames of geometric over arithmetic mean power in bins low to high."""
    p = F.col("mag") * F.col("mag") + 1e-30
    f = spectra.where(F.col("k").between(low, high)).groupBy("track_id", "frame_no").agg(F.exp(F.avg(F.log(p))).alias("g"), F.avg(p).alias("a")).where("a > 1e-15")
    a = f.groupBy("track_id").agg(F.avg(F.col("g") / F.col("a")).alias("flatness"), F.avg("a").alias("e"), F.count(F.lit(1)).alias("frames"))
    return a.select("track_id", "flatness", F.when(F.col("e") > 1e-20, 10 * F.log10("e")).otherwise(-120.0).alias("band_db"), "frames")


def sfm_finding(spectra: DataFrame, low: int, high: int, least: int = 10) -> DataFrame:
    """Lossy findings from a flat high band."""
    a = band_flatness(spectra, low, high).where((F.col("frames") >= least) & (F.col("band_db") >= -75) & (F.col("flatness") > 0.35))
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.3), (F.col("flatness") - 0.35) / 0.35))
    return a.select("track_id", "flatness", "band_db", conf.alias("confidence"), F.when(conf > 0.7, "high").otherwise("medium").alias("severity"))


def _hz(rate: int) -> Column:
    return F.col("k") * (float(rate) / 2) / F.col("bins")


def _framed(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("bins", F.count(F.lit(1)).over(W.partitionBy("track_id", "frame_no")))


def spectral_centroid(spectra: DataFrame, rate: int) -> DataFrame:
    """Centroid and spread of each frame."""
    f = _framed(spectra).withColumn("hz", _hz(rate))
    a = f.groupBy("track_id", "frame_no").agg(F.sum("mag").alias("m"), F.sum(F.col("hz") * F.col("mag")).alias("fm"), F.sum(F.col("hz") * F.col("hz") * F.col("mag")).alias("ffm"))
    c = F.col("fm") / F.col("m")
    quiet = F.col("m") < 1e-10
    return a.select("track_id", "frame_no", F.when(quiet, 0.0).otherwise(c).alias("centroid"), F.when(quiet, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("ffm") / F.col("m") - c * c))).alias("spread"))


def spectral_flatness(spectra: DataFrame) -> DataFrame:
    a = spectra.groupBy("track_id", "frame_no").agg(F.exp(F.avg(F.log(F.col("mag") + 1e-10))).alias("g"), F.avg("mag").alias("m"))
    return a.select("track_id", "frame_no", F.when(F.col("m") < 1e-10, 0.0).otherwise(F.col("g") / F.col("m")).alias("flatness"))


def spectral_rolloff(spectra: DataFrame, rate: int, p: float = 0.85) -> DataFrame:
    """Frequency below which a share of the power lies."""
    w = W.partitionBy("track_id", "frame_no")
    e = F.col("mag") * F.col("mag")
    f = _framed(spectra).withColumn("cum", F.sum(e).over(w.orderBy("k").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum(e).over(w))
    return f.groupBy("track_id", "frame_no").agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("all") * p, _hz(rate))), F.lit(rate / 2.0)).alias("rolloff_hz"))


def spectral_flux(spectra: DataFrame) -> DataFrame:
    """Root of the squared rises of all bins from a frame to the next one of its track."""
    w = W.partitionBy("track_id", "k").orderBy("frame_no")
    d = F.col("mag") - F.lag("mag").over(w)
    f = spectra.withColumn("d", d).where("d is not null")
    return f.groupBy("track_id", "frame_no").agg(F.sqrt(F.sum(F.when(F.col("d") > 0, F.col("d") * F.col("d")).otherwise(0.0))).alias("flux"))


def spectral_contrast(spectra: DataFrame, bands: int) -> DataFrame:
    """Decibels from the lowest to the highest fifth of the bins of each band."""
    f = _framed(spectra).withColumn("width", F.floor(F.col("bins") / bands)).withColumn("band", F.floor(F.col("k") / F.col("width"))).where(F.col("band") < bands)
    f = f.withColumn("r", F.row_number().over(W.partitionBy("track_id", "frame_no", "band").orderBy("mag")) - 1)
    top, low = F.floor(F.col("width") * 80 / 100), F.greatest(F.lit(1), F.floor(F.col("width") * 20 / 100))
    a = f.groupBy("track_id", "frame_no", "band").agg(F.avg(F.when(F.col("r") >= top, F.col("mag"))).alias("p"), F.avg(F.when(F.col("r") < low, F.col("mag"))).alias("v"))
    db = lambda c: F.when(F.col(c) > 1e-10, 20 * F.log10(c)).otherwise(-200.0)
    return a.select("track_id", "frame_no", F.col("band").cast("int").alias("band"), F.when(F.col("v") > 1e-10, db("p") - db("v")).otherwise(db("p") + 60).alias("contrast"))


def hf_noise_level(spectra: DataFrame, rate: int, size: int, from_hz: float = 18_000.0) -> DataFrame:
    """Level of the mean power from a frequency to half the rate, in a track's frames."""
    b = int(from_hz / (rate / size))
    a = spectra.groupBy("track_id", "frame_no").agg(F.avg(F.when((F.col("k") >= b) & (F.col("k") < size // 2), F.col("mag") * F.col("mag"))).alias("p"))
    return a.select("track_id", "frame_no", F.when(F.col("p").isNull(), -100.0).when(F.col("p") > 1e-20, 20 * F.log10(F.sqrt("p"))).otherwise(-120.0).alias("level_db"))


def noise_floor_elevation(spectra: DataFrame, rate: int, size: int, low: tuple = (10_000, 16_000), high: tuple = (18_000, 20_000)) -> DataFrame:
    """Decibels by which the mean magnitude of the high band exceeds that of the low one."""
    res = rate / size
    band = lambda a, b: F.coalesce(F.avg(F.when((F.col("k") >= int(a / res)) & (F.col("k") < min(int(b / res), size // 2)), F.col("mag"))), F.lit(0.0))
    a = spectra.groupBy("track_id", "frame_no").agg(band(*low).alias("l"), band(*high).alias("h"))
    return a.select("track_id", "frame_no", F.when((F.col("l") > 1e-10) & (F.col("h") > 1e-10), 20 * F.log10(F.col("h") / F.col("l"))).otherwise(0.0).alias("elevation_db"))


def spectral_folding(spectra: DataFrame, size: int, reach: int = 30, margin: int = 50) -> DataFrame:
    """Share of mirrored bins of like magnitude around a quarter and a third of the rate; the larger of both."""
    folds = [b for b in (size // 4, int(size / 3)) if b >= margin and b < size // 2 - margin]
    s = spectra.select("track_id", "frame_no", "k", "mag")
    shares = []
    for b in folds:
        lo = s.where(F.col("k").between(b - reach + 1, b - 1)).select("track_id", "frame_no", (b - F.col("k")).alias("o"), F.col("mag").alias("l"))
        hi = s.where(F.col("k").between(b + 1, b + reach - 1)).select("track_id", "frame_no", (F.col("k") - b).alias("o"), F.col("mag").alias("h"))
        alike = (F.col("l") > 1e-10) & (F.col("h") > 1e-10) & (F.abs(F.log10(F.col("l") / F.col("h"))) < 0.5)
        shares.append(lo.join(hi, ["track_id", "frame_no", "o"]).groupBy("track_id", "frame_no").agg((F.count_if(alike) / reach).alias("s")))
    if not shares:
        return s.select("track_id", "frame_no").distinct().withColumn("score", F.lit(0.0))
    both = shares[0]
    for x in shares[1:]:
        both = both.unionByName(x)
    return both.groupBy("track_id", "frame_no").agg(F.max("s").alias("score"))


def spectrogram_grid(grid: DataFrame, rate: int, size: int, width: int = 1200, height: int = 400, scale: str = "mel", low: float = -90.0, high: float = 0.0, max_seconds: float | None = 15.0, hop: int = 1024) -> DataFrame:
    """``(track_id, px, py, v)``: a picture's cells from ``(track_id, frame_no, k, db)``, values from 0 to 1, low rows at the bottom.

    Only frames that lie, ``hop`` samples from one to the next, in the first ``max_seconds`` are shown; all with None.
    """
    if max_seconds is not None:
        # A track shorter than a frame shows its first frame all the same.
        grid = grid.where(F.col("frame_no") <= max(0, int(max_seconds * rate) - size) // hop)
    spark, bins = grid.sparkSession, size // 2 + 1
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    rows = []
    for y in range(height):
        part = (height - 1 - y) / max(1, height - 1)
        k = part * (bins - 1) if scale == "linear" else 700 * (10 ** (part * mel(rate / 2) / 2595) - 1) / (rate / size)
        rows.append((y, min(bins - 1, int(k))))
    lines = F.broadcast(spark.createDataFrame(rows, "py int, k int"))
    frames = grid.groupBy("track_id").agg((F.max("frame_no") + 1).alias("frames"))
    cells = frames.select("track_id", "frames", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px"))
    cells = cells.select("track_id", "px", F.floor(F.col("px") * F.col("frames") / width).alias("frame_no"))
    v = (F.least(F.lit(high), F.greatest(F.lit(low), F.col("db"))) - low) / (high - low)
    return grid.join(lines, "k").join(cells, ["track_id", "frame_no"]).select("track_id", "px", "py", v.alias("v"))
