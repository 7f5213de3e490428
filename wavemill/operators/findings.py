"""From measures to findings, and from findings to verdicts.

A finding is a row ``(track_id, defect_type, confidence, severity, detector, ...)``; severities are
critical, high, medium, low and info.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.scalar import format_rate, is_lossy

WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3, "info": 0.1}
TRANSCODES = ("Mp3Transcode", "AacTranscode", "OpusTranscode", "OggVorbisTranscode", "LossyTranscode")
DETECTORS = ("SpectralCutoff", "BitDepth", "Upsampling", "PreEcho", "StereoField", "PhaseCoherence", "CodecSignature", "TruePeak")
#: Detectors whose findings fall to others, one that never does and an unnamed one.
GATED = ("cutoff", "shelf", "downsampling", "mfcc", "sfm", "", None)
# Preset, sensitivity, least confidence, and (detector, multiplier, suppressed) of its modifiers.
PROFILES: dict[str, tuple[float, float, list[tuple[str, float, bool]]]] = {
    "standard": (1.0, 0.5, []),
    "high_res": (0.9, 0.6, [("SpectralCutoff", 0.7, False), ("BitDepth", 1.2, False)]),
    "electronic": (0.8, 0.6, [("SpectralCutoff", 0.6, False), ("PreEcho", 0.0, True), ("PhaseCoherence", 0.7, False)]),
    "noise": (0.5, 0.7, [("SpectralCutoff", 0.3, False), ("PreEcho", 0.4, False), ("Upsampling", 0.0, True), ("StereoField", 1.0, True)]),
    "classical": (1.1, 0.5, [("BitDepth", 1.3, False), ("PreEcho", 1.2, False), ("PhaseCoherence", 1.1, False)]),
    "podcast": (0.5, 0.7, [("SpectralCutoff", 0.0, True), ("Upsampling", 0.0, True), ("PreEcho", 0.0, True), ("StereoField", 0.0, True), ("PhaseCoherence", 0.0, True), ("BitDepth", 1.0, False), ("CodecSignature", 1.0, False)]),
}
# Badge and category of each kind of finding; a general transcode shows its codec.
BADGES = {
    "Mp3Transcode": ("MP3", "critical"), "AacTranscode": ("AAC", "critical"), "OpusTranscode": ("OPUS", "critical"), "OggVorbisTranscode": ("VORBIS", "critical"), "LossyTranscode": (None, "critical"),
    "Upsampled": ("UPSAMPLED", "warning"), "BitDepthInflated": ("BIT DEPTH", "warning"), "Clipping": ("CLIPPING", "quality"), "SilencePadding": ("PADDING", "info"), "MqaEncoded": ("MQA", "info"),
    "UpsampledLossyTranscode": ("UPSAMPLED+LOSSY", "critical"), "DitheringDetected": ("DITHER", "info"), "ResamplingDetected": ("RESAMPLED", "warning"), "LoudnessWarVictim": ("LOUDNESS WAR", "quality"),
}


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def dither_finding(slope: DataFrame, entropy: DataFrame, bits: int) -> DataFrame:
    """Dither kinds from the noise slope, then the entropy of the lowest bit; other depths than 16 and 24 give none."""
    j = slope.join(entropy, "track_id").where(F.lit(bits in (16, 24)))
    shaped, s, e = F.col("slope") > 0.3, F.col("slope"), F.col("entropy")
    kind = F.when(shaped, "Shaped").when(e > 0.95, "TPDF").when(e < 0.5, "Truncated").otherwise("None")
    conf = F.when(shaped, s).when(e > 0.95, 0.72).when(e < 0.5, 0.8).otherwise(0.0)
    return j.select("track_id", kind.alias("dither_type"), shaped.alias("noise_shaping"), conf.alias("confidence"), kind.isin("Shaped", "TPDF").alias("is_dithered"))


def bit_depth_finding(ints: DataFrame, claimed: int, usage: DataFrame, entropy: DataFrame) -> DataFrame:
    """Padded bit depth by two votes of three: unused bits, odd low-bit entropy, too little noise below the used bits.

    ``usage`` is ``(track_id, effective_bits)``, ``entropy`` the normalised entropy of the lowest four bits.
    """
    # Noise below each number of bits is summed in one pass, so samples are never sorted to meet their track's bits.
    q = F.col("q")
    below = F.array(*[F.sum(F.pow(q - F.floor(q / 2.0**k) * 2.0**k, 2)) for k in range(claimed + 1)])
    noise = ints.groupBy("track_id").agg(below.alias("below"), F.sum(q.cast("double") * q).alias("s"))
    noise = noise.join(usage.select("track_id", "effective_bits").distinct(), "track_id")
    noise = noise.withColumn("r", F.get("below", F.greatest(F.lit(claimed) - F.col("effective_bits"), F.lit(0)))).drop("below")
    db = F.when((F.col("r") > 0) & (F.col("s") > 0), 10 * F.log10(F.col("r") / F.col("s"))).otherwise(-120.0)
    a = noise.withColumn("q_noise_db", db).join(entropy.select("track_id", "entropy"), "track_id").where(F.lit(claimed >= 20))
    e, gap = F.col("entropy"), F.greatest(F.lit(1), F.lit(claimed) - F.col("effective_bits"))
    votes = (F.col("effective_bits") + 4 <= claimed).cast("int") + ((e > 0.85) | (e < 0.25)).cast("int") + (F.lit(claimed >= 24) & (F.col("q_noise_db") < -96)).cast("int")
    a = a.withColumn("votes", votes).where("votes >= 2")
    conf = _clip(gap / 8, 0.3, 1.0)
    conf = F.when(F.col("votes") == 3, F.least(F.lit(1.0), conf + 0.15)).otherwise(conf)
    conf = F.when((e < 0.1) | (e > 0.95), F.least(F.lit(1.0), conf + 0.1)).otherwise(conf)
    conf = F.when(F.col("q_noise_db") < -100, F.least(F.lit(1.0), conf + 0.1)).otherwise(conf)
    return a.select("track_id", "effective_bits", "entropy", "q_noise_db", "votes", conf.alias("confidence"), F.when(gap >= 8, "high").otherwise("medium").alias("severity"))


# Thresholds of the layered-encoding score: entropy, entropy of early encoders, noise, noise of early encoders, pattern.
MQA_PRESETS = {"default": (0.75, 0.40, 6.0, 2.0, 0.20), "early": (0.50, 0.30, 4.0, 1.5, 0.15), "strict": (0.90, 0.75, 15.0, 10.0, 0.40)}


def mqa_score(measures: DataFrame, preset: str = "default") -> DataFrame:
    """Score of layered encoding from one row of measures for each track.

    Columns: ``entropy, correlation, hf_db, elevation_db, pattern, folding, periodicity, transitions,
    clustering, bits, rate, rms``.  Tracks that are silent or not in a usual container score 0.
    """
    te, tee, tn, tne, tp = MQA_PRESETS[preset]
    c = F.col
    early = (
        F.when((c("entropy") > 0.30) & (c("entropy") < 0.80), 0.35).otherwise(0.0) + F.when(c("periodicity") > 0.10, 0.30).otherwise(0.0) + F.when(c("clustering") > 0.20, 0.25).otherwise(0.0)
        + F.when((c("transitions") > 0.35) & (c("transitions") < 0.60), 0.20).otherwise(0.0) + F.when((c("elevation_db") > 1.0) & (c("elevation_db") < 20.0), 0.25).otherwise(0.0)
    )
    a = measures.withColumn("early", early > 0.25)
    basic = (c("entropy") > tee) & ((c("elevation_db") > tne) | (c("correlation") > 0.06) | (c("hf_db") > -75.0))
    soft = c("early") | basic
    e0, n0 = F.when(soft, tee).otherwise(te), F.when(soft, tne).otherwise(tn)
    part = lambda x, w: F.least(F.lit(1.0), x) * w
    above = lambda x, t, span, w: F.when(c(x) > t, part((c(x) - t) / span, w)).otherwise(0.0)
    score = (
        F.when(c("entropy") > e0, part((c("entropy") - e0) / (1 - e0), 0.35)).when(c("entropy") > 0.35, part((c("entropy") - 0.35) / 0.40, 0.25)).otherwise(0.0)
        + above("correlation", 0.06, 0.4, 0.15)
        + F.when(c("elevation_db") > n0, part((c("elevation_db") - n0) / 25.0, 0.20)).when(c("elevation_db") > 1.0, part(c("elevation_db") / n0, 0.10)).otherwise(0.0)
        + F.when(c("hf_db") > F.when(c("early"), -75.0).otherwise(-70.0), part((c("hf_db") + 90.0) / 30.0, 0.10)).otherwise(0.0)
        + above("pattern", tp, 0.5, 0.10) + above("folding", 0.20, 0.5, 0.10) + above("periodicity", 0.15, 0.5, 0.15) + above("clustering", 0.25, 0.5, 0.15)
    )
    fit = c("bits").isin(16, 24) & c("rate").isin(44100, 48000) & (c("rms") >= 1e-6)
    a = a.withColumn("confidence", F.when(fit, F.least(F.lit(1.0), score)).otherwise(0.0)).withColumn("early", F.when(fit, c("early")).otherwise(False))
    a = a.withColumn("is_encoded", fit & (c("confidence") > F.when(c("early"), 0.25).otherwise(0.35)))
    version = F.when(c("is_encoded"), F.when(c("early"), "Early").when(c("entropy") > 0.85, "Current").otherwise("Unknown"))
    return a.select("track_id", "confidence", "is_encoded", version.alias("encoder_version"), F.when(fit, c("rate") * 2).alias("original_rate"))


def clipping_finding(samples: DataFrame, peaks: DataFrame, regions: DataFrame, thr: float = 0.99) -> DataFrame:
    """Clipping of each track: samples at the limit and peaks between samples; tracks without any have no row."""
    a = samples.groupBy("track_id").agg(F.count_if(F.abs("x") >= thr).alias("hits"), F.max(F.abs("x")).alias("peak"), F.count(F.lit(1)).alias("n"))
    p, r = peaks.groupBy("track_id").agg(F.sum("peaks").alias("peaks")), regions.groupBy("track_id").agg(F.count(F.lit(1)).alias("regions"))
    a = a.join(p, "track_id", "left").join(r, "track_id", "left").fillna(0, ["peaks", "regions"]).withColumn("clipped", F.col("hits") + F.col("peaks")).where("clipped > 0")
    ratio = F.col("clipped") / F.col("n")
    severity = F.when(ratio > 0.01, "critical").when(ratio > 0.001, "high").when(ratio > 0.0001, "medium").otherwise("low")
    return a.select("track_id", F.when(F.col("peak") > 0, 20 * F.log10("peak")).alias("peak_db"), "clipped", "regions", F.least(F.lit(1.0), ratio * 1000).alias("confidence"), severity.alias("severity"))


def multi_generation(findings: DataFrame, least: float = 0.6) -> DataFrame:
    """A finding for tracks with two or more sure transcode findings."""
    a = findings.where(F.col("defect_type").isin(*TRANSCODES) & (F.col("confidence") >= least)).groupBy("track_id").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    return _generations(a)


def _generations(sure: DataFrame) -> DataFrame:
    """``multi_generation`` from the number ``n`` of sure transcode findings of each track and their mean ``c``."""
    return sure.where("n >= 2").select("track_id", F.lit("LossyTranscode").alias("defect_type"), _clip(F.col("c"), 0.4, 0.95).alias("confidence"), F.lit("high").alias("severity"), F.lit("multi_generation").alias("detector"), F.lit(None).cast("int").alias("estimated_bitrate"))


def confidence_gate(findings: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Findings that reach the least confidence of their kind; high bitrates are given a fifth of grace."""
    kind = F.col("defect_type")
    coded = kind.isin("Mp3Transcode", "AacTranscode")
    high = (coded & (F.coalesce("estimated_bitrate", F.lit(192)) >= 256)) | kind.isin("OpusTranscode", "OggVorbisTranscode")
    floor = F.when(coded, F.when(high, 0.3).otherwise(0.5)).when(high, 0.3).when(kind.isin("LossyTranscode", "Upsampled", "BitDepthInflated"), 0.4).otherwise(min_confidence)
    floor = F.least(floor, F.lit(min_confidence))
    return findings.where((F.col("confidence") >= floor) | (high & (F.col("confidence") >= floor * 0.8)))


def assemble_findings(findings: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Candidate findings of all detectors, gated by each other.

    ``detector`` names the source: dither, resampling, cutoff, bit_depth, shelf, downsampling, mqa, clipping,
    mfcc, sfm or pre_echo.  A cutoff falls to resampling, shelf and downsampling to a cutoff, downsampling
    to resampling, and of mfcc and sfm the surer one stays unless there is a cutoff.  Then padded bits
    fall to lossy findings, and without those or resampling they must reach 0.85.
    """
    kinds, d, c = GATED, F.col("detector"), F.col("confidence")
    at = F.coalesce(*[F.when(d == k, F.lit(i)) for i, k in enumerate(kinds)], F.when(d.isNull(), F.lit(len(kinds) - 1)), F.lit(len(kinds) - 2))
    sure = F.col("defect_type").isin(*TRANSCODES) & (c >= 0.6)
    # One pass over the findings: what stays of a track depends on its detectors only, so its later flags are counted for each of these.
    flags = [F.bool_or(d == "resampling").alias("resampled"), F.max(F.when(d == "mfcc", c)).alias("m"), F.max(F.when(d == "sfm", c)).alias("s"), F.bool_or(d == "cutoff").alias("cut")]
    for i in range(len(kinds)):
        flags += [F.bool_or(F.when(at == i, is_lossy(F.col("defect_type")))).alias(f"lossy{i}"), F.count_if((at == i) & sure).alias(f"n{i}"), F.sum(F.when((at == i) & sure, c)).alias(f"c{i}")]
    tracks = findings.where("track_id is not null").groupBy("track_id").agg(*flags).withColumn("coded", F.col("cut") & ~F.col("resampled"))

    def drop(d: Column) -> Column:
        return (
            ((d == "cutoff") & F.col("resampled")) | (d.isin("shelf", "downsampling", "mfcc", "sfm") & F.col("coded")) | ((d == "downsampling") & F.col("resampled"))
            | ((d == "sfm") & F.coalesce(F.col("m") >= F.col("s"), F.lit(False))) | ((d == "mfcc") & F.coalesce(F.col("s") > F.col("m"), F.lit(False)))
        )

    stays = [F.coalesce(~drop(F.lit(k).cast("string")), F.lit(False)) for k in kinds]
    over = lambda name, none: [F.coalesce(F.when(k, F.col(f"{name}{i}")), none) for i, k in enumerate(stays)]
    n = sum(over("n", F.lit(0)), F.lit(0))
    lossy, mean = F.greatest(*over("lossy", F.lit(None))), F.try_divide(sum(over("c", F.lit(0.0)), F.lit(0.0)), n)
    tracks = tracks.select("track_id", "resampled", "coded", "m", "s", lossy.alias("lossy"), n.alias("n"), mean.alias("c"))
    columns = ["track_id", "defect_type", "confidence", "severity", "detector", "estimated_bitrate"]
    f = findings.select(*columns).join(tracks.drop("n", "c"), "track_id").where(~drop(d))
    padded = F.col("defect_type") == "BitDepthInflated"
    f = f.where(~(padded & (F.col("lossy") | (~F.col("resampled") & (c < 0.85)))))
    return confidence_gate(f.select(*columns).unionByName(_generations(tracks)), min_confidence)


def overall_confidence(findings: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(track_id, confidence)``: one less the severity-weighted mean confidence; 1 without findings."""
    w = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in WEIGHTS.items()])
    a = findings.withColumn("w", w).groupBy("track_id").agg((1 - F.sum(F.col("confidence") * F.col("w")) / F.sum("w")).alias("confidence"))
    return tracks.select("track_id").join(a, "track_id", "left").select("track_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def verdict(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(track_id, genuine, quality_score, label)``; ``metrics`` has a row for each track, its noise floor may be null."""
    bad = findings.groupBy("track_id").agg(F.count_if(F.col("severity").isin("critical", "high", "medium")).alias("bad"))
    a = metrics.select("track_id", "noise_floor").join(bad, "track_id", "left").withColumn("genuine", F.coalesce("bad", F.lit(0)) == 0)
    score = F.when(F.col("noise_floor").isNotNull(), 1 - F.least(F.lit(1.0), F.abs("noise_floor") / 120)).when(F.col("genuine"), 0.95).otherwise(0.4)
    a = a.withColumn("quality_score", score)
    q = F.col("quality_score")
    label = F.when(F.col("genuine"), F.when(q >= 0.9, "Lossless").otherwise("Probably Lossless")).when(q < 0.5, "Lossy / Fake").otherwise("Suspect")
    return a.select("track_id", "genuine", "quality_score", label.alias("label"))


def profile_table(spark: SparkSession) -> DataFrame:
    """``(profile, detector, multiplier, suppressed)`` for all presets and detectors; fixed rows."""
    rows = []
    for name, (_, _, mods) in PROFILES.items():
        own = {d: (m, s) for d, m, s in mods}
        rows += [(name, d, *own.get(d, (1.0, False))) for d in DETECTORS]
    return spark.createDataFrame(rows, "profile string, detector string, multiplier double, suppressed boolean")


def custom_profile(spark: SparkSession, base: str = "standard", sensitivity: float | None = None, multipliers: dict[str, float] | None = None, disabled: tuple[str, ...] = (), suppressed: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """A profile table named ``custom`` with changes to a preset, and its sensitivity held within 0 and 2."""
    changes = {**{d: (m, False) for d, m in (multipliers or {}).items()}, **{d: (0.0, True) for d in disabled}, **{d: (1.0, True) for d in suppressed}}
    own = {d: (m, s) for d, m, s in PROFILES[base][2]} | changes
    table = spark.createDataFrame([("custom", d, *own.get(d, (1.0, False))) for d in DETECTORS], "profile string, detector string, multiplier double, suppressed boolean")
    return table, min(2.0, max(0.0, PROFILES[base][0] if sensitivity is None else sensitivity))


def apply_profile(findings: DataFrame, profile: str = "standard", table: DataFrame | None = None, sensitivity: float | None = None) -> DataFrame:
    """Findings with ``adjusted`` confidence and ``suppressed``; those of disabled detectors go, unknown detectors stay as they are."""
    t = F.broadcast((table if table is not None else profile_table(findings.sparkSession)).where(F.col("profile") == profile).drop("profile"))
    s = PROFILES[profile][0] if sensitivity is None else sensitivity
    j = findings.join(t, "detector", "left").where("coalesce(multiplier, 1.0) > 0")
    return j.withColumn("adjusted", _clip(F.col("confidence") * F.coalesce("multiplier", F.lit(1.0)) * s, 0.0, 1.0)).withColumn("suppressed", F.coalesce("suppressed", F.lit(False))).drop("multiplier")


def defect_badge(findings: DataFrame) -> DataFrame:
    """Findings with ``label``, ``category`` and ``detail``.

    Optional columns used: codec, estimated_bitrate, cutoff_hz, original_rate, current_rate, actual_bits, claimed_bits.
    """
    rows = [(k, label, cat) for k, (label, cat) in BADGES.items()]
    t = F.broadcast(findings.sparkSession.createDataFrame(rows, "defect_type string, label string, category string"))
    have = set(findings.columns)
    col = lambda n, kind="int": F.col(n) if n in have else F.lit(None).cast(kind)
    codec = F.coalesce(*[F.when(F.col("defect_type") == k, F.lit(v)) for k, v in (("Mp3Transcode", "MP3"), ("AacTranscode", "AAC"), ("OpusTranscode", "Opus"), ("OggVorbisTranscode", "OggVorbis"))], F.when(F.col("defect_type") == "LossyTranscode", col("codec", "string")))
    rate = F.when(col("estimated_bitrate").isNotNull(), F.concat(F.lit(" @ ~"), col("estimated_bitrate").cast("string"), F.lit(" kbps"))).otherwise("")
    detail = F.when(codec.isNotNull(), F.concat(codec, rate, F.lit(", cutoff "), col("cutoff_hz").cast("string"), F.lit(" Hz")))
    detail = detail.when(F.col("defect_type") == "Upsampled", F.concat(format_rate(col("original_rate")), F.lit(" → "), format_rate(col("current_rate"))))
    detail = detail.when(F.col("defect_type") == "BitDepthInflated", F.concat(col("actual_bits").cast("string"), F.lit("-bit content in "), col("claimed_bits").cast("string"), F.lit("-bit container")))
    return findings.join(t, "defect_type", "left").withColumn("label", F.coalesce("label", F.upper(col("codec", "string")))).withColumn("detail", detail)


def findings_diff(df: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """``df`` with ``missing`` and ``extra``."""
    return df.withColumn("missing", F.array_except(expected, found)).withColumn("extra", F.array_except(found, expected))
