"""Levels, dynamic range, stereo and corpus statistics of sample tables ``(track_id, ch, idx, x)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions.scalar import dbfs, lufs_from_power, lufs_from_rms

CH = ["track_id", "ch"]


def to_mono(samples: DataFrame) -> DataFrame:
    """Mean over the channels at each index."""
    return samples.groupBy("track_id", "idx").agg(F.avg("x").alias("x")).select("track_id", F.lit(0).alias("ch"), "idx", "x")


def deinterleave(df: DataFrame, channels: int) -> DataFrame:
    """Interleaved ``(track_id, g, x)`` to channels."""
    return df.select("track_id", (F.col("g") % channels).cast("int").alias("ch"), F.floor(F.col("g") / channels).alias("idx"), "x")


def interleave(samples: DataFrame, channels: int) -> DataFrame:
    """All channels as one, in playing order."""
    return samples.select("track_id", F.lit(0).alias("ch"), (F.col("idx") * channels + F.col("ch")).alias("idx"), "x")


def _pair(samples: DataFrame) -> DataFrame:
    left = F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("l")
    right = F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("r")
    return samples.where("ch < 2").groupBy("track_id", "idx").agg(left, right)


def mid_side(samples: DataFrame) -> DataFrame:
    """Half sum and half difference of channels 0 and 1; null where one is missing."""
    return _pair(samples).select("track_id", "idx", ((F.col("l") + F.col("r")) / 2).alias("mid"), ((F.col("l") - F.col("r")) / 2).alias("side"))


def level_stats(samples: DataFrame) -> DataFrame:
    """Peak, RMS and crest of each channel."""
    s = samples.groupBy(*CH).agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    s = s.withColumns({"peak_dbfs": dbfs(F.col("peak")), "rms_dbfs": dbfs(F.col("rms"))})
    return s.withColumn("crest_db", F.col("peak_dbfs") - F.col("rms_dbfs"))


def _bin(value: str) -> Column:
    """A number that never falls as the value rises: sixteen bins for each doubling of the magnitude."""
    v = F.col(value).cast("double")
    # Infinities lie beyond all finite values, and what is no number comes last.
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 16) + 20_000
    return F.when(F.isnan(v), 50_000).otherwise(F.signum(v) * size).cast("int")


#: Parts that the bin of a rank is cut in.
SPLITS = 4096


def order_statistic(df: DataFrame, keys: list[str], value: str, rank: Column, out: str) -> DataFrame:
    """``(*keys, out)``: the value at a rank (from 0) that may depend on the group's size ``n``.

    Values are counted first.  Bins, of which a group has a bounded number, are summed to find the one that
    holds the rank; it is cut in ``SPLITS`` equal parts, which are summed alike; only the values of one part are then put
    in order, so a group whose values are close to each other is no single task.  Null values do not count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__bin", F.coalesce(_bin(value), F.lit(0)))
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__s"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    bins = bins.withColumn("n", F.sum("__s").over(W.partitionBy(*keys))).withColumn("__left", rank)
    there = _holding(bins, keys, "__bin").select(*keys, "__bin", "__left", "__low", "__high")
    place = (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * SPLITS
    # Values that are not finite come last.
    part = F.when(F.col("__high") == F.col("__low"), 0).otherwise(F.coalesce(F.when(~F.isnan(place), F.least(F.floor(place), F.lit(SPLITS - 1))), F.lit(SPLITS - 1)))
    inside = counts.join(there, [*keys, "__bin"]).select(*keys, value, "__c", "__left", part.cast("int").alias("__part"))
    parts = inside.groupBy(*keys, "__part").agg(F.sum("__c").alias("__s"), F.first("__left").alias("__left"))
    last = inside.drop("__left").join(_holding(parts, keys, "__part").select(*keys, "__part", "__left"), [*keys, "__part"])
    last = last.withColumn("__cum", F.sum("__c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    return last.where(F.col("__cum") > F.col("__left")).groupBy(*keys).agg(F.min(value).alias(out))


def _holding(bins: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of each group's bins with sums ``__s`` the one that holds the rank ``__left``, which then counts from its start."""
    cum = bins.withColumn("__cum", F.sum("__s").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0)))
    there = cum.where((F.col("__cum") > F.col("__left")) & (F.col("__cum") - F.col("__s") <= F.col("__left")))
    return there.withColumn("__left", F.col("__left") - F.col("__cum") + F.col("__s"))


def quality_metrics(samples: DataFrame, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Metrics of a whole track: the noise floor is the order statistic at one percent of the magnitudes.

    Not ``exact``, it is read off a mergeable sketch in the pass of the other metrics, and its rank is right within one in
    ``accuracy`` samples of the track.
    ``true_peak`` and ``lufs_integrated`` are the sample peak and the RMS in decibels; ``true_peak``
    and ``integrated_loudness`` elsewhere measure what the names say.
    """
    mags = samples.select("track_id", F.abs("x").alias("a"))
    sketch = [] if exact else [F.percentile_approx("a", 0.01, accuracy).alias("low")]
    base = mags.groupBy("track_id").agg(F.max("a").alias("peak"), F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rms"), *sketch)
    if exact:
        base = base.join(order_statistic(mags, ["track_id"], "a", F.floor(F.col("n") / 100), "low"), "track_id")
    db = lambda c: F.when(F.col(c) > 0, 20 * F.log10(c))
    out = base.withColumns({"true_peak": db("peak"), "lufs_integrated": db("rms")})
    return out.select(
        "track_id", (F.col("true_peak") - F.col("lufs_integrated") + 3).alias("dynamic_range"), F.coalesce(db("low"), F.lit(-96.0)).alias("noise_floor"), F.lit(0.0).alias("spectral_centroid"),
        F.when(F.col("rms") > 0, 20 * F.log10(F.col("peak") / F.col("rms"))).otherwise(0.0).alias("crest_factor"), "true_peak", "lufs_integrated",
    )


def stereo_stats(samples: DataFrame) -> DataFrame:
    """Correlation, width and side energy of channels 0 and 1."""
    p = _pair(samples).where("l is not null and r is not null")
    m, s = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    a = p.groupBy("track_id").agg(F.covar_pop("l", "r").alias("c"), F.var_pop("l").alias("vl"), F.var_pop("r").alias("vr"), F.sum(m * m).alias("me"), F.sum(s * s).alias("se"))
    corr = F.when((F.col("vl") <= 1e-10) | (F.col("vr") <= 1e-10), 1.0).otherwise(F.col("c") / F.sqrt(F.col("vl") * F.col("vr")))
    a = a.withColumn("correlation", corr).withColumn("width", F.sqrt(F.greatest(F.lit(0.0), 1 - F.abs("correlation"))))
    a = a.withColumn("side_mid_ratio", F.when(F.col("me") > 1e-10, F.col("se") / F.col("me")).otherwise(0.0))
    joint = (F.col("correlation") > 0.95) & (F.col("side_mid_ratio") < 0.1)
    return a.select("track_id", "correlation", "width", "side_mid_ratio", joint.alias("joint_stereo"), F.when(joint, 0.7).otherwise(0.0).alias("confidence"))


def tt_dr(samples: DataFrame, block: int, top: float = 0.2, gate: float = 1e-3) -> DataFrame:
    """Dynamic range from the loudest fifth of full blocks of ``block`` samples, near-silent blocks left out.

    A channel shorter than a block is one block.  Blocks are reduced before channels, so a long
    channel is spread over its blocks.
    """
    x2 = F.col("x") * F.col("x")
    blocks = samples.groupBy(*CH, F.floor(F.col("idx") / block).alias("b")).agg(F.max(F.abs("x")).alias("peak"), F.sum(x2).alias("ss"), F.count(F.lit(1)).alias("n"))
    of = W.partitionBy(*CH)
    blocks = blocks.withColumn("total", F.sum("n").over(of)).withColumn("rms", F.sqrt(F.col("ss") / F.col("n")))
    short = blocks.where(F.col("total") < block).select(*CH, (dbfs(F.col("peak")) - dbfs(F.col("rms"))).alias("dr_db"), F.lit(1).cast("long").alias("blocks"))
    full = blocks.where((F.col("total") >= block) & (F.col("n") == block))
    full = full.withColumn("loud", F.col("rms") > gate).withColumn("all", F.count(F.lit(1)).over(of))
    ranked = full.withColumn("k", F.row_number().over(W.partitionBy(*CH, "loud").orderBy(F.desc("rms"), "b"))).withColumn("m", F.count_if("loud").over(of))
    chosen = F.col("loud") & (F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(top))))
    agg = ranked.groupBy(*CH).agg(F.avg(F.when(chosen, F.col("peak"))).alias("p"), F.avg(F.when(chosen, F.col("rms"))).alias("r"), F.max("all").alias("blocks"))
    dr = F.when(F.col("p").isNull(), 0.0).otherwise(dbfs(F.col("p")) - dbfs(F.col("r")))
    return agg.select(*CH, dr.alias("dr_db"), "blocks").unionByName(short)


def integrated_loudness(weighted: DataFrame, quarter: int) -> DataFrame:
    """Gated loudness of K-weighted samples in blocks of four ``quarter`` lengths with hops of one.

    Quarter sums slide over four; the absolute gate is -70 LUFS, the relative one 10 LU below the mean.
    """
    hops = weighted.groupBy(*CH, F.floor(F.col("idx") / quarter).alias("h")).agg(F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    slide = W.partitionBy(*CH).orderBy("h").rowsBetween(0, 3)
    blocks = hops.withColumn("bs", F.sum("ss").over(slide)).withColumn("bn", F.sum("n").over(slide))
    of = W.partitionBy(*CH)
    blocks = blocks.withColumn("p", F.when(F.col("bn") == 4 * quarter, F.col("bs") / (4 * quarter)))
    loud = F.when(F.col("p") > 10 ** ((-70 + 0.691) / 10), F.col("p"))
    blocks = blocks.withColumn("loud", loud).withColumn("mean", F.avg("loud").over(of))
    kept = F.when(F.col("loud") > F.col("mean") * F.pow(F.lit(10.0), F.lit(-1.0)), F.col("loud"))
    out = blocks.groupBy(*CH).agg(F.avg(kept).alias("g"), F.count("p").alias("k"), F.sqrt(F.sum("ss") / F.sum("n")).alias("rms"))
    lufs = F.when(F.col("k") == 0, lufs_from_rms(F.col("rms"))).when(F.col("g").isNull(), -70.0).otherwise(lufs_from_power(F.col("g")))
    return out.select(*CH, lufs.alias("lufs"))


def dr_verdict(levels: DataFrame, dr: DataFrame, loudness: DataFrame) -> DataFrame:
    """Per track: mean DR and loudness over channels, peak-to-loudness ratio and the class."""
    joined = levels.join(dr, CH).join(loudness, CH)
    a = joined.groupBy("track_id").agg(F.max("peak_dbfs").alias("peak_dbfs"), F.avg("dr_db").alias("dr"), F.avg("lufs").alias("lufs"), F.avg("crest_db").alias("crest_db"))
    d = F.col("dr")
    verdict = F.when(d > 20, "Exceptional").when(d >= 14, "Excellent").when(d >= 8, "Normal").when(d >= 5, "Compressed").otherwise("Brickwalled")
    return a.select("track_id", "dr", "lufs", "crest_db", (F.col("peak_dbfs") - F.col("lufs")).alias("plr_db"), verdict.alias("verdict"), (d < 8).alias("loudness_war_victim"))


def corpus_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of analysed, genuine, suspect and failed tracks; with ``by``, also its roll-ups."""
    ok = F.col("error").isNull()
    grouped = results.rollup(*by) if by else results.groupBy()
    return grouped.agg(F.count_if(ok).alias("analyzed"), F.count_if(ok & F.col("genuine")).alias("genuine"), F.count_if(ok & ~F.col("genuine")).alias("suspect"), F.count_if(~ok).alias("errors"))


def median(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Middle value, or the mean of the two in the middle."""
    low = order_statistic(df, by, col, F.floor((F.col("n") - 1) / 2), "__low")
    high = order_statistic(df, by, col, F.floor(F.col("n") / 2), "__high")
    return low.join(high, by).select(*by, ((F.col("__low") + F.col("__high")) / 2).alias("median"))
