"""Low-order bits of integer samples ``(track_id, ch, idx, q)``: entropies, usage, correlation, bit depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.operators.blocks import CH, neighbours
from wavemill.operators.levels import order_statistic

LAGS = (1, 2, 4, 8, 16, 32, 64, 128)
PERIODS = (256, 512, 1024, 1152, 2048, 2304, 4096)
# How many samples from a channel's start a short analysis takes in, and sections for quantization_step.
FIRST_SAMPLES = {"lsb_periodicity": 65_536, "bit_transition_rate": 100_000, "lsb_value_clustering": 100_000, "byte_pattern_score": 16_384}
#: Periods that the short analysis looks at.
FIRST_PERIODS = {"lsb_periodicity": 10, "byte_pattern_score": 4}
FIRST_SECTIONS = 30


def _first(ints: DataFrame, cap: int | None) -> DataFrame:
    """The channel whole, or its first ``cap`` samples."""
    return ints if cap is None else ints.where(F.col("idx") < cap)


def low_byte(q: Column) -> Column:
    return F.abs(q).bitwiseAND(255)


def _entropy(ints: DataFrame, value: Column, log2: bool = True) -> DataFrame:
    """Entropy of a value's distribution by channel, with the number of distinct values."""
    counts = ints.groupBy(*CH, value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*CH))
    counts = counts.withColumn("p", p)
    return counts.groupBy(*CH).agg((-F.sum(F.col("p") * (F.log2("p") if log2 else F.log("p")))).alias("h"), F.count(F.lit(1)).alias("k"))


def lsb_bit_entropy(ints: DataFrame) -> DataFrame:
    """Bits of entropy of the lowest bit."""
    return _entropy(ints, F.col("q").bitwiseAND(1)).select(*CH, (F.col("h") + 0.0).alias("entropy"))


def lsb_nibble_entropy(ints: DataFrame) -> DataFrame:
    """Entropy of the lowest four bits, as a share of the largest possible."""
    return _entropy(ints, F.col("q").bitwiseAND(15), log2=False).select(*CH, (F.col("h") / F.log(F.lit(16.0))).alias("entropy"))


def lsb_byte_entropy(ints: DataFrame, normalize: bool = True) -> DataFrame:
    """Entropy of the low byte of the magnitude, over 8 if normalised; 0 for a single value."""
    e = _entropy(ints, low_byte(F.col("q")))
    h = F.col("h") / 8 if normalize else F.col("h")
    return e.select(*CH, F.when(F.col("k") <= 1, 0.0).otherwise(h).alias("entropy"))


def bit_usage(ints: DataFrame, bits: int) -> DataFrame:
    """``(track_id, ch, bit, share)``: how often each bit is set, in two's complement."""
    sums = [F.avg(F.shiftright("q", b).bitwiseAND(1).cast("double")).alias(f"b{b}") for b in range(bits)]
    wide = ints.groupBy(*CH).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(b).alias("bit"), F.col(f"b{b}").alias("share")) for b in range(bits)])
    return wide.select(*CH, F.explode(pairs).alias("p")).select(*CH, "p.bit", "p.share")


def effective_bits(usage: DataFrame, bits: int, least: float = 0.01, variant: str = "highest") -> DataFrame:
    """``highest``: the highest bit in use plus one, 8 at least.  ``lowest``: claimed bits less unused ones from the bottom."""
    if variant == "highest":
        top = F.max(F.when(F.col("share") > least, F.col("bit")).otherwise(0))
        return usage.groupBy(*CH).agg(F.greatest(F.lit(8), top + 1).alias("effective_bits"))
    used = (F.col("share") >= least) & (F.col("share") <= 1 - least)
    return usage.groupBy(*CH).agg((F.lit(bits) - F.coalesce(F.min(F.when(used, F.col("bit"))), F.lit(bits))).alias("effective_bits"))


# The rungs of the ladders below are fixed values: condition, bits, confidence.
def _ladder(steps: list[tuple[Column, int, float]], bits: int, conf: float) -> tuple[Column, Column]:
    b, c = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0.0))
    for cond, x, y in steps:
        b, c = b.when(cond, F.lit(x)), c.when(cond, F.lit(y))
    return b.otherwise(F.lit(bits)).alias("bits"), c.otherwise(F.lit(conf)).alias("conf")


def trailing_zero_profile(ints: DataFrame) -> DataFrame:
    """Bits from trailing zeros of non-silent 24-bit integers ``q`` with their sample ``x``."""
    z = F.when(F.col("q") % 256 == 0, 8)  # only whether 8, more, or at most 3
    low = F.col("q").bitwiseAND(15) != 0
    exact = (F.col("q") % 256 == 0) & (F.col("q") % 512 != 0)
    a = ints.where((F.abs("x") >= 1e-5) & (F.col("q") != 0)).groupBy(*CH).agg(
        F.count(F.lit(1)).alias("n"), F.avg(exact.cast("double")).alias("r8"), F.avg(z.isNotNull().cast("double")).alias("r8p"), F.avg(low.cast("double")).alias("r3")
    )
    r8, r8p, r3 = F.col("r8"), F.col("r8p"), F.col("r3")
    steps = [
        (F.col("n") < 1000, 24, 0.3), ((r8 > 0.97) & (r3 < 0.01), 16, 0.98), ((r8 > 0.95) & (r3 < 0.02), 16, 0.92), ((r8p > 0.93) & (r3 < 0.03), 16, 0.85),
        (r3 > 0.20, 24, 0.95), (r3 > 0.10, 24, 0.85), (r3 > 0.05, 24, 0.70), (r8p > 0.85, 16, 0.55),
    ]
    return a.select(*CH, "n", r8.alias("ratio_8"), r8p.alias("ratio_8_plus"), r3.alias("ratio_low"), *_ladder(steps, 24, 0.60))


def unique_ratio(samples: DataFrame, approx: bool = False) -> DataFrame:
    """Bits from how many more distinct 24-bit than 16-bit values there are, and how many are multiples of 256."""
    q24, q16 = F.round(F.col("x") * 8388607).cast("int"), F.round(F.col("x") * 32767).cast("int")
    rows = samples.where(F.abs("x") >= 1e-5).select(*CH, q24.alias("q24"), q16.alias("q16"))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    edge = F.when((F.col("q24") != 0) & (F.col("q24") % 256 == 0), F.col("q24"))
    a = rows.groupBy(*CH).agg(distinct("q16").alias("u16"), distinct("q24").alias("u24"), distinct(edge).alias("edges"))
    r, e = F.col("u24") / F.col("u16"), F.col("edges") / F.col("u24")
    steps = [
        ((r < 1.1) & (e > 0.90), 16, 0.98), ((r < 1.2) & (e > 0.85), 16, 0.90), ((r < 1.3) & (e > 0.80), 16, 0.80), (r > 50, 24, 0.98),
        (r > 20, 24, 0.90), (r > 10, 24, 0.80), (r > 3, 24, 0.70),
    ]
    return a.select(*CH, r.alias("ratio"), e.alias("edge_ratio"), *_ladder(steps, 24, 0.50))


def lsb_clustering(ints: DataFrame) -> DataFrame:
    """Bits from the concentration and entropy of the low byte of non-silent samples."""
    counts = ints.where(F.abs("x") >= 1e-5).groupBy(*CH, low_byte(F.col("q")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*CH))
    a = counts.withColumn("p", p).groupBy(*CH).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum(F.when(F.col("v").isin(0, 128), F.col("p"))), F.lit(0.0)).alias("share"), (-F.sum(F.col("p") * F.log2("p")) / 8).alias("entropy")
    )
    s, k, h = F.col("share"), F.col("kinds"), F.col("entropy")
    steps = [
        (F.col("n") < 1000, 24, 0.3), ((s > 0.97) & (k < 5), 16, 0.98), ((s > 0.93) & (k < 10), 16, 0.90), ((s > 0.88) & (k < 20), 16, 0.82),
        ((h > 0.90) & (k > 200), 24, 0.98), ((h > 0.80) & (k > 150), 24, 0.85), (k > 100, 24, 0.70), (s > 0.80, 16, 0.55),
    ]
    return a.select(*CH, "n", "kinds", "share", "entropy", *_ladder(steps, 24, 0.55))


def quantization_step(samples: DataFrame, section: int = 16384, quiet: int = 8, sections: int | None = None, least: int = 100) -> DataFrame:
    """Bits from the tenth percentile of steps between samples in the quietest sections, of all or of the first ``sections``."""
    rows = _first(samples, sections and section * sections).withColumn("s", F.floor(F.col("idx") / section))
    full = rows.groupBy(*CH, "s").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("n")).where(F.col("n") == section)
    calm = full.where("rms > 1e-7 and rms < 0.01").withColumn("k", F.row_number().over(W.partitionBy(*CH).orderBy("rms", "s"))).where(F.col("k") <= quiet)
    step = F.abs(F.col("x") - F.lag("x").over(W.partitionBy(*CH, "s").orderBy("idx")))
    steps = rows.join(calm.select(*CH, "s"), [*CH, "s"]).withColumn("d", step).where("d > 1e-10 and d < 0.001")
    ranked = order_statistic(steps, [*CH, "s"], "d", F.floor(F.col("n") / 10), "step")
    enough = steps.groupBy(*CH, "s").count().where(F.col("count") > least).drop("count")
    mean = ranked.join(enough, [*CH, "s"]).groupBy(*CH).agg(F.avg("step").alias("step"))
    had = samples.groupBy(*CH).agg(F.count(F.lit(1)).alias("n"))
    a, s16, s24 = had.join(mean, CH, "left"), 1 / 32768, 1 / 8388608
    v = F.col("step")
    rungs = [(F.col("n") < section, 24, 0.3), (v.isNull(), 24, 0.40), (v > s16 * 0.8, 16, 0.85), (v < s24 * 100, 24, 0.90), (v < s16 * 0.3, 24, 0.75)]
    return a.select(*CH, "step", *_ladder(rungs, 24, 0.45))


def vote_bit_depth(methods: DataFrame, claimed: int) -> DataFrame:
    """The verdict over rows ``(track_id, ch, bits, conf)``, one for each method; 16 only on strong agreement."""
    low = F.col("bits") <= 16
    count = lambda c: F.count_if(low & (F.col("conf") >= c))
    a = methods.groupBy(*CH).agg(
        F.coalesce(F.sum(F.when(low, F.col("conf"))), F.lit(0.0)).alias("v16"), F.coalesce(F.sum(F.when(~low, F.col("conf"))), F.lit(0.0)).alias("v24"),
        count(0.80).alias("high"), count(0.90).alias("very"), count(0.85).alias("sure"),
    )
    v16, v24 = F.col("v16"), F.col("v24")
    t = v16 + v24
    rules = [
        (t < 0.1, F.lit(claimed), F.lit(0.3)), ((v16 > v24) & (F.col("very") >= 3), F.lit(16), v16 / t), ((v16 > v24) & (F.col("high") >= 4), F.lit(16), v16 / t * 0.95),
        ((v16 > v24 * 2) & (F.col("high") >= 3), F.lit(16), v16 / t * 0.90), (v24 > v16, F.lit(24), v24 / t),
    ]
    bits, conf = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0.0))
    for cond, b, c in rules:
        bits, conf = bits.when(cond, b), conf.when(cond, c)
    a = a.withColumn("actual_bits", bits.otherwise(claimed)).withColumn("confidence", conf.otherwise(0.5))
    mismatch = (F.col("actual_bits") == 16) & (F.lit(claimed) >= 24) & (F.col("confidence") >= 0.90) & (F.col("sure") >= 3)
    return a.select(*CH, "actual_bits", "confidence", mismatch.alias("is_mismatch"))


def lsb_lag_correlation(ints: DataFrame, lags: tuple[int, ...] = LAGS, least: int = 1000) -> DataFrame:
    """Mean over lags of the absolute correlation of the low byte with itself; sums are exact integers."""
    v = ints.select(*CH, "idx", low_byte(F.col("q")).cast("long").alias("v"))
    v = neighbours(v, "v", [-k for k in lags])
    sums = [F.count("v").alias("n"), F.avg("v").alias("mu"), F.var_pop("v").alias("var")]
    for k in lags:
        b = F.col(f"v_m{k}")
        sums += [F.sum(F.col("v") * b).alias(f"ab{k}"), F.sum(F.when(b.isNotNull(), F.col("v"))).alias(f"a{k}"), F.sum(b).alias(f"b{k}"), F.count(b).alias(f"n{k}")]
    s = v.groupBy(*CH).agg(*sums)
    mu = F.col("mu")
    each = [F.when(F.col(f"n{k}") > 0, F.abs((F.col(f"ab{k}") - mu * (F.col(f"a{k}") + F.col(f"b{k}")) + F.col(f"n{k}") * mu * mu) / (F.col(f"n{k}") * F.col("var")))) for k in lags]
    total = sum((F.coalesce(e, F.lit(0.0)) for e in each), F.lit(0.0)) / sum((e.isNotNull().cast("int") for e in each), F.lit(0))
    return s.select(*CH, F.when((F.col("n") < least) | (F.col("var") < 0.001), 0.0).otherwise(total).alias("correlation"))


def lsb_periodicity(ints: DataFrame, periods: tuple[int, ...] = PERIODS, span: int | None = None, room: int = 3, gain: float = 10.0, least: int = 4096, cap: int | None = None) -> DataFrame:
    """Largest share of low bytes equal to the one a period before, over the whole channel.

    The short analysis looks at the first ``cap`` samples (65 536) and of these at the first ``span`` periods (10).
    """
    had = _first(ints, cap).groupBy(*CH).agg(F.count(F.lit(1)).alias("n"))
    # What lies beyond the longest span is not looked at, so it is not sorted.
    reach = None if span is None else min(x for x in (cap, max(periods) * span) if x is not None)
    v = _first(ints, cap if reach is None else reach).select(*CH, "idx", low_byte(F.col("q")).alias("v"))
    v = neighbours(v, "v", [-p for p in periods])
    agg = []
    for p in periods:
        inside = (F.col("idx") >= p) if span is None else (F.col("idx") >= p) & (F.col("idx") < p * span)
        agg.append(F.avg(F.when(inside, (F.col("v") == F.col(f"v_m{p}")).cast("double"))).alias(f"r{p}"))
    s = v.groupBy(*CH).agg(*agg).join(had, CH)
    scores = [F.when((F.col("n") >= p * room) & (F.col(f"r{p}") > 0.01), F.col(f"r{p}") * gain).otherwise(0.0) for p in periods]
    return s.select(*CH, F.when(F.col("n") < least, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(*scores))).alias("periodicity"))


def bit_transition_rate(ints: DataFrame, least: int = 1000, cap: int | None = None) -> DataFrame:
    """Share of low-byte bits that change from sample to sample, in the channel or its first ``cap`` samples."""
    v = neighbours(_first(ints, cap).select(*CH, "idx", low_byte(F.col("q")).alias("v")), "v", [-1])
    s = v.groupBy(*CH).agg(F.count(F.lit(1)).alias("n"), F.sum(F.bit_count(F.col("v").bitwiseXOR(F.col("v_m1")))).alias("t"))
    return s.select(*CH, F.when(F.col("n") < least, 0.5).otherwise(F.col("t") / (8 * (F.col("n") - 1))).alias("rate"))


def lsb_value_clustering(ints: DataFrame, least: int = 1000, cap: int | None = None) -> DataFrame:
    """How few byte values hold more than a hundredth of the samples each, of the channel or its first ``cap`` samples."""
    counts = _first(ints, cap).groupBy(*CH, low_byte(F.col("q")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("n", F.sum("c").over(W.partitionBy(*CH)))
    s = counts.groupBy(*CH).agg(F.max("n").alias("n"), F.count_if(F.col("c") > F.floor(F.col("n") / 100)).alias("k"))
    k = F.col("k").cast("double")
    score = F.when(k < 50, 1 - k / 50).when(k < 150, 0.5 * (1 - (k - 50) / 100)).otherwise(0.0)
    return s.select(*CH, F.when(F.col("n") < least, 0.0).otherwise(score).alias("clustering"))


def byte_pattern_score(ints: DataFrame, least: int = 4096, cap: int | None = None, span: int | None = None) -> DataFrame:
    """Score of change rate, rare byte values and periodicity of the low-byte stream, of the channel.

    The short analysis looks at the first ``cap`` samples (16 384) and for periods at the first ``span`` of each (4).
    """
    rows = _first(ints, cap)
    v = neighbours(rows.select(*CH, "idx", low_byte(F.col("q")).alias("v")), "v", [-1])
    change = v.groupBy(*CH).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") != F.col("v_m1")).cast("double")).alias("rate"))
    common = rows.groupBy(*CH, low_byte(F.col("q")).alias("v")).count().groupBy(*CH).agg((256 - F.count_if(F.col("count") >= 5)).alias("rare"))
    period = lsb_periodicity(rows, (256, 512, 1024, 2048), span=span, room=2, gain=1.0, least=1024, cap=cap)
    s = change.join(common, CH).join(period, CH)
    score = (
        F.when((F.col("rate") > 0.45) & (F.col("rate") < 0.55), 0.3).otherwise(0.0)
        + F.when((F.col("rare") > 10) & (F.col("rare") < 100), 0.2).otherwise(0.0)
        + F.when(F.col("periodicity") > 0.2, F.col("periodicity") * 0.3).otherwise(0.0)
    )
    return s.select(*CH, F.when(F.col("n") < least, 0.0).otherwise(F.least(F.lit(1.0), score)).alias("score"))
