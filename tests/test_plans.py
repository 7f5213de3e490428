"""What plans read and how often they deal it, where results alone do not tell."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from wavemill.functions.scalar import is_lossy
from wavemill.operators import findings, ordered


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain_assembly(rows, min_confidence=0.5):
    """The gates of ``assemble_findings`` one after the other."""
    flag = rows.groupBy("track_id").agg(F.bool_or(F.col("detector") == "resampling").alias("re0"), F.max(F.when(F.col("detector") == "mfcc", F.col("confidence"))).alias("m"), F.max(F.when(F.col("detector") == "sfm", F.col("confidence"))).alias("s"), F.bool_or(F.col("detector") == "cutoff").alias("cut"))
    gone = """(detector = 'cutoff' AND re0) OR (detector IN ('shelf', 'downsampling', 'mfcc', 'sfm') AND cut AND NOT re0) OR (detector = 'downsampling' AND re0)
    OR (detector = 'sfm' AND coalesce(m >= s, false)) OR (detector = 'mfcc' AND coalesce(s > m, false))"""
    f = rows.join(flag, "track_id").where(f"NOT ({gone})").select(rows.columns)
    f = f.unionByName(findings.multi_generation(f))
    state = f.groupBy("track_id").agg(F.bool_or(is_lossy(F.col("defect_type"))).alias("lossy"), F.bool_or(F.col("detector") == "resampling").alias("re"))
    f = f.join(state, "track_id").where("NOT (defect_type = 'BitDepthInflated' AND (lossy OR (NOT re AND confidence < 0.85)))")
    return findings.confidence_gate(f.select(rows.columns), min_confidence)


def test_assembled_findings_meet_their_track_once(spark):
    detectors = ["cutoff", "resampling", "shelf", "downsampling", "mfcc", "sfm", "bit_depth", "clipping", None]
    kinds = [*findings.TRANSCODES, "Upsampled", "BitDepthInflated", "Clipping", None]
    rows, n = [], 0
    for size in (1, 2, 3):
        for some in itertools.combinations(detectors, size):
            for turn in range(3):
                rows += [(n if n % 50 else None, kinds[(n * 7 + i * 3 + turn) % len(kinds)], [0.2, 0.65, 0.9, None, 0.7][(n + i) % 5], "high", d, 320 if n % 2 else None) for i, d in enumerate(some)]
                n += 1
    df = spark.createDataFrame(rows, "track_id long, defect_type string, confidence double, severity string, detector string, estimated_bitrate int")
    got = findings.assemble_findings(df)
    key = lambda r: tuple((v is not None, v) for v in r)
    tidy = lambda d: sorted((tuple(r) for r in d.withColumn("confidence", F.round("confidence", 9)).collect()), key=key)
    assert tidy(got) == tidy(plain_assembly(df))
    # Findings meet their track in one join, and no join is joined again.
    assert optimized(got).count("Join Inner") == 1


def test_samples_are_never_dealt_by_channel(spark):
    """Long channels are few: what is told of a whole channel meets samples by block."""
    s = spark.range(300).select(F.lit("a").alias("track_id"), F.lit(0).alias("ch"), F.col("id").alias("idx"), F.sin("id").alias("x"))
    env = ordered.from_blocks(ordered.envelope(ordered.to_blocks(s, 64), 0.2, 0.01, smooth=8, block=64), 64)
    for df in (ordered.moving_average(s, 8), ordered.envelope(ordered.to_blocks(s, 64), 0.2, 0.01), ordered.find_transients(env, 0.5, 20)):
        joins = [line for line in optimized(df).splitlines() if "Join Inner" in line]
        assert joins and all("__b" in j or "block_no" in j or "b#" in j for j in joins)


def test_a_block_is_correlated_where_it_is_packed(spark):
    """A table of blocks would come to the next Python step in batches of many blocks."""
    s = spark.range(5000).select(F.lit("a").alias("track_id"), F.lit(0).alias("ch"), F.col("id").alias("idx"), F.sin("id").alias("x"))
    r = ordered.autocorrelation(s, 8, 1000)
    assert optimized(r.where("lag = 0")).count("MapInArrow") <= 2
    x = np.sin(np.arange(5000))
    assert np.allclose([v.r for v in r.orderBy("lag").collect()], [x[: 5000 - k] @ x[k:] / (x @ x) for k in range(9)])


def test_padded_bits_are_found_without_samples_in_a_join(spark):
    """Samples meet their track's bits as sums: below every join there is an aggregate between it and the samples."""
    rows = [(t, 0, i, (i * 7919 + t * 104729) % (1 << 23) >> z << z) for t, z in ((1, 0), (2, 8), (3, 13), (4, 16)) for i in range(400)]
    x = spark.createDataFrame([*rows, (5, 0, 0, None)], "track_id long, ch int, idx long, q long")
    usage = spark.createDataFrame([(t, c, e) for t, e in ((1, 24), (2, 16), (3, 11), (4, 8), (5, 24)) for c in (0, 1)], "track_id long, ch int, effective_bits int")
    entropy = spark.createDataFrame([(t, 0.05) for t in range(1, 6)], "track_id long, entropy double")
    got = findings.bit_depth_finding(x, 24, usage, entropy)
    path, bare = [], []
    for line in optimized(got).splitlines():
        text = line.lstrip(" :+-")
        path = [p for p in path if p[0] < len(line) - len(text)]
        path.append((len(line) - len(text), text))
        if "q#" in text and text.startswith("LogicalRDD"):
            names = [p[1].split()[0] for p in path]
            bare += names[max((i for i, n in enumerate(names) if n == "Join"), default=0) :]
    assert bare and "Aggregate" in bare, bare
    # The plain form: every sample with the bits of its track.
    shift = F.pow(F.lit(2.0), 24 - F.col("effective_bits"))
    r = F.col("q") - F.floor(F.col("q") / shift) * shift
    n = x.join(usage.select("track_id", "effective_bits"), "track_id").groupBy("track_id", "effective_bits").agg(F.sum(r * r).alias("r"), F.sum(F.col("q").cast("double") * F.col("q")).alias("s"))
    n = n.select("track_id", "effective_bits", F.when((F.col("r") > 0) & (F.col("s") > 0), 10 * F.log10(F.col("r") / F.col("s"))).otherwise(-120.0).alias("db"))
    want = {k.track_id: (k.effective_bits, round(k.db, 9)) for k in n.collect()}
    found = {k.track_id: (k.effective_bits, round(k.q_noise_db, 9)) for k in got.collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found == want
