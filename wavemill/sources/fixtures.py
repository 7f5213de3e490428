"""Signal views over general tables, so that every operator has data to run on.

A sample table is ``(track_id, ch, idx, x)``, idx counting from 0 within a track's channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.operators.blocks import numbered

#: Order of ``lineitem`` rows; no shorter key is unique.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
#: Nominal rate of the frame view, in Hz.
FRAME_RATE = 16_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, track: str, cell: Column | None) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_ORDER, track]))
    q = F.round(F.col("l_extendedprice") * 100).cast("long") - 5_295_000
    return numbered(rows, [track], LINE_ORDER, cell).select(F.col(track).alias("track_id"), F.lit(0).alias("ch"), "idx", (q / F.lit(8388608.0)).alias("x"), q.alias("q"))


def sig_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short tracks of exact 24-bit integers ``q`` with ``x = q / 2**23``."""
    return _lines(spark, sf_dir, "l_suppkey", None)


def sig_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long tracks of the same values."""
    return _lines(spark, sf_dir, "l_returnflag", F.floor(F.col("l_orderkey") / 1024))


def sig_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long track of the same values."""
    rows = _table(spark, sf_dir, "lineitem").select(*LINE_ORDER).withColumn("track", F.lit(0))
    q = F.round(F.col("l_extendedprice") * 100).cast("long") - 5_295_000
    return numbered(rows, ["track"], LINE_ORDER, F.floor(F.col("l_orderkey") / 1024)).select(F.col("track").alias("track_id"), F.lit(0).alias("ch"), "idx", (q / F.lit(8388608.0)).alias("x"), q.alias("q"))


def sig_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tracks scaled so that each touches 1."""
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    top = F.max("value").over(W.partitionBy("user_id"))
    return numbered(rows.withColumn("top", top), ["user_id"], ["ts", "event_id"]).select(F.col("user_id").alias("track_id"), F.lit(0).alias("ch"), "idx", (2 * F.col("value") / F.col("top") - 1).alias("x"))


def frames64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track_id, frame_no, x array<double>)``: embeddings as frames of 64 samples, a track for each label."""
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").alias("track_id"), F.col("vec_id").alias("frame_no"), F.col("embedding").cast("array<double>").alias("x"))


def vec64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, v array<double>)``: embeddings as fingerprints."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def spec_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track_id, k, db)``: levels of short tracks read as spectra, 40 dB lower from a place on that differs by track."""
    s = sig_supp(spark, sf_dir)
    level = F.when(F.abs("x") > 1e-10, 20 * F.log10(F.abs("x"))).otherwise(-200.0)
    low = F.col("idx") >= 300 + F.col("track_id") * 37 % 260
    return s.select("track_id", F.col("idx").alias("k"), (level - F.when(low, 40.0).otherwise(0.0)).alias("db"))


def findings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings derived from orders: a track for each customer, kinds, severities and confidences from the order."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    kinds = ["Mp3Transcode", "AacTranscode", "OpusTranscode", "OggVorbisTranscode", "LossyTranscode", "Upsampled", "BitDepthInflated", "Clipping", "DitheringDetected", "ResamplingDetected"]
    sources = ["cutoff", "cutoff", "cutoff", "cutoff", "mfcc", "shelf", "bit_depth", "clipping", "dither", "resampling"]
    levels = ["critical", "high", "medium", "low", "info"]
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    key = F.col("o_orderkey") % 10
    conf = F.round((F.round(F.col("o_totalprice") * 100).cast("long") % 1000) / 1000, 3)
    return o.select(
        F.col("o_custkey").alias("track_id"), pick(kinds, key).alias("defect_type"), conf.alias("confidence"), pick(levels, F.col("o_orderkey") % 5).alias("severity"), pick(sources, key).alias("detector"),
        (F.lit(64) * (1 + F.col("o_orderkey") % 5)).cast("int").alias("estimated_bitrate"),
    )


def cases_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found labels for each order, from the bits of its key."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    names = ["Mp3Transcode", "Upsampled", "BitDepthMismatch"]
    k = F.col("o_orderkey")
    some = lambda shift: F.array_compact(F.array(*[F.when(F.floor(k / (1 << (shift + i))) % 2 == 1, n) for i, n in enumerate(names)]))
    found = some(3)
    return o.select(
        k.alias("case_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("genre"), (k % 4 == 0).alias("should_pass"), some(0).alias("expected"), found.alias("found"), ((F.size(found) == 0) | (k % 5 == 0)).alias("is_clean")
    )
