"""Queries of file sources: the tracks of ``lineitem`` written as PCM files, scanned, digested, read and reported."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.plans.registry import add
from wavemill.sources import media, pcm
from wavemill.sources.fixtures import sig_flag, sig_supp
from wavemill.sources.folders import shared_folder

RATE = 8000
#: Extensions dealt to the tracks; the third is no media file.
NAMES = ["wav", "FLAC", "txt", "dsf"]


def _little(value, width: int):
    """Hex digits of an integer, lowest byte first."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255))), 2, "0") for i in range(width)])


def files(s, d):
    """``(name, content)``: a track of 16-bit samples for each supplier as an uncompressed file, every fifth of them broken."""
    x = sig_supp(s, d).select("track_id", "idx", _little(F.shiftright("q", 9), 2).alias("h"))
    t = x.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("s"), F.count(F.lit(1)).alias("n"))
    size = (F.col("n") * 2).cast("int")
    head = F.concat(F.lit("52494646"), _little(size + 36, 4), F.lit("57415645666d742010000000" "01000100" + RATE.to_bytes(4, "little").hex() + (2 * RATE).to_bytes(4, "little").hex() + "0200" "1000" "64617461"), _little(size, 4))
    whole = F.unhex(F.concat(head, F.array_join(F.transform("s", lambda e: e["h"]), "")))
    broken = F.lit("RIFFnothing").cast("binary")
    ext = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("track_id") % len(NAMES) + 1).cast("int"))
    name = F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("."), ext)
    return t.select(name.alias("name"), F.when(F.col("track_id") % 5 == 0, broken).otherwise(whole).alias("content"))


def scanned(s, d):
    folder = shared_folder(s, "media")
    media.write_media(files(s, d), folder).agg(F.sum("length")).collect()
    return media.scan_media(s, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))


HEX = "printf('%02x%02x', v & 255, (v >> 8) & 255)"
LITTLE = "printf('%02x%02x%02x%02x', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"
FILES = f"""tr AS (SELECT track_id, count(*)::BIGINT AS n, string_agg({HEX}, '' ORDER BY idx) AS body FROM (SELECT track_id, idx, ((q >> 9) & 65535)::BIGINT AS v FROM supp) GROUP BY ALL),
fl AS (SELECT track_id, n, ['wav', 'FLAC', 'txt', 'dsf'][(track_id % 4 + 1)::INT] AS e, track_id % 5 = 0 AS broken, CASE WHEN track_id % 5 = 0 THEN 'RIFFnothing'::BLOB
ELSE unhex('52494646' || {LITTLE.format("(2 * n + 36)")} || '57415645666d742010000000' || '01000100' || '{RATE.to_bytes(4, "little").hex()}{(2 * RATE).to_bytes(4, "little").hex()}' || '02001000' || '64617461' || {LITTLE.format("(2 * n)")} || body) END AS content FROM tr),
md AS (SELECT *, 'track_' || track_id || '.' || e AS name, lower(e) AS ext FROM fl WHERE e <> 'txt')"""
add("scan_media", lambda s, d: scanned(s, d).select("name", "ext", "length"), f"WITH {FILES} SELECT name, ext, octet_length(content)::BIGINT AS length FROM md", "supp")
add("with_digest", lambda s, d: media.with_digest(scanned(s, d)).select("name", "md5"), f"WITH {FILES} SELECT name, md5(content) AS md5 FROM md", "supp")
add("with_claimed_bits", lambda s, d: media.with_claimed_bits(scanned(s, d)).select("name", "claimed_bits", "bit_depth_inferred"), f"WITH {FILES} SELECT name, CASE WHEN ext = 'dsf' THEN 16 ELSE 24 END AS claimed_bits, true AS bit_depth_inferred FROM md", "supp")


def sample_rows(blocks):
    return blocks.select(F.col("track_id").alias("name"), "ch", "block_no", "rate", "channels", "bits", F.posexplode("x").alias("place", "x"))


def ingested(s, d):
    """Short files, some of them broken, several to a task."""
    folder = shared_folder(s, "media")
    media.write_media(files(s, d), folder).agg(F.sum("length")).collect()
    b = pcm.read_pcm_files(s, folder, block=256).where("error is null")
    return sample_rows(b)


#: Samples of a piece of a long file.
PIECE = 4096


def long_pieces(s, d):
    """``(name, place, content)``: a file of 24-bit samples for each of the long tracks, its header and then pieces of its samples."""
    x = sig_flag(s, d).select("track_id", "idx", "q")
    name = F.concat(F.lit("long_"), "track_id", F.lit(".wav")).alias("name")
    size = F.col("n") * 3
    form = "57415645666d742010000000" "01000100" + RATE.to_bytes(4, "little").hex() + (3 * RATE).to_bytes(4, "little").hex() + "0300" "1800" "64617461"
    head = F.unhex(F.concat(F.lit("52494646"), _little(size + 36, 4), F.lit(form), _little(size, 4)))
    heads = x.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).select(name, F.lit(-1).cast("long").alias("place"), head.alias("content"))
    held = F.array_sort(F.collect_list(F.struct("idx", _little(F.col("q"), 3).alias("h"))))
    pieces = x.groupBy("track_id", F.floor(F.col("idx") / PIECE).alias("place")).agg(held.alias("s"))
    return heads.unionByName(pieces.select(name, "place", F.unhex(F.array_join(F.transform("s", lambda e: e["h"]), "")).alias("content")))


def ingested_by_ranges(s, d):
    """Long files in ranges of an odd number of bytes, so that borders lie inside frames; many ranges to a task."""
    folder = shared_folder(s, "media")
    media.write_pieces(long_pieces(s, d), folder).agg(F.sum("length")).collect()
    b = media.ingest_pcm(media.scan_media(s, folder), block=1000, range_bytes=10_007).where("error is null")
    return sample_rows(b)


add(
    "ingest_pcm",
    ingested,
    f"WITH {FILES} SELECT name, 0 AS ch, idx // 256 AS block_no, {RATE} AS rate, 1 AS channels, 16 AS bits, (idx % 256)::INT AS place, round((q >> 9) / 32768::DOUBLE, 6) AS x FROM supp JOIN md USING (track_id) WHERE NOT broken",
    "supp",
)
add(
    "ingest_pcm_ranges",
    ingested_by_ranges,
    f"SELECT 'long_' || track_id || '.wav' AS name, 0 AS ch, idx // 1000 AS block_no, {RATE} AS rate, 1 AS channels, 24 AS bits, (idx % 1000)::INT AS place, round(x, 6) AS x FROM flag",
    "flag",
)
add(
    "keep_errors",
    lambda s, d: media.keep_errors(media.ingest_pcm(scanned(s, d))).select(F.element_at(F.split("path", "/"), -1).alias("name"), "error"),
    f"WITH {FILES} SELECT name, 'not a RIFF WAVE file' AS error FROM md WHERE broken",
    "supp",
)


def manifests(s, d):
    """Manifests of all suppliers saved and loaded again, a row for each of their tests."""
    p = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    dither = F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: F.struct(F.concat(F.lit("d"), i.cast("string")).alias("filename"), F.lit("tpdf").alias("method"), (i / 4).alias("scale"), F.lit(16).alias("output_bits"), F.lit("DitheringDetected").alias("expected_detection")))
    rate = F.array(F.struct(F.lit("r").alias("filename"), F.lit(44100).alias("original_rate"), (k * 10).cast("int").alias("target_rate"), F.lit("soxr").alias("engine"), F.when(k % 2 == 0, "ResamplingDetected").alias("expected_detection")))
    path = shared_folder(s, "manifest")
    media.save_manifest(p.select(F.col("s_name").alias("source_file"), F.lit(44100).alias("source_sample_rate"), F.lit(24).alias("source_bit_depth"), dither.alias("dithering_tests"), rate.alias("resampling_tests")), path)
    m = media.load_manifest(s, path)
    base = ["source_file", "source_sample_rate", "source_bit_depth"]
    one = m.select(*base, F.explode("dithering_tests").alias("t")).select(*base, "t.filename", F.col("t.scale").alias("scale"), F.col("t.output_bits").alias("value"), "t.expected_detection")
    two = m.select(*base, F.explode("resampling_tests").alias("t")).select(*base, "t.filename", F.lit(0.0).alias("scale"), F.col("t.target_rate").alias("value"), "t.expected_detection")
    return one.unionByName(two)


add(
    "manifest_round_trip",
    manifests,
    """SELECT s_name AS source_file, 44100 AS source_sample_rate, 24 AS source_bit_depth, 'd' || i AS filename, i / 4 AS scale, 16 AS value, 'DitheringDetected' AS expected_detection FROM supplier, range(1, 4) t(i) WHERE i <= s_suppkey % 3 + 1
UNION ALL SELECT s_name, 44100, 24, 'r', 0, (s_suppkey * 10)::INT, CASE WHEN s_suppkey % 2 = 0 THEN 'ResamplingDetected' END FROM supplier""",
)
