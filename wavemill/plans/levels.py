"""Queries of levels, dynamic range and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions import scalar
from wavemill.functions.windows import window_table
from wavemill.operators import levels, ordered
from wavemill.plans.registry import add
from wavemill.sources.fixtures import sig_flag, sig_supp, sig_user

DB = "CASE WHEN {0} > 0 THEN 20 * log10({0}) ELSE -120 END"
LEVELS = f"""lv AS (SELECT track_id, ch, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM {{0}} GROUP BY ALL),
lvl AS (SELECT *, {DB.format("peak")} AS peak_dbfs, {DB.format("rms")} AS rms_dbfs FROM lv)"""

add(
    "level_stats",
    lambda s, d: levels.level_stats(sig_supp(s, d)),
    f"WITH {LEVELS.format('supp')} SELECT track_id, ch, round(peak, 6) AS peak, round(rms, 6) AS rms, round(peak_dbfs, 6) AS peak_dbfs, round(rms_dbfs, 6) AS rms_dbfs, round(peak_dbfs - rms_dbfs, 6) AS crest_db FROM lvl",
    "supp",
)


def tt_dr_sql(view: str, block: int, gate: str) -> str:
    return f"""blk AS (SELECT track_id, ch, idx // {block} AS b, max(abs(x)) AS peak, sqrt(sum(x * x) / count(*)) AS rms, count(*) AS n, sum(count(*)) OVER (PARTITION BY track_id, ch) AS total FROM {view} GROUP BY track_id, ch, idx // {block}),
ful AS (SELECT *, rms > {gate} AS loud, count(*) OVER (PARTITION BY track_id, ch) AS blocks FROM blk WHERE total >= {block} AND n = {block}),
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id, ch, loud ORDER BY rms DESC, b) AS k, sum(loud::INT) OVER (PARTITION BY track_id, ch) AS m FROM ful),
agg AS (SELECT track_id, ch, avg(peak) FILTER (loud AND k <= greatest(1, ceil(m * 0.2))) AS p, avg(rms) FILTER (loud AND k <= greatest(1, ceil(m * 0.2))) AS r, max(blocks)::BIGINT AS blocks FROM rk GROUP BY ALL),
dr AS (SELECT track_id, ch, CASE WHEN p IS NULL THEN 0 ELSE {DB.format("p")} - ({DB.format("r")}) END AS dr_db, blocks FROM agg
UNION ALL SELECT track_id, ch, {DB.format("peak")} - ({DB.format("rms")}), 1::BIGINT FROM blk WHERE total < {block})"""


add("tt_dr", lambda s, d: levels.tt_dr(sig_supp(s, d), 50), f"WITH {tt_dr_sql('supp', 50, '1e-3')} SELECT track_id, ch, round(dr_db, 6) AS dr_db, blocks FROM dr", "supp")
add("tt_dr_long", lambda s, d: levels.tt_dr(sig_flag(s, d), 500), f"WITH {tt_dr_sql('flag', 500, '1e-3')} SELECT track_id, ch, round(dr_db, 6) AS dr_db, blocks FROM dr", "flag")

LOUD = """hop AS (SELECT track_id, ch, idx // 20 AS h, sum(x * x) AS ss, count(*) AS n FROM supp GROUP BY ALL),
sl AS (SELECT *, CASE WHEN sum(n) OVER w = 80 THEN sum(ss) OVER w / 80 END AS p FROM hop WINDOW w AS (PARTITION BY track_id, ch ORDER BY h ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
lo AS (SELECT *, CASE WHEN p > pow(10, (-70 + 0.691) / 10) THEN p END AS loud FROM sl),
gt AS (SELECT *, avg(loud) OVER (PARTITION BY track_id, ch) AS mean FROM lo),
ld AS (SELECT track_id, ch, avg(loud) FILTER (loud > mean * 0.1) AS g, count(p) AS k, sqrt(sum(ss) / sum(n)) AS rms FROM gt GROUP BY ALL),
loudness AS (SELECT track_id, ch, CASE WHEN k = 0 THEN CASE WHEN rms > 0 THEN -0.691 + 20 * log10(rms) ELSE -70 END WHEN g IS NULL THEN -70 ELSE -0.691 + 10 * log10(g) END AS lufs FROM ld)"""
add("integrated_loudness", lambda s, d: levels.integrated_loudness(sig_supp(s, d), 20), f"WITH {LOUD} SELECT track_id, ch, round(lufs, 6) AS lufs FROM loudness", "supp")


def verdicts(s, d):
    x = sig_supp(s, d)
    return levels.dr_verdict(levels.level_stats(x), levels.tt_dr(x, 50), levels.integrated_loudness(x, 20))


add(
    "dr_verdict",
    verdicts,
    f"""WITH {LEVELS.format("supp")}, {tt_dr_sql("supp", 50, "1e-3")}, {LOUD},
a AS (SELECT lvl.track_id, max(peak_dbfs) AS peak, avg(dr_db) AS dr, avg(lufs) AS lufs, avg(peak_dbfs - rms_dbfs) AS crest FROM lvl JOIN dr USING (track_id, ch) JOIN loudness USING (track_id, ch) GROUP BY ALL)
SELECT track_id, round(dr, 6) AS dr, round(lufs, 6) AS lufs, round(crest, 6) AS crest_db, round(peak - lufs, 6) AS plr_db,
CASE WHEN dr > 20 THEN 'Exceptional' WHEN dr >= 14 THEN 'Excellent' WHEN dr >= 8 THEN 'Normal' WHEN dr >= 5 THEN 'Compressed' ELSE 'Brickwalled' END AS verdict, dr < 8 AS loudness_war_victim FROM a""",
    "supp",
)
add(
    "quality_metrics",
    lambda s, d: levels.quality_metrics(sig_supp(s, d)),
    """WITH m AS (SELECT track_id, abs(x) AS a, row_number() OVER (PARTITION BY track_id ORDER BY abs(x)) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM supp),
b AS (SELECT track_id, max(a) AS p, sqrt(avg(a * a)) AS rms, max(a) FILTER (r = n // 100) AS low FROM m GROUP BY ALL)
SELECT track_id, round(20 * log10(p) - 20 * log10(rms) + 3, 6) AS dynamic_range, round(CASE WHEN low > 0 THEN 20 * log10(low) ELSE -96 END, 6) AS noise_floor, 0.0::DOUBLE AS spectral_centroid,
round(20 * log10(p / rms), 6) AS crest_factor, round(20 * log10(p), 6) AS true_peak, round(20 * log10(rms), 6) AS lufs_integrated FROM b""",
    "supp",
)
add(
    "quality_metrics_sketch",
    lambda s, d: levels.quality_metrics(sig_supp(s, d), exact=False).select("track_id", "noise_floor", "true_peak"),
    # Tracks shorter than the sketch's accuracy are read off exactly, at the first rank that covers one percent.
    """WITH m AS (SELECT track_id, abs(x) AS a, row_number() OVER (PARTITION BY track_id ORDER BY abs(x)) AS r, count(*) OVER (PARTITION BY track_id) AS n FROM supp)
SELECT track_id, round(20 * log10(max(a) FILTER (r = ceil(n / 100))), 6) AS noise_floor, round(20 * log10(max(a)), 6) AS true_peak FROM m GROUP BY ALL""",
    "supp",
)
add("zero_crossing_rate", lambda s, d: ordered.zero_crossing_rate(sig_flag(s, d)), """WITH p AS (SELECT *, lag(x) OVER (PARTITION BY track_id, ch ORDER BY idx) AS y FROM flag)
SELECT track_id, ch, round(avg(((x >= 0) <> (y >= 0))::INT) FILTER (y IS NOT NULL), 6) AS zcr FROM p GROUP BY ALL""", "flag")


def stereo(s, d):
    x = sig_supp(s, d)
    return x.select((F.floor(F.col("track_id") / 2)).alias("track_id"), (F.col("track_id") % 2).cast("int").alias("ch"), "idx", "x")


STEREO = "st AS (SELECT track_id // 2 AS track_id, (track_id % 2)::INT AS ch, idx, x FROM supp), pr AS (SELECT track_id, idx, max(x) FILTER (ch = 0) AS l, max(x) FILTER (ch = 1) AS r FROM st GROUP BY ALL)"
add("to_mono", lambda s, d: levels.to_mono(stereo(s, d)), f"WITH {STEREO} SELECT track_id, 0 AS ch, idx, round(avg(x), 6) AS x FROM st GROUP BY ALL", "supp")
add("mid_side", lambda s, d: levels.mid_side(stereo(s, d)), f"WITH {STEREO} SELECT track_id, idx, round((l + r) / 2, 6) AS mid, round((l - r) / 2, 6) AS side FROM pr", "supp")
add("deinterleave", lambda s, d: levels.deinterleave(sig_supp(s, d).select("track_id", F.col("idx").alias("g"), "x"), 2), "SELECT track_id, (idx % 2)::INT AS ch, idx // 2 AS idx, round(x, 6) AS x FROM supp", "supp")
add(
    "stereo_stats",
    lambda s, d: levels.stereo_stats(stereo(s, d)),
    f"""WITH {STEREO}, a AS (SELECT track_id, covar_pop(l, r) AS c, var_pop(l) AS vl, var_pop(r) AS vr, sum(pow((l + r) / 2, 2)) AS me, sum(pow((l - r) / 2, 2)) AS se FROM pr WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY ALL),
b AS (SELECT track_id, CASE WHEN vl <= 1e-10 OR vr <= 1e-10 THEN 1 ELSE c / sqrt(vl * vr) END AS correlation, CASE WHEN me > 1e-10 THEN se / me ELSE 0 END AS ratio FROM a)
SELECT track_id, round(correlation, 6) AS correlation, round(sqrt(greatest(0, 1 - abs(correlation))), 6) AS width, round(ratio, 6) AS side_mid_ratio, correlation > 0.95 AND ratio < 0.1 AS joint_stereo,
CASE WHEN correlation > 0.95 AND ratio < 0.1 THEN 0.7 ELSE 0 END::DOUBLE AS confidence FROM b""",
    "supp",
)
add("median", lambda s, d: levels.median(sig_supp(s, d), ["track_id"], "x"), "SELECT track_id, round(quantile_cont(x, 0.5), 6) AS median FROM supp GROUP BY ALL", "supp")


def results(s, d):
    x = s.read.parquet(f"{d}/orders.parquet")
    return x.select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("genre"), F.when(F.col("o_orderkey") % 17 == 0, "bad file").alias("error"), (F.col("o_orderkey") % 3 == 0).alias("genuine"))


add(
    "corpus_summary",
    lambda s, d: levels.corpus_summary(results(s, d), ("genre", "category")),
    """WITH r AS (SELECT o_orderpriority AS category, o_orderstatus AS genre, o_orderkey % 17 = 0 AS bad, o_orderkey % 3 = 0 AS g FROM orders)
SELECT genre, category, count(*) FILTER (NOT bad) AS analyzed, count(*) FILTER (NOT bad AND g) AS genuine, count(*) FILTER (NOT bad AND NOT g) AS suspect, count(*) FILTER (bad) AS errors FROM r GROUP BY ROLLUP (genre, category)""",
)


def scalars(s, d):
    x = sig_supp(s, d)
    c, hz = F.abs("x"), F.abs(F.col("q")) % 24000
    return x.select(
        "track_id", "idx", scalar.amp_db(c).alias("amp_db"), scalar.db_amp(scalar.amp_db(c)).alias("db_amp"), scalar.dbfs(F.col("x")).alias("dbfs"), scalar.lufs_from_power(c).alias("lufs_p"), scalar.lufs_from_rms(c).alias("lufs_r"),
        scalar.hz_to_mel(hz).alias("mel"), scalar.mel_to_hz(scalar.hz_to_mel(hz)).alias("hz"), scalar.quantize(F.col("x"), 16, "dither").alias("q_dither"), scalar.quantize(F.col("x"), 16, "inflate").alias("q_inflate"),
        scalar.quantize(F.col("x"), 16, "mqa").alias("q_mqa"), scalar.quantize(F.col("x"), 24, "fixed24").alias("q_fixed"), scalar.format_rate((hz + 1) * 100).alias("rate"),
    )


add(
    "scalar_functions",
    scalars,
    """WITH s AS (SELECT track_id, idx, x, abs(x) AS c, abs(q) % 24000 AS hz FROM supp), m AS (SELECT *, CASE WHEN c > 1e-10 THEN 20 * log10(c) ELSE -200 END AS a, 2595 * log10(1 + hz / 700) AS mel, (hz + 1) * 100 AS rt FROM s)
SELECT track_id, idx, round(a, 6) AS amp_db, round(pow(10, a / 20), 6) AS db_amp, round(CASE WHEN x > 0 THEN 20 * log10(x) ELSE -120 END, 6) AS dbfs, round(CASE WHEN c > 0 THEN -0.691 + 10 * log10(c) ELSE -70 END, 6) AS lufs_p,
round(CASE WHEN c > 0 THEN -0.691 + 20 * log10(c) ELSE -70 END, 6) AS lufs_r, round(mel, 6) AS mel, round(700 * (pow(10, mel / 2595) - 1), 6) AS hz, round(x * 32767)::INT AS q_dither, greatest(least(round(x * 32768), 32767), -32768)::INT AS q_inflate,
trunc(greatest(least(x, 1), -1) * 32767)::INT AS q_mqa, round(x * 8388607)::INT AS q_fixed, CASE WHEN rt % 1000 = 0 THEN (rt // 1000) || ' kHz' ELSE printf('%.1f kHz', rt / 1000) END AS rate FROM m""",
    "supp",
)


def windowed(s, d):
    x = sig_supp(s, d)
    w = window_table(s, "blackman_harris", 64).withColumnsRenamed({"n": "i"})
    k = window_table(s, "kaiser", 64, True, 8.6).withColumnsRenamed({"n": "i", "w": "kw"})
    return x.join(F.broadcast(w.join(k, "i")), F.col("idx") % 64 == F.col("i")).groupBy("track_id").agg(F.sum(F.col("x") * F.col("w")).alias("bh"), F.sum(F.col("x") * F.col("kw")).alias("kaiser"))


add(
    "window_table",
    windowed,
    """WITH i0 AS (SELECT r::DOUBLE AS z, i FROM (SELECT i, 8.6 * sqrt(greatest(0, 1 - pow(2 * i / 63 - 1, 2))) AS r FROM range(64) t(i))),
fact AS (SELECT k, exp(list_sum(list_transform(range(1, k + 1), lambda v: ln(v)))) AS f FROM range(1, 50) t(k)),
bes AS (SELECT i, 1 + sum(pow(pow(z / 2, k) / f, 2)) AS b FROM i0, fact GROUP BY ALL), bb AS (SELECT 1 + sum(pow(pow(4.3, k) / f, 2)) AS b FROM fact),
w AS (SELECT t.i, 0.35875 - 0.48829 * cos(2 * pi() * t.i / 63) + 0.14128 * cos(4 * pi() * t.i / 63) - 0.01168 * cos(6 * pi() * t.i / 63) AS w, bes.b / bb.b AS kw FROM range(64) t(i) JOIN bes ON bes.i = t.i, bb)
SELECT track_id, round(sum(x * w), 6) AS bh, round(sum(x * kw), 6) AS kaiser FROM supp JOIN w ON idx % 64 = i GROUP BY ALL""",
    "supp",
)
