"""Queries of spectra, cutoffs, resampling traces, cepstra, similarity and hum."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wavemill.operators import cepstra, hum, ordered, spectra
from wavemill.plans.registry import add
from wavemill.sources.fixtures import FRAME_RATE, frames64, sig_flag, sig_supp, sig_whole, spec_supp, vec64

T = "track_id"
FR = "track_id, frame_no"


def mags(s, d):
    return spectra.dft(frames64(s, d), 64)


add("fft_magnitude", mags, f"SELECT {FR}, k, round(mag, 6) AS mag FROM spectra", "spectra")
add("fft_magnitude_batched", lambda s, d: spectra.fft_magnitude(frames64(s, d), 64, "rect", method="fft"), f"SELECT {FR}, k, round(mag, 6) AS mag FROM spectra", "spectra")
add(
    "median_power_db",
    lambda s, d: spectra.median_power_db(mags(s, d), 64),
    """WITH p AS (SELECT track_id, k, pow(mag / 64, 2) AS p, row_number() OVER (PARTITION BY track_id, k ORDER BY mag) - 1 AS r, count(*) OVER (PARTITION BY track_id, k) AS n FROM spectra)
SELECT track_id, k, round(CASE WHEN p > 1e-20 THEN 10 * log10(p) ELSE -200 END, 6) AS db FROM p WHERE r = n // 2""",
    "spectra",
)
add("spectrogram", lambda s, d: spectra.spectrogram(mags(s, d), 64), f"SELECT {FR}, k, round(CASE WHEN mag > 1e-10 THEN 20 * log10(mag / 64) ELSE -200 END, 6) AS db FROM spectra", "spectra")
add(
    "averaged_spectrum_db",
    lambda s, d: spectra.averaged_spectrum_db(mags(s, d)),
    "WITH m AS (SELECT track_id, k, 20 * log10(avg(mag)) AS d FROM spectra GROUP BY ALL) SELECT track_id, k, round(avg(d) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS db FROM m",
    "spectra",
)
add("spectral_centroid", lambda s, d: spectra.spectral_centroid(mags(s, d), FRAME_RATE), f"""WITH a AS (SELECT {FR}, sum(mag) AS m, sum(k * 8000 / 33 * mag) AS f, sum(pow(k * 8000 / 33, 2) * mag) AS g FROM spectra GROUP BY ALL)
SELECT {FR}, round(f / m, 4) AS centroid, round(sqrt(greatest(0, g / m - pow(f / m, 2))), 4) AS spread FROM a""", "spectra", digits=4)
add("spectral_flatness", lambda s, d: spectra.spectral_flatness(mags(s, d)), f"SELECT {FR}, round(exp(avg(ln(mag + 1e-10))) / avg(mag), 6) AS flatness FROM spectra GROUP BY ALL", "spectra")
add(
    "spectral_rolloff",
    lambda s, d: spectra.spectral_rolloff(mags(s, d), FRAME_RATE),
    f"""WITH c AS (SELECT {FR}, k, sum(mag * mag) OVER (PARTITION BY {FR} ORDER BY k) AS cum, sum(mag * mag) OVER (PARTITION BY {FR}) AS al FROM spectra)
SELECT {FR}, round(min(k) FILTER (cum >= al * 0.85) * 8000 / 33, 4) AS rolloff_hz FROM c GROUP BY ALL""",
    "spectra",
    digits=4,
)
add("spectral_flux", lambda s, d: spectra.spectral_flux(mags(s, d)), f"""WITH p AS (SELECT *, mag - lag(mag) OVER (PARTITION BY track_id, k ORDER BY frame_no) AS d FROM spectra)
SELECT {FR}, round(sqrt(sum(CASE WHEN d > 0 THEN d * d ELSE 0 END)), 6) AS flux FROM p WHERE d IS NOT NULL GROUP BY ALL""", "spectra")
add(
    "spectral_contrast",
    lambda s, d: spectra.spectral_contrast(mags(s, d), 3),
    f"""WITH b AS (SELECT *, k // 11 AS band, row_number() OVER (PARTITION BY {FR}, k // 11 ORDER BY mag) - 1 AS r FROM spectra), a AS (SELECT {FR}, band, avg(mag) FILTER (r >= 8) AS p, avg(mag) FILTER (r < 2) AS v FROM b GROUP BY ALL)
SELECT {FR}, band, round(CASE WHEN v > 1e-10 THEN 20 * log10(p) - 20 * log10(v) ELSE 20 * log10(p) + 60 END, 6) AS contrast FROM a""",
    "spectra",
)
add("hf_noise_level", lambda s, d: spectra.hf_noise_level(mags(s, d), FRAME_RATE, 64, 6000.0), f"SELECT {FR}, round(20 * log10(sqrt(avg(mag * mag) FILTER (k >= 24 AND k < 32))), 6) AS level_db FROM spectra GROUP BY ALL", "spectra")
add("noise_floor_elevation", lambda s, d: spectra.noise_floor_elevation(mags(s, d), FRAME_RATE, 64, (2000, 4000), (6000, 7000)), f"SELECT {FR}, round(20 * log10(avg(mag) FILTER (k >= 24 AND k < 28) / avg(mag) FILTER (k >= 8 AND k < 16)), 6) AS elevation_db FROM spectra GROUP BY ALL", "spectra")
add(
    "spectral_folding",
    lambda s, d: spectra.spectral_folding(mags(s, d), 64, reach=6, margin=7),
    f"""WITH f AS (SELECT a.track_id, a.frame_no, fold, count(*) FILTER (a.mag > 1e-10 AND b.mag > 1e-10 AND abs(log10(a.mag / b.mag)) < 0.5) / 6 AS s
FROM (VALUES (16), (21)) t(fold), range(1, 6) u(o), spectra a, spectra b WHERE a.k = fold - o AND b.k = fold + o AND a.track_id = b.track_id AND a.frame_no = b.frame_no GROUP BY ALL) SELECT {FR}, round(max(s), 6) AS score FROM f GROUP BY ALL""",
    "spectra",
)
add(
    "band_flatness",
    lambda s, d: spectra.band_flatness(mags(s, d), 12, 28),
    """WITH f AS (SELECT track_id, frame_no, exp(avg(ln(mag * mag + 1e-30))) AS g, avg(mag * mag + 1e-30) AS a FROM spectra WHERE k BETWEEN 12 AND 28 GROUP BY ALL)
SELECT track_id, round(avg(g / a), 6) AS flatness, round(10 * log10(avg(a)), 6) AS band_db, count(*) AS frames FROM f WHERE a > 1e-15 GROUP BY ALL""",
    "spectra",
)
add(
    "sfm_finding",
    lambda s, d: spectra.sfm_finding(mags(s, d), 12, 28),
    """WITH f AS (SELECT track_id, exp(avg(ln(mag * mag + 1e-30))) AS g, avg(mag * mag + 1e-30) AS a FROM spectra WHERE k BETWEEN 12 AND 28 GROUP BY track_id, frame_no), b AS (SELECT track_id, avg(g / a) AS fl, 10 * log10(avg(a)) AS db, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT *, least(0.95, greatest(0.3, (fl - 0.35) / 0.35)) AS conf FROM b WHERE n >= 10 AND db >= -75 AND fl > 0.35) SELECT track_id, round(fl, 6) AS flatness, round(db, 6) AS band_db, round(conf, 6) AS confidence, CASE WHEN conf > 0.7 THEN 'high' ELSE 'medium' END AS severity FROM c""",
    "spectra",
)

# Spectra of some five to seven hundred bins.
RATE, SIZE = 44_100, 1024
RES = f"({RATE} / {SIZE}::DOUBLE)"
HALF = RATE / 2


def first(hz: float) -> str:
    return f"ceil({hz} / {RES})"


CUT = f"""cp AS (SELECT *, max(db) FILTER (k >= ceil(2000 / {RES}) AND k < floor(8000 / {RES})) OVER (PARTITION BY track_id) AS ref FROM spec),
cb AS (SELECT *, (db < ref - 25)::INT AS below FROM cp), cw AS (SELECT *, sum(below) OVER w AS c, min(k) FILTER (below = 1) OVER w AS f FROM cb WINDOW w AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
ch AS (SELECT track_id, max(bins) AS bins, max(ref) AS ref, arg_min(CASE WHEN k = bins - 40 THEN k ELSE f END, k) FILTER (k >= {first(10000)} AND k <= bins - 40 AND c >= 32) AS bin FROM cw GROUP BY ALL),
cut AS (SELECT track_id, CASE WHEN bins >= 100 AND ref >= -80 AND {first(10000)} + 40 < bins AND bin * {RES} < {HALF * 0.95} THEN bin * {RES} END AS cutoff_hz FROM ch)"""
add("detect_cutoff", lambda s, d: spectra.detect_cutoff(spec_supp(s, d), RATE, SIZE), f"WITH {CUT} SELECT track_id, round(cutoff_hz, 4) AS cutoff_hz FROM cut", "spec", digits=4)


def roll(src: str, out: str) -> str:
    return f"""{out}j AS (SELECT s.track_id, s.k, s.db, s.bins, c.bin, least(ceil(c.bin * {RES} * 1.414 / {RES}), s.bins - 1) AS up FROM spec s JOIN {src} c USING (track_id)),
{out} AS (SELECT track_id, CASE WHEN max(bin) >= max(bins) - 20 OR max(bin) < 20 OR max(up) <= max(bin) THEN 0 ELSE greatest(0, 2 * (max(db) FILTER (k = bin) - max(db) FILTER (k = up))) END AS rolloff FROM {out}j GROUP BY ALL)"""


REF = f"rf AS (SELECT *, max(db) FILTER (k >= {first(2000)} AND k < {first(8000)}) OVER (PARTITION BY track_id) AS ref FROM spec)"
DROP = f"""{REF}, dc AS (SELECT *, sum((db < ref - 25)::INT) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS c FROM rf),
da AS (SELECT track_id, max(bins) AS bins, min(k) FILTER (c = 30 AND k >= {first(10000)} + 29) - 29 AS bin, arg_min(ref - db, k) FILTER (c = 30 AND k >= {first(10000)} + 29) AS dp FROM dc GROUP BY ALL), dk AS (SELECT * FROM da WHERE bin IS NOT NULL), {roll("dk", "dr")},
m1 AS (SELECT da.track_id, CASE WHEN bin IS NOT NULL THEN bin * {RES} ELSE {HALF} END AS cutoff_hz, CASE WHEN bin IS NOT NULL THEN rolloff ELSE 0 END AS rolloff, CASE WHEN bin IS NOT NULL THEN least(0.95, greatest(0.4, dp / 40)) ELSE 0.3 END AS conf FROM da LEFT JOIN dr USING (track_id))"""
DERIV = f"""ds AS (SELECT *, (lead(db, 10) OVER w - lag(db, 10) OVER w) / (20 * {RES}) AS sl FROM spec WINDOW w AS (PARTITION BY track_id ORDER BY k)),
dm AS (SELECT track_id, min(struct_pack(s := sl, k := k)) FILTER (k >= {first(10000)} + 10 AND k < bins - 10) AS m FROM ds GROUP BY ALL),
m2 AS (SELECT track_id, CASE WHEN m.s < -0.003 THEN m.k * {RES} ELSE {HALF} END AS cutoff_hz, CASE WHEN m.s < -0.003 THEN least(-m.s * 6000, 200) ELSE 0 END AS rolloff, CASE WHEN m.s < -0.003 THEN least(0.85, greatest(0.3, -m.s * 200)) ELSE 0.2 END AS conf FROM dm)"""
FLOOR = f"""nt AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY db) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM spec WHERE k >= bins * 9 // 10), nf AS (SELECT track_id, db AS floor FROM nt WHERE r = n // 5),
nr AS (SELECT *, max(db) FILTER (k >= {first(2000)} AND k < {first(8000)}) OVER (PARTITION BY track_id) AS ref FROM spec), na AS (SELECT track_id, max(bins) AS bins, max(ref) AS ref, max(floor) AS floor, coalesce(max(k) FILTER (k >= {first(10000)} AND db > floor + 15), max(bins) - 1) AS bin FROM nr JOIN nf USING (track_id) GROUP BY ALL), {roll("na", "ro")},
m3 AS (SELECT track_id, CASE WHEN bin * {RES} > {HALF * 0.95} THEN {HALF} ELSE bin * {RES} END AS cutoff_hz, CASE WHEN bin * {RES} > {HALF * 0.95} THEN 0 ELSE rolloff END AS rolloff, CASE WHEN bin * {RES} > {HALF * 0.95} THEN 0.25 ELSE least(0.8, greatest(0.3, (ref - floor) / 50)) END AS conf FROM na JOIN ro USING (track_id))"""
OUT = "SELECT track_id, round(cutoff_hz, 4) AS cutoff_hz, round(rolloff, 4) AS rolloff, round(conf, 4) AS conf FROM "
add("cutoff_energy_drop", lambda s, d: spectra.cutoff_energy_drop(spec_supp(s, d), RATE, SIZE), f"WITH {DROP} {OUT} m1", "spec", digits=4)
add("cutoff_derivative", lambda s, d: spectra.cutoff_derivative(spec_supp(s, d), RATE, SIZE), f"WITH {DERIV} {OUT} m2", "spec", digits=4)
add("cutoff_noise_floor", lambda s, d: spectra.cutoff_noise_floor(spec_supp(s, d), RATE, SIZE), f"WITH {FLOOR} {OUT} m3", "spec", digits=4)
add(
    "rolloff_steepness",
    lambda s, d: spectra.rolloff_steepness(spec_supp(s, d), spec_supp(s, d).groupBy("track_id").agg((F.col("track_id") % 400).alias("bin")), RATE, SIZE),
    f"WITH bn AS (SELECT track_id, track_id % 400 AS bin FROM spec GROUP BY ALL), {roll('bn', 'ro')} SELECT track_id, round(rolloff, 4) AS rolloff FROM ro",
    "spec",
    digits=4,
)


def multi(s, d):
    return spectra.cutoff_multimethod(spectra.cutoff_methods(spec_supp(s, d), RATE, SIZE), RATE)


MULTI = f"""{DROP}, {DERIV}, {FLOOR}, al AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
ml AS (SELECT track_id, max(cutoff_hz) - min(cutoff_hz) AS sp, sum(conf) AS w, sum(cutoff_hz * conf) AS wc, sum(rolloff * conf) AS wr, arg_max(struct_pack(c := cutoff_hz, r := rolloff, f := conf), struct_pack(f := conf, c := cutoff_hz)) AS b FROM al GROUP BY ALL),
mm AS (SELECT track_id, CASE WHEN sp < {HALF * 0.08} THEN wc / w ELSE b.c END AS cutoff_hz, CASE WHEN sp < {HALF * 0.08} THEN wr / w ELSE b.r END AS rolloff, CASE WHEN sp < {HALF * 0.08} THEN least(0.95, w / 3) ELSE b.f * 0.7 END AS conf FROM ml)"""
add("cutoff_multimethod", multi, f"WITH {MULTI} {OUT} mm", "spec", digits=4)
ROWS = ", ".join(f"({i}, '{c}', {b}, {t}, {w})" for i, (c, b, t, w) in enumerate(spectra.CODECS))
add(
    "match_codec",
    lambda s, d: spectra.match_codec(multi(s, d)),
    f"""WITH {MULTI}, sg(o, codec, bitrate, typ, tol) AS (VALUES {ROWS}), sc AS (SELECT track_id, codec, bitrate, o, 0.7 * (1 - abs(cutoff_hz - typ) / tol) + 0.3 * least(1, rolloff / 60) AS score FROM mm, sg WHERE cutoff_hz <= 20500 AND rolloff >= 5 AND abs(cutoff_hz - typ) < tol)
SELECT track_id, codec, bitrate, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, o) = 1""",
    "spec",
    digits=4,
)
add(
    "transcode_verdict",
    lambda s, d: spectra.transcode_verdict(multi(s, d), RATE).drop("reason"),
    f"""WITH {MULTI}, v AS (SELECT *, cutoff_hz / {HALF} AS r, cutoff_hz / {HALF} < 0.95 AND rolloff > 10 AND conf > 0.4 AS y FROM mm)
SELECT track_id, y AS is_transcode, round(CASE WHEN y THEN conf ELSE greatest(0.5, 1 - conf * 0.5) END, 4) AS confidence, round(r, 4) AS cutoff_ratio FROM v""",
    "spec",
    digits=4,
)
BAND = "CASE " + " ".join(f"WHEN cutoff_hz < {t} THEN '{c}'" for t, c, _ in spectra.BANDS["current"]) + " ELSE 'unknown' END"
BITS = "CASE " + " ".join(f"WHEN cutoff_hz < {t} THEN {b}" for t, _, b in spectra.BANDS["current"]) + " ELSE 0 END"
add(
    "spectral_cutoff_finding",
    lambda s, d: spectra.spectral_cutoff_finding(spectra.detect_cutoff(spec_supp(s, d), RATE, SIZE), RATE),
    f"""WITH {CUT}, r AS (SELECT *, cutoff_hz / {HALF} AS r, {BAND} AS codec FROM cut WHERE cutoff_hz / {HALF} < 0.95), c AS (SELECT *, least(1, greatest(0, (0.95 - r) / 0.3)) AS c0 FROM r)
SELECT track_id, CASE codec WHEN 'mp3' THEN 'Mp3Transcode' WHEN 'aac' THEN 'AacTranscode' ELSE 'LossyTranscode' END AS defect_type, {BITS} AS estimated_bitrate, trunc(cutoff_hz)::INT AS cutoff_hz, round(CASE WHEN r < 0.6 THEN least(1, c0 + 0.15) ELSE c0 END, 4) AS confidence,
CASE WHEN r < 0.5 THEN 'critical' WHEN r < 0.7 THEN 'high' WHEN r < 0.85 THEN 'medium' ELSE 'low' END AS severity FROM c""",
    "spec",
    digits=4,
)
for table in spectra.BANDS:
    steps = " ".join(f"WHEN hz < {t} THEN '{c} {b}'" for t, c, b in spectra.BANDS[table])
    add(
        f"estimate_codec_{table}",
        lambda s, d, table=table: sig_supp(s, d).select("track_id", "idx", spectra.estimate_codec(F.abs("q") % 24000, table).alias("e")).select("track_id", "idx", F.concat_ws(" ", "e.codec", "e.bitrate").alias("codec")),
        f"SELECT track_id, idx, CASE {steps} ELSE 'unknown 0' END AS codec FROM (SELECT track_id, idx, abs(q) % 24000 AS hz FROM supp)",
        "supp",
    )
R2, S2 = 192_000, 1024
RES2 = R2 / S2
M2 = -(-500 // RES2)
LOWER = ", ".join(f"({i}, {r}, {int(r / 2 / RES2)})" for i, r in enumerate(spectra.RATES) if r < R2)
add(
    "resampling_finding",
    lambda s, d: spectra.resampling_finding(spec_supp(s, d), R2, S2),
    f"""WITH c(o, r, b) AS (VALUES {LOWER}), e AS (SELECT track_id, o, r, b, max(bins) AS bins, avg(db) FILTER (k >= greatest(0, b - {4 * M2}) AND k < greatest(0, b - {M2})) AS lo, avg(db) FILTER (k >= least(b + {M2}, bins - 1) AND k < least(b + {4 * M2}, bins)) AS hi FROM spec, c GROUP BY ALL),
f AS (SELECT *, lo - hi AS dp, least(0.95, greatest(0.3, (lo - hi) / 60)) AS conf FROM e WHERE b < bins AND lo > -90 AND lo - hi > 20)
SELECT track_id, r AS original_rate, round(conf, 6) AS confidence, CASE WHEN dp > 50 THEN 'Poor' WHEN dp > 35 THEN 'Moderate' ELSE 'Good' END AS quality FROM f QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY conf DESC, o) = 1""",
    "spec",
)
RAD = -(-200 // RES2)
PLACES = ", ".join(f"({o}, {r}, {h}, {int(r / 2 * h / RES2)})" for o, r in enumerate(spectra.RATES) if 10_000 <= r / 2 < R2 / 2 for h in range(1, 5) if r / 2 * h < R2 / 2 - 500)
add(
    "imaging_nulls",
    lambda s, d: spectra.imaging_nulls(spec_supp(s, d), R2, S2),
    f"""WITH p(o, r, h, b) AS (VALUES {PLACES}), e AS (SELECT track_id, o, r, h, min(db) FILTER (k >= b - {RAD} AND k < b + {RAD}) AS low, avg(db) AS around FROM spec, p WHERE k >= greatest(0, b - {4 * RAD}) AND k < b + {4 * RAD} AND b < bins GROUP BY ALL),
c AS (SELECT track_id, o, r, count(*) AS n, count(*) FILTER (around - low > 15) AS z FROM e GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (around - low > 15) / count(*) >= 0.5)
SELECT track_id, arg_min(r, o) AS original_rate, round(arg_min(least(0.85, greatest(0.3, z / n * 0.8)), o), 6) AS confidence FROM c GROUP BY ALL""",
    "spec",
)
R3 = 100_000
ROOTS = ", ".join(f"({i}, {r}, {int(r / 2 / (R3 / S2) + 0.5)})" for i, r in enumerate(spectra.RATES[:4]) if r < R3)
add(
    "upsampling_shelf",
    lambda s, d: spectra.upsampling_shelf(spec_supp(s, d), R3, S2),
    f"""WITH c(o, r, b) AS (VALUES {ROOTS}), e AS (SELECT track_id, o, r, b, max(bins) AS bins, avg(pow(10, db / 10)) FILTER (k >= b // 2 AND k < b) AS lo, avg(pow(10, db / 10)) FILTER (k >= b) AS hi FROM spec, c GROUP BY ALL),
f AS (SELECT *, -10 * log10(greatest(hi / lo, 1e-15)) AS gap FROM e WHERE bins >= 64 AND b < bins - 4 AND lo > 1e-14 AND hi / lo < 0.01)
SELECT track_id, arg_min(r, o) AS original_rate, round(arg_min(gap, o), 6) AS gap_db, round(arg_min(least(0.95, greatest(0.4, (gap - 20) / 30)), o), 6) AS confidence FROM f GROUP BY ALL""",
    "spec",
)
add(
    "downsampling_rolloff",
    lambda s, d: spectra.downsampling_rolloff(spec_supp(s, d), RATE, SIZE),
    f"""WITH r AS (SELECT *, avg(db) FILTER (k >= bins * 60 // 100 AND k < bins * 80 // 100) OVER (PARTITION BY track_id) AS ref FROM spec), a AS (SELECT track_id, max(bins) AS bins, max(ref) AS ref, avg(db) FILTER (k >= bins * 85 // 100 AND k < bins * 98 // 100) AS en,
min(k) FILTER (k >= bins * 85 // 100 AND k < bins * 98 // 100 AND db < ref - 20) AS kn FROM r GROUP BY ALL), b AS (SELECT *, ref - en AS dp, coalesce(kn, bins * 85 // 100) * {RES} AS hz FROM a WHERE ref - en > 30)
SELECT track_id, CASE WHEN abs(hz - {HALF}) < {HALF * 0.15} THEN 88200 ELSE {2 * RATE} END AS original_rate, round(dp, 6) AS drop_db, round(hz, 6) AS knee_hz, round(least(0.85, greatest(0.3, (dp - 30) / 30)), 6) AS confidence FROM b""",
    "spec",
)
add(
    "noise_shaping_slope",
    lambda s, d: spectra.noise_shaping_slope(spec_supp(s, d).withColumn("db", -F.col("db")), RATE, SIZE),
    f"WITH a AS (SELECT track_id, avg(-db) FILTER (k < {int(10000 / (RATE / SIZE))}) AS lo, avg(-db) FILTER (k >= {int(16000 / (RATE / SIZE))}) AS hi FROM spec GROUP BY ALL) SELECT track_id, round(CASE WHEN hi - lo > 6 THEN least(1, (hi - lo) / 20) ELSE 0 END, 6) AS slope FROM a",
    "spec",
)


def long_chain(s, d):
    """Frames, transforms, median spectrum and cutoff of long tracks, one frame a row."""
    return spectra.median_of_frames_db(spectra.frame_magnitudes(sig_flag(s, d), 1024, 256, "blackman_harris", plan="spread40"), 1024)


add(
    "median_spectrum_long",
    long_chain,
    """WITH t AS (SELECT track_id, count(*) AS n FROM flag GROUP BY ALL HAVING count(*) >= 2048), p AS MATERIALIZED (SELECT flag.track_id, f, idx - f * ((n - 1024) // 40) AS i, x FROM flag JOIN t USING (track_id), range(40) z(f) WHERE idx >= f * ((n - 1024) // 40) AND idx < f * ((n - 1024) // 40) + 1024),
w AS (SELECT *, x * (0.35875 - 0.48829 * cos(2 * pi() * i / 1023) + 0.14128 * cos(4 * pi() * i / 1023) - 0.01168 * cos(6 * pi() * i / 1023)) AS y FROM p),
s AS (SELECT track_id, f, k::INT AS k, sum(y * cos(2 * pi() * ((i * k) % 1024) / 1024)) AS re, sum(y * sin(2 * pi() * ((i * k) % 1024) / 1024)) AS im FROM w, range(513) b(k) GROUP BY ALL),
r AS (SELECT track_id, k, (re * re + im * im) / (1024 * 1024.0::DOUBLE) AS p, row_number() OVER (PARTITION BY track_id, k ORDER BY re * re + im * im) AS r FROM s)
SELECT track_id, k, round(CASE WHEN p > 1e-20 THEN 10 * log10(p) ELSE -200 END, 6) AS db FROM r WHERE r = 21""",
    "flag",
)
add(
    "frame",
    lambda s, d: spectra.frame(sig_supp(s, d), 128, 64).select("track_id", "ch", "frame_no", "start_idx", F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("x").alias("n")),
    """WITH t AS (SELECT track_id, ch, count(*) AS n FROM supp GROUP BY ALL), f AS (SELECT track_id, ch, unnest(range((n - 128) // 64 + 1)) AS frame_no FROM t WHERE n >= 128)
SELECT f.track_id, f.ch, frame_no, frame_no * 64 AS start_idx, round(sum(x), 6) AS total, count(*)::INT AS n FROM f JOIN supp s ON s.track_id = f.track_id AND s.idx >= frame_no * 64 AND s.idx < frame_no * 64 + 128 GROUP BY ALL""",
    "supp",
)
def grid_rows(width: int, height: int, scale: str) -> str:
    """Bin of each row of the picture, as the scale says: ``py, k`` for range(height) t(py)."""
    part = f"({height} - 1 - py) / {max(1, height - 1)}::DOUBLE"
    top = f"2595 * log10(1 + {FRAME_RATE / 2} / 700)"
    k = f"{part} * 32" if scale == "linear" else f"700 * (pow(10, {part} * {top} / 2595) - 1) / {FRAME_RATE / 64}"
    return f"SELECT py::INT AS py, least(32, trunc({k}))::INT AS k FROM range({height}) t(py)"


for name, scale, seconds, hop in (("spectrogram_grid", "mel", 15.0, 1024), ("spectrogram_grid_linear", "linear", 15.0, 1024), ("spectrogram_grid_first", "mel", 0.1, 64)):
    add(
        name,
        lambda s, d, scale=scale, seconds=seconds, hop=hop: spectra.spectrogram_grid(spectra.spectrogram(mags(s, d), 64).withColumn("frame_no", F.floor(F.col("frame_no") / 10)).groupBy("track_id", "frame_no", "k").agg(F.avg("db").alias("db")), FRAME_RATE, 64, 30, 16, scale, max_seconds=seconds, hop=hop),
        f"""WITH g AS (SELECT track_id, frame_no // 10 AS frame_no, k, avg(CASE WHEN mag > 1e-10 THEN 20 * log10(mag / 64) ELSE -200 END) AS db FROM spectra WHERE (frame_no // 10) * {hop} + 64 <= {seconds} * {FRAME_RATE} GROUP BY ALL), ln AS ({grid_rows(30, 16, scale)}),
ce AS (SELECT track_id, px::INT AS px, px * n // 30 AS frame_no FROM (SELECT track_id, max(frame_no) + 1 AS n FROM g GROUP BY ALL), range(30) t(px))
SELECT track_id, px, py, round((least(0, greatest(-90, db)) + 90) / 90, 6) AS v FROM g JOIN ln USING (k) JOIN ce USING (track_id, frame_no)""",
        "spectra",
    )

# Cepstra.
MEL = 12
BANK = """edge AS (SELECT i, 700 * (pow(10, (2595 * log10(1 + 20 / 700) + (2595 * log10(1 + 8000 / 700) - 2595 * log10(1 + 20 / 700)) * i / 13) / 2595) - 1) * 64 / 16000 AS e FROM range(14) t(i)),
bank AS (SELECT m, k, CASE WHEN k >= a AND k <= b AND b - a > 1e-10 THEN (k - a) / (b - a) WHEN k > b AND k <= c AND c - b > 1e-10 THEN (c - k) / (c - b) ELSE 0 END AS w FROM (SELECT x.i::INT AS m, x.e AS a, y.e AS b, z.e AS c FROM edge x JOIN edge y ON y.i = x.i + 1 JOIN edge z ON z.i = x.i + 2), range(33) t(k))"""
MFCC = f"""{BANK}, me AS (SELECT track_id, frame_no, m, sum(mag * mag * w) AS e FROM spectra JOIN bank USING (k) GROUP BY ALL),
mf AS (SELECT track_id, frame_no, c::INT AS c, sum(ln(greatest(e, 1e-10)) * CASE WHEN c = 0 THEN sqrt(1 / 12) ELSE sqrt(2 / 12) END * (1 + 11 * sin(pi() * c / 22)) * cos(pi() * c * (2 * m + 1) / 24)) AS v FROM me, range(8) t(c) GROUP BY ALL)"""


def mf(s, d):
    return cepstra.mfcc(mags(s, d), FRAME_RATE, 64, MEL, 8)


add("mel_filterbank", lambda s, d: cepstra.mel_energies(mags(s, d), cepstra.mel_filterbank(s, MEL, 64, FRAME_RATE), MEL), f"WITH {MFCC} SELECT {FR}, m, round(e, 6) AS e FROM me", "spectra")
add("mfcc", mf, f"WITH {MFCC} SELECT {FR}, c, round(v, 5) AS v FROM mf", "spectra", digits=5)
DELTA = """, ix AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY track_id, c) AS n FROM mf WINDOW w AS (PARTITION BY track_id, c ORDER BY frame_no)),
de AS (SELECT a.track_id, a.frame_no, a.c, (sum(l * (p.v - q.v)) / 10) AS v FROM ix a, range(1, 3) t(l), ix p, ix q WHERE p.track_id = a.track_id AND p.c = a.c AND p.r = least(a.r + l, a.n) AND q.track_id = a.track_id AND q.c = a.c AND q.r = greatest(a.r - l, 1) GROUP BY ALL)"""
add("deltas", lambda s, d: cepstra.deltas(mf(s, d)), f"WITH {MFCC} {DELTA} SELECT {FR}, c, round(v, 5) AS v FROM de", "spectra", digits=5)
STATS = f"""{MFCC} {DELTA}, mo AS (SELECT track_id, c, avg(v) AS mean, stddev_pop(v) AS std FROM mf GROUP BY ALL),
mq AS (SELECT track_id, c, max(mean) AS mean, max(std) AS std, avg(pow(v - mean, 3)) / pow(max(std), 3) AS skew, avg(pow(v - mean, 4)) / pow(max(std), 4) - 3 AS kurt, count(*) AS n FROM mf JOIN mo USING (track_id, c) GROUP BY ALL),
dq AS (SELECT track_id, c, avg(v) AS delta_mean, stddev_pop(v) AS delta_std FROM de GROUP BY ALL)"""


def stats(s, d):
    m = mf(s, d)
    return cepstra.mfcc_stats(m, cepstra.deltas(m))


add("mfcc_stats", stats, f"WITH {STATS} SELECT track_id, c, round(mean, 5) AS mean, round(std, 5) AS std, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(delta_mean, 5) AS delta_mean, round(delta_std, 5) AS delta_std FROM mq JOIN dq USING (track_id, c)", "spectra", digits=5)
add(
    "fingerprint",
    lambda s, d: cepstra.fingerprint(stats(s, d)).select("track_id", "dimension", F.posexplode("features").alias("place", "value")),
    f"""WITH {STATS}, un AS (SELECT track_id, 0 AS o, c, mean AS v FROM mq UNION ALL SELECT track_id, 1, c, std FROM mq UNION ALL SELECT track_id, 2, c, skew FROM mq UNION ALL SELECT track_id, 3, c, kurt FROM mq UNION ALL SELECT track_id, 4, c, delta_mean FROM dq UNION ALL SELECT track_id, 5, c, delta_std FROM dq)
SELECT track_id, 48 AS dimension, o * 8 + c AS place, round(v, 5) AS value FROM un""",
    "spectra",
    digits=5,
)


def frames_of(s, d):
    return frames64(s, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_frames"))


add(
    "mfcc_lossy_finding",
    lambda s, d: cepstra.mfcc_lossy_finding(stats(s, d).withColumn("std", F.col("std") / 8).withColumn("delta_std", F.col("delta_std") / 8), frames_of(s, d)),
    f"""WITH {STATS}, h AS (SELECT track_id, avg(std / 8) AS std, avg(delta_std / 8) AS d, avg(abs(kurt)) AS kurt, max(n) AS n FROM mq JOIN dq USING (track_id, c) WHERE c >= 5 GROUP BY ALL),
f AS (SELECT *, least(1, greatest(0.3, (2.5 - std) / 2.5)) AS c0 FROM h WHERE n >= 10 AND std < 2.5 AND std >= 0.15 AND d < 0.7), g AS (SELECT *, CASE WHEN kurt < 0.5 THEN least(1, c0 + 0.15) ELSE c0 END AS conf FROM f)
SELECT track_id, round(std, 5) AS high_std, round(kurt, 5) AS mean_abs_kurt, round(conf, 5) AS confidence, CASE WHEN conf > 0.75 THEN 'high' ELSE 'medium' END AS severity FROM g""",
    "spectra",
    digits=5,
)


def asked(s, d):
    """The stated query set: every twentieth vector, against all."""
    return vec64(s, d).where("id % 20 = 0")


VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0)"
add(
    "cosine_pairs",
    lambda s, d: cepstra.cosine_pairs(asked(s, d), vec64(s, d), 5),
    f"""WITH {VEC}, p AS (SELECT q.id AS a_id, v.id AS b_id, list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))) AS s FROM q, v WHERE q.id <> v.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_id)::INT AS rank FROM p) SELECT a_id, b_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5""",
)
add(
    "euclid_pairs",
    lambda s, d: cepstra.euclid_pairs(asked(s, d), vec64(s, d), 1.2),
    f"WITH {VEC} SELECT q.id AS a_id, v.id AS b_id, round(list_distance(q.v, v.v), 6) AS distance FROM q, v WHERE q.id <> v.id AND list_distance(q.v, v.v) <= 1.2",
)
add(
    "euclid_pairs_cells",
    lambda s, d: cepstra.euclid_pairs(vec64(s, d), vec64(s, d), 1.1, method="cells"),
    f"WITH {VEC} SELECT a.id AS a_id, b.id AS b_id, round(list_distance(a.v, b.v), 6) AS distance FROM v a, v b WHERE a.id <> b.id AND list_distance(a.v, b.v) <= 1.1",
)

# Hum: the frame view read as spectra with 10 Hz bins.
HRES = 10.0


def hspec(s, d):
    return hum.hires_spectrum(mags(s, d), HRES, 10)




add("hires_spectrum", hspec, "SELECT track_id, k, round(sum(mag) / 10, 6) AS mag FROM spectra WHERE k * 10 < 500 GROUP BY ALL", "spectra")


def fine(s, d):
    """A finer spectrum: bins of 1 Hz from short tracks' samples."""
    return sig_supp(s, d).select("track_id", F.col("idx").alias("k"), F.abs("x").alias("mag")).where("k < 500")


FINE = "fs AS (SELECT track_id, idx AS k, abs(x) AS mag FROM supp WHERE idx < 500)"


def fenergy(base: int) -> str:
    return "sqrt(" + " + ".join(f"pow(max(mag) FILTER (k >= {base * h - 2} AND k < {base * h + 2}), 2)" for h in range(1, 5)) + ")"


QUIET = " OR ".join(f"(k >= {a} AND k < {b})" for a, b in hum.QUIET)
NF = f"nq AS (SELECT track_id, mag, row_number() OVER (PARTITION BY track_id ORDER BY mag) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM fs WHERE {QUIET}), nf AS (SELECT track_id, mag AS floor FROM nq WHERE r = n // 2)"
add("harmonic_energy", lambda s, d: hum.harmonic_energy(fine(s, d), 50.0, 1.0), f"WITH {FINE} SELECT track_id, round({fenergy(50)}, 6) AS energy FROM fs GROUP BY ALL", "supp")
add("hum_noise_floor", lambda s, d: hum.hum_noise_floor(fine(s, d), 1.0), f"WITH {FINE}, {NF} SELECT track_id, round(floor, 6) AS floor FROM nf", "supp")
BASE = f"""{FINE}, {NF}, en AS (SELECT track_id, {fenergy(50)} / max(floor) AS s50, {fenergy(60)} / max(floor) AS s60 FROM fs JOIN nf USING (track_id) GROUP BY ALL),
bf AS (SELECT track_id, CASE WHEN s60 > s50 AND s60 > 2 THEN 60 ELSE 50 END::DOUBLE AS base, CASE WHEN s50 > s60 AND s50 > 2 THEN least(0.95, s50 / (s50 + s60 + 0.1)) WHEN s60 > s50 AND s60 > 2 THEN least(0.95, s60 / (s50 + s60 + 0.1)) ELSE 0 END AS confidence FROM en)"""
add("base_frequency", lambda s, d: hum.base_frequency(fine(s, d), 1.0), f"WITH {BASE} SELECT track_id, base, round(confidence, 6) AS confidence FROM bf", "supp")
PEAK = """pw AS (SELECT p.track_id, p.target, f.k, f.mag, c - {t} AS s, least(c + {t}, b) AS e FROM pt p JOIN (SELECT *, max(k) OVER (PARTITION BY track_id) + 1 AS b FROM fs) f USING (track_id) WHERE f.k >= c - {t} - {t2} AND f.k < least(least(c + {t}, b) + {t2}, b)),
pk AS (SELECT track_id, target, max(mag) AS st, arg_max(k, struct_pack(m := mag, k := -k)) AS k FROM pw WHERE k >= s AND k < e GROUP BY ALL),
pn AS (SELECT track_id, target, mag, row_number() OVER (PARTITION BY track_id, target ORDER BY mag) - 1 AS r, count(*) OVER (PARTITION BY track_id, target) AS n FROM pw WHERE k < s OR k >= e),
pf AS (SELECT track_id, target, mag AS fl FROM pn WHERE r = n // 2), pe AS (SELECT pk.track_id, pk.target, (k + 0.5)::DOUBLE AS freq, st, CASE WHEN coalesce(fl, 0.001) > 0 THEN st / coalesce(fl, 0.001) ELSE 0 END AS snr FROM pk LEFT JOIN pf USING (track_id, target))"""
add(
    "peak_near",
    lambda s, d: hum.peak_near(fine(s, d), fine(s, d).select("track_id", F.lit(100.0).alias("target")).distinct(), 1.0, 3.0),
    f"WITH {FINE}, pt AS (SELECT DISTINCT track_id, 100.0::DOUBLE AS target, 100 AS c FROM fs), {PEAK.format(t=3, t2=6)} SELECT track_id, target, round(freq, 6) AS freq, round(st, 6) AS strength, round(snr, 6) AS snr FROM pe",
    "supp",
)
HARM = f"""{BASE}, pt AS (SELECT track_id, base * n AS target, (base * n)::BIGINT AS c, n::INT AS n FROM bf, range(1, 9) t(n) WHERE base * n < {1000 / 2 - 10}), {PEAK.format(t=1, t2=2)},
hm AS (SELECT pe.track_id, pt.n, pt.target AS expected, freq, 20 * log10(st) AS strength_db, 10 * log10(snr) AS snr_db, CASE WHEN snr > 10 THEN 0.95 WHEN snr > 5 THEN 0.7 + (snr - 5) * 0.05 WHEN snr > 2 THEN 0.4 + (snr - 2) * 0.1 ELSE snr * 0.2 END AS confidence FROM pe JOIN pt USING (track_id, target))"""


def harmonics(s, d):
    return hum.hum_harmonics(fine(s, d), hum.base_frequency(fine(s, d), 1.0), 1000, 1.0)


add("hum_harmonics", harmonics, f"WITH {HARM} SELECT track_id, n, expected, round(freq, 6) AS freq, round(strength_db, 6) AS strength_db, round(snr_db, 6) AS snr_db, round(confidence, 6) AS confidence FROM hm", "supp")


def trace(s, d):
    x = sig_supp(s, d)
    f = (F.lit(50.0) + F.col("x") * 0.4).alias("freq")
    c = F.when(F.abs(F.col("q")) % 7 == 0, 0.2).when(F.abs(F.col("q")) % 5 == 0, 0.6).otherwise(0.9)
    return x.select("track_id", (F.col("idx") * 0.5).alias("t"), f, c.alias("confidence"), F.when(F.abs(F.col("q")) % 7 == 0, -80.0).otherwise(-20.0).alias("strength_db"))


TRACE = "tr AS (SELECT track_id, idx * 0.5::DOUBLE AS t, 50 + x * 0.4 AS freq, CASE WHEN abs(q) % 7 = 0 THEN 0.2 WHEN abs(q) % 5 = 0 THEN 0.6 ELSE 0.9 END AS confidence, abs(q) % 7 = 0 AS weak FROM supp)"
JUMPS = f"""{TRACE}, sd AS (SELECT track_id, stddev_pop(freq) AS sd, count(*) AS n FROM tr WHERE confidence > 0.5 GROUP BY ALL), lg AS (SELECT *, lag(freq) OVER w AS pf, lag(t) OVER w AS pt, lag(confidence) OVER w AS pc FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY t)),
jm AS (SELECT track_id, pt AS start, t - pt AS duration, 'frequency_jump' AS kind, least(1, abs(freq - pf) / 0.5) AS severity FROM lg JOIN sd USING (track_id) WHERE n >= 3 AND confidence >= 0.5 AND pc >= 0.5 AND abs(freq - pf) > 0.1 AND abs(freq - pf) > 3 * sd)"""
DROPS = """wg AS (SELECT *, sum((NOT weak)::INT) OVER (PARTITION BY track_id ORDER BY t) AS g FROM tr), rn AS (SELECT track_id, g, min(t) AS start, max(t) + 0.5 AS e FROM wg WHERE weak GROUP BY ALL),
dp AS (SELECT track_id, start, e - start AS duration, 'signal_dropout' AS kind, least(1, (e - start) / 5) AS severity FROM rn JOIN (SELECT track_id, max(t) AS last FROM tr GROUP BY ALL) USING (track_id) WHERE e - start > 0.5 AND e <= last)"""
OUT5 = "SELECT track_id, start, duration, kind, round(severity, 6) AS severity FROM "
add("enf_jumps", lambda s, d: hum.enf_jumps(trace(s, d)), f"WITH {JUMPS} {OUT5} jm", "supp")
add("enf_dropouts", lambda s, d: hum.enf_dropouts(trace(s, d)), f"WITH {TRACE}, {DROPS} {OUT5} dp", "supp")
add("enf_anomalies", lambda s, d: hum.enf_anomalies(trace(s, d)), f"WITH {JUMPS}, {DROPS} {OUT5} jm UNION ALL {OUT5} dp", "supp")
add(
    "enf_summary",
    lambda s, d: hum.enf_summary(harmonics(s, d), trace(s, d), hum.base_frequency(fine(s, d), 1.0)),
    f"""WITH {HARM}, {TRACE}, h AS (SELECT track_id, 10 * log10(sum(pow(10, snr_db / 10)) FILTER (snr_db > -30)) AS snr, count(*) FILTER (confidence > 0.5) AS half, count(*) FILTER (confidence > 0.6) AS strong FROM hm GROUP BY ALL),
v AS (SELECT track_id, count(*) AS valid, avg(freq) AS m, stddev_pop(freq) AS s FROM tr WHERE confidence > 0.5 GROUP BY ALL)
SELECT track_id, base, half >= 2 AND snr > 3 AS detected, round(least(0.95, least(1, strong / 4) * 0.4 + CASE WHEN snr > 10 THEN 0.3 WHEN snr > 5 THEN 0.2 WHEN snr > 2 THEN 0.1 ELSE 0 END + CASE WHEN valid > 20 THEN 0.3 WHEN valid > 10 THEN 0.2 WHEN valid > 5 THEN 0.1 ELSE 0 END), 6) AS confidence,
round(snr, 6) AS snr_db, round(least(1, greatest(0, 1 - s / m * 500)), 6) AS stability, CASE WHEN base = 50 THEN 'Europe' ELSE 'NorthAmerica' END AS region FROM bf JOIN h USING (track_id) JOIN v USING (track_id) WHERE confidence >= 0.3""",
    "supp",
)


def tracked(s, d):
    m = spectra.frame_magnitudes(sig_supp(s, d), 256, 256, "hann", sym=False)
    m = m.select("track_id", "frame_no", F.posexplode("mag").alias("k", "mag"))
    base = m.select("track_id").distinct().withColumn("base", F.lit(50.0))
    return hum.track_frequency(m, base, 256, 256)


add(
    "track_frequency",
    tracked,
    """WITH t AS (SELECT track_id, count(*) AS n FROM supp GROUP BY ALL), p AS (SELECT track_id, idx // 256 AS f, idx % 256 AS i, x * 0.5 * (1 - cos(2 * pi() * (idx % 256) / 256)) AS y FROM supp JOIN t USING (track_id) WHERE idx // 256 < n // 256),
s AS (SELECT track_id, f, k, sum(y * cos(2 * pi() * ((i * k) % 256) / 256)) AS re, sum(y * sin(2 * pi() * ((i * k) % 256) / 256)) AS im FROM p, range(97, 103) b(k) GROUP BY ALL), m AS (SELECT track_id, f, k, sqrt(re * re + im * im) AS mag FROM s),
c AS (SELECT track_id, f, max(mag) AS st, arg_max(k, struct_pack(m := mag, k := -k)) AS k FROM m WHERE k IN (99, 100) GROUP BY ALL),
r AS (SELECT track_id, f, mag AS fl FROM (SELECT *, row_number() OVER (PARTITION BY track_id, f ORDER BY mag) AS r FROM m WHERE k NOT IN (99, 100)) WHERE r = 3)
SELECT track_id, round((f * 128 + 128) / 256::DOUBLE, 6) AS t, round((k + 0.5) / 2, 6) AS freq, CASE WHEN st / fl > 5 THEN 0.9 WHEN st / fl > 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, round(20 * log10(st), 6) AS strength_db FROM c JOIN r USING (track_id, f)""",
    "supp",
)


#: Samples that each value of the long track is held for.
HOLD = 24


def recording(s, d, rate):
    """One long recording: the values of the long track, held, under a mains hum whose frequency changes from half to half."""
    x = sig_whole(s, d).select("track_id", "ch", "idx", "x")
    n = x.agg(F.count(F.lit(1)).alias("n"))
    held = x.crossJoin(F.broadcast(n)).select("*", F.explode(F.sequence(F.lit(0), F.lit(HOLD - 1))).alias("j")).withColumn("idx", F.col("idx") * HOLD + F.col("j"))
    f = F.when(F.col("idx") < F.col("n") * HOLD / 2, 50.0).otherwise(50.2)
    tone = lambda h: F.sin(2 * math.pi * h * f * F.col("idx") / rate)
    return held.select("track_id", "ch", "idx", (F.col("x") * 0.01 + tone(1) * 0.2 + tone(2) * 0.1 + tone(3) * 0.05).alias("x"))


for preset, p in hum.PRESETS.items():
    # Bins of 1 Hz.
    add(f"hum_analysis_{preset}", lambda s, d, preset=preset, rate=p["size"]: hum.hum_analysis(recording(s, d, rate), rate, preset))
