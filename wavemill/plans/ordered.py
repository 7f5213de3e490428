"""Queries of ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.operators import levels, ordered
from wavemill.plans.levels import LEVELS, tt_dr_sql
from wavemill.plans.registry import ORDER, add
from wavemill.sources.fixtures import sig_flag, sig_supp, sig_user

K = "track_id, ch"
W = f"OVER (PARTITION BY {K} ORDER BY idx)"

add("pre_emphasis", lambda s, d: ordered.pre_emphasis(sig_flag(s, d)), f"SELECT {K}, idx, round(x - 0.97::DOUBLE * coalesce(lag(x) {W}, 0), 6) AS x FROM flag", "flag")
RECUR = """rec AS (SELECT track_id, ch, idx, x, {first} AS y FROM usr WHERE idx = 0 UNION ALL SELECT u.track_id, u.ch, u.idx, u.x, {step} FROM rec r JOIN usr u ON u.track_id = r.track_id AND u.idx = r.idx + 1)"""
SMALL = 16


def recursive(sql: str, first: str, step: str) -> str:
    body = RECUR.format(first=first, step=step)
    return f"WITH RECURSIVE usr AS MATERIALIZED (SELECT user_id AS track_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 2 * value / max(value) OVER (PARTITION BY user_id) - 1 AS x FROM events),\n{body}\n{sql}"


def blocks(s, d):
    return ordered.to_blocks(sig_user(s, d), SMALL)


def plain(sql: str) -> tuple[str]:
    return (sql,)


add("de_emphasis", lambda s, d: ordered.from_blocks(ordered.de_emphasis(blocks(s, d)), SMALL), *plain(recursive("SELECT track_id, ch, idx, round(y, 6) AS x FROM rec", "x", "u.x + 0.97 * r.y")))
add(
    "envelope",
    lambda s, d: ordered.from_blocks(ordered.envelope(blocks(s, d)), SMALL),
    *plain(recursive("SELECT track_id, ch, idx, round(y, 6) AS x FROM rec", "CASE WHEN abs(x) > 0 THEN 0.01 ELSE 0.0001 END * abs(x)", "r.y + CASE WHEN abs(u.x) > r.y THEN 0.01 ELSE 0.0001 END * (abs(u.x) - r.y)")),
)
(B1, A1), (B2, A2) = ordered.k_coefficients(48_000)
K_SQL = f"""WITH RECURSIVE usr AS MATERIALIZED (SELECT user_id AS track_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 2 * value / max(value) OVER (PARTITION BY user_id) - 1 AS x FROM events),
rec AS (SELECT track_id, ch, -1::BIGINT AS idx, 0::DOUBLE AS w, 0::DOUBLE AS p, 0::DOUBLE AS q, 0::DOUBLE AS g, 0::DOUBLE AS h FROM usr WHERE idx = 0
UNION ALL SELECT track_id, ch, idx, w, {B1[1]}::DOUBLE * x - {A1[1]}::DOUBLE * u + q, {B1[2]}::DOUBLE * x - {A1[2]}::DOUBLE * u, {B2[1]}::DOUBLE * u - {A2[1]}::DOUBLE * w + h, {B2[2]}::DOUBLE * u - {A2[2]}::DOUBLE * w
FROM (SELECT *, {B2[0]}::DOUBLE * u + g AS w FROM (SELECT s.track_id, s.ch, s.idx, s.x, {B1[0]}::DOUBLE * s.x + r.p AS u, r.q, r.g, r.h FROM rec r JOIN usr s ON s.track_id = r.track_id AND s.idx = r.idx + 1)))
"""
add("k_weight", lambda s, d: ordered.from_blocks(ordered.k_weight(blocks(s, d), 48_000), SMALL), K_SQL + "SELECT track_id, ch, idx, round(w, 6) AS x FROM rec WHERE idx >= 0")
add(
    "envelope_smooth",
    lambda s, d: ordered.from_blocks(ordered.envelope(blocks(s, d), 0.5, 0.1, smooth=7, block=SMALL), SMALL),
    *plain(recursive(
        f"SELECT track_id, ch, idx, round(CASE WHEN count(*) OVER (PARTITION BY {K}) < 7 THEN y ELSE avg(y) OVER v END, 6) AS x FROM rec WINDOW v AS (PARTITION BY {K} ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
        "CASE WHEN abs(x) > 0 THEN 0.5 ELSE 0.1 END * abs(x)", "r.y + CASE WHEN abs(u.x) > r.y THEN 0.5 ELSE 0.1 END * (abs(u.x) - r.y)",
    )),
)
for w in (7, 8):
    h = w // 2
    even = f"WHEN idx >= {h} AND idx < n - {h} THEN (sum(x) OVER v - max(x) FILTER (idx = {2 * h}) OVER (PARTITION BY {K})) / {w}" if w % 2 == 0 else ""
    add(
        f"moving_average_{w}",
        lambda s, d, w=w: ordered.moving_average(sig_supp(s, d), w),
        f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM supp) SELECT {K}, idx, round(CASE WHEN n < {w} THEN x {even} ELSE avg(x) OVER v END, 6) AS x FROM c WINDOW v AS (PARTITION BY {K} ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)",
        "supp",
    )


def loud(s, d):
    return sig_flag(s, d).withColumn("x", F.col("x") / 0.6)


RUNS = f"""lo AS (SELECT {K}, idx, x / 0.6 AS x FROM flag), hit AS (SELECT {K}, idx, idx - row_number() {W} AS g FROM lo WHERE abs(x) >= {{thr}}),
runs AS (SELECT {K}, min(idx) AS s, max(idx) + 1 AS e FROM (SELECT * FROM hit) GROUP BY {K}, g)"""
add("clip_runs", lambda s, d: ordered.clip_runs(loud(s, d), 0.5, 3, block=64), f'WITH {RUNS.format(thr=0.5)} SELECT {K}, s AS start, e AS "end", e - s AS n FROM runs WHERE e - s >= 3', "flag")
add(
    "intersample_peaks",
    lambda s, d: ordered.intersample_peaks(sig_user(s, d), 0.99),
    f"""WITH n AS (SELECT {K}, lag(x) {W} AS a, x AS b, lead(x) {W} AS c FROM usr), o AS (SELECT *, CASE WHEN 2 * (a - 2 * b + c) <> 0 THEN (a - c) / (2 * (a - 2 * b + c)) END AS f FROM n)
SELECT {K}, count(*) FILTER (abs(f) < 1 AND abs(b - 0.25 * (a - c) * f) > 1 AND abs(b) < 0.99) AS peaks FROM o GROUP BY ALL""",
    "usr",
)


def histogram(s, d):
    x = loud(s, d)
    n = x.groupBy("track_id", "ch").agg(F.count(F.lit(1)).alias("n"))
    return ordered.temporal_histogram(ordered.clip_runs(x, 0.5, 3), n)


add(
    "temporal_histogram",
    histogram,
    f"""WITH {RUNS.format(thr=0.5)}, n AS (SELECT {K}, count(*) / 100::DOUBLE AS w FROM lo GROUP BY ALL), b AS (SELECT runs.track_id, runs.ch, unnest(range(floor(s / w)::BIGINT, least(ceil(e / w), 100)::BIGINT))::INT AS bin FROM runs JOIN n USING (track_id, ch) WHERE e - s >= 3),
c AS (SELECT {K}, bin, count(*) AS c FROM b GROUP BY ALL) SELECT {K}, bin, round(c / max(c) OVER (PARTITION BY {K}), 6) AS value FROM c""",
    "flag",
)
SIZES = (64, 128, 192)
add(
    "frame_boundary_rate",
    lambda s, d: ordered.frame_boundary_rate(sig_supp(s, d), SIZES),
    f"""WITH p AS (SELECT {K}, idx, abs(x - lag(x) {W}) AS d, count(*) OVER (PARTITION BY {K}) AS n FROM supp), z(k, size) AS (VALUES (0, 64), (1, 128), (2, 192)),
r AS (SELECT {K}, k, size, count(*) AS hits, avg(d) AS mean, count(*) / (max(n) // size) AS rate FROM p, z WHERE d > 0.01 AND idx > 0 AND idx % size = 0 GROUP BY track_id, ch, k, size)
SELECT {K}, size AS frame_size, hits, round(mean, 6) AS mean_jump, round(rate, 6) AS rate FROM r QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY rate DESC, k) = 1""",
    "supp",
)
add(
    "autocorrelation",
    lambda s, d: ordered.autocorrelation(sig_supp(s, d), 8),
    f"""WITH e AS (SELECT {K}, sum(x * x) AS e FROM supp GROUP BY ALL), c AS (SELECT a.track_id, a.ch, lag::INT AS lag, sum(a.x * b.x) AS s FROM supp a, range(9) t(lag), supp b WHERE b.track_id = a.track_id AND b.idx = a.idx - lag GROUP BY ALL)
SELECT {K}, lag, round(s / e, 6) AS r FROM c JOIN e USING (track_id, ch)""",
    "supp",
)
add(
    "autocorrelation_long",
    lambda s, d: ordered.autocorrelation(sig_flag(s, d), 1500, 2000).where("lag % 100 = 0"),
    f"""WITH e AS (SELECT {K}, sum(x * x) AS e FROM flag GROUP BY ALL), c AS (SELECT a.track_id, a.ch, lag::INT AS lag, sum(a.x * b.x) AS s FROM flag a, range(0, 1501, 100) t(lag), flag b WHERE b.track_id = a.track_id AND b.idx = a.idx - lag GROUP BY ALL)
SELECT {K}, lag, round(s / e, 6) AS r FROM c JOIN e USING (track_id, ch)""",
    "flag",
)
add("downsample_mean", lambda s, d: ordered.downsample_mean(sig_flag(s, d), 7), f"SELECT {K}, idx // 7 AS idx, round(avg(x), 6) AS x FROM flag GROUP BY {K}, idx // 7", "flag")


def sinc(factor: int, taps: int) -> str:
    return f"""wt AS (SELECT p, o, sin(pi() * t) / (pi() * t) * 0.5 * (1 + cos(pi() * t / {taps})) AS w FROM (SELECT p, o, p / {factor} - o AS t FROM range(1, {factor}) a(p), range(-{taps}, {taps + 1}) b(o)) WHERE abs(t) <= {taps}),
up AS (SELECT {K}, idx * {factor} AS idx, x FROM sm UNION ALL SELECT b.track_id, b.ch, b.idx * {factor} + p, CASE WHEN sum(abs(w)) > 1e-10 THEN sum(s.x * w) / sum(abs(w)) ELSE 0 END FROM sm b, wt, sm s WHERE s.track_id = b.track_id AND s.idx = b.idx + o GROUP BY b.track_id, b.ch, b.idx, p)"""


def few(s, d):
    return sig_user(s, d)


add("upsample_sinc", lambda s, d: ordered.upsample_sinc(few(s, d), 3, 8), f"WITH sm AS (SELECT * FROM usr), {sinc(3, 8)} SELECT {K}, idx, round(x, 6) AS x FROM up", "usr")
PDB = "CASE WHEN {0} > 0 THEN greatest(-100, 20 * log10({0})) ELSE -100 END"
add(
    "true_peak",
    lambda s, d: ordered.true_peak(few(s, d)),
    f"""WITH sm AS (SELECT * FROM usr), {sinc(4, 16)}, a AS (SELECT {K}, max(abs(x)) FILTER (idx % 4 = 0) AS p, max(abs(x)) AS t, count(*) FILTER (idx % 4 <> 0 AND abs(x) > 1) AS overs FROM up GROUP BY ALL)
SELECT {K}, round({PDB.format("p")}, 6) AS sample_peak_db, round({PDB.format("t")}, 6) AS true_peak_db, overs FROM a""",
    "usr",
)


def steps(s, d):
    return ordered.find_transients(sig_user(s, d), 1.2, 5, mode="step")


def greedy(thr: float, gap: int) -> str:
    return f"""WITH RECURSIVE usr AS MATERIALIZED (SELECT user_id AS track_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 2 * value / max(value) OVER (PARTITION BY user_id) - 1 AS x FROM events),
cand AS MATERIALIZED (SELECT {K}, idx AS pos FROM (SELECT *, x - lag(x) {W} AS d FROM usr) WHERE d > {thr}),
tr AS (SELECT {K}, min(pos) AS pos FROM cand WHERE pos > {gap} GROUP BY ALL UNION ALL SELECT * FROM (SELECT c.track_id, c.ch, min(c.pos) AS pos FROM tr JOIN cand c ON c.track_id = tr.track_id AND c.pos > tr.pos + {gap} GROUP BY ALL) WHERE pos IS NOT NULL)"""


add("find_transients", steps, f"{greedy(1.2, 5)} SELECT {K}, pos FROM tr")


def rises(s, d):
    env = ordered.from_blocks(ordered.envelope(ordered.to_blocks(sig_flag(s, d), 4096), 0.2, 0.01, smooth=64, block=4096), 4096)
    return ordered.find_transients(env, 0.5, 200, hop=32)


RISE = f"""WITH RECURSIVE flg AS MATERIALIZED (SELECT l_returnflag AS track_id, 0 AS ch, row_number() OVER (PARTITION BY l_returnflag ORDER BY {ORDER}) - 1 AS idx, abs((round(l_extendedprice * 100)::BIGINT - 5295000) / 8388608::DOUBLE) AS x FROM lineitem),
rec AS (SELECT track_id, ch, idx, CASE WHEN x > 0 THEN 0.2 ELSE 0.01 END * x AS y FROM flg WHERE idx = 0 UNION ALL SELECT u.track_id, u.ch, u.idx, r.y + CASE WHEN u.x > r.y THEN 0.2 ELSE 0.01 END * (u.x - r.y) FROM rec r JOIN flg u ON u.track_id = r.track_id AND u.idx = r.idx + 1),
cnt AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM rec), head AS (SELECT {K}, max(y) FILTER (idx = 64) AS fixed FROM rec GROUP BY ALL),
smo AS (SELECT {K}, idx, CASE WHEN n < 64 THEN y WHEN idx >= 32 AND idx < n - 32 THEN (sum(y) OVER v - fixed) / 64 ELSE avg(y) OVER v END AS y
FROM cnt JOIN head USING (track_id, ch) WINDOW v AS (PARTITION BY {K} ORDER BY idx ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING)),
hop AS (SELECT {K}, idx // 32 AS h, max(CASE WHEN y > 1e-10 THEN 20 * log10(y) ELSE -200 END) AS m, sum(count(*)) OVER (PARTITION BY {K}) AS total FROM smo GROUP BY track_id, ch, idx // 32),
cand AS MATERIALIZED (SELECT {K}, h * 32 AS pos FROM (SELECT *, lag(m) OVER (PARTITION BY {K} ORDER BY h) AS p FROM hop) WHERE m - p > 0.5 AND h * 32 < total - 32),
tr AS (SELECT {K}, min(pos) AS pos FROM cand WHERE pos > 200 GROUP BY ALL UNION ALL SELECT * FROM (SELECT c.track_id, c.ch, min(c.pos) AS pos FROM tr JOIN cand c ON c.track_id = tr.track_id AND c.pos > tr.pos + 200 GROUP BY ALL) WHERE pos IS NOT NULL)
SELECT {K}, pos FROM tr"""
add("find_transients_rise", rises, RISE)
add(
    "pre_echo_events",
    lambda s, d: ordered.pre_echo_events(sig_user(s, d), steps(s, d), 4, least=16),
    f"""{greedy(1.2, 5)}, tot AS (SELECT {K}, count(*) AS n FROM usr GROUP BY ALL),
r AS (SELECT t.track_id, t.ch, t.pos, avg(x * x) FILTER (idx < pos) AS pre, avg(x * x) FILTER (idx >= pos) AS post FROM tr t JOIN usr u ON u.track_id = t.track_id AND idx >= pos - 4 AND idx < pos + 4 WHERE pos > 4 GROUP BY ALL),
q AS (SELECT *, CASE WHEN post > 1e-10 THEN pre / post ELSE 0 END AS ratio FROM r), f AS (SELECT {K}, count(*) FILTER (ratio > 0.01 AND ratio < 0.3) AS echoes, avg(ratio) FILTER (ratio > 0.01 AND ratio < 0.3) AS level FROM q GROUP BY ALL),
a AS (SELECT tr.track_id, tr.ch, count(*) AS transients FROM tr JOIN tot USING (track_id, ch) WHERE n >= 16 GROUP BY ALL)
SELECT {K}, transients, coalesce(echoes, 0) AS echoes, round(coalesce(level, 0), 6) AS level, round(coalesce(echoes, 0) / transients, 6) AS score, coalesce(echoes, 0) / transients > 0.3 AS evidence FROM a LEFT JOIN f USING (track_id, ch)""",
)


def clipping(s, d):
    from wavemill.operators import findings

    x = sig_user(s, d)
    return findings.clipping_finding(x, ordered.intersample_peaks(x, 0.95), ordered.clip_runs(x, 0.95, 2), 0.95)


add(
    "clipping_finding",
    clipping,
    f"""WITH n AS (SELECT {K}, idx, lag(x) {W} AS a, x AS b, lead(x) {W} AS c FROM usr), o AS (SELECT *, CASE WHEN 2 * (a - 2 * b + c) <> 0 THEN (a - c) / (2 * (a - 2 * b + c)) END AS f FROM n),
p AS (SELECT track_id, count(*) FILTER (abs(f) < 1 AND abs(b - 0.25 * (a - c) * f) > 1 AND abs(b) < 0.95) AS peaks FROM o GROUP BY ALL),
hit AS (SELECT {K}, idx, idx - row_number() {W} AS g FROM usr WHERE abs(x) >= 0.95), rg AS (SELECT track_id, count(*) AS regions FROM (SELECT track_id, g FROM hit GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
t AS (SELECT track_id, count(*) FILTER (abs(x) >= 0.95) AS hits, max(abs(x)) AS peak, count(*) AS n FROM usr GROUP BY ALL), j AS (SELECT track_id, peak, n, hits + peaks AS clipped, coalesce(regions, 0) AS regions FROM t JOIN p USING (track_id) LEFT JOIN rg USING (track_id))
SELECT track_id, round(20 * log10(peak), 6) AS peak_db, clipped, regions, round(least(1, clipped / n * 1000), 6) AS confidence, CASE WHEN clipped / n > 0.01 THEN 'critical' WHEN clipped / n > 0.001 THEN 'high' WHEN clipped / n > 0.0001 THEN 'medium' ELSE 'low' END AS severity FROM j WHERE clipped > 0""",
    "usr",
)


def dynamic_range(s, d):
    """The whole chain on long tracks: weighting, loudness, blocks, verdict."""
    x = sig_flag(s, d)
    weighted = ordered.from_blocks(ordered.k_weight(ordered.to_blocks(x, 4096), 48_000), 4096)
    return levels.dr_verdict(levels.level_stats(x), levels.tt_dr(x, 500), levels.integrated_loudness(weighted, 100))


def dynamic_range_sql() -> str:
    """The weighting follows the long tracks sample by sample; the rest is that of the short ones."""
    weighted = K_SQL.replace("SELECT user_id AS track_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 2 * value / max(value) OVER (PARTITION BY user_id) - 1 AS x FROM events", f"SELECT l_returnflag AS track_id, 0 AS ch, row_number() OVER (PARTITION BY l_returnflag ORDER BY {ORDER}) - 1 AS idx, (round(l_extendedprice * 100)::BIGINT - 5295000) / 8388608::DOUBLE AS x FROM lineitem")
    return f"""{weighted.rstrip()},
hop AS (SELECT track_id, ch, idx // 100 AS h, sum(w * w) AS ss, count(*) AS n FROM rec WHERE idx >= 0 GROUP BY ALL),
sl AS (SELECT *, CASE WHEN sum(n) OVER v = 400 THEN sum(ss) OVER v / 400 END AS p FROM hop WINDOW v AS (PARTITION BY track_id, ch ORDER BY h ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
lo AS (SELECT *, CASE WHEN p > pow(10, (-70 + 0.691) / 10) THEN p END AS loud FROM sl), gt AS (SELECT *, avg(loud) OVER (PARTITION BY track_id, ch) AS mean FROM lo),
ld AS (SELECT track_id, ch, avg(loud) FILTER (loud > mean * 0.1) AS g, count(p) AS k, sqrt(sum(ss) / sum(n)) AS rms FROM gt GROUP BY ALL),
loudness AS (SELECT track_id, ch, CASE WHEN k = 0 THEN CASE WHEN rms > 0 THEN -0.691 + 20 * log10(rms) ELSE -70 END WHEN g IS NULL THEN -70 ELSE -0.691 + 10 * log10(g) END AS lufs FROM ld),
{LEVELS.format("usr")}, {tt_dr_sql("usr", 500, "1e-3")},
a AS (SELECT lvl.track_id, max(peak_dbfs) AS peak, avg(dr_db) AS dr, avg(lufs) AS lufs, avg(peak_dbfs - rms_dbfs) AS crest FROM lvl JOIN dr USING (track_id, ch) JOIN loudness USING (track_id, ch) GROUP BY ALL)
SELECT track_id, round(dr, 6) AS dr, round(lufs, 6) AS lufs, round(crest, 6) AS crest_db, round(peak - lufs, 6) AS plr_db,
CASE WHEN dr > 20 THEN 'Exceptional' WHEN dr >= 14 THEN 'Excellent' WHEN dr >= 8 THEN 'Normal' WHEN dr >= 5 THEN 'Compressed' ELSE 'Brickwalled' END AS verdict, dr < 8 AS loudness_war_victim FROM a"""


add("dynamic_range", dynamic_range, dynamic_range_sql())
