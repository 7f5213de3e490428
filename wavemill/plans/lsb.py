"""Queries of the low-order bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.operators import lsb
from wavemill.plans.registry import LOW, add
from wavemill.sources.fixtures import sig_flag, sig_supp, sig_whole

ENT = "h AS (SELECT track_id, ch, v, count(*) AS c, count(*) / sum(count(*)) OVER (PARTITION BY track_id, ch) AS p FROM (SELECT track_id, ch, {v} AS v FROM supp) GROUP BY track_id, ch, v)"
K = "track_id, ch"

add("lsb_bit_entropy", lambda s, d: lsb.lsb_bit_entropy(sig_supp(s, d)), f"WITH {ENT.format(v='q & 1')} SELECT {K}, round(-sum(p * log2(p)), 6) AS entropy FROM h GROUP BY ALL", "supp")
add("lsb_nibble_entropy", lambda s, d: lsb.lsb_nibble_entropy(sig_supp(s, d)), f"WITH {ENT.format(v='q & 15')} SELECT {K}, round(-sum(p * ln(p)) / ln(16), 6) AS entropy FROM h GROUP BY ALL", "supp")
add("lsb_byte_entropy", lambda s, d: lsb.lsb_byte_entropy(sig_supp(s, d)), f"WITH {ENT.format(v=LOW)} SELECT {K}, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * log2(p)) / 8 END, 6) AS entropy FROM h GROUP BY ALL", "supp")
USE = f"us AS (SELECT {K}, b::INT AS bit, avg(((q >> b) & 1)::DOUBLE) AS share FROM supp, range(24) t(b) GROUP BY ALL)"
add("bit_usage", lambda s, d: lsb.bit_usage(sig_supp(s, d), 24), f"WITH {USE} SELECT {K}, bit, round(share, 9) AS share FROM us", "supp", digits=9)
add("effective_bits", lambda s, d: lsb.effective_bits(lsb.bit_usage(sig_supp(s, d), 24), 24), f"WITH {USE} SELECT {K}, greatest(8, max(CASE WHEN share > 0.01 THEN bit ELSE 0 END) + 1) AS effective_bits FROM us GROUP BY ALL", "supp")
add("effective_bits_lowest", lambda s, d: lsb.effective_bits(lsb.bit_usage(sig_supp(s, d), 24), 24, variant="lowest"), f"WITH {USE} SELECT {K}, 24 - coalesce(min(bit) FILTER (share >= 0.01 AND share <= 0.99), 24) AS effective_bits FROM us GROUP BY ALL", "supp")

LADDERS = {
    "tz": ([("n < 1000", 24, 0.3), ("r8 > 0.97 AND r3 < 0.01", 16, 0.98), ("r8 > 0.95 AND r3 < 0.02", 16, 0.92), ("r8p > 0.93 AND r3 < 0.03", 16, 0.85), ("r3 > 0.20", 24, 0.95), ("r3 > 0.10", 24, 0.85), ("r3 > 0.05", 24, 0.7), ("r8p > 0.85", 16, 0.55)], 24, 0.6),
    "ur": ([("r < 1.1 AND e > 0.9", 16, 0.98), ("r < 1.2 AND e > 0.85", 16, 0.9), ("r < 1.3 AND e > 0.8", 16, 0.8), ("r > 50", 24, 0.98), ("r > 20", 24, 0.9), ("r > 10", 24, 0.8), ("r > 3", 24, 0.7)], 24, 0.5),
    "cl": ([("n < 1000", 24, 0.3), ("s > 0.97 AND k < 5", 16, 0.98), ("s > 0.93 AND k < 10", 16, 0.9), ("s > 0.88 AND k < 20", 16, 0.82), ("h > 0.9 AND k > 200", 24, 0.98), ("h > 0.8 AND k > 150", 24, 0.85), ("k > 100", 24, 0.7), ("s > 0.8", 16, 0.55)], 24, 0.55),
    "qs": ([("n < {section}", 24, 0.3), ("step IS NULL", 24, 0.4), ("step > 0.8 / 32768", 16, 0.85), ("step < 100 / 8388608::DOUBLE", 24, 0.9), ("step < 0.3 / 32768", 24, 0.75)], 24, 0.45),
}


def ladder(name: str) -> str:
    steps, bits, conf = LADDERS[name]
    return f"CASE {' '.join(f'WHEN {c} THEN {b}' for c, b, _ in steps)} ELSE {bits} END AS bits, (CASE {' '.join(f'WHEN {c} THEN {v}' for c, _, v in steps)} ELSE {conf} END)::DOUBLE AS conf"


def ints24(s, d):
    return sig_flag(s, d).withColumn("q", F.round(F.col("x") * 8388607).cast("int"))


F24 = "f24 AS (SELECT track_id, ch, idx, x, round(x * 8388607)::INT AS q FROM flag)"
TZ = f"tz AS (SELECT {K}, count(*) AS n, avg((q % 256 = 0 AND q % 512 <> 0)::INT) AS r8, avg((q % 256 = 0)::INT) AS r8p, avg((q & 15 <> 0)::INT) AS r3 FROM f24 WHERE abs(x) >= 1e-5 AND q <> 0 GROUP BY ALL)"
UR = f"ur AS (SELECT {K}, count(DISTINCT q) / count(DISTINCT round(x * 32767)::INT) AS r, count(DISTINCT CASE WHEN q <> 0 AND q % 256 = 0 THEN q END) / count(DISTINCT q) AS e FROM f24 WHERE abs(x) >= 1e-5 GROUP BY ALL)"
CL = f"""lh AS (SELECT {K}, {LOW} AS v, count(*) AS c, count(*) / sum(count(*)) OVER (PARTITION BY {K}) AS p FROM f24 WHERE abs(x) >= 1e-5 GROUP BY {K}, {LOW}),
cl AS (SELECT {K}, sum(c)::BIGINT AS n, count(*) AS k, coalesce(sum(p) FILTER (v IN (0, 128)), 0) AS s, -sum(p * log2(p)) / 8 AS h FROM lh GROUP BY ALL)"""


def step_sql(view: str, section: int, least: int) -> str:
    """CTEs up to ``qs(track_id, ch, n, step)``."""
    return f"""sec AS (SELECT *, idx // {section} AS s FROM {view}), fs AS (SELECT {K}, s, sqrt(avg(x * x)) AS rms FROM sec GROUP BY ALL HAVING count(*) = {section}),
calm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY rms, s) AS k FROM fs WHERE rms > 1e-7 AND rms < 0.01) WHERE k <= 8),
stp AS (SELECT {K}, s, abs(x - lag(x) OVER (PARTITION BY {K}, s ORDER BY idx)) AS d FROM sec SEMI JOIN calm USING (track_id, ch, s)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {K}, s ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY {K}, s) AS m FROM stp WHERE d > 1e-10 AND d < 0.001),
av AS (SELECT {K}, avg(d) AS step FROM rk WHERE r = m // 10 AND m > {least} GROUP BY ALL), had AS (SELECT {K}, count(*) AS n FROM {view} GROUP BY ALL), qs AS (SELECT had.track_id, had.ch, n, step FROM had LEFT JOIN av USING (track_id, ch))"""


add("trailing_zero_profile", lambda s, d: lsb.trailing_zero_profile(ints24(s, d)), f"WITH {F24}, {TZ} SELECT {K}, n, round(r8, 6) AS ratio_8, round(r8p, 6) AS ratio_8_plus, round(r3, 6) AS ratio_low, {ladder('tz')} FROM tz", "flag")
add("unique_ratio", lambda s, d: lsb.unique_ratio(sig_flag(s, d)), f"WITH {F24}, {UR} SELECT {K}, round(r, 6) AS ratio, round(e, 6) AS edge_ratio, {ladder('ur')} FROM ur", "flag")
add("lsb_clustering", lambda s, d: lsb.lsb_clustering(ints24(s, d)), f"WITH {F24}, {CL} SELECT {K}, n, k AS kinds, round(s, 6) AS share, round(h, 6) AS entropy, {ladder('cl')} FROM cl", "flag")


def quiet(s, d):
    """All values as one track of low level, long enough for whole sections."""
    return sig_whole(s, d).withColumn("x", F.col("x") / 100)


add(
    "quantization_step",
    lambda s, d: lsb.quantization_step(quiet(s, d)),
    f"WITH qf AS (SELECT {K}, idx, x / 100 AS x FROM whole), {step_sql('qf', 16384, 100)} SELECT {K}, round(step, 9) AS step, {ladder('qs').format(section=16384)} FROM qs",
    "whole",
    digits=9,
)


def voted(s, d):
    x = ints24(s, d)
    rows = [m.select("track_id", "ch", "bits", "conf") for m in (lsb.trailing_zero_profile(x), lsb.unique_ratio(x), lsb.lsb_clustering(x), lsb.quantization_step(x))]
    return lsb.vote_bit_depth(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), 24)


add(
    "vote_bit_depth",
    voted,
    f"""WITH {F24}, {TZ}, {UR}, {CL}, {step_sql("f24", 16384, 100)},
ms AS (SELECT {K}, {ladder("tz")} FROM tz UNION ALL SELECT {K}, {ladder("ur")} FROM ur UNION ALL SELECT {K}, {ladder("cl")} FROM cl UNION ALL SELECT {K}, {ladder("qs").format(section=16384)} FROM qs),
v AS (SELECT {K}, coalesce(sum(conf) FILTER (bits <= 16), 0) AS a, coalesce(sum(conf) FILTER (bits > 16), 0) AS b, count(*) FILTER (bits <= 16 AND conf >= 0.8) AS hi, count(*) FILTER (bits <= 16 AND conf >= 0.9) AS ve, count(*) FILTER (bits <= 16 AND conf >= 0.85) AS su FROM ms GROUP BY ALL),
w AS (SELECT *, CASE WHEN a + b < 0.1 THEN 24 WHEN a > b AND ve >= 3 THEN 16 WHEN a > b AND hi >= 4 THEN 16 WHEN a > 2 * b AND hi >= 3 THEN 16 WHEN b > a THEN 24 ELSE 24 END AS actual_bits,
CASE WHEN a + b < 0.1 THEN 0.3 WHEN a > b AND ve >= 3 THEN a / (a + b) WHEN a > b AND hi >= 4 THEN a / (a + b) * 0.95 WHEN a > 2 * b AND hi >= 3 THEN a / (a + b) * 0.9 WHEN b > a THEN b / (a + b) ELSE 0.5 END AS c FROM v)
SELECT {K}, actual_bits, round(c, 6) AS confidence, actual_bits = 16 AND c >= 0.9 AND su >= 3 AS is_mismatch FROM w""",
    "flag",
)
LV = f"lv AS (SELECT {K}, idx, {LOW}::BIGINT AS v FROM {{0}})"


def lag_sql() -> str:
    parts = [f"SELECT {K}, {k} AS lag, sum(v * w) AS ab, sum(v) FILTER (w IS NOT NULL) AS a, sum(w) AS b, count(w) AS n FROM (SELECT {K}, v, lag(v, {k}) OVER (PARTITION BY {K} ORDER BY idx) AS w FROM lv) GROUP BY ALL" for k in lsb.LAGS]
    return " UNION ALL ".join(parts)


add(
    "lsb_lag_correlation",
    lambda s, d: lsb.lsb_lag_correlation(sig_flag(s, d)),
    f"""WITH {LV.format("flag")}, st AS (SELECT {K}, avg(v) AS mu, var_pop(v) AS var FROM lv GROUP BY ALL), lg AS ({lag_sql()})
SELECT {K}, round(avg(abs((ab - mu * (a + b) + n * mu * mu) / (n * var))), 6) AS correlation FROM lg JOIN st USING (track_id, ch) GROUP BY ALL""",
    "flag",
)


def period_sql(periods: tuple, span: int | None, gain: float) -> str:
    upto = lambda p: "" if span is None else f"AND idx < {p * span}"
    return " UNION ALL ".join(f"SELECT {K}, CASE WHEN avg((v = w)::INT) > 0.01 THEN avg((v = w)::INT) * {gain} ELSE 0 END AS r FROM (SELECT *, lag(v, {p}) OVER (PARTITION BY {K} ORDER BY idx) AS w FROM lv) WHERE idx >= {p} {upto(p)} GROUP BY ALL" for p in periods)


def cut(cap: int | None) -> str:
    return "flag" if cap is None else f"(SELECT * FROM flag WHERE idx < {cap})"


def period(cap: int | None) -> str:
    return f"WITH {LV.format(cut(cap))}, pr AS ({period_sql(lsb.PERIODS, cap and lsb.FIRST_PERIODS['lsb_periodicity'], 10.0)}), le AS (SELECT {K}, count(*) AS n FROM lv GROUP BY ALL) SELECT {K}, round(CASE WHEN n < 4096 THEN 0 ELSE least(1, max(r)) END, 6) AS periodicity FROM pr JOIN le USING (track_id, ch) GROUP BY {K}, n"


def transitions(cap: int | None) -> str:
    return f"WITH {LV.format(cut(cap))} SELECT {K}, round(CASE WHEN count(*) < 1000 THEN 0.5 ELSE sum(bit_count(xor(v, w))) / (8 * count(w)) END, 6) AS rate FROM (SELECT *, lag(v) OVER (PARTITION BY {K} ORDER BY idx) AS w FROM lv) GROUP BY ALL"


def clustering(cap: int | None) -> str:
    return f"""WITH c AS (SELECT {K}, {LOW} AS v, count(*) AS c, sum(count(*)) OVER (PARTITION BY {K}) AS n FROM {cut(cap)} GROUP BY {K}, {LOW}), k AS (SELECT {K}, max(n) AS n, count(*) FILTER (c > n // 100)::DOUBLE AS k FROM c GROUP BY ALL)
SELECT {K}, round(CASE WHEN n < 1000 THEN 0 WHEN k < 50 THEN 1 - k / 50 WHEN k < 150 THEN 0.5 * (1 - (k - 50) / 100) ELSE 0 END, 6) AS clustering FROM k"""


def pattern(cap: int | None) -> str:
    return f"""WITH {LV.format(cut(cap))}, ch1 AS (SELECT {K}, avg((v <> w)::INT) AS rate, count(*) AS n FROM (SELECT *, lag(v) OVER (PARTITION BY {K} ORDER BY idx) AS w FROM lv) GROUP BY ALL),
ra AS (SELECT {K}, 256 - count(*) FILTER (c >= 5) AS rare FROM (SELECT {K}, v, count(*) AS c FROM lv GROUP BY ALL) GROUP BY ALL), pr AS (SELECT {K}, max(r) AS p FROM ({period_sql((256, 512, 1024, 2048), cap and lsb.FIRST_PERIODS['byte_pattern_score'], 1.0)}) GROUP BY ALL)
SELECT {K}, round(CASE WHEN n < 4096 THEN 0 ELSE 1 END * least(1, CASE WHEN rate > 0.45 AND rate < 0.55 THEN 0.3 ELSE 0 END + CASE WHEN rare > 10 AND rare < 100 THEN 0.2 ELSE 0 END + CASE WHEN p > 0.2 THEN p * 0.3 ELSE 0 END), 6) AS score FROM ch1 JOIN ra USING (track_id, ch) JOIN pr USING (track_id, ch)"""


# Whole channels, and the short analysis of the first samples, which is a preset of its own.
for name, sql in (("lsb_periodicity", period), ("bit_transition_rate", transitions), ("lsb_value_clustering", clustering), ("byte_pattern_score", pattern)):
    for ending, cap in (("", None), ("_first", lsb.FIRST_SAMPLES[name])):
        more = {"span": lsb.FIRST_PERIODS[name]} if cap and name in lsb.FIRST_PERIODS else {}
        add(f"{name}{ending}", lambda s, d, name=name, cap=cap, more=more: getattr(lsb, name)(sig_flag(s, d), cap=cap, **more), sql(cap), "flag")
