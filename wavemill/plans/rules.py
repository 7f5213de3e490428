"""Queries of findings, verdicts, profiles and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions import scalar
from wavemill.operators import evaluate, findings, levels, lsb, ordered
from wavemill.plans.registry import LOW, add
from wavemill.sources import reports
from wavemill.sources.folders import shared_folder
from wavemill.sources.fixtures import cases_view, findings_view, sig_supp, sig_user

KINDS = ["Mp3Transcode", "AacTranscode", "OpusTranscode", "OggVorbisTranscode", "LossyTranscode", "Upsampled", "BitDepthInflated", "Clipping", "DitheringDetected", "ResamplingDetected"]
SOURCES = ["cutoff", "cutoff", "cutoff", "cutoff", "mfcc", "shelf", "bit_depth", "clipping", "dither", "resampling"]
LEVELS = ["critical", "high", "medium", "low", "info"]


def arr(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


FV = f"""f AS (SELECT o_custkey AS track_id, {arr(KINDS)}[(o_orderkey % 10 + 1)::INT] AS defect_type, round((round(o_totalprice * 100)::BIGINT % 1000) / 1000, 3) AS confidence, {arr(LEVELS)}[(o_orderkey % 5 + 1)::INT] AS severity,
{arr(SOURCES)}[(o_orderkey % 10 + 1)::INT] AS detector, (64 * (1 + o_orderkey % 5))::INT AS estimated_bitrate FROM orders)"""
COLS = "track_id, defect_type, round(confidence, 6) AS confidence, severity, detector, coalesce(estimated_bitrate, -1) AS estimated_bitrate"
LOSSY = "('Mp3Transcode', 'AacTranscode', 'OpusTranscode', 'OggVorbisTranscode', 'LossyTranscode')"


def gate(src: str) -> str:
    return f"""SELECT {COLS} FROM (SELECT *, defect_type IN ('Mp3Transcode', 'AacTranscode') AS co, (defect_type IN ('Mp3Transcode', 'AacTranscode') AND coalesce(estimated_bitrate, 192) >= 256) OR defect_type IN ('OpusTranscode', 'OggVorbisTranscode') AS hi FROM {src})
WHERE confidence >= least(0.5, CASE WHEN co AND NOT hi THEN 0.5 WHEN hi THEN 0.3 WHEN defect_type IN ('LossyTranscode', 'Upsampled', 'BitDepthInflated') THEN 0.4 ELSE 0.5 END) OR (hi AND confidence >= 0.3 * 0.8)"""


MULTI = "SELECT track_id, 'LossyTranscode' AS defect_type, least(0.95, greatest(0.4, avg(confidence))) AS confidence, 'high' AS severity, 'multi_generation' AS detector, NULL::INT AS estimated_bitrate FROM {0} WHERE defect_type IN " + LOSSY + " AND confidence >= 0.6 GROUP BY track_id HAVING count(*) >= 2"
add("confidence_gate", lambda s, d: findings.confidence_gate(findings_view(s, d)), f"WITH {FV} {gate('f')}")
add("multi_generation", lambda s, d: findings.multi_generation(findings_view(s, d)).fillna(-1), f"WITH {FV}, m AS ({MULTI.format('f')}) SELECT {COLS} FROM m")
add(
    "assemble_findings",
    lambda s, d: findings.assemble_findings(findings_view(s, d)).fillna(-1),
    f"""WITH {FV}, fl AS (SELECT track_id, bool_or(detector = 'resampling') AS re, bool_or(detector = 'cutoff') AND NOT bool_or(detector = 'resampling') AS cut FROM f GROUP BY ALL),
k AS (SELECT f.* FROM f JOIN fl USING (track_id) WHERE NOT ((detector = 'cutoff' AND re) OR (detector IN ('shelf', 'downsampling', 'mfcc', 'sfm') AND cut) OR (detector = 'downsampling' AND re))),
a AS (SELECT * FROM k UNION ALL BY NAME {MULTI.format("k")}), st AS (SELECT track_id, bool_or(defect_type IN {LOSSY}) AS lossy, bool_or(detector = 'resampling') AS re FROM a GROUP BY ALL),
b AS (SELECT a.* FROM a JOIN st USING (track_id) WHERE NOT (defect_type = 'BitDepthInflated' AND (lossy OR (NOT re AND confidence < 0.85)))) {gate("b")}""",
)
WEIGHT = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.3 ELSE 0.1 END::DOUBLE"


def tracks(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("track_id"))


add(
    "overall_confidence",
    lambda s, d: findings.overall_confidence(findings_view(s, d), tracks(s, d)),
    f"WITH {FV}, a AS (SELECT track_id, 1 - sum(confidence * {WEIGHT}) / sum({WEIGHT}) AS c FROM f GROUP BY ALL) SELECT c_custkey AS track_id, round(coalesce(c, 1), 6) AS confidence FROM customer LEFT JOIN a ON track_id = c_custkey",
)


def noise(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("track_id"), F.when(F.col("c_custkey") % 3 != 0, -F.abs("c_acctbal") / 100).alias("noise_floor"))


add(
    "verdict",
    lambda s, d: findings.verdict(findings_view(s, d), noise(s, d)).withColumn("quality_score", F.round("quality_score", 9)),
    f"""WITH {FV}, b AS (SELECT track_id, count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS bad FROM f GROUP BY ALL), g AS (SELECT c_custkey AS track_id, coalesce(bad, 0) = 0 AS genuine, CASE WHEN c_custkey % 3 <> 0 THEN -abs(c_acctbal) / 100 END AS nf FROM customer LEFT JOIN b ON track_id = c_custkey),
q AS (SELECT *, CASE WHEN nf IS NOT NULL THEN 1 - least(1, abs(nf) / 120) WHEN genuine THEN 0.95 ELSE 0.4 END AS s FROM g)
SELECT track_id, genuine, round(s, 9)::DOUBLE AS quality_score, CASE WHEN genuine THEN CASE WHEN s >= 0.9 THEN 'Lossless' ELSE 'Probably Lossless' END WHEN s < 0.5 THEN 'Lossy / Fake' ELSE 'Suspect' END AS label FROM q""",
    digits=9,
)
NAMES = {"cutoff": "SpectralCutoff", "mfcc": "CodecSignature", "shelf": "Upsampling", "bit_depth": "BitDepth", "clipping": "PreEcho", "dither": "StereoField", "resampling": "Other"}


def named(s, d):
    f = findings_view(s, d)
    out = F.lit(None).cast("string")
    for k, v in NAMES.items():
        out = F.when(F.col("detector") == k, v).otherwise(out)
    return f.withColumn("detector", out)


def profile_sql(profile: str) -> str:
    sens, _, mods = findings.PROFILES[profile]
    own = {d: (m, x) for d, m, x in mods}
    rows = ", ".join(f"('{n}', {own.get(n, (1.0, False))[0]}, {own.get(n, (1.0, False))[1]})" for n in findings.DETECTORS)
    case = "CASE detector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
    return f"""WITH {FV}, p(detector, m, suppressed) AS (VALUES {rows}), n AS (SELECT * REPLACE ({case} AS detector) FROM f)
SELECT n.detector, track_id, defect_type, round(confidence, 6) AS confidence, severity, estimated_bitrate, coalesce(suppressed, false) AS suppressed, round(least(1, greatest(0, confidence * coalesce(m, 1)::DOUBLE * {sens}::DOUBLE)), 6) AS adjusted FROM n LEFT JOIN p ON p.detector = n.detector WHERE coalesce(m, 1) > 0"""


for profile in findings.PROFILES:
    add(f"apply_profile_{profile}", lambda s, d, profile=profile: findings.apply_profile(named(s, d), profile), profile_sql(profile))


def badge_rows(s, d):
    f = findings_view(s, d)
    return f.select(
        "track_id", "defect_type", "severity", "confidence", "estimated_bitrate", F.lit("general").alias("codec"), (F.col("track_id") % 20000).cast("int").alias("cutoff_hz"), F.lit(44100).alias("original_rate"), F.lit(96000).alias("current_rate"), F.lit(16).alias("actual_bits"), F.lit(24).alias("claimed_bits")
    )


CAT = "CASE " + " ".join(f"WHEN defect_type = '{k}' THEN '{c}'" for k, (_, c) in findings.BADGES.items()) + " END"
LAB = "CASE " + " ".join(f"WHEN defect_type = '{k}' THEN '{v or 'GENERAL'}'" for k, (v, _) in findings.BADGES.items()) + " END"
CODEC = "CASE defect_type WHEN 'Mp3Transcode' THEN 'MP3' WHEN 'AacTranscode' THEN 'AAC' WHEN 'OpusTranscode' THEN 'Opus' WHEN 'OggVorbisTranscode' THEN 'OggVorbis' WHEN 'LossyTranscode' THEN 'general' END"
add(
    "defect_badge",
    lambda s, d: findings.defect_badge(badge_rows(s, d)).select("track_id", "defect_type", "label", "category", "detail"),
    f"""WITH {FV} SELECT track_id, defect_type, {LAB} AS label, {CAT} AS category, CASE WHEN defect_type IN {LOSSY} THEN {CODEC} || ' @ ~' || estimated_bitrate || ' kbps, cutoff ' || (track_id % 20000) || ' Hz'
WHEN defect_type = 'Upsampled' THEN '44.1 kHz → 96 kHz' WHEN defect_type = 'BitDepthInflated' THEN '16-bit content in 24-bit container' END AS detail FROM f""",
)
add(
    "codec_name",
    lambda s, d: findings_view(s, d).select("track_id", "defect_type", "confidence", scalar.is_lossy(F.col("defect_type")).alias("lossy"), scalar.codec_name(F.col("defect_type"), F.lit("own")).alias("codec")),
    f"""WITH {FV} SELECT track_id, defect_type, round(confidence, 6) AS confidence, defect_type IN {LOSSY} AS lossy, CASE defect_type WHEN 'Mp3Transcode' THEN 'MP3' WHEN 'AacTranscode' THEN 'AAC' WHEN 'OpusTranscode' THEN 'Opus' WHEN 'OggVorbisTranscode' THEN 'Ogg Vorbis' WHEN 'LossyTranscode' THEN 'own' END AS codec FROM f""",
)


def report_rows(s, d, metrics=None, loudness=None):
    f = badge_rows(s, d)
    t = tracks(s, d).select("track_id", F.concat(F.lit("t"), "track_id").alias("file"), F.lit(44100).alias("sample_rate"), F.lit(24).alias("bit_depth"), F.lit(2).alias("channels"), F.lit("flac").alias("extension"))
    v = findings.verdict(f, tracks(s, d).withColumn("noise_floor", F.lit(None).cast("double")))
    return reports.reports(t, f, v, metrics, loudness)


REPORT = "struct<file: string, verdict: struct<genuine: boolean, label: string>, detections: array<struct<severity: string>>, format: struct<sample_rate_display: string, extension: string>, quality_metrics: struct<noise_floor: double>, dynamic_range: struct<dr: long, verdict: string>>"


def written(s, records):
    """Records written as files and read back; the track is told by the file's name."""
    path = shared_folder(s, "report")
    reports.write_report(records, path)
    return reports.read_report(s, path, REPORT).withColumn("track_id", F.substring("r.file", 2, 20).cast("long"))


def parsed(s, d):
    r = written(s, report_rows(s, d))
    return r.select("track_id", "r.file", F.col("r.verdict.genuine").alias("genuine"), F.col("r.verdict.label").alias("label"), F.size("r.detections").alias("n"), F.col("r.format.sample_rate_display").alias("rate"), F.col("r.format.extension").alias("ext"))


def full(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey").alias("track_id")
    metrics = c.where("c_custkey % 3 > 0").select(k, F.col("c_acctbal").cast("double").alias("noise_floor"), F.lit(None).cast("double").alias("true_peak"))
    loud = c.where("c_custkey % 4 > 0").select(k, (F.col("c_custkey") % 25).alias("dr"), F.when(F.col("c_custkey") % 25 > 12, "Normal").alias("verdict"))
    r = written(s, report_rows(s, d, metrics, loud))
    return r.select("track_id", F.size("r.detections").alias("n"), F.col("r.quality_metrics.noise_floor").alias("noise_floor"), F.col("r.dynamic_range.dr").alias("dr"), F.col("r.dynamic_range.verdict").alias("dr_verdict"))


add(
    "write_report_full",
    full,
    f"""WITH {FV}, n AS (SELECT track_id, count(*)::INT AS n FROM f GROUP BY ALL)
SELECT c_custkey AS track_id, coalesce(n, 0)::INT AS n, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal::DOUBLE, 6) END AS noise_floor, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 25 END AS dr,
CASE WHEN c_custkey % 4 > 0 AND c_custkey % 25 > 12 THEN 'Normal' END AS dr_verdict FROM customer LEFT JOIN n ON track_id = c_custkey""",
)
add(
    "write_report",
    parsed,
    f"""WITH {FV}, n AS (SELECT track_id, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS bad FROM f GROUP BY ALL)
SELECT c_custkey AS track_id, 't' || c_custkey AS file, coalesce(bad, 0) = 0 AS genuine, CASE WHEN coalesce(bad, 0) = 0 THEN 'Lossless' ELSE 'Lossy / Fake' END AS label, coalesce(n, 0)::INT AS n, '44.1 kHz' AS rate, 'FLAC' AS ext FROM customer LEFT JOIN n ON track_id = c_custkey""",
)
LBL = arr(["Mp3Transcode", "Upsampled", "BitDepthMismatch"])
CV = f"""c0 AS (SELECT o_orderkey AS k, o_orderpriority AS category, o_orderstatus AS genre, list_filter({LBL}, lambda x, i: (o_orderkey >> (i - 1)) % 2 = 1) AS expected, list_filter({LBL}, lambda x, i: (o_orderkey >> (i + 2)) % 2 = 1) AS found FROM orders),
cv AS (SELECT *, k % 4 = 0 AS should_pass, len(found) = 0 OR k % 5 = 0 AS is_clean, list_filter(expected, lambda x: NOT list_contains(found, x)) AS missing, list_filter(found, lambda x: NOT list_contains(expected, x)) AS extra FROM c0),
sc AS (SELECT *, CASE WHEN should_pass THEN CASE WHEN is_clean THEN 'Pass' ELSE 'FalsePositive' END WHEN is_clean THEN 'FalseNegative' WHEN len(expected) = 0 THEN 'Pass' WHEN NOT list_has_any(expected, found) THEN 'WrongDefectType' WHEN len(extra) > 0 THEN 'ExtraDefects' WHEN len(missing) = 0 THEN 'Pass' ELSE 'PassWithWarning' END AS result FROM cv)"""


def flat(df):
    return df.select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), *(["result"] if "result" in df.columns else []))


add("findings_diff", lambda s, d: flat(findings.findings_diff(cases_view(s, d))), f"WITH {CV} SELECT k AS case_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM cv")
add("score_strict", lambda s, d: flat(evaluate.score_strict(cases_view(s, d))), f"WITH {CV} SELECT k AS case_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, result FROM sc")


def tolerant(s, d):
    c = cases_view(s, d)
    return evaluate.score_tolerant(
        c.select(
            "case_id", F.col("should_pass").alias("should_be_clean"), F.get("expected", F.lit(0)).alias("primary_defect"), F.array_compact(F.array(F.get("expected", F.lit(1)))).alias("alternative_defects"), F.array(F.lit("BitDepthMismatch")).alias("tolerated_extras"), "is_clean", "found"
        )
    ).select("case_id", F.array_join("intolerable", ",").alias("intolerable"), "result")


add(
    "score_tolerant",
    tolerant,
    f"""WITH {CV}, t AS (SELECT *, expected[1] AS p, list_filter([expected[2]], lambda x: x IS NOT NULL) AS a FROM cv), u AS (SELECT *, list_filter(found, lambda x: x IS DISTINCT FROM p AND NOT list_contains(a, x) AND x <> 'BitDepthMismatch') AS bad, coalesce(list_contains(found, p), false) AS hp, list_has_any(a, found) AS ha, list_filter(found, lambda x: x <> 'BitDepthMismatch') AS un FROM t)
SELECT k AS case_id, array_to_string(bad, ',') AS intolerable, CASE WHEN should_pass THEN CASE WHEN is_clean THEN 'Pass' WHEN len(un) = 0 THEN 'PassWithExtra' ELSE 'FalsePositive' END WHEN is_clean THEN 'FalseNegative'
WHEN hp THEN CASE WHEN len(bad) = 0 THEN 'Pass' ELSE 'PassWithExtra' END WHEN ha THEN CASE WHEN len(bad) = 0 THEN 'PassWithAlternative' ELSE 'PassWithExtra' END ELSE 'WrongDefectType' END AS result FROM u""",
)
add(
    "accuracy_report",
    lambda s, d: evaluate.accuracy_report(evaluate.score_strict(cases_view(s, d)), ["category", "genre"]),
    f"""WITH {CV} SELECT category, genre, count(*) AS total, count(*) FILTER (starts_with(result, 'Pass')) AS passed, count(*) FILTER (result = 'FalsePositive') AS "FalsePositive", count(*) FILTER (result = 'FalseNegative') AS "FalseNegative", count(*) FILTER (result = 'WrongDefectType') AS "WrongDefectType",
round(count(*) FILTER (starts_with(result, 'Pass')) / count(*), 6) AS pass_rate FROM sc GROUP BY ROLLUP (category, genre)""",
)
add(
    "compare_cohorts",
    lambda s, d: evaluate.compare_cohorts(levels.level_stats(sig_supp(s, d)).withColumn("cohort", F.when(F.col("track_id") % 2 == 0, "control").otherwise("transcoded")), "cohort", ["rms_dbfs", "crest_db"]),
    """WITH lv AS (SELECT track_id, 20 * log10(max(abs(x))) AS p, 20 * log10(sqrt(avg(x * x))) AS r FROM supp GROUP BY ALL)
SELECT CASE WHEN track_id % 2 = 0 THEN 'control' ELSE 'transcoded' END AS cohort, count(*) AS n, round(avg(r), 6) AS mean_rms_dbfs, round(avg(p - r), 6) AS mean_crest_db FROM lv GROUP BY ALL""",
    "supp",
)
CATS = ["Control_Original", "MP3_128", "Combined_MP3_128_From_CD", "AAC_96", "Edge_Opus", "Vorbis_q3", "BitDepth_16to24", "Combined_16bit_44khz", "SampleRate_96", "Edge_Resample_x", "Generation_AAC", "Generation_x", "Other"]
WANT = ["Mp3Transcode", "Mp3Transcode", "AacTranscode", "OpusTranscode", "OggVorbisTranscode", "BitDepthMismatch", "BitDepthMismatch,Upsampled", "Upsampled", "Upsampled", "AacTranscode", "", ""]


def categories(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.element_at(F.array(*map(F.lit, CATS)), (F.col("o_orderkey") % len(CATS) + 1).cast("int")).alias("category"))
    return evaluate.category_expectation(o, "category").select("o_orderkey", "category", "should_pass", F.array_join("expected", ",").alias("expected"))


add(
    "category_expectation",
    categories,
    f"SELECT o_orderkey, {arr(CATS)}[(o_orderkey % {len(CATS)} + 1)::INT] AS category, o_orderkey % {len(CATS)} = 0 AS should_pass, {arr(['', *WANT])}[(o_orderkey % {len(CATS)} + 1)::INT] AS expected FROM orders",
)


def labels(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("output_tri_hp_scale1_"), (k % 10).cast("string"), F.lit(".flac"))).when(k % 3 == 1, F.concat(F.lit("output_"), (k % 9 + 1).cast("string"), F.lit("000Hz_soxr_p_28.flac"))).otherwise("else.flac")
    return evaluate.parse_label_names(o.withColumn("name", name), "name").fillna(-1)


add(
    "parse_label_names",
    labels,
    """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'output_tri_hp_scale1_' || o_orderkey % 10 || '.flac' WHEN o_orderkey % 3 = 1 THEN 'output_' || (o_orderkey % 9 + 1) || '000Hz_soxr_p_28.flac' ELSE 'else.flac' END AS name FROM orders)
SELECT o_orderkey, name, CASE WHEN o_orderkey % 3 = 0 THEN 'tri_hp' END AS algorithm, CASE WHEN o_orderkey % 3 = 0 THEN round(1 + (o_orderkey % 10) / 10, 6) ELSE -1 END AS scale, CASE WHEN o_orderkey % 3 = 1 THEN ((o_orderkey % 9 + 1) * 1000)::INT ELSE -1 END AS rate,
CASE WHEN o_orderkey % 3 = 1 THEN 'soxr' END AS engine, CASE WHEN o_orderkey % 3 = 1 THEN 'p_28' END AS params FROM n""",
)


def genres(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    tokens = s.createDataFrame([(1, "a", "first"), (2, "e", "second"), (3, "o", "third")], "priority int, token string, genre string")
    return evaluate.genre_lookup(p, "p_name", tokens, "p_partkey")


add("genre_lookup", genres, "SELECT p_partkey, p_name, CASE WHEN contains(p_name, 'a') THEN 'first' WHEN contains(p_name, 'e') THEN 'second' WHEN contains(p_name, 'o') THEN 'third' ELSE 'Unknown' END AS genre FROM part")


def manifest(s, d):
    n = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("source"), F.when(F.col("s_suppkey") % 2 == 0, 44100).otherwise(48000).alias("rate"), F.explode(F.array(F.lit(44100), F.lit(96000), F.lit(22050))).alias("target_rate"))
    return evaluate.expected_manifest(s, n).fillna(-1)


DIT = ", ".join(f"('{m}', {str(x).lower()})" for m, x in evaluate.DITHERS)
ENG = ", ".join(f"('{e}', '{t}', {str(x).lower()})" for e, t, x in evaluate.ENGINES)
add(
    "expected_manifest",
    manifest,
    f"""WITH di(m, x) AS (VALUES {DIT}), en(e, t, x) AS (VALUES {ENG}), n AS (SELECT s_name, CASE WHEN s_suppkey % 2 = 0 THEN 44100 ELSE 48000 END AS own FROM supplier)
SELECT s_name || '_dither_' || m || '_scale' || replace(printf('%.2f', s::DOUBLE), '.', '_') || '.flac' AS filename, 'dither' AS kind, m AS name, round(s::DOUBLE, 6) AS scale, -1 AS target_rate, NULL AS direction, NULL AS tier, x AS detectable, 16 AS output_bits FROM n, di, (VALUES (0.5), (0.75), (1.0), (1.25), (1.5), (2.0)) q(s)
UNION ALL SELECT s_name || '_' || r || 'Hz_' || e || '.flac', 'resample', e, -1, r, CASE WHEN r > own THEN 'Upsample' WHEN r < own THEN 'Downsample' ELSE 'None' END, t, x, -1 FROM n, en, (VALUES (44100), (96000), (22050)) z(r)""",
)


def json_cases(s, d):
    f = findings_view(s, d)
    kind = F.concat(F.lit('{"severity": "'), "severity", F.lit('", "defect_type": {"'), "defect_type", F.lit('": {"codec": "mp3 x"}}}'))
    per = f.groupBy("track_id").agg(F.array_sort(F.collect_set(kind)).alias("k"))
    text = F.concat(F.lit('{"verdict": {"genuine": false}, "detections": ['), F.array_join("k", ","), F.lit("]}"))
    return per.select("track_id", F.when(F.col("track_id") % 11 == 0, "{broken").otherwise(text).alias("report"))


def normalized(suite):
    def run(s, d):
        n = evaluate.normalize_findings(json_cases(s, d), "report", suite)
        return n.select("track_id", "is_clean", F.array_join(F.array_sort("found"), ",").alias("found"))

    return run


for suite, extra, skip in (("genre", "WHEN 'ResamplingDetected' THEN 'Upsampled'", "AND severity <> 'info'"), ("dsp", "WHEN 'ResamplingDetected' THEN 'ResamplingDetected' WHEN 'DitheringDetected' THEN 'DitheringDetected'", "")):
    add(
        f"normalize_findings_{suite}",
        normalized(suite),
        f"""WITH {FV}, l AS (SELECT track_id, CASE defect_type WHEN 'LossyTranscode' THEN 'Mp3Transcode' WHEN 'Upsampled' THEN 'Upsampled' WHEN 'BitDepthInflated' THEN 'BitDepthMismatch' {extra} END AS l FROM f WHERE true {skip}),
t AS (SELECT DISTINCT track_id FROM f), g AS (SELECT track_id, string_agg(DISTINCT l, ',' ORDER BY l) AS found FROM l WHERE l IS NOT NULL GROUP BY ALL)
SELECT track_id, track_id % 11 = 0 AS is_clean, CASE WHEN track_id % 11 = 0 THEN '' ELSE coalesce(found, '') END AS found FROM t LEFT JOIN g USING (track_id)""",
    )


def dithers(s, d):
    x = sig_supp(s, d)
    slope = x.groupBy("track_id").agg(F.abs(F.avg("x")).alias("slope"))
    return findings.dither_finding(slope.withColumn("slope", F.col("slope") * 20), lsb.lsb_bit_entropy(x), 24)


add(
    "dither_finding",
    dithers,
    """WITH h AS (SELECT track_id, v, count(*) / sum(count(*)) OVER (PARTITION BY track_id) AS p FROM (SELECT track_id, q & 1 AS v FROM supp) GROUP BY track_id, v), e AS (SELECT track_id, -sum(p * log2(p)) AS e FROM h GROUP BY ALL), s AS (SELECT track_id, abs(avg(x)) * 20 AS s FROM supp GROUP BY ALL),
j AS (SELECT *, CASE WHEN s > 0.3 THEN 'Shaped' WHEN e > 0.95 THEN 'TPDF' WHEN e < 0.5 THEN 'Truncated' ELSE 'None' END AS t FROM s JOIN e USING (track_id))
SELECT track_id, t AS dither_type, s > 0.3 AS noise_shaping, round(CASE WHEN s > 0.3 THEN s WHEN e > 0.95 THEN 0.72 WHEN e < 0.5 THEN 0.8 ELSE 0 END, 6) AS confidence, t IN ('Shaped', 'TPDF') AS is_dithered FROM j""",
    "supp",
)


def depth(s, d):
    x = sig_supp(s, d).withColumn("q", F.abs("q") % 65536 + 0)
    return findings.bit_depth_finding(x, 24, lsb.effective_bits(lsb.bit_usage(x, 24), 24), lsb.lsb_nibble_entropy(x))


add(
    "bit_depth_finding",
    depth,
    """WITH z AS (SELECT track_id, abs(q) % 65536 AS q FROM supp), us AS (SELECT track_id, b, avg(((q >> b) & 1)::DOUBLE) AS share FROM z, range(24) t(b) GROUP BY ALL), eb AS (SELECT track_id, greatest(8, max(CASE WHEN share > 0.01 THEN b ELSE 0 END) + 1) AS eb FROM us GROUP BY ALL),
h AS (SELECT track_id, q & 15 AS v, count(*) / sum(count(*)) OVER (PARTITION BY track_id) AS p FROM z GROUP BY track_id, q & 15), e AS (SELECT track_id, -sum(p * ln(p)) / ln(16) AS e FROM h GROUP BY ALL),
n AS (SELECT track_id, eb, sum(pow(q % (1 << (24 - eb)::INT), 2)) AS r, sum(q::DOUBLE * q) AS s FROM z JOIN eb USING (track_id) GROUP BY ALL), a AS (SELECT track_id, eb, e, CASE WHEN r > 0 AND s > 0 THEN 10 * log10(r / s) ELSE -120 END AS db FROM n JOIN e USING (track_id)),
v AS (SELECT *, (eb + 4 <= 24)::INT + (e > 0.85 OR e < 0.25)::INT + (db < -96)::INT AS votes, least(1, greatest(0.3, greatest(1, 24 - eb) / 8)) AS c0 FROM a), w AS (SELECT *, CASE WHEN votes = 3 THEN least(1, c0 + 0.15) ELSE c0 END AS c1 FROM v WHERE votes >= 2), x AS (SELECT *, CASE WHEN e < 0.1 OR e > 0.95 THEN least(1, c1 + 0.1) ELSE c1 END AS c2 FROM w)
SELECT track_id, eb::INT AS effective_bits, round(e, 6) AS entropy, round(db, 6) AS q_noise_db, votes, round(CASE WHEN db < -100 THEN least(1, c2 + 0.1) ELSE c2 END, 6) AS confidence, CASE WHEN 24 - eb >= 8 THEN 'high' ELSE 'medium' END AS severity FROM x""",
    "supp",
)


def mqa_rows(s, d):
    x = sig_supp(s, d)
    e = lsb.lsb_byte_entropy(x).withColumnRenamed("entropy", "entropy")
    u = lambda n, m: (F.abs("q0") % m / m).alias(n)
    a = x.groupBy("track_id").agg(F.max("q").alias("q0"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).join(e.select("track_id", "entropy"), "track_id")
    return a.select(
        "track_id", "entropy", u("correlation", 7), (-F.abs("q0") % 40 - 50.0).alias("hf_db"), (F.abs("q0") % 30 + 0.0).alias("elevation_db"), u("pattern", 11), u("folding", 13), u("periodicity", 17), u("transitions", 19), u("clustering", 23),
        F.when(F.col("track_id") % 3 == 0, 16).otherwise(24).alias("bits"), F.when(F.col("track_id") % 5 == 0, 96000).otherwise(44100).alias("rate"), "rms",
    )


def mqa_sql(preset: str) -> str:
    te, tee, tn, tne, tp = findings.MQA_PRESETS[preset]
    ab = lambda c, t, w: f"CASE WHEN {c} > {t} THEN least(1, ({c} - {t}) / 0.5) * {w} ELSE 0 END"
    return f"""WITH h AS (SELECT track_id, {LOW} AS v, count(*) / sum(count(*)) OVER (PARTITION BY track_id) AS p FROM supp GROUP BY track_id, {LOW}), e AS (SELECT track_id, -sum(p * log2(p)) / 8 AS entropy FROM h GROUP BY ALL), m AS (SELECT track_id, abs(max(q)) AS z, max(q) AS q0, sqrt(avg(x * x)) AS rms FROM supp GROUP BY ALL),
r AS (SELECT track_id, entropy, z % 7 / 7 AS correlation, (-z) % 40 - 50 AS hf, z % 30 AS el, z % 11 / 11 AS pattern, z % 13 / 13 AS folding, z % 17 / 17 AS periodicity, z % 19 / 19 AS transitions, z % 23 / 23 AS clustering, CASE WHEN track_id % 5 = 0 THEN 96000 ELSE 44100 END AS rate, rms FROM m JOIN e USING (track_id)),
a AS (SELECT *, CASE WHEN entropy > 0.3 AND entropy < 0.8 THEN 0.35 ELSE 0 END + CASE WHEN periodicity > 0.1 THEN 0.3 ELSE 0 END + CASE WHEN clustering > 0.2 THEN 0.25 ELSE 0 END + CASE WHEN transitions > 0.35 AND transitions < 0.6 THEN 0.2 ELSE 0 END + CASE WHEN el > 1 AND el < 20 THEN 0.25 ELSE 0 END > 0.25 AS early FROM r),
b AS (SELECT *, CASE WHEN early OR (entropy > {tee} AND (el > {tne} OR correlation > 0.06 OR hf > -75)) THEN {tee}::DOUBLE ELSE {te}::DOUBLE END AS e0, CASE WHEN early OR (entropy > {tee} AND (el > {tne} OR correlation > 0.06 OR hf > -75)) THEN {tne}::DOUBLE ELSE {tn}::DOUBLE END AS n0 FROM a),
c AS (SELECT *, least(1, CASE WHEN entropy > e0 THEN least(1, (entropy - e0) / (1 - e0)) * 0.35 WHEN entropy > 0.35 THEN least(1, (entropy - 0.35) / 0.4) * 0.25 ELSE 0 END + CASE WHEN correlation > 0.06 THEN least(1, (correlation - 0.06) / 0.4) * 0.15 ELSE 0 END
+ CASE WHEN el > n0 THEN least(1, (el - n0) / 25) * 0.2 WHEN el > 1 THEN least(1, el / n0) * 0.1 ELSE 0 END + CASE WHEN hf > CASE WHEN early THEN -75 ELSE -70 END THEN least(1, (hf + 90) / 30) * 0.1 ELSE 0 END + {ab("pattern", tp, 0.1)} + {ab("folding", 0.2, 0.1)} + {ab("periodicity", 0.15, 0.15)} + {ab("clustering", 0.25, 0.15)}) AS cf FROM b)
SELECT track_id, round(CASE WHEN rate = 44100 THEN cf ELSE 0 END, 6)::DOUBLE AS confidence, rate = 44100 AND cf > CASE WHEN early THEN 0.25 ELSE 0.35 END AS is_encoded,
CASE WHEN rate = 44100 AND cf > CASE WHEN early THEN 0.25 ELSE 0.35 END THEN CASE WHEN early THEN 'Early' WHEN entropy > 0.85 THEN 'Current' ELSE 'Unknown' END END AS encoder_version, CASE WHEN rate = 44100 THEN 88200 ELSE -1 END AS original_rate FROM c"""


for preset in findings.MQA_PRESETS:
    add(f"mqa_score_{preset}", lambda s, d, preset=preset: findings.mqa_score(mqa_rows(s, d), preset).fillna(-1), mqa_sql(preset), "supp")


def analysis(s, d):
    """Measures to verdict for short tracks: clipping and padded bits gathered, gated and judged."""
    x = sig_supp(s, d)
    u = sig_user(s, d).select((F.col("track_id") + 1_000_000).alias("track_id"), "ch", "idx", "x")
    clip = findings.clipping_finding(u, ordered.intersample_peaks(u), ordered.clip_runs(u)).select("track_id", F.lit("Clipping").alias("defect_type"), "confidence", "severity", F.lit("clipping").alias("detector"), F.lit(None).cast("int").alias("estimated_bitrate"))
    pad = findings.bit_depth_finding(x, 24, lsb.effective_bits(lsb.bit_usage(x, 24), 24), lsb.lsb_nibble_entropy(x)).select("track_id", F.lit("BitDepthInflated").alias("defect_type"), "confidence", "severity", F.lit("bit_depth").alias("detector"), F.lit(None).cast("int").alias("estimated_bitrate"))
    found = findings.assemble_findings(clip.unionByName(pad))
    return findings.verdict(found, levels.quality_metrics(x.select("track_id", "ch", "idx", "x").unionByName(u)))


BITS = """us AS (SELECT track_id, b, avg(((q >> b) & 1)::DOUBLE) AS share FROM supp, range(24) t(b) GROUP BY ALL), eb AS (SELECT track_id, greatest(8, max(CASE WHEN share > 0.01 THEN b ELSE 0 END) + 1) AS eb FROM us GROUP BY ALL),
h AS (SELECT track_id, q & 15 AS v, count(*) / sum(count(*)) OVER (PARTITION BY track_id) AS p FROM supp GROUP BY track_id, q & 15), e AS (SELECT track_id, -sum(p * ln(p)) / ln(16) AS e FROM h GROUP BY ALL),
n AS (SELECT track_id, eb, sum(pow(q % (1 << (24 - eb)::INT), 2)) AS r, sum(q::DOUBLE * q) AS s FROM supp JOIN eb USING (track_id) GROUP BY ALL), a AS (SELECT track_id, eb, e, CASE WHEN r > 0 AND s > 0 THEN 10 * log10(r / s) ELSE -120 END AS db FROM n JOIN e USING (track_id)),
v AS (SELECT *, (eb + 4 <= 24)::INT + (e > 0.85 OR e < 0.25)::INT + (db < -96)::INT AS votes, least(1, greatest(0.3, greatest(1, 24 - eb) / 8)) AS c0 FROM a), w AS (SELECT *, CASE WHEN votes = 3 THEN least(1, c0 + 0.15) ELSE c0 END AS c1 FROM v WHERE votes >= 2), x AS (SELECT *, CASE WHEN e < 0.1 OR e > 0.95 THEN least(1, c1 + 0.1) ELSE c1 END AS c2 FROM w),
pad AS (SELECT track_id, CASE WHEN db < -100 THEN least(1, c2 + 0.1) ELSE c2 END AS confidence, CASE WHEN 24 - eb >= 8 THEN 'high' ELSE 'medium' END AS severity FROM x)"""
OVER = "OVER (PARTITION BY track_id ORDER BY idx)"
CLIPS = f"""nb AS (SELECT track_id, lag(x) {OVER} AS a, x AS b, lead(x) {OVER} AS c FROM usr), ob AS (SELECT *, CASE WHEN 2 * (a - 2 * b + c) <> 0 THEN (a - c) / (2 * (a - 2 * b + c)) END AS f FROM nb),
pk AS (SELECT track_id, count(*) FILTER (abs(f) < 1 AND abs(b - 0.25 * (a - c) * f) > 1 AND abs(b) < 0.99) AS peaks FROM ob GROUP BY ALL), ct AS (SELECT track_id, count(*) FILTER (abs(x) >= 0.99) AS hits, count(*) AS n FROM usr GROUP BY ALL),
clip AS (SELECT track_id + 1000000 AS track_id, least(1, (hits + peaks) / n * 1000) AS confidence, CASE WHEN (hits + peaks) / n > 0.01 THEN 'critical' WHEN (hits + peaks) / n > 0.001 THEN 'high' WHEN (hits + peaks) / n > 0.0001 THEN 'medium' ELSE 'low' END AS severity FROM ct JOIN pk USING (track_id) WHERE hits + peaks > 0)"""
add(
    "analysis",
    analysis,
    f"""WITH {BITS}, {CLIPS}, found AS (SELECT * FROM pad WHERE confidence >= 0.85 UNION ALL SELECT * FROM clip WHERE confidence >= 0.5), bad AS (SELECT track_id, count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS bad FROM found GROUP BY ALL),
al AS (SELECT track_id, x FROM supp UNION ALL SELECT track_id + 1000000, x FROM usr), rk AS (SELECT track_id, abs(x) AS m, row_number() OVER (PARTITION BY track_id ORDER BY abs(x)) - 1 AS r, count(*) OVER (PARTITION BY track_id) AS n FROM al),
fl AS (SELECT track_id, CASE WHEN m > 0 THEN 20 * log10(m) ELSE -96 END AS nf FROM rk WHERE r = n // 100), g AS (SELECT track_id, coalesce(bad, 0) = 0 AS genuine, 1 - least(1, abs(nf) / 120) AS s FROM fl LEFT JOIN bad USING (track_id))
SELECT track_id, genuine, round(s, 6)::DOUBLE AS quality_score, CASE WHEN genuine THEN CASE WHEN s >= 0.9 THEN 'Lossless' ELSE 'Probably Lossless' END WHEN s < 0.5 THEN 'Lossy / Fake' ELSE 'Suspect' END AS label FROM g""",
    "supp",
    "usr",
)
