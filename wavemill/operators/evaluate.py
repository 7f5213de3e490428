"""Ground truth and evaluation: expected labels, normalised findings, scores and accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wavemill.operators.findings import findings_diff

# Names of dither methods, whether they can be told; engines with their tier and whether they can be told.
DITHERS = [
    ("rectangular", True), ("triangular", True), ("triangular_hp", False), ("lipshitz", False), ("shibata", True), ("low_shibata", False), ("high_shibata", True),
    ("f_weighted", False), ("modified_e_weighted", False), ("improved_e_weighted", False),
]
ENGINES = [
    ("swr_default", "Standard", False), ("swr_cubic", "Standard", False), ("swr_blackman_nuttall", "High", True), ("swr_kaiser_beta9", "High", False), ("swr_kaiser_beta12", "VeryHigh", False), ("swr_kaiser_beta16", "VeryHigh", False),
    ("swr_filter_size_16", "High", False), ("swr_filter_size_64", "VeryHigh", False), ("soxr_default", "High", False), ("soxr_hq", "High", False), ("soxr_vhq", "VeryHigh", True), ("soxr_vhq_cheby", "VeryHigh", True),
    ("soxr_cutoff_91", "VeryHigh", False), ("soxr_cutoff_95", "VeryHigh", False),
]
SCALES = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


def expected_manifest(spark: SparkSession, sources: DataFrame, bits: int = 16) -> DataFrame:
    """All dither and resampling cases of ``sources(source, rate, target_rate)``."""
    d = spark.createDataFrame([(m, x, s) for m, x in DITHERS for s in SCALES], "method string, detectable boolean, scale double")
    e = spark.createDataFrame(ENGINES, "engine string, tier string, detectable boolean")
    one = sources.select("source").distinct().crossJoin(F.broadcast(d))
    scale = F.translate(F.format_string("%.2f", "scale"), ".", "_")
    dither = one.select(
        F.concat_ws("", "source", F.lit("_dither_"), "method", F.lit("_scale"), scale, F.lit(".flac")).alias("filename"), F.lit("dither").alias("kind"), F.col("method").alias("name"), "scale",
        F.lit(None).cast("int").alias("target_rate"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("tier"), "detectable", F.lit(bits).alias("output_bits"),
    )
    pairs = sources.crossJoin(F.broadcast(e))
    way = F.when(F.col("target_rate") > F.col("rate"), "Upsample").when(F.col("target_rate") < F.col("rate"), "Downsample").otherwise("None")
    resample = pairs.select(
        F.concat_ws("", "source", F.lit("_"), F.col("target_rate").cast("string"), F.lit("Hz_"), "engine", F.lit(".flac")).alias("filename"), F.lit("resample").alias("kind"), F.col("engine").alias("name"),
        F.lit(None).cast("double").alias("scale"), "target_rate", way.alias("direction"), "tier", "detectable", F.lit(None).cast("int").alias("output_bits"),
    )
    return dither.unionByName(resample)


def parse_label_names(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``algorithm, scale`` and ``rate, engine, params`` of file names that follow either form."""
    dither, resample = r"^output_(.+)_scale([0-9]+(?:_[0-9]+)?)\.flac$", r"^output_([0-9]+)Hz_([^_]*)_(.*)\.flac$"
    part = lambda p, i: F.when(F.col(col).rlike(p), F.regexp_extract(col, p, i))
    return df.withColumns(
        {"algorithm": part(dither, 1), "scale": F.translate(part(dither, 2), "_", ".").cast("double"), "rate": part(resample, 1).cast("int"), "engine": part(resample, 2), "params": part(resample, 3)}
    )


def category_expectation(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``should_pass`` and ``expected`` of a category name; the first rule that fits holds."""
    c = F.col(col)
    has = c.contains
    # Category names and the labels they stand for, in the order in which they are tried.
    rules: list[tuple[Column, bool, list[str]]] = [
        (c == "Control_Original", True, []), (has("MP3"), False, ["Mp3Transcode"]), (c.startswith("AAC_"), False, ["AacTranscode"]), (has("Opus"), False, ["OpusTranscode"]), (c.startswith("Vorbis_"), False, ["OggVorbisTranscode"]),
        (c == "BitDepth_16to24", False, ["BitDepthMismatch"]), (c == "Combined_16bit_44khz", False, ["BitDepthMismatch", "Upsampled"]), (c.startswith("SampleRate_"), False, ["Upsampled"]),
        (c.startswith("Edge_") & has("Resample"), False, ["Upsampled"]), (c.startswith("Generation_") & has("AAC"), False, ["AacTranscode"]),
    ]
    ok, labels = F.when(F.lit(False), False), F.when(F.lit(False), F.array().cast("array<string>"))
    for cond, passes, names in rules:
        ok, labels = ok.when(cond, passes), labels.when(cond, F.array(*map(F.lit, names)).cast("array<string>"))
    return df.withColumn("should_pass", ok.otherwise(False)).withColumn("expected", labels.otherwise(F.array().cast("array<string>")))


#: Tokens that an automaton is built of and sent to every task, at most.
TOKENS = 100_000


def genre_lookup(df: DataFrame, col: str, tokens: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``genre``: that of the first token of ``tokens(priority, token, genre)`` that the text holds, else Unknown.

    One automaton of all tokens reads each text once, in place.  More than ``TOKENS`` tokens are joined instead, which
    takes ``id_col``.
    """
    rows = [tuple(r) for r in tokens.where("token is not null").select("priority", "token", "genre").limit(TOKENS + 1).collect()]
    if len(rows) > TOKENS:
        hit = df.select(id_col, col).join(tokens, F.col(col).contains(F.col("token")))
        first = hit.groupBy(id_col).agg(F.min_by("genre", "priority").alias("genre"))
        return df.join(first, id_col, "left").withColumn("genre", F.coalesce("genre", F.lit("Unknown")))
    best: dict[str, tuple] = {}
    for rank, (_, token, genre) in enumerate(sorted(rows, key=lambda r: r[0])):
        best.setdefault(token, (rank, genre))
    always = best.pop("", None)
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for token, value in best.items():
            automaton.add_word(token, value)
        automaton.make_automaton()
        for b in batches:
            found = []
            for text in b.column(at).to_pylist():
                hits = [v for _, v in automaton.iter(text)] if text and best else []
                hits += [always] if always and text is not None else []
                found.append(min(hits, key=lambda v: v[0])[1] if hits else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g or "Unknown" for g in found])], names=[*b.schema.names, "genre"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("genre", StringType())]))


REPORT = "struct<verdict: struct<genuine: boolean>, detections: array<struct<severity: string, defect_type: map<string, map<string, string>>>>>"


def _codec_label(codec: Column) -> Column:
    u = F.upper(F.coalesce(codec, F.lit("")))
    return F.when(u.contains("MP3"), "Mp3Transcode").when(u.contains("AAC"), "AacTranscode").when(u.contains("OPUS"), "OpusTranscode").when(u.contains("VORBIS") | u.contains("OGG"), "OggVorbisTranscode").otherwise("LossyTranscode")


def normalize_findings(df: DataFrame, col: str, suite: str = "genre") -> DataFrame:
    """``df`` with ``is_clean`` and ``found`` labels from JSON reports; unreadable reports are clean.

    ``genre`` leaves out findings of severity info and counts resampling as upsampling; ``dsp`` keeps both apart.
    """
    r = F.from_json(F.col(col), REPORT)

    def labels(d: Column) -> Column:
        t = d["defect_type"]
        own = lambda k: F.map_contains_key(t, k)
        arr = lambda *x: F.array(*[v if isinstance(v, Column) else F.lit(v) for v in x])
        none = F.array().cast("array<string>")
        out = F.when(own("LossyTranscode"), arr(_codec_label(t["LossyTranscode"]["codec"])))
        if suite == "genre":
            out = out.when(own("Upsampled") | own("ResamplingDetected"), arr("Upsampled"))
        else:
            out = out.when(own("DitheringDetected"), arr("DitheringDetected")).when(own("ResamplingDetected"), arr("ResamplingDetected")).when(own("Upsampled"), arr("Upsampled"))
        out = out.when(own("BitDepthInflated"), arr("BitDepthMismatch")).when(own("UpsampledLossyTranscode"), arr("Upsampled", _codec_label(t["UpsampledLossyTranscode"]["codec"])))
        if suite == "genre":
            return F.when(d["severity"] == "info", none).otherwise(F.coalesce(out, none))
        return F.coalesce(out, none)

    found = F.array_distinct(F.flatten(F.transform(F.coalesce(r["detections"], F.array().cast("array<struct<severity: string, defect_type: map<string, map<string, string>>>>")), labels)))
    bad = r["verdict"]["genuine"].isNull()
    return df.withColumn("is_clean", F.coalesce(r["verdict"]["genuine"], F.lit(True))).withColumn("found", F.when(bad, F.array().cast("array<string>")).otherwise(found))


def score_strict(df: DataFrame) -> DataFrame:
    """``(should_pass, expected, is_clean, found)`` rows with ``missing``, ``extra`` and ``result``."""
    d = findings_diff(df)
    result = (
        F.when(F.col("should_pass"), F.when(F.col("is_clean"), "Pass").otherwise("FalsePositive")).when(F.col("is_clean"), "FalseNegative").when(F.size("expected") == 0, "Pass")
        .when(~F.arrays_overlap("expected", "found"), "WrongDefectType").when(F.size("extra") > 0, "ExtraDefects").when(F.size("missing") == 0, "Pass").otherwise("PassWithWarning")
    )
    return d.withColumn("result", result)


def score_tolerant(df: DataFrame) -> DataFrame:
    """``(should_be_clean, primary_defect, alternative_defects, tolerated_extras, is_clean, found)`` rows with ``intolerable`` and ``result``."""
    primary = F.coalesce(F.array_contains("found", F.col("primary_defect")), F.lit(False))
    other = F.arrays_overlap("alternative_defects", "found")
    own = F.concat("alternative_defects", F.array_compact(F.array("primary_defect")))
    bad = F.array_except(F.array_except("found", own), F.col("tolerated_extras"))
    result = (
        F.when(F.col("should_be_clean"), F.when(F.col("is_clean"), "Pass").when(F.size(F.array_except("found", "tolerated_extras")) == 0, "PassWithExtra").otherwise("FalsePositive"))
        .when(F.col("is_clean"), "FalseNegative").when(primary, F.when(F.size(bad) == 0, "Pass").otherwise("PassWithExtra"))
        .when(other, F.when(F.size(bad) == 0, "PassWithAlternative").otherwise("PassWithExtra")).otherwise("WrongDefectType")
    )
    return df.withColumn("intolerable", bad).withColumn("result", result)


def accuracy_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Totals and pass rate by the columns given and their roll-ups."""
    ok = F.col("result").startswith("Pass")
    kinds = ["FalsePositive", "FalseNegative", "WrongDefectType"]
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), *[F.count_if(F.col("result") == k).alias(k) for k in kinds], (F.count_if(ok) / F.count(F.lit(1))).alias("pass_rate")]
    return scored.rollup(*by).agg(*aggs)


def compare_cohorts(metrics: DataFrame, cohort: str, values: list[str]) -> DataFrame:
    """Mean of each metric by cohort, with the count."""
    return metrics.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
