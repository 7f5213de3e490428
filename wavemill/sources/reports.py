"""Result records and their JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.scalar import format_rate
from wavemill.operators.findings import defect_badge


def reports(tracks: DataFrame, findings: DataFrame, verdicts: DataFrame, metrics: DataFrame | None = None, dynamic_range: DataFrame | None = None) -> DataFrame:
    """``(track_id, report)``: a JSON record for each track; null parts are left out.

    ``metrics`` and ``dynamic_range`` are rows of a track whose columns become ``quality_metrics`` and ``dynamic_range``.

    ``tracks`` has ``track_id, file, sample_rate, bit_depth, channels, extension``; findings may have ``evidence``.
    """
    b = defect_badge(findings)
    evidence = F.col("evidence") if "evidence" in findings.columns else F.lit(None).cast("string")
    one = F.struct(F.struct("label", "category", "detail").alias("badge"), F.lower("severity").alias("severity"), "confidence", evidence.alias("evidence"), "defect_type")
    d = b.groupBy("track_id").agg(F.array_sort(F.collect_list(one)).alias("detections"))
    j = tracks.join(verdicts, "track_id").join(d, "track_id", "left")
    kind = dict(d.dtypes)["detections"]
    det = F.coalesce("detections", F.array().cast(kind))
    form = F.struct("sample_rate", format_rate(F.col("sample_rate")).alias("sample_rate_display"), "bit_depth", "channels", F.upper("extension").alias("extension"))
    says = F.struct("genuine", "quality_score", "label", F.transform(det, lambda x: x["badge"]["label"]).alias("badge_labels"))
    parts = [F.col("file"), form.alias("format"), says.alias("verdict"), det.alias("detections")]
    for name, rows in (("quality_metrics", metrics), ("dynamic_range", dynamic_range)):
        if rows is not None:
            j = j.join(rows.select("track_id", F.struct(*[c for c in rows.columns if c != "track_id"]).alias(name)), "track_id", "left")
            parts.append(F.col(name))
    return j.select("track_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}).alias("report"))


def write_report(records: DataFrame, path: str) -> None:
    """One JSON record on each line."""
    records.select("report").write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``(r)``: the records of ``write_report`` as structs of the given fields."""
    return spark.read.text(path).select(F.from_json("value", fields).alias("r"))
