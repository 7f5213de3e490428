"""Queries of the stream monitors.

Streams read the events table as files, a bounded number of them a batch, run in append mode until what is
there is used up, and write a table into the shared folder, which is the result: windows, sessions and runs that the
watermark has not closed by then are not in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.plans.registry import add
from wavemill.sources.folders import shared_folder
from wavemill.streaming import monitors

EVENTS = "SELECT user_id AS key, ts::TIMESTAMP AS ts, value / 500 - 1 AS value FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500 - 1).alias("value"))


#: Stateful processors need this provider; a query takes it from the session when it starts.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame) -> DataFrame:
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        sink = stream.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append")
        query = sink.option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:  # the session is the user's
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def loudness(s, d):
    return drained(monitors.stream_loudness(events(s, d), "6 hours", "3 hours", "1 hour", step="1 day", idle="3650 days")).select("key", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", "power", "lufs", "loud", "gated")


add(
    "stream_loudness",
    loudness,
    f"""WITH e AS ({EVENTS}), w AS (SELECT key, time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL (h * 3) HOURS AS start, value FROM e, range(2) t(h)), a AS (SELECT key, start, count(*) AS n, avg(value * value) AS p FROM w GROUP BY ALL),
l AS (SELECT *, CASE WHEN p > 0 THEN -0.691 + 10 * log10(p) ELSE -70 END AS lufs FROM a WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)), m AS (SELECT *, avg(p) FILTER (lufs > -70) OVER (PARTITION BY key ORDER BY start ROWS UNBOUNDED PRECEDING) AS mean FROM l)
SELECT key, epoch_us(start) AS start, epoch_us(start + INTERVAL 6 HOURS) AS "end", n, round(p, 6) AS power, round(lufs, 6) AS lufs, lufs > -70 AS loud, lufs > -70 AND coalesce(p > mean * 0.1, false) AS gated FROM m""",
)


def levels(s, d):
    return drained(monitors.stream_block_levels(events(s, d), "1 day", "1 hour")).withColumn("start", F.unix_micros("start"))


add(
    "stream_block_levels",
    levels,
    f"""WITH e AS ({EVENTS}), a AS (SELECT key, date_trunc('day', ts) AS start, count(*) AS n, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM e GROUP BY ALL)
SELECT key, epoch_us(start) AS start, n, round(peak, 6) AS peak, round(rms, 6) AS rms, round(CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE -120 END, 6) AS peak_dbfs, round(CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -120 END, 6) AS rms_dbfs FROM a WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)""",
)


def dropouts(s, d):
    return drained(monitors.stream_dropouts(events(s, d), 0.5, "12 hours", "1 hour")).withColumns({c: F.unix_micros(c) for c in ("start", "last", "silent_from")})


add(
    "stream_dropouts",
    dropouts,
    f"""WITH e AS (SELECT * FROM ({EVENTS}) WHERE abs(value) > 0.5), g AS (SELECT *, (ts - lag(ts) OVER w >= INTERVAL 12 HOURS OR lag(ts) OVER w IS NULL)::INT AS f FROM e WINDOW w AS (PARTITION BY key ORDER BY ts)), h AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY ts, f DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT key, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, epoch_us(max(ts) + INTERVAL 12 HOURS) AS silent_from, count(*) AS n FROM h GROUP BY key, k HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)""",
)


def envelope(s, d):
    # Rounded by the same operations on both sides: many levels lie midway between two rounded ones.
    return drained(monitors.stream_envelope(events(s, d), 0.5, 0.1, "1 hour", "6 hours", "5 days")).withColumns({"ts": F.unix_micros("ts"), "envelope": F.floor(F.col("envelope") * 1e6 + 0.5) / 1e6})


def clips(s, d):
    return drained(monitors.stream_clip_runs(events(s, d), 0.6, 2, "1 hour", "6 hours", "5 days")).withColumns({c: F.unix_micros(c) for c in ("start", "last")})


#: Rows whose step of six hours ends by the watermark, one hour behind the latest row.
RELEASED = f"""e AS ({EVENTS}), lim AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM e), rel AS (SELECT e.*, wm FROM e, lim WHERE time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS <= wm)"""
add(
    "stream_envelope",
    envelope,
    f"""WITH RECURSIVE {RELEASED}, o AS MATERIALIZED (SELECT key, ts, abs(value) AS v, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM rel),
r AS (SELECT key, ts, i, CASE WHEN v > 0 THEN 0.5 ELSE 0.1 END * v AS e FROM o WHERE i = 1
UNION ALL SELECT key, ts, i, e + CASE WHEN v > e THEN 0.5 ELSE 0.1 END * (v - e) FROM (SELECT o.key, o.ts, o.i, o.v, CASE WHEN o.ts - r.ts > INTERVAL 5 DAYS THEN 0 ELSE r.e END AS e FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1))
SELECT key, epoch_us(ts) AS ts, floor(e * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS envelope FROM r""",
)
add(
    "stream_clip_runs",
    clips,
    f"""WITH {RELEASED}, o AS (SELECT *, abs(value) >= 0.6 AS hit, lag(ts) OVER w AS before, lag(abs(value) >= 0.6) OVER w AS prior FROM rel WINDOW w AS (PARTITION BY key ORDER BY ts)),
b AS (SELECT *, sum((before IS NULL OR NOT prior OR ts - before > INTERVAL 5 DAYS)::INT) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT key, run, min(ts) FILTER (hit) AS start, max(ts) FILTER (hit) AS last, count(*) FILTER (hit)::INT AS n, max(wm) AS wm, bool_or(NOT hit) AS ended FROM b GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1 AS final FROM r)
SELECT key, epoch_us(start) AS start, epoch_us(last) AS last, n FROM z WHERE n >= 2 AND (ended OR NOT final OR time_bucket(INTERVAL 6 HOURS, last + INTERVAL 5 DAYS) + INTERVAL 6 HOURS <= wm)""",
)
