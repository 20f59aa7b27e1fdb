"""Queries of the streaming operators: the events as a file stream, run to the end of what is there. Rows whose window, session or
partner the last watermark leaves open are not given out, and the SQL says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmflow.operators.features import seconds
from ohmflow.plans.registry import query
from ohmflow.sources import sinks
from ohmflow.streaming import causal, history

EVENTS = "e AS (SELECT user_id // 10 AS building_id, event_type AS meter, date_trunc('hour', ts) AS timestamp, value AS meter_reading FROM events)"


def readings(spark, sf: str) -> DataFrame:
    """building_id, meter, timestamp, meter_reading: a row per event. Times are instants in UTC, whatever the session's zone."""
    # a stream's path may be a folder or a pattern, but no single file
    events = causal.read_readings(spark, f"{sf}/events.parque[t]", spark.read.parquet(f"{sf}/events.parquet").schema)
    hour = F.timestamp_seconds(F.floor(seconds("ts") / 3600) * 3600)
    return events.select(F.floor(F.col("user_id") / 10).alias("building_id"), F.col("event_type").alias("meter"), hour.alias("timestamp"), F.col("value").alias("meter_reading"))


def zoneless(instant: str) -> Column:
    return F.timestamp_add("SECOND", F.unix_seconds(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def finished(rows: DataFrame, tag: str, *times: str) -> DataFrame:
    with history.rocks_state(rows.sparkSession):
        done = causal.run_to_files(rows, sinks.scratch_folder(rows.sparkSession, tag))
    return done.withColumns({t: zoneless(t) for t in times})


@query(f"""WITH {EVENTS}, m AS (SELECT max(timestamp) - INTERVAL 2 HOUR AS mark FROM e)
SELECT n.building_id, n.meter, n.timestamp, n.meter_reading, n.meter_reading - b.meter_reading AS lag_value_diff_1, round((n.meter_reading + 1) / (b.meter_reading + 1), 6) AS lag_value_ratio_1
FROM m, e n LEFT JOIN e b ON b.building_id = n.building_id AND b.meter = n.meter AND b.timestamp + INTERVAL 1 HOUR = n.timestamp WHERE b.timestamp IS NOT NULL OR n.timestamp <= mark""")
def streamed_changes(spark, sf):
    done = finished(causal.value_changes(readings(spark, sf), 1), "changes", "timestamp")
    return done.withColumn("lag_value_ratio_1", F.round("lag_value_ratio_1", 6))


@query(f"""WITH {EVENTS} SELECT building_id, meter, timestamp, CASE WHEN dayofyear(timestamp) + hour(timestamp) / 24.0 > dayofyear(make_date(year(timestamp), 12, 31)) + 22.5 / 24 THEN 0.0 WHEN building_id % 3 = 0 THEN 0.0
WHEN meter_reading = 1 THEN 1.0 ELSE round(least(meter_reading / 1000, 1), 6) END AS score FROM e""")
def streamed_overrides(spark, sf):
    rows = readings(spark, sf).withColumn("timestamp", zoneless("timestamp")).withColumn("score", F.round(F.least(F.col("meter_reading") / 1000, F.lit(1.0)), 6)).withColumn("masked", F.col("building_id") % 3 == 0)
    return finished(causal.overrides(rows).select("building_id", "meter", "timestamp", "score"), "rules")


@query(f"""WITH {EVENTS}, a AS (SELECT * FROM e WHERE meter_reading > 40), g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY building_id, meter ORDER BY timestamp) AS session FROM g), t AS (SELECT building_id, meter, min(timestamp) AS start, max(timestamp) AS last, count(*) AS duration_rows FROM s GROUP BY building_id, meter, session)
SELECT * FROM t WHERE last + INTERVAL 3601 SECOND <= (SELECT max(timestamp) - INTERVAL 2 HOUR FROM a)""")
def streamed_segments(spark, sf):
    rows = readings(spark, sf).withColumn("anomaly", (F.col("meter_reading") > 40).cast("int"))
    return finished(causal.segments(rows), "sessions", "start", "last")


@query(f"""WITH {EVENTS}, d AS (SELECT building_id, meter, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS day, count(*) AS present, round(1 - count(*) / 24.0, 6) AS missing_rate FROM e WHERE meter_reading IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 DAY FROM e WHERE meter_reading IS NOT NULL)""")
def streamed_completeness(spark, sf):
    return finished(causal.daily_completeness(readings(spark, sf)), "days", "day")


SHIFTED = ", ".join(f"round(n.meter_reading - b{n}.high + 1e-9, 6) AS lag_value_diff_{n}, round((n.meter_reading + 1) / nullif(b{n}.high + 1, 0) + 1e-9, 6) AS lag_value_ratio_{n}" for n in history.CAUSAL_SHIFTS)
JOINED = " ".join(f"LEFT JOIN h b{n} ON b{n}.building_id = n.building_id AND b{n}.meter = n.meter AND b{n}.timestamp = n.timestamp - INTERVAL {n} HOUR" for n in history.CAUSAL_SHIFTS)


@query(f"""WITH {EVENTS}, m AS (SELECT max(timestamp) - INTERVAL 2 HOUR AS mark FROM e), h AS (SELECT building_id, meter, timestamp, max(meter_reading) AS high FROM e GROUP BY ALL)
SELECT n.building_id, n.meter, n.timestamp, n.meter_reading, {SHIFTED} FROM m, e n {JOINED} WHERE n.timestamp <= mark""")
def streamed_causal_features(spark, sf):
    """The whole causal set of a series in one stream."""
    return finished(history.causal_features(readings(spark, sf), digits=6), "causal", "timestamp")
