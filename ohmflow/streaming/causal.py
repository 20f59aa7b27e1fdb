"""Streaming versions of what needs past readings only. Rows later than the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ohmflow.functions import scalar


def read_readings(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def value_changes(stream: DataFrame, hours: int, ts: str = "timestamp", late: str = "2 hours") -> DataFrame:
    """building_id, meter, timestamp, meter_reading and the change against exactly `hours` before: a stream-stream join whose state is bounded
    by the time range. Only past shifts can be causal."""
    if hours <= 0:
        raise ValueError("a stream has no future readings")
    now = stream.withWatermark(ts, late).alias("now")
    past = stream.select(F.col("building_id").alias("_b"), F.col("meter").alias("_m"), F.expr(f"{ts} + interval {hours} hours").alias("_at"), F.col("meter_reading").alias("_before")).withWatermark("_at", late).alias("past")
    on = (F.col("now.building_id") == F.col("_b")) & (F.col("now.meter") == F.col("_m")) & (F.col(f"now.{ts}") == F.col("_at"))
    return now.join(past, on, "leftOuter").select("building_id", "meter", ts, "meter_reading", (F.col("meter_reading") - F.col("_before")).alias(f"lag_value_diff_{hours}"), F.try_divide(F.col("meter_reading") + 1, F.col("_before") + 1).alias(f"lag_value_ratio_{hours}"))


def overrides(stream: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Scores after the hard rules; stateless. Needs score, meter_reading, masked."""
    day = F.dayofyear(ts) + F.hour(ts) / 24.0
    return stream.withColumn("score", scalar.override_rules(F.col("score"), F.col("meter_reading"), F.col("masked"), F.col(ts), day))


def segments(stream: DataFrame, label: str = "anomaly", ts: str = "timestamp", late: str = "2 hours") -> DataFrame:
    """building_id, meter, start, last (end of the session), duration_rows of anomaly sessions with gaps of one hour at most."""
    bad = stream.filter(F.col(label) == 1).withWatermark(ts, late)
    found = bad.groupBy("building_id", "meter", F.session_window(ts, "1 hour 1 second").alias("w")).agg(F.count("*").alias("duration_rows"), F.max(ts).alias("last"))
    return found.select("building_id", "meter", F.col("w.start").alias("start"), "last", "duration_rows")


def daily_completeness(stream: DataFrame, ts: str = "timestamp", late: str = "1 day") -> DataFrame:
    """building_id, meter, day, present, missing_rate of tumbling days."""
    rows = stream.filter("meter_reading is not null").withWatermark(ts, late)
    found = rows.groupBy("building_id", "meter", F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("present"))
    return found.select("building_id", "meter", F.col("w.start").alias("day"), "present", F.round(1 - F.col("present") / 24.0, 6).alias("missing_rate"))


def run_once(rows: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs what is there to a memory table, for tests and backfills."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)


def run_to_files(rows: DataFrame, folder: str) -> DataFrame:
    """Runs what is there to Parquet files under folder, beside the stream's state, and reads them back."""
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
