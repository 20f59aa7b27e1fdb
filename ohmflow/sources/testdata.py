"""Adapters from the driver's tables to the domain: readings, buildings, weather and predictions; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmflow.operators.features import quantiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building_id, site_id, meter, timestamp, meter_reading: one row per building, meter and hour. Ten users are a building, so
    buildings grow with the table and their series stay as dense."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    keyed = events.select(F.floor(F.col("user_id") / 10).alias("building_id"), F.col("event_type").alias("meter"), hour.alias("timestamp"), "value")
    hourly = keyed.groupBy("building_id", "meter", "timestamp").agg(F.max("value").alias("meter_reading"))
    return hourly.select("building_id", (F.col("building_id") % 4).alias("site_id"), "meter", "timestamp", "meter_reading")


READINGS = """
r AS (
  SELECT user_id // 10 AS building_id, (user_id // 10) % 4 AS site_id, event_type AS meter, date_trunc('hour', ts) AS timestamp, max(value) AS meter_reading
  FROM events GROUP BY 1, 2, 3, 4)"""


def labelled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings and anomaly: 1 above the meter's 95th percentile."""
    rows = readings(spark, sf_dir)
    high = quantiles(rows, ["meter"], "meter_reading", [0.95]).select("meter", F.col("q")[0].alias("high"))
    return rows.join(F.broadcast(high), "meter").select("building_id", "site_id", "meter", "timestamp", "meter_reading", (F.col("meter_reading") > F.col("high")).cast("int").alias("anomaly"))


LABELLED = (
    READINGS
    + """,
q AS (SELECT meter, quantile_cont(meter_reading, 0.95) AS high FROM r GROUP BY meter),
a AS (SELECT r.*, CAST(meter_reading > high AS INTEGER) AS anomaly FROM r JOIN q USING (meter))"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_index, y, score_a, score_b, meter, building_id, site_id, reading: scores have many ties."""
    line = table(spark, sf_dir, "lineitem")
    raw = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    return line.select(
        raw.alias("raw_index"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.col("l_discount") * 10, 6).alias("score_a"),
        F.round(F.col("l_tax") * 10, 6).alias("score_b"),
        F.col("l_linestatus").alias("meter"),
        F.col("l_suppkey").alias("building_id"),
        (F.col("l_suppkey") % 16).alias("site_id"),
        F.col("l_quantity").alias("reading"),
    )


PREDICTIONS = """
p AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS raw_index, CAST(l_returnflag = 'R' AS INTEGER) AS y,
    round(l_discount * 10, 6) AS score_a, round(l_tax * 10, 6) AS score_b, l_linestatus AS meter, l_suppkey AS building_id,
    l_suppkey % 16 AS site_id, l_quantity AS reading
  FROM lineitem)"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building_id, site_id, primary_use, square_feet."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("building_id"), (F.col("c_nationkey") % 16).alias("site_id"), F.col("c_mktsegment").alias("primary_use"), F.abs("c_acctbal").alias("square_feet"))


BUILDINGS = """
b AS (SELECT c_custkey AS building_id, c_nationkey % 16 AS site_id, c_mktsegment AS primary_use, abs(c_acctbal) AS square_feet FROM customer)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, timestamp, air_temperature, cloud_coverage: one row per site and hour."""
    events = table(spark, sf_dir, "events").filter("event_type = 'view'")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return events.groupBy((F.col("user_id") % 4).alias("site_id"), hour.alias("timestamp")).agg(F.max("value").alias("air_temperature"), F.max(F.when(F.col("event_id") % 7 == 0, 255).otherwise(F.col("event_id") % 9)).alias("cloud_coverage"))


WEATHER = """
w AS (
  SELECT user_id % 4 AS site_id, date_trunc('hour', ts) AS timestamp, max(value) AS air_temperature,
    max(CASE WHEN event_id % 7 = 0 THEN 255 ELSE event_id % 9 END) AS cloud_coverage
  FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""
