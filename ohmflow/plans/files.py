"""Queries of file sources and sinks: tables are written to the scratch folder in the formats of the loaders and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.plans.registry import query
from ohmflow.sources import ingest, sinks
from ohmflow.sources import testdata as td

METERS = ["click", "error", "purchase", "signup", "view"]
CODE = "list_position(['" + "', '".join(METERS) + "'], meter) - 1"
ROW = f"(building_id * 10 + {CODE}) * 10000000 + CAST(floor(epoch(a.timestamp) / 3600) AS BIGINT)"


def numbered(rows):
    """Readings with the meter's code, and a row id that their key makes."""
    meter = (F.array_position(F.array(*map(F.lit, METERS)), F.col("meter")) - 1).cast("long")
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz '1970-01-01 00:00:00', timestamp)")
    return rows.withColumn("meter", meter).withColumn("row_id", (F.col("building_id") * 10 + F.col("meter")) * 10000000 + hours)


@query(f"""WITH {td.LABELLED}, {td.BUILDINGS.strip()}, {td.WEATHER.strip()}, c AS (SELECT building_id, site_id, dense_rank() OVER (ORDER BY coalesce(primary_use, 'Unknown')) - 1 AS primary_use_code, round(ln(1 + CAST(trunc(square_feet) AS INTEGER)), 6) AS log_square_feet FROM b)
SELECT {ROW} AS row_id, a.building_id, {CODE} AS meter, a.timestamp, CAST(a.meter_reading AS FLOAT) AS meter_reading, a.anomaly, c.site_id, c.primary_use_code, c.log_square_feet, CAST(w.air_temperature AS FLOAT) AS air_temperature, CASE WHEN w.cloud_coverage = 255 THEN 10 ELSE w.cloud_coverage END AS cloud_coverage
FROM a LEFT JOIN c USING (building_id) LEFT JOIN w ON w.site_id = c.site_id AND w.timestamp = a.timestamp""")
def frame_from_files(spark, sf):
    rows, root = numbered(td.labelled_readings(spark, sf)), sinks.scratch_folder(spark, "frame")
    none = F.lit(None).cast("int")
    files = {
        "train": rows.select("row_id", "building_id", "meter", "timestamp", "meter_reading"),
        "bad_meter_readings": rows.select("row_id", F.col("anomaly").alias("is_bad_meter_reading")),
        "building_metadata": td.buildings(spark, sf).select("building_id", "site_id", "primary_use", F.col("square_feet").cast("int").alias("square_feet"), none.alias("year_built"), none.alias("floor_count")),
        "weather_train": td.weather(spark, sf).select("site_id", "timestamp", "air_temperature", "cloud_coverage", *[none.alias(c) for c in ("dew_temperature", "precip_depth_1_hr", "sea_level_pressure", "wind_direction", "wind_speed")]),
    }
    for name, table in files.items():
        sinks.write_csv(table, f"{root}/{name}.csv")
    return ingest.read_tables(spark, root).select("row_id", "building_id", "meter", "timestamp", "meter_reading", "anomaly", "site_id", "primary_use_code", "log_square_feet", "air_temperature", "cloud_coverage")


@query(f"WITH {td.PREDICTIONS} SELECT raw_index, score_b, meter FROM p WHERE meter = 'O'")
def rows_of_one_meter(spark, sf):
    path = sinks.scratch_folder(spark, "meters")
    sinks.write_parquet(td.predictions(spark, sf), path, ["meter"])
    return ingest.read_meter_rows(spark, path, ["raw_index", "score_b", "meter"], ["O"])


@query(f"WITH {td.PREDICTIONS} SELECT raw_index AS row_id, score_a AS anomaly FROM p")
def submitted_scores(spark, sf):
    path = sinks.scratch_folder(spark, "submission")
    sinks.submission(td.predictions(spark, sf).select(F.col("raw_index").alias("row_id"), F.col("score_a").alias("score"), "meter"), path)
    return spark.read.schema("row_id long, anomaly double").option("header", True).csv(path)


@query(f"WITH {td.PREDICTIONS} SELECT site_id, meter, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, 'r1' AS revision, true AS dated FROM p GROUP BY 1, 2")
def recorded_metrics(spark, sf):
    found, path = td.predictions(spark, sf).groupBy("site_id", "meter").agg(F.count("*").alias("rows"), F.sum("y").alias("positives")), sinks.scratch_folder(spark, "metrics")
    sinks.write_json(found, path, "r1")
    read = spark.read.schema("site_id long, meter string, rows long, positives long, revision string, generated_at_utc string").json(path)
    return read.withColumn("dated", F.col("generated_at_utc").isNotNull()).drop("generated_at_utc")


@query(f"WITH {td.READINGS} SELECT building_id || '/' || meter AS unit_id, count(*) AS rows, md5(building_id || '/' || meter || '/' || count(*)) AS digest FROM r WHERE building_id % 3 <> 0 GROUP BY building_id, meter")
def unfinished_units(spark, sf):
    unit = F.concat_ws("/", F.col("building_id").cast("string"), "meter")
    units = td.readings(spark, sf).groupBy("building_id", unit.alias("unit_id")).agg(F.count("*").alias("rows")).withColumn("digest", F.md5(F.concat_ws("/", "unit_id", F.col("rows").cast("string"))))
    path = sinks.scratch_folder(spark, "done")
    sinks.write_parquet(units.filter("building_id % 3 = 0").select("unit_id", "digest"), path)
    return sinks.pending(units.drop("building_id"), spark.read.parquet(path))
