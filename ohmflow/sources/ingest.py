"""Sources: readings with labels, buildings and weather; wide meter archives; gates on schemas and keys."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmflow.functions import scalar

READINGS_SCHEMA = "row_id long, building_id int, meter byte, timestamp timestamp_ntz, meter_reading float"
BUILDING_SCHEMA = "building_id int, site_id byte, primary_use string, square_feet int, year_built int, floor_count int"
WEATHER_SCHEMA = "site_id byte, timestamp timestamp_ntz, air_temperature float, cloud_coverage int, dew_temperature float, precip_depth_1_hr float, sea_level_pressure float, wind_direction float, wind_speed float"


def require_columns(rows: DataFrame, columns: list[str], what: str = "table") -> None:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, keys: list[str], what: str = "table") -> None:
    if not duplicate_keys(rows, keys).isEmpty():
        raise ValueError(f"{what} repeats a key of {', '.join(keys)}")


def attach_labels(readings: DataFrame, labels: DataFrame, row_id: str = "row_id", label: str = "is_bad_meter_reading") -> DataFrame:
    """readings and anomaly. Labels are by row number, so both sides carry the row id that ingest gave them; the label
    table has exactly one other column, both have the same ids, and reading keys are unique."""
    if set(labels.columns) != {row_id, label}:
        raise ValueError(f"labels must have the columns {row_id} and {label}")
    require_unique(readings, ["building_id", "meter", "timestamp"], "readings")
    require_unique(labels, [row_id], "labels")
    both = readings.join(labels, row_id, "full_outer")
    if not both.filter(F.col(label).isNull() | F.col("building_id").isNull()).isEmpty():
        raise ValueError("labels and readings differ in length or row ids")
    return both.withColumnRenamed(label, "anomaly")


def clean_buildings(buildings: DataFrame) -> DataFrame:
    """Buildings with primary_use_code (alphabetical, null as Unknown) and log_square_feet."""
    return scalar.label_codes(buildings, "primary_use", "primary_use_code").withColumn("log_square_feet", F.round(F.log1p("square_feet"), 6))


def clean_weather(weather: DataFrame) -> DataFrame:
    """Weather with cloud coverage 255 (no view of the sky) as 10."""
    return weather.withColumn("cloud_coverage", F.when(F.col("cloud_coverage") == 255, 10).otherwise(F.col("cloud_coverage")))


def denormalise(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> DataFrame:
    """One row per reading with calendar, building and weather columns. The building table is small beside the readings;
    Spark broadcasts it under its own size limit. Readings without a building or weather keep nulls."""
    cal = scalar.calendar(F.col("timestamp"))
    based = readings.select("*", *[c.alias(n) for n, c in cal.items()])
    return based.join(buildings.drop("site_id") if "site_id" in readings.columns else buildings, "building_id", "left").join(weather, ["site_id", "timestamp"], "left")


def read_tables(spark: SparkSession, root: str) -> DataFrame:
    """The denormalised frame from four CSV files with declared schemas: no pass for inference."""
    read = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{root}/{name}.csv")
    labels = read("bad_meter_readings", "row_id long, is_bad_meter_reading int")
    return denormalise(attach_labels(read("train", READINGS_SCHEMA), labels), clean_buildings(read("building_metadata", BUILDING_SCHEMA)), clean_weather(read("weather_train", WEATHER_SCHEMA)))


def load_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Building metadata of a wide archive: unique non-null ids, overlap flag from the other dataset's id."""
    rows = spark.read.option("header", True).csv(f"{root}/metadata.csv")
    require_columns(rows, ["building_id", "site_id", "building_id_kaggle", "primaryspaceusage", "sqft", "timezone"], "metadata")
    if not rows.filter(~scalar.non_blank(F.col("building_id")) | F.col("building_id").isNull()).isEmpty():
        raise ValueError("metadata has a row without building_id")
    require_unique(rows, ["building_id"], "metadata")
    named = rows.withColumn("is_overlap", F.coalesce(scalar.non_blank(F.col("building_id_kaggle")), F.lit(False)))
    return named.withColumnsRenamed({"primaryspaceusage": "primary_use", "sqft": "square_feet", "yearbuilt": "year_built", "numberoffloors": "floor_count"})


def melt(wide: DataFrame, meter: str, known: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """building_id, meter, timestamp, meter_reading from one column per building; unknown buildings are refused."""
    require_columns(wide, ["timestamp", *(columns or [])], f"{meter} file")
    chosen = columns or [c for c in wide.columns if c != "timestamp"]
    if known is not None:
        given = wide.sparkSession.createDataFrame([(c,) for c in chosen], "building_id string")
        if not given.join(known, "building_id", "left_anti").isEmpty():
            raise ValueError(f"{meter} file has a building that metadata lacks")
    return wide.unpivot(["timestamp"], chosen, "building_id", "meter_reading").select("building_id", F.lit(meter).alias("meter"), "timestamp", "meter_reading")


def read_wide(spark: SparkSession, path: str, meter: str, known: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """melt() of a CSV file as strings. Lines are cut into fields where they are read: the plan has no column for each building, so it does not grow
    with them."""
    names = spark.read.option("header", True).csv(path).columns
    if "timestamp" not in names or set(columns or []) - set(names):
        raise ValueError(f"{meter} file lacks {', '.join(c for c in ['timestamp', *(columns or [])] if c not in names)}")
    chosen = columns or [c for c in names if c != "timestamp"]
    if known is not None:
        given = spark.createDataFrame([(c,) for c in chosen], "building_id string")
        if not given.join(known, "building_id", "left_anti").isEmpty():
            raise ValueError(f"{meter} file has a building that metadata lacks")
    place = {c: i for i, c in enumerate(names)}
    at, taken = place["timestamp"], [place[c] for c in chosen]

    def cut(batches):
        for batch in batches:
            for fields in csv.reader(batch["value"], escapechar="\\"):
                # every file begins with the header
                if fields and fields[at : at + 1] != ["timestamp"]:
                    values = [(fields[i] or None) if i < len(fields) else None for i in taken]
                    yield pd.DataFrame({"building_id": chosen, "timestamp": fields[at] or None if at < len(fields) else None, "meter_reading": pd.Series(values, dtype=object)})

    long = spark.read.text(path).mapInPandas(cut, "building_id string, timestamp string, meter_reading string")
    return long.select("building_id", F.lit(meter).alias("meter"), "timestamp", "meter_reading")


def load_archive(spark: SparkSession, root: str, meters: list[str], variant: str = "cleaned", buildings: list[str] | None = None, with_weather: bool = True) -> DataFrame:
    """The long frame of a wide archive: union of meter files, metadata, optional weather; keys are unique."""
    metadata = load_metadata(spark, root)
    suffix = {"cleaned": "_cleaned", "raw": ""}[variant]
    long = None
    for meter in meters:
        part = read_wide(spark, f"{root}/{meter}{suffix}.csv", meter, metadata.select("building_id"), buildings)
        part = part.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("meter_reading", F.col("meter_reading").cast("double"))
        long = part if long is None else long.unionByName(part)
    require_unique(long, ["building_id", "meter", "timestamp"], "archive")
    full = long.join(metadata, "building_id", "left")
    if not full.select("site_id").filter("site_id is null").isEmpty():
        raise ValueError("archive: a row has no site")
    return full if not with_weather else full.join(load_weather(spark, root), ["site_id", "timestamp"], "left")


def load_weather(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(f"{root}/weather.csv").withColumnRenamed("airTemperature", "air_temperature")
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("air_temperature", F.col("air_temperature").cast("double"))
    require_unique(rows, ["site_id", "timestamp"], "weather")
    return rows


def load_scoring(spark: SparkSession, root: str, meters: list[str]) -> DataFrame:
    """The frame to score: readings as they came."""
    return load_archive(spark, root, meters, variant="raw")


def union_shards(shards: list[DataFrame], canonical: DataFrame, key: str = "raw_index", label: str = "anomaly") -> DataFrame:
    """Prediction shards in canonical order; a lost, foreign or repeated row and a label that differs are refused."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s)
    require_unique(whole, [key], "shards")
    checked = whole.join(canonical.select(key, F.col(label).alias("_label")), key, "full_outer")
    if not checked.filter(F.col("_label").isNull() | F.col(label).isNull() | (F.col("_label") != F.col(label))).isEmpty():
        raise ValueError("shards and the canonical table differ")
    return whole.orderBy(key)


def read_meter_rows(spark: SparkSession, path: str, columns: list[str], meters: list) -> DataFrame:
    """Only these columns and meters of a Parquet table; both reach the scan."""
    return spark.read.parquet(path).filter(F.col("meter").isin(meters)).select(*columns)


def census(rows: DataFrame, label: str = "anomaly") -> DataFrame:
    """n_columns, rows, buildings, positives, series, meters of a table, in one aggregation."""
    return rows.agg(F.lit(len(rows.columns)).alias("n_columns"), F.count("*").alias("rows"), F.count_distinct("building_id").alias("buildings"), F.sum(label).alias("positives"), F.count_distinct("building_id", "meter").alias("series"), F.array_join(F.array_sort(F.collect_set(F.col("meter").cast("string"))), ",").alias("meters"))


def site_names(rows: DataFrame, site: str = "site_id", name: str = "site_name") -> DataFrame:
    """site, name pairs, refused unless they are one to one."""
    pairs = rows.select(site, name).distinct()
    require_unique(pairs, [site], "site names")
    require_unique(pairs, [name], "site names")
    return pairs
