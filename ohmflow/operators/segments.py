"""Anomaly segments: runs of anomalous hours of one series, and joins with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import HOUR, seconds

SERIES = ["building_id", "meter"]


def islands(rows: DataFrame, keys=SERIES, ts: str = "timestamp", gap_hours: int = 1) -> DataFrame:
    """rows and island: a series' running number of runs without a gap over gap_hours, from 1."""
    order = Window.partitionBy(*keys).orderBy("_seconds")
    based = rows.withColumn("_seconds", seconds(ts)).withColumn("_new", (F.col("_seconds") - F.coalesce(F.lag("_seconds").over(order), F.lit(-(10**15))) > gap_hours * HOUR).cast("int"))
    return based.withColumn("island", F.sum("_new").over(order)).drop("_new", "_seconds")


def segments(rows: DataFrame, keys=SERIES, label: str = "anomaly", value: str = "meter_reading", ts: str = "timestamp", gap_hours: int = 1, digits: int = 6) -> DataFrame:
    """keys, island, start, end, duration_rows, mean, low, high, slope: one row per run of anomalous rows."""
    runs = islands(rows.filter(F.col(label) == 1), keys, ts, gap_hours)
    found = runs.groupBy(*keys, "island").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("duration_rows"), F.avg(value).alias("_m"), F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(value, ts).alias("_first"), F.max_by(value, ts).alias("_last")
    )
    slope = F.try_divide(F.col("_last") - F.col("_first"), F.nullif(F.col("duration_rows") - 1, F.lit(0)).cast("double"))
    return found.select(*keys, "island", "start", "end", "duration_rows", F.round("_m", digits).alias("mean"), "low", "high", F.round(slope, digits).alias("slope"))


def phases(rows: DataFrame, keys=SERIES, label: str = "anomaly", ts: str = "timestamp", gap_hours: int = 1) -> DataFrame:
    """Anomalous rows with island and phase: onset in a run's first quarter, recovery in its last, else middle."""
    runs = islands(rows.filter(F.col(label) == 1), keys, ts, gap_hours)
    order, whole = Window.partitionBy(*keys, "island").orderBy(ts), Window.partitionBy(*keys, "island")
    part = F.try_divide((F.row_number().over(order) - 1).cast("double"), F.nullif(F.count("*").over(whole) - 1, F.lit(0)))
    return runs.withColumn("_part", F.coalesce(part, F.lit(0.0))).withColumn("phase", F.when(F.col("_part") <= 0.25, "onset").when(F.col("_part") >= 0.75, "recovery").otherwise("middle")).drop("_part")


def run_lengths(rows: DataFrame, keys=SERIES, label: str = "anomaly", ts: str = "timestamp") -> DataFrame:
    """keys, run, length: runs of positive rows that follow each other in the series, whatever the time between."""
    order = Window.partitionBy(*keys).orderBy(ts)
    numbered = rows.withColumn("_i", F.row_number().over(order)).filter(F.col(label) == 1)
    runs = numbered.withColumn("run", F.col("_i") - F.row_number().over(order))
    return runs.groupBy(*keys, "run").agg(F.count("*").alias("length"))


def run_summary(lengths: DataFrame, groups: list[str], long_run: int = 24, digits: int = 6) -> DataFrame:
    """groups, runs, rows, singleton_share, mean, p90, p99, long_share (rows in runs of at least long_run)."""
    r = lambda c, n: F.round(c, digits).alias(n)
    n = F.col("length")
    return lengths.groupBy(*groups).agg(
        F.count("*").alias("runs"), F.sum("length").alias("rows"), r(F.avg((n == 1).cast("double")), "singleton_share"), r(F.avg("length"), "mean"), r(F.percentile("length", 0.9), "p90"), r(F.percentile("length", 0.99), "p99"), r(F.try_divide(F.sum(F.when(n >= long_run, n).otherwise(0)).cast("double"), F.sum("length")), "long_share")
    )


def attach(rows: DataFrame, segs: DataFrame, keys=SERIES, ts: str = "timestamp", block_hours: int = 168) -> DataFrame:
    """rows and the first segment (island) whose span holds the row's time, null for none; repeated rows stay. Spans are cut into blocks of time, so
    the interval join is an equality join on (series, block) with a filter."""
    block = lambda c: F.floor(seconds(c) / (block_hours * HOUR))
    spans = segs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("island").alias("_island"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.sequence(block("start"), block("end"))).alias("_block"))
    on = F.col("_b") == F.col("_block")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    times = rows.select(*keys, ts).distinct().withColumn("_b", block(ts)).join(spans, on & F.col(ts).between(F.col("_start"), F.col("_end")))
    return rows.join(times.groupBy(*keys, ts).agg(F.min("_island").alias("segment")), [*keys, ts], "left").select(*rows.columns, "segment")


def anchor_window(rows: DataFrame, hours: int, keys=SERIES, label: str = "anomaly", value: str = "meter_reading", ts: str = "timestamp") -> DataFrame:
    """The rows within `hours` of the anomaly with the largest |ln ratio| to the reading one hour before, in its series."""
    order = Window.partitionBy(*keys).orderBy("_seconds")
    based = rows.withColumn("_seconds", seconds(ts)).withColumn("_before", F.max(value).over(order.rangeBetween(-HOUR, -HOUR)))
    ratio = F.abs(F.ln((F.col(value) + 1) / (F.col("_before") + 1)))
    pick = based.filter((F.col(label) == 1) & F.col("_before").isNotNull()).orderBy(F.desc(F.round(ratio, 9)), *keys, ts).limit(1)
    anchor = pick.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_seconds").alias("_at"))
    on = F.abs(F.col("_seconds") - F.col("_at")) <= hours * HOUR
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.withColumn("_seconds", seconds(ts)).join(F.broadcast(anchor), on).withColumn("offset_hours", ((F.col("_seconds") - F.col("_at")) / HOUR).cast("int")).select(*rows.columns, "offset_hours")


def concentration(items: DataFrame, value: str, owner: str, key: str, ks=(1, 5, 10), digits: int = 6) -> DataFrame:
    """k, share, top_owner_share: the share of all |value| that the k largest items hold, and their most frequent owner's
    part of them. The k largest come from a distributed limit."""
    total = items.agg(F.sum(F.abs(value)).alias("total"))
    top = items.select(owner, key, F.abs(value).alias("_v")).orderBy(F.desc("_v"), key).limit(max(ks))
    numbered = top.withColumn("_i", F.row_number().over(Window.orderBy(F.desc("_v"), key)))
    of = numbered.join(items.sparkSession.createDataFrame([(k,) for k in ks], "k int"), F.col("_i") <= F.col("k"))
    owners = of.groupBy("k", owner).agg(F.sum("_v").alias("_v"), F.count("*").alias("_n"))
    return owners.groupBy("k").agg(F.sum("_v").alias("_s"), F.max("_n").alias("_top"), F.sum("_n").alias("_all")).join(F.broadcast(total)).select("k", F.round(F.try_divide(F.col("_s"), F.col("total")), digits).alias("share"), F.round(F.col("_top") / F.col("_all"), digits).alias("top_owner_share"))
