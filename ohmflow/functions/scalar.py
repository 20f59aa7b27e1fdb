"""Column functions: calendar, categories, rules, priorities. All are built-in expressions, so they stay in one stage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Meter codes.
METER_CODES = {"electricity": 0, "chilledwater": 1, "steam": 2, "hotwater": 3, "gas": 4, "water": 5, "irrigation": 6, "solar": 7}
BASELINE_SHIFTS = (*range(-30, 0), *range(1, 31))


def calendar(ts: Column) -> dict[str, Column]:
    """hour, weekday (Monday 0), month, and day of the year with the hour as its fraction."""
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts), "dayofyear": F.round(F.dayofyear(ts) + F.hour(ts) / 24.0, 4)}


def cyclic(ts: Column, digits: int = 6) -> dict[str, Column]:
    """Sine and cosine of hour, weekday and month."""
    out = {}
    for name, value, period in (("hour", F.hour(ts), 24), ("weekday", F.weekday(ts), 7), ("month", F.month(ts) - 1, 12)):
        angle = value * (2 * math.pi / period)
        out |= {f"{name}_sin": F.round(F.sin(angle), digits), f"{name}_cos": F.round(F.cos(angle), digits)}
    return out


def holiday_country(zone: Column) -> Column:
    """Country whose holidays a time zone follows."""
    return F.when(zone.startswith("US/"), "US").when(zone == "Europe/Dublin", "IE").when(zone == "Europe/London", "GB").otherwise("US")


def holidays(rows: DataFrame, table: DataFrame, ts: str = "timestamp", zone: str = "timezone") -> DataFrame:
    """rows and is_holiday, from a table (country, date) of holidays."""
    days = table.select(F.col("country").alias("_country"), F.col("date").cast("date").alias("_date")).distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(days, (holiday_country(F.col(zone)) == F.col("_country")) & (F.to_date(ts) == F.col("_date")), "left")
    return joined.withColumn("is_holiday", F.coalesce("_hit", F.lit(False))).drop("_country", "_date", "_hit")


def unit_correction(reading: Column, site: Column, meter: Column, factor: float = 0.2931) -> Column:
    """Readings of site 0's electricity meters in the other unit."""
    return F.when((site == 0) & (meter == 0), reading * factor).otherwise(reading)


def use_meter(primary_use: Column, meter: Column) -> Column:
    """Interaction category of use and meter."""
    return F.concat_ws("_", F.coalesce(primary_use, F.lit("Unknown")), meter.cast("string"))


def label_codes(rows: DataFrame, column: str, name: str, missing: str = "Unknown") -> DataFrame:
    """rows and the alphabetical code of a category from 0; null counts as `missing`. Only the distinct values are ranked."""
    codes = category_codes(rows, column, missing)
    return rows.withColumn("_value", F.coalesce(F.col(column).cast("string"), F.lit(missing))).join(codes.withColumnRenamed("code", name), "_value").drop("_value")


def category_codes(rows: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    """_value, code of the distinct categories: a code is the number of smaller categories."""
    values = rows.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("_value")).distinct()
    smaller = values.alias("x").join(values.alias("y"), F.col("y._value") < F.col("x._value"), "left")
    return smaller.groupBy(F.col("x._value").alias("_value")).agg(F.count("y._value").cast("int").alias("code"))


def map_codes(rows: DataFrame, codes: DataFrame, column: str, name: str, missing: str = "Unknown") -> DataFrame:
    """rows and another table's code of the category, -1 where it has none."""
    keyed = rows.withColumn("_value", F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    return keyed.join(codes.withColumnRenamed("code", name), "_value", "left").withColumn(name, F.coalesce(name, F.lit(-1))).drop("_value")


def normal_category(value: Column) -> Column:
    return F.replace(F.trim(F.lower(F.coalesce(value, F.lit("")))), F.lit("_"), F.lit(" "))


def non_blank(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def shift_names(shifts) -> list[str]:
    return [f"lag_value_{kind}_{n}" for kind in ("diff", "ratio") for n in shifts]


def feature_names(tag: str, baseline: list[str], shifts=BASELINE_SHIFTS) -> list[str]:
    """Columns of a feature set: baseline, full (both directions), causal (past shifts only), or no_<group>."""
    if tag == "baseline":
        return list(baseline)
    if tag == "causal":
        return [*baseline, *shift_names([n for n in shifts if n > 0])]
    if tag == "full":
        return [*baseline, *shift_names(shifts)]
    if tag == "no_diff" or tag == "no_ratio":
        return [c for c in [*baseline, *shift_names(shifts)] if not c.startswith(f"lag_value_{tag[3:]}_")]
    raise ValueError(f"unknown feature set {tag}")


def correlated_group(name: str, names: list[str]) -> list[str]:
    """A shift feature's near relatives: the other kind at the same shift and its own kind one shift away."""
    parts = name.split("_")
    if name not in names or parts[:2] != ["lag", "value"]:
        return [name]
    kind, n = parts[2], int(parts[3])
    other = {"diff": "ratio", "ratio": "diff"}[kind]
    near = [name, f"lag_value_{other}_{n}", f"lag_value_{kind}_{n - 1}", f"lag_value_{kind}_{n + 1}"]
    return [c for c in near if c in names]


def end_of_year(ts: Column, dayofyear: Column) -> Column:
    """The last hour of a year, by the year's own length."""
    days = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    return dayofyear > days + 22.5 / 24


def override_rules(score: Column, reading: Column, mask: Column, ts: Column, dayofyear: Column, use_mask: bool = True, use_year_end: bool = True) -> Column:
    """A reading of 1 scores 1; then masked rows and the year's last hour score 0. A later rule wins."""
    out = F.when(reading == 1, F.lit(1.0)).otherwise(score)
    if use_mask:
        out = F.when(mask, F.lit(0.0)).otherwise(out)
    return F.when(end_of_year(ts, dayofyear), F.lit(0.0)).otherwise(out) if use_year_end else out


def new_year_rule(score: Column, building: Column, dayofyear: Column, low: int = 105, high: int = 145) -> Column:
    """Scores of 1 January outside a range of buildings are 0."""
    return F.when((F.floor(dayofyear) == 1) & ((building > high) | (building < low)), F.lit(0.0)).otherwise(score)


def log_odds(score: Column, clip: float = 1e-7) -> Column:
    p = F.greatest(F.least(score, F.lit(1 - clip)), F.lit(clip))
    return F.ln(p / (1 - p))


def band(value: Column, edges: list[float]) -> Column:
    """Index of the interval [edge i, edge i + 1) that holds the value, the ends open."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(value < edges[i], F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)


def priority(seed: int, key: Column) -> Column:
    """Stable priority of a row: the same text in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def jitter(key: Column, width: float, seed: int = 0) -> Column:
    """Deterministic offset in [-width / 2, width / 2) from a row's key."""
    return (F.conv(F.substring(priority(seed, key), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5) * width


def building_mean_fill(rows: DataFrame, columns: list[str], building: str = "building_id") -> DataFrame:
    """Nulls take the building's mean, 0 where it has none. Means are aggregated and joined, so no building's rows meet in one task."""
    means = rows.groupBy(building).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return rows.join(means, building, "left").select(*[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) if c in columns else c for c in rows.columns])


def context_tag(tag: str) -> dict:
    """An intervention's parameters from its name."""
    kind, *args = tag.split(":")
    if kind in ("pooled_reference", "meter_balanced", "site_balanced", "site_meter_balanced") and not args:
        return {"kind": kind}
    if kind == "meter_heavy" and len(args) == 2 and 0 < float(args[1]) < 1:
        return {"kind": kind, "meter": args[0], "share": float(args[1])}
    if kind == "meter_excluded" and len(args) == 1:
        return {"kind": kind, "meter": args[0]}
    if kind == "site_source" and len(args) == 1:
        return {"kind": kind, "site": args[0]}
    raise ValueError(f"unknown context {tag}")


def causal_columns(columns: list[str]) -> list[str]:
    """Feature columns without those of future (negative) shifts."""
    return [c for c in columns if not (c.startswith("lag_value_") and c.rsplit("_", 1)[1].startswith("-"))]
