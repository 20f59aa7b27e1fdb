"""Time features of meter series. A series is (building, meter); all shifts of a series come from one sort of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators.scan import prefix_sums

HOUR = 3600
#: Added before rounding, so that exact halves round up in any engine.
TIE = 1e-9


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, from its fields, so that no session zone's clock change moves it; the order
    key of hour-exact frames."""
    t = F.col(ts).cast("timestamp_ntz")
    return F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def shifted(regime: str, n: int, value: str, ts: str, keys: list[str], meter: str) -> Column:
    """The value n hours (or rows) before; later for negative n. Hours are exact: a gap gives null."""
    if regime == "timestamp":
        frame = Window.partitionBy(*keys).orderBy("_seconds").rangeBetween(-n * HOUR, -n * HOUR)
        return F.max(value).over(frame)
    if regime not in ("row_offset", "row_offset_meter"):
        raise ValueError(f"unknown regime {regime}")
    order = Window.partitionBy(*keys).orderBy(ts, meter)
    return F.lag(value, n).over(order) if n > 0 else F.lead(value, -n).over(order)


def quantiles(rows: DataFrame, groups: list[str], value: str, points: list[float], name: str = "q") -> DataFrame:
    """groups and an array of exact quantiles, interpolated between neighbours; nulls skipped. Values are counted first and dealt to ranges of
    equal counts, so that neither a large group nor an odd value is one task's work."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    scanned = prefix_sums(counts, groups, value, {"c": "_n"})
    ranked = scanned.select(*groups, F.col(value).alias("_v"), (F.col("c_before") + F.col("_n")).alias("_upto"), F.col("c_total").alias("_total"))
    out = []
    for p in points:
        at = F.floor(F.lit(p) * (F.col("_total") - 1))
        low, high = F.min(F.when(F.col("_upto") > at, F.col("_v"))), F.min(F.when(F.col("_upto") > at + 1, F.col("_v")))
        weight = F.max(F.lit(p) * (F.col("_total") - 1) - at)
        out.append(F.when(weight > 0, low + (high - low) * weight).otherwise(low).cast("double"))
    return ranked.groupBy(*groups).agg(F.array(*out).alias(name))


def value_changes(rows: DataFrame, shifts, regime: str = "timestamp", orientation: str = "current_first", value: str = "meter_reading", ts: str = "timestamp", building: str = "building_id", meter: str = "meter", extra_keys: tuple = (), digits: int | None = None) -> DataFrame:
    """rows and lag_value_diff_n, lag_value_ratio_n for every shift n.

    timestamp: the same series exactly n hours before (unique timestamps per series are needed); timestamp_building: the same
    without the meter in the key, the highest reading of the hour; row_offset: n rows before in the building, whatever the meter; row_offset_meter: n rows
    before in the series. orientation: current_first r(t) - r(t-n) and (r(t)+1)/(r(t-n)+1), or shifted_first. A ratio over 0
    is null. extra_keys, such as a split's side, keep series apart."""
    keys = [building, *extra_keys] if regime in ("row_offset", "timestamp_building") else [building, meter, *extra_keys]
    plain = "timestamp" if regime == "timestamp_building" else regime
    based = rows.withColumn("_seconds", seconds(ts))
    based = based.select("*", *[shifted(plain, n, value, ts, keys, meter).alias(f"_s{n}") for n in shifts])
    trim = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = []
    for n in shifts:
        a, b = (F.col(value), F.col(f"_s{n}")) if orientation == "current_first" else (F.col(f"_s{n}"), F.col(value))
        out += [trim(a - b).alias(f"lag_value_diff_{n}"), trim(F.try_divide(a + 1, b + 1)).alias(f"lag_value_ratio_{n}")]
    return based.select(*rows.columns, *out)


def contiguous_diffs(rows: DataFrame, hours=(1, 24, 168), value: str = "meter_reading", ts: str = "timestamp", keys=("building_id", "meter"), digits: int = 6) -> DataFrame:
    """rows and diff_n, ratio_n over the reading n rows before, kept only where it is exactly n hours before."""
    order = Window.partitionBy(*keys).orderBy("_seconds")
    based = rows.withColumn("_seconds", seconds(ts))
    based = based.select("*", *[F.lag(value, n).over(order).alias(f"_v{n}") for n in hours], *[F.lag("_seconds", n).over(order).alias(f"_t{n}") for n in hours])
    out = []
    for n in hours:
        before = F.when(F.col("_seconds") - F.col(f"_t{n}") == n * HOUR, F.col(f"_v{n}"))
        out += [F.round(F.col(value) - before, digits).alias(f"diff_{n}"), F.round(F.try_divide(F.col(value), F.nullif(before, F.lit(0.0))), digits).alias(f"ratio_{n}")]
    return based.select(*rows.columns, *out)


def lag_and_rolling(rows: DataFrame, columns: list[str], windows=(7, 73), key: str = "site_id", ts: str = "timestamp", digits: int = 6) -> DataFrame:
    """rows and, per column and window w, the value w rows before and the mean of the last w rows (nulls skipped)."""
    order = Window.partitionBy(key).orderBy(ts)
    out = []
    for c in columns:
        for w in windows:
            out += [F.lag(c, w).over(order).alias(f"{c}_lag_{w}"), F.round(F.avg(c).over(order.rowsBetween(-(w - 1), 0)) + TIE, digits).alias(f"{c}_mean_{w}")]
    return rows.select("*", *out)


#: Weights of a cubic fit over five points, for an inner row and for the first two rows; the last two mirror them.
SMOOTH_INNER = (-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35)
SMOOTH_FIRST = ((69 / 70, 4 / 70, -6 / 70, 4 / 70, -1 / 70), (2 / 35, 27 / 35, 12 / 35, -8 / 35, 2 / 35))


def smooth_residual(rows: DataFrame, value: str = "meter_reading", ts: str = "timestamp", keys=("building_id", "meter"), digits: int = 6) -> DataFrame:
    """rows and smooth_residual: value less its five-point cubic fit, after gaps are filled forward, backward, then 0; null in shorter series."""
    order = Window.partitionBy(*keys).orderBy(ts)
    filled = F.coalesce(F.last(value, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    based = rows.withColumn("_f", filled).select("*", F.row_number().over(order).alias("_i"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    at = lambda k: F.col("_f") if k == 0 else (F.lead("_f", k).over(order) if k > 0 else F.lag("_f", -k).over(order))
    dot = lambda weights, offset, sign=1: sum((w * at(sign * (k - offset)) for k, w in enumerate(weights)), F.lit(0.0))
    fit = (
        F.when(F.col("_n") < 5, None)
        .when(F.col("_i") == 1, dot(SMOOTH_FIRST[0], 0))
        .when(F.col("_i") == 2, dot(SMOOTH_FIRST[1], 1))
        .when(F.col("_i") == F.col("_n"), dot(SMOOTH_FIRST[0], 0, -1))
        .when(F.col("_i") == F.col("_n") - 1, dot(SMOOTH_FIRST[1], 1, -1))
        .otherwise(dot(SMOOTH_INNER, 2))
    )
    return based.withColumn("smooth_residual", F.round(F.col("_f") - fit, digits)).select(*rows.columns, "smooth_residual")


def target_encoding(rows: DataFrame, keys: list[str], label: str, weight: float = 20.0, digits: int = 6) -> DataFrame:
    """keys, n, encoded: (sum + weight * mean) / (n + weight), mean over all rows. Fit it on training rows only."""
    whole = rows.agg(F.avg(label).alias("_mean"))
    return rows.groupBy(*keys).agg(F.count(label).alias("n"), F.sum(label).alias("_s")).join(F.broadcast(whole)).select(*keys, "n", F.round((F.col("_s") + weight * F.col("_mean")) / (F.col("n") + weight), digits).alias("encoded"))


def apply_encoding(rows: DataFrame, encoding: DataFrame, keys: list[str], fallback: float) -> DataFrame:
    """rows and encoded; unseen keys take the fallback, the training mean."""
    return rows.join(encoding.select(*keys, "encoded"), keys, "left").withColumn("encoded", F.coalesce("encoded", F.lit(fallback)))


def regime_contamination(rows: DataFrame, shifts, digits: int = 6) -> DataFrame:
    """shift, n, changed, null_mismatch, median_abs, p95_abs: what row offsets across meters change against offsets within a series."""
    columns = ["building_id", "meter", "timestamp"]
    a = value_changes(rows, shifts, "row_offset").select(*columns, *[F.col(f"lag_value_diff_{n}").alias(f"a{n}") for n in shifts])
    b = value_changes(rows, shifts, "row_offset_meter").select(*columns, *[F.col(f"lag_value_diff_{n}").alias(f"b{n}") for n in shifts])
    long = a.join(b, columns).select(F.explode(F.array(*[F.struct(F.lit(n).alias("shift"), F.col(f"a{n}").alias("a"), F.col(f"b{n}").alias("b")) for n in shifts])).alias("x")).select("x.*")
    d = F.abs(F.col("a") - F.col("b"))
    return long.groupBy("shift").agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("null_mismatch"), F.round(F.percentile(d, 0.5), digits).alias("median_abs"), F.round(F.percentile(d, 0.95), digits).alias("p95_abs"))


def reading_regimes(rows: DataFrame, value: str = "meter_reading", group: str = "meter", fixed: dict[str, float] | None = None) -> DataFrame:
    """rows and regime: low to the group's first quartile, high from its third, else middle; groups in `fixed` are cut at one value."""
    cuts = quantiles(rows, [group], value, [0.25, 0.75], "_q")
    regime = F.when(F.col(value) <= F.col("_q")[0], "low").when(F.col(value) >= F.col("_q")[1], "high").otherwise("middle")
    for name, cut in (fixed or {}).items():
        regime = F.when(F.col(group) == name, F.when(F.col(value) <= cut, "low").otherwise("high")).otherwise(regime)
    return rows.join(F.broadcast(cuts), group).withColumn("regime", regime).select(*rows.columns, "regime")


def rank_bins(items: DataFrame, value: str, key: str, labels: list[str], zero: str | None = None) -> DataFrame:
    """items (a small table of groups) and bin: by the share of items at or before each in the order of value, then key; zero values in a bin of their own."""
    some = items if zero is None else items.filter(F.col(value) > 0)
    order = Window.orderBy(value, key)
    share = F.row_number().over(order) / F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = some.withColumn("_share", share)
    cell = F.least(F.ceil(F.col("_share") * len(labels)), F.lit(len(labels)))
    out = ranked.withColumn("bin", F.element_at(F.array(*[F.lit(x) for x in labels]), cell.cast("int"))).drop("_share")
    return out if zero is None else out.unionByName(items.filter(F.col(value) <= 0).withColumn("bin", F.lit(zero)))


def quartile_labels(rows: DataFrame, value: str) -> DataFrame:
    """rows and quartile: the interval of distinct quartile edges that holds the value, from 0; tied edges merge."""
    edges = quantiles(rows, [], value, [0.0, 0.25, 0.5, 0.75, 1.0], "_e").withColumn("_e", F.array_distinct("_e"))
    inner = F.expr("slice(_e, 2, greatest(size(_e) - 2, 0))")
    return rows.join(F.broadcast(edges)).withColumn("_inner", inner).withColumn("quartile", F.size(F.filter("_inner", lambda e: e < F.col(value)))).drop("_e", "_inner")


def hourly_fill(rows: DataFrame, columns: list[str], key: str = "site_id", ts: str = "timestamp", digits: int = 6) -> DataFrame:
    """key, timestamp of every hour from a site's first to its last, and columns interpolated in time between known values."""
    spans = rows.groupBy(key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    hours = spans.select(key, F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias(ts))
    full = hours.join(rows.select(key, ts, *columns), [key, ts], "left").withColumn("_t", seconds(ts))
    before, after = Window.partitionBy(key).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("_t").rowsBetween(0, Window.unboundedFollowing)
    out = []
    for c in columns:
        t = F.when(F.col(c).isNotNull(), F.col("_t"))
        a, b, ta, tb = F.last(c, True).over(before), F.first(c, True).over(after), F.last(t, True).over(before), F.first(t, True).over(after)
        out.append(F.round(F.coalesce(F.col(c).cast("double"), a + F.try_divide((b - a) * (F.col("_t") - ta), (tb - ta).cast("double")), a.cast("double")) + TIE, digits).alias(c))
    return full.select(key, ts, *out)


def z_scores(rows: DataFrame, value: str, key: str, name: str = "z", digits: int = 6) -> DataFrame:
    """rows and the value's z-score in its group (sample deviation); null without spread."""
    stats = rows.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return rows.join(stats, key, "left").withColumn(name, F.round(F.try_divide(F.col(value) - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))), digits)).select(*rows.columns, name)


def robust_load_z(rows: DataFrame, value: str, key: str, sigmas: float = 10.0, digits: int = 6) -> DataFrame:
    """rows and z: log1p of the value, standardised per group after values beyond `sigmas` deviations are masked."""
    first = z_scores(rows, value, key, "_z", 9)
    masked = first.withColumn("_l", F.when(F.abs("_z") <= sigmas, F.log1p(F.greatest(F.col(value), F.lit(0.0)))))
    return z_scores(masked, "_l", key, "z", digits).select(*rows.columns, "z")


def lag_correlations(pairs: DataFrame, other: DataFrame, key: str, a: str, b: str, lags: range = range(-12, 13), least: int = 1000, ts: str = "timestamp", digits: int = 6) -> DataFrame:
    """key, lag, n, corr of a at t and b at t + lag hours; lags with fewer than `least` pairs have null corr. Each row is copied once per lag and joined by hour."""
    moved = other.select(key, F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag"), F.col(ts), F.col(b)).withColumn(ts, F.expr(f"timestampadd(HOUR, -lag, {ts})"))
    joined = pairs.select(key, ts, a).join(moved, [key, ts])
    return joined.groupBy(key, "lag").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= least, F.corr(a, b)), digits).alias("corr"))


def best_lag(correlations: DataFrame, key: str) -> DataFrame:
    """key, lag, corr of the strongest correlation either way, the smallest lag on ties."""
    best = correlations.filter("corr is not null").groupBy(key).agg(F.max(F.struct(F.abs("corr").alias("s"), (-F.col("lag")).alias("l"), F.col("corr").alias("c"))).alias("b"))
    return best.select(key, (-F.col("b.l")).alias("lag"), F.col("b.c").alias("corr"))


def peak_hours(rows: DataFrame, keys: list[str], value: str, ts: str = "timestamp", digits: int = 6) -> DataFrame:
    """keys, peak_hour, trough_hour, peak_mean of the mean daily profile; the earlier hour on ties."""
    by_hour = rows.groupBy(*keys, F.hour(ts).alias("h")).agg(F.round(F.avg(value), digits).alias("m"))
    best = by_hour.groupBy(*keys).agg(F.max(F.struct("m", (-F.col("h")).alias("h"))).alias("hi"), F.min(F.struct("m", "h")).alias("lo"))
    return best.select(*keys, (-F.col("hi.h")).alias("peak_hour"), F.col("lo.h").alias("trough_hour"), F.col("hi.m").alias("peak_mean"))


def hour_delta(a: Column, b: Column) -> Column:
    """Difference a - b on the 24-hour circle, from -12 to 11."""
    return F.pmod(a - b + 12, F.lit(24)) - 12


def step_deltas(records: DataFrame, keys: list[str], order: str, value: str, digits: int = 6) -> DataFrame:
    """records and step: the change of value against the next smaller context."""
    return records.withColumn("step", F.round(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)), digits))


def cumulative_share(groups: DataFrame, keys: list[str], item: str, n: str, digits: int = 6) -> DataFrame:
    """Items of each group in falling order of n: position, share, cumulative_share. keys must not be empty."""
    order, whole = Window.partitionBy(*keys).orderBy(F.desc(n), item), Window.partitionBy(*keys)
    total = F.sum(n).over(whole)
    return groups.select("*", F.row_number().over(order).alias("position"), F.round(F.try_divide(F.col(n).cast("double"), total), digits).alias("share"), F.round(F.try_divide(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), total), digits).alias("cumulative_share"))
