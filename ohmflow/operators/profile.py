"""Profiles of tables: support, completeness, distributions, drift. Each is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators.features import quantiles, seconds
from ohmflow.operators.scan import prefix_sums


def _share(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def building_profiles(rows: DataFrame, meters: list[str], label: str = "anomaly", digits: int = 6) -> DataFrame:
    """building_id, site_id, n_sites, rows, anomalies, anomaly_rate, and per meter rows, anomalies, share, rate. n_sites over 1 breaks the
    building's dependency on its site."""
    per = []
    for m in meters:
        here = F.col("meter") == m
        n, bad = F.count_if(here), F.sum(F.when(here, F.col(label)).otherwise(0))
        per += [n.alias(f"{m}_rows"), bad.alias(f"{m}_anomalies"), _share(n, F.count("*"), digits).alias(f"{m}_share"), _share(bad, n, digits).alias(f"{m}_rate")]
    return rows.groupBy("building_id").agg(F.min("site_id").alias("site_id"), F.count_distinct("site_id").alias("n_sites"), F.count("*").alias("rows"), F.sum(label).alias("anomalies"), _share(F.sum(label), F.count("*"), digits).alias("anomaly_rate"), *per)


def grouped_support(rows: DataFrame, groups: list[str], label: str = "anomaly", digits: int = 6) -> DataFrame:
    """groups, rows, anomalies, rate, buildings, series, meters (sorted, comma-joined)."""
    return rows.groupBy(*groups).agg(F.count("*").alias("rows"), F.sum(label).alias("anomalies"), _share(F.sum(label), F.count("*"), digits).alias("rate"), F.count_distinct("building_id").alias("buildings"), F.count_distinct("building_id", "meter").alias("series"), F.array_join(F.array_sort(F.collect_set("meter")), ",").alias("meters"))


def grouping_counts(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """One pass over several groupings: grouping (its columns' names), the columns as text ('' where not grouped by), rows."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id(*columns).alias("_g"), F.count("*").alias("rows"))
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): "+".join(s) or "all" for s in sets}
    name = F.lit(None).cast("string")
    for value, text in ids.items():
        name = F.when(F.col("_g") == value, F.lit(text)).otherwise(name)
    return found.select(name.alias("grouping"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], "rows")


def site_concentration(rows: DataFrame, label: str = "anomaly", clean: float = 0.001, digits: int = 6) -> DataFrame:
    """site_id, anomalies, buildings, top_share, buildings_for_90, near_clean: how few buildings hold a site's anomalies."""
    per = rows.groupBy("site_id", "building_id").agg(F.sum(label).alias("n"), F.count("*").alias("rows"))
    order, whole = Window.partitionBy("site_id").orderBy(F.desc("n"), "building_id"), Window.partitionBy("site_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.select("*", before.alias("before"), F.sum("n").over(whole).alias("total"))
    return ranked.groupBy("site_id").agg(F.max("total").alias("anomalies"), F.count("*").alias("buildings"), _share(F.max("n"), F.max("total"), digits).alias("top_share"), F.count_if((F.col("total") > 0) & (F.col("before") * 10 < F.col("total") * 9)).alias("buildings_for_90"), F.count_if(F.col("n") <= F.col("rows") * clean).alias("near_clean"))


def completeness(rows: DataFrame, hours: int, keys=("building_id", "meter"), limit: float = 0.5, digits: int = 6) -> DataFrame:
    """keys, present, missing_rate of a span of hours, and completeness: high_missing over the limit, else sufficient."""
    rate = 1 - F.col("present") / F.lit(float(hours))
    return rows.filter("meter_reading is not null").groupBy(*keys).agg(F.count_distinct("timestamp").alias("present")).select(*keys, "present", F.round(rate, digits).alias("missing_rate"), F.when(rate > limit, "high_missing").otherwise("sufficient").alias("completeness"))


def sufficiency(per_series: DataFrame, limits: list[float], rate: str = "missing_rate") -> DataFrame:
    """limit, series, sufficient: how many series stay at each limit."""
    at = per_series.select(F.explode(F.array(*[F.lit(x) for x in limits])).alias("limit"), rate)
    return at.groupBy("limit").agg(F.count("*").alias("series"), F.count_if(F.col(rate) <= F.col("limit")).alias("sufficient"))


def gaps(rows: DataFrame, keys=("building_id", "meter"), ts: str = "timestamp") -> DataFrame:
    """keys, observed, expected, missing: hours of each series against the hours from its first to its last."""
    found = rows.groupBy(*keys).agg(F.count_distinct(ts).alias("observed"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    expected = F.floor((seconds("hi") - seconds("lo")) / 3600) + 1
    return found.select(*keys, "observed", expected.alias("expected"), (expected - F.col("observed")).alias("missing"))


def top_groups(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n groups by a compound key, as a distributed limit."""
    return rows.orderBy(*order).limit(n)


def numeric_summary(rows: DataFrame, groups: list[str], value: str, digits: int = 6) -> DataFrame:
    """groups, n, low, q25, median, q75, iqr, p95, p99, high, missing_rate. groups must not be empty."""
    sums = rows.groupBy(*groups).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), F.count("*").alias("_all"))
    q = sums.join(quantiles(rows, groups, value, [0.25, 0.5, 0.75, 0.95, 0.99]), groups, "left")
    r = lambda c, n: F.round(c, digits).alias(n)
    return q.select(*groups, "n", "low", r(F.col("q")[0], "q25"), r(F.col("q")[1], "median"), r(F.col("q")[2], "q75"), r(F.col("q")[2] - F.col("q")[0], "iqr"), r(F.col("q")[3], "p95"), r(F.col("q")[4], "p99"), "high", _share(F.col("_all") - F.col("n"), F.col("_all"), digits).alias("missing_rate"))


def nine_quantiles(rows: DataFrame, groups: list[str], value: str, digits: int = 6) -> DataFrame:
    """groups, n, finite_rate, and q01 q05 q10 q25 q50 q75 q90 q95 q99."""
    points = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    finite = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    based = rows.withColumn("_finite", finite)
    found = based.groupBy(*groups).agg(F.count("*").alias("n"), _share(F.count("_finite"), F.count("*"), digits).alias("finite_rate")).join(quantiles(based, groups, "_finite", points), groups, "left")
    return found.select(*groups, "n", "finite_rate", *[F.round(F.col("q")[i], digits).alias(f"q{round(p * 100):02d}") for i, p in enumerate(points)])


def field_summary(rows: DataFrame, column: str, numeric: bool, digits: int = 6) -> DataFrame:
    """field, present_rate, typical: the median of a number or the most frequent value (the smallest on ties)."""
    rate = rows.agg(_share(F.count(column), F.count("*"), digits).alias("present_rate"))
    if numeric:
        typical = quantiles(rows, [], column, [0.5]).select(F.round(F.col("q")[0], digits).cast("string").alias("typical"))
    else:
        counts = rows.filter(F.col(column).isNotNull()).groupBy(column).count()
        typical = counts.orderBy(F.desc("count"), column).limit(1).select(F.col(column).cast("string").alias("typical"))
    return rate.join(F.broadcast(typical), F.lit(True), "left").select(F.lit(column).alias("field"), "present_rate", "typical")


def quality_summary(rows: DataFrame, groups: list[str], value: str = "meter_reading", digits: int = 6) -> DataFrame:
    """groups, rows, null_share, zero_share, negative_share, coverage (series with any reading)."""
    v = F.col(value)
    return rows.groupBy(*groups).agg(F.count("*").alias("rows"), _share(F.count_if(v.isNull()), F.count("*"), digits).alias("null_share"), _share(F.count_if(v == 0), F.count("*"), digits).alias("zero_share"), _share(F.count_if(v < 0), F.count("*"), digits).alias("negative_share"), F.count_distinct(F.when(v.isNotNull(), F.col("building_id"))).alias("coverage"))


def cell_diff(raw: DataFrame, cleaned: DataFrame, keys: list[str], value: str) -> DataFrame:
    """removed, filled, changed, same: cells of two variants of one table."""
    a, b = raw.select(*keys, F.col(value).alias("_a")), cleaned.select(*keys, F.col(value).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    return a.join(b, keys, "full_outer").agg(F.count_if(x.isNotNull() & y.isNull()).alias("removed"), F.count_if(x.isNull() & y.isNotNull()).alias("filled"), F.count_if(x != y).alias("changed"), F.count_if(x.eqNullSafe(y)).alias("same"))


def flatline(rows: DataFrame, groups: list[str], keys=("building_id", "meter"), value: str = "meter_reading", ts: str = "timestamp", digits: int = 6) -> DataFrame:
    """groups, pairs, flat_share: adjacent readings of a series that are equal."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts))
    pairs = rows.withColumn("_b", before).filter(F.col(value).isNotNull() & F.col("_b").isNotNull())
    return pairs.groupBy(*groups).agg(F.count("*").alias("pairs"), _share(F.count_if(F.col(value) == F.col("_b")), F.count("*"), digits).alias("flat_share"))


def hourly_profile(rows: DataFrame, groups: list[str], value: str = "meter_reading", ts: str = "timestamp", digits: int = 6) -> DataFrame:
    """groups, hour, mean of hourly means: first over series at one time, then over times."""
    first = rows.groupBy(*groups, ts).agg(F.avg(value).alias("_m"))
    return first.groupBy(*groups, F.hour(ts).alias("hour")).agg(F.round(F.avg("_m"), digits).alias("mean"))


def composition(rows: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """field, value, n, share of every value of several columns, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.groupBy("field").agg(F.sum("n").alias("_t"))), "field").select("field", "value", "n", _share(F.col("n"), F.col("_t"), digits).alias("share"))


def step_counts(rows: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """keys, step_seconds, n: how often each time step stands between neighbouring rows of a series."""
    steps = rows.withColumn("_t", seconds(ts)).withColumn("step_seconds", F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys).orderBy("_t"))).filter("step_seconds is not null")
    return steps.groupBy(*keys, "step_seconds").agg(F.count("*").alias("n"))


def most_frequent_step(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step_seconds, n of the most frequent step, the smaller on ties."""
    return steps.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("step_seconds")).alias("s"))).alias("b")).select(*keys, (-F.col("b.s")).alias("step_seconds"), F.col("b.n").alias("n"))


def label_columns(rows: DataFrame, terms=("label", "anomaly", "bad", "fault")) -> list[str]:
    """Columns whose name holds one of the terms."""
    return [c for c in rows.columns if any(t in c.lower() for t in terms)]


def missing_rates(rows: DataFrame, columns: list[str], groups: list[str], digits: int = 6) -> DataFrame:
    """groups, field, missing_rate, from one aggregation."""
    rates = rows.groupBy(*groups).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot(groups, columns, "field", "rate").select(*groups, "field", F.round("rate", digits).alias("missing_rate"))


def unseen_rate(rows: DataFrame, reference: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """n, unseen, rate: rows whose category the reference does not have."""
    known = reference.select(F.col(column).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return rows.join(known, F.col(column) == F.col("_k"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("_hit").isNull()).alias("unseen"), _share(F.count_if(F.col("_hit").isNull()), F.count("*"), digits).alias("rate"))


def frame_summary(rows: DataFrame, keys=("building_id", "site_id", "meter"), ts: str = "timestamp") -> DataFrame:
    """rows, distinct counts of the keys, first and last time."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_distinct(k).alias(f"n_{k}") for k in keys], F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def macro(records: DataFrame, groups: list[str], value: str, expected: int | None = None, digits: int = 6) -> DataFrame:
    """groups, n, macro: unweighted mean over group metrics; null unless all expected groups are there."""
    mean = F.avg(value)
    return records.groupBy(*groups).agg(F.count(value).alias("n"), F.round(mean if expected is None else F.when(F.count(value) == expected, mean), digits).alias("macro"))


def metric_distribution(records: DataFrame, groups: list[str], value: str, digits: int = 6) -> DataFrame:
    """groups, n, mean, std, low, p10, q25, median, q75, p90, high of a metric over units."""
    r = lambda c, n: F.round(c, digits).alias(n)
    q = lambda p: F.percentile(value, p)
    return records.groupBy(*groups).agg(F.count(value).alias("n"), r(F.avg(value), "mean"), r(F.stddev_pop(value), "std"), r(F.min(value), "low"), r(q(0.1), "p10"), r(q(0.25), "q25"), r(q(0.5), "median"), r(q(0.75), "q75"), r(q(0.9), "p90"), r(F.max(value), "high"))


def duplicate_use(rows: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """rows, unique_rows, duplicate_rate of a sample with repeats."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("unique_rows"), F.round(1 - F.try_divide(F.count_distinct(key).cast("double"), F.count("*")), digits).alias("duplicate_rate"))


def ks_distance(rows: DataFrame, side: str, value: str, groups: list[str], digits: int = 6) -> DataFrame:
    """groups, n_a, n_b, ks: the largest gap between two samples' cumulative shares. side is 'a' or 'b'; running counts are over ranges of distinct values."""
    counts = rows.groupBy(*groups, value).agg(F.count_if(F.col(side) == "a").alias("a"), F.count_if(F.col(side) == "b").alias("b"))
    steps = prefix_sums(counts, groups, value, {"n_a": "a", "n_b": "b"})
    share = lambda c: F.try_divide((F.col(f"n_{c}_before") + F.col(c)).cast("double"), F.col(f"n_{c}_total"))
    return steps.withColumn("_gap", F.abs(share("a") - share("b"))).groupBy(*groups).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.round(F.max("_gap"), digits).alias("ks"))


def psi(rows: DataFrame, side: str, value: str, bins: int = 10, floor: float = 1e-6, digits: int = 6) -> DataFrame:
    """bins, psi of side 'b' against quantile bins of side 'a'; tied edges merge, the outer bins are open."""
    points = [i / bins for i in range(1, bins)]
    edges = quantiles(rows.filter(F.col(side) == "a"), [], value, points, "_e").withColumn("_e", F.array_distinct("_e"))
    cell = F.size(F.filter("_e", lambda e: e <= F.col(value)))
    counts = rows.join(F.broadcast(edges)).withColumn("bin", cell).groupBy("bin").agg(F.count_if(F.col(side) == "a").alias("a"), F.count_if(F.col(side) == "b").alias("b"))
    whole = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.greatest(F.col("a") / F.col("ta"), F.lit(floor)), F.greatest(F.col("b") / F.col("tb"), F.lit(floor))
    return counts.join(F.broadcast(whole)).agg(F.count("*").alias("bins"), F.round(F.sum((q - p) * F.ln(q / p)), digits).alias("psi"))


def psi_categories(rows: DataFrame, side: str, value: str, floor: float = 1e-6, digits: int = 6) -> DataFrame:
    """categories, psi over the categories of either side."""
    counts = rows.groupBy(value).agg(F.count_if(F.col(side) == "a").alias("a"), F.count_if(F.col(side) == "b").alias("b"))
    whole = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.greatest(F.col("a") / F.col("ta"), F.lit(floor)), F.greatest(F.col("b") / F.col("tb"), F.lit(floor))
    return counts.join(F.broadcast(whole)).agg(F.count("*").alias("categories"), F.round(F.sum((q - p) * F.ln(q / p)), digits).alias("psi"))


def drift_variants(rows: DataFrame, side: str, value: str) -> DataFrame:
    """rows once for each variant: raw, log1p, log1p_nonzero; ks_distance(groups=['variant']) then measures all of them."""
    v = F.col(value)
    variants = F.array(F.struct(F.lit("raw").alias("variant"), v.alias("v")), F.struct(F.lit("log1p").alias("variant"), F.log1p(F.greatest(v, F.lit(0.0))).alias("v")), F.struct(F.lit("log1p_nonzero").alias("variant"), F.when(v > 0, F.log1p(v)).alias("v")))
    return rows.select(side, F.explode(variants).alias("x")).select(side, "x.*").filter("v is not null")


def flatten_records(cells: DataFrame, column: str, schema: str) -> DataFrame:
    """Nested JSON result cells as rows of a plain table: the other columns and the records' fields."""
    others = [c for c in cells.columns if c != column]
    return cells.select(*others, F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("_r")).select(*others, "_r.*")
