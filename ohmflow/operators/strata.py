"""Strata: rates, movements and score reports by group, and what they contribute. Each is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators import metrics
from ohmflow.operators.features import quantiles


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def _part(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def bucketed_rates(rows: DataFrame, value: Column, width: float, label: str = "anomaly") -> DataFrame:
    """bucket, n, rate of the label by value / width, and its correlation with the value over all rows."""
    based = rows.select(F.floor(value / width).alias("bucket"), value.cast("double").alias("_v"), F.col(label).cast("double").alias("_y"))
    whole = based.agg(_r(F.corr("_v", "_y"), "corr"))
    return based.groupBy("bucket").agg(F.count("*").alias("n"), _r(F.avg("_y"), "rate")).join(F.broadcast(whole))


def cell_census(rows: DataFrame, groups: list[str], label: str = "anomaly") -> DataFrame:
    """groups, pairs (building, meter), anomalous_pairs, anomalous_rate."""
    pairs = rows.groupBy(*groups, "building_id", "meter").agg(F.sum(label).alias("_a"))
    return pairs.groupBy(*groups).agg(F.count("*").alias("pairs"), F.count_if(F.col("_a") > 0).alias("anomalous_pairs"), _r(F.avg((F.col("_a") > 0).cast("double")), "anomalous_rate"))


def building_audit(available: DataFrame, selected: DataFrame, label: str = "anomaly") -> DataFrame:
    """building_id, meter, rows and anomalies available and selected; 0 where a side has none."""
    both = available.select("building_id", "meter", label, F.lit(0).alias("_s")).unionByName(selected.select("building_id", "meter", label, F.lit(1).alias("_s")))
    of = lambda s, c: F.sum(F.when(F.col("_s") == s, c).otherwise(0))
    return both.groupBy("building_id", "meter").agg(of(0, F.lit(1)).alias("available_rows"), of(0, F.col(label)).alias("available_anomalies"), of(1, F.lit(1)).alias("selected_rows"), of(1, F.col(label)).alias("selected_anomalies"))


def site_buildings(rows: DataFrame, flag: str) -> DataFrame:
    """site_id, buildings, flagged, unflagged, position: sites by most unflagged buildings, then most buildings, then id."""
    per = rows.groupBy("site_id", "building_id").agg(F.max(flag).alias("_f")).groupBy("site_id").agg(F.count("*").alias("buildings"), F.count_if(F.col("_f") == 1).alias("flagged"), F.count_if(F.col("_f") == 0).alias("unflagged"))
    # a table of sites
    return per.withColumn("position", F.row_number().over(Window.orderBy(F.desc("unflagged"), F.desc("buildings"), "site_id")).cast("long"))


def stratified_report(rows: DataFrame, first: str, second: str, score: str = "score") -> DataFrame:
    """stratum, first, second ('' where pooled), rows, buildings, coverage (scored share), mean, median, p95: over all rows, by the first
    column, and by both. A row counts once in each of its three strata."""
    text = lambda c: F.col(c).cast("string")
    strata = F.array(
        F.struct(F.lit("all").alias("stratum"), F.lit("").alias(first), F.lit("").alias(second)),
        F.struct(F.lit(first).alias("stratum"), text(first).alias(first), F.lit("").alias(second)),
        F.struct(F.lit(f"{first}+{second}").alias("stratum"), text(first).alias(first), text(second).alias(second)),
    )
    long = rows.select("building_id", F.col(score).alias("_s"), F.explode(strata).alias("x")).select("building_id", "_s", "x.*")
    keys = ["stratum", first, second]
    sums = long.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("building_id").alias("buildings"), _r(_part(F.count("_s"), F.count("*")), "coverage"), _r(F.avg("_s"), "mean"))
    return sums.join(quantiles(long, keys, "_s", [0.5, 0.95]), keys, "left").select(*keys, "rows", "buildings", "coverage", "mean", _r(F.col("q")[0], "median"), _r(F.col("q")[1], "p95"))


def partials(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, n, total, squares, low, high: what pool() merges; partial tables of any split of the rows give one result."""
    v = F.col(value)
    return rows.groupBy(*groups).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))


def pool(parts: DataFrame, groups: list[str]) -> DataFrame:
    """groups, n, mean, std (population), low, high of merged partials."""
    s = parts.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = F.col("_t") / F.nullif(F.col("n"), F.lit(0))
    return s.select(*groups, "n", _r(mean, "mean"), _r(F.sqrt(F.greatest(F.col("_q") / F.nullif(F.col("n"), F.lit(0)) - mean * mean, F.lit(0.0))), "std"), "low", "high")


def histogram_mass(rows: DataFrame, groups: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """groups, bin, n, mass: shares of a group's values in equal bins of [low, high]; values beyond count in the end bins."""
    cell = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins))).cast("int")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, cell.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("_t"))
    return counts.join(totals, groups).select(*groups, "bin", "n", _r(_part(F.col("n"), F.col("_t")), "mass"))


def context_sensitivity(rows: DataFrame, contexts: list[str], key: str, groups: list[str], threshold: float) -> DataFrame:
    """groups, rows, mean_std, mean_range, mean_rank_range, crossing_rate: how a row's score moves over contexts. rows has a score
    column per context; ranks are average-rank percentiles within groups and context."""
    long = rows.unpivot([key, *groups], contexts, "context", "_s")
    ranked = metrics.average_ranks(long, [*groups, "context"], "_s", "_p")
    per = ranked.groupBy(key, *groups).agg(F.stddev_pop("_s").alias("std"), (F.max("_s") - F.min("_s")).alias("range"), (F.max("_p") - F.min("_p")).alias("rank_range"), ((F.min("_s") < threshold) & (F.max("_s") >= threshold)).cast("double").alias("crossed"))
    return per.groupBy(*groups).agg(F.count("*").alias("rows"), _r(F.avg("std"), "mean_std"), _r(F.avg("range"), "mean_range"), _r(F.avg("rank_range"), "mean_rank_range"), _r(F.avg("crossed"), "crossing_rate"))


def role_support(rows: DataFrame, group: str, score: str = "score", label: str = "y") -> DataFrame:
    """pos_group, neg_group, positives, negatives, pos_buildings, neg_buildings, margin (mean positive less mean negative score), auc of
    every two different groups."""
    of = lambda c, p: rows.filter(F.col(label) == c).groupBy(F.col(group).alias(f"{p}_group")).agg(F.count("*").alias(f"{p}_n"), F.count_distinct("building_id").alias(f"{p}_buildings"), F.avg(score).alias(f"{p}_mean"))
    areas = metrics.pairwise_auc(rows, group, score, label).filter("relation = 'cross'")
    both = areas.join(of(1, "pos"), "pos_group").join(of(0, "neg"), "neg_group")
    return both.select("pos_group", "neg_group", F.col("pos_n").alias("positives"), F.col("neg_n").alias("negatives"), "pos_buildings", "neg_buildings", _r(F.col("pos_mean") - F.col("neg_mean"), "margin"), "auc")


def movement_shares(rows: DataFrame, strata: list[str], movement: str) -> DataFrame:
    """strata, n, mean, abs_total, share (of all absolute movement), top_share (largest row's part of the stratum)."""
    d = F.abs(F.col(movement))
    per = rows.groupBy(*strata).agg(F.count(movement).alias("n"), _r(F.avg(movement), "mean"), F.sum(d).alias("_a"), F.max(d).alias("_m"))
    whole = per.agg(F.sum("_a").alias("_t"))
    return per.join(F.broadcast(whole)).select(*strata, "n", "mean", _r(F.col("_a"), "abs_total"), _r(_part(F.col("_a"), F.col("_t")), "share"), _r(_part(F.col("_m"), F.col("_a")), "top_share"))


def movement_table(rows: DataFrame, groups: list[str], base: str, other: str) -> DataFrame:
    """groups, n, mean, mean_abs, low, high, share_up of other - base."""
    d = F.col(other) - F.col(base)
    return rows.groupBy(*groups).agg(F.count(d).alias("n"), _r(F.avg(d), "mean"), _r(F.avg(F.abs(d)), "mean_abs"), _r(F.min(d), "low"), _r(F.max(d), "high"), _r(F.avg((d > 0).cast("double")), "share_up"))


def site_contribution(pool_rows: DataFrame, sites: list, enough: Column) -> DataFrame:
    """site_id, series, sufficient, share of the pool's series that named sites give; one row per series in the pool."""
    per = pool_rows.groupBy("site_id").agg(F.count("*").alias("series"), F.count_if(enough).alias("sufficient"))
    whole = per.agg(F.sum("series").alias("_t"))
    return per.join(F.broadcast(whole)).filter(F.col("site_id").isin(sites)).select("site_id", "series", "sufficient", _r(_part(F.col("series"), F.col("_t")), "share"))


def range_summary(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, n, missing_rate, median, p99, high."""
    sums = rows.groupBy(*groups).agg(F.count("*").alias("n"), _r(F.avg(F.col(value).isNull().cast("double")), "missing_rate"), F.max(value).alias("high"))
    return sums.join(quantiles(rows, groups, value, [0.5, 0.99]), groups, "left").select(*groups, "n", "missing_rate", _r(F.col("q")[0], "median"), _r(F.col("q")[1], "p99"), "high")


def out_of_range_flags(strata: DataFrame, source: DataFrame, key: str, most_ratio: float = 2.0) -> DataFrame:
    """strata of range_summary() against the source's summary of the same key: median_ratio, far_median, p99_above, high_above, verdict."""
    other = source.select(key, *[F.col(c).alias(f"_{c}") for c in ("median", "p99", "high")])
    ratio = F.try_divide(F.col("median"), F.nullif(F.col("_median"), F.lit(0.0)))
    flagged = strata.join(other, key, "left").withColumn("median_ratio", F.round(ratio, 6)).withColumn("far_median", F.coalesce((ratio > most_ratio) | (ratio < 1 / most_ratio), F.lit(False))).withColumn("p99_above", F.coalesce(F.col("p99") > F.col("_p99"), F.lit(False))).withColumn("high_above", F.coalesce(F.col("high") > F.col("_high"), F.lit(False)))
    return flagged.withColumn("verdict", F.when(F.col("_median").isNull(), "no source").when(F.col("far_median"), "shifted").when(F.col("p99_above") | F.col("high_above"), "tail").otherwise("within")).drop("_median", "_p99", "_high")


def factorial_cells(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", segment: str = "segment", normal: float = 0.999) -> DataFrame:
    """groups, positives, median, q90 (of positive scores), cut (the normals' upper quantile), false_positives (normals at or above it),
    buildings, segments."""
    pos, neg = rows.filter(F.col(label) == 1), rows.filter(F.col(label) == 0)
    cuts = quantiles(neg, groups, score, [normal], "_c").withColumn("_cut", F.col("_c")[0]).drop("_c")
    hit = (F.col(label) == 0) & (F.col(score) >= F.col("_cut"))
    # cuts are a row for each group; broadcast, so that no group's rows are sent to one task
    sums = rows.join(F.broadcast(cuts), groups, "left").groupBy(*groups).agg(F.count_if(F.col(label) == 1).alias("positives"), F.max("_cut").alias("_cut"), F.count_if(hit).alias("false_positives"), F.count_distinct("building_id").alias("buildings"), F.count_distinct(segment).alias("segments"))
    return sums.join(quantiles(pos, groups, score, [0.5, 0.9]), groups, "left").select(*groups, "positives", _r(F.col("q")[0], "median"), _r(F.col("q")[1], "q90"), _r(F.col("_cut"), "cut"), "false_positives", "buildings", "segments")


def resampling_deltas(records: DataFrame, axis: str, model: str, seed: str, value: str, base: str) -> DataFrame:
    """axis, model, runs, mean, std, pairs, mean_delta, std_delta, low_delta, high_delta against the base model's run of the same axis and seed."""
    other = records.filter(F.col(model) == base).select(axis, seed, F.col(value).alias("_b"))
    d = F.when(F.col(model) != base, F.col(value) - F.col("_b"))
    return records.join(other, [axis, seed], "left").groupBy(axis, model).agg(F.count(value).alias("runs"), _r(F.avg(value), "mean"), _r(F.stddev_pop(value), "std"), F.count(d).alias("pairs"), _r(F.avg(d), "mean_delta"), _r(F.stddev_pop(d), "std_delta"), _r(F.min(d), "low_delta"), _r(F.max(d), "high_delta"))


def top_differences(rows: DataFrame, a: str, b: str, key: str, n: int) -> DataFrame:
    """The n rows that two runs score most differently: key, a, b, delta. A report's limit."""
    return rows.withColumn("delta", F.round(F.col(a) - F.col(b), 6)).orderBy(F.desc(F.abs("delta")), key).limit(n).select(key, a, b, "delta")


def new_year_report(rows: DataFrame, label: str = "anomaly", ts: str = "timestamp") -> DataFrame:
    """new_year, rows, anomalies, rate, verdict: 1 January against the other days: empty, clean, quiet (a lower rate) or usual."""
    day = (F.month(ts) == 1) & (F.dayofmonth(ts) == 1)
    per = rows.groupBy(day.alias("new_year")).agg(F.count("*").alias("rows"), F.sum(label).alias("anomalies"), F.avg(label).alias("_r"))
    both = per.agg(F.max(F.when(F.col("new_year"), F.col("_r"))).alias("_j"), F.max(F.when(~F.col("new_year"), F.col("_r"))).alias("_o"))
    verdict = F.when(F.col("_j").isNull(), "empty").when(F.col("_j") == 0, "clean").when(F.col("_j") < F.col("_o"), "quiet").otherwise("usual")
    return per.join(F.broadcast(both)).select("new_year", "rows", "anomalies", _r(F.col("_r"), "rate"), verdict.alias("verdict"))


def routed_metrics(rows: DataFrame, group: str, own: str, fallback: str, calibration: str, label: str = "y") -> DataFrame:
    """roc_auc, pr_auc (pooled), macro_auc (mean over groups with both classes), coverage (rows with a score of their own), scored (any),
    threshold (best F1 on the calibration rows), f1 at it on the others. calibration is a boolean column."""
    routed = rows.withColumn("_s", F.coalesce(own, fallback))
    test, some = routed.filter(~F.col(calibration)), F.col("_s").isNotNull()
    pooled = metrics.roc_pr(test.filter(some), [], "_s", label)
    macro = metrics.roc_pr(test.filter(some), [group], "_s", label).agg(_r(F.avg("roc_auc"), "macro_auc"))
    shares = test.agg(_r(_part(F.count(own), F.count("*")), "coverage"), _r(_part(F.count("_s"), F.count("*")), "scored"))
    cut = metrics.best_f1_threshold(routed.filter(F.col(calibration) & some), [], "_s", label).select("threshold")
    hit = F.col("_s") >= F.col("threshold")
    f1 = test.filter(some).join(F.broadcast(cut)).agg(_r(F.coalesce(_part(2 * F.count_if(hit & (F.col(label) == 1)), F.count_if(hit) + F.count_if(F.col(label) == 1)), F.lit(0.0)), "f1"), F.max("threshold").alias("threshold"))
    return pooled.select("roc_auc", "pr_auc").join(macro).join(shares).join(f1)


def budget_table(records: DataFrame, keys: list[str], model: str, models: list[str], value: str) -> DataFrame:
    """keys, a column of value per model, and gap (first less second): matched cells side by side; only cells that all models have."""
    wide = records.groupBy(*keys).pivot(model, models).agg(F.max(value)).dropna(subset=models)
    return wide.withColumn("gap", F.round(F.col(models[0]) - F.col(models[1]), 6))


def endpoint_panel(rows: DataFrame, group: str, a: str, b: str, score: str = "score", label: str = "y") -> DataFrame:
    """endpoint, value: areas of positives of one group against negatives of either, the mean margin, and mean percentile ranks (within both
    groups together) of the four parts."""
    some = rows.filter(F.col(group).isin(a, b))
    areas = metrics.pairwise_auc(some, group, score, label).select(F.concat_ws("_", F.lit("auc"), "pos_group", "neg_group").alias("endpoint"), F.col("auc").alias("value"))
    ranks = metrics.average_ranks(some, [], score, "_p").groupBy(group, label).agg(F.round(F.avg("_p"), 6).alias("value")).select(F.concat_ws("_", F.lit("rank"), group, F.when(F.col(label) == 1, "pos").otherwise("neg")).alias("endpoint"), "value")
    margin = some.groupBy(group).agg(F.round(F.avg(F.when(F.col(label) == 1, F.col(score))) - F.avg(F.when(F.col(label) == 0, F.col(score))), 6).alias("value")).select(F.concat_ws("_", F.lit("margin"), group).alias("endpoint"), "value")
    return areas.unionByName(ranks).unionByName(margin)
