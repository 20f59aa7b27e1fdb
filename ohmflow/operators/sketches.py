"""Mergeable quantiles: one stored sketch for each site and day, merged by any grouping.

A sketch of K keeps a few thousand values whatever its rows; a quantile read from it, merged or not, stands at a rank that is off by at most
RANK_ERROR of the rows, with 99 % probability. Sketches are aggregated in Spark's own functions, before and after the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sketch's size, and the rank error that it keeps to.
K, RANK_ERROR = 400, 0.0075


def quantile_partials(rows: DataFrame, groups: list[str], value: str, k: int = K) -> DataFrame:
    """groups, n (values that are not null), low, high, sketch. Groups without a value have no row."""
    known = rows.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return known.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def pool_quantiles(parts: DataFrame, groups: list[str], points: list[float], k: int = K) -> DataFrame:
    """groups, n, low, high, q (one value for each point) of merged partials."""
    merged = parts.groupBy(*groups).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    return merged.filter("n > 0").select(*groups, "n", "low", "high", F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))) for p in points]).alias("q"))


def rank_errors(rows: DataFrame, pooled: DataFrame, groups: list[str], value: str, points: list[float]) -> DataFrame:
    """groups, point, error: how far the share of rows up to each pooled quantile is from its point, ties to the nearest of their ranks."""
    at = pooled.select(*groups, F.posexplode("q").alias("_i", "_q")).withColumn("point", F.element_at(F.array(*map(F.lit, points)), F.col("_i") + 1))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    met = counts.join(F.broadcast(at), groups) if groups else counts.join(F.broadcast(at))
    shares = met.groupBy(*groups, "point").agg(F.sum(F.when(F.col("_v") < F.col("_q"), F.col("_n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("_v") <= F.col("_q"), F.col("_n")).otherwise(0)).alias("t"), F.sum("_n").alias("n"))
    below, upto = F.col("u") / F.col("n"), F.col("t") / F.col("n")
    return shares.select(*groups, "point", F.greatest(below - F.col("point"), F.col("point") - upto, F.lit(0.0)).alias("error"))
