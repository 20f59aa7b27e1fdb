"""Experiments as tables: splits and feature sets as columns, and axes of fits with one row per cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmflow.operators import metrics, models, resample, sampling, strata
from ohmflow.sources.sinks import stored


def masks(rows: DataFrame, experiments: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """experiment, side and rows: each experiment's side column on the rows that its condition keeps; one pass, a row once per experiment."""
    kept = [F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(name).alias("experiment"), side.alias("side"))) for name, (side, keep) in experiments.items()]
    return rows.withColumn("_x", F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull()))).select(*rows.columns, "_x.*")


def split_regimes(rows: DataFrame, splits: dict[str, Column], regimes: dict[str, Callable[[DataFrame], DataFrame]], feature: str) -> DataFrame:
    """split, regime, side, rows, null_rate, mean of a feature: features are built per split side, so no side sees the other's rows."""
    out = None
    for regime, build in regimes.items():
        cells = masks(rows, {name: (side, None) for name, side in splits.items()})
        made = build(cells).withColumn("regime", F.lit(regime)).select(F.col("experiment").alias("split"), "regime", "side", F.col(feature).alias("_f"))
        out = made if out is None else out.unionByName(made)
    return out.groupBy("split", "regime", "side").agg(F.count("*").alias("rows"), F.round(F.avg(F.col("_f").isNull().cast("double")), 6).alias("null_rate"), F.round(F.avg(F.round("_f", 6)) + 1e-9, 6).alias("mean"))


def factorial_bootstrap(rows: DataFrame, cluster: str, a: str, b: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """effect, draws, invalid, median, low, high, positive_share, excludes_zero of a 2x2 design's effects over draws of clusters. Rows are
    reduced to cluster and cell sums before draws are joined as weights."""
    parts = rows.groupBy(cluster, a, b).agg(F.sum(value).alias("_t"), F.count(value).alias("_n"))
    drawn = parts.join(resample.cluster_draws(parts, cluster, draws, seed), cluster)
    cells = drawn.groupBy("draw", a, b).agg((F.sum(F.col("_t") * F.col("weight")) / F.sum(F.col("_n") * F.col("weight"))).alias("v"))
    effects = resample.factorial(cells, ["draw"], a, b, "v", 9).unpivot(["draw"], ["main_a", "main_b", "interaction"], "effect", "value")
    return resample.intervals(effects, ["effect"], "value")


def permutation_importance(rows: DataFrame, groups: dict[str, list[str]], scorer: Callable[[], Column], key: str, repeats: int, part: list[str], label: str = "y", seed: int = 0) -> DataFrame:
    """feature, repeats, and mean and std of the drops in roc_auc and pr_auc when a feature's columns are dealt anew together. groups names
    each feature's columns; scorer makes the score column from them; values are dealt within part."""
    base = metrics.roc_pr(rows.withColumn("score", scorer()), []).select(F.col("roc_auc").alias("_roc"), F.col("pr_auc").alias("_pr"))
    # a repeat deals all features' columns once; a feature takes its own from the dealt row and the others from the row itself
    every = sorted({c for columns in groups.values() for c in columns})
    dealt = resample.permuted(rows.withColumn("_values", F.struct(*every)), "_values", key, repeats, part, seed)
    of = dealt.withColumn("feature", F.explode(F.array(*map(F.lit, groups))))
    takes = lambda c: F.col("feature").isin([n for n, columns in groups.items() if c in columns])
    mixed = of.withColumns({c: F.when(takes(c), F.col("_values")[c]).otherwise(F.col(c)) for c in every}).drop("_values")
    out = metrics.roc_pr(mixed.withColumn("score", scorer()), ["feature", "repeat"])
    drops = out.join(F.broadcast(base)).select("feature", (F.col("_roc") - F.col("roc_auc")).alias("roc"), (F.col("_pr") - F.col("pr_auc")).alias("pr"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return drops.groupBy("feature").agg(F.count("*").alias("repeats"), r(F.avg("roc"), "roc_drop"), r(F.stddev_pop("roc"), "roc_std"), r(F.avg("pr"), "pr_drop"), r(F.stddev_pop("pr"), "pr_std"))


# --- axes of fits ---


def small_tree() -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol="y", maxDepth=4, seed=1)


def cell(train: DataFrame, test: DataFrame, columns: list[str], learner=None) -> DataFrame:
    """n_pos, n_neg, roc_auc, pr_auc on the test rows of a learner fitted on the training rows, scaled on them. A fit passes over its rows several
    times, so what made them is done once, into a table."""
    train = stored(train.select(*columns, "y"), "fit-rows")
    scaler = models.fit_scaler(train, columns)
    fitted = models.fit_members(models.scale(train, scaler), columns, {"score": learner or small_tree()})
    scored = models.score_members(models.scale(test, scaler), fitted, columns, ["y"])
    return metrics.roc_pr(scored.select("y", "score"), [])


def axis(name: str, cells: dict[str, DataFrame]) -> DataFrame:
    """axis, cell and the metrics of each cell."""
    out = None
    for label, found in cells.items():
        one = found.select(F.lit(name).alias("axis"), F.lit(label).alias("cell"), "n_pos", "n_neg", "roc_auc", "pr_auc")
        out = one if out is None else out.unionByName(one)
    return out


def label_efficiency(train: DataFrame, test: DataFrame, columns: list[str], budgets: list[int], key: str) -> DataFrame:
    """A fit per nested balanced budget."""
    return axis("label_efficiency", {str(b): cell(sampling.balanced(train, key, "y", b), test, columns) for b in budgets})


def dimensionality(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """A fit per prefix of the columns."""
    return axis("dimensionality", {str(k): cell(train, test, columns[:k]) for k in range(1, len(columns) + 1)})


def stability(train: DataFrame, test: DataFrame, columns: list[str], seeds: list[int], n: int, key: str) -> DataFrame:
    """axis, runs, mean, std_pop, low, high of the area over seeds of the training sample."""
    runs = axis("stability", {str(s): cell(sampling.balanced(train, key, "y", n, s), test, columns) for s in seeds})
    return metrics.seed_summary(runs, ["axis"], "roc_auc")


def ablations(train: DataFrame, test: DataFrame, columns: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """A refit without each group of columns, with each group held constant, and with all."""
    sets = {name: cell(train, test, kept) for name, kept in models.ablate(columns, groups).items()}
    still = {f"constant_{n}": cell(train.select(*[F.lit(0.0).alias(c) if c in g else c for c in train.columns]), test, columns) for n, g in groups.items()}
    return axis("ablation", sets | still)


def shuffled_fits(train: DataFrame, test: DataFrame, columns: list[str], seeds: list[int], key: str) -> DataFrame:
    """axis, runs, mean, std_pop, low, high of the area after fits on shuffled labels: near a half where nothing leaks."""
    cells = {}
    for s in seeds:
        dealt = sampling.shuffle_labels(train.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(64))), ["_g"], key, "y", s).withColumn("y", F.col("shuffled"))
        cells[str(s)] = cell(dealt, test, columns)
    return metrics.seed_summary(axis("shuffled_labels", cells), ["axis"], "roc_auc")


def default_and_tuned(train: DataFrame, validation: DataFrame, test: DataFrame, columns: list[str], depths: list[int]) -> DataFrame:
    """axis, cell (default or tuned) and metrics: the tuned learner is the one of the best step area on the validation rows."""
    tree = lambda d: DecisionTreeClassifier(labelCol="y", maxDepth=d, seed=1)
    areas = {d: cell(train, validation, columns, tree(d)).first()["pr_auc"] or 0.0 for d in depths}
    best = max(depths, key=lambda d: (areas[d], -d))
    return axis("default_and_tuned", {"default": cell(train, test, columns), "tuned": cell(train, test, columns, tree(best))})


def transfer(source: DataFrame, target: DataFrame, columns: list[str], first: str, second: str) -> DataFrame:
    """stratified_report() of the target's rows under a learner fitted on the source."""
    scaler = models.fit_scaler(source, columns)
    fitted = models.fit_members(models.scale(source, scaler), columns, {"score": small_tree()})
    scored = models.score_members(models.scale(target, scaler), fitted, columns, ["building_id", first, second])
    return strata.stratified_report(scored, first, second, "score")


def evenly_spaced(ranked: DataFrame, rank: str, n: int, most: int) -> DataFrame:
    """At most `most` of n rows, at floor(k (n - 1) / (most - 1)) of their rank from 0."""
    return metrics.thin(ranked.withColumn("i", F.col(rank)).withColumn("n", F.lit(n)), most).drop("i", "n")


def null_fractions(rows: DataFrame, columns: list[str], key: str, most: int) -> DataFrame:
    """field, null_fraction on an evenly spaced sample of rows in key order. The rank is by key within ranges of equal width, which are
    counted first."""
    from ohmflow.sources import sinks

    n = rows.count()
    placed = sinks.ranked(rows, key)
    some = evenly_spaced(placed, "rank", n, most)
    one = some.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "null_fraction")


def matched_replicates(samples: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """runs, mean, std_pop, std_samp, low, high of the area over seeds of a sampled fit."""
    areas = metrics.roc_pr(samples, ["seed"], score, label).withColumn("_a", F.lit("seeds"))
    return metrics.seed_summary(areas, ["_a"], "roc_auc").drop("_a")


