"""Evaluation of anomaly scores. Ranks are never taken over all rows: rows are first reduced to distinct scores with their
positive and negative counts, so a group's work is that of its distinct scores."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators.features import quantiles
from ohmflow.operators.scan import prefix_sums

#: Margins are told apart down to this difference, and so many are counted at once in the search for one.
MARGIN_STEP = 1e-9
CUTS = 24


def score_counts(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """groups, score, pos, neg: the reduction that all metrics start from. weight: rows count so many times. Rows without a score (null or
    NaN) or without a label are not scored, so they count in no metric; coverage is counted apart."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    kind = dict(rows.dtypes)[score]
    known = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull() & (~F.isnan(score) if kind in ("double", "float") else F.lit(True)))
    return known.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"))


def curve(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """groups, score, pos, neg, tp, fp, tp_before, fp_before, n_pos, n_neg: cumulative counts at each distinct score, from the highest, the i-th of n.
    Distinct scores are dealt to ranges of equal counts, so that neither a large group nor an odd score is one task's work."""
    return curve_of(score_counts(rows, groups, score, label, weight), groups)


def curve_of(counts: DataFrame, groups: list[str]) -> DataFrame:
    """curve() of counts (groups, score, pos, neg) that are there."""
    found = prefix_sums(counts, groups, "score", {"pos": "pos", "neg": "neg", "i": F.lit(1).cast("long")}, descending=True)
    return found.select(
        *groups, "score", "pos", "neg", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"), F.col("pos_before").alias("tp_before"), F.col("neg_before").alias("fp_before"),
        F.col("pos_total").alias("n_pos"), F.col("neg_total").alias("n_neg"), F.col("i_before").alias("i"), F.col("i_total").alias("n"),
    )


def auc_expr() -> Column:
    """Tie-aware ROC area from curve() rows: pairs won plus half of the ties, over all pairs; null for one class."""
    won = F.sum(F.col("pos") * ((F.col("n_neg") - F.col("fp")) + F.col("neg") / F.lit(2.0)))
    return F.try_divide(won, (F.max("n_pos") * F.max("n_neg")).cast("double"))


def average_precision_expr() -> Column:
    """Step-form PR area from curve() rows: precision at each distinct score times the recall gained there."""
    return F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")), F.max("n_pos").cast("double"))


def roc_pr(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", weight: str | None = None, digits: int = 6) -> DataFrame:
    """groups, n_pos, n_neg, roc_auc, pr_auc; a group of one class has nulls."""
    points = curve(rows, groups, score, label, weight)
    both = F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), F.lit(1))
    found = points.groupBy(*groups).agg(F.max("n_pos").cast("long").alias("n_pos"), F.max("n_neg").cast("long").alias("n_neg"), F.round(auc_expr(), digits).alias("roc_auc"), F.round(F.when(both == 1, average_precision_expr()), digits).alias("pr_auc"))
    return found


def grouped_metrics(rows: DataFrame, group_columns: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Metrics by several groupings in one pass: grouping, group_value, n_pos, n_neg, roc_auc, pr_auc."""
    long = rows.select(score, label, F.explode(F.array(*[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("group_value")) for c in group_columns])).alias("g")).select(score, label, "g.*")
    return roc_pr(long, ["grouping", "group_value"], score, label)


def score_columns_metrics(rows: DataFrame, scores: list[str], groups: list[str], label: str = "y") -> DataFrame:
    """Metrics of several score columns: model, groups, n_pos, n_neg, roc_auc, pr_auc."""
    long = rows.unpivot([*groups, label], scores, "model", "score")
    return roc_pr(long, ["model", *groups], "score", label)


def confusion(rows: DataFrame, groups: list[str], threshold: float | Column = 0.5, score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """groups, tp, fp, fn, tn, accuracy, precision, recall, f1, fpr; rates without a denominator are 0 for precision, recall and F1 and null otherwise."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    n = rows.groupBy(*groups).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b), digits)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("*", rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.coalesce(rate(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(rate(tp, tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(rate(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), rate(fp, fp + tn).alias("fpr"))


def recall_threshold(rows: DataFrame, groups: list[str], target: float, score: str = "score", label: str = "y") -> DataFrame:
    """groups, threshold: the highest score at which recall reaches the target; 1.0 where a group has no positives."""
    points = curve(rows, groups, score, label)
    reached = F.max(F.when((F.col("n_pos") > 0) & (F.col("tp") >= F.ceil(F.col("n_pos") * target)), F.col("score")))
    return points.groupBy(*groups).agg(F.coalesce(reached, F.lit(1.0)).alias("threshold"))


def best_f1_threshold(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """groups, threshold, f1: the distinct score of the highest F1, the higher score on ties."""
    points = curve(rows, groups, score, label).withColumn("f1", F.round(2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")), digits))
    best = points.groupBy(*groups).agg(F.max(F.struct("f1", "score")).alias("b"))
    return best.select(*groups, F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def curve_points(rows: DataFrame, groups: list[str], max_points: int, score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """groups, point, score, fpr, tpr, precision: ROC and PR points, thinned to at most max_points evenly spaced ones."""
    points = curve(rows, groups, score, label)
    return thin(points, max_points).select(
        *groups, F.col("i").alias("point"), "score", F.round(F.try_divide(F.col("fp").cast("double"), F.col("n_neg")), digits).alias("fpr"), F.round(F.try_divide(F.col("tp").cast("double"), F.col("n_pos")), digits).alias("tpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"), digits).alias("precision")
    )


def thin(points: DataFrame, max_points: int) -> DataFrame:
    """Of rows numbered i from 0 of n, those at floor(k (n - 1) / (max_points - 1)); all where n is no larger."""
    steps = max_points - 1
    k = F.ceil(F.col("i") * steps / (F.col("n") - 1).cast("double"))
    on_grid = (F.floor(k * (F.col("n") - 1) / steps) == F.col("i")) & (k <= steps)
    return points.filter((F.col("n") <= max_points) | on_grid)


def pairwise_auc(rows: DataFrame, group: str, score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """pos_group, neg_group, n_pairs, auc, relation: positives of one group against negatives of another, without making pairs:
    a positive's wins are the cumulative negatives below its score, looked up by score."""
    counts = score_counts(rows, [group], score, label)
    scores = counts.select("score").distinct()
    negatives = counts.groupBy(group).agg(F.sum("neg").alias("n_neg")).filter("n_neg > 0")
    # every distinct score of the table for every negative group, so that a join by equality finds the counts below
    grid = scores.join(F.broadcast(negatives.select(F.col(group).alias("neg_group"), "n_neg")))
    own = counts.select(F.col(group).alias("neg_group"), "score", "neg")
    ladder = prefix_sums(grid.join(own, ["neg_group", "score"], "left").withColumn("neg", F.coalesce("neg", F.lit(0))), ["neg_group"], "score", {"neg": "neg"}).withColumnRenamed("neg_before", "below")
    pos = counts.filter("pos > 0").select(F.col(group).alias("pos_group"), "score", "pos")
    won = pos.join(ladder, "score").groupBy("pos_group", "neg_group").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("won"), (F.sum("pos") * F.max("n_neg")).alias("n_pairs"))
    return won.select("pos_group", "neg_group", "n_pairs", F.round(F.col("won") / F.col("n_pairs"), digits).alias("auc"), F.when(F.col("pos_group") == F.col("neg_group"), "within").otherwise("cross").alias("relation"))


def auc_decomposition(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """relation, n_pairs, share, auc, contribution: how within- and cross-group pairs make up the pooled area."""
    total = pairs.agg(F.sum("n_pairs").alias("total"))
    parts = pairs.groupBy("relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum(F.col("auc") * F.col("n_pairs")).alias("won"))
    return parts.join(F.broadcast(total)).select("relation", "n_pairs", F.round(F.col("n_pairs") / F.col("total"), digits).alias("share"), F.round(F.col("won") / F.col("n_pairs"), digits).alias("auc"), F.round(F.col("won") / F.col("total"), digits).alias("contribution"))


def average_ranks(rows: DataFrame, groups: list[str], value: str, name: str = "percentile") -> DataFrame:
    """rows and their average-rank percentile within groups: ranks are made on distinct values and joined back by value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    scanned = prefix_sums(counts, groups, value, {"c": "_n"})
    ranks = scanned.select(*groups, value, ((F.col("c_before") + (F.col("_n") + 1) / F.lit(2.0)) / F.col("c_total")).alias(name))
    return rows.join(ranks, [*groups, value], "left")


def class_means(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """Mean and median score of either class, and their separation."""
    of = lambda c: F.when(F.col(label) == c, F.col(score))
    halves = [quantiles(rows.filter(F.col(label) == c), groups, score, [0.5], f"_{c}") for c in (1, 0)]
    found = rows.groupBy(*groups).agg(F.avg(of(1)).alias("mp"), F.avg(of(0)).alias("mn")).join(halves[0], groups, "left").join(halves[1], groups, "left").withColumn("dp", F.col("_1")[0]).withColumn("dn", F.col("_0")[0])
    r = lambda c: F.round(c, digits)
    return found.select(*groups, r(F.col("mp")).alias("mean_pos"), r(F.col("mn")).alias("mean_neg"), r(F.col("dp")).alias("median_pos"), r(F.col("dn")).alias("median_neg"), r(F.col("mp") - F.col("mn")).alias("separation"))


def distributions(rows: DataFrame, groups: list[str], score: str = "score", points=(0.1, 0.5, 0.9), digits: int = 6) -> DataFrame:
    """groups, n, mean, and a column per quantile (q10, q50, q90)."""
    named = [F.round(F.col("_q")[i], digits).alias(f"q{round(100 * p):02d}") for i, p in enumerate(points)]
    sums = rows.groupBy(*groups).agg(F.count(score).alias("n"), F.round(F.avg(score), digits).alias("mean"))
    return sums.join(quantiles(rows, groups, score, list(points), "_q"), groups, "left").select(*groups, "n", "mean", *named)


def contrasts(rows: DataFrame, groups: list[str], low: str, high: str, digits: int = 6) -> DataFrame:
    """groups, n, mean, median, q10, q90, mean_abs, fraction_up of high - low."""
    moved = rows.withColumn("_d", F.col(high) - F.col(low))
    sums = moved.groupBy(*groups).agg(F.count("_d").alias("n"), F.round(F.avg("_d"), digits).alias("mean"), F.round(F.avg(F.abs("_d")), digits).alias("mean_abs"), F.round(F.avg((F.col("_d") > 0).cast("double")), digits).alias("fraction_up"))
    named = [F.round(F.col("_q")[i], digits).alias(n) for i, n in enumerate(("median", "q10", "q90"))]
    return sums.join(quantiles(moved, groups, "_d", [0.5, 0.1, 0.9], "_q"), groups, "left").select(*groups, "n", "mean", *named, "mean_abs", "fraction_up")


def operating_points(rows: DataFrame, groups: list[str], kind: str, rates: list[float], score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """groups, rate, threshold, fpr, tpr: kind 'fpr' takes the threshold from the negatives' upper quantile, 'tpr' from the positives' lower one."""
    base = 0 if kind == "fpr" else 1
    cuts = quantiles(rows.filter(F.col(label) == base), groups, score, [1.0 - r for r in rates]).select(*groups, F.posexplode("q").alias("i", "threshold")).select(*groups, F.element_at(F.array(*[F.lit(float(r)) for r in rates]), F.col("i") + 1).alias("rate"), "threshold")
    counts = score_counts(rows, groups, score, label)
    joined = counts.join(F.broadcast(cuts), groups) if groups else counts.join(F.broadcast(cuts))
    hit = F.col("score") >= F.col("threshold")
    out = joined.groupBy(*groups, "rate", "threshold").agg(F.try_divide(F.sum(F.when(hit, F.col("neg")).otherwise(0)), F.sum("neg")).alias("fpr"), F.try_divide(F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum("pos")).alias("tpr"))
    return out.select(*groups, "rate", F.round("threshold", digits).alias("threshold"), F.round("fpr", digits).alias("fpr"), F.round("tpr", digits).alias("tpr"))


def crossings(rows: DataFrame, groups: list[str], low: str, high: str, threshold: float) -> DataFrame:
    """groups, n, upward, downward: rows whose score passes the threshold between two contexts."""
    a, b = F.col(low) >= threshold, F.col(high) >= threshold
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(~a & b).alias("upward"), F.count_if(a & ~b).alias("downward"))


def log_slope(records: DataFrame, groups: list[str], size: str, value: str, digits: int = 6) -> DataFrame:
    """groups, slope: least-squares slope of value on log10 of the context size."""
    return records.groupBy(*groups).agg(F.round(F.regr_slope(F.col(value), F.log10(size)), digits).alias("slope"))


def spearman(rows: DataFrame, groups: list[str], a: str, b: str, digits: int = 6) -> DataFrame:
    """groups, n, spearman: correlation of average ranks."""
    ranked = average_ranks(average_ranks(rows, groups, a, "_ra"), groups, b, "_rb")
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), digits).alias("spearman"))


def run_deltas(rows: DataFrame, groups: list[str], a: str, b: str, digits: int = 6) -> DataFrame:
    """groups, n, mae, max_abs, changed: differences between two runs of one scorer."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg(d), digits).alias("mae"), F.round(F.max(d), digits).alias("max_abs"), F.count_if(F.col(a) != F.col(b)).alias("changed"))


def top_overlap(rows: DataFrame, a: str, b: str, key: str, fraction: float = 0.1) -> DataFrame:
    """n_top, n_both: rows in the top fraction of both scorings, cut at the score and, among ties, the key at that place."""
    n = int(-(-rows.count() * fraction // 1))
    both = _top(rows, a, key, n).join(_top(rows, b, key, n), key, "left_semi")
    return both.agg(F.lit(n).cast("long").alias("n_top"), F.count("*").alias("n_both"))


def _top(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """Keys of the n highest scores, smaller keys first on ties: rows above the n-th score, and of those at it the smallest keys up to
    the key at the place that is left."""
    size = rows.filter(F.col(score).isNotNull()).count()
    if not n or not size:
        return rows.select(key).limit(0)
    at_rank = lambda some, column, k, of: quantiles(some, [], column, [k / max(1, of - 1)]).first()["q"][0]
    cut = at_rank(rows, score, size - n, size) if n < size else rows.agg(F.min(score)).first()[0]
    sizes = rows.agg(F.count_if(F.col(score) > cut).alias("above"), F.count_if(F.col(score) == cut).alias("at")).first()
    tied = rows.filter(F.col(score) == cut)
    last = at_rank(tied, key, min(n - sizes["above"], sizes["at"]) - 1, sizes["at"])
    return rows.filter((F.col(score) > cut) | ((F.col(score) == cut) & (F.col(key) <= last))).select(key)


def rank_models(metrics: DataFrame, groups: list[str], metric: str) -> DataFrame:
    """metrics and position: 1 for the best model of each group, equal for equal values."""
    return metrics.withColumn("position", F.rank().over(Window.partitionBy(*groups).orderBy(F.desc(metric))))


def learner_gaps(metrics: DataFrame, keys: list[str], model: str, left: str, right: str, metric: str, digits: int = 6) -> DataFrame:
    """keys, left, right, gap: two models paired on the same cells; cells with one model are left out."""
    of = lambda m: F.max(F.when(F.col(model) == m, F.col(metric)))
    pivoted = metrics.filter(F.col(model).isin(left, right)).groupBy(*keys).agg(of(left).alias("left_value"), of(right).alias("right_value"))
    return pivoted.filter("left_value is not null and right_value is not null").withColumn("gap", F.round(F.col("left_value") - F.col("right_value"), digits))


def seed_summary(records: DataFrame, groups: list[str], value: str, digits: int = 6) -> DataFrame:
    """groups, runs, mean, std_pop, std_samp, low, high over repeated runs."""
    r = lambda c, n: F.round(c, digits).alias(n)
    return records.groupBy(*groups).agg(F.count(value).alias("runs"), r(F.avg(value), "mean"), r(F.stddev_pop(value), "std_pop"), r(F.stddev_samp(value), "std_samp"), r(F.min(value), "low"), r(F.max(value), "high"))


def margin_quartiles(rows: DataFrame, score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """q25, q75, iqr of all positive-minus-negative margins, without making pairs."""
    q25, q75 = margin_quantiles(rows, [Fraction(1, 4), Fraction(3, 4)], score, label) or (None, None)
    found = [None if q25 is None else round(float(q), digits) for q in (q25, q75, (q75 or 0) - (q25 or 0))]
    return rows.sparkSession.createDataFrame([tuple(found)], "q25 double, q75 double, iqr double")


def margin_quantiles(rows: DataFrame, fractions: list[Fraction], score: str = "score", label: str = "y") -> list[Fraction] | None:
    """Interpolated quantiles of the margins of all pairs; None without pairs. Scores are taken in MARGIN_STEPs (null scores and labels
    take no part). The margin at a place is searched for: a round counts, for CUTS margins in the range that is left, the pairs
    up to each of them, in one pass over the distinct scores; a range of one takes seven rounds."""
    step = F.round(F.col(score).cast("double") / MARGIN_STEP).cast("long")
    counts = score_counts(rows.filter(F.col(score).isNotNull()).select(step.alias("score"), F.col(label).alias("y")), []).filter("pos > 0 or neg > 0").persist()
    try:
        is_pos, is_neg = F.col("pos") > 0, F.col("neg") > 0
        seen = counts.agg(*[f(F.when(c, F.col("score"))).alias(n) for n, f, c in (("pl", F.min, is_pos), ("ph", F.max, is_pos), ("nl", F.min, is_neg), ("nh", F.max, is_neg))], F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
        if not seen["p"] or not seen["n"]:
            return None
        places = [f * (int(seen["p"]) * int(seen["n"]) - 1) for f in fractions]
        # of each wanted place: margins that are below it (no pair up to there reaches it), and margins that are not
        below = {k: seen["pl"] - seen["nh"] - 1 for x in places for k in (math.floor(x), math.ceil(x))}
        reached = dict.fromkeys(below, seen["ph"] - seen["nl"])
        while any(reached[k] - below[k] > 1 for k in below):
            cuts = {below[k] + (reached[k] - below[k]) * i // (CUTS + 1) for k in below for i in range(1, CUTS + 1)} - set(below.values())
            for cut, pairs in _pairs_up_to(counts, sorted(cuts)):
                for k in below:
                    if pairs > k:
                        reached[k] = min(reached[k], cut)
                    else:
                        below[k] = max(below[k], cut)
        at = lambda x: reached[math.floor(x)] + (reached[math.ceil(x)] - reached[math.floor(x)]) * (x - math.floor(x))
        return [at(x) * Fraction(MARGIN_STEP).limit_denominator(10**12) for x in places]
    finally:
        counts.unpersist()


def _pairs_up_to(counts: DataFrame, cuts: list[int]) -> list[tuple[int, int]]:
    """For each cut, the number of pairs whose positive is at most `cut` above its negative: positives are moved down by the cut, and
    the negatives from there on are summed from the highest score."""
    cut = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    moved = counts.filter("pos > 0").select(cut, "score", "pos").select("cut", (F.col("score") - F.col("cut")).alias("at"), F.col("pos").alias("n"), F.lit(1).alias("side"))
    still = counts.filter("neg > 0").select(cut, F.col("score").alias("at"), F.col("neg").alias("n"), F.lit(0).alias("side"))
    # from the highest, negatives before positives at the same place
    placed = moved.union(still).withColumn("place", F.col("at") * 2 - F.col("side"))
    above = prefix_sums(placed, ["cut"], "place", {"above": F.when(F.col("side") == 0, F.col("n")).otherwise(0)}, descending=True).withColumnRenamed("above_before", "above")
    pairs = above.filter("side = 1").groupBy("cut").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("above").cast("decimal(19,0)")).alias("pairs"))
    return [(r["cut"], int(r["pairs"])) for r in pairs.collect()]


def histogram(rows: DataFrame, groups: list[str], score: str = "score", label: str = "y", bins: int = 100) -> DataFrame:
    """groups, y, bin, n: fixed bins on [0, 1], values at or above 1 in the last one."""
    cell = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).cast("int")
    return rows.groupBy(*groups, F.col(label).alias("y"), cell.alias("bin")).agg(F.count("*").alias("n"))
