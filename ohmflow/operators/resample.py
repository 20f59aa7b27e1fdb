"""Resampling: bootstrap over clusters and rows, leave-one-out, factorial effects, permutation importance. The fact table is
never copied per draw: it is reduced first (to cluster and score counts), and draws are weights joined to the reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators import metrics
from ohmflow.operators.scan import digest_ranks, prefix_sums

#: Two-sided 95 % points of Student's t by degrees of freedom.
T_95 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272)

#: Fixed value: the normal one.
Z_95 = 1.959963984540054


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from md5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson(u: Column, top: int = 6) -> Column:
    """Poisson(1) count at quantile u."""
    mass, total = 0.36787944117144233, 0.0
    cuts = []
    for k in range(top):
        total += mass
        cuts.append(total)
        mass /= k + 1
    out = F.lit(top)
    for k in range(top - 1, -1, -1):
        out = F.when(u < cuts[k], F.lit(k)).otherwise(out)
    return out


def cluster_draws(clusters: DataFrame, cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """draw, cluster, weight: how often each draw takes each cluster, with replacement; weight 0 is left out. Clusters are a
    small table: draw i of n picks the cluster at floor(u * n)."""
    numbered = clusters.select(cluster).distinct().withColumn("_i", F.row_number().over(Window.orderBy(cluster)) - 1)
    n = numbered.count()
    spark = clusters.sparkSession
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("slot"))
    picked = picks.select("draw", F.floor(unit_hash(F.lit(seed), F.col("draw"), F.col("slot")) * n).cast("int").alias("_i"))
    return picked.groupBy("draw", "_i").agg(F.count("*").alias("weight")).join(F.broadcast(numbered), "_i").select("draw", cluster, "weight")


def cluster_bootstrap(rows: DataFrame, cluster: str, groups: list[str], draws: int, score: str = "score", label: str = "y", seed: int = 0, digits: int = 6) -> DataFrame:
    """draw, groups, n_pos, n_neg, roc_auc, pr_auc: draws are matched, as every group uses the same cluster weights; one-class draws have nulls."""
    counts = metrics.score_counts(rows, [*groups, cluster], score, label)
    drawn = counts.join(cluster_draws(rows, cluster, draws, seed), cluster)
    long = drawn.groupBy("draw", *groups, "score").agg(F.sum(F.col("pos") * F.col("weight")).alias("pos"), F.sum(F.col("neg") * F.col("weight")).alias("neg"))
    return _areas(long, ["draw", *groups], digits)


def _areas(counts: DataFrame, groups: list[str], digits: int) -> DataFrame:
    """Areas from groups, score, pos, neg."""
    long = counts.select(*groups, "score", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("w")), F.struct(F.lit(0).alias("y"), F.col("neg").alias("w")))).alias("x")).select(*groups, "score", "x.*").filter("w > 0")
    return metrics.roc_pr(long, groups, "score", "y", "w", digits)


def intervals(draws: DataFrame, groups: list[str], value: str, digits: int = 6) -> DataFrame:
    """groups, draws, invalid, median, low (2.5 %), high (97.5 %), positive_share, excludes_zero."""
    r = lambda c, n: F.round(c, digits).alias(n)
    lo, hi = F.percentile(value, 0.025), F.percentile(value, 0.975)
    return draws.groupBy(*groups).agg(F.count("*").alias("draws"), F.count_if(F.col(value).isNull()).alias("invalid"), r(F.percentile(value, 0.5), "median"), r(lo, "low"), r(hi, "high"), r(F.avg((F.col(value) > 0).cast("double")), "positive_share"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


def mean_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int, seed: int = 0, digits: int = 9) -> DataFrame:
    """draw, mean over the drawn clusters' means."""
    means = rows.groupBy(cluster).agg(F.avg(value).alias("_m"))
    drawn = means.join(cluster_draws(means, cluster, draws, seed), cluster)
    return drawn.groupBy("draw").agg(F.round(F.sum(F.col("_m") * F.col("weight")) / F.sum("weight"), digits).alias("mean"))


def leave_one_mean(rows: DataFrame, cluster: str, value: str, digits: int = 6) -> DataFrame:
    """cluster, mean, without, influence: the mean of cluster means without each cluster."""
    means = rows.groupBy(cluster).agg(F.avg(value).alias("_m"))
    whole = means.agg(F.sum("_m").alias("_s"), F.count("*").alias("_n"))
    without = F.try_divide(F.col("_s") - F.col("_m"), F.nullif(F.col("_n") - 1, F.lit(0)).cast("double"))
    return means.join(F.broadcast(whole)).select(cluster, F.round("_m", digits).alias("mean"), F.round(without, digits).alias("without"), F.round(without - F.col("_s") / F.col("_n"), digits).alias("influence"))


def leave_one_auc(rows: DataFrame, cluster: str, score: str = "score", label: str = "y", digits: int = 6) -> DataFrame:
    """cluster, without: the pooled area without each cluster, from pair counts: all pairs less those that the cluster is in."""
    counts = metrics.score_counts(rows, [cluster], score, label)
    pooled = counts.groupBy("score").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    lifted = metrics.curve_of(pooled.select("score", F.col("p").alias("pos"), F.col("n").alias("neg")), [])
    # a positive at a score wins over the negatives below it, a negative loses to the positives above it; ties are half
    ladder = lifted.select("score", (F.col("n_neg") - F.col("fp") + F.col("neg") / F.lit(2.0)).alias("wins"), (F.col("tp_before") + F.col("pos") / F.lit(2.0)).alias("losses"), "n_pos", "n_neg")
    total = lifted.agg(F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / F.lit(2.0))).alias("won"))
    own = prefix_sums(counts, [cluster], "score", {"neg": "neg"}).withColumnRenamed("neg_before", "own_below")
    parts = own.join(ladder, "score").groupBy(cluster).agg(
        F.sum(F.col("pos") * F.col("wins")).alias("a"), F.sum(F.col("neg") * F.col("losses")).alias("b"), F.sum(F.col("pos") * (F.col("own_below") + F.col("neg") / F.lit(2.0))).alias("both"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("n_pos").alias("np"), F.max("n_neg").alias("nn")
    )
    left = F.col("won") - F.col("a") - F.col("b") + F.col("both")
    pairs = (F.col("np") - F.col("p")) * (F.col("nn") - F.col("n"))
    return parts.join(F.broadcast(total)).select(cluster, F.round(F.try_divide(left, F.nullif(pairs, F.lit(0)).cast("double")), digits).alias("without"))


def paired_row_bootstrap(rows: DataFrame, key: str, a: str, b: str, draws: int, label: str = "y", seed: int = 0, digits: int = 6) -> DataFrame:
    """draw, auc_a, auc_b, delta with Poisson(1) row weights from a hash of row and draw; both models see the same weights. Weights are
    summed per distinct score of either model at once."""
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson(unit_hash(F.lit(seed), F.col("draw"), F.col(key)))).filter("w > 0")
    long = drawn.select("draw", label, "w", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col(a).alias("score")), F.struct(F.lit("b").alias("model"), F.col(b).alias("score")))).alias("x")).select("draw", label, "w", "x.*")
    areas = metrics.roc_pr(long, ["draw", "model"], "score", label, "w", digits)
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("roc_auc")))
    return areas.groupBy("draw").agg(of("a").alias("auc_a"), of("b").alias("auc_b")).withColumn("delta", F.round(F.col("auc_a") - F.col("auc_b"), digits))


def half_width(records: DataFrame, groups: list[str], value: str, limit: float, digits: int = 6) -> DataFrame:
    """groups, n, mean, half_width (95 %, Student's t), precise: whether it is within the limit. Beyond the table's degrees of freedom the
    normal point is expanded in their inverse, which is right to a millionth there."""
    n = F.count(value)
    listed = F.element_at(F.array(*[F.lit(x) for x in T_95]), F.greatest(F.lit(1), F.least(n - 1, F.lit(len(T_95)))).cast("int"))
    z, v = Z_95, (n - 1).cast("double")
    expanded = F.lit(z) + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (v * v * v)
    t = F.when(n - 1 <= len(T_95), listed).otherwise(expanded)
    width = F.when(n > 1, F.stddev_samp(value) / F.sqrt(n) * t)
    return records.groupBy(*groups).agg(n.alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(width, digits).alias("half_width"), F.coalesce(width <= limit, F.lit(False)).alias("precise"))


def factorial(cells: DataFrame, groups: list[str], a: str, b: str, value: str, digits: int = 6) -> DataFrame:
    """groups, main_a, main_b, interaction of a 2x2 design with levels 0 and 1; null where a cell is missing."""
    of = lambda x, y: F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value)))
    c = cells.groupBy(*groups).agg(of(0, 0).alias("_00"), of(0, 1).alias("_01"), of(1, 0).alias("_10"), of(1, 1).alias("_11"))
    r = lambda x, n: F.round(x, digits).alias(n)
    v = F.col
    return c.select(*groups, r((v("_10") + v("_11") - v("_00") - v("_01")) / 2, "main_a"), r((v("_01") + v("_11") - v("_00") - v("_10")) / 2, "main_b"), r(v("_11") - v("_10") - v("_01") + v("_00"), "interaction"))


def permuted(rows: DataFrame, column: str, key: str, repeats: int, groups: list[str], seed: int = 0) -> DataFrame:
    """repeat and rows, the column's values dealt anew within groups: pairing ranks by key with ranks by a hash of key and repeat. Ranks by key are
    made once for all repeats; of a repeat only key and value are dealt."""
    own = prefix_sums(rows, groups, key, {"_i": F.lit(1).cast("long")}).withColumnRenamed("_i_before", "_i").drop("_i_total")
    many = rows.select(*groups, key, F.col(column).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(key).cast("string")))
    other = digest_ranks(many, ["repeat", *groups], hashed, key, "_i").drop(key)
    return own.join(other, [*groups, "_i"]).withColumn(column, F.col("_v")).drop("_i", "_v")


def consensus(importance: DataFrame, model: str = "model", feature: str = "feature", value: str = "importance", top: int = 10, digits: int = 6) -> DataFrame:
    """feature, votes (models that rank it in the top), mean_rank."""
    ranked = importance.withColumn("_r", F.rank().over(Window.partitionBy(model).orderBy(F.desc(value))))
    return ranked.groupBy(feature).agg(F.count_if(F.col("_r") <= top).alias("votes"), F.round(F.avg("_r"), digits).alias("mean_rank"))
