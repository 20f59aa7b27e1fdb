"""Uncertainty of areas without copies of rows: the covariance of placement values.

A positive's placement is the share of negatives below it (ties half), a negative's that of positives above it. Rows are reduced to distinct
pairs of scores with counts once; placements are looked up in running counts of distinct scores, and their sums of products give the
covariance of both models' areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmflow.operators import metrics
from ohmflow.sources.sinks import stored

Z_95 = 1.959963984540054


def _placements(cells: DataFrame, score: str, name: str) -> DataFrame:
    """The score and its placements as a positive and as a negative."""
    counts = cells.groupBy(score).agg(F.sum(F.col("n") * F.col("y")).alias("_pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("_neg"))
    scanned = metrics.prefix_sums(counts, [], score, {"pos": "_pos", "neg": "_neg"})
    share = lambda before, own, total: F.try_divide(before + own / F.lit(2.0), total.cast("double"))
    above = F.col("pos_total") - F.col("pos_before") - F.col("_pos")
    return scanned.select(F.col(score).alias(f"_{name}"), share(F.col("neg_before"), F.col("_neg"), F.col("neg_total")).alias(f"{name}_p"), share(above, F.col("_pos"), F.col("pos_total")).alias(f"{name}_n"))


def paired_areas(rows: DataFrame, a: str, b: str, label: str = "y", digits: int = 6) -> DataFrame:
    """n_pos, n_neg, auc_a, auc_b, delta, se_a, se_b, se_delta, low, high (95 % of delta): rows with both scores and a label; null with under two
    rows of a class."""
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isNotNull())
    cells = stored(known.groupBy(F.col(a).alias("a"), F.col(b).alias("b"), F.col(label).cast("long").alias("y")).agg(F.count("*").alias("n")), "pairs")
    met = cells.join(_placements(cells, "a", "pa"), F.col("a") == F.col("_pa")).join(_placements(cells, "b", "pb"), F.col("b") == F.col("_pb"))
    placed = met.select("y", "n", F.when(F.col("y") == 1, F.col("pa_p")).otherwise(F.col("pa_n")).alias("va"), F.when(F.col("y") == 1, F.col("pb_p")).otherwise(F.col("pb_n")).alias("vb"))
    n, va, vb = F.col("n"), F.col("va"), F.col("vb")
    means = placed.groupBy("y").agg(F.sum(n).alias("m"), (F.sum(n * va) / F.sum(n)).alias("ma"), (F.sum(n * vb) / F.sum(n)).alias("mb"))
    # deviations first, so that close areas lose no digits
    off = placed.join(F.broadcast(means), "y").select("y", "n", "m", "ma", "mb", (va - F.col("ma")).alias("da"), (vb - F.col("mb")).alias("db"))
    spread = lambda x, y: F.try_divide(F.sum(n * F.col(x) * F.col(y)), (F.max("m") - 1).cast("double"))
    side = off.groupBy("y").agg(F.max("m").alias("m"), F.max("ma").alias("ma"), F.max("mb").alias("mb"), spread("da", "da").alias("aa"), spread("db", "db").alias("bb"), spread("da", "db").alias("ab"))
    of = lambda c, y: F.max(F.when(F.col("y") == y, F.col(c)))
    wide = side.agg(*[of(c, y).alias(f"{c}{y}") for c in ("m", "ma", "mb", "aa", "bb", "ab") for y in (0, 1)])
    var = lambda c: F.try_divide(F.col(f"{c}1"), F.col("m1").cast("double")) + F.try_divide(F.col(f"{c}0"), F.col("m0").cast("double"))
    full = wide.select(F.coalesce("m1", F.lit(0)).alias("n_pos"), F.coalesce("m0", F.lit(0)).alias("n_neg"), F.when(F.col("m0") > 0, F.col("ma1")).alias("auc_a"), F.when(F.col("m0") > 0, F.col("mb1")).alias("auc_b"), F.sqrt(var("aa")).alias("se_a"), F.sqrt(var("bb")).alias("se_b"), F.sqrt(F.greatest(var("aa") + var("bb") - 2 * var("ab"), F.lit(0.0))).alias("se_delta"))
    r = lambda c, name: F.round(c, digits).alias(name)
    c = F.col
    delta = c("auc_a") - c("auc_b")
    return full.select("n_pos", "n_neg", r(c("auc_a"), "auc_a"), r(c("auc_b"), "auc_b"), r(delta, "delta"), r(c("se_a"), "se_a"), r(c("se_b"), "se_b"), r(c("se_delta"), "se_delta"), r(delta - Z_95 * c("se_delta"), "low"), r(delta + Z_95 * c("se_delta"), "high"))
