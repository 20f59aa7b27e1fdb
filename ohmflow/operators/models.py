"""Model operators on tables, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmflow.operators import metrics, trees
from ohmflow.operators.features import quantiles


def fit_scaler(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, nulls skipped; no spread counts as 1."""
    found = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Scaled columns; nulls stay."""
    return rows.select(*[((F.col(c) - scaler[c][0]) / scaler[c][1]).alias(c) if c in scaler else F.col(c) for c in rows.columns])


def vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows and features: nulls count as 0, the mean of a scaled column."""
    filled = rows.fillna(0.0, subset=columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def members(seed: int = 7, rounds: int = 10) -> dict[str, object]:
    """The ensemble's members by name."""
    return {
        "gbt_deep": GBTClassifier(labelCol="y", maxDepth=5, maxIter=rounds, seed=seed),
        "gbt_shallow": GBTClassifier(labelCol="y", maxDepth=3, maxIter=rounds, seed=seed, stepSize=0.2),
        "forest": RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=6, seed=seed),
    }


def fit_members(train: DataFrame, columns: list[str], which: dict | None = None) -> dict[str, object]:
    data = vectors(train.withColumn("y", F.col("y").cast("double")), columns).select("features", "y")
    return {name: estimator.fit(data) for name, estimator in (which or members()).items()}


def score_members(rows: DataFrame, models: dict[str, object], columns: list[str], keep: list[str], others: dict[str, Column] | None = None) -> DataFrame:
    """keep, one score column per member, and their equal-weight mean as ensemble. others: members that score as columns of rows."""
    others = others or {}
    data = vectors(rows.select("*", *[c.alias(n) for n, c in others.items()]), columns)
    for name, model in models.items():
        data = model.transform(data).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    members = [*models, *others]
    mean = sum((F.col(n) for n in members), F.lit(0.0)) / len(members)
    return data.select(*keep, *members, mean.alias("ensemble"))


def symmetric_member(train: DataFrame, columns: list[str], rounds: int = 6, depth: int = 3) -> Column:
    """A boosted member of symmetric trees, fitted on these rows, as a score column: a member of its own kind beside the others."""
    edges = trees.default_edges(train, columns)
    found = trees.fit_units(train, [[]], columns, edges, rounds=rounds, depth=depth, symmetric=True).first()
    return trees.symmetric_score(found.asDict(recursive=True), columns, edges, depth, 9) if found else F.lit(0.5)


def fit_early_stopped(train: DataFrame, columns: list[str], stop: str, max_rounds: int = 20, seed: int = 7):
    """A boosted model whose rounds are chosen on the rows where `stop` is true, refitted on the others with that many."""
    data = vectors(train.withColumn("y", F.col("y").cast("double")), columns)
    probe = GBTClassifier(labelCol="y", maxDepth=3, maxIter=max_rounds, seed=seed, validationIndicatorCol=stop).fit(data)
    rounds = max(1, probe.getNumTrees)
    return GBTClassifier(labelCol="y", maxDepth=3, maxIter=rounds, seed=seed).fit(data.filter(~F.col(stop))), rounds


def tune(train: DataFrame, validation: DataFrame, columns: list[str], trials: list[dict], keep: list[str]):
    """(trial, pr_auc, model) of the best configuration by step-form PR area on the validation rows."""
    best = None
    for trial in trials:
        models = fit_members(train, columns, {"m": GBTClassifier(labelCol="y", **trial)})
        found = metrics.roc_pr(score_members(validation, models, columns, keep), [], "ensemble", "y").first()["pr_auc"]
        if best is None or (found or 0) > (best[1] or 0):
            best = (trial, found, models["m"])
    return best


def unit_means(rows: DataFrame, unit: str, feature: str, label: str = "y") -> DataFrame:
    """unit, cut, above, below: a one-split model per unit, in one aggregation: the unit's median as cut and the class rate on
    either side; units of one class have no model."""
    both = rows.groupBy(unit).agg(F.sum(label).alias("_p"), F.count("*").alias("_n")).filter("_p between 1 and _n - 1").select(unit)
    cuts = quantiles(rows, [unit], feature, [0.5]).join(both, unit).select(unit, F.col("q")[0].alias("cut"))
    over = F.col(feature) > F.col("cut")
    return rows.join(cuts, unit).groupBy(unit, "cut").agg(F.avg(F.when(over, F.col(label))).alias("above"), F.avg(F.when(~over, F.col(label))).alias("below"))


def route(rows: DataFrame, fine: DataFrame, coarse: DataFrame, unit: str, fallback: str, feature: str, digits: int = 6) -> DataFrame:
    """rows, score, routed: the unit's own model, else the coarser unit's."""
    of = lambda m, p: F.when(F.col(feature) > F.col(f"{p}cut"), F.col(f"{p}above")).otherwise(F.col(f"{p}below"))
    a = fine.select(unit, *[F.col(c).alias(f"f_{c}") for c in ("cut", "above", "below")])
    b = coarse.select(fallback, *[F.col(c).alias(f"c_{c}") for c in ("cut", "above", "below")])
    joined = rows.join(a, unit, "left").join(F.broadcast(b), fallback, "left")
    own = F.when(F.col("f_cut").isNotNull(), of(fine, "f_"))
    return joined.withColumn("score", F.round(F.coalesce(own, of(coarse, "c_")), digits)).withColumn("routed", F.when(F.col("f_cut").isNotNull(), "unit").when(F.col("c_cut").isNotNull(), "fallback").otherwise("none")).select(*rows.columns, "score", "routed")


def cluster(rows: DataFrame, column: str, k: int = 10, starts: int = 3, seed: int = 1) -> DataFrame:
    """rows and cluster of the best of several starts by training cost."""
    data = rows.withColumn("features", F.col(column))
    best = None
    for s in range(starts):
        model = KMeans(k=k, seed=seed + s, maxIter=10).fit(data)
        if best is None or model.summary.trainingCost < best[0]:
            best = (model.summary.trainingCost, model)
    return best[1].transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def ablate(columns: list[str], groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Column sets without each group, and all of them."""
    return {"all": columns} | {f"without_{n}": [c for c in columns if c not in g] for n, g in groups.items()}
