"""Load profiles of buildings: vectors by hour, and groups of like ones."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmflow.operators.features import TIE, robust_load_z, seconds
from ohmflow.sources.sinks import stored


def load_vectors(rows: DataFrame, building: str = "building_id", value: str = "meter_reading", ts: str = "timestamp", period: int | None = 168, digits: int = 6) -> DataFrame:
    """building, hours (vector indexed by hour, 0 where nothing was measured), n_hours (of them measured). Readings are standardised per building, those
    beyond ten deviations are masked, logarithms of the rest are standardised again, and hours that fall on one index are averaged. period: hours after which
    the index begins anew (168: the week's hour, from Monday); None: an index for each hour from the first one in the table."""
    # read for each mean and deviation, so written once
    kept = stored(rows.select(building, ts, value), "load-rows")
    z = robust_load_z(kept, value, building).filter("z is not null")
    hour = F.floor(seconds(ts) / 3600).cast("long")
    if period:
        # 1970-01-01 was a Thursday
        index, size = F.pmod(hour + 72, F.lit(period)).cast("int"), F.lit(period)
    else:
        ends = z.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).first()
        index, size = (hour - F.lit(ends["lo"] or 0)).cast("int"), F.lit(((ends["hi"] or 0) - (ends["lo"] or 0)) + 1)
    means = z.groupBy(building, index.alias("_i")).agg(F.round(F.avg("z") + TIE, digits).alias("_z"))
    packed = means.groupBy(building).agg(F.array_sort(F.collect_list(F.struct("_i", "_z"))).alias("_m"))
    # each hour brings the zeros since the one before, so a vector takes steps in proportion to its length
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    gap = lambda m, at: m["_i"] - F.coalesce(F.get("_m", at - 1)["_i"], F.lit(-1)) - 1
    filled = F.flatten(F.transform("_m", lambda m, at: F.concat(zeros(gap(m, at)), F.array(m["_z"]))))
    return packed.select(building, F.concat(filled, zeros(size - 1 - F.element_at("_m", -1)["_i"])).alias("hours"), F.size("_m").alias("n_hours"))


def load_groups(vectors: DataFrame, building: str = "building_id", k: int = 10, starts: int = 10, seed: int = 1) -> tuple[DataFrame, dict]:
    """building, cluster of the best of `starts` starts by cost, and its cost, silhouette (cosine-free, squared distances) and stability: the share of pairs of
    buildings that the best and the second-best start both keep together or apart (the adjusted Rand index)."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    # from a table, so that each of the many passes has as many tasks as the vectors' size asks for, not as many as a shuffle has parts
    data = stored(vectors.select(building, "hours"), "load-vectors").select(building, array_to_vector("hours").alias("features")).cache()
    try:
        fits = sorted(((m.summary.trainingCost, s, m) for s in range(starts) for m in [KMeans(k=k, seed=seed + s, maxIter=20).fit(data)]), key=lambda x: x[:2])
        best, second = (f[2].transform(data) for f in (fits[0], fits[min(1, len(fits) - 1)]))
        used = best.select("prediction").distinct().count()
        silhouette = ClusteringEvaluator().evaluate(best) if 1 < used else None
        pair = best.select(building, F.col("prediction").alias("a")).join(second.select(building, F.col("prediction").alias("b")), building)
        choose = lambda c: c * (c - 1) / 2
        cells = pair.groupBy("a", "b").agg(F.count("*").alias("n")).toPandas()  # k squared rows at most
        both, rows, columns, total = choose(cells["n"]).sum(), choose(cells.groupby("a")["n"].sum()).sum(), choose(cells.groupby("b")["n"].sum()).sum(), choose(cells["n"].sum())
        expected = rows * columns / total if total else 0
        span = (rows + columns) / 2 - expected
        stability = float((both - expected) / span) if span else 1.0
        found = stored(best.select(building, F.col("prediction").alias("cluster")), "load-groups")
        return found, {"cost": float(fits[0][0]), "silhouette": silhouette, "stability": stability}
    finally:
        data.unpersist()
