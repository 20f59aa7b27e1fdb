"""Gates as tables: one row per check, with how many rows break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, failures, passed from one aggregation of counts; a null count is no failure."""
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "check", "failures").withColumn("passed", F.col("failures") == 0)


def manifest_checks(selected: DataFrame, candidates: DataFrame, size: int, key: str, label: str = "anomaly", excluded: Column | None = None, digest: int | None = None) -> DataFrame:
    """check, failures, passed of a context: size (rows too many or few), unique, member (rows that are no candidates), parity (classes
    apart by more than one row), label (values that drifted from the candidates'), excluded (rows that the intervention forbids) and
    digest (its order-free fingerprint differs from the recorded one)."""
    known = candidates.select(F.col(key).alias("_k"), F.col(label).alias("_y"), F.lit(1).alias("_c"))
    both = selected.join(known, F.col(key) == F.col("_k"), "left")
    n = F.count("*")
    checks = {
        "size": F.abs(n - size),
        "unique": n - F.count_distinct(key),
        "member": F.count_if(F.col("_c").isNull()),
        "parity": F.greatest(F.abs(F.count_if(F.col(label) == 1) - F.count_if(F.col(label) == 0)) - 1, F.lit(0)),
        "label": F.count_if(F.col("_c").isNotNull() & ~F.col(label).eqNullSafe(F.col("_y"))),
        "excluded": F.count_if(F.coalesce(F.lit(False) if excluded is None else excluded, F.lit(False))),
    }
    if digest is not None:
        checks["digest"] = (F.bit_xor(F.xxhash64(F.col(key).cast("long"))) != F.lit(digest)).cast("int")
    return _checks(both, checks)


def ladder_checks(ladder: DataFrame, roles: list[str]) -> DataFrame:
    """check, failures, passed of nested building sets (budget, position, building_id, role): unique, size (budgets without as many
    buildings), prefix (a position whose building differs between budgets), roles (unknown, or changing with the budget)."""
    per = ladder.groupBy("budget").agg(F.count("*").alias("n"), F.count_distinct("building_id").alias("d"))
    spots = ladder.groupBy("position").agg(F.count_distinct("building_id").alias("d"))
    kinds = ladder.groupBy("building_id").agg(F.count_distinct("role").alias("d"), F.max((~F.col("role").isin(roles)).cast("int")).alias("bad"))
    one = lambda df, name, c: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias("failures")).select(F.lit(name).alias("check"), "failures")
    found = one(per, "unique", F.sum(F.col("n") - F.col("d"))).unionByName(one(per, "size", F.count_if(F.col("n") != F.col("budget")))).unionByName(one(spots, "prefix", F.count_if(F.col("d") > 1))).unionByName(one(kinds, "roles", F.count_if((F.col("d") > 1) | (F.col("bad") == 1))))
    return found.withColumn("passed", F.col("failures") == 0)


def prediction_checks(rows: DataFrame, key: str, score: str, expected: int) -> DataFrame:
    """check, failures, passed: length (against the expected rows), unique ids, finite scores, range [0, 1]."""
    s = F.col(score)
    bad = s.isNull() | F.isnan(s.cast("double")) | (F.abs(s) == float("inf"))
    return _checks(rows, {"length": F.abs(F.count("*") - expected), "unique": F.count("*") - F.count_distinct(key), "finite": F.count_if(bad), "range": F.count_if(~bad & ~s.between(0, 1))})


def matched_contexts(units: DataFrame, keys: list[str], family: str, fields: list[str]) -> DataFrame:
    """keys, families, differing (fields whose value is not the same in all families, nulls equal nulls), matched (at least two families
    and nothing differing)."""
    apart = sum((F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\u0000"))) > 1).cast("int") for f in fields)
    per = units.groupBy(*keys).agg(F.count_distinct(family).alias("families"), apart.cast("long").alias("differing"))
    return per.withColumn("matched", (F.col("families") >= 2) & (F.col("differing") == 0))


def feature_checks(shard: DataFrame, rebuilt: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """field, missing (rows that one side lacks), not_finite, differing, passed: a feature shard against features built anew. Columns
    that the shard lacks are refused."""
    lacking = [c for c in columns if c not in shard.columns]
    if lacking:
        raise ValueError(f"the shard lacks {', '.join(lacking)}")
    a = shard.select(F.col(key).alias("_k"), F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("_a"))
    b = rebuilt.select(F.col(key).alias("_k"), F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("_b"))
    both = a.join(b, "_k", "full_outer").withColumn("_lost", F.col("_a").isNull() | F.col("_b").isNull())
    out = []
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        apart = ~F.col("_lost") & ((x.isNull() != y.isNull()) | (F.abs(x - y) > tolerance))
        out.append(F.struct(F.lit(c).alias("field"), F.count_if("_lost").alias("missing"), F.count_if(odd).alias("not_finite"), F.count_if(apart).alias("differing")))
    found = both.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return found.withColumn("passed", (F.col("missing") == 0) & (F.col("not_finite") == 0) & (F.col("differing") == 0))


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_a, n_b, only_a, only_b, repeated, aligned: whether two tables hold the same keys once each."""
    both = a.groupBy(key).agg(F.count("*").alias("_a")).join(b.groupBy(key).agg(F.count("*").alias("_b")), key, "full_outer").fillna(0, ["_a", "_b"])
    found = both.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_b"), F.count_if(F.col("_b") == 0).alias("only_a"), F.count_if(F.col("_a") == 0).alias("only_b"), F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("repeated"))
    return found.withColumn("aligned", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("repeated") == 0))
