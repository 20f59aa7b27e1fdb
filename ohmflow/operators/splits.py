"""Splits as columns, and gates that return the rows which break a rule (none when it holds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmflow.functions.scalar import priority

def mod(column: str, divisor: int) -> Column:
    return F.pmod(F.col(column), F.lit(divisor))


def side(holdout: Column) -> Column:
    return F.when(holdout, "val").otherwise("train")


def building_split(rows: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """rows and side of 80_20_mod5, 50_50_mod2 or 50_50_random (the half of buildings of least priority trains)."""
    if name == "80_20_mod5":
        return rows.withColumn("side", side(mod("building_id", 5) == 4))
    if name == "50_50_mod2":
        return rows.withColumn("side", side(mod("building_id", 2) == 1))
    if name != "50_50_random":
        raise ValueError(f"unknown split {name}")
    ids = rows.select("building_id").distinct().withColumn("_p", priority(seed, F.col("building_id")))
    half = ids.orderBy("_p", "building_id").limit(ids.count() // 2).select("building_id", F.lit("train").alias("side"))
    return rows.join(half, "building_id", "left").withColumn("side", F.coalesce("side", F.lit("val")))


def leave_sites_out(sites: list[int]) -> Column:
    return side(F.col("site_id").isin(sites))


def location_side(name: str, fold: int = 0, site: int | None = None) -> Column:
    """A0 odd buildings, A1 even sites train, A2 odd sites train, A3 one of four site groups out, A4 one site out."""
    rules = {"A0": mod("building_id", 2) == 1, "A1": mod("site_id", 2) == 1, "A2": mod("site_id", 2) == 0, "A3": mod("site_id", 4) == fold}
    if name == "A4":
        if site is None:
            raise ValueError("A4 needs a site")
        return side(F.col("site_id") == site)
    if name not in rules:
        raise ValueError(f"unknown split {name}")
    return side(rules[name])


def all_sites_out(rows: DataFrame) -> DataFrame:
    """fold, side, and the columns of rows: every site held out in turn, one job for all folds."""
    folds = rows.select(F.col("site_id").alias("fold")).distinct()
    return rows.join(F.broadcast(folds)).withColumn("side", F.when(F.col("site_id") == F.col("fold"), "val").otherwise("train"))


def in_site_oracle(site: int) -> Column:
    """Within one site, even buildings train and odd ones are held out; other sites are outside."""
    return F.when(F.col("site_id") != site, "out").otherwise(side(mod("building_id", 2) == 1))


def source_calibration() -> Column:
    """Within the source, buildings 4 mod 5 calibrate and the others fit."""
    return F.when(mod("building_id", 5) == 4, "calibration").otherwise("fit")


def site_mod(divisor: int) -> Column:
    return side(mod("site_id", divisor) == divisor - 1)


def time_side(ts: str = "timestamp", month: int = 9) -> Column:
    """Months before `month` train."""
    return side(F.month(ts) >= month)


def windows(edges: tuple[str, str], ts: str = "timestamp") -> Column:
    """train, calib, test by two moments."""
    return F.when(F.col(ts) < F.lit(edges[0]).cast("timestamp_ntz"), "train").when(F.col(ts) < F.lit(edges[1]).cast("timestamp_ntz"), "calib").otherwise("test")


def unit_key(fields: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(f).cast("string") for f in fields])


def scorable_units(rows: DataFrame, unit: str, label: str = "anomaly", window: str = "window") -> DataFrame:
    """unit, rows, positives of units whose training rows hold both classes."""
    return rows.filter(F.col(window) == "train").groupBy(unit).agg(F.count("*").alias("rows"), F.sum(label).alias("positives")).filter("positives between 1 and rows - 1")


def select_units(units: DataFrame, unit: str, cap: int, seed: int = 0) -> DataFrame:
    """At most cap units, by stable priority."""
    return units.orderBy(priority(seed, F.col(unit)), unit).limit(cap)


def unit_rows(rows: DataFrame, unit: str, window: str = "window") -> DataFrame:
    """unit, train, calib, test row counts."""
    return rows.groupBy(unit).agg(*[F.count_if(F.col(window) == w).alias(w) for w in ("train", "calib", "test")])


def protocol(rows: DataFrame, seed: int, validation_rows: int, key: str = "raw_index") -> DataFrame:
    """rows and role: odd buildings are the holdout, a fixed number of even buildings' rows validates, the others fit."""
    even = rows.filter(mod("building_id", 2) == 0)
    picked = even.select(key).orderBy(priority(seed, F.col(key)), key).limit(validation_rows).withColumn("_v", F.lit(True))
    return rows.join(picked, key, "left").withColumn("role", F.when(mod("building_id", 2) == 1, "holdout").when(F.col("_v"), "validation").otherwise("fit")).drop("_v")


def compositions(rows: DataFrame, meters: list[str]) -> DataFrame:
    """scenario and rows: all meters, each meter dropped, each meter alone; one pass with a scenario column."""
    scenarios = [("all", None, None), *[(f"without_{m}", m, None) for m in meters], *[(f"only_{m}", None, m) for m in meters]]
    keep = F.array(*[F.when((F.lit(True) if drop is None else F.col("meter") != drop) & (F.lit(True) if only is None else F.col("meter") == only), F.lit(name)) for name, drop, only in scenarios])
    return rows.withColumn("scenario", F.explode(F.filter(keep, lambda x: x.isNotNull())))


def three_way() -> Column:
    """Odd buildings test; of the even ones, 0 mod 4 fit and 2 mod 4 validate."""
    return F.when(mod("building_id", 2) == 1, "test").when(mod("building_id", 4) == 0, "fit").otherwise("val")


def split_manifest(rows: DataFrame, label: str = "anomaly", digits: int = 6) -> DataFrame:
    """side, rows, anomalies, rate, sites, buildings."""
    return rows.groupBy("side").agg(F.count("*").alias("rows"), F.sum(label).alias("anomalies"), F.round(F.avg(label), digits).alias("rate"), F.count_distinct("site_id").alias("sites"), F.count_distinct("building_id").alias("buildings"))


# --- gates -----------------------------------------------------------------------------------------------------------


def overlap(rows: DataFrame, key: str, a: str = "train", b: str = "val") -> DataFrame:
    """Keys on both sides of a split."""
    return rows.filter(F.col("side") == a).select(key).intersect(rows.filter(F.col("side") == b).select(key))


def assert_disjoint(rows: DataFrame, key: str = "building_id", name: str = "split") -> None:
    if not overlap(rows, key).isEmpty():
        raise ValueError(f"{name}: a {key} is on both sides")


def coverage_gap(folds: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Rows that folds lack, hold too often, or hold beside the reference: key, n."""
    return folds.groupBy(key).agg(F.count("*").alias("n")).join(reference.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer").filter("n is null or n <> 1 or _r is null").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def nesting_gap(smaller: DataFrame, larger: DataFrame, key: str) -> DataFrame:
    """Rows of the smaller context that the larger lacks."""
    return smaller.select(key).join(larger.select(key), key, "left_anti")


def future_leaks(rows: DataFrame, unit: str, window: str = "window", ts: str = "timestamp") -> DataFrame:
    """Units whose last training time is not before their first test time."""
    spans = rows.groupBy(unit).agg(F.max(F.when(F.col(window) == "train", F.col(ts))).alias("last_train"), F.min(F.when(F.col(window) == "test", F.col(ts))).alias("first_test"))
    return spans.filter("last_train >= first_test")


def identity_gap(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """only_a, only_b, differing: how two tables that should describe the same rows differ."""
    x = a.select(*keys, F.struct(*columns).alias("_a"))
    y = b.select(*keys, F.struct(*columns).alias("_b"))
    both = x.join(y, keys, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"))


def parity_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table without an equal row in the other, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def content_leaks(fit: DataFrame, holdout: DataFrame, features: list[str], key: str) -> DataFrame:
    """Holdout rows that equal a fit row on every feature (nulls equal nulls): joined by hash, then compared."""
    seen = fit.select(F.xxhash64(*features).alias("_h"), F.struct(*features).alias("_f")).distinct()
    own = holdout.withColumn("_h", F.xxhash64(*features)).withColumn("_o", F.struct(*features)).alias("o")
    return own.join(seen.alias("s"), (F.col("o._h") == F.col("s._h")) & F.col("o._o").eqNullSafe(F.col("s._f")), "left_semi").select(key)


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """rows, sum_hash (as text), xor_hash: an order-free fingerprint of ids by md5, merged from partial ones, the same in any engine."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("long").cast("string")), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def ordered_digest(rows: DataFrame, groups: list[str], key: str) -> DataFrame:
    """groups, n, sha256 of each group's comma-joined ordered ids; for small groups, such as selections."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key))), ","), 256).alias("sha256"))


def golden_gap(metrics: DataFrame, golden: DataFrame, keys: list[str], value: str, noise: float = 0.0005) -> DataFrame:
    """keys, value, golden, passed: metrics within the noise floor of their golden value."""
    return metrics.join(golden.select(*keys, F.col(value).alias("golden")), keys, "left").select(*keys, value, "golden", F.coalesce(F.abs(F.col(value) - F.col("golden")) <= noise, F.lit(False)).alias("passed"))


def transfer_verdict(report: DataFrame) -> DataFrame:
    """report and verdict from coverage, rows and buildings of a stratum."""
    return report.withColumn("powered", (F.col("buildings") >= 5) & (F.col("rows") >= 17544)).withColumn("verdict", F.when(F.col("rows") == 0, "empty").when(F.col("coverage") < 1, "incomplete").when(~F.col("powered"), "underpowered").otherwise("pass"))


def ablation_class(deltas: DataFrame, column: str = "delta", tolerance: float = 0.0005) -> DataFrame:
    """deltas and effect: harmful when dropping the feature helps, useful when it hurts, else neutral."""
    return deltas.withColumn("effect", F.when(F.col(column) > tolerance, "harmful").when(F.col(column) < -tolerance, "useful").otherwise("neutral"))


# --- row identity ----------------------------------------------------------------------------------------------------


def restrict(rows: DataFrame, wanted: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows of the wanted keys (one column or several); an absent key is refused."""
    keys = [key] if isinstance(key, str) else key
    if not wanted.select(*keys).join(rows.select(*keys), keys, "left_anti").isEmpty():
        raise ValueError(f"a wanted {', '.join(keys)} is absent")
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def lookup(wanted: DataFrame, rows: DataFrame, key: str, columns: list[str], total: bool = False) -> DataFrame:
    """wanted with columns of the raw rows, and found: false where the raw table lacks the key. total: a key that the raw table lacks, or has without a
    value, is refused."""
    met = wanted.join(rows.select(key, *columns, F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if total and not met.filter(~F.col("found") | F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)).cast("boolean")).isEmpty():
        raise ValueError(f"a wanted {key} has no {', '.join(columns)}")
    return met


def whole_series(rows: DataFrame, wanted: DataFrame, key: str, series: list[str], build) -> DataFrame:
    """Features that `build` makes from the complete series of the wanted rows, for exactly those rows."""
    picked = rows.join(wanted.select(key), key, "left_semi").select(*series).distinct()
    return build(rows.join(picked, series, "left_semi")).join(wanted.select(key), key, "left_semi")
