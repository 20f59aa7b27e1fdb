"""Reports by stratum and gates that refuse: drift evidence, paired arms, unit summaries, search over models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators import metrics, placements, trees
from ohmflow.operators.features import quantiles
from ohmflow.operators.scan import prefix_sums
from ohmflow.sources.sinks import stored

#: From these on a shift counts as drift (share of a gap, stability index).
KS_LIMIT, PSI_LIMIT = 0.1, 0.2


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def drift_evidence(rows: DataFrame, groups: list[str], side: str, columns: list[str], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """groups, field, n_a, n_b, ks, psi, median_a, median_b, contrast (b less a), drifted: how each column of side 'b' (overlap) lies against side 'a' (the rest)
    within each group. Nulls are left out; psi bins are quantiles of a, and a field without rows on either side has nulls."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    long = rows.select(*groups, F.col(side).alias("_side"), fields).select(*groups, "_side", "x.*").filter("v is not null and _side in ('a', 'b')")
    keys = [*groups, "field"]
    counts = long.groupBy(*keys, "v").agg(F.count_if(F.col("_side") == "a").alias("_a"), F.count_if(F.col("_side") == "b").alias("_b"))
    steps = prefix_sums(counts, keys, "v", {"a": "_a", "b": "_b"})
    share = lambda s: F.try_divide((F.col(f"{s}_before") + F.col(f"_{s}")).cast("double"), F.col(f"{s}_total"))
    ks = steps.groupBy(*keys).agg(F.max("a_total").alias("n_a"), F.max("b_total").alias("n_b"), F.max(F.abs(share("a") - share("b"))).alias("_ks"))
    of = lambda s, points, name: quantiles(long.filter(F.col("_side") == s), keys, "v", points, name)
    edges = of("a", [i / bins for i in range(1, bins)], "_e").withColumn("_e", F.array_distinct("_e"))
    cells = counts.join(edges, keys).withColumn("_bin", F.size(F.filter("_e", lambda e: e <= F.col("v")))).groupBy(*keys, "_bin").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    whole = Window.partitionBy(*keys)  # of at most `bins` rows
    p, q = (F.greatest(F.try_divide(F.col(c).cast("double"), F.sum(c).over(whole)), F.lit(floor)) for c in ("_a", "_b"))
    psi = cells.select(*keys, ((q - p) * F.ln(q / p)).alias("_t")).groupBy(*keys).agg(F.sum("_t").alias("_psi"))
    both = ks.join(psi, keys, "left").join(of("a", [0.5], "_ma"), keys, "left").join(of("b", [0.5], "_mb"), keys, "left")
    a, b = F.col("_ma")[0], F.col("_mb")[0]
    some = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    drifted = some & ((F.round("_ks", 6) >= KS_LIMIT) | (F.round("_psi", 6) >= PSI_LIMIT))
    return both.select(*keys, "n_a", "n_b", _r(F.when(some, F.col("_ks")), "ks"), _r(F.when(some, F.col("_psi")), "psi"), _r(a, "median_a"), _r(b, "median_b"), _r(b - a, "contrast"), drifted.alias("drifted"))


def pilot_verdicts(report: DataFrame, evidence: DataFrame, groups: list[str]) -> DataFrame:
    """groups, rows, coverage, drifted_fields, verdict of a transfer: empty, incomplete (not all rows scored), drifted (evidence on any field) or pass."""
    seen = evidence.groupBy(*groups).agg(F.count_if("drifted").alias("drifted_fields"))
    verdict = F.when(F.col("rows") == 0, "empty").when(F.col("coverage") < 1, "incomplete").when(F.col("drifted_fields") > 0, "drifted").otherwise("pass")
    return report.join(seen, groups, "left").withColumn("drifted_fields", F.coalesce("drifted_fields", F.lit(0))).select(*groups, "rows", "coverage", "drifted_fields", verdict.alias("verdict"))


def paired_arms(a: DataFrame, b: DataFrame, key: str, score: str = "score", label: str = "y") -> DataFrame:
    """Both arms' areas on one and the same set of rows, their gap and its error (placements.paired_areas). Arms that do not describe the same rows with the
    same labels are refused."""
    left, right = a.select(key, F.col(label).alias("y"), F.col(score).alias("a")), b.select(F.col(key).alias("_k"), F.col(label).alias("_y"), F.col(score).alias("b"))
    both = left.join(right, F.col(key) == F.col("_k"), "full_outer")
    if not both.filter(F.col(key).isNull() | F.col("_k").isNull() | ~F.col("y").eqNullSafe(F.col("_y"))).isEmpty():
        raise ValueError("the arms differ in rows or labels")
    return placements.paired_areas(both, "a", "b", "y")


def order_gap(shard: DataFrame, canonical: DataFrame, key: str, position: str) -> DataFrame:
    """missing, foreign, repeated, disordered: rows of the canonical slice that the shard lacks, rows that only the shard has, ids that it repeats, and
    rows whose place in the shard's own order is not their place in key order."""
    from ohmflow.sources.sinks import ranked

    own = ranked(shard.select(key, position), position).select(F.col(key).alias("_k"), F.col("rank").alias("_own"))
    wanted = ranked(canonical.select(key), key).select(key, F.col("rank").alias("_wanted"))
    met = wanted.join(own, F.col(key) == F.col("_k"), "full_outer")
    repeats = shard.groupBy(key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
    return met.agg(F.count_if(F.col("_k").isNull()).alias("missing"), F.count_if(F.col(key).isNull()).alias("foreign"), F.count_if(F.col("_own") != F.col("_wanted")).alias("disordered")).join(repeats)


def span_gap(spans: DataFrame) -> DataFrame:
    """span, first, last, rows, broken of checkpoint spans (span, first, last, rows; positions from 0): a span is broken that does not begin where the one before it
    ends, or whose rows are not its width."""
    order = Window.orderBy("first", "span")  # spans are as many as checkpoints
    expected = F.coalesce(F.lag("last").over(order) + 1, F.lit(0))
    return spans.select("span", "first", "last", "rows", ((F.col("first") != expected) | (F.col("last") - F.col("first") + 1 != F.col("rows"))).alias("broken"))


def finite_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, rows, nulls, nans, infinite, nan_fraction of numeric columns, from one aggregation."""
    one = []
    for c in columns:
        v = F.col(c).cast("double")
        one.append(F.struct(F.lit(c).alias("field"), F.count("*").alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinite")))
    found = rows.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return found.withColumn("nan_fraction", F.round(F.try_divide((F.col("nulls") + F.col("nans")).cast("double"), F.col("rows")), 6))


def require_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows; infinite values are refused."""
    bad = [r["field"] for r in finite_report(rows, columns).filter("infinite > 0").collect()]
    if bad:
        raise ValueError(f"infinite values in {', '.join(sorted(bad))}")
    return rows


def unit_summary(rows: DataFrame, unit: list[str], cohort: list[str], columns: list[str]) -> DataFrame:
    """cohort, field, units, low, median, high: of units' row counts (field n_rows) and of their null fractions of each column."""
    null = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    per = rows.groupBy(*cohort, *unit).agg(F.count("*").cast("double").alias("n_rows"), *null)
    long = per.unpivot([*cohort, *unit], ["n_rows", *columns], "field", "v")
    found = long.groupBy(*cohort, "field").agg(F.count("*").alias("units"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return found.join(quantiles(long, [*cohort, "field"], "v", [0.5], "_q"), [*cohort, "field"]).select(*cohort, "field", "units", _r(F.col("_lo"), "low"), _r(F.col("_q")[0], "median"), _r(F.col("_hi"), "high"))


def composition_by_flag(rows: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """flag (null: all), field, value, n, share of every value of several columns, split by a flag, in one pass."""
    long = rows.select(F.explode(F.array(F.lit(None).cast("boolean"), F.col(flag))).alias("flag"), *columns)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    counts = long.select("flag", fields).groupBy("flag", "x.field", "x.value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("flag").alias("_flag"), F.col("field").alias("_field")).agg(F.sum("n").alias("_t"))
    met = counts.join(F.broadcast(totals), F.col("flag").eqNullSafe(F.col("_flag")) & (F.col("field") == F.col("_field")))
    return met.select("flag", "field", "value", "n", _r(F.col("n") / F.col("_t").cast("double"), "share"))


def rates_by(rows: DataFrame, label: str, keys: dict[str, Column]) -> DataFrame:
    """by, value, rows, anomalies, rate over several keys (building, month), in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("by"), c.cast("string").alias("value")) for n, c in keys.items()])).alias("x")
    return rows.select(F.col(label).alias("_y"), each).groupBy("x.by", "x.value").agg(F.count("*").alias("rows"), F.sum("_y").alias("anomalies"), _r(F.avg("_y"), "rate"))


def recall_threshold_from(rows: DataFrame, groups: list[str], target: float, score: str = "score", label: str = "y") -> DataFrame:
    """groups, threshold, recall: of the distinct scores in descending order the first one whose recall reaches the target, whatever its class."""
    points = metrics.curve(rows, groups, score, label).filter("n_pos > 0").withColumn("recall", F.col("tp") / F.col("n_pos").cast("double"))
    best = points.filter(F.col("tp") >= target * F.col("n_pos")).groupBy(*groups).agg(F.max(F.struct("score", "recall")).alias("b"))
    return best.select(*groups, F.col("b.score").alias("threshold"), _r(F.col("b.recall"), "recall"))


def dominance(effects: DataFrame, groups: list[str]) -> DataFrame:
    """groups, main_a, main_b, interaction, dominant: which effect of a factorial is the largest; 'none' if all are 0 or missing."""
    size = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    most = F.greatest(*[size(c) for c in ("main_a", "main_b", "interaction")])
    name = F.when(most == 0, "none").when(size("main_a") == most, "main_a").when(size("main_b") == most, "main_b").otherwise("interaction")
    return effects.select(*groups, "main_a", "main_b", "interaction", name.alias("dominant"))


def ranking_change(before: DataFrame, after: DataFrame, item: str, value: str, noise: float = 0.0005) -> DataFrame:
    """item, rank_before, rank_after, delta, verdict: places of models under two regimes (ties share a place); a change within the noise floor is none."""
    order = Window.orderBy(F.desc(value))  # models are few
    places = lambda d, n: d.select(item, F.rank().over(order).alias(f"rank_{n}"), F.col(value).alias(f"_{n}"))
    both = places(before, "before").join(places(after, "after"), item)
    delta = F.col("_after") - F.col("_before")
    verdict = F.when(F.abs(delta) <= noise, "same").when(F.col("rank_before") == F.col("rank_after"), "moved").otherwise("reordered")
    return both.select(item, "rank_before", "rank_after", _r(delta, "delta"), verdict.alias("verdict"))


def segment_deviations(rows: DataFrame, segs: DataFrame, keys: list[str], value: str = "meter_reading") -> DataFrame:
    """keys, island, n, mean_deviation, max_deviation of a segment's readings from the median of its series, signed by the segment's mean. rows has a segment column (segments.attach)."""
    middle = quantiles(rows, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias("_m"))
    off = rows.filter("segment is not null").join(middle, keys).withColumn("_d", F.col(value) - F.col("_m"))
    found = off.groupBy(*keys, F.col("segment").alias("island")).agg(F.count("*").alias("n"), _r(F.avg("_d"), "mean_deviation"), _r(F.max(F.abs("_d")), "max_deviation"))
    return segs.select(*keys, "island").join(found, [*keys, "island"])


def label_join_verdict(observed: DataFrame, nulls: DataFrame, value: str, margin: float = 2.0) -> DataFrame:
    """observed, null_mean, null_high, passed: a run statistic of the labels against the same of labels shuffled within buildings. It passes where it exceeds every
    shuffled one and the shuffled mean `margin` times: labels that were joined to wrong rows look like shuffled ones."""
    n = nulls.agg(F.avg(value).alias("_m"), F.max(value).alias("_h"))
    passed = (F.col(value) > F.col("_h")) & (F.col(value) >= margin * F.col("_m"))
    return observed.join(n).select(_r(F.col(value), "observed"), _r(F.col("_m"), "null_mean"), _r(F.col("_h"), "null_high"), F.coalesce(passed, F.lit(False)).alias("passed"))


def sampled_trials(n: int, seed: int = 0) -> list[dict]:
    """Settings of a random search, each value drawn by a hash of seed, trial and name."""
    import hashlib

    space = {"rounds": [2, 3, 4, 6], "depth": [1, 2, 3], "rate": [0.2, 0.3, 0.5, 0.8], "ridge": [0.5, 1.0, 5.0, 20.0]}
    draw = lambda i, k: int(hashlib.md5(f"{seed}:{i}:{k}".encode()).hexdigest(), 16)
    return [{k: v[draw(i, k) % len(v)] for k, v in space.items()} for i in range(n)]


def default_and_searched(train: DataFrame, validation: DataFrame, test: DataFrame, features: list[str], edges: dict, trials: list[dict], label: str = "y") -> DataFrame:
    """arm, trial, validation_pr, test_pr, test_roc: symmetric trees with their default settings, and with those of the trial of best validation PR area (the first on ties).
    A tree knows a row by its bins only, so each part is reduced once to distinct bins with counts, by which all trials are fitted and evaluated."""
    spark = train.sparkSession
    default = {"rounds": 2, "depth": 2, "rate": 0.5, "ridge": 1.0}
    most = max(len(e) for e in edges.values()) + 1
    cells = lambda rows, tag: stored(trees.unit_cells(rows, [[]], features, edges, label), tag)
    fitted_on = cells(train, "train-cells")
    # a class of a cell is a row of so many
    sides = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("w")))).alias("_c")
    validation, test = (cells(rows, tag).select("x", sides).select("x", "_c.*") for rows, tag in ((validation, "validation-cells"), (test, "test-cells")))

    def areas(part, model, depth):
        score = trees.symmetric_score(model, features, edges, depth, 9, "x") if model else F.lit(0.5)
        return metrics.roc_pr(part.withColumn("score", score), [], "score", "y", "w").first() or {"pr_auc": None, "roc_auc": None}

    def run(settings):
        row = trees.grow_units(fitted_on, most, symmetric=True, **settings).first()
        model = row.asDict(recursive=True) if row else None
        return model, areas(validation, model, settings["depth"])["pr_auc"]

    found = [(s, *run(s)) for s in [default, *trials]]
    best = max(range(1, len(found)), key=lambda i: (found[i][2] or 0.0, -i))
    out = []
    for arm, i in (("default", 0), ("searched", best)):
        s, model, area = found[i]
        t = areas(test, model, s["depth"])
        out.append((arm, i, area, t["pr_auc"], t["roc_auc"]))
    return spark.createDataFrame(out, "arm string, trial int, validation_pr double, test_pr double, test_roc double")
