"""The segmented prefix scan: brute force, balance, and plans without a window over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from ohmflow.operators import features, metrics, resample, scan
from ohmflow.sources import sinks


@pytest.mark.parametrize("descending", [False, True])
def test_equals_running_sums(spark, descending):
    r = random.Random(2)
    values = [None, *map(float, r.sample(range(10**6), 900)), 1e12, -1e12]
    rows = [(g, v, r.randint(0, 5), None if r.random() < 0.1 else r.randint(0, 3)) for v in values for g in ("big",)]
    rows += [(g, v, 1, 2) for g in ("a", "b", None) for v in r.sample(values, 5)] + [("one", 3.0, 4, None)]
    df = spark.createDataFrame(rows, "g string, v double, n long, m long").repartition(3)
    for groups in (["g"], []):
        use = df if groups else df.filter("g = 'big'")
        got = {(x.g, x.v): (x.a_before, x.a_total, x.b_before, x.b_total) for x in scan.prefix_sums(use, groups, "v", {"a": "n", "b": "m"}, descending).collect()}
        key = lambda v: (v is not None, v or 0)
        for g in {x[0] for x in rows} if groups else {"big"}:
            own = sorted((x for x in rows if x[0] == g), key=lambda x: key(x[1]), reverse=descending)
            a = b = 0
            for x in own:
                assert got[g, x[1]] == (a, sum(y[2] for y in own), b, sum(y[3] or 0 for y in own))
                a, b = a + x[2], b + (x[3] or 0)
        assert len(got) == use.count()
    assert scan.prefix_sums(df.limit(0), ["g"], "v", {"a": "n"}).collect() == []
    assert scan.prefix_sums(df.limit(0), [], "v", {"a": "n"}).collect() == []


def test_one_group_and_an_odd_value_are_spread(spark):
    """No task has over twice the mean of the rows."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.col("id") / 40_000).alias("v")).union(spark.createDataFrame([("g", 1e12)], "g string, v double"))
    scanned = scan.prefix_sums(df, ["g"], "v", {"c": F.lit(1)})
    sizes = [x["count"] for x in scanned.groupBy(F.spark_partition_id()).count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == parts and max(sizes) <= 2 * 40_001 / parts


def windows_without_parts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "windowspecdefinition(" in line and "_part" not in line]


def test_plans_have_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([(i, i % 2, i / 7, "m") for i in range(50)], "raw_index long, y int, score double, meter string")
    for made in (metrics.curve(df, []), metrics.curve(df, ["meter"]), features.quantiles(df, [], "score", [0.5]), features.quantiles(df, ["meter"], "score", [0.5]), metrics.average_ranks(df, [], "score"), sinks.ranked(df, "raw_index")):
        assert windows_without_parts(made) == []


def test_rows_without_a_score_are_not_scored(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (None, 1), (float("nan"), 1), (3.0, None), (4.0, 1)], "score double, y int")
    got = metrics.roc_pr(df, []).first()
    assert (got.n_pos, got.n_neg, got.roc_auc) == (2, 1, 0.5)


def test_half_width_beyond_the_table(spark):
    r = random.Random(1)
    for n, t in ((31, 2.042272), (32, 2.039513), (61, 2.000298), (1001, 1.962339)):
        values = [r.gauss(0, 1) for _ in range(n)]
        df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
        got = resample.half_width(df, ["g"], "v", 0.5, digits=9).first()
        mean = sum(values) / n
        sd = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5
        assert abs(got.half_width - t * sd / n**0.5) < 2e-6
