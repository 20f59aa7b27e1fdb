"""Areas, thresholds and resampling against direct computations."""

import random

import pytest

from ohmflow.operators import metrics, resample


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(rows):
    total, tp, seen = 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        here = [y for t, y in rows if t == s]
        tp, seen = tp + sum(here), seen + len(here)
        total += sum(here) * tp / seen
    return total / sum(y for _, y in rows)


@pytest.fixture(scope="module")
def sample():
    r = random.Random(3)
    return [(i, r.choice("ab"), r.randint(0, 9) / 10, int(r.random() < 0.3)) for i in range(400)]


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample, "id int, g string, score double, y int")


def test_pooled_and_grouped_areas(frame, sample):
    whole = metrics.roc_pr(frame, []).first()
    rows = [(s, y) for _, _, s, y in sample]
    assert whole.roc_auc == pytest.approx(auc(rows), abs=1e-6)
    assert whole.pr_auc == pytest.approx(average_precision(rows), abs=1e-6)
    for r in metrics.roc_pr(frame, ["g"]).collect():
        assert r.roc_auc == pytest.approx(auc([(s, y) for _, g, s, y in sample if g == r.g]), abs=1e-6)


def test_one_class_group_has_no_areas(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.1, 0), ("b", 0.3, 1)], "g string, score double, y int")
    got = {r.g: (r.roc_auc, r.pr_auc) for r in metrics.roc_pr(df, ["g"]).collect()}
    assert got == {"a": (None, None), "b": (1.0, 1.0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, score double, y int")
    assert metrics.roc_pr(df, ["g"]).collect() == []
    assert metrics.pairwise_auc(df, "g").collect() == []


def test_pairwise_areas(frame, sample):
    for r in metrics.pairwise_auc(frame, "g").collect():
        rows = [(s, 1) for _, g, s, y in sample if y and g == r.pos_group] + [(s, 0) for _, g, s, y in sample if not y and g == r.neg_group]
        assert r.auc == pytest.approx(auc(rows), abs=1e-6)


def test_area_without_group(frame, sample):
    for r in resample.leave_one_auc(frame, "g").collect():
        assert r.without == pytest.approx(auc([(s, y) for _, g, s, y in sample if g != r.g]), abs=1e-6)


def test_matched_draws_and_intervals(frame):
    draws = resample.cluster_bootstrap(frame, "g", [], 8)
    assert draws.count() == 8
    one = resample.intervals(draws, [], "roc_auc").first()
    assert one.draws == 8 and one.low <= one.median <= one.high


def test_thresholds(frame, sample):
    t = metrics.recall_threshold(frame, [], 0.8).first().threshold
    pos = [s for _, _, s, y in sample if y]
    assert sum(s >= t for s in pos) >= 0.8 * len(pos) > sum(s > t for s in pos)


def test_factorial_sign(spark):
    cells = spark.createDataFrame([("x", 0, 0, 1.0), ("x", 0, 1, 2.0), ("x", 1, 0, 3.0), ("x", 1, 1, 7.0)], "g string, a int, b int, v double")
    r = resample.factorial(cells, ["g"], "a", "b", "v").first()
    assert (r.main_a, r.main_b, r.interaction) == (3.5, 2.5, 3.0)


def test_margin_quartiles_equal_all_pairs(spark):
    draw = random.Random(5)
    rows = [(round(draw.gauss(0, 2), 4), int(draw.random() < 0.3)) for _ in range(200)] + [(None, 1), (0.5, None)]
    margins = sorted(a - b for a, y in rows if y == 1 and a is not None for b, z in rows if z == 0)
    got = metrics.margin_quartiles(spark.createDataFrame(rows, "score double, y int")).first()
    for name, share in (("q25", 0.25), ("q75", 0.75)):
        place = share * (len(margins) - 1)
        low, high = margins[int(place)], margins[min(int(place) + 1, len(margins) - 1)]
        assert abs(got[name] - (low + (high - low) * (place - int(place)))) < 2e-6
    assert abs(got["iqr"] - (got["q75"] - got["q25"])) < 2e-6


def test_margin_quartiles_of_one_class_are_null(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.25, 1)], "score double, y int")
    assert tuple(metrics.margin_quartiles(rows).first()) == (None, None, None)
    assert tuple(metrics.margin_quartiles(rows.limit(0)).first()) == (None, None, None)
