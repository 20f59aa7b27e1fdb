"""Model operators on a small separable table."""

import random

import pytest

from ohmflow.operators import models


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        x = r.random()
        rows.append((i, x, None if i % 11 == 0 else r.random(), int(x > 0.6), i % 4 == 0))
    return spark.createDataFrame(rows, "raw_index long, x0 double, x1 double, y int, stop boolean").cache()


def test_scaler_skips_nulls_and_keeps_them(frame):
    scaler = models.fit_scaler(frame, ["x0", "x1"])
    scaled = models.scale(frame, scaler)
    assert scaled.filter("x1 is null").count() == frame.filter("x1 is null").count()
    again = models.fit_scaler(scaled, ["x0", "x1"])
    assert abs(again["x1"][0]) < 1e-9 and abs(again["x1"][1] - 1) < 1e-9


def test_ensemble_and_early_stop(frame):
    from pyspark.ml.classification import RandomForestClassifier

    fitted = models.fit_members(frame, ["x0", "x1"], {"forest": RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=3, seed=1)})
    scored = models.score_members(frame, fitted, ["x0", "x1"], ["raw_index", "y"])
    wrong = scored.filter("(ensemble >= 0.5) <> (y = 1)").count()
    assert wrong < 20
    _, rounds = models.fit_early_stopped(frame, ["x0", "x1"], "stop", max_rounds=4)
    assert 1 <= rounds <= 4


def test_tuning_picks_the_better_trial(frame):
    trial, area, _ = models.tune(frame, frame, ["x0", "x1"], [{"maxIter": 1, "maxDepth": 1, "seed": 1}, {"maxIter": 3, "maxDepth": 3, "seed": 1}], ["raw_index", "y"])
    assert area > 0.9 and trial in ({"maxIter": 1, "maxDepth": 1, "seed": 1}, {"maxIter": 3, "maxDepth": 3, "seed": 1})


def test_column_sets():
    sets = models.ablate(["a", "b", "c"], {"bc": ["b", "c"]})
    assert sets == {"all": ["a", "b", "c"], "without_bc": ["a"]}
