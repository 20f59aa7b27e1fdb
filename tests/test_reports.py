"""Gates that refuse, and reports on planted rows."""

import random

import pytest
from pyspark.sql import functions as F

from ohmflow.operators import models, reports, sampling, segments, splits
from ohmflow.sources import ingest


def frame(spark, rows, schema="k long, y int, score double"):
    return spark.createDataFrame(rows, schema)


def test_arms_of_other_rows_are_refused(spark):
    rows = [(i, i % 2, i / 10 + (i % 2)) for i in range(40)]
    a, b = frame(spark, rows), frame(spark, [(k, y, -s) for k, y, s in rows])
    got = reports.paired_arms(a, b, "k").first()
    assert got.auc_a > 0.5 and abs(got.auc_a + got.auc_b - 1) < 1e-9 and got.delta > 0
    for other in (b.filter("k > 0"), b.withColumn("y", F.when(F.col("k") == 3, 0).otherwise(F.col("y"))), b.unionByName(frame(spark, [(99, 1, 0.0)]))):
        with pytest.raises(ValueError, match="differ"):
            reports.paired_arms(a, other, "k")


def test_orders_and_spans(spark):
    rows = frame(spark, [(i, 0, float(i)) for i in range(20)]).withColumn("place", F.col("k") * 10)
    tell = lambda shard: tuple(reports.order_gap(shard, rows, "k", "place").select("missing", "foreign", "repeated", "disordered").first())
    assert tell(rows) == (0, 0, 0, 0)
    assert tell(rows.filter("k <> 19")) == (1, 0, 0, 0)
    assert tell(rows.withColumn("place", F.when(F.col("k") == 0, 15).otherwise(F.col("place")))) == (0, 0, 0, 2)
    assert tell(rows.unionByName(rows.filter("k = 19")))[2] == 1
    spans = frame(spark, [(0, 0, 9, 10), (1, 10, 19, 10), (2, 21, 29, 9), (3, 30, 39, 9)], "span int, first long, last long, rows long")
    assert [r.broken for r in reports.span_gap(spans).orderBy("span").collect()] == [False, False, True, True]


def test_gates_refuse(spark, tmp_path):
    raw = frame(spark, [(1, 0, 1.0), (2, None, 2.0)])
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert splits.lookup(wanted, raw, "k", ["y"]).count() == 3
    assert splits.lookup(wanted.filter("k = 1"), raw, "k", ["y"], total=True).count() == 1
    for bad in ("k <= 2", "k in (1, 3)"):
        with pytest.raises(ValueError, match="no y"):
            splits.lookup(wanted.filter(bad), raw, "k", ["y"], total=True)
    assert splits.restrict(raw, raw.select("k", "score").limit(1), ["k", "score"]).count() == 1
    with pytest.raises(ValueError, match="absent"):
        splits.restrict(raw, spark.createDataFrame([(1, 2.0)], "k long, score double"), ["k", "score"])
    assert reports.require_finite(raw, ["y", "score"]).count() == 2
    with pytest.raises(ValueError, match="score"):
        reports.require_finite(frame(spark, [(1, 0, float("inf"))]), ["y", "score"])
    (tmp_path / "metadata.csv").write_text("building_id,site_id,building_id_kaggle,site_id_kaggle,primaryspaceusage,sqft,yearbuilt,numberoffloors,timezone\nA,,7,1,Office,100,1990,2,US/Eastern\n")
    (tmp_path / "electricity.csv").write_text("timestamp,A\n2016-01-01 00:00:00,1\n")
    with pytest.raises(ValueError, match="site"):
        ingest.load_archive(spark, str(tmp_path), ["electricity"], "raw", with_weather=False)


def test_drift_is_seen_where_it_is_planted(spark):
    r = random.Random(4)
    rows = [(s, side, r.gauss(0, 1) + (1.0 if s == "moved" and side == "b" else 0.0)) for s in ("moved", "still") for side in "ab" for _ in range(2000)] + [("lone", "a", 1.0), ("still", "b", None)]
    df = spark.createDataFrame(rows, "stratum string, side string, v double")
    got = {x.stratum: x for x in reports.drift_evidence(df, ["stratum"], "side", ["v"]).collect()}
    assert got["moved"].drifted and abs(got["moved"].contrast - 1) < 0.15 and got["moved"].ks > 0.3 and got["moved"].psi > 0.5
    assert not got["still"].drifted and got["still"].n_b == 2000 and not got["lone"].drifted and got["lone"].ks is None
    report = spark.createDataFrame([("moved", 10, 1.0), ("still", 10, 1.0), ("gone", 0, None), ("part", 5, 0.9)], "stratum string, rows long, coverage double")
    verdicts = {x.stratum: x.verdict for x in reports.pilot_verdicts(report, reports.drift_evidence(df, ["stratum"], "side", ["v"]), ["stratum"]).collect()}
    assert verdicts == {"moved": "drifted", "still": "pass", "gone": "empty", "part": "incomplete"}


def test_labels_joined_to_wrong_rows_fail_the_gate(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(b, "m", t(h), b * 1000 + h, int(h % 60 < 12)) for b in range(3) for h in range(480)]
    df = spark.createDataFrame(rows, "building_id int, meter string, timestamp timestamp_ntz, k long, anomaly int")
    stat = lambda d: segments.run_summary(segments.run_lengths(d), [])
    shuffled = lambda s: sampling.shuffle_labels(df, ["building_id"], "k", "anomaly", s).withColumn("anomaly", F.col("shuffled"))
    nulls = stat(shuffled(1)).unionByName(stat(shuffled(2)))
    assert reports.label_join_verdict(stat(df), nulls, "mean").first().passed
    assert not reports.label_join_verdict(stat(shuffled(3)), nulls, "mean").first().passed


def test_search_and_fourth_member(spark):
    r = random.Random(8)
    rows = [(i, a, b, int((a > 0.5) != (b > 0.3)), i % 3) for i in range(900) for a, b in [(r.random(), r.random())]]
    df = spark.createDataFrame(rows, "raw_index long, a double, b double, y int, part int")
    edges = {"a": [0.1 * i for i in range(1, 10)], "b": [0.1 * i for i in range(1, 10)]}
    of = lambda p: df.filter(F.col("part") == p)
    trials = [{"rounds": 1, "depth": 1, "rate": 0.2, "ridge": 1.0}, {"rounds": 5, "depth": 2, "rate": 0.8, "ridge": 1.0}]
    got = {x.arm: x for x in reports.default_and_searched(of(0), of(1), of(2), ["a", "b"], edges, trials).collect()}
    assert got["searched"].trial == 2 and got["searched"].test_pr >= got["default"].test_pr - 0.02 and got["searched"].test_roc > 0.9
    assert reports.sampled_trials(4, 1) == reports.sampled_trials(4, 1) != reports.sampled_trials(4, 2)
    member = {"symmetric": models.symmetric_member(of(0), ["a", "b"])}
    scored = models.score_members(of(1), {}, ["a", "b"], ["raw_index", "y"], member)
    assert scored.columns == ["raw_index", "y", "symmetric", "ensemble"] and scored.filter("(symmetric >= 0.5) <> (y = 1)").count() < 30
