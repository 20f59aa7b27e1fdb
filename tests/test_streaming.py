"""Streaming operators on file sources, run to the end of what is there."""

import datetime as dt

from ohmflow.streaming import causal

SCHEMA = "building_id int, meter string, timestamp timestamp, meter_reading double, anomaly int, score double, masked boolean"


def source(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, "m", t(h), float(v), a, 0.5, h == 1) for h, v, a in ((0, 10, 1), (1, 12, 1), (2, 1, 0), (5, 15, 1), (60, 9, 0), (200, 1, 0))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    return causal.read_readings(spark, str(tmp_path / "in"), SCHEMA)


def test_causal_changes(spark, tmp_path):
    out = causal.run_once(causal.value_changes(source(spark, tmp_path), 1), "changes", str(tmp_path / "c"))
    got = {r.timestamp.hour + 24 * (r.timestamp.day - 1): r["lag_value_diff_1"] for r in out.collect()}
    assert got[1] == 2.0 and got[2] == -11.0


def test_overrides(spark, tmp_path):
    out = causal.run_once(causal.overrides(source(spark, tmp_path)), "rules", str(tmp_path / "c"))
    got = {r.timestamp.hour + 24 * (r.timestamp.day - 1): r.score for r in out.collect()}
    assert got[0] == 0.5 and got[1] == 0.0 and got[2] == 1.0


def test_segments(spark, tmp_path):
    out = causal.run_once(causal.segments(source(spark, tmp_path)), "sessions", str(tmp_path / "c"))
    assert [(r.start.hour, r.duration_rows) for r in out.collect() if r.start.hour == 0] == [(0, 2)]


def test_daily_completeness(spark, tmp_path):
    out = causal.run_once(causal.daily_completeness(source(spark, tmp_path)), "days", str(tmp_path / "c"))
    got = {r.day.day: r.present for r in out.collect()}
    assert got[1] == 4


def test_causal_set_from_one_state(spark, tmp_path):
    """Rows in any order over several files equal the batch windows up to the last watermark; late rows are dropped, repeated ones kept."""
    import random

    from pyspark.sql import functions as F

    from ohmflow.operators import features
    from ohmflow.streaming import history

    schema = "building_id long, meter string, timestamp timestamp, meter_reading double"
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    r = random.Random(3)
    rows = [(b, m, t(h), None if r.random() < 0.05 else float(r.randint(-1, 9))) for b in (1, 2) for m in ("x", "y") for h in range(0, 260) if r.random() < 0.8]
    rows.sort(key=lambda x: x[2])
    files = [rows[:300], rows[300:500], rows[500:]]
    for part in files:
        r.shuffle(part)  # within a file rows come in any order
    late = (1, "x", t(2), 99.0)
    files[2].append(late)
    again = (2, "y", t(255), 3.0)
    files[2] += [again, again, (None, "x", t(200), 1.0)]
    shifts = (1, 2, 24, 168)
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with history.rocks_state(spark):
            stream = history.causal_features(causal.read_readings(spark, str(tmp_path / "in"), schema), shifts, late="6 hours")
            query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            query.awaitTermination()
    mark = max(x[2] for x in rows) - dt.timedelta(hours=6)
    key = lambda x: repr(x)
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    # in the batch, an hour's highest reading is its past value
    kept = spark.createDataFrame([x for x in [*rows, again, again] if x[2] <= mark], schema)
    hours = kept.groupBy("building_id", "meter", "timestamp").agg(F.max("meter_reading").alias("high"))
    want = kept
    for n in shifts:
        then = hours.select("building_id", "meter", (F.col("timestamp") + F.expr(f"interval {n} hours")).alias("timestamp"), F.col("high").alias(f"h{n}"))
        want = want.join(then, ["building_id", "meter", "timestamp"], "left")
    now = F.col("meter_reading")
    want = want.select("building_id", "meter", "timestamp", "meter_reading", *[c for n in shifts for c in (now - F.col(f"h{n}"), F.try_divide(now + 1, F.col(f"h{n}") + 1))])
    assert got == sorted(map(tuple, want.collect()), key=key) and len(got) > 550
    # without repeated hours the windows of the batch give the same columns
    once = kept.distinct().withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    frames = features.value_changes(once, shifts).select("building_id", "meter", "timestamp", *[f"lag_value_diff_{n}" for n in shifts])
    streamed = spark.read.parquet(str(tmp_path / "out")).distinct().select("building_id", "meter", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *[f"lag_value_diff_{n}" for n in shifts])
    assert frames.exceptAll(streamed).isEmpty() and streamed.exceptAll(frames).isEmpty()


def test_a_stream_has_no_future(spark):
    import pytest

    from ohmflow.streaming import history

    with pytest.raises(ValueError, match="future"):
        history.causal_features(spark.range(1), (1, -1))
