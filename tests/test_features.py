"""Value changes, calendar and rules on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ohmflow.functions import scalar
from ohmflow.operators import features, segments

T = lambda h, day=1, month=1, year=2016: dt.datetime(year, month, day, h)


def gapped(spark):
    rows = [(1, 0, T(0), 10.0), (1, 0, T(1), 12.0), (1, 0, T(3), 15.0), (2, 0, T(0), 20.0), (2, 0, T(1), 18.0)]
    return spark.createDataFrame(rows, "building_id int, meter int, timestamp timestamp_ntz, meter_reading double")


def test_gap_gives_null_by_hour_and_a_value_by_row(spark):
    hour = {(r.building_id, r.timestamp): r for r in features.value_changes(gapped(spark), [1]).collect()}
    assert hour[1, T(1)]["lag_value_diff_1"] == 2.0
    assert hour[1, T(1)]["lag_value_ratio_1"] == pytest.approx(13 / 11)
    assert hour[1, T(3)]["lag_value_diff_1"] is None
    row = {(r.building_id, r.timestamp): r for r in features.value_changes(gapped(spark), [1], "row_offset").collect()}
    assert row[1, T(3)]["lag_value_diff_1"] == 3.0


def test_meters_keep_apart(spark):
    rows = [(1, 0, T(0), 10.0), (1, 1, T(0), 100.0), (1, 0, T(1), 12.0), (1, 1, T(1), 105.0)]
    df = spark.createDataFrame(rows, "building_id int, meter int, timestamp timestamp_ntz, meter_reading double")
    own = {(r.meter, r.timestamp.hour): r["lag_value_diff_1"] for r in features.value_changes(df, [1]).collect()}
    assert own[0, 1] == 2.0 and own[1, 1] == 5.0
    crossed = {(r.meter, r.timestamp.hour): r["lag_value_diff_1"] for r in features.value_changes(df, [1], "row_offset").collect()}
    assert crossed[1, 0] == 90.0


def test_future_shift_and_zero_denominator(spark):
    rows = [(1, 0, T(0), -1.0), (1, 0, T(1), 4.0)]
    df = spark.createDataFrame(rows, "building_id int, meter int, timestamp timestamp_ntz, meter_reading double")
    got = {r.timestamp.hour: r for r in features.value_changes(df, [1, -1]).collect()}
    assert got[1]["lag_value_ratio_1"] is None  # over zero
    assert got[0]["lag_value_diff_-1"] == -5.0


def test_unknown_regime(spark):
    with pytest.raises(ValueError):
        features.value_changes(gapped(spark), [1], "sideways")


def test_holidays_by_country(spark):
    rows = spark.createDataFrame([(T(5, 4, 7), "US/Eastern"), (T(5, 25, 12, 2017), "Europe/London"), (T(5, 5, 7), "US/Pacific")], "timestamp timestamp_ntz, timezone string")
    days = spark.createDataFrame([("US", dt.date(2016, 7, 4)), ("GB", dt.date(2017, 12, 25))], "country string, date date")
    got = {r.timezone: r.is_holiday for r in scalar.holidays(rows, days).collect()}
    assert got == {"US/Eastern": True, "Europe/London": True, "US/Pacific": False}


def test_end_of_year_knows_leap_years(spark):
    rows = spark.createDataFrame([(T(23, 31, 12, 2016), 366.9584), (T(23, 31, 12, 2017), 365.9584), (T(22, 31, 12, 2017), 365.9167)], "timestamp timestamp_ntz, doy double")
    assert [r.e for r in rows.select(scalar.end_of_year(F.col("timestamp"), F.col("doy")).alias("e")).collect()] == [True, True, False]


def test_feature_sets():
    base = [f"x{i}" for i in range(17)]
    assert len(scalar.feature_names("full", base)) == 137
    assert len(scalar.feature_names("causal", base)) == 77
    assert len(scalar.causal_columns(scalar.feature_names("full", base))) == 77
    assert scalar.correlated_group("lag_value_diff_2", scalar.feature_names("full", base)) == ["lag_value_diff_2", "lag_value_ratio_2", "lag_value_diff_1", "lag_value_diff_3"]


def test_context_tags():
    assert scalar.context_tag("meter_heavy:2:0.7") == {"kind": "meter_heavy", "meter": "2", "share": 0.7}
    with pytest.raises(ValueError):
        scalar.context_tag("meter_heavy:2")


def test_segments_break_at_gaps(spark):
    rows = [(1, 0, T(h), float(h), 1) for h in (0, 1, 2, 5, 6)] + [(1, 0, T(3), 9.0, 0)]
    df = spark.createDataFrame(rows, "building_id int, meter int, timestamp timestamp_ntz, meter_reading double, anomaly int")
    got = sorted((r.island, r.duration_rows, r.slope) for r in segments.segments(df).collect())
    assert got == [(1, 3, 1.0), (2, 2, 1.0)]
    placed = {r.timestamp.hour: r.segment for r in segments.attach(df, segments.segments(df)).collect()}
    assert placed == {0: 1, 1: 1, 2: 1, 3: None, 5: 2, 6: 2}


def test_hours_are_exact_over_a_clock_change(spark):
    """A session zone with a clock change moves no reading."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("select 1L as building_id, 0 as meter, cast(concat('2024-03-10 0', id, ':00:00') as timestamp_ntz) as timestamp, cast(id * id as double) as meter_reading from range(6)")
        got = {r.timestamp.hour: r.lag_value_diff_1 for r in features.value_changes(rows, [1]).collect()}
        assert got == {0: None, 1: 1.0, 2: 3.0, 3: 5.0, 4: 7.0, 5: 9.0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_quantiles_equal_percentiles(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.pmod(F.col("id") * 7919, F.lit(101)) / 4.0).alias("v"))
    points = [0.0, 0.1, 0.5, 0.99, 1.0]
    want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", points).alias("q")).collect()}
    assert {r.g: r.q for r in features.quantiles(rows, ["g"], "v", points).collect()} == {g: [__import__("pytest").approx(x) for x in q] for g, q in want.items()}
    whole = rows.agg(F.percentile("v", points).alias("q")).first().q
    assert features.quantiles(rows, [], "v", points).first().q == __import__("pytest").approx(whole)
