"""Samples, splits, gates, loaders and sinks."""

import pytest

from ohmflow.operators import sampling, splits
from ohmflow.sources import ingest, sinks


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, i % 16, i % 48, "abcd"[i % 4], int(i % 5 == 0)) for i in range(960)]
    return spark.createDataFrame(rows, "raw_index long, site_id int, building_id int, meter string, anomaly int")


def test_downsample_is_balanced(frame):
    pos = frame.filter("anomaly = 1").count()
    got = sampling.downsample(frame, "raw_index")
    assert got.count() == 4 * pos
    assert got.filter("anomaly = 1").count() == 2 * pos


def test_nested_budgets(frame):
    got = sampling.nested_balanced(frame, "raw_index", [10, 40, 100])
    assert sampling.balanced_prefix_gap(got).isEmpty()
    small, large = got.filter("budget = 10"), got.filter("budget = 40")
    assert splits.nesting_gap(small, large, "raw_index").isEmpty()


def test_contexts(frame):
    from ohmflow.functions.scalar import context_tag

    out = sampling.context(frame, 100, context_tag("meter_excluded:b"), "raw_index")
    assert out.count() == 100 and out.filter("meter = 'b'").isEmpty() and out.filter("anomaly = 1").count() == 50
    heavy = sampling.context(frame, 100, context_tag("meter_heavy:a:0.8"), "raw_index")
    assert heavy.filter("meter = 'a'").count() == 80


def test_quotas_respect_capacity(spark):
    table = spark.createDataFrame([("a", 3), ("b", 50), ("c", 47)], "k string, w long")
    got = {r.k: r.quota for r in sampling.quotas(table, 10, "w", "k").collect()}
    assert sum(got.values()) == 10 and got["a"] <= 3
    with pytest.raises(ValueError):
        sampling.quotas(table, 1000, "w", "k")
    apart = table.withColumn("even", sampling.F.lit(1.0))
    assert {r.k: r.quota for r in sampling.quotas(apart, 90, "even", "k", "w").collect()} == {"a": 3, "b": 44, "c": 43}


def test_shares_equal_one_at_a_time():
    import random

    r = random.Random(8)
    for _ in range(300):
        room = [r.randint(0, 40) for _ in range(r.randint(1, 6))]
        weights, total = [r.randint(0, 9) + 0.5 for _ in room], r.randint(0, sum(room))
        wanted = [total * w / sum(weights) for w in weights]
        got = [min(int(x), c) for x, c in zip(wanted, room, strict=True)]
        while sum(got) < total:
            best = max((i for i in range(len(room)) if got[i] < room[i]), key=lambda i: (wanted[i] - got[i], -i))
            got[best] += 1
        assert sampling.shares(weights, total, room) == got


def test_contexts_have_the_asked_size(spark):
    from ohmflow.functions.scalar import context_tag

    rows = [(i, i % 4, i % 8, "O" if i % 10 < 1 else "F" if i % 10 < 5 else "G", i % 2) for i in range(400)]
    frame = spark.createDataFrame(rows, "raw_index long, site_id int, building_id int, meter string, anomaly int")
    for tag in ("meter_balanced", "meter_heavy:O:0.7", "site_balanced", "pooled_reference", "meter_excluded:G"):
        out = sampling.context(frame, 100, context_tag(tag), "raw_index")
        assert out.count() == 100 and out.filter("anomaly = 1").count() == 50
    with pytest.raises(ValueError):
        sampling.context(frame, 100, context_tag("meter_excluded:zz"), "raw_index").sparkSession and sampling.context(frame, 1000, context_tag("pooled_reference"), "raw_index")


def test_large_samples_are_cut_by_priority(spark, monkeypatch):
    frame = spark.range(30000).withColumnRenamed("id", "raw_index")
    whole = [r.raw_index for r in sampling.sample(frame, 4000, "raw_index", 5).collect()]
    monkeypatch.setattr(sampling, "LIMIT_ROWS", 100)
    assert sorted(r.raw_index for r in sampling.sample(frame, 4000, "raw_index", 5).collect()) == sorted(whole)
    assert sampling.sample(frame, 40000, "raw_index").count() == 30000


def test_split_gates(frame):
    sided = splits.building_split(frame, "50_50_mod2")
    splits.assert_disjoint(sided)
    with pytest.raises(ValueError):
        splits.assert_disjoint(frame.withColumn("side", splits.F.when(splits.F.col("raw_index") < 480, "train").otherwise("val")), "meter")


def test_folds_cover_every_site_once(frame):
    folds = splits.all_sites_out(frame)
    assert folds.filter("side = 'val'").count() == frame.count()
    assert splits.coverage_gap(folds.filter("side = 'val'"), frame, "raw_index").isEmpty()


def test_labels_are_attached_by_row_id(spark):
    readings = spark.createDataFrame([(0, 1, 0, "2016-01-01 00:00:00", 1.0), (1, 1, 0, "2016-01-01 01:00:00", 2.0)], "row_id long, building_id int, meter int, timestamp string, meter_reading double")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "row_id long, is_bad_meter_reading int")
    assert {r.row_id: r.anomaly for r in ingest.attach_labels(readings, labels).collect()} == {0: 1, 1: 0}
    with pytest.raises(ValueError):
        ingest.attach_labels(readings, labels.filter("row_id = 0"))
    with pytest.raises(ValueError):
        ingest.attach_labels(readings, labels.withColumnRenamed("is_bad_meter_reading", "bad"))
    with pytest.raises(ValueError):
        ingest.attach_labels(readings.unionByName(readings.withColumn("row_id", readings.row_id + 2)), labels)


def test_wide_archive(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("building_id,site_id,building_id_kaggle,site_id_kaggle,primaryspaceusage,sqft,yearbuilt,numberoffloors,timezone\nA,s1,7,1,Office,100,1990,2,US/Eastern\nB,s1,,,Lodging,200,,,US/Eastern\n")
    (tmp_path / "electricity_cleaned.csv").write_text("timestamp,A,B\n2016-01-01 00:00:00,1,2\n2016-01-01 01:00:00,3,\n")
    (tmp_path / "weather.csv").write_text("timestamp,site_id,airTemperature\n2016-01-01 00:00:00,s1,5\n")
    got = ingest.load_archive(spark, str(tmp_path), ["electricity"])
    assert got.count() == 4 and got.filter("is_overlap").select("building_id").distinct().count() == 1
    assert got.filter("air_temperature is not null").count() == 2
    (tmp_path / "electricity_cleaned.csv").write_text("timestamp,A,Z\n2016-01-01 00:00:00,1,2\n")
    with pytest.raises(ValueError):
        ingest.load_archive(spark, str(tmp_path), ["electricity"])


def test_shards_and_resume(spark, frame, tmp_path):
    parts = [frame.filter("raw_index < 500"), frame.filter("raw_index >= 500")]
    assert ingest.union_shards(parts, frame).count() == 960
    with pytest.raises(ValueError):
        ingest.union_shards(parts[:1], frame)
    units = spark.createDataFrame([("a", "x"), ("b", "y")], "unit_id string, digest string")
    assert [r.unit_id for r in sinks.pending(units, units.filter("unit_id = 'a'")).collect()] == ["b"]
    with pytest.raises(ValueError):
        sinks.pending(units, spark.createDataFrame([("a", "z")], "unit_id string, digest string"))
    sinks.write_parquet(frame, str(tmp_path / "p"), ["meter"])
    read = ingest.read_meter_rows(spark, str(tmp_path / "p"), ["raw_index", "meter"], ["a"])
    assert read.count() == 240
    sinks.write_json(frame.limit(3), str(tmp_path / "j"), "abc")
    assert "revision" in spark.read.json(str(tmp_path / "j")).columns
    assert sinks.spans(frame, "raw_index", 100).groupBy("span").count().filter("count > 100").isEmpty()


def test_scoring_loads_raw_meters(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("building_id,site_id,building_id_kaggle,site_id_kaggle,primaryspaceusage,sqft,yearbuilt,numberoffloors,timezone\nA,s1,7,1,Office,100,1990,2,US/Eastern\n")
    (tmp_path / "electricity.csv").write_text("timestamp,A\n2016-01-01 00:00:00,1\n2016-01-01 01:00:00,3\n")
    (tmp_path / "weather.csv").write_text("timestamp,site_id,airTemperature\n2016-01-01 00:00:00,s1,5\n")
    assert ingest.load_scoring(spark, str(tmp_path), ["electricity"]).count() == 2


def test_submission_has_id_and_score(spark, tmp_path):
    sinks.submission(spark.createDataFrame([(1, 0.5, "x"), (2, 0.25, "y")], "row_id long, score double, other string"), str(tmp_path / "s"))
    read = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert read.columns == ["row_id", "anomaly"] and {(r.row_id, r.anomaly) for r in read.collect()} == {("1", "0.5"), ("2", "0.25")}


def test_label_columns(spark):
    from ohmflow.operators import profile

    assert profile.label_columns(spark.createDataFrame([(1, 2, 3)], "meter int, is_bad_reading int, Anomaly int")) == ["is_bad_reading", "Anomaly"]


def test_matched_positives_are_as_many_as_asked(frame):
    labelled = frame.withColumn("anomaly", (frame.raw_index % 4 == 0).cast("int"))
    found = sampling.matched_positives(labelled, "raw_index", 50)
    assert found.filter("anomaly = 1").select("raw_index").distinct().count() == 50


def test_frame_from_four_files(spark, tmp_path):
    (tmp_path / "train.csv").write_text("row_id,building_id,meter,timestamp,meter_reading\n0,1,0,2016-01-01 00:00:00,5\n1,1,0,2016-01-01 01:00:00,6\n")
    (tmp_path / "bad_meter_readings.csv").write_text("row_id,is_bad_meter_reading\n0,0\n1,1\n")
    (tmp_path / "building_metadata.csv").write_text("building_id,site_id,primary_use,square_feet,year_built,floor_count\n1,3,,100,1990,2\n")
    (tmp_path / "weather_train.csv").write_text("site_id,timestamp,air_temperature,cloud_coverage\n3,2016-01-01 00:00:00,4.5,255\n")
    got = {r.row_id: r for r in ingest.read_tables(spark, str(tmp_path)).collect()}
    assert got[1].anomaly == 1 and got[0].cloud_coverage == 10 and got[1].air_temperature is None and got[0].site_id == 3
