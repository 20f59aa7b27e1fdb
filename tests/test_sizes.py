"""Queries on tables beyond the small ones' sizes: SQL of the same rule, and steps that no class or group makes one task's work."""

import hashlib

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from ohmflow.operators import experiments, loads, resample, sampling, strata, trees
from ohmflow.sources import ingest, sinks


def connect(folder):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def lines(folder, n: int):
    """n lineitem rows with ids of their own."""
    duckdb.execute(f"""COPY (SELECT i AS l_orderkey, CAST(1 + i % 7 AS INTEGER) AS l_linenumber, i % 20000 AS l_partkey, i % 1000 AS l_suppkey, CAST(1 + i % 50 AS DOUBLE) AS l_quantity, (i % 11) / 100.0::DOUBLE AS l_discount,
(i % 9) / 100.0::DOUBLE AS l_tax, CASE WHEN hash(i) % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, CASE WHEN hash(i) % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus FROM range({n}) r(i)) TO '{folder}/lineitem.parquet'""")
    return folder


@pytest.mark.parametrize("n", [0, 1500, 256_000, 256_001])
def test_id_tree_root_has_as_many_levels_as_it_needs(spark, tmp_path, n):
    folder, name = lines(tmp_path, n), "id_tree_root"
    assert compare.differences(spark, connect(folder), driver.queries()[name], driver.oracle_sql()[name], str(folder)) == []


def test_streamed_segments_with_several_events_an_hour(spark, tmp_path):
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (hash(i) % 720 * 3600 + i % 3600) SECOND AS ts, CAST(hash(i + 7) % 400 AS BIGINT) AS user_id, ['view', 'error', 'signup'][1 + i % 3] AS event_type,
(hash(i + 9) % 100)::DOUBLE AS value, '{{}}' AS props FROM range(150000) r(i)) TO '{tmp_path}/events.parquet'""")
    name = "streamed_segments"
    assert compare.differences(spark, connect(tmp_path), driver.queries()[name], driver.oracle_sql()[name], str(tmp_path)) == []


def labelled(spark, n: int = 20_000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 100 / 7.0).alias("v"))


@pytest.fixture
def dealt_as_planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def places(rows, group: str) -> int:
    """The fewest tasks that hold a group's rows."""
    return min(r["n"] for r in rows.withColumn("_at", F.spark_partition_id()).groupBy(group).agg(F.count_distinct("_at").alias("n")).collect())


def test_quotas_are_no_group_in_one_task(spark, dealt_as_planned):
    rows = labelled(spark)
    table = spark.createDataFrame([(0, 9000), (1, 6667)], "y int, quota long")
    found = sampling.by_quota(rows, table, "y", "k", 5)
    order = sampling.ranked(rows, ["y"], "k", 5).join(table, "y").filter("rank < quota")
    assert sorted(r["k"] for r in found.collect()) == sorted(r["k"] for r in order.collect())
    assert places(found, "y") > 1
    for n in (0, 1, 7):
        few = sampling.by_quota(rows, spark.createDataFrame([(0, n)], "y int, quota long"), "y", "k", 5)
        assert sorted(r["k"] for r in few.collect()) == sorted(r["k"] for r in sampling.ranked(rows, ["y"], "k", 5).filter(f"y = 0 and rank < {n}").collect())


def test_quota_takes_a_null_key_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, 0), (1, 0), (1, 0), (2, 0), (3, None)], "k long, y int")
    table = spark.createDataFrame([(0, 2)], "y int, quota long")
    assert [r["k"] for r in sampling.by_quota(rows, table, "y", "k").collect()].count(None) == 1
    assert sampling.by_quota(rows, spark.createDataFrame([(0, 9)], "y int, quota long"), "y", "k").count() == 4


def test_natural_contexts_nest_without_a_class_in_one_task(spark, dealt_as_planned):
    found = sampling.natural_contexts(labelled(spark), "k", [3000, 15000], "y", 3)
    sets = {b: {r["k"] for r in found.filter(F.col("budget") == b).collect()} for b in (3000, 15000)}
    assert {b: len(s) for b, s in sets.items()} == {3000: 3000, 15000: 15000} and sets[3000] <= sets[15000]
    assert places(found, "y") > 1


def test_replacements_rank_no_class_in_one_task(spark, monkeypatch):
    rows = labelled(spark)
    slots, reserve = rows.filter("k % 5 = 0"), rows.filter("k % 5 > 0")
    a, b = (sampling.ranked(r, ["y"], "k", 0, "i").select("y", "i", F.col("k").alias(n)) for r, n in ((slots, "slot"), (reserve, "replacement")))
    wanted = sorted(tuple(r) for r in a.join(b, ["y", "i"]).select("slot", "replacement", "y").collect())
    monkeypatch.setattr(sampling, "ranked", None)
    assert sorted(tuple(r) for r in sampling.replacements(slots, reserve, "k", "y").collect()) == wanted


def test_permuted_ranks_rows_once_for_all_repeats(spark, monkeypatch):
    seen, plain = [], resample.prefix_sums
    monkeypatch.setattr(resample, "prefix_sums", lambda rows, *a, **k: (seen.append(rows.count()), plain(rows, *a, **k))[1])
    rows = labelled(spark, 500)
    found = resample.permuted(rows, "v", "k", 3, ["y"], 4).select("repeat", "y", "k", "v").toPandas()
    assert seen == [500]
    for (repeat, y), part in found.groupby(["repeat", "y"]):
        of = [r for r in rows.collect() if r["y"] == y]
        by_hash = sorted(of, key=lambda r: hashlib.md5(f"4:{repeat}:{r['k']}".encode()).hexdigest())
        assert dict(zip(part["k"], part["v"], strict=True)) == {r["k"]: h["v"] for r, h in zip(of, by_hash, strict=True)}


def test_importance_deals_once_for_all_features(spark, monkeypatch):
    calls, plain = [], resample.permuted
    monkeypatch.setattr(resample, "permuted", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    rows = labelled(spark, 400).withColumn("w", F.col("v") + F.col("y"))
    groups = {"v": ["v"], "w": ["w"], "both": ["v", "w"]}
    found = {r["feature"]: r for r in experiments.permutation_importance(rows, groups, lambda: F.round(F.col("v") * 0.1 + F.col("w"), 6), "k", 2, ["y"]).collect()}
    assert len(calls) == 1 and set(found) == set(groups) and all(r["repeats"] == 2 for r in found.values())


def test_wide_archives_are_planned_without_a_column_for_each_building(spark, tmp_path):
    names = [f"b{i}" for i in range(300)]
    rows = spark.range(3 * 300).select((F.col("id") % 3).alias("hour"), F.concat(F.lit("b"), F.floor(F.col("id") / 3).cast("string")).alias("building_id"), F.when(F.col("id") % 7 > 0, F.col("id") / 4).alias("v"))
    rows = rows.select(F.timestamp_add("HOUR", "hour", F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"), "building_id", "v")
    path = str(tmp_path / "view.csv")
    sinks.write_wide(rows, path, "timestamp", "building_id", "v", names)
    plain = lambda long: sorted((r["building_id"], r["timestamp"], r["meter"], r["meter_reading"] or "") for r in long.collect())
    long = ingest.read_wide(spark, path, "view")
    assert plain(long) == plain(ingest.melt(spark.read.option("header", True).csv(path), "view")) and long.count() == 900
    assert len(long._jdf.queryExecution().optimizedPlan().toString()) < 2000
    assert plain(ingest.read_wide(spark, path, "view", columns=["b7"])) == [r for r in plain(long) if r[0] == "b7"]
    with pytest.raises(ValueError, match="building that metadata lacks"):
        ingest.read_wide(spark, path, "view", spark.createDataFrame([("b1",)], "building_id string"))


def jobs_and_tasks(spark, tag: str, run):
    """What run gives, and the jobs and tasks that it took."""
    spark.sparkContext.setJobGroup(tag, tag)
    found, tracker = run(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("", "")
    jobs = tracker.getJobIdsForGroup(tag)
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    return found, len(jobs), sum(s.numCompletedTasks for s in stages if s)


def test_load_vectors_fill_gaps_in_place(spark):
    # hours 0 and 1 of the year, then 400 and 403: gaps in the midst, at the week's start and at its end
    rows = spark.range(8).select((F.col("id") % 2).alias("building_id"), F.timestamp_add("HOUR", F.element_at(F.array(*map(F.lit, (0, 1, 400, 403))), (F.floor(F.col("id") / 2) + 1).cast("int")), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"), (F.col("id") * F.col("id") + 1.0).alias("meter_reading"))
    for period, at in ((168, [0, 1, 64, 67]), (None, [0, 1, 400, 403])):
        for r in loads.load_vectors(rows, period=period).collect():
            assert [i for i, z in enumerate(r["hours"]) if z] == at and len(r["hours"]) == (period or 404) and r["n_hours"] == 4


def test_load_groups_pass_over_as_many_parts_as_the_vectors_need(spark):
    rows = spark.range(60).select(F.col("id").alias("building_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.col("id") % 3 == i % 3).cast("double") + F.col("id") / 1000)).alias("hours"))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        (found, quality), _, tasks = jobs_and_tasks(spark, "load-groups", lambda: loads.load_groups(rows.repartition(60), k=3, starts=2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found.count() == 60 and quality["stability"] == 1.0 and tasks < 500
    assert found.join(rows, "building_id").groupBy("cluster").agg(F.count_distinct(F.col("building_id") % 3).alias("n")).filter("n <> 1").isEmpty()


def planned(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_rows_are_scored_without_being_sent_by_a_coarse_key(spark, dealt_as_planned):
    rows = labelled(spark, 2000).select("y", (F.col("k") % 7).alias("building"), (F.col("k") % 2).alias("meter"), "v")
    levels, edges = [["building", "meter"], ["meter"]], {"v": [2.0, 5.0, 9.0]}
    found = trees.fit_units(rows.filter("building < 5"), levels, ["v"], edges)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = trees.score_units(rows, found, levels, ["v"], edges)
        assert "SortMergeJoin" not in planned(scored) and "Exchange hashpartitioning" not in planned(scored)
        assert {r["routed"]: r["count"] for r in scored.groupBy("routed").count().collect()} == {0: rows.filter("building < 5").count(), 1: rows.filter("building >= 5").count()}
        trees.BROADCAST_UNITS = 3
        again = trees.score_units(rows, found, levels, ["v"], edges)
        assert "SortMergeJoin" not in planned(again) and again.exceptAll(scored).isEmpty()
    finally:
        trees.BROADCAST_UNITS = 10_000
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_factorial_cells_send_no_rows_by_group(spark, dealt_as_planned):
    rows = labelled(spark, 700).select("y", F.col("v").alias("score"), (F.col("k") % 2).alias("meter"), (F.col("k") % 9).alias("building_id"), (F.col("k") % 7).alias("segment"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = strata.factorial_cells(rows, ["meter"])
        joins = [line for line in planned(found).splitlines() if "SortMergeJoin" in line]
        assert len(joins) == 1  # of the groups' sums and quantiles
        assert [r["buildings"] for r in found.collect()] == [9, 9]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fits_read_rows_that_are_made_once(spark, monkeypatch):
    calls, plain = [], sinks.stored
    monkeypatch.setattr(experiments, "stored", lambda rows, tag: (calls.append(rows.columns), plain(rows, tag))[1])
    rows = labelled(spark, 300)
    assert experiments.cell(rows, rows, ["v"]).first()["n_pos"] == 100 and calls == [["v", "y"]]
