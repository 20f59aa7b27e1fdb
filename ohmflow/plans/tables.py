"""Queries of profiles, drift, splits, gates and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.functions.scalar import priority
from ohmflow.operators import profile, sampling, splits
from ohmflow.plans.registry import query
from ohmflow.sources import ingest, sinks
from ohmflow.sources import testdata as td

R, LAB, P = td.READINGS, td.LABELLED, td.PREDICTIONS
METERS = ["click", "error", "purchase", "signup", "view"]


def labelled(spark, sf):
    return td.labelled_readings(spark, sf)


def preds(spark, sf):
    return td.predictions(spark, sf).withColumnRenamed("y", "anomaly")


PA = P + ", a AS (SELECT raw_index, y AS anomaly, score_a, score_b, meter, building_id, site_id, reading FROM p)"

# --- profiles --------------------------------------------------------------------------------------------------------


@query(f"WITH {LAB} SELECT building_id, min(site_id) AS site_id, count(DISTINCT site_id) AS n_sites, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies, round(sum(anomaly) / count(*), 6) AS anomaly_rate, " + ", ".join(f"count(*) FILTER (meter = '{m}') AS {m}_rows, CAST(coalesce(sum(anomaly) FILTER (meter = '{m}'), 0) AS BIGINT) AS {m}_anomalies, round(count(*) FILTER (meter = '{m}') / count(*), 6) AS {m}_share, round(coalesce(sum(anomaly) FILTER (meter = '{m}'), 0) / nullif(count(*) FILTER (meter = '{m}'), 0), 6) AS {m}_rate" for m in METERS) + " FROM a GROUP BY building_id")
def building_profiles(spark, sf):
    return profile.building_profiles(labelled(spark, sf), METERS)


@query(f"WITH {LAB} SELECT site_id, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies, round(sum(anomaly) / count(*), 6) AS rate, count(DISTINCT building_id) AS buildings, count(DISTINCT (building_id, meter)) AS series, array_to_string(list_sort(list(DISTINCT meter)), ',') AS meters FROM a GROUP BY site_id")
def site_support(spark, sf):
    return profile.grouped_support(labelled(spark, sf), ["site_id"])


@query(f"""WITH {LAB} SELECT CASE grouping_id(anomaly, meter, site_id) WHEN 3 THEN 'anomaly' WHEN 5 THEN 'meter' WHEN 1 THEN 'anomaly+meter' WHEN 6 THEN 'site_id' ELSE 'site_id+anomaly' END AS "grouping",
coalesce(CAST(anomaly AS VARCHAR), '') AS anomaly, coalesce(meter, '') AS meter, coalesce(CAST(site_id AS VARCHAR), '') AS site_id, count(*) AS rows FROM a GROUP BY GROUPING SETS ((anomaly), (meter), (anomaly, meter), (site_id), (site_id, anomaly))""")
def context_counts(spark, sf):
    return profile.grouping_counts(labelled(spark, sf), [["anomaly"], ["meter"], ["anomaly", "meter"], ["site_id"], ["site_id", "anomaly"]])


@query(f"""WITH {LAB}, g AS (SELECT site_id, building_id, sum(anomaly) AS n, count(*) AS rows FROM a GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY site_id) AS total, coalesce(sum(n) OVER (PARTITION BY site_id ORDER BY n DESC, building_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT site_id, CAST(max(total) AS BIGINT) AS anomalies, count(*) AS buildings, round(max(n) / nullif(max(total), 0), 6) AS top_share, count(*) FILTER (total > 0 AND before * 10 < total * 9) AS buildings_for_90, count(*) FILTER (n <= rows * 0.001) AS near_clean FROM k GROUP BY site_id""")
def site_concentration(spark, sf):
    return profile.site_concentration(labelled(spark, sf))


@query(f"""WITH {R}, g AS (SELECT building_id, meter, count(DISTINCT timestamp) AS present FROM r WHERE meter_reading IS NOT NULL GROUP BY 1, 2)
SELECT *, round(1 - present / 720.0, 6) AS missing_rate, CASE WHEN 1 - present / 720.0 > 0.5 THEN 'high_missing' ELSE 'sufficient' END AS completeness FROM g""")
def series_completeness(spark, sf):
    return profile.completeness(td.readings(spark, sf), 720)


@query(f"""WITH {R}, g AS (SELECT building_id, meter, round(1 - count(DISTINCT timestamp) / 720.0, 6) AS m FROM r GROUP BY 1, 2), l AS (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6]::DOUBLE[]) AS "limit")
SELECT "limit", count(*) AS series, count(*) FILTER (m <= "limit") AS sufficient FROM g, l GROUP BY 1""")
def sufficiency(spark, sf):
    return profile.sufficiency(profile.completeness(td.readings(spark, sf), 720), [0.4, 0.45, 0.5, 0.55, 0.6])


GAP = f"{R}, g AS (SELECT building_id, meter, count(DISTINCT timestamp) AS observed, date_diff('hour', min(timestamp), max(timestamp)) + 1 AS expected FROM r GROUP BY 1, 2)"


@query(f"WITH {GAP} SELECT *, expected - observed AS missing FROM g")
def series_gaps(spark, sf):
    return profile.gaps(td.readings(spark, sf))


@query(f"WITH {GAP} SELECT *, expected - observed AS missing FROM g ORDER BY missing DESC, building_id, meter LIMIT 10")
def most_gapped(spark, sf):
    return profile.top_groups(profile.gaps(td.readings(spark, sf)), [F.desc("missing"), "building_id", "meter"], 10)


@query(f"""WITH {R} SELECT meter, count(meter_reading) AS n, min(meter_reading) AS low, round(quantile_cont(meter_reading, 0.25), 6) AS q25, round(quantile_cont(meter_reading, 0.5), 6) AS median, round(quantile_cont(meter_reading, 0.75), 6) AS q75,
round(quantile_cont(meter_reading, 0.75) - quantile_cont(meter_reading, 0.25), 6) AS iqr, round(quantile_cont(meter_reading, 0.95), 6) AS p95, round(quantile_cont(meter_reading, 0.99), 6) AS p99, max(meter_reading) AS high, round((count(*) - count(meter_reading)) / count(*), 6) AS missing_rate FROM r GROUP BY meter""")
def reading_summary(spark, sf):
    return profile.numeric_summary(td.readings(spark, sf), ["meter"], "meter_reading")


@query(f"WITH {P} SELECT site_id, count(*) AS n, round(count(score_a) / count(*), 6) AS finite_rate, " + ", ".join(f"round(quantile_cont(score_a, {q}), 6) AS q{round(q * 100):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM p GROUP BY site_id")
def score_quantiles(spark, sf):
    return profile.nine_quantiles(td.predictions(spark, sf), ["site_id"], "score_a")


@query("""SELECT 'c_mktsegment' AS field, round(count(c_mktsegment) / count(*), 6) AS present_rate, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS typical FROM customer""")
def category_field(spark, sf):
    return profile.field_summary(td.table(spark, sf, "customer"), "c_mktsegment", False)


@query(f"WITH {R} SELECT meter, count(*) AS rows, round(count(*) FILTER (meter_reading IS NULL) / count(*), 6) AS null_share, round(count(*) FILTER (meter_reading = 0) / count(*), 6) AS zero_share, round(count(*) FILTER (meter_reading < 0) / count(*), 6) AS negative_share, count(DISTINCT building_id) FILTER (meter_reading IS NOT NULL) AS coverage FROM r GROUP BY meter")
def meter_quality(spark, sf):
    return profile.quality_summary(td.readings(spark, sf), ["meter"])


@query(f"""WITH {R}, c AS (SELECT building_id, meter, timestamp, CASE WHEN meter_reading > 400 THEN NULL ELSE round(meter_reading) END AS v FROM r WHERE building_id <> 3)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NULL) AS removed, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS filled, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a IS NOT DISTINCT FROM b) AS same
FROM (SELECT r.meter_reading AS a, c.v AS b FROM r FULL JOIN c USING (building_id, meter, timestamp))""")
def raw_against_cleaned(spark, sf):
    rows = td.readings(spark, sf)
    cleaned = rows.filter("building_id <> 3").withColumn("meter_reading", F.when(~(F.col("meter_reading") > 400), F.round("meter_reading")))
    return profile.cell_diff(rows, cleaned, ["building_id", "meter", "timestamp"], "meter_reading")


@query(f"WITH {R}, l AS (SELECT *, lag(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY timestamp) AS b FROM r) SELECT meter, count(*) AS pairs, round(count(*) FILTER (meter_reading = b) / count(*), 6) AS flat_share FROM l WHERE b IS NOT NULL AND meter_reading IS NOT NULL GROUP BY meter")
def flatline_share(spark, sf):
    return profile.flatline(td.readings(spark, sf), ["meter"])


@query(f"WITH {R}, f AS (SELECT meter, timestamp, avg(meter_reading) AS m FROM r GROUP BY 1, 2) SELECT meter, CAST(hour(timestamp) AS INTEGER) AS hour, round(avg(m), 6) AS mean FROM f GROUP BY ALL")
def hourly_profile(spark, sf):
    return profile.hourly_profile(td.readings(spark, sf), ["meter"])


@query(f"""WITH {LAB}, l AS (SELECT 'meter' AS field, meter AS value FROM a UNION ALL SELECT 'site_id', CAST(site_id AS VARCHAR) FROM a UNION ALL SELECT 'anomaly', CAST(anomaly AS VARCHAR) FROM a), c AS (SELECT field, value, count(*) AS n FROM l GROUP BY 1, 2)
SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM c""")
def composition(spark, sf):
    return profile.composition(labelled(spark, sf), ["meter", "site_id", "anomaly"])


@query(f"""WITH {R}, s AS (SELECT meter, epoch(timestamp) - lag(epoch(timestamp)) OVER (PARTITION BY meter, building_id ORDER BY timestamp) AS step FROM r), c AS (SELECT meter, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY n DESC, step) AS i FROM c)
SELECT meter, CAST(step AS BIGINT) AS step_seconds, n FROM k WHERE i = 1""")
def common_time_step(spark, sf):
    # the step within a building's series, the most frequent one of each meter
    steps = profile.step_counts(td.readings(spark, sf), ["meter", "building_id"]).groupBy("meter", "step_seconds").agg(F.sum("n").alias("n"))
    return profile.most_frequent_step(steps, ["meter"])


@query("""SELECT lang, 'quality' AS field, round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang UNION ALL
SELECT lang, 'toxic', round(avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def missing_by_group(spark, sf):
    rows = td.table(spark, sf, "documents").select("doc_id", "lang").join(td.table(spark, sf, "labels"), "doc_id", "left")
    return profile.missing_rates(rows, ["quality", "toxic"], ["lang"])


@query("""SELECT count(*) AS n, count(*) FILTER (p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 100 = 1)) AS unseen, round(count(*) FILTER (p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 100 = 1)) / count(*), 6) AS rate FROM part""")
def unseen_categories(spark, sf):
    part = td.table(spark, sf, "part")
    return profile.unseen_rate(part, part.filter("p_partkey % 100 = 1"), "p_brand")


@query(f"WITH {R} SELECT count(*) AS rows, count(DISTINCT building_id) AS n_building_id, count(DISTINCT site_id) AS n_site_id, count(DISTINCT meter) AS n_meter, min(timestamp) AS first_time, max(timestamp) AS last_time FROM r")
def frame_summary(spark, sf):
    return profile.frame_summary(td.readings(spark, sf))


@query(f"WITH {LAB} SELECT 6 AS n_columns, count(*) AS rows, count(DISTINCT building_id) AS buildings, CAST(sum(anomaly) AS BIGINT) AS positives, count(DISTINCT (building_id, meter)) AS series, array_to_string(list_sort(list(DISTINCT meter)), ',') AS meters FROM a")
def table_census(spark, sf):
    return ingest.census(labelled(spark, sf))


@query(f"WITH {LAB}, g AS (SELECT meter, site_id, avg(anomaly) AS v FROM a GROUP BY 1, 2) SELECT meter, count(v) AS n, round(CASE WHEN count(v) = 4 THEN avg(v) END, 6) AS macro FROM g GROUP BY meter")
def macro_rates(spark, sf):
    cells = labelled(spark, sf).groupBy("meter", "site_id").agg(F.avg("anomaly").alias("v"))
    return profile.macro(cells, ["meter"], "v", 4)


@query(f"""WITH {LAB}, g AS (SELECT meter, building_id, avg(anomaly) AS v FROM a GROUP BY 1, 2) SELECT meter, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS q25,
round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS high FROM g GROUP BY meter""")
def rate_distribution(spark, sf):
    cells = labelled(spark, sf).groupBy("meter", "building_id").agg(F.avg("anomaly").alias("v"))
    return profile.metric_distribution(cells, ["meter"], "v")


SIDES = "x AS (SELECT o_orderstatus AS g, o_totalprice AS v, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' ELSE 'b' END AS s, o_orderpriority AS c FROM orders)"


def _sides(spark, sf):
    side = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "a").otherwise("b")
    return td.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("v"), side.alias("s"), F.col("o_orderpriority").alias("c"))


KS = """c AS (SELECT g, v, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'b') AS b FROM x GROUP BY 1, 2), k AS (SELECT g, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY g) - sum(b) OVER w / sum(b) OVER (PARTITION BY g)) AS d FROM c WINDOW w AS (PARTITION BY g ORDER BY v))"""


@query(f"WITH {SIDES}, {KS} SELECT g, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, round(max(d), 6) AS ks FROM k GROUP BY g")
def ks_distance(spark, sf):
    return profile.ks_distance(_sides(spark, sf), "s", "v", ["g"])


@query(f"WITH {SIDES.replace('x AS', 'y AS')}, x AS (SELECT 'raw' AS g, v, s FROM y UNION ALL SELECT 'log1p', ln(1 + greatest(v, 0)), s FROM y UNION ALL SELECT 'log1p_nonzero', ln(1 + v), s FROM y WHERE v > 0), {KS} SELECT g AS variant, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, round(max(d), 6) AS ks FROM k GROUP BY g")
def drift_variants(spark, sf):
    return profile.ks_distance(profile.drift_variants(_sides(spark, sf), "s", "v"), "s", "v", ["variant"])


@query(f"""WITH {SIDES}, e AS (SELECT list_sort(list_distinct([{", ".join(f"quantile_cont(v, {i / 10})" for i in range(1, 10))}])) AS e FROM x WHERE s = 'a'),
c AS (SELECT len(list_filter(e, lambda t: t <= v)) AS bin, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'b') AS b FROM x, e GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c),
p AS (SELECT greatest(a / ta, 1e-6) AS p, greatest(b / tb, 1e-6) AS q FROM c, t) SELECT count(*) AS bins, round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
def psi_numeric(spark, sf):
    return profile.psi(_sides(spark, sf), "s", "v")


@query("""WITH c AS (SELECT o_orderpriority AS c, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 <> 0) AS b FROM orders GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c), p AS (SELECT greatest(a / ta, 1e-6) AS p, greatest(b / tb, 1e-6) AS q FROM c, t)
SELECT count(*) AS categories, round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
def psi_categories(spark, sf):
    rows = td.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("c"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("s"))
    return profile.psi_categories(rows, "s", "c")


@query("""SELECT n_regionkey, n_nationkey AS nation, n_name AS name FROM nation""")
def nested_records(spark, sf):
    """Result cells as JSON arrays, one per region, flattened into rows."""
    record = F.struct(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    cells = td.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(record)).alias("cell"))
    return profile.flatten_records(cells, "cell", "nation long, name string")


# --- splits and gates ------------------------------------------------------------------------------------------------


@query(f"""WITH {LAB}, s AS (SELECT a.*, CASE WHEN site_id % 2 = 1 THEN 'val' ELSE 'train' END AS side FROM a) SELECT side, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies, round(avg(anomaly), 6) AS rate, count(DISTINCT site_id) AS sites, count(DISTINCT building_id) AS buildings FROM s GROUP BY side""")
def split_manifest(spark, sf):
    return splits.split_manifest(labelled(spark, sf).withColumn("side", splits.location_side("A1")))


_SIDES = ["A0", "A1", "A2", "A3", "A4", "oracle", "calibration", "mod5", "time", "three_way"]


@query(f"""WITH {LAB} SELECT building_id, site_id, meter, timestamp, CASE WHEN building_id % 2 = 1 THEN 'val' ELSE 'train' END AS "A0", CASE WHEN site_id % 2 = 1 THEN 'val' ELSE 'train' END AS "A1", CASE WHEN site_id % 2 = 0 THEN 'val' ELSE 'train' END AS "A2",
CASE WHEN site_id % 4 = 2 THEN 'val' ELSE 'train' END AS "A3", CASE WHEN site_id = 3 THEN 'val' ELSE 'train' END AS "A4", CASE WHEN site_id <> 1 THEN 'out' WHEN building_id % 2 = 1 THEN 'val' ELSE 'train' END AS oracle, CASE WHEN building_id % 5 = 4 THEN 'calibration' ELSE 'fit' END AS calibration,
CASE WHEN site_id % 5 = 4 THEN 'val' ELSE 'train' END AS mod5, CASE WHEN month(timestamp) >= 9 THEN 'val' ELSE 'train' END AS time, CASE WHEN building_id % 2 = 1 THEN 'test' WHEN building_id % 4 = 0 THEN 'fit' ELSE 'val' END AS three_way,
CASE WHEN timestamp < TIMESTAMP '2024-01-11' THEN 'train' WHEN timestamp < TIMESTAMP '2024-01-21' THEN 'calib' ELSE 'test' END AS "window", CASE WHEN site_id IN (1, 2) THEN 'val' ELSE 'train' END AS sites_out, building_id || '|' || meter AS unit FROM a""")
def split_sides(spark, sf):
    s = splits
    sides = {"A0": s.location_side("A0"), "A1": s.location_side("A1"), "A2": s.location_side("A2"), "A3": s.location_side("A3", fold=2), "A4": s.location_side("A4", site=3), "oracle": s.in_site_oracle(1), "calibration": s.source_calibration(), "mod5": s.site_mod(5), "time": s.time_side(), "three_way": s.three_way(), "window": s.windows(("2024-01-11", "2024-01-21")), "sites_out": s.leave_sites_out([1, 2]), "unit": s.unit_key(["building_id", "meter"])}
    return labelled(spark, sf).select("building_id", "site_id", "meter", "timestamp", *[c.alias(n) for n, c in sides.items()])


@query(f"""WITH {LAB}, b AS (SELECT building_id, row_number() OVER (ORDER BY md5('3:' || building_id), building_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT building_id FROM a))
SELECT building_id, CASE WHEN i <= n // 2 THEN 'train' ELSE 'val' END AS side FROM b""")
def random_half(spark, sf):
    return splits.building_split(labelled(spark, sf).select("building_id").distinct(), "50_50_random", 3)


@query(f"WITH {LAB} SELECT f.fold, CASE WHEN site_id = fold THEN 'val' ELSE 'train' END AS side, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies FROM a, (SELECT DISTINCT site_id AS fold FROM a) f GROUP BY 1, 2")
def every_site_out(spark, sf):
    return splits.all_sites_out(labelled(spark, sf)).groupBy("fold", "side").agg(F.count("*").alias("rows"), F.sum("anomaly").alias("anomalies"))


UNITS = f"{LAB}, u AS (SELECT a.*, building_id || '|' || meter AS unit, CASE WHEN timestamp < TIMESTAMP '2024-01-11' THEN 'train' WHEN timestamp < TIMESTAMP '2024-01-21' THEN 'calib' ELSE 'test' END AS w FROM a)"


def _units(spark, sf):
    return labelled(spark, sf).withColumn("unit", splits.unit_key(["building_id", "meter"])).withColumn("window", splits.windows(("2024-01-11", "2024-01-21")))


@query(f"WITH {UNITS} SELECT unit, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS positives FROM u WHERE w = 'train' GROUP BY unit HAVING sum(anomaly) BETWEEN 1 AND count(*) - 1 ORDER BY md5('5:' || unit), unit LIMIT 12")
def scorable_units(spark, sf):
    return splits.select_units(splits.scorable_units(_units(spark, sf), "unit"), "unit", 12, 5)


@query(f"WITH {UNITS} SELECT unit, count(*) FILTER (w = 'train') AS train, count(*) FILTER (w = 'calib') AS calib, count(*) FILTER (w = 'test') AS test FROM u GROUP BY unit")
def unit_rows(spark, sf):
    return splits.unit_rows(_units(spark, sf), "unit")


@query(f"""WITH {PA}, v AS (SELECT raw_index FROM a WHERE building_id % 2 = 0 ORDER BY md5('1:' || raw_index), raw_index LIMIT 500) SELECT a.raw_index, CASE WHEN building_id % 2 = 1 THEN 'holdout' WHEN v.raw_index IS NOT NULL THEN 'validation' ELSE 'fit' END AS role FROM a LEFT JOIN v ON v.raw_index = a.raw_index""")
def protocol_roles(spark, sf):
    return splits.protocol(preds(spark, sf), 1, 500).select("raw_index", "role")


@query(f"WITH {LAB}, s AS (SELECT 'all' AS scenario, a.* FROM a UNION ALL SELECT 'without_view', a.* FROM a WHERE meter <> 'view' UNION ALL SELECT 'without_click', a.* FROM a WHERE meter <> 'click' UNION ALL SELECT 'only_view', a.* FROM a WHERE meter = 'view' UNION ALL SELECT 'only_click', a.* FROM a WHERE meter = 'click') SELECT scenario, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies FROM s GROUP BY scenario")
def meter_compositions(spark, sf):
    return splits.compositions(labelled(spark, sf), ["view", "click"]).groupBy("scenario").agg(F.count("*").alias("rows"), F.sum("anomaly").alias("anomalies"))


@query("SELECT building_id FROM (SELECT user_id // 10 AS building_id FROM events WHERE user_id % 3 = 0 INTERSECT SELECT user_id // 10 FROM events WHERE user_id % 3 <> 0)")
def split_overlap(spark, sf):
    rows = td.table(spark, sf, "events").select(F.floor(F.col("user_id") / 10).alias("building_id"), F.when(F.col("user_id") % 3 == 0, "train").otherwise("val").alias("side"))
    return splits.overlap(rows, "building_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return ingest.duplicate_keys(td.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT coalesce(a.o_custkey, b.c_custkey) AS k, coalesce(a.n, 0) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey FROM customer) b ON a.o_custkey = b.c_custkey WHERE n IS NULL OR n <> 1 OR c_custkey IS NULL")
def fold_coverage(spark, sf):
    folds = td.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return splits.coverage_gap(folds, td.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def nesting_gap(spark, sf):
    return splits.nesting_gap(td.table(spark, sf, "customer").select("c_custkey"), td.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


@query(f"WITH {UNITS} SELECT unit, max(timestamp) FILTER (w = 'train') AS last_train, min(timestamp) FILTER (w = 'test') AS first_test FROM u GROUP BY unit HAVING max(timestamp) FILTER (w = 'train') >= min(timestamp) FILTER (w = 'test')")
def future_leaks(spark, sf):
    return splits.future_leaks(_units(spark, sf), "unit")


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0), y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 1)
SELECT count(*) FILTER (y.o_orderkey IS NULL) AS only_a, count(*) FILTER (x.o_orderkey IS NULL) AS only_b, count(*) FILTER (x.o_orderkey IS NOT NULL AND y.o_orderkey IS NOT NULL AND x.o_orderstatus IS DISTINCT FROM y.o_orderstatus) AS differing FROM x FULL JOIN y ON x.o_orderkey = y.o_orderkey""")
def identity_gap(spark, sf):
    o = td.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    b = o.filter("o_orderkey % 10 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return splits.identity_gap(o.filter("o_orderkey % 10 <> 0"), b, ["o_orderkey"], ["o_orderstatus"])


@query("""SELECT n_regionkey, 'a' AS side FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT n_regionkey FROM nation WHERE n_nationkey > 4) UNION ALL SELECT n_regionkey, 'b' FROM (SELECT n_regionkey FROM nation WHERE n_nationkey > 4 EXCEPT ALL SELECT n_regionkey FROM nation)""")
def parity_gap(spark, sf):
    n = td.table(spark, sf, "nation")
    return splits.parity_gap(n.select("n_regionkey"), n.filter("n_nationkey > 4").select("n_regionkey"))


@query(f"""WITH {PA} SELECT DISTINCT h.raw_index FROM a h JOIN a f ON f.building_id % 2 = 0 AND h.building_id % 2 = 1 AND h.reading IS NOT DISTINCT FROM f.reading AND h.score_a IS NOT DISTINCT FROM f.score_a AND h.score_b IS NOT DISTINCT FROM f.score_b AND h.meter = f.meter""")
def content_leaks(spark, sf):
    rows = preds(spark, sf)
    return splits.content_leaks(rows.filter("building_id % 2 = 0"), rows.filter("building_id % 2 = 1"), ["reading", "score_a", "score_b", "meter"], "raw_index").distinct()


@query(f"""WITH {P}, h AS (SELECT CAST('0x' || substr(md5(CAST(raw_index AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM p) SELECT count(*) AS rows, CAST(sum(h) AS VARCHAR) AS sum_hash, bit_xor(h) AS xor_hash FROM h""")
def id_fingerprint(spark, sf):
    return splits.fingerprint(td.predictions(spark, sf), "raw_index")


@query("SELECT s_nationkey, count(*) AS n, sha256(array_to_string(list_sort(list(s_suppkey)), ',')) AS sha256 FROM supplier GROUP BY 1")
def ordered_digests(spark, sf):
    return splits.ordered_digest(td.table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey")


@query(f"""WITH {LAB}, m AS (SELECT meter, round(avg(anomaly), 6) AS value FROM a GROUP BY 1), g AS (SELECT meter, round(avg(anomaly), 6) AS golden FROM a WHERE building_id < 9 GROUP BY 1) SELECT m.meter, value, golden, coalesce(abs(value - golden) <= 0.0005, false) AS passed FROM m LEFT JOIN g USING (meter)""")
def golden_gate(spark, sf):
    rate = lambda rows: rows.groupBy("meter").agg(F.round(F.avg("anomaly"), 6).alias("value"))
    rows = labelled(spark, sf)
    return splits.golden_gap(rate(rows), rate(rows.filter("building_id < 9")), ["meter"], "value")


@query(f"""WITH {R}, g AS (SELECT site_id, count(*) AS rows, count(DISTINCT building_id) AS buildings, round(count(meter_reading) / count(*), 6) AS coverage FROM r GROUP BY 1) SELECT *, buildings >= 5 AND rows >= 17544 AS powered, CASE WHEN rows = 0 THEN 'empty' WHEN coverage < 1 THEN 'incomplete' WHEN NOT (buildings >= 5 AND rows >= 17544) THEN 'underpowered' ELSE 'pass' END AS verdict FROM g""")
def transfer_verdicts(spark, sf):
    report = td.readings(spark, sf).groupBy("site_id").agg(F.count("*").alias("rows"), F.count_distinct("building_id").alias("buildings"), F.round(F.count("meter_reading") / F.count("*"), 6).alias("coverage"))
    return splits.transfer_verdict(report)


@query(f"WITH {PA}, k AS (SELECT raw_index, row_number() OVER (ORDER BY raw_index) - 1 AS i FROM a WHERE site_id NOT IN (1, 2)) SELECT i // 1000 AS span, count(*) AS rows, min(raw_index) AS first, max(raw_index) AS last FROM k GROUP BY 1")
def remaining_batches(spark, sf):
    rows = preds(spark, sf)
    return sinks.remaining_batches(rows, spark.createDataFrame([(1,), (2,)], "site_id long"), 1000)


# --- samples ---------------------------------------------------------------------------------------------------------


@query(f"WITH {PA} SELECT raw_index, anomaly FROM a ORDER BY md5('4:' || raw_index), raw_index LIMIT 200")
def fixed_sample(spark, sf):
    return sampling.sample(preds(spark, sf), 200, "raw_index", 4).select("raw_index", "anomaly")


@query(f"WITH {PA}, n AS (SELECT count(*) AS n FROM a WHERE anomaly = 1), x AS (SELECT raw_index, row_number() OVER (ORDER BY md5('10:' || raw_index), raw_index) AS i, row_number() OVER (ORDER BY md5('11:' || raw_index), raw_index) AS j FROM a WHERE anomaly = 0) SELECT raw_index, 0 AS copy_id FROM x, n WHERE i <= n UNION ALL SELECT raw_index, 1 FROM x, n WHERE j <= n UNION ALL SELECT raw_index, unnest([0, 1]) FROM a WHERE anomaly = 1")
def class_balance(spark, sf):
    return sampling.downsample(preds(spark, sf), "raw_index").select("raw_index", "copy_id")


@query(f"WITH {PA}, x AS (SELECT raw_index, anomaly, row_number() OVER (PARTITION BY anomaly ORDER BY md5('0:' || raw_index), raw_index) AS i FROM a) SELECT raw_index, anomaly FROM x WHERE i <= 150")
def balanced_sample(spark, sf):
    return sampling.balanced(preds(spark, sf), "raw_index", max_rows=300).select("raw_index", "anomaly")


@query(f"""WITH {PA}, x AS (SELECT raw_index, anomaly, (row_number() OVER (PARTITION BY anomaly ORDER BY md5('0:' || raw_index), raw_index) - 1) * 2 + (1 - anomaly) AS place FROM a), b AS (SELECT unnest([10, 50, 200]) AS budget) SELECT budget, raw_index, anomaly, place FROM x JOIN b ON place < budget""")
def nested_contexts(spark, sf):
    return sampling.nested_balanced(preds(spark, sf), "raw_index", [10, 50, 200]).select("budget", "raw_index", "anomaly", "place")


@query(f"WITH {PA}, x AS (SELECT *, row_number() OVER (PARTITION BY site_id, meter, anomaly ORDER BY md5('2:' || raw_index), raw_index) AS i FROM a) SELECT raw_index, site_id, meter, anomaly FROM x WHERE i <= 5")
def sentinel_rows(spark, sf):
    return sampling.per_group(preds(spark, sf), ["site_id", "meter", "anomaly"], 5, "raw_index", 2).select("raw_index", "site_id", "meter", "anomaly")


@query(f"""WITH {PA}, g AS (SELECT meter, count(*) AS w FROM a GROUP BY 1), s AS (SELECT meter, w, 1000 * w / sum(w) OVER () AS q FROM g), k AS (SELECT *, row_number() OVER (ORDER BY q - floor(q) DESC, meter) AS i, 1000 - sum(floor(q)) OVER () AS spare FROM s)
SELECT meter, w, CAST(floor(q) + CASE WHEN i <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k""")
def apportionment(spark, sf):
    counts = preds(spark, sf).groupBy("meter").agg(F.count("*").alias("w"))
    return sampling.quotas(counts, 1000, "w", "meter")


@query(f"""WITH {PA}, g AS (SELECT anomaly, count(*) AS w FROM a GROUP BY 1), s AS (SELECT anomaly, w, 400 * w / sum(w) OVER () AS q FROM g), k AS (SELECT *, row_number() OVER (ORDER BY q - floor(q) DESC, CAST(anomaly AS VARCHAR)) AS i, 400 - sum(floor(q)) OVER () AS spare FROM s),
n AS (SELECT anomaly, floor(q) + CASE WHEN i <= spare THEN 1 ELSE 0 END AS quota FROM k), x AS (SELECT raw_index, anomaly, row_number() OVER (PARTITION BY anomaly ORDER BY md5('6:' || raw_index), raw_index) AS i FROM a) SELECT raw_index, x.anomaly FROM x JOIN n ON n.anomaly = x.anomaly WHERE i <= quota""")
def stratified_sample(spark, sf):
    return sampling.stratified(preds(spark, sf), "anomaly", 400, "raw_index", 6).select("raw_index", "anomaly")


@query(f"""WITH {PA}, s AS (SELECT *, building_id || '|' || (raw_index % 7) AS segment FROM a), x AS (SELECT *, row_number() OVER (PARTITION BY building_id, segment ORDER BY md5('8:' || raw_index), raw_index) AS i FROM s), y AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY md5('8:' || raw_index), raw_index) AS j FROM x WHERE i <= 2)
SELECT raw_index, building_id, segment FROM y WHERE j <= 5 ORDER BY md5('8:' || raw_index), raw_index LIMIT 100""")
def dual_cap_sample(spark, sf):
    rows = preds(spark, sf).withColumn("segment", F.concat_ws("|", "building_id", F.col("raw_index") % 7))
    return sampling.dual_cap(rows, 100, 5, 2, "raw_index", 8).select("raw_index", "building_id", "segment")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS site_id FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY md5('0:' || s_suppkey), s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY site_id) AS n FROM s)
SELECT s_suppkey, site_id, row_number() OVER (ORDER BY round(k / n, 12), site_id) - 1 AS position FROM k""")
def nested_site_order(spark, sf):
    series = td.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("site_id"))
    return sampling.nested_meter_order(series, "s_suppkey").withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {PA}, o AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY raw_index) AS i FROM a), h AS (SELECT building_id, anomaly AS shuffled, row_number() OVER (PARTITION BY building_id ORDER BY md5('9:' || raw_index), raw_index) AS i FROM a) SELECT raw_index, anomaly, shuffled FROM o JOIN h USING (building_id, i)""")
def shuffled_labels(spark, sf):
    return sampling.shuffle_labels(preds(spark, sf), ["building_id"], "raw_index", seed=9).select("raw_index", "anomaly", "shuffled")


@query(f"""WITH {PA}, s AS (SELECT raw_index, anomaly, row_number() OVER (PARTITION BY anomaly ORDER BY md5('0:' || raw_index), raw_index) AS k FROM a WHERE meter = 'O' AND site_id = 1), r AS (SELECT raw_index, anomaly, row_number() OVER (PARTITION BY anomaly ORDER BY md5('0:' || raw_index), raw_index) AS k FROM a WHERE meter = 'F')
SELECT s.raw_index AS slot, r.raw_index AS replacement, anomaly FROM s JOIN r USING (anomaly, k)""")
def slot_replacements(spark, sf):
    rows = preds(spark, sf)
    return sampling.replacements(rows.filter("meter = 'O' and site_id = 1"), rows.filter("meter = 'F'"), "raw_index")


@query(f"""WITH {PA}, d AS (SELECT * FROM a WHERE substr(md5('0:' || raw_index), 1, 1) = '0'), f AS (SELECT unnest(['q25', 'q50', 'q75']) AS field, unnest([0.25, 0.5, 0.75]) AS q),
par AS (SELECT anomaly, quantile_cont(reading, [0.25, 0.5, 0.75]) AS v FROM a GROUP BY 1), e AS (SELECT anomaly, quantile_cont(reading, [0.25, 0.5, 0.75]) AS v FROM d GROUP BY 1), i AS (SELECT unnest([1, 2, 3]) AS i, unnest(['q25', 'q50', 'q75']) AS field)
SELECT anomaly, field, round(par.v[i], 6) AS parent, round(e.v[i], 6) AS draw, round((e.v[i] - par.v[i]) / nullif(abs(par.v[i]), 0), 6) AS deviation FROM par JOIN e USING (anomaly), i""")
def draw_against_parent(spark, sf):
    rows = preds(spark, sf)
    return sampling.representativeness(rows.filter(F.substring(priority(0, F.col("raw_index")), 1, 1) == "0"), rows, "reading")


@query("""WITH s AS (SELECT l_linenumber AS seed, l_suppkey AS item FROM lineitem GROUP BY 1, 2), n AS (SELECT seed, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.seed AS a, y.seed AS b, count(*) AS c FROM s x JOIN s y USING (item) WHERE x.seed < y.seed GROUP BY 1, 2)
SELECT a.seed AS seed_a, b.seed AS seed_b, coalesce(c, 0) AS intersection_count, a.n + b.n - coalesce(c, 0) AS union_count, round(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)), 6) AS jaccard_similarity FROM n a JOIN n b ON a.seed < b.seed LEFT JOIN c ON c.a = a.seed AND c.b = b.seed""")
def selection_overlap(spark, sf):
    rows = td.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("seed"), F.col("l_suppkey").alias("item"))
    return sampling.jaccard(rows, "seed", "item")


@query(f"""WITH {LAB}, b AS (SELECT building_id, min(site_id) AS site_id FROM a GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY md5('0:' || building_id), building_id) - 1 AS k FROM b), o AS (SELECT *, row_number() OVER (ORDER BY k, md5('0:' || site_id), site_id) - 1 AS position FROM k)
SELECT budget, position, building_id, site_id, CASE WHEN position % 5 = 4 THEN 'early_stop' ELSE 'fit' END AS role FROM o, (SELECT unnest([2, 5, 8]) AS budget) WHERE position < budget""")
def building_ladder(spark, sf):
    """Nested building sets of an order that interleaves sites."""
    return sampling.ladder(profile.building_profiles(labelled(spark, sf), METERS), [2, 5, 8], METERS)


@query(f"WITH {PA} SELECT count(*) AS rows, count(DISTINCT building_id) AS unique_rows, round(1 - count(DISTINCT building_id) / count(*), 6) AS duplicate_rate FROM a")
def duplicate_use(spark, sf):
    return profile.duplicate_use(preds(spark, sf), "building_id")


# --- row identity ----------------------------------------------------------------------------------------------------


@query(f"WITH {PA}, w AS (SELECT raw_index FROM a WHERE building_id % 7 = 0) SELECT raw_index, meter, anomaly FROM a WHERE raw_index IN (SELECT raw_index FROM w)")
def restricted_arm(spark, sf):
    rows = preds(spark, sf)
    return splits.restrict(rows, rows.filter("building_id % 7 = 0"), "raw_index").select("raw_index", "meter", "anomaly")


@query("SELECT o_orderkey AS raw_index, c_custkey IS NOT NULL AS found, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def raw_field_lookup(spark, sf):
    wanted = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("raw_index"))
    raw = td.table(spark, sf, "customer").withColumnRenamed("c_custkey", "raw_index")
    return splits.lookup(wanted, raw, "raw_index", ["c_mktsegment"])


@query(f"""WITH {R}, s AS (SELECT *, building_id || '|' || meter || '|' || timestamp AS k, max(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS s1 FROM r)
SELECT building_id, meter, timestamp, round(meter_reading - s1, 6) AS lag_value_diff_1, round((meter_reading + 1) / nullif(s1 + 1, 0), 6) AS lag_value_ratio_1 FROM s WHERE building_id = 2 AND hour(timestamp) = 5""")
def features_of_wanted_rows(spark, sf):
    from ohmflow.operators import features

    rows = td.readings(spark, sf).withColumn("k", F.concat_ws("|", "building_id", "meter", F.col("timestamp").cast("string")))
    wanted = rows.filter((F.col("building_id") == 2) & (F.hour("timestamp") == 5))
    made = splits.whole_series(rows, wanted, "k", ["building_id", "meter"], lambda r: features.value_changes(r, [1], digits=6))
    return made.select("building_id", "meter", "timestamp", "lag_value_diff_1", "lag_value_ratio_1")
