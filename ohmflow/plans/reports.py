"""Queries of reports by stratum, of gates on rows that break them, and of the wide archive's loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.operators import reports, resample, segments, splits
from ohmflow.plans.registry import query
from ohmflow.plans.trees import EDGES, FEATURES
from ohmflow.sources import ingest, sinks
from ohmflow.sources import testdata as td

P, R, LAB = td.PREDICTIONS, td.READINGS, td.LABELLED


def preds(spark, sf):
    return td.predictions(spark, sf)


SIDED = f"""{P}, x AS (SELECT *, CASE WHEN site_id % 2 = 0 THEN 'b' ELSE 'a' END AS side, CASE WHEN site_id % 2 = 0 THEN reading * 1.2 ELSE reading END AS shifted FROM p),
l AS (SELECT meter, side, 'score_a' AS field, score_a AS v FROM x UNION ALL SELECT meter, side, 'shifted', shifted FROM x), c AS (SELECT meter, field, v, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM l GROUP BY ALL),
k AS (SELECT meter, field, max(ta) AS n_a, max(tb) AS n_b, max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY meter, field) AS ta, sum(b) OVER (PARTITION BY meter, field) AS tb FROM c WINDOW w AS (PARTITION BY meter, field ORDER BY v)) GROUP BY ALL),
e AS (SELECT meter, field, list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM l WHERE side = 'a' GROUP BY ALL), z AS (SELECT meter, field, len(list_filter(e, lambda y: y <= v)) AS bin, sum(a) AS a, sum(b) AS b FROM c JOIN e USING (meter, field) GROUP BY ALL),
s AS (SELECT meter, field, sum((q - p) * ln(q / p)) AS psi FROM (SELECT meter, field, greatest(a / sum(a) OVER w, 1e-6) AS p, greatest(b / sum(b) OVER w, 1e-6) AS q FROM z WINDOW w AS (PARTITION BY meter, field)) GROUP BY ALL),
m AS (SELECT meter, field, quantile_cont(v, 0.5) FILTER (side = 'a') AS ma, quantile_cont(v, 0.5) FILTER (side = 'b') AS mb FROM l GROUP BY ALL),
evidence AS (SELECT meter, field, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(ks, 6) AS ks, round(psi, 6) AS psi, round(ma, 6) AS median_a, round(mb, 6) AS median_b, round(mb - ma, 6) AS contrast, round(ks, 6) >= 0.1 OR round(psi, 6) >= 0.2 AS drifted FROM k JOIN s USING (meter, field) JOIN m USING (meter, field))"""


def sided(spark, sf):
    half = F.col("site_id") % 2 == 0
    return preds(spark, sf).withColumn("side", F.when(half, "b").otherwise("a")).withColumn("shifted", F.when(half, F.col("reading") * 1.2).otherwise(F.col("reading")))


@query(f"WITH {SIDED} SELECT * FROM evidence")
def drift_evidence(spark, sf):
    """Scores, and readings moved by a fifth in the overlap, by meter."""
    return reports.drift_evidence(sided(spark, sf), ["meter"], "side", ["score_a", "shifted"])


@query(f"""WITH {SIDED}, r AS (SELECT meter, count(*) AS rows, round(count(score_a) / count(*), 6) AS coverage FROM x GROUP BY 1), g AS (SELECT meter, count(*) FILTER (drifted) AS drifted_fields FROM evidence GROUP BY 1)
SELECT meter, rows, coverage, drifted_fields, CASE WHEN rows = 0 THEN 'empty' WHEN coverage < 1 THEN 'incomplete' WHEN drifted_fields > 0 THEN 'drifted' ELSE 'pass' END AS verdict FROM r JOIN g USING (meter)""")
def pilot_verdicts(spark, sf):
    rows = sided(spark, sf)
    report = rows.groupBy("meter").agg(F.count("*").alias("rows"), F.round(F.count("score_a") / F.count("*"), 6).alias("coverage"))
    return reports.pilot_verdicts(report, reports.drift_evidence(rows, ["meter"], "side", ["score_a", "shifted"]), ["meter"])


@query(f"""WITH {P}, c AS (SELECT raw_index, raw_index + CASE WHEN raw_index % 97 = 0 THEN 3000000000000 ELSE 0 END AS place FROM p WHERE raw_index % 50 <> 7), o AS (SELECT raw_index, row_number() OVER (ORDER BY place) AS own FROM c), w AS (SELECT raw_index, row_number() OVER (ORDER BY raw_index) AS wanted FROM p WHERE raw_index % 50 <> 9)
SELECT count(*) FILTER (o.raw_index IS NULL) AS missing, count(*) FILTER (w.raw_index IS NULL) AS foreign, count(*) FILTER (own <> wanted) AS disordered, 0 AS repeated FROM w FULL JOIN o USING (raw_index)""")
def shard_order(spark, sf):
    """A shard that lacks rows, has others, and has some out of place."""
    key = F.col("raw_index")
    shard = preds(spark, sf).filter(key % 50 != 7).select("raw_index", (key + F.when(key % 97 == 0, F.lit(3000000000000)).otherwise(F.lit(0))).alias("place"))
    return reports.order_gap(shard, preds(spark, sf).filter(key % 50 != 9), "raw_index", "place")


@query(f"""WITH {P}, k AS (SELECT raw_index, row_number() OVER (ORDER BY raw_index) - 1 AS i FROM p), s AS (SELECT i // 5000 AS span, min(i) AS first, max(i) AS last, count(*) AS rows FROM k GROUP BY 1), t AS (SELECT span, first, CASE WHEN span % 4 = 2 THEN last - 3 ELSE last END AS last, rows FROM s)
SELECT span, first, last, rows, first <> coalesce(lag(last) OVER (ORDER BY first) + 1, 0) OR last - first + 1 <> rows AS broken FROM t""")
def broken_spans(spark, sf):
    """Checkpoint spans of which some end too early."""
    at = sinks.ranked(preds(spark, sf).select("raw_index"), "raw_index").withColumn("span", F.floor(F.col("rank") / 5000))
    spans = at.groupBy("span").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("rows"))
    return reports.span_gap(spans.withColumn("last", F.when(F.col("span") % 4 == 2, F.col("last") - 3).otherwise(F.col("last"))))


@query(f"""WITH {P}, x AS (SELECT CASE WHEN reading > 45 THEN NULL ELSE reading END AS reading, CASE WHEN score_a = 0.3 THEN CAST('nan' AS DOUBLE) WHEN score_a = 0.4 THEN CAST('-inf' AS DOUBLE) ELSE score_a END AS score_a FROM p),
l AS (SELECT 'reading' AS field, reading AS v FROM x UNION ALL SELECT 'score_a', score_a FROM x)
SELECT field, count(*) AS rows, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (isnan(v)) AS nans, count(*) FILTER (isinf(v)) AS infinite, round(count(*) FILTER (v IS NULL OR isnan(v)) / count(*), 6) AS nan_fraction FROM l GROUP BY field""")
def finite_fields(spark, sf):
    odd = F.when(F.col("score_a") == 0.3, float("nan")).when(F.col("score_a") == 0.4, float("-inf")).otherwise(F.col("score_a"))
    return reports.finite_report(preds(spark, sf).withColumn("reading", F.when(~(F.col("reading") > 45), F.col("reading"))).withColumn("score_a", odd), ["reading", "score_a"])


@query(f"""WITH {P}, u AS (SELECT meter, building_id, count(*) AS n_rows, avg(CASE WHEN reading > 45 THEN 1.0 ELSE 0.0 END) AS reading, avg(CASE WHEN score_b > 0.5 THEN 1.0 ELSE 0.0 END) AS score_b FROM p GROUP BY 1, 2),
l AS (SELECT meter, 'n_rows' AS field, CAST(n_rows AS DOUBLE) AS v FROM u UNION ALL SELECT meter, 'reading', reading FROM u UNION ALL SELECT meter, 'score_b', score_b FROM u)
SELECT meter, field, count(*) AS units, round(min(v), 6) AS low, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS high FROM l GROUP BY 1, 2""")
def unit_summaries(spark, sf):
    rows = preds(spark, sf).withColumn("reading", F.when(~(F.col("reading") > 45), F.col("reading"))).withColumn("score_b", F.when(~(F.col("score_b") > 0.5), F.col("score_b")))
    return reports.unit_summary(rows, ["building_id"], ["meter"], ["reading", "score_b"])


@query("""WITH b AS (SELECT c_mktsegment AS primary_use, CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal < 0 AS flag FROM customer), l AS (SELECT NULL AS flag, 'primary_use' AS field, primary_use AS value FROM b UNION ALL SELECT NULL, 'nation', nation FROM b UNION ALL SELECT flag, 'primary_use', primary_use FROM b UNION ALL SELECT flag, 'nation', nation FROM b),
c AS (SELECT flag, field, value, count(*) AS n FROM l GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY flag, field), 6) AS share FROM c""")
def composition_by_flag(spark, sf):
    rows = td.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("primary_use"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") < 0).alias("flag"))
    return reports.composition_by_flag(rows, ["primary_use", "nation"], "flag")


@query(f"""WITH {LAB}, l AS (SELECT 'building' AS "by", CAST(building_id AS VARCHAR) AS value, anomaly FROM a UNION ALL SELECT 'month', CAST(month(timestamp) AS VARCHAR), anomaly FROM a) SELECT "by", value, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies, round(avg(anomaly), 6) AS rate FROM l GROUP BY ALL""")
def anomalies_by_building_and_month(spark, sf):
    return reports.rates_by(td.labelled_readings(spark, sf), "anomaly", {"building": F.col("building_id"), "month": F.month("timestamp")})


@query(f"""WITH {P}, c AS (SELECT site_id, score_a AS s, sum(y) AS pos FROM p GROUP BY 1, 2), v AS (SELECT *, sum(pos) OVER (PARTITION BY site_id ORDER BY s DESC) AS tp, sum(pos) OVER (PARTITION BY site_id) AS np FROM c)
SELECT site_id, max(s) AS threshold, round(arg_max(tp / np, s), 6) AS recall FROM v WHERE np > 0 AND tp >= 0.8 * np GROUP BY site_id""")
def first_recall_thresholds(spark, sf):
    return reports.recall_threshold_from(preds(spark, sf), ["site_id"], 0.8, "score_a")


FACTORIAL = f"""{P}, c AS (SELECT meter, site_id % 2 AS a, building_id // 7 % 2 AS b, avg(score_a) AS v FROM p GROUP BY ALL), w AS (SELECT meter, max(v) FILTER (a = 0 AND b = 0) AS v00, max(v) FILTER (a = 0 AND b = 1) AS v01, max(v) FILTER (a = 1 AND b = 0) AS v10, max(v) FILTER (a = 1 AND b = 1) AS v11 FROM c GROUP BY 1),
f AS (SELECT meter, round((v10 + v11 - v00 - v01) / 2, 6) AS main_a, round((v01 + v11 - v00 - v10) / 2, 6) AS main_b, round(v11 - v10 - v01 + v00, 6) AS interaction FROM w)"""


@query(f"""WITH {FACTORIAL} SELECT *, CASE WHEN greatest(abs(main_a), abs(main_b), abs(interaction)) = 0 THEN 'none' WHEN abs(main_a) >= greatest(abs(main_b), abs(interaction)) THEN 'main_a' WHEN abs(main_b) >= abs(interaction) THEN 'main_b' ELSE 'interaction' END AS dominant FROM f""")
def dominant_effects(spark, sf):
    cells = preds(spark, sf).groupBy("meter", (F.col("site_id") % 2).alias("a"), (F.floor(F.col("building_id") / 7) % 2).alias("b")).agg(F.avg("score_a").alias("v"))
    return reports.dominance(resample.factorial(cells, ["meter"], "a", "b", "v"), ["meter"])


@query(f"""WITH {P}, a AS (SELECT site_id, round(avg(score_a), 6) AS v FROM p GROUP BY 1), b AS (SELECT site_id, round(avg(score_b), 6) AS v FROM p GROUP BY 1), r AS (SELECT site_id, rank() OVER (ORDER BY a.v DESC) AS rank_before, rank() OVER (ORDER BY b.v DESC) AS rank_after, b.v - a.v AS d FROM a JOIN b USING (site_id))
SELECT site_id, CAST(rank_before AS INTEGER) AS rank_before, CAST(rank_after AS INTEGER) AS rank_after, round(d, 6) AS delta, CASE WHEN abs(d) <= 0.0005 THEN 'same' WHEN rank_before = rank_after THEN 'moved' ELSE 'reordered' END AS verdict FROM r""")
def ranking_changes(spark, sf):
    mean = lambda c: preds(spark, sf).groupBy("site_id").agg(F.round(F.avg(c), 6).alias("v"))
    return reports.ranking_change(mean("score_a"), mean("score_b"), "site_id", "v")


@query(f"""WITH {LAB}, o AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM a WHERE anomaly = 1 WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY building_id, meter ORDER BY timestamp) AS BIGINT) AS island FROM o), m AS (SELECT building_id, meter, quantile_cont(meter_reading, 0.5) AS m FROM a GROUP BY 1, 2)
SELECT building_id, meter, island, count(*) AS n, round(avg(meter_reading - m), 6) AS mean_deviation, round(max(abs(meter_reading - m)), 6) AS max_deviation FROM s JOIN m USING (building_id, meter) GROUP BY 1, 2, 3""")
def segment_deviations(spark, sf):
    rows = td.labelled_readings(spark, sf)
    segs = segments.segments(rows)
    held = segments.attach(rows.filter("anomaly = 1").select("building_id", "meter", "timestamp", "meter_reading"), segs)
    # the median is of the whole series, the deviations are of its anomalous rows
    whole = held.unionByName(rows.filter("anomaly = 0").select("building_id", "meter", "timestamp", "meter_reading"), allowMissingColumns=True)
    return reports.segment_deviations(whole, segs, ["building_id", "meter"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3")
def nesting_gap_of_a_cut_context(spark, sf):
    """A larger context that lacks every seventh row of the smaller."""
    rows = td.table(spark, sf, "customer").select("c_custkey")
    return splits.nesting_gap(rows, rows.filter("c_custkey % 7 <> 3"), "c_custkey")


@query(f"""WITH {R}, u AS (SELECT building_id AS unit, timestamp, CASE WHEN (day(timestamp) <= 12) = (building_id % 3 <> 0) THEN 'train' ELSE 'test' END AS w FROM r)
SELECT unit, max(timestamp) FILTER (w = 'train') AS last_train, min(timestamp) FILTER (w = 'test') AS first_test FROM u GROUP BY unit HAVING max(timestamp) FILTER (w = 'train') >= min(timestamp) FILTER (w = 'test')""")
def future_leaks_of_turned_units(spark, sf):
    """Units of which every third was cut the wrong way round."""
    early = F.dayofmonth("timestamp") <= 12
    rows = td.readings(spark, sf).withColumn("window", F.when(early == (F.col("building_id") % 3 != 0), "train").otherwise("test"))
    return splits.future_leaks(rows.withColumnRenamed("building_id", "unit"), "unit")


@query()
def random_search_tuning(spark, sf):
    """Symmetric trees with default settings and with those that a random search finds on validation sites."""
    rows = preds(spark, sf).select("y", "site_id", *FEATURES)
    part = lambda m: rows.filter(F.col("site_id") % 4 == m)
    return reports.default_and_searched(rows.filter("site_id % 4 in (0, 2)"), part(1), part(3), FEATURES, EDGES, reports.sampled_trials(3, 5))


ARCHIVE = f"""{R}, w AS (SELECT building_id, site_id, timestamp, meter_reading FROM r WHERE meter = 'view')"""


def archive(spark, sf, variant: str):
    """A wide archive of one meter, written as its files: a column for each building, metadata, weather."""
    rows = td.readings(spark, sf).filter("meter = 'view'").select(F.concat(F.lit("b"), F.col("building_id").cast("string")).alias("building_id"), "site_id", "timestamp", "meter_reading")
    root, names = sinks.scratch_folder(spark, "archive"), sorted(r["building_id"] for r in rows.select("building_id").distinct().collect())
    meta = rows.select("building_id", F.concat(F.lit("s"), F.col("site_id").cast("string")).alias("site_id")).distinct()
    none = F.lit(None).cast("string")
    meta = meta.select("building_id", "site_id", F.when(F.col("site_id") == "s1", F.lit("7")).alias("building_id_kaggle"), none.alias("site_id_kaggle"), F.lit("Office").alias("primaryspaceusage"), F.lit(100).alias("sqft"), none.alias("yearbuilt"), none.alias("numberoffloors"), F.lit("US/Eastern").alias("timezone"))
    weather = rows.groupBy("timestamp", F.concat(F.lit("s"), F.col("site_id").cast("string")).alias("site_id")).agg(F.min("meter_reading").alias("airTemperature"))
    sinks.write_wide(rows, f"{root}/view{variant}.csv", "timestamp", "building_id", "meter_reading", names)
    for name, table in (("metadata", meta), ("weather", weather.filter("airTemperature > 5"))):
        sinks.write_csv(table, f"{root}/{name}.csv")
    return root


@query(f"""WITH {ARCHIVE}, t AS (SELECT DISTINCT timestamp FROM w), b AS (SELECT DISTINCT building_id, site_id FROM w), h AS (SELECT site_id, timestamp, min(meter_reading) AS air FROM w GROUP BY 1, 2 HAVING min(meter_reading) > 5)
SELECT 'b' || b.building_id AS building_id, 's' || b.site_id AS site_id, b.site_id = 1 AS is_overlap, t.timestamp, w.meter_reading, h.air AS air_temperature FROM t CROSS JOIN b LEFT JOIN w ON w.building_id = b.building_id AND w.timestamp = t.timestamp LEFT JOIN h ON h.site_id = b.site_id AND h.timestamp = t.timestamp""")
def archive_frame(spark, sf):
    """Metadata, cleaned meter files and weather of a wide archive as one long frame."""
    return ingest.load_archive(spark, archive(spark, sf, "_cleaned"), ["view"]).select("building_id", "site_id", "is_overlap", "timestamp", "meter_reading", "air_temperature")


@query(f"""WITH {ARCHIVE}, t AS (SELECT DISTINCT timestamp FROM w), b AS (SELECT DISTINCT building_id FROM w) SELECT 'b' || b.building_id AS building_id, count(*) AS rows, count(w.meter_reading) AS readings FROM t CROSS JOIN b LEFT JOIN w ON w.building_id = b.building_id AND w.timestamp = t.timestamp GROUP BY 1""")
def scoring_frame(spark, sf):
    """The raw variant that is scored."""
    return ingest.load_scoring(spark, archive(spark, sf, ""), ["view"]).groupBy("building_id").agg(F.count("*").alias("rows"), F.count("meter_reading").alias("readings"))
