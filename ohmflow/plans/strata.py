"""Queries of strata, gates, samples and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.functions.scalar import context_tag
from ohmflow.operators import experiments, features, gates, profile, sampling, splits, strata
from ohmflow.plans.analytics import AREAS, DRAWS, PAIRS, curve_sql
from ohmflow.plans.registry import query
from ohmflow.sources import ingest
from ohmflow.sources import testdata as td

P, LAB, R = td.PREDICTIONS, td.LABELLED, td.READINGS


def preds(spark, sf):
    return td.predictions(spark, sf).withColumn("score", F.col("score_a"))


def moved(spark, sf):
    return preds(spark, sf).withColumn("d", F.col("score_b") - F.col("score_a"))


def anomalies(spark, sf):
    return preds(spark, sf).withColumnRenamed("y", "anomaly")


# --- strata ---


@query(f"WITH {LAB}, b AS (SELECT CAST(floor(day(timestamp) / 5.0) AS BIGINT) AS bucket, day(timestamp)::DOUBLE AS v, anomaly::DOUBLE AS y FROM a) SELECT bucket, count(*) AS n, round(avg(y), 6) AS rate, (SELECT round(corr(v, y), 6) FROM b) AS corr FROM b GROUP BY bucket")
def bucketed_label_rate(spark, sf):
    return strata.bucketed_rates(td.labelled_readings(spark, sf), F.dayofmonth("timestamp"), 5.0)


@query(f"WITH {LAB}, p AS (SELECT site_id, building_id, meter, sum(anomaly) AS n FROM a GROUP BY ALL) SELECT site_id, count(*) AS pairs, count(*) FILTER (n > 0) AS anomalous_pairs, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS anomalous_rate FROM p GROUP BY site_id")
def pair_census(spark, sf):
    return strata.cell_census(td.labelled_readings(spark, sf), ["site_id"])


@query(f"WITH {LAB} SELECT building_id, meter, count(*) AS available_rows, CAST(sum(anomaly) AS BIGINT) AS available_anomalies, count(*) FILTER (hour(timestamp) < 6) AS selected_rows, CAST(coalesce(sum(anomaly) FILTER (hour(timestamp) < 6), 0) AS BIGINT) AS selected_anomalies FROM a GROUP BY ALL")
def building_audit(spark, sf):
    rows = td.labelled_readings(spark, sf)
    return strata.building_audit(rows, rows.filter(F.hour("timestamp") < 6))


@query("""WITH c AS (SELECT c_nationkey % 16 AS site_id, c_custkey AS building_id, CAST(c_acctbal < 0 AS INTEGER) AS f FROM customer), s AS (SELECT site_id, count(*) AS buildings, count(*) FILTER (f = 1) AS flagged, count(*) FILTER (f = 0) AS unflagged FROM c GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY unflagged DESC, buildings DESC, site_id) AS position FROM s""")
def site_building_ranks(spark, sf):
    rows = td.table(spark, sf, "customer").select((F.col("c_nationkey") % 16).alias("site_id"), F.col("c_custkey").alias("building_id"), (F.col("c_acctbal") < 0).cast("int").alias("f"))
    return strata.site_buildings(rows, "f")


@query(f"""WITH {P}, x AS (SELECT building_id, CASE WHEN reading > 45 THEN NULL ELSE score_a END AS s, CAST(site_id % 2 = 0 AS VARCHAR) AS overlap, meter FROM p),
l AS (SELECT 'all' AS stratum, '' AS overlap, '' AS meter, building_id, s FROM x UNION ALL SELECT 'overlap', overlap, '', building_id, s FROM x UNION ALL SELECT 'overlap+meter', overlap, meter, building_id, s FROM x)
SELECT stratum, overlap, meter, count(*) AS rows, count(DISTINCT building_id) AS buildings, round(count(s) / count(*), 6) AS coverage, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95 FROM l GROUP BY ALL""")
def stratified_scores(spark, sf):
    rows = preds(spark, sf).withColumn("score", F.when(~(F.col("reading") > 45), F.col("score_a"))).withColumn("overlap", F.col("site_id") % 2 == 0)
    return strata.stratified_report(rows, "overlap", "meter")


@query(f"WITH {P} SELECT meter, count(reading) AS n, round(avg(reading), 6) AS mean, round(stddev_pop(reading), 6) AS std, min(reading) AS low, max(reading) AS high FROM p GROUP BY meter")
def pooled_strata(spark, sf):
    """Partials per site and meter, pooled over sites."""
    return strata.pool(strata.partials(preds(spark, sf), ["site_id", "meter"], "reading"), ["meter"])


@query(f"WITH {P}, c AS (SELECT meter, CAST(greatest(0, least(9, floor((reading - 5) / 40 * 10))) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY ALL) SELECT meter, bin, n, round(n / sum(n) OVER (PARTITION BY meter), 6) AS mass FROM c")
def reading_mass(spark, sf):
    return strata.histogram_mass(preds(spark, sf), ["meter"], "reading", 5.0, 45.0, 10)


@query(f"""WITH {P}, l AS (SELECT raw_index, meter, 'score_a' AS context, score_a AS s FROM p UNION ALL SELECT raw_index, meter, 'score_b', score_b FROM p),
k AS (SELECT *, (rank() OVER (PARTITION BY meter, context ORDER BY s) + (count(*) OVER (PARTITION BY meter, context, s) - 1) / 2.0) / count(*) OVER (PARTITION BY meter, context) AS r FROM l),
g AS (SELECT raw_index, meter, stddev_pop(s) AS std, max(s) - min(s) AS range, max(r) - min(r) AS rr, CASE WHEN min(s) < 0.5 AND max(s) >= 0.5 THEN 1.0 ELSE 0.0 END AS c FROM k GROUP BY 1, 2)
SELECT meter, count(*) AS rows, round(avg(std), 6) AS mean_std, round(avg(range), 6) AS mean_range, round(avg(rr), 6) AS mean_rank_range, round(avg(c), 6) AS crossing_rate FROM g GROUP BY meter""")
def context_sensitivity(spark, sf):
    return strata.context_sensitivity(preds(spark, sf), ["score_a", "score_b"], "raw_index", ["meter"], 0.5)


@query(f"""WITH {PAIRS}, a AS (SELECT site_id, y, count(*) AS n, count(DISTINCT building_id) AS b, avg(score_a) AS m FROM p GROUP BY ALL)
SELECT pos_group, neg_group, q.n AS positives, w.n AS negatives, q.b AS pos_buildings, w.b AS neg_buildings, round(q.m - w.m, 6) AS margin, auc FROM k JOIN a q ON q.site_id = pos_group AND q.y = 1 JOIN a w ON w.site_id = neg_group AND w.y = 0 WHERE relation = 'cross'""")
def role_support(spark, sf):
    return strata.role_support(preds(spark, sf), "site_id")


@query(f"WITH {P}, d AS (SELECT meter, site_id, score_b - score_a AS d FROM p), g AS (SELECT meter, site_id, count(d) AS n, avg(d) AS mean, sum(abs(d)) AS a, max(abs(d)) AS m FROM d GROUP BY ALL) SELECT meter, site_id, n, round(mean, 6) AS mean, round(a, 6) AS abs_total, round(a / (SELECT sum(a) FROM g), 6) AS share, round(m / a, 6) AS top_share FROM g")
def movement_shares(spark, sf):
    return strata.movement_shares(moved(spark, sf), ["meter", "site_id"], "d")


@query(f"WITH {P}, d AS (SELECT meter, y, score_b - score_a AS d FROM p) SELECT meter, y, count(d) AS n, round(avg(d), 6) AS mean, round(avg(abs(d)), 6) AS mean_abs, round(min(d), 6) AS low, round(max(d), 6) AS high, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_up FROM d GROUP BY ALL")
def movement_table(spark, sf):
    return strata.movement_table(preds(spark, sf), ["meter", "y"], "score_a", "score_b")


@query(f"""WITH {R}, s AS (SELECT site_id, building_id, meter, 1 - count(DISTINCT timestamp) / 720.0 AS m FROM r WHERE meter_reading IS NOT NULL GROUP BY ALL), g AS (SELECT site_id, count(*) AS series, count(*) FILTER (round(m, 6) <= 0.85) AS sufficient FROM s GROUP BY 1)
SELECT site_id, series, sufficient, round(series / (SELECT sum(series) FROM g), 6) AS share FROM g WHERE site_id IN (0, 2)""")
def named_site_contribution(spark, sf):
    series = profile.completeness(td.readings(spark, sf), 720, keys=("site_id", "building_id", "meter"))
    return strata.site_contribution(series, [0, 2], F.col("missing_rate") <= 0.85)


RANGES = "round(avg(CASE WHEN meter_reading IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, round(quantile_cont(meter_reading, 0.5), 6) AS median, round(quantile_cont(meter_reading, 0.99), 6) AS p99, max(meter_reading) AS high"


@query(f"WITH {R} SELECT site_id, meter, count(*) AS n, {RANGES} FROM r GROUP BY ALL")
def reading_ranges(spark, sf):
    return strata.range_summary(td.readings(spark, sf), ["site_id", "meter"], "meter_reading")


@query(f"""WITH {R}, t AS (SELECT meter, count(*) AS n, {RANGES} FROM r WHERE site_id % 2 = 1 GROUP BY meter), s AS (SELECT meter, {RANGES} FROM r WHERE site_id % 2 = 0 AND meter <> 'view' GROUP BY meter),
f AS (SELECT t.*, s.median AS sm, t.median / nullif(s.median, 0) AS ratio, coalesce(t.p99 > s.p99, false) AS p99_above, coalesce(t.high > s.high, false) AS high_above FROM t LEFT JOIN s USING (meter))
SELECT meter, n, missing_rate, median, p99, high, round(ratio, 6) AS median_ratio, coalesce(ratio > 1.1 OR ratio < 1 / 1.1, false) AS far_median, p99_above, high_above,
CASE WHEN sm IS NULL THEN 'no source' WHEN ratio > 1.1 OR ratio < 1 / 1.1 THEN 'shifted' WHEN p99_above OR high_above THEN 'tail' ELSE 'within' END AS verdict FROM f""")
def out_of_range_flags(spark, sf):
    rows = td.readings(spark, sf)
    of = lambda some: strata.range_summary(some, ["meter"], "meter_reading")
    return strata.out_of_range_flags(of(rows.filter("site_id % 2 = 1")), of(rows.filter("site_id % 2 = 0 and meter <> 'view'")), "meter", 1.1)


@query(f"""WITH {P}, c AS (SELECT meter, quantile_cont(score_a, 0.95) AS cut FROM p WHERE y = 0 GROUP BY meter), q AS (SELECT meter, quantile_cont(score_a, 0.5) AS m, quantile_cont(score_a, 0.9) AS q FROM p WHERE y = 1 GROUP BY meter)
SELECT meter, count(*) FILTER (y = 1) AS positives, round(max(m), 6) AS median, round(max(q), 6) AS q90, round(max(cut), 6) AS cut, count(*) FILTER (y = 0 AND score_a >= cut) AS false_positives, count(DISTINCT building_id) AS buildings, count(DISTINCT raw_index % 7) AS segments FROM p JOIN c USING (meter) JOIN q USING (meter) GROUP BY meter""")
def factorial_cells(spark, sf):
    return strata.factorial_cells(preds(spark, sf).withColumn("segment", F.col("raw_index") % 7), ["meter"], normal=0.95)


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_totalprice END AS price, nullif(o_orderstatus, 'F') AS status FROM orders),
g AS (SELECT DISTINCT CAST(floor(k * (n - 1) / 499) AS BIGINT) AS i FROM (SELECT DISTINCT n FROM o), (SELECT unnest(range(0, 500)) AS k)), s AS (SELECT * FROM o WHERE n <= 500 OR i IN (SELECT i FROM g))
SELECT 'price' AS field, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_fraction FROM s UNION ALL SELECT 'status', round(avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM s""")
def sampled_null_fractions(spark, sf):
    rows = td.table(spark, sf, "orders").select("o_orderkey", F.when(~(F.col("o_totalprice") > 200000), F.col("o_totalprice")).alias("price"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return experiments.null_fractions(rows, ["price", "status"], "o_orderkey", 500)


RECORDS = "x AS (SELECT l_linestatus AS axis, l_returnflag AS model, l_linenumber AS seed, round(avg(l_tax), 9) AS v FROM lineitem GROUP BY ALL)"


@query(f"""WITH {RECORDS}, d AS (SELECT x.axis, x.model, x.v, CASE WHEN x.model <> 'A' THEN x.v - b.v END AS d FROM x LEFT JOIN x b ON b.model = 'A' AND b.axis = x.axis AND b.seed = x.seed)
SELECT axis, model, count(v) AS runs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(d) AS pairs, round(avg(d), 6) AS mean_delta, round(stddev_pop(d), 6) AS std_delta, round(min(d), 6) AS low_delta, round(max(d), 6) AS high_delta FROM d GROUP BY ALL""")
def resampling_deltas(spark, sf):
    records = td.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("axis"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_tax"), 9).alias("v"))
    return strata.resampling_deltas(records, "axis", "model", "seed", "v", "A")


@query(f"WITH {P} SELECT raw_index, score_a, score_b, round(score_a - score_b, 6) AS delta FROM p ORDER BY abs(round(score_a - score_b, 6)) DESC, raw_index LIMIT 20")
def top_differences(spark, sf):
    return strata.top_differences(preds(spark, sf), "score_a", "score_b", "raw_index", 20)


@query(f"""WITH {LAB}, g AS (SELECT month(timestamp) = 1 AND day(timestamp) = 1 AS new_year, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies, avg(anomaly) AS r FROM a GROUP BY 1), b AS (SELECT max(r) FILTER (new_year) AS j, max(r) FILTER (NOT new_year) AS o FROM g)
SELECT new_year, rows, anomalies, round(r, 6) AS rate, CASE WHEN j IS NULL THEN 'empty' WHEN j = 0 THEN 'clean' WHEN j < o THEN 'quiet' ELSE 'usual' END AS verdict FROM g, b""")
def new_year_report(spark, sf):
    return strata.new_year_report(td.labelled_readings(spark, sf))


ROUTED = f"""{P}, x AS (SELECT *, coalesce(CASE WHEN reading > 20 THEN score_a END, CASE WHEN reading > 5 THEN score_b END) AS s, CASE WHEN reading > 20 THEN score_a END AS own, building_id % 5 = 4 AS cal FROM p)"""


@query(f"""WITH {ROUTED}, t AS (SELECT * FROM x WHERE NOT cal AND s IS NOT NULL), {curve_sql('', 't', 's')}, pooled AS (SELECT {AREAS} FROM v),
cg AS (SELECT meter, s AS score, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY ALL), vg AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY meter) AS n_pos, sum(neg) OVER (PARTITION BY meter) AS n_neg FROM cg WINDOW w AS (PARTITION BY meter ORDER BY score DESC)),
mg AS (SELECT meter, {AREAS} FROM vg GROUP BY meter), kc AS (SELECT s AS score, sum(y) AS pos, sum(1 - y) AS neg FROM x WHERE cal AND s IS NOT NULL GROUP BY 1),
kv AS (SELECT score, round(2.0 * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w + sum(pos) OVER ()), 6) AS f1 FROM kc WINDOW w AS (ORDER BY score DESC)), th AS (SELECT score AS threshold FROM kv ORDER BY f1 DESC, score DESC LIMIT 1)
SELECT (SELECT roc_auc FROM pooled) AS roc_auc, (SELECT pr_auc FROM pooled) AS pr_auc, (SELECT round(avg(roc_auc), 6) FROM mg) AS macro_auc, (SELECT round(count(own) / count(*), 6) FROM x WHERE NOT cal) AS coverage, (SELECT round(count(s) / count(*), 6) FROM x WHERE NOT cal) AS scored,
(SELECT round(2 * count(*) FILTER (s >= threshold AND y = 1) / (count(*) FILTER (s >= threshold) + count(*) FILTER (y = 1)), 6) FROM t, th) AS f1, (SELECT threshold FROM th) AS threshold""")
def routed_metrics(spark, sf):
    rows = preds(spark, sf).withColumn("own", F.when(F.col("reading") > 20, F.col("score_a"))).withColumn("other", F.when(F.col("reading") > 5, F.col("score_b"))).withColumn("cal", F.col("building_id") % 5 == 4)
    return strata.routed_metrics(rows, "meter", "own", "other", "cal")


@query(f"""WITH {P}, o AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('0:' || raw_index), raw_index) - 1) * 2 + (1 - y) AS place FROM p), b AS (SELECT unnest([2000, 6000]) AS budget),
l AS (SELECT budget, meter, 'score_a' AS model, score_a AS s, y FROM o, b WHERE place < budget UNION ALL SELECT budget, meter, 'score_b', score_b, y FROM o, b WHERE place < budget), {curve_sql('budget, meter, model', 'l', 's')}, m AS (SELECT budget, meter, model, {AREAS} FROM v GROUP BY ALL),
w AS (SELECT budget, meter, max(roc_auc) FILTER (model = 'score_a') AS score_a, max(roc_auc) FILTER (model = 'score_b') AS score_b FROM m GROUP BY ALL) SELECT *, round(score_a - score_b, 6) AS gap FROM w WHERE score_a IS NOT NULL AND score_b IS NOT NULL""")
def budget_table(spark, sf):
    from ohmflow.operators import metrics

    rows = sampling.nested_balanced(preds(spark, sf).drop("score"), "raw_index", [2000, 6000], "y")
    cells = metrics.score_columns_metrics(rows, ["score_a", "score_b"], ["budget", "meter"])
    return strata.budget_table(cells, ["budget", "meter"], "model", ["score_a", "score_b"], "roc_auc")


@query(f"""WITH {P.replace("FROM lineitem", "FROM lineitem WHERE l_suppkey % 16 IN (1, 2)")}, c AS (SELECT site_id AS g, score_a AS s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1, 2),
x AS (SELECT a.g AS a, b.g AS b, sum(a.pos * b.neg) AS n, sum(a.pos * b.neg * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS won FROM c a, c b GROUP BY 1, 2 HAVING sum(a.pos * b.neg) > 0),
r AS (SELECT *, (rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0) / count(*) OVER () AS r FROM p)
SELECT 'auc_' || a || '_' || b AS endpoint, round(won / n, 6) AS value FROM x UNION ALL SELECT 'rank_' || site_id || CASE WHEN y = 1 THEN '_pos' ELSE '_neg' END, round(avg(r), 6) FROM r GROUP BY site_id, y
UNION ALL SELECT 'margin_' || site_id, round(avg(score_a) FILTER (y = 1) - avg(score_a) FILTER (y = 0), 6) FROM p GROUP BY site_id""")
def endpoint_panel(spark, sf):
    return strata.endpoint_panel(preds(spark, sf).withColumn("site_id", F.col("site_id").cast("string")), "site_id", "1", "2")


# --- gates ---


@query(f"""WITH {P}, s AS (SELECT raw_index, CASE WHEN raw_index % 97 = 0 THEN 1 - y ELSE y END AS y, meter FROM p WHERE site_id = 3), c AS (SELECT raw_index, y FROM p WHERE building_id % 2 = 1), j AS (SELECT s.*, c.raw_index AS ck, c.y AS cy FROM s LEFT JOIN c USING (raw_index)),
x AS (SELECT abs(count(*) - 500) AS size, count(*) - count(DISTINCT raw_index) AS uniq, count(*) FILTER (ck IS NULL) AS member, greatest(abs(count(*) FILTER (y = 1) - count(*) FILTER (y = 0)) - 1, 0) AS parity, count(*) FILTER (ck IS NOT NULL AND y <> cy) AS label, count(*) FILTER (meter = 'O') AS excluded FROM j)
SELECT "check", failures, failures = 0 AS passed FROM (SELECT 'size' AS "check", size AS failures FROM x UNION ALL SELECT 'unique', uniq FROM x UNION ALL SELECT 'member', member FROM x UNION ALL SELECT 'parity', parity FROM x UNION ALL SELECT 'label', label FROM x UNION ALL SELECT 'excluded', excluded FROM x)""")
def manifest_checks(spark, sf):
    rows = anomalies(spark, sf)
    selected = rows.filter("site_id = 3").select("raw_index", F.when(F.col("raw_index") % 97 == 0, 1 - F.col("anomaly")).otherwise(F.col("anomaly")).alias("anomaly"), "meter")
    return gates.manifest_checks(selected, rows.filter("building_id % 2 = 1"), 500, "raw_index", excluded=F.col("meter") == "O")


LADDER = """b AS (SELECT s_suppkey AS building_id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position FROM supplier), l AS (SELECT budget, CASE WHEN budget = 20 AND position = 7 THEN 7 ELSE position END AS position, CASE WHEN budget = 20 AND position = 7 THEN -1 ELSE building_id END AS building_id, CASE WHEN position % 5 = 4 THEN 'stop' ELSE 'fit' END AS role FROM b, (SELECT unnest([10, 20, 50]) AS budget) WHERE position < budget)"""


@query(f"""WITH {LADDER}, p AS (SELECT budget, count(*) AS n, count(DISTINCT building_id) AS d FROM l GROUP BY 1), s AS (SELECT count(DISTINCT building_id) AS d FROM l GROUP BY position), k AS (SELECT count(DISTINCT role) AS d FROM l GROUP BY building_id)
SELECT "check", failures, failures = 0 AS passed FROM (SELECT 'unique' AS "check", CAST(sum(n - d) AS BIGINT) AS failures FROM p UNION ALL SELECT 'size', count(*) FILTER (n <> budget) FROM p UNION ALL SELECT 'prefix', count(*) FILTER (d > 1) FROM s UNION ALL SELECT 'roles', count(*) FILTER (d > 1) FROM k)""")
def ladder_checks(spark, sf):
    from pyspark.sql import Window

    placed = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("building_id"), (F.row_number().over(Window.orderBy("s_acctbal", "s_suppkey")) - 1).alias("position"))
    steps = placed.withColumn("budget", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50)))).filter("position < budget").withColumn("role", F.when(F.col("position") % 5 == 4, "stop").otherwise("fit"))
    broken = steps.withColumn("building_id", F.when((F.col("budget") == 20) & (F.col("position") == 7), F.lit(-1).cast("long")).otherwise(F.col("building_id")))
    return gates.ladder_checks(broken, ["fit", "stop"])


@query("""WITH x AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 400000 END AS s FROM orders) SELECT "check", failures, failures = 0 AS passed FROM (SELECT 'length' AS "check", abs(count(*) - 15000) AS failures FROM x
UNION ALL SELECT 'unique', count(*) - count(DISTINCT k) FROM x UNION ALL SELECT 'finite', count(*) FILTER (s IS NULL) FROM x UNION ALL SELECT 'range', count(*) FILTER (s IS NOT NULL AND NOT s BETWEEN 0 AND 1) FROM x)""")
def prediction_checks(spark, sf):
    rows = td.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 400000).alias("s"))
    return gates.prediction_checks(rows, "k", "s", 15000)


@query("""WITH u AS (SELECT l_linenumber AS seed, l_suppkey % 5 AS k, l_returnflag AS family, count(*) % 2 AS rows, max(l_shipdate) > TIMESTAMP '2001-11-01' AS late FROM lineitem GROUP BY ALL), g AS (SELECT seed, k, count(DISTINCT family) AS families, CAST(count(DISTINCT rows) > 1 AS BIGINT) + CAST(count(DISTINCT late) > 1 AS BIGINT) AS differing FROM u GROUP BY ALL)
SELECT *, families >= 2 AND differing = 0 AS matched FROM g""")
def matched_contexts(spark, sf):
    units = td.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("seed"), (F.col("l_suppkey") % 5).alias("k"), F.col("l_returnflag").alias("family")).agg((F.count("*") % 2).alias("rows"), (F.max("l_shipdate") > F.lit("2001-11-01").cast("timestamp_ntz")).alias("late"))
    return gates.matched_contexts(units, ["seed", "k"], "family", ["rows", "late"])


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS price, o_custkey AS cust FROM orders),
j AS (SELECT a.k IS NULL OR b.k IS NULL AS lost, a.price AS ap, b.price AS bp, a.cust AS ac, b.cust AS bc FROM a FULL JOIN b USING (k)), x AS (SELECT 'price' AS field, count(*) FILTER (lost) AS missing, 0 AS not_finite, count(*) FILTER (NOT lost AND ((ap IS NULL) <> (bp IS NULL) OR abs(ap - bp) > 1e-9)) AS differing FROM j
UNION ALL SELECT 'cust', count(*) FILTER (lost), 0, count(*) FILTER (NOT lost AND ((ac IS NULL) <> (bc IS NULL) OR abs(ac - bc) > 1e-9)) FROM j) SELECT *, missing = 0 AND not_finite = 0 AND differing = 0 AS passed FROM x""")
def feature_checks(spark, sf):
    o = td.table(spark, sf, "orders")
    shard = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("cust"))
    rebuilt = o.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)).alias("price"), F.col("o_custkey").alias("cust"))
    return gates.feature_checks(shard, rebuilt, "k", ["price", "cust"])


@query("""WITH x AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k),
g AS (SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, count(*) FILTER (b = 0) AS only_a, count(*) FILTER (a = 0) AS only_b, count(*) FILTER (a > 1 OR b > 1) AS repeated FROM x) SELECT *, only_a = 0 AND only_b = 0 AND repeated = 0 AS aligned FROM g""")
def key_alignment(spark, sf):
    return gates.alignment(td.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), td.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


# --- samples ---


def _context_sql(where: str, quota: str) -> str:
    return f"""WITH {P}, x AS (SELECT raw_index, meter, site_id, y AS anomaly FROM p WHERE {where}), g AS (SELECT anomaly, meter, count(*) AS have FROM x GROUP BY ALL), w AS (SELECT *, {quota} AS w FROM g), s AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY anomaly) AS q FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY anomaly ORDER BY q - floor(q) DESC, meter) AS i, 100 - sum(floor(q)) OVER (PARTITION BY anomaly) AS spare FROM s), n AS (SELECT anomaly, meter, floor(q) + CASE WHEN i <= spare THEN 1 ELSE 0 END AS quota FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY anomaly, meter ORDER BY md5('0:' || raw_index), raw_index) AS i FROM x) SELECT raw_index, o.meter, o.anomaly FROM o JOIN n ON n.anomaly = o.anomaly AND n.meter = o.meter WHERE i <= quota"""


def _context(spark, sf, tag):
    return sampling.context(anomalies(spark, sf), 200, context_tag(tag), "raw_index").select("raw_index", "meter", "anomaly")


@query(_context_sql("true", "1.0"))
def balanced_context(spark, sf):
    return _context(spark, sf, "meter_balanced")


@query(_context_sql("true", "CASE WHEN meter = 'O' THEN 0.7 ELSE 0.3 * have / (SELECT sum(have) FROM g h WHERE h.anomaly = g.anomaly AND h.meter <> 'O') END"))
def heavy_context(spark, sf):
    return _context(spark, sf, "meter_heavy:O:0.7")


@query(_context_sql("meter <> 'F'", "have"))
def excluded_context(spark, sf):
    return _context(spark, sf, "meter_excluded:F")


@query(_context_sql("site_id = 5", "have").replace("meter, count(*) AS have FROM x", "'5' AS meter, count(*) AS have FROM x").replace("SELECT raw_index, meter, site_id", "SELECT raw_index, meter AS real_meter, '5' AS meter, site_id").replace("o.meter, o.anomaly FROM", "o.real_meter AS meter, o.anomaly FROM"))
def source_context(spark, sf):
    return _context(spark, sf, "site_source:5")


@query(f"""WITH {P}, g AS (SELECT y, count(*) AS w FROM p GROUP BY 1), b AS (SELECT unnest([100, 400]) AS budget), s AS (SELECT budget, y, budget * w / sum(w) OVER (PARTITION BY budget) AS q FROM g, b), k AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY q - floor(q) DESC, y) AS i, budget - sum(floor(q)) OVER (PARTITION BY budget) AS spare FROM s),
n AS (SELECT budget, y, floor(q) + CASE WHEN i <= spare THEN 1 ELSE 0 END AS quota FROM k), o AS (SELECT raw_index, y, row_number() OVER (PARTITION BY y ORDER BY md5('3:' || raw_index), raw_index) AS i FROM p) SELECT budget, raw_index, o.y FROM o JOIN n ON n.y = o.y AND i <= quota""")
def natural_contexts(spark, sf):
    return sampling.natural_contexts(preds(spark, sf), "raw_index", [100, 400], "y", 3).select("budget", "raw_index", "y")


@query(f"WITH {P}, o AS (SELECT raw_index, CAST(reading > 30 AS INTEGER) AS flag FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5('2:' || raw_index), raw_index) AS i FROM o) SELECT raw_index, flag FROM k WHERE i <= 75")
def half_flagged(spark, sf):
    return sampling.half_flagged(preds(spark, sf).withColumn("flag", (F.col("reading") > 30).cast("int")), "flag", 150, "raw_index", 2).select("raw_index", "flag")


@query(f"WITH {P}, k AS (SELECT raw_index, y AS anomaly, row_number() OVER (PARTITION BY y ORDER BY md5('4:' || raw_index), raw_index) - 1 AS i FROM p) SELECT raw_index, anomaly, i * 2 + (1 - anomaly) AS place FROM k WHERE i < 80")
def bounded_class_rows(spark, sf):
    return sampling.bounded_rows(anomalies(spark, sf), 80, "raw_index", seed=4).select("raw_index", "anomaly", F.col("place").cast("long").alias("place"))


@query(f"WITH {P}, a AS (SELECT * FROM p WHERE site_id < 4), n AS (SELECT count(*) AS n FROM a WHERE y = 1), x AS (SELECT *, row_number() OVER (ORDER BY md5('10:' || raw_index), raw_index) AS i, row_number() OVER (ORDER BY md5('11:' || raw_index), raw_index) AS j FROM a WHERE y = 0) SELECT 0 AS copy_id, building_id, meter, raw_index FROM x, n WHERE i <= n UNION ALL SELECT 1, building_id, meter, raw_index FROM x, n WHERE j <= n UNION ALL SELECT unnest([0, 1]), building_id, meter, raw_index FROM a WHERE y = 1")
def downsampled_ids(spark, sf):
    return sampling.downsampled_ids(anomalies(spark, sf).filter("site_id < 4"), "raw_index", ["building_id", "meter"])


_SIDE = "CASE WHEN site_id % 4 < 2 THEN 'train' WHEN site_id % 4 = 2 THEN 'val' ELSE 'test' END"


@query(f"""WITH {P}, x AS (SELECT raw_index, y, {_SIDE} AS side FROM p), f AS (SELECT raw_index, row_number() OVER (PARTITION BY y ORDER BY md5('6:' || raw_index), raw_index) AS i FROM x WHERE side = 'train'),
o AS (SELECT side, raw_index, row_number() OVER (PARTITION BY side ORDER BY md5(CASE side WHEN 'train' THEN '7:' WHEN 'val' THEN '8:' ELSE '9:' END || raw_index), raw_index) AS i FROM x) SELECT 'fit' AS role, raw_index FROM f WHERE i <= 50 UNION ALL SELECT side, raw_index FROM o WHERE i <= 60""")
def index_sets(spark, sf):
    side = F.when(F.col("site_id") % 4 < 2, "train").when(F.col("site_id") % 4 == 2, "val").otherwise("test")
    return sampling.index_sets(anomalies(spark, sf).withColumn("side", side), "side", 100, 60, "raw_index", seed=6)


@query(f"""WITH {P}, b AS (SELECT building_id, row_number() OVER (ORDER BY building_id) - 1 AS position FROM (SELECT DISTINCT building_id FROM p)) SELECT raw_index, building_id, CASE WHEN position % 5 = 4 THEN 'stop' ELSE 'fit' END AS role FROM p JOIN b USING (building_id) WHERE position < 20""")
def ladder_cell_rows(spark, sf):
    from pyspark.sql import Window

    rows = anomalies(spark, sf)
    placed = rows.select("building_id").distinct().withColumn("position", F.row_number().over(Window.orderBy("building_id")) - 1)
    steps = placed.withColumn("budget", F.explode(F.array(F.lit(10), F.lit(20)))).filter("position < budget").withColumn("role", F.when(F.col("position") % 5 == 4, "stop").otherwise("fit"))
    return sampling.ladder_rows(rows, steps, 20).select("raw_index", "building_id", "role")


@query(f"""WITH {P}, b AS (SELECT building_id, count(*) AS rows, row_number() OVER (ORDER BY building_id) - 1 AS position FROM p GROUP BY 1), c AS (SELECT *, CASE WHEN position < 10 THEN 0 ELSE 1 END AS block, CASE WHEN position < 10 THEN 300 ELSE 500 END AS total FROM b WHERE position < 30),
s AS (SELECT *, total * rows / sum(rows) OVER (PARTITION BY block) AS q FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY q - floor(q) DESC, building_id) AS i, total - sum(floor(q)) OVER (PARTITION BY block) AS spare FROM s) SELECT building_id, position, rows, CAST(floor(q) + CASE WHEN i <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k""")
def building_quotas(spark, sf):
    from pyspark.sql import Window

    counts = preds(spark, sf).groupBy("building_id").agg(F.count("*").alias("rows")).withColumn("position", F.row_number().over(Window.orderBy("building_id")) - 1)
    return sampling.building_quotas(counts, [(10, 300), (30, 500)])


@query(f"""WITH {P}, k AS (SELECT *, unnest([1, 2, 3]) AS seed FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || raw_index), raw_index) AS i FROM k), t AS (SELECT * FROM o WHERE i <= 2000), {curve_sql('seed', 't')}, m AS (SELECT seed, {AREAS} FROM v GROUP BY seed)
SELECT count(roc_auc) AS runs, round(avg(roc_auc), 6) AS mean, round(stddev_pop(roc_auc), 6) AS std_pop, round(stddev_samp(roc_auc), 6) AS std_samp, round(min(roc_auc), 6) AS low, round(max(roc_auc), 6) AS high FROM m""")
def seed_stability(spark, sf):
    return experiments.matched_replicates(sampling.seeded_samples(preds(spark, sf), [1, 2, 3], 2000, "raw_index"))


@query("""WITH b AS (SELECT s_suppkey AS building_id, s_nationkey AS site_id, s_suppkey % 9 AS rows, s_suppkey % 3 AS anomalies FROM supplier), o AS (SELECT *, unnest([1, 2, 3]) AS seed FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || building_id), building_id) - 1 AS position FROM o),
c AS (SELECT * FROM q, (SELECT unnest([10, 40]) AS budget) WHERE position < budget), s AS (SELECT seed, budget, count(*) AS buildings, count(DISTINCT site_id) AS sites, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(anomalies) AS BIGINT) AS anomalies, list(building_id) AS l FROM c GROUP BY ALL),
j AS (SELECT x.seed, x.budget, round(min(len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l)))), 6) AS least_overlap FROM s x JOIN s y ON x.budget = y.budget AND x.seed <> y.seed GROUP BY ALL) SELECT seed, budget, buildings, sites, rows, anomalies, true AS prefix, least_overlap FROM s LEFT JOIN j USING (seed, budget)""")
def ladder_sensitivity(spark, sf):
    table = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("building_id"), F.col("s_nationkey").alias("site_id"), (F.col("s_suppkey") % 9).alias("rows"), (F.col("s_suppkey") % 3).alias("anomalies"))
    return sampling.ladder_sensitivity(table, [10, 40], [1, 2, 3])


# --- experiments ---


@query(f"""WITH {LAB}, e AS (SELECT 'by_building' AS experiment, CASE WHEN building_id % 2 = 1 THEN 'val' ELSE 'train' END AS side, anomaly FROM a UNION ALL SELECT 'by_site', CASE WHEN site_id % 2 = 1 THEN 'val' ELSE 'train' END, anomaly FROM a UNION ALL SELECT 'views_by_site', CASE WHEN site_id % 2 = 1 THEN 'val' ELSE 'train' END, anomaly FROM a WHERE meter = 'view')
SELECT experiment, side, count(*) AS rows, CAST(sum(anomaly) AS BIGINT) AS anomalies FROM e GROUP BY ALL""")
def experiment_masks(spark, sf):
    made = experiments.masks(td.labelled_readings(spark, sf), {"by_building": (splits.location_side("A0"), None), "by_site": (splits.location_side("A1"), None), "views_by_site": (splits.location_side("A1"), F.col("meter") == "view")})
    return made.groupBy("experiment", "side").agg(F.count("*").alias("rows"), F.sum("anomaly").alias("anomalies"))


@query(f"""WITH {R}, e AS (SELECT 'mod5' AS split, CASE WHEN building_id % 5 = 4 THEN 'val' ELSE 'train' END AS side, r.* FROM r UNION ALL SELECT 'mod2', CASE WHEN building_id % 2 = 1 THEN 'val' ELSE 'train' END, r.* FROM r),
f AS (SELECT split, side, 'timestamp' AS regime, meter_reading - max(meter_reading) OVER (PARTITION BY split, side, building_id, meter ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS f FROM e UNION ALL SELECT split, side, 'row_offset_meter', meter_reading - lag(meter_reading) OVER (PARTITION BY split, side, building_id, meter ORDER BY timestamp) FROM e)
SELECT split, regime, side, count(*) AS rows, round(avg(CASE WHEN f IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, round(avg(round(f, 6)) + 1e-9, 6) AS mean FROM f GROUP BY ALL""")
def split_regimes(spark, sf):
    sides = {"mod5": F.when(F.col("building_id") % 5 == 4, "val").otherwise("train"), "mod2": F.when(F.col("building_id") % 2 == 1, "val").otherwise("train")}
    build = lambda regime: lambda rows: features.value_changes(rows, [1], regime, extra_keys=("experiment", "side"))
    return experiments.split_regimes(td.readings(spark, sf), sides, {r: build(r) for r in ("timestamp", "row_offset_meter")}, "lag_value_diff_1")


@query(f"""WITH {P}, {DRAWS}, s AS (SELECT building_id, CAST(meter = 'O' AS INTEGER) AS a, y AS b, sum(score_a) AS t, count(score_a) AS n FROM p GROUP BY ALL), c AS (SELECT draw, a, b, sum(t * weight) / sum(s.n * weight) AS v FROM s JOIN w USING (building_id) GROUP BY ALL),
q AS (SELECT draw, max(v) FILTER (a = 0 AND b = 0) AS c00, max(v) FILTER (a = 0 AND b = 1) AS c01, max(v) FILTER (a = 1 AND b = 0) AS c10, max(v) FILTER (a = 1 AND b = 1) AS c11 FROM c GROUP BY draw),
e AS (SELECT 'main_a' AS effect, round((c10 + c11 - c00 - c01) / 2, 9) AS x FROM q UNION ALL SELECT 'main_b', round((c01 + c11 - c00 - c10) / 2, 9) FROM q UNION ALL SELECT 'interaction', round(c11 - c10 - c01 + c00, 9) FROM q)
SELECT effect, count(*) AS draws, count(*) FILTER (x IS NULL) AS invalid, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0 AS excludes_zero FROM e GROUP BY effect""")
def factorial_intervals(spark, sf):
    rows = preds(spark, sf).withColumn("a", (F.col("meter") == "O").cast("int")).withColumn("b", F.col("y"))
    return experiments.factorial_bootstrap(rows, "building_id", "a", "b", "score", 20)


def _importance_sql() -> str:
    dealt = lambda name, columns: f"SELECT '{name}' AS feature, o.repeat, o.y, " + ", ".join(f"{'h' if c in columns else 'o'}.{c}" for c in ("score_a", "score_b", "reading")) + " FROM o JOIN h USING (repeat, meter, i)"
    return f"""WITH {P}, r AS (SELECT unnest(range(0, 2)) AS repeat), o AS (SELECT repeat, meter, raw_index, y, score_a, score_b, reading, row_number() OVER (PARTITION BY repeat, meter ORDER BY raw_index) AS i FROM p, r),
h AS (SELECT repeat, meter, score_a, score_b, reading, row_number() OVER (PARTITION BY repeat, meter ORDER BY md5('0:' || repeat || ':' || raw_index), raw_index) AS i FROM p, r),
l AS ({dealt('score_a', ['score_a'])} UNION ALL {dealt('score_b', ['score_b'])} UNION ALL {dealt('both', ['score_a', 'score_b'])} UNION ALL SELECT 'base', 0, y, score_a, score_b, reading FROM p), t AS (SELECT feature, repeat, y, round(score_a - 0.5 * score_b + reading / 50, 6) AS s FROM l),
{curve_sql('feature, repeat', 't', 's')}, m AS (SELECT feature, repeat, {AREAS} FROM v GROUP BY ALL), d AS (SELECT m.feature, b.roc_auc - m.roc_auc AS roc, b.pr_auc - m.pr_auc AS pr FROM m JOIN m b ON b.feature = 'base' WHERE m.feature <> 'base')
SELECT feature, count(*) AS repeats, round(avg(roc), 6) AS roc_drop, round(stddev_pop(roc), 6) AS roc_std, round(avg(pr), 6) AS pr_drop, round(stddev_pop(pr), 6) AS pr_std FROM d GROUP BY feature"""


@query(_importance_sql())
def permutation_drops(spark, sf):
    scorer = lambda: F.round(F.col("score_a") - 0.5 * F.col("score_b") + F.col("reading") / 50, 6)
    return experiments.permutation_importance(td.predictions(spark, sf).select("raw_index", "meter", "y", *COLUMNS), {"score_a": ["score_a"], "score_b": ["score_b"], "both": ["score_a", "score_b"]}, scorer, "raw_index", 2, ["meter"])


COLUMNS = ["reading", "score_a", "score_b"]


def _fits(spark, sf):
    rows = td.predictions(spark, sf)
    return rows.filter("site_id % 4 < 2"), rows.filter("site_id % 4 = 2"), rows.filter("site_id % 4 = 3")


@query()
def label_efficiency(spark, sf):
    """A fit per nested training budget."""
    train, _, test = _fits(spark, sf)
    return experiments.label_efficiency(train, test, COLUMNS, [500, 4000], "raw_index")


@query()
def dimensionality_axis(spark, sf):
    train, _, test = _fits(spark, sf)
    return experiments.dimensionality(train, test, COLUMNS[:2])


@query()
def refit_ablation(spark, sf):
    """Refits without a group of columns, and with it held constant."""
    train, _, test = _fits(spark, sf)
    return experiments.ablations(train, test, COLUMNS, {"scores": ["score_a", "score_b"]})


@query()
def shuffled_label_fits(spark, sf):
    train, _, test = _fits(spark, sf)
    return experiments.shuffled_fits(train, test, COLUMNS, [1, 2], "raw_index")


@query()
def default_and_tuned(spark, sf):
    train, validation, test = _fits(spark, sf)
    return experiments.default_and_tuned(train, validation, test, COLUMNS, [2, 5])


@query()
def stability_axis(spark, sf):
    train, _, test = _fits(spark, sf)
    return experiments.stability(train, test, COLUMNS, [1, 2], 2000, "raw_index")


@query()
def transfer_report(spark, sf):
    """A learner of the even sites on the odd ones, by overlap and meter."""
    rows = td.predictions(spark, sf).withColumn("overlap", F.col("building_id") % 3 == 0)
    return experiments.transfer(rows.filter("site_id % 2 = 0"), rows.filter("site_id % 2 = 1"), COLUMNS, "overlap", "meter")


# --- sources ---


@query("SELECT o_orderkey AS row_id, o_custkey AS building_id, o_orderkey AS meter, o_orderdate AS timestamp, CAST(o_totalprice > 300000 AS INTEGER) AS anomaly FROM orders")
def attached_labels(spark, sf):
    o = td.table(spark, sf, "orders")
    readings = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("building_id"), F.col("o_orderkey").alias("meter"), F.col("o_orderdate").alias("timestamp"))
    return ingest.attach_labels(readings, o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 300000).cast("int").alias("is_bad_meter_reading")))


@query("SELECT o_orderkey AS raw_index, CAST(o_totalprice > 300000 AS INTEGER) AS anomaly FROM orders")
def merged_shards(spark, sf):
    rows = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("raw_index"), (F.col("o_totalprice") > 300000).cast("int").alias("anomaly"))
    return ingest.union_shards([rows.filter("raw_index % 3 = 0"), rows.filter("raw_index % 3 <> 0")], rows).select("raw_index", "anomaly")


@query("SELECT n_nationkey AS site_id, n_name AS site_name FROM nation")
def site_names(spark, sf):
    pairs = td.table(spark, sf, "supplier").join(td.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "right")
    return ingest.site_names(pairs.select(F.col("s_nationkey").alias("site_id"), F.col("n_name").alias("site_name")))
