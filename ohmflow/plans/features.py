"""Queries of ingest, column functions and time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.functions import scalar
from ohmflow.operators import features, splits
from ohmflow.plans.registry import query
from ohmflow.sources import ingest
from ohmflow.sources import testdata as td

R, LAB, B, W = td.READINGS, td.LABELLED, td.BUILDINGS, td.WEATHER
SHIFT = lambda n: f"max(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY timestamp RANGE BETWEEN INTERVAL {n} HOUR PRECEDING AND INTERVAL {n} HOUR PRECEDING)"
AHEAD = lambda n: f"max(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY timestamp RANGE BETWEEN INTERVAL {n} HOUR FOLLOWING AND INTERVAL {n} HOUR FOLLOWING)"


@query(f"""
WITH {LAB},
s AS (SELECT *, CASE WHEN building_id % 5 = 4 THEN 'val' ELSE 'train' END AS side, {SHIFT(1)} AS s1, {SHIFT(24)} AS s24, {AHEAD(1)} AS f1 FROM a)
SELECT side, meter, count(*) AS rows, round(avg(CASE WHEN s1 IS NULL THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS null_rate_1,
  round(avg(round(meter_reading - s1, 6)) + 1e-9, 6) AS mean_diff_1, round(avg(round((meter_reading + 1) / nullif(s1 + 1, 0), 6)) + 1e-9, 6) AS mean_ratio_1,
  round(avg(round(meter_reading - s24, 6)) + 1e-9, 6) AS mean_diff_24, round(avg(round(meter_reading - f1, 6)) + 1e-9, 6) AS mean_diff_next,
  round(avg(anomaly) + 1e-9, 6) AS anomaly_rate
FROM s GROUP BY side, meter""")
def value_change_by_side(spark, sf):
    rows = splits.building_split(td.labelled_readings(spark, sf), "80_20_mod5")
    made = features.value_changes(rows, (1, 24, -1), digits=6, extra_keys=("side",))
    mean = lambda c, n: F.round(F.avg(c) + 1e-9, 6).alias(n)  # noqa: E731  halves round alike in both engines
    return made.groupBy("side", "meter").agg(
        F.count("*").alias("rows"), mean(F.col("lag_value_diff_1").isNull().cast("double"), "null_rate_1"), mean("lag_value_diff_1", "mean_diff_1"), mean("lag_value_ratio_1", "mean_ratio_1"), mean("lag_value_diff_24", "mean_diff_24"), mean("lag_value_diff_-1", "mean_diff_next"), mean("anomaly", "anomaly_rate")
    )


_S = (1, 2, 3, 24, 48, 168)


@query(f"WITH {R}, s AS (SELECT *, " + ", ".join([f"{SHIFT(n)} AS s{n}" for n in _S] + [f"{AHEAD(n)} AS f{n}" for n in _S]) + ") SELECT building_id, meter, timestamp, meter_reading, ".replace(") SELECT", " FROM r) SELECT") + ", ".join(f"round(meter_reading - {p}{n}, 6) AS \"lag_value_diff_{g}{n}\", round((meter_reading + 1) / nullif({p}{n} + 1, 0), 6) AS \"lag_value_ratio_{g}{n}\"" for p, g in (("s", ""), ("f", "-")) for n in _S) + " FROM s")
def value_change_timestamp(spark, sf):
    made = features.value_changes(td.readings(spark, sf).drop("site_id"), (*_S, *[-n for n in _S]), digits=6)
    return made


_ALL = [n for n in range(-30, 31) if n]


@query(f"WITH {R}, s AS (SELECT *, " + ", ".join(f"{SHIFT(n) if n > 0 else AHEAD(-n)} AS {'s' if n > 0 else 'f'}{abs(n)}" for n in _ALL) + " FROM r) SELECT building_id, site_id, meter, timestamp, meter_reading, " + ", ".join(f"round(meter_reading - {'s' if n > 0 else 'f'}{abs(n)} + 1e-9, 6) AS \"lag_value_diff_{n}\", round((meter_reading + 1) / nullif({'s' if n > 0 else 'f'}{abs(n)} + 1, 0) + 1e-9, 6) AS \"lag_value_ratio_{n}\"" for n in _ALL) + " FROM s")
def value_change_full_set(spark, sf):
    """All 60 shifts of both kinds."""
    rows = td.readings(spark, sf)
    made = features.value_changes(rows, scalar.BASELINE_SHIFTS)
    return made.select(*rows.columns, *[F.round(F.col(c) + features.TIE, 6).alias(c) for c in made.columns if c.startswith("lag_value_")])


@query(f"""WITH {R}, s AS (SELECT *, lag(meter_reading, 1) OVER w AS s1, lead(meter_reading, 2) OVER w AS f2 FROM r WINDOW w AS (PARTITION BY building_id ORDER BY timestamp, meter))
SELECT building_id, meter, timestamp, round(meter_reading - s1, 6) AS lag_value_diff_1, round((meter_reading + 1) / nullif(s1 + 1, 0), 6) AS lag_value_ratio_1,
  round(meter_reading - f2, 6) AS "lag_value_diff_-2", round((meter_reading + 1) / nullif(f2 + 1, 0), 6) AS "lag_value_ratio_-2" FROM s""")
def value_change_row_offset(spark, sf):
    return features.value_changes(td.readings(spark, sf), (1, -2), "row_offset", digits=6).drop("site_id", "meter_reading")


@query(f"""WITH {R}, s AS (SELECT *, lag(meter_reading, 1) OVER w AS s1 FROM r WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp))
SELECT building_id, meter, timestamp, round(s1 - meter_reading, 6) AS lag_value_diff_1, round((s1 + 1) / nullif(meter_reading + 1, 0), 6) AS lag_value_ratio_1 FROM s""")
def value_change_shifted_first(spark, sf):
    return features.value_changes(td.readings(spark, sf), (1,), "row_offset_meter", "shifted_first", digits=6).drop("site_id", "meter_reading")


@query(f"""WITH {R}, s AS (SELECT *, max(meter_reading) OVER (PARTITION BY building_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS s1 FROM r)
SELECT building_id, meter, timestamp, round(meter_reading - s1, 6) AS lag_value_diff_1, round((meter_reading + 1) / nullif(s1 + 1, 0), 6) AS lag_value_ratio_1 FROM s""")
def value_change_without_meter_key(spark, sf):
    return features.value_changes(td.readings(spark, sf), (1,), "timestamp_building", digits=6).drop("site_id", "meter_reading")


@query(f"""WITH {R}, x AS (SELECT *, lag(meter_reading, 1) OVER a AS a1, lag(meter_reading, 1) OVER b AS b1 FROM r
  WINDOW a AS (PARTITION BY building_id ORDER BY timestamp, meter), b AS (PARTITION BY building_id, meter ORDER BY timestamp)),
d AS (SELECT 1 AS shift, meter_reading - a1 AS a, meter_reading - b1 AS b FROM x)
SELECT shift, count(*) AS n, count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS null_mismatch,
  round(quantile_cont(abs(a - b), 0.5), 6) AS median_abs, round(quantile_cont(abs(a - b), 0.95), 6) AS p95_abs FROM d GROUP BY shift""")
def lag_contamination(spark, sf):
    return features.regime_contamination(td.readings(spark, sf), (1,))


@query(f"""WITH {R}, s AS (SELECT *, lag(meter_reading, 1) OVER w AS v1, lag(timestamp, 1) OVER w AS t1, lag(meter_reading, 24) OVER w AS v24, lag(timestamp, 24) OVER w AS t24 FROM r WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp)),
k AS (SELECT *, CASE WHEN timestamp - t1 = INTERVAL 1 HOUR THEN v1 END AS p1, CASE WHEN timestamp - t24 = INTERVAL 24 HOUR THEN v24 END AS p24 FROM s)
SELECT building_id, meter, timestamp, round(meter_reading - p1, 6) AS diff_1, round(meter_reading / nullif(p1, 0), 6) AS ratio_1, round(meter_reading - p24, 6) AS diff_24, round(meter_reading / nullif(p24, 0), 6) AS ratio_24 FROM k""")
def contiguous_diffs(spark, sf):
    return features.contiguous_diffs(td.readings(spark, sf), (1, 24)).drop("site_id", "meter_reading")


@query(f"""WITH {W} SELECT site_id, timestamp, air_temperature, cloud_coverage, lag(air_temperature, 7) OVER w AS air_temperature_lag_7,
  round(avg(air_temperature) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS air_temperature_mean_7, lag(air_temperature, 73) OVER w AS air_temperature_lag_73,
  round(avg(air_temperature) OVER (w ROWS BETWEEN 72 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS air_temperature_mean_73 FROM w WINDOW w AS (PARTITION BY site_id ORDER BY timestamp)""")
def weather_lags(spark, sf):
    return features.lag_and_rolling(td.weather(spark, sf), ["air_temperature"])


_FIT = {
    "1": [(0, "69/70.0"), (1, "4/70.0"), (2, "-6/70.0"), (3, "4/70.0"), (4, "-1/70.0")],
    "2": [(-1, "2/35.0"), (0, "27/35.0"), (1, "12/35.0"), (2, "-8/35.0"), (3, "2/35.0")],
    "n": [(0, "69/70.0"), (-1, "4/70.0"), (-2, "-6/70.0"), (-3, "4/70.0"), (-4, "-1/70.0")],
    "m": [(1, "2/35.0"), (0, "27/35.0"), (-1, "12/35.0"), (-2, "-8/35.0"), (-3, "2/35.0")],
    "i": [(-2, "-3/35.0"), (-1, "12/35.0"), (0, "17/35.0"), (1, "12/35.0"), (2, "-3/35.0")],
}
_dot = lambda k: " + ".join(f"({w}) * " + ("meter_reading" if o == 0 else f"lag(meter_reading, {-o}) OVER w" if o < 0 else f"lead(meter_reading, {o}) OVER w") for o, w in _FIT[k])


@query(f"""WITH {R}, x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY building_id, meter) AS n,
  {_dot('1')} AS e1, {_dot('2')} AS e2, {_dot('n')} AS en, {_dot('m')} AS em, {_dot('i')} AS ei FROM r WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp))
SELECT building_id, meter, timestamp, round(meter_reading - CASE WHEN n < 5 THEN NULL WHEN i = 1 THEN e1 WHEN i = 2 THEN e2 WHEN i = n THEN en WHEN i = n - 1 THEN em ELSE ei END, 4) AS smooth_residual FROM x""")
def smooth_residual(spark, sf):
    return features.smooth_residual(td.readings(spark, sf), digits=4).drop("site_id", "meter_reading")


@query(f"""WITH {LAB}, m AS (SELECT avg(anomaly) AS mean FROM a)
SELECT site_id, meter, count(anomaly) AS n, round((sum(anomaly) + 20.0 * max(mean)) / (count(anomaly) + 20.0), 6) AS encoded FROM a, m GROUP BY site_id, meter""")
def target_encoding(spark, sf):
    return features.target_encoding(td.labelled_readings(spark, sf), ["site_id", "meter"], "anomaly")


@query(f"""WITH {LAB}, t AS (SELECT * FROM a WHERE building_id % 5 <> 4), m AS (SELECT avg(anomaly) AS mean FROM t),
e AS (SELECT building_id % 3 AS k, meter, round((sum(anomaly) + 20.0 * max(mean)) / (count(anomaly) + 20.0), 6) AS encoded FROM t, m GROUP BY 1, 2)
SELECT building_id, a.meter, timestamp, coalesce(encoded, 0.05) AS encoded FROM a LEFT JOIN e ON e.k = building_id % 3 AND e.meter = a.meter WHERE building_id % 5 = 4""")
def target_encoding_applied(spark, sf):
    rows = td.labelled_readings(spark, sf).withColumn("k", F.col("building_id") % 3)
    fit = features.target_encoding(rows.filter("building_id % 5 <> 4"), ["k", "meter"], "anomaly")
    return features.apply_encoding(rows.filter("building_id % 5 = 4"), fit, ["k", "meter"], 0.05).select("building_id", "meter", "timestamp", "encoded")


@query(f"""WITH {R} SELECT building_id, meter, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS weekday, CAST(month(timestamp) AS INTEGER) AS month, round(dayofyear(timestamp) + hour(timestamp) / 24.0, 4) AS dayofyear,
  round(sin(hour(timestamp) * (2 * pi() / 24)), 6) AS hour_sin, round(cos(hour(timestamp) * (2 * pi() / 24)), 6) AS hour_cos,
  round(sin((isodow(timestamp) - 1) * (2 * pi() / 7)), 6) AS weekday_sin, round(cos((isodow(timestamp) - 1) * (2 * pi() / 7)), 6) AS weekday_cos,
  round(sin((month(timestamp) - 1) * (2 * pi() / 12)), 6) AS month_sin, round(cos((month(timestamp) - 1) * (2 * pi() / 12)), 6) AS month_cos FROM r""")
def calendar_features(spark, sf):
    ts = F.col("timestamp")
    return td.readings(spark, sf).select("building_id", "meter", "timestamp", *[c.alias(n) for n, c in {**scalar.calendar(ts), **scalar.cyclic(ts)}.items()])


@query(f"""WITH {R}, z AS (SELECT *, CASE building_id % 4 WHEN 0 THEN 'US/Pacific' WHEN 1 THEN 'Europe/Dublin' WHEN 2 THEN 'Europe/London' ELSE 'US/Eastern' END AS timezone FROM r),
h AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'IE' ELSE 'GB' END AS country, DATE '2024-01-01' + CAST(s_suppkey % 20 AS INTEGER) AS date FROM supplier)
SELECT timezone, count(*) AS rows, count(*) FILTER (h.country IS NOT NULL) AS holiday_rows FROM z LEFT JOIN h ON h.date = CAST(z.timestamp AS DATE)
  AND h.country = CASE WHEN timezone LIKE 'US/%' THEN 'US' WHEN timezone = 'Europe/Dublin' THEN 'IE' WHEN timezone = 'Europe/London' THEN 'GB' ELSE 'US' END GROUP BY timezone""")
def holiday_flags(spark, sf):
    zone = F.element_at(F.array(*[F.lit(z) for z in ("US/Pacific", "Europe/Dublin", "Europe/London", "US/Eastern")]), (F.col("building_id") % 4 + 1).cast("int"))
    country = F.element_at(F.array(F.lit("US"), F.lit("IE"), F.lit("GB")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    days = td.table(spark, sf, "supplier").select(country.alias("country"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 20).cast("int")).alias("date"))
    flagged = scalar.holidays(td.readings(spark, sf).withColumn("timezone", zone), days)
    return flagged.groupBy("timezone").agg(F.count("*").alias("rows"), F.count_if("is_holiday").alias("holiday_rows"))


@query(f"""WITH {B}, u AS (SELECT DISTINCT coalesce(primary_use, 'Unknown') AS u FROM b), c AS (SELECT u, CAST(row_number() OVER (ORDER BY u) - 1 AS INTEGER) AS code FROM u)
SELECT building_id, site_id, primary_use, square_feet, code AS primary_use_code, round(ln(1 + square_feet), 6) AS log_square_feet FROM b JOIN c ON c.u = coalesce(primary_use, 'Unknown')""")
def building_dimension(spark, sf):
    return ingest.clean_buildings(td.buildings(spark, sf))


@query(f"WITH {W} SELECT site_id, timestamp, air_temperature, CASE WHEN cloud_coverage = 255 THEN 10 ELSE cloud_coverage END AS cloud_coverage FROM w")
def weather_dimension(spark, sf):
    return ingest.clean_weather(td.weather(spark, sf))


@query(f"""WITH {R}, {B}, {W.replace("w AS", "wx AS")}, u AS (SELECT u, CAST(row_number() OVER (ORDER BY u) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT primary_use AS u FROM b))
SELECT r.site_id, r.timestamp, r.building_id, meter, meter_reading, CAST(hour(r.timestamp) AS INTEGER) AS hour, CAST(isodow(r.timestamp) - 1 AS INTEGER) AS weekday, CAST(month(r.timestamp) AS INTEGER) AS month, round(dayofyear(r.timestamp) + hour(r.timestamp) / 24.0, 4) AS dayofyear,
  primary_use, square_feet, code AS primary_use_code, round(ln(1 + square_feet), 6) AS log_square_feet, air_temperature, CASE WHEN cloud_coverage = 255 THEN 10 ELSE cloud_coverage END AS cloud_coverage
FROM r LEFT JOIN b ON b.building_id = r.building_id LEFT JOIN u ON u.u = b.primary_use LEFT JOIN wx ON wx.site_id = r.site_id AND wx.timestamp = r.timestamp""")
def denormalised_frame(spark, sf):
    return ingest.denormalise(td.readings(spark, sf), ingest.clean_buildings(td.buildings(spark, sf)), ingest.clean_weather(td.weather(spark, sf)))


@query("""SELECT d.doc_id, n_chars, quality, toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def partial_label_join(spark, sf):
    labels = td.table(spark, sf, "labels").withColumn("_l", F.lit(True))
    return td.table(spark, sf, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic", F.coalesce("_l", F.lit(False)).alias("labelled"))


@query(f"""WITH {R} SELECT CAST(building_id AS VARCHAR) AS building_id, 'view' AS meter, timestamp, meter_reading FROM (SELECT b.building_id, t.timestamp, r.meter_reading
  FROM (SELECT DISTINCT building_id FROM r WHERE building_id < 10) b CROSS JOIN (SELECT DISTINCT timestamp FROM r WHERE meter = 'view') t
  LEFT JOIN r ON r.building_id = b.building_id AND r.timestamp = t.timestamp AND r.meter = 'view')""")
def wide_to_long(spark, sf):
    rows = td.readings(spark, sf).filter("meter = 'view'")
    wide = rows.groupBy("timestamp").pivot("building_id", list(range(10))).agg(F.max("meter_reading"))
    return ingest.melt(wide, "view")


@query("""WITH u AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_partkey % 2 = 0), c AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM u)
SELECT p_partkey, coalesce(code, -1) AS brand_code FROM part LEFT JOIN c ON v = p_brand""")
def external_codes(spark, sf):
    part = td.table(spark, sf, "part")
    codes = scalar.category_codes(part.filter("p_partkey % 2 = 0"), "p_brand")
    return scalar.map_codes(part.select("p_partkey", "p_brand"), codes, "p_brand", "brand_code").select("p_partkey", "brand_code")


@query("""SELECT c_custkey, replace(trim(lower(coalesce(c_mktsegment, ''))), '_', ' ') AS segment, c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> '' AS present,
  concat_ws('_', coalesce(c_mktsegment, 'Unknown'), CAST(c_nationkey AS VARCHAR)) AS use_meter FROM customer""")
def category_cleaning(spark, sf):
    seg = F.col("c_mktsegment")
    return td.table(spark, sf, "customer").select("c_custkey", scalar.normal_category(seg).alias("segment"), scalar.non_blank(seg).alias("present"), scalar.use_meter(seg, F.col("c_nationkey")).alias("use_meter"))


@query(f"""WITH {R}, s AS (SELECT *, dayofyear(timestamp) + hour(timestamp) / 24.0 AS doy, round(least(meter_reading / 1000, 1), 6) AS score, building_id % 3 = 0 AS masked FROM r)
SELECT building_id, meter, timestamp, CASE WHEN doy > dayofyear(make_date(year(timestamp), 12, 31)) + 22.5 / 24 THEN 0.0 WHEN masked THEN 0.0 WHEN meter_reading = 1 THEN 1.0 ELSE score END AS score,
  CASE WHEN floor(doy) = 1 AND (building_id > 7 OR building_id < 3) THEN 0.0 ELSE score END AS new_year_score, round(ln(greatest(least(score, 1 - 1e-7), 1e-7) / (1 - greatest(least(score, 1 - 1e-7), 1e-7))), 6) AS log_odds,
  CASE WHEN meter_reading < 50 THEN 0 WHEN meter_reading < 200 THEN 1 ELSE 2 END AS band FROM s""")
def hard_rules(spark, sf):
    rows = td.readings(spark, sf).withColumn("doy", F.dayofyear("timestamp") + F.hour("timestamp") / 24.0).withColumn("raw", F.round(F.least(F.col("meter_reading") / 1000, F.lit(1.0)), 6))
    c = F.col
    return rows.select(
        "building_id", "meter", "timestamp", scalar.override_rules(c("raw"), c("meter_reading"), c("building_id") % 3 == 0, c("timestamp"), c("doy")).alias("score"), scalar.new_year_rule(c("raw"), c("building_id"), c("doy"), 3, 7).alias("new_year_score"), F.round(scalar.log_odds(c("raw")), 6).alias("log_odds"), scalar.band(c("meter_reading"), [50.0, 200.0]).alias("band")
    )


@query(f"""WITH {td.PREDICTIONS} SELECT raw_index, md5('7:' || raw_index) AS priority, round((CAST('0x' || substr(md5('0:' || raw_index), 1, 8) AS BIGINT) / 4294967296.0 - 0.5) * 0.2, 6) AS jitter FROM p""")
def row_priorities(spark, sf):
    k = F.col("raw_index")
    return td.predictions(spark, sf).select("raw_index", scalar.priority(7, k).alias("priority"), F.round(scalar.jitter(k, 0.2), 6).alias("jitter"))


@query(f"""WITH {W}, m AS (SELECT site_id, avg(CASE WHEN cloud_coverage < 5 THEN air_temperature END) AS m FROM w GROUP BY site_id)
SELECT site_id, timestamp, round(coalesce(CASE WHEN cloud_coverage < 5 THEN air_temperature END, m, 0.0) + 1e-9, 6) AS air_temperature FROM w JOIN m USING (site_id)""")
def mean_fill(spark, sf):
    rows = td.weather(spark, sf).withColumn("air_temperature", F.when(F.col("cloud_coverage") < 5, F.col("air_temperature")))
    return scalar.building_mean_fill(rows, ["air_temperature"], "site_id").select("site_id", "timestamp", F.round(F.col("air_temperature") + 1e-9, 6).alias("air_temperature"))


@query(f"""WITH {R}, q AS (SELECT meter, quantile_cont(meter_reading, 0.25) AS lo, quantile_cont(meter_reading, 0.75) AS hi FROM r GROUP BY meter)
SELECT building_id, meter, timestamp, CASE WHEN meter = 'view' THEN CASE WHEN meter_reading <= 50 THEN 'low' ELSE 'high' END WHEN meter_reading <= lo THEN 'low' WHEN meter_reading >= hi THEN 'high' ELSE 'middle' END AS regime FROM r JOIN q USING (meter)""")
def reading_regimes(spark, sf):
    return features.reading_regimes(td.readings(spark, sf), fixed={"view": 50.0}).select("building_id", "meter", "timestamp", "regime")


@query(f"""WITH {LAB}, g AS (SELECT building_id, round(avg(anomaly), 6) AS rate FROM a GROUP BY building_id), k AS (SELECT *, row_number() OVER (ORDER BY rate, building_id) AS i, count(*) OVER () AS n FROM g WHERE rate > 0)
SELECT building_id, rate, ['low', 'mid', 'high'][CAST(least(ceil(i / n * 3), 3) AS INTEGER)] AS bin FROM k UNION ALL SELECT building_id, rate, 'zero' FROM g WHERE rate <= 0""")
def rate_bins(spark, sf):
    rates = td.labelled_readings(spark, sf).groupBy("building_id").agg(F.round(F.avg("anomaly"), 6).alias("rate"))
    return features.rank_bins(rates, "rate", "building_id", ["low", "mid", "high"], zero="zero")


@query("""WITH e AS (SELECT list_sort(list_distinct([quantile_cont(l_tax, 0.0), quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.75), quantile_cont(l_tax, 1.0)])) AS e FROM lineitem),
x AS (SELECT l_tax, len(list_filter(e[2 : len(e) - 1], lambda v: v < l_tax)) AS quartile FROM lineitem, e)
SELECT CAST(quartile AS INTEGER) AS quartile, count(*) AS n, min(l_tax) AS low, max(l_tax) AS high FROM x GROUP BY quartile""")
def quartile_bins(spark, sf):
    return features.quartile_labels(td.table(spark, sf, "lineitem").select("l_tax"), "l_tax").groupBy("quartile").agg(F.count("*").alias("n"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"))


@query(f"""WITH {W}, sp AS (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM w GROUP BY site_id),
h AS (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM sp),
f AS (SELECT h.site_id, h.timestamp, air_temperature AS v, epoch(h.timestamp) AS t, CASE WHEN air_temperature IS NOT NULL THEN epoch(h.timestamp) END AS k FROM h LEFT JOIN w USING (site_id, timestamp)),
g AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(k IGNORE NULLS) OVER b AS ta, first_value(v IGNORE NULLS) OVER c AS b, first_value(k IGNORE NULLS) OVER c AS tb FROM f
  WINDOW b AS (PARTITION BY site_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY site_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT site_id, timestamp, round(coalesce(v, a + (b - a) * (t - ta) / nullif(tb - ta, 0), a) + 1e-9, 4) AS air_temperature FROM g""")
def hourly_weather(spark, sf):
    return features.hourly_fill(td.weather(spark, sf), ["air_temperature"], digits=4)


@query(f"""WITH {R}, s AS (SELECT site_id, avg(meter_reading) AS m, stddev_samp(meter_reading) AS s FROM r GROUP BY site_id)
SELECT building_id, meter, timestamp, round((meter_reading - m) / nullif(s, 0), 6) AS z FROM r JOIN s USING (site_id)""")
def site_z_scores(spark, sf):
    return features.z_scores(td.readings(spark, sf), "meter_reading", "site_id").select("building_id", "meter", "timestamp", "z")


@query(f"""WITH {R}, s AS (SELECT building_id, avg(meter_reading) AS m, stddev_samp(meter_reading) AS s FROM r GROUP BY building_id),
l AS (SELECT r.*, CASE WHEN abs((meter_reading - m) / nullif(s, 0)) <= 10 THEN ln(1 + greatest(meter_reading, 0)) END AS l FROM r JOIN s USING (building_id)), t AS (SELECT building_id, avg(l) AS m, stddev_samp(l) AS s FROM l GROUP BY building_id)
SELECT building_id, meter, timestamp, round((l - m) / nullif(s, 0), 5) AS z FROM l JOIN t USING (building_id)""")
def masked_load_z(spark, sf):
    return features.robust_load_z(td.readings(spark, sf), "meter_reading", "building_id", digits=5).select("building_id", "meter", "timestamp", "z")


@query(f"""WITH {R}, {W.replace("w AS", "wx AS")}, l AS (SELECT r.site_id, timestamp, avg(meter_reading) AS load FROM r GROUP BY 1, 2), g AS (SELECT unnest(range(-12, 13)) AS lag),
j AS (SELECT l.site_id, CAST(lag AS INTEGER) AS lag, air_temperature, load FROM wx JOIN g ON true JOIN l ON l.site_id = wx.site_id AND l.timestamp = wx.timestamp + to_hours(CAST(lag AS INTEGER)))
SELECT site_id, lag, count(*) AS n, CASE WHEN count(*) >= 100 THEN round(corr(air_temperature, load), 5) END AS corr FROM j GROUP BY site_id, lag""")
def lag_correlations(spark, sf):
    load = td.readings(spark, sf).groupBy("site_id", "timestamp").agg(F.avg("meter_reading").alias("load"))
    return features.lag_correlations(td.weather(spark, sf), load, "site_id", "air_temperature", "load", least=100, digits=5)


@query(f"""WITH {R}, h AS (SELECT site_id, hour(timestamp) AS h, round(avg(meter_reading), 6) AS m FROM r GROUP BY 1, 2)
SELECT site_id, CAST(arg_max(h, m) AS INTEGER) AS peak_hour, CAST(arg_min(h, m) AS INTEGER) AS trough_hour, max(m) AS peak_mean FROM h GROUP BY site_id""")
def peak_hours(spark, sf):
    return features.peak_hours(td.readings(spark, sf), ["site_id"], "meter_reading")


@query(f"""WITH {R}, g AS (SELECT site_id, building_id, count(*) AS n FROM r GROUP BY 1, 2)
SELECT site_id, building_id, n, row_number() OVER w AS position, round(n / sum(n) OVER (PARTITION BY site_id), 6) AS share, round(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY site_id), 6) AS cumulative_share
FROM g WINDOW w AS (PARTITION BY site_id ORDER BY n DESC, building_id)""")
def cumulative_shares(spark, sf):
    return features.cumulative_share(td.readings(spark, sf).groupBy("site_id", "building_id").agg(F.count("*").alias("n")), ["site_id"], "building_id", "n")


@query(f"WITH {R} SELECT building_id, meter, timestamp, CASE WHEN site_id = 0 AND meter = 'view' THEN meter_reading * 0.2931 ELSE meter_reading END AS meter_reading FROM r")
def unit_correction(spark, sf):
    code = F.when(F.col("meter") == "view", 0).otherwise(1)
    return td.readings(spark, sf).select("building_id", "meter", "timestamp", scalar.unit_correction(F.col("meter_reading"), F.col("site_id"), code).alias("meter_reading"))
