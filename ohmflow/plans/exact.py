"""Queries of stable priorities, digests, holiday rules, placements, sketches, load profiles and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.functions import holiday_rules, scalar, stable
from ohmflow.operators import digests, loads, placements, sampling, sketches
from ohmflow.plans.registry import query
from ohmflow.sources import publish, sinks
from ohmflow.sources import testdata as td

P, R = td.PREDICTIONS, td.READINGS
MOD = 1 << 64


def _mixed(seed: int, step: bool) -> str:
    """CTE z: p's rows and z, the unsigned priority."""
    start = (seed + (stable.STEP if step else 0)) % MOD
    times = lambda x, c: f"CAST((CAST({x} % 4294967296 AS HUGEINT) * {c} + ((CAST({x} >> 32 AS HUGEINT) * {c}) % 4294967296) * 4294967296) % {MOD} AS UBIGINT)"
    return f"""z0 AS (SELECT *, xor(CAST(raw_index AS UBIGINT), CAST({start} AS UBIGINT)) AS x FROM p), z1 AS (SELECT * REPLACE (xor(x, x >> 30) AS x) FROM z0), z2 AS (SELECT * REPLACE ({times("x", stable.FIRST)} AS x) FROM z1),
z3 AS (SELECT * REPLACE (xor(x, x >> 27) AS x) FROM z2), z4 AS (SELECT * REPLACE ({times("x", stable.SECOND)} AS x) FROM z3), z AS (SELECT * EXCLUDE (x), xor(x, x >> 31) AS z FROM z4)"""


@query(f"WITH {P}, {_mixed(42, True)}, y AS (SELECT raw_index, z FROM z), {_mixed(42, False).replace('z0', 'l0').replace('z1', 'l1').replace('z2', 'l2').replace('z3', 'l3').replace('z4', 'l4').replace(', z AS', ', l AS')} SELECT raw_index, CAST(y.z AS VARCHAR) AS priority, CAST(l.z AS VARCHAR) AS ladder_priority FROM y JOIN l USING (raw_index)")
def stable_row_priorities(spark, sf):
    key = F.col("raw_index")
    return td.predictions(spark, sf).select("raw_index", stable.unsigned_text(stable.stable_priority(42, key)).alias("priority"), stable.unsigned_text(stable.stable_priority(42, key, step=False)).alias("ladder_priority"))


@query(f"WITH {P}, {_mixed(7, True)}, k AS (SELECT *, row_number() OVER (PARTITION BY site_id, y ORDER BY z) AS i FROM z) SELECT site_id, y, raw_index FROM k WHERE i <= 40")
def stable_selection(spark, sf):
    """The forty rows of least unsigned priority of each site and class."""
    return sampling.stable_sample(td.predictions(spark, sf), ["site_id", "y"], "raw_index", 40, 7).select("site_id", "y", "raw_index")


TURNED = " || ".join(f"substr(printf('%016x', raw_index), {i}, 2)" for i in range(15, 0, -2))


@query(f"WITH {P} SELECT site_id, count(*) AS n, sha256(unhex(string_agg({TURNED}, '' ORDER BY raw_index))) AS sha256 FROM p GROUP BY site_id")
def id_digests(spark, sf):
    return digests.id_digest(td.predictions(spark, sf), ["site_id"], "raw_index")


@query(f"""WITH RECURSIVE {P}, k AS (SELECT raw_index, (row_number() OVER (ORDER BY raw_index) - 1) // 1000 AS span FROM p), d AS (SELECT span, count(*) AS n, sha256(unhex(string_agg({TURNED}, '' ORDER BY raw_index))) AS h FROM k GROUP BY span),
t AS (SELECT 0 AS level, span, CAST(n AS HUGEINT) AS n, h, count(*) OVER () AS width FROM d UNION ALL SELECT level, span, n, h, count(*) OVER () FROM (SELECT level + 1 AS level, span // 16 AS span, sum(n) AS n, sha256(unhex(string_agg(h, '' ORDER BY span))) AS h FROM t WHERE level = 0 OR width > 1 GROUP BY ALL))
SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS n, coalesce(max(h), sha256('')) AS sha256 FROM t WHERE level > 0 AND width = 1""")
def id_tree_root(spark, sf):
    """A tree of spans of a thousand ids, sixteen to a node, with levels above the spans until one node is left: one at least."""
    return digests.id_tree(td.predictions(spark, sf), "raw_index", 1000, 16)


@query(f"""WITH {P}, m AS (SELECT min(raw_index) AS m FROM p WHERE site_id = 7), o AS (SELECT raw_index FROM p, m WHERE raw_index <> m),
a AS (SELECT (row_number() OVER (ORDER BY raw_index) - 1) // 1000 AS span, raw_index FROM p), b AS (SELECT (row_number() OVER (ORDER BY raw_index) - 1) // 1000 AS span, raw_index FROM o),
x AS (SELECT span, min(raw_index) AS first_a, max(raw_index) AS last_a, list(raw_index ORDER BY raw_index) AS l FROM a GROUP BY span), y AS (SELECT span, min(raw_index) AS first_b, max(raw_index) AS last_b, list(raw_index ORDER BY raw_index) AS l FROM b GROUP BY span)
SELECT span, first_a, last_a, first_b, last_b FROM x FULL JOIN y USING (span) WHERE x.l IS DISTINCT FROM y.l""")
def differing_id_spans(spark, sf):
    """Where the ids differ from those without one."""
    rows = td.predictions(spark, sf)
    one = rows.filter("site_id = 7").agg(F.min("raw_index").alias("m"))
    return digests.differing_spans(rows, rows.join(F.broadcast(one), F.col("raw_index") == F.col("m"), "left_anti"), "raw_index", 1000)


#: Published holidays of 2024 (government lists), by country.
PUBLISHED_2024 = {
    "US": ["01-01", "01-15", "02-19", "05-27", "06-19", "07-04", "09-02", "10-14", "11-11", "11-28", "12-25"],
    "GB": ["01-01", "03-29", "04-01", "05-06", "05-27", "08-26", "12-25", "12-26"],
    "IE": ["01-01", "02-05", "03-17", "03-18", "04-01", "05-06", "06-03", "08-05", "10-28", "12-25", "12-26"],
}
_LISTED = ", ".join(f"('{c}', DATE '2024-{d}')" for c, days in PUBLISHED_2024.items() for d in days)


@query(f"""WITH {R}, z AS (SELECT *, CASE building_id % 4 WHEN 0 THEN 'US/Pacific' WHEN 1 THEN 'Europe/Dublin' WHEN 2 THEN 'Europe/London' ELSE 'US/Eastern' END AS timezone FROM r), h(country, date) AS (VALUES {_LISTED})
SELECT timezone, CAST(timestamp AS DATE) AS day, count(*) AS rows, count(h.country) AS holiday_rows FROM z LEFT JOIN h ON h.date = CAST(timestamp AS DATE) AND h.country = CASE timezone WHEN 'Europe/Dublin' THEN 'IE' WHEN 'Europe/London' THEN 'GB' ELSE 'US' END GROUP BY ALL""")
def ruled_holidays(spark, sf):
    """Readings on holidays that rules give; the SQL has the published days of the events' year."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ("US/Pacific", "Europe/Dublin", "Europe/London", "US/Eastern")]), (F.col("building_id") % 4 + 1).cast("int"))
    rows = td.readings(spark, sf).withColumn("timezone", zone)
    years = rows.agg(F.min(F.year("timestamp")).alias("a"), F.max(F.year("timestamp")).alias("b")).first()
    flagged = scalar.holidays(rows, holiday_rules.holiday_table(spark, years["a"] or 2024, years["b"] or 2024))
    return flagged.groupBy("timezone", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("rows"), F.count_if("is_holiday").alias("holiday_rows"))


def _placed(score: str) -> str:
    return f"""c{score} AS (SELECT score_{score} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1), v{score} AS (SELECT s, (coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) / sum(neg) OVER () AS p1,
(coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pos / 2.0) / sum(pos) OVER () AS p0 FROM c{score})"""


@query(f"""WITH {P}, {_placed('a')}, {_placed('b')}, m AS (SELECT p.y, CASE p.y WHEN 1 THEN va.p1 ELSE va.p0 END AS a, CASE p.y WHEN 1 THEN vb.p1 ELSE vb.p0 END AS b FROM p JOIN va ON va.s = score_a JOIN vb ON vb.s = score_b),
s AS (SELECT y, count(*) AS m, avg(a) AS ma, avg(b) AS mb, var_samp(a) / count(*) AS aa, var_samp(b) / count(*) AS bb, covar_samp(a, b) / count(*) AS ab FROM m GROUP BY y),
t AS (SELECT max(m) FILTER (y = 1) AS n_pos, max(m) FILTER (y = 0) AS n_neg, max(ma) FILTER (y = 1) AS auc_a, max(mb) FILTER (y = 1) AS auc_b, sqrt(sum(aa)) AS se_a, sqrt(sum(bb)) AS se_b, sqrt(sum(aa) + sum(bb) - 2 * sum(ab)) AS se FROM s)
SELECT n_pos, n_neg, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta, round(se_a, 6) AS se_a, round(se_b, 6) AS se_b, round(se, 6) AS se_delta, round(auc_a - auc_b - {placements.Z_95} * se, 6) AS low, round(auc_a - auc_b + {placements.Z_95} * se, 6) AS high FROM t""")
def paired_area_errors(spark, sf):
    return placements.paired_areas(td.predictions(spark, sf), "score_a", "score_b")


@query(f"""WITH {R} SELECT site_id, point, true AS within FROM (SELECT DISTINCT site_id FROM r), (SELECT unnest([0.05, 0.5, 0.95]) AS point)""")
def pooled_quantile_errors(spark, sf):
    """Quantiles of a site from stored sketches of its days: whether each keeps to the stated rank error."""
    rows, points = td.readings(spark, sf), [0.05, 0.5, 0.95]
    parts = sinks.stored(sketches.quantile_partials(rows.withColumn("day", F.to_date("timestamp")), ["site_id", "day"], "meter_reading"), "sketches")
    errors = sketches.rank_errors(rows, sketches.pool_quantiles(parts, ["site_id"], points), ["site_id"], "meter_reading", points)
    return errors.select("site_id", "point", (F.col("error") <= sketches.RANK_ERROR).alias("within"))


@query(f"WITH {P} SELECT raw_index, CASE WHEN meter = 'O' THEN score_b ELSE score_a END AS score, meter FROM p")
def republished_parts(spark, sf):
    """A table published by meter, of which one meter is done again."""
    root, rows = sinks.scratch_folder(spark, "published"), td.predictions(spark, sf)
    publish.publish(rows.select("raw_index", F.col("score_a").alias("score"), "meter"), root, "first", "meter")
    publish.publish(rows.filter("meter = 'O'").select("raw_index", F.col("score_b").alias("score"), "meter"), root, "again", "meter")
    return publish.read(spark, root)


@query(f"""WITH {R}, a AS (SELECT *, round((meter_reading - avg(meter_reading) OVER w) / nullif(stddev_samp(meter_reading) OVER w, 0), 9) AS f FROM r WINDOW w AS (PARTITION BY building_id)),
b AS (SELECT building_id, timestamp, CASE WHEN abs(f) <= 10 THEN ln(1 + greatest(meter_reading, 0)) END AS l FROM a), c AS (SELECT *, round((l - avg(l) OVER w) / nullif(stddev_samp(l) OVER w, 0), 6) AS z FROM b WINDOW w AS (PARTITION BY building_id)),
d AS (SELECT building_id, CAST((CAST(epoch(timestamp) AS BIGINT) // 3600 + 72) % 168 AS INTEGER) AS hour, round(avg(z) + 1e-9, 6) AS z FROM c WHERE z IS NOT NULL GROUP BY 1, 2), n AS (SELECT building_id, count(*) AS n_hours FROM d GROUP BY 1)
SELECT n.building_id, CAST(h.hour AS INTEGER) AS hour, coalesce(d.z, 0.0) AS z, n_hours FROM n CROSS JOIN (SELECT unnest(range(0, 168)) AS hour) h LEFT JOIN d ON d.building_id = n.building_id AND d.hour = h.hour""")
def load_profiles(spark, sf):
    return loads.load_vectors(td.readings(spark, sf)).select("building_id", F.posexplode("hours").alias("hour", "z"), F.col("n_hours").cast("long").alias("n_hours"))


@query()
def load_profile_groups(spark, sf):
    """Buildings grouped by the shape of their week: ten groups, the best of ten starts, with the stability of the choice."""
    found, quality = loads.load_groups(loads.load_vectors(td.readings(spark, sf)))
    return found.groupBy("cluster").agg(F.count("*").alias("buildings")).withColumn("stability", F.lit(quality["stability"])).withColumn("silhouette", F.lit(quality["silhouette"]).cast("double"))
