"""Queries of score evaluation, segments and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.operators import features, metrics, models, resample, segments
from ohmflow.plans.registry import query
from ohmflow.sources import testdata as td

P, LAB = td.PREDICTIONS, td.LABELLED
KEYS = ["building_id", "meter"]


def preds(spark, sf):
    return td.predictions(spark, sf).withColumn("score", F.col("score_a"))


def curve_sql(groups: str, source: str = "p", score: str = "score_a") -> str:
    """CTE v: cumulative counts at each distinct score."""
    part = f"PARTITION BY {groups}" if groups else ""
    lead = f"{groups}, " if groups else ""
    return f"""c AS (SELECT {lead}{score} AS score, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY ALL),
v AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg FROM c WINDOW w AS ({part} ORDER BY score DESC))"""


AREAS = """CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg, round(sum(pos * (n_neg - fp + neg / 2.0)) / nullif(max(n_pos) * max(n_neg), 0), 6) AS roc_auc,
round(CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(pos * tp / (tp + fp)) / max(n_pos) END, 6) AS pr_auc"""


@query(f"WITH {P}, {curve_sql('')} SELECT {AREAS} FROM v")
def pooled_areas(spark, sf):
    return metrics.roc_pr(preds(spark, sf), [])


@query(f"WITH {P}, {curve_sql('building_id, meter')} SELECT building_id, meter, {AREAS} FROM v GROUP BY building_id, meter")
def areas_by_series(spark, sf):
    return metrics.roc_pr(preds(spark, sf), KEYS)


@query(f"""WITH {P}, l AS (SELECT 'meter' AS "grouping", meter AS group_value, score_a, y FROM p UNION ALL SELECT 'site_id', CAST(site_id AS VARCHAR), score_a, y FROM p UNION ALL SELECT 'building_id', CAST(building_id AS VARCHAR), score_a, y FROM p),
{curve_sql('"grouping", group_value', 'l')} SELECT "grouping", group_value, {AREAS} FROM v GROUP BY ALL""")
def areas_by_several_groups(spark, sf):
    return metrics.grouped_metrics(preds(spark, sf), ["meter", "site_id", "building_id"])


@query(f"""WITH {P}, l AS (SELECT 'score_a' AS model, meter, score_a, y FROM p UNION ALL SELECT 'score_b', meter, score_b, y FROM p), {curve_sql('model, meter', 'l')} SELECT model, meter, {AREAS} FROM v GROUP BY ALL""")
def areas_by_model(spark, sf):
    return metrics.score_columns_metrics(preds(spark, sf), ["score_a", "score_b"], ["meter"])


@query(f"""WITH {P}, n AS (SELECT meter, count(*) FILTER (score_a >= 0.5 AND y = 1) AS tp, count(*) FILTER (score_a >= 0.5 AND y = 0) AS fp, count(*) FILTER (score_a < 0.5 AND y = 1) AS fn, count(*) FILTER (score_a < 0.5 AND y = 0) AS tn FROM p GROUP BY meter)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 6), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0.0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM n""")
def confusion_by_meter(spark, sf):
    return metrics.confusion(preds(spark, sf), ["meter"])


@query(f"WITH {P}, {curve_sql('site_id')} SELECT site_id, coalesce(max(CASE WHEN n_pos > 0 AND tp >= ceil(n_pos * 0.9) THEN score END), 1.0) AS threshold FROM v GROUP BY site_id")
def recall_thresholds(spark, sf):
    return metrics.recall_threshold(preds(spark, sf), ["site_id"], 0.9)


@query(f"""WITH {P}, {curve_sql('site_id')}, f AS (SELECT site_id, score, round(2.0 * tp / (tp + fp + n_pos), 6) AS f1 FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY f1 DESC, score DESC) AS i FROM f)
SELECT site_id, score AS threshold, f1 FROM k WHERE i = 1""")
def best_f1_thresholds(spark, sf):
    return metrics.best_f1_threshold(preds(spark, sf), ["site_id"])


@query(f"""WITH {P}, {curve_sql('meter')}, n AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY score DESC) - 1 AS i, count(*) OVER (PARTITION BY meter) AS n FROM v),
g AS (SELECT DISTINCT meter, CAST(floor(k * (n - 1) / 4) AS BIGINT) AS i FROM (SELECT DISTINCT meter, n FROM n), (SELECT unnest(range(0, 5)) AS k) WHERE n > 5)
SELECT meter, i AS point, score, round(fp / nullif(n_neg, 0), 6) AS fpr, round(tp / nullif(n_pos, 0), 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM n WHERE n <= 5 OR (meter, i) IN (SELECT meter, i FROM g)""")
def curve_points(spark, sf):
    return metrics.curve_points(preds(spark, sf), ["meter"], 5).withColumn("point", F.col("point").cast("long"))


PAIRS = f"""{P}, c AS (SELECT site_id AS g, score_a AS s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1, 2),
x AS (SELECT a.g AS pos_group, b.g AS neg_group, sum(a.pos * b.neg) AS n_pairs, sum(a.pos * b.neg * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS won FROM c a, c b GROUP BY 1, 2 HAVING sum(a.pos * b.neg) > 0),
k AS (SELECT pos_group, neg_group, CAST(n_pairs AS BIGINT) AS n_pairs, round(won / n_pairs, 6) AS auc, CASE WHEN pos_group = neg_group THEN 'within' ELSE 'cross' END AS relation FROM x)"""


@query(f"WITH {PAIRS} SELECT * FROM k")
def pairwise_areas(spark, sf):
    return metrics.pairwise_auc(preds(spark, sf), "site_id")


@query(f"""WITH {PAIRS} SELECT relation, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, round(sum(n_pairs) / max(t), 6) AS share, round(sum(auc * n_pairs) / sum(n_pairs), 6) AS auc, round(sum(auc * n_pairs) / max(t), 6) AS contribution
FROM k, (SELECT sum(n_pairs) AS t FROM k) GROUP BY relation""")
def area_decomposition(spark, sf):
    return metrics.auc_decomposition(metrics.pairwise_auc(preds(spark, sf), "site_id"))


RANKS = f"""{P}, k AS (SELECT *, (rank() OVER (PARTITION BY meter ORDER BY score_a) + (count(*) OVER (PARTITION BY meter, score_a) - 1) / 2.0) / count(*) OVER (PARTITION BY meter) AS ra,
(rank() OVER (PARTITION BY meter ORDER BY score_b) + (count(*) OVER (PARTITION BY meter, score_b) - 1) / 2.0) / count(*) OVER (PARTITION BY meter) AS rb FROM p)"""


@query(f"WITH {RANKS} SELECT raw_index, meter, round(ra, 6) AS percentile FROM k")
def score_percentiles(spark, sf):
    return metrics.average_ranks(preds(spark, sf), ["meter"], "score").select("raw_index", "meter", F.round("percentile", 6).alias("percentile"))


@query(f"WITH {RANKS} SELECT meter, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY meter")
def rank_agreement(spark, sf):
    return metrics.spearman(preds(spark, sf), ["meter"], "score_a", "score_b")


@query(f"""WITH {P}, g AS (SELECT meter, avg(score_a) FILTER (y = 1) AS mp, avg(score_a) FILTER (y = 0) AS mn, quantile_cont(score_a, 0.5) FILTER (y = 1) AS dp, quantile_cont(score_a, 0.5) FILTER (y = 0) AS dn FROM p GROUP BY meter)
SELECT meter, round(mp, 6) AS mean_pos, round(mn, 6) AS mean_neg, round(dp, 6) AS median_pos, round(dn, 6) AS median_neg, round(mp - mn, 6) AS separation FROM g""")
def class_separation(spark, sf):
    return metrics.class_means(preds(spark, sf), ["meter"])


@query(f"""WITH {P} SELECT meter, y, count(score_a) AS n, round(avg(score_a), 6) AS mean, round(quantile_cont(score_a, 0.1), 6) AS q10, round(quantile_cont(score_a, 0.5), 6) AS q50, round(quantile_cont(score_a, 0.9), 6) AS q90 FROM p GROUP BY meter, y""")
def score_distributions(spark, sf):
    return metrics.distributions(preds(spark, sf), ["meter", "y"])


@query(f"""WITH {P}, d AS (SELECT *, score_b - score_a AS d FROM p) SELECT meter, site_id, y, count(d) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.1), 6) AS q10, round(quantile_cont(d, 0.9), 6) AS q90,
round(avg(abs(d)), 6) AS mean_abs, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_up FROM d GROUP BY meter, site_id, y""")
def score_contrasts(spark, sf):
    return metrics.contrasts(preds(spark, sf), ["meter", "site_id", "y"], "score_a", "score_b")


@query(f"""WITH {P}, t AS (SELECT meter, rate, quantile_cont(score_a, 1 - rate) AS th FROM p, (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS rate) WHERE y = 0 GROUP BY meter, rate)
SELECT meter, rate, round(th, 6) AS threshold, round(count(*) FILTER (y = 0 AND score_a >= th) / nullif(count(*) FILTER (y = 0), 0), 6) AS fpr, round(count(*) FILTER (y = 1 AND score_a >= th) / nullif(count(*) FILTER (y = 1), 0), 6) AS tpr
FROM p JOIN t USING (meter) GROUP BY meter, rate, th""".replace("quantile_cont(score_a, 1 - rate)", "CASE rate WHEN 0.01 THEN quantile_cont(score_a, 0.99) WHEN 0.05 THEN quantile_cont(score_a, 0.95) ELSE quantile_cont(score_a, 0.9) END"))
def operating_points(spark, sf):
    return metrics.operating_points(preds(spark, sf), ["meter"], "fpr", [0.01, 0.05, 0.1])


@query(f"WITH {P} SELECT meter, count(*) AS n, count(*) FILTER (score_a < 0.5 AND score_b >= 0.5) AS upward, count(*) FILTER (score_a >= 0.5 AND score_b < 0.5) AS downward FROM p GROUP BY meter")
def threshold_crossings(spark, sf):
    return metrics.crossings(preds(spark, sf), ["meter"], "score_a", "score_b", 0.5)


@query("""WITH g AS (SELECT l_linestatus AS meter, l_linenumber AS k, round(avg(l_tax), 9) AS gap FROM lineitem GROUP BY 1, 2) SELECT meter, round(regr_slope(gap, log10(k)), 6) AS slope FROM g GROUP BY meter""")
def context_slopes(spark, sf):
    cells = td.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("meter"), F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_tax"), 9).alias("gap"))
    return metrics.log_slope(cells, ["meter"], "k", "gap")


@query("""WITH g AS (SELECT l_linestatus AS meter, l_linenumber AS k, round(avg(l_tax), 9) AS gap FROM lineitem GROUP BY 1, 2) SELECT meter, k, gap, round(gap - lag(gap) OVER (PARTITION BY meter ORDER BY k), 6) AS step FROM g""")
def context_steps(spark, sf):
    cells = td.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("meter"), F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_tax"), 9).alias("gap"))
    return features.step_deltas(cells, ["meter"], "k", "gap")


@query(f"WITH {P} SELECT meter, count(*) AS n, round(avg(abs(score_a - score_b)), 6) AS mae, round(max(abs(score_a - score_b)), 6) AS max_abs, count(*) FILTER (score_a <> score_b) AS changed FROM p GROUP BY meter")
def run_deltas(spark, sf):
    return metrics.run_deltas(preds(spark, sf), ["meter"], "score_a", "score_b")


@query(f"""WITH {P}, n AS (SELECT ceil(count(*) * 0.1) AS n FROM p), a AS (SELECT raw_index FROM (SELECT raw_index, row_number() OVER (ORDER BY score_a DESC, raw_index) AS i FROM p), n WHERE i <= n),
b AS (SELECT raw_index FROM (SELECT raw_index, row_number() OVER (ORDER BY score_b DESC, raw_index) AS i FROM p), n WHERE i <= n)
SELECT CAST(max(n) AS BIGINT) AS n_top, count(a.raw_index) AS n_both FROM n LEFT JOIN (SELECT * FROM a WHERE raw_index IN (SELECT raw_index FROM b)) a ON true""")
def top_decile_overlap(spark, sf):
    return metrics.top_overlap(preds(spark, sf), "score_a", "score_b", "raw_index")


@query(f"""WITH {P}, c AS (SELECT score_a AS s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1), m AS (SELECT round(a.s - b.s, 9) AS m, sum(a.pos * b.neg) AS n FROM c a, c b WHERE a.pos > 0 AND b.neg > 0 GROUP BY 1),
o AS (SELECT m, n, sum(n) OVER (ORDER BY m) AS upto, sum(n) OVER () AS total FROM m),
q AS (SELECT f, min(m) FILTER (upto > floor(f * (total - 1))) AS lo, min(m) FILTER (upto > floor(f * (total - 1)) + 1) AS hi, max(f * (total - 1) - floor(f * (total - 1))) AS w FROM o, (SELECT unnest([0.25, 0.75]::DOUBLE[]) AS f) GROUP BY f),
v AS (SELECT f, CASE WHEN w > 0 THEN lo + (hi - lo) * w ELSE lo END AS v FROM q)
SELECT round(max(v) FILTER (f = 0.25), 6) AS q25, round(max(v) FILTER (f = 0.75), 6) AS q75, round(max(v) FILTER (f = 0.75) - max(v) FILTER (f = 0.25), 6) AS iqr FROM v""")
def margin_quartiles(spark, sf):
    return metrics.margin_quartiles(preds(spark, sf))


@query(f"WITH {P} SELECT site_id, y, CAST(greatest(0, least(floor(score_a * 100), 99)) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY ALL")
def score_histogram(spark, sf):
    return metrics.histogram(preds(spark, sf), ["site_id"])


GAPS = f"""{P}, l AS (SELECT 'score_a' AS model, meter, site_id, score_a, y FROM p UNION ALL SELECT 'score_b', meter, site_id, score_b, y FROM p), {curve_sql('model, meter, site_id', 'l')}, m AS (SELECT model, meter, site_id, {AREAS} FROM v GROUP BY ALL)"""


def _cells(spark, sf):
    return metrics.score_columns_metrics(preds(spark, sf), ["score_a", "score_b"], ["meter", "site_id"])


@query(f"""WITH {GAPS}, g AS (SELECT meter, site_id, max(roc_auc) FILTER (model = 'score_a') AS left_value, max(roc_auc) FILTER (model = 'score_b') AS right_value FROM m GROUP BY 1, 2)
SELECT *, round(left_value - right_value, 6) AS gap FROM g WHERE left_value IS NOT NULL AND right_value IS NOT NULL""")
def learner_gaps(spark, sf):
    return metrics.learner_gaps(_cells(spark, sf), ["meter", "site_id"], "model", "score_a", "score_b", "roc_auc")


@query(f"WITH {GAPS} SELECT model, meter, count(roc_auc) AS runs, round(avg(roc_auc), 6) AS mean, round(stddev_pop(roc_auc), 6) AS std_pop, round(stddev_samp(roc_auc), 6) AS std_samp, round(min(roc_auc), 6) AS low, round(max(roc_auc), 6) AS high FROM m GROUP BY 1, 2")
def seed_summaries(spark, sf):
    return metrics.seed_summary(_cells(spark, sf), ["model", "meter"], "roc_auc")


@query(f"WITH {GAPS} SELECT model, meter, site_id, roc_auc, rank() OVER (PARTITION BY meter, site_id ORDER BY roc_auc DESC NULLS LAST) AS position FROM m")
def model_ranking(spark, sf):
    return metrics.rank_models(_cells(spark, sf), ["meter", "site_id"], "roc_auc").select("model", "meter", "site_id", "roc_auc", "position")


_T = ", ".join(str(x) for x in resample.T_95)


@query(f"""WITH {GAPS}, s AS (SELECT model, meter, count(roc_auc) AS n, avg(roc_auc) AS m, stddev_samp(roc_auc) AS sd FROM m GROUP BY 1, 2), h AS (SELECT *, CASE WHEN n > 1 THEN sd / sqrt(n) * ([{_T}])[greatest(1, least(n - 1, {len(resample.T_95)}))] END AS w FROM s)
SELECT model, meter, n, round(m, 6) AS mean, round(w, 6) AS half_width, coalesce(w <= 0.01, false) AS precise FROM h""")
def precision_gate(spark, sf):
    return resample.half_width(_cells(spark, sf), ["model", "meter"], "roc_auc", 0.01)


@query("""WITH c AS (SELECT l_linestatus AS meter, l_linenumber % 2 AS a, l_suppkey % 2 AS b, avg(l_tax) AS v FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT meter, max(v) FILTER (a = 0 AND b = 0) AS c00, max(v) FILTER (a = 0 AND b = 1) AS c01, max(v) FILTER (a = 1 AND b = 0) AS c10, max(v) FILTER (a = 1 AND b = 1) AS c11 FROM c GROUP BY meter)
SELECT meter, round((c10 + c11 - c00 - c01) / 2, 6) AS main_a, round((c01 + c11 - c00 - c10) / 2, 6) AS main_b, round(c11 - c10 - c01 + c00, 6) AS interaction FROM p""")
def factorial_effects(spark, sf):
    cells = td.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("meter"), (F.col("l_linenumber") % 2).alias("a"), (F.col("l_suppkey") % 2).alias("b")).agg(F.avg("l_tax").alias("v"))
    return resample.factorial(cells, ["meter"], "a", "b", "v")


DRAWS = """n AS (SELECT building_id, row_number() OVER (ORDER BY building_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT building_id FROM p)),
d AS (SELECT draw, CAST(floor(CAST('0x' || substr(md5('0:' || draw || ':' || slot), 1, 8) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS i FROM (SELECT unnest(range(0, 20)) AS draw), (SELECT i AS slot, n FROM n)),
w AS (SELECT draw, building_id, count(*) AS weight FROM d JOIN n USING (i) GROUP BY 1, 2)"""


@query(f"""WITH {P}, {DRAWS}, l AS (SELECT draw, meter, score_a AS score, sum(y * weight) AS pos, sum((1 - y) * weight) AS neg FROM p JOIN w USING (building_id) GROUP BY ALL),
v AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg FROM l WINDOW w AS (PARTITION BY draw, meter ORDER BY score DESC), g AS (PARTITION BY draw, meter))
SELECT draw, meter, {AREAS} FROM v GROUP BY draw, meter""")
def cluster_bootstrap(spark, sf):
    return resample.cluster_bootstrap(preds(spark, sf), "building_id", ["meter"], 20)


@query(f"""WITH {P}, {DRAWS}, m AS (SELECT building_id, avg(score_b - score_a) AS m FROM p GROUP BY 1), b AS (SELECT draw, round(sum(m * weight) / sum(weight), 9) AS mean FROM m JOIN w USING (building_id) GROUP BY draw)
SELECT count(*) AS draws, count(*) FILTER (mean IS NULL) AS invalid, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high,
round(avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS excludes_zero FROM b""")
def movement_interval(spark, sf):
    moved = preds(spark, sf).withColumn("d", F.col("score_b") - F.col("score_a"))
    return resample.intervals(resample.mean_bootstrap(moved, "building_id", "d", 20), [], "mean")


@query(f"""WITH {P}, m AS (SELECT building_id, avg(score_b - score_a) AS m FROM p GROUP BY 1), t AS (SELECT sum(m) AS s, count(*) AS n FROM m)
SELECT building_id, round(m, 6) AS mean, round((s - m) / nullif(n - 1, 0), 6) AS without, round((s - m) / nullif(n - 1, 0) - s / n, 6) AS influence FROM m, t""")
def building_influence(spark, sf):
    return resample.leave_one_mean(preds(spark, sf).withColumn("d", F.col("score_b") - F.col("score_a")), "building_id", "d")


@query(f"""WITH {P}, s AS (SELECT DISTINCT site_id AS s FROM p), c AS (SELECT s, score_a AS score, sum(y) AS pos, sum(1 - y) AS neg FROM p, s WHERE site_id <> s GROUP BY 1, 2),
v AS (SELECT *, sum(neg) OVER (PARTITION BY s ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY s) AS n_pos, sum(neg) OVER (PARTITION BY s) AS n_neg FROM c)
SELECT s AS site_id, round(sum(pos * (n_neg - fp + neg / 2.0)) / nullif(max(n_pos) * max(n_neg), 0), 6) AS without FROM v GROUP BY s""")
def area_without_site(spark, sf):
    return resample.leave_one_auc(preds(spark, sf), "site_id")


_CUM = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


@query(f"""WITH {P}, d AS (SELECT draw, y, score_a, score_b, CAST('0x' || substr(md5('0:' || draw || ':' || raw_index), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p, (SELECT unnest(range(0, 5)) AS draw)),
w AS (SELECT *, CASE {" ".join(f"WHEN u < {c} THEN {k}" for k, c in enumerate(_CUM))} ELSE 6 END AS w FROM d),
l AS (SELECT draw, 'a' AS model, score_a AS score, y, w FROM w WHERE w > 0 UNION ALL SELECT draw, 'b', score_b, y, w FROM w WHERE w > 0), c AS (SELECT draw, model, score, sum(y * w) AS pos, sum((1 - y) * w) AS neg FROM l GROUP BY ALL),
v AS (SELECT *, sum(neg) OVER (PARTITION BY draw, model ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY draw, model) AS n_pos, sum(neg) OVER (PARTITION BY draw, model) AS n_neg FROM c),
a AS (SELECT draw, model, round(sum(pos * (n_neg - fp + neg / 2.0)) / nullif(max(n_pos) * max(n_neg), 0), 6) AS auc FROM v GROUP BY 1, 2)
SELECT CAST(draw AS INTEGER) AS draw, max(auc) FILTER (model = 'a') AS auc_a, max(auc) FILTER (model = 'b') AS auc_b, round(max(auc) FILTER (model = 'a') - max(auc) FILTER (model = 'b'), 6) AS delta FROM a GROUP BY draw""")
def paired_row_bootstrap(spark, sf):
    return resample.paired_row_bootstrap(preds(spark, sf), "raw_index", "score_a", "score_b", 5)


@query(f"""WITH {P}, r AS (SELECT unnest(range(0, 3)) AS repeat), o AS (SELECT repeat, meter, raw_index, y, row_number() OVER (PARTITION BY repeat, meter ORDER BY raw_index) AS i FROM p, r),
h AS (SELECT repeat, meter, score_a, row_number() OVER (PARTITION BY repeat, meter ORDER BY md5('0:' || repeat || ':' || raw_index), raw_index) AS i FROM p, r), l AS (SELECT o.repeat, o.meter, y, h.score_a FROM o JOIN h USING (repeat, meter, i)), {curve_sql('repeat, meter', 'l')}
SELECT CAST(repeat AS INTEGER) AS repeat, meter, {AREAS} FROM v GROUP BY repeat, meter""")
def permuted_scores(spark, sf):
    return metrics.roc_pr(resample.permuted(preds(spark, sf).select("raw_index", "meter", "y", "score"), "score", "raw_index", 3, ["meter"]), ["repeat", "meter"])


@query("""WITH i AS (SELECT l_shipmode AS feature, l_linestatus AS model, round(sum(l_tax), 6) AS importance FROM (SELECT l_linenumber AS l_shipmode, l_linestatus, l_tax FROM lineitem) GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY importance DESC) AS r FROM i)
SELECT feature, count(*) FILTER (r <= 3) AS votes, round(avg(r), 6) AS mean_rank FROM r GROUP BY feature""")
def consensus_importance(spark, sf):
    table = td.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("feature"), F.col("l_linestatus").alias("model")).agg(F.round(F.sum("l_tax"), 6).alias("importance"))
    return resample.consensus(table, top=3)


# --- segments --------------------------------------------------------------------------------------------------------

SEG = f"""{LAB}, x AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM a WHERE anomaly = 1 WINDOW w AS (PARTITION BY building_id, meter ORDER BY timestamp)),
i AS (SELECT *, sum(b) OVER (PARTITION BY building_id, meter ORDER BY timestamp) AS island FROM x),
s AS (SELECT building_id, meter, CAST(island AS BIGINT) AS island, min(timestamp) AS start, max(timestamp) AS "end", count(*) AS duration_rows, round(avg(meter_reading), 6) AS mean, min(meter_reading) AS low, max(meter_reading) AS high,
  round((arg_max(meter_reading, timestamp) - arg_min(meter_reading, timestamp)) / nullif(count(*) - 1, 0), 6) AS slope FROM i GROUP BY 1, 2, 3)"""


@query(f"WITH {SEG} SELECT * FROM s")
def anomaly_segments(spark, sf):
    return segments.segments(td.labelled_readings(spark, sf))


@query(f"""WITH {SEG}, k AS (SELECT *, coalesce((row_number() OVER (PARTITION BY building_id, meter, island ORDER BY timestamp) - 1) / nullif(count(*) OVER (PARTITION BY building_id, meter, island) - 1, 0), 0) AS part FROM i)
SELECT building_id, meter, timestamp, CAST(island AS BIGINT) AS island, CASE WHEN part <= 0.25 THEN 'onset' WHEN part >= 0.75 THEN 'recovery' ELSE 'middle' END AS phase FROM k""")
def segment_phases(spark, sf):
    return segments.phases(td.labelled_readings(spark, sf)).select("building_id", "meter", "timestamp", "island", "phase")


RUNS = f"""{LAB}, n AS (SELECT *, row_number() OVER (PARTITION BY building_id, meter ORDER BY timestamp) AS i FROM a), l AS (SELECT building_id, meter, i - row_number() OVER (PARTITION BY building_id, meter ORDER BY timestamp) AS run FROM n WHERE anomaly = 1),
g AS (SELECT building_id, meter, run, count(*) AS length FROM l GROUP BY 1, 2, 3)"""


@query(f"""WITH {RUNS} SELECT meter, count(*) AS runs, CAST(sum(length) AS BIGINT) AS rows, round(avg(CASE WHEN length = 1 THEN 1.0 ELSE 0.0 END), 6) AS singleton_share, round(avg(length), 6) AS mean, round(quantile_cont(length, 0.9), 6) AS p90, round(quantile_cont(length, 0.99), 6) AS p99,
round(sum(CASE WHEN length >= 2 THEN length ELSE 0 END) / sum(length), 6) AS long_share FROM g GROUP BY meter""")
def positive_runs(spark, sf):
    return segments.run_summary(segments.run_lengths(td.labelled_readings(spark, sf)), ["meter"], long_run=2)


@query(f"""WITH {SEG} SELECT a.building_id, a.meter, a.timestamp, min(island) AS segment FROM a LEFT JOIN s ON s.building_id = a.building_id AND s.meter = a.meter AND a.timestamp BETWEEN s.start AND s."end" GROUP BY 1, 2, 3""")
def rows_in_segments(spark, sf):
    rows = td.labelled_readings(spark, sf)
    return segments.attach(rows.select("building_id", "meter", "timestamp"), segments.segments(rows))


@query(f"""WITH {LAB}, k AS (SELECT *, max(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS b FROM a),
o AS (SELECT building_id, meter, timestamp AS t0 FROM k WHERE anomaly = 1 AND b IS NOT NULL ORDER BY round(abs(ln((meter_reading + 1) / (b + 1))), 9) DESC, building_id, meter, timestamp LIMIT 1)
SELECT a.building_id, a.meter, timestamp, meter_reading, anomaly, CAST(epoch(timestamp - t0) / 3600 AS INTEGER) AS offset_hours FROM a JOIN o ON a.building_id = o.building_id AND a.meter = o.meter AND abs(epoch(timestamp - t0)) <= 86400""")
def anchor_window(spark, sf):
    return segments.anchor_window(td.labelled_readings(spark, sf), 24).drop("site_id")


@query(f"""WITH {P}, v AS (SELECT building_id, raw_index, abs(score_b - score_a) AS v FROM p), t AS (SELECT sum(v) AS t FROM v), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, raw_index) AS i FROM v),
k AS (SELECT k, building_id, sum(v) AS v, count(*) AS n FROM o JOIN (SELECT unnest([1, 5, 10]) AS k) ON i <= k GROUP BY 1, 2)
SELECT k, round(sum(v) / max(t), 6) AS share, round(max(n) / sum(n), 6) AS top_owner_share FROM k, t GROUP BY k""")
def movement_concentration(spark, sf):
    moved = preds(spark, sf).withColumn("d", F.col("score_b") - F.col("score_a"))
    return segments.concentration(moved, "d", "building_id", "raw_index")


@query(f"""WITH {P}, u AS (SELECT *, building_id || '|' || meter AS unit FROM p),
f AS (SELECT unit, quantile_cont(reading, 0.5) AS cut FROM u WHERE site_id % 2 = 0 GROUP BY unit HAVING sum(y) BETWEEN 1 AND count(*) - 1), m AS (SELECT meter, quantile_cont(reading, 0.5) AS cut FROM u WHERE site_id % 2 = 0 GROUP BY meter HAVING sum(y) BETWEEN 1 AND count(*) - 1),
ft AS (SELECT unit, cut, avg(y) FILTER (reading > cut) AS above, avg(y) FILTER (reading <= cut) AS below FROM u JOIN f USING (unit) WHERE site_id % 2 = 0 GROUP BY 1, 2),
mt AS (SELECT meter, cut, avg(y) FILTER (reading > cut) AS above, avg(y) FILTER (reading <= cut) AS below FROM u JOIN m USING (meter) WHERE site_id % 2 = 0 GROUP BY 1, 2)
SELECT raw_index, round(coalesce(CASE WHEN ft.cut IS NULL THEN NULL WHEN reading > ft.cut THEN ft.above ELSE ft.below END, CASE WHEN reading > mt.cut THEN mt.above ELSE mt.below END), 6) AS score,
CASE WHEN ft.cut IS NOT NULL THEN 'unit' WHEN mt.cut IS NOT NULL THEN 'fallback' ELSE 'none' END AS routed FROM u LEFT JOIN ft USING (unit) LEFT JOIN mt USING (meter)""")
def unit_models_with_fallback(spark, sf):
    rows = preds(spark, sf).drop("score").withColumn("unit", F.concat_ws("|", "building_id", "meter"))
    train = rows.filter("site_id % 2 = 0")
    return models.route(rows, models.unit_means(train, "unit", "reading"), models.unit_means(train, "meter", "reading"), "unit", "meter", "reading").select("raw_index", "score", "routed")


COLUMNS = ["reading", "score_a", "score_b"]


@query()
def ensemble_scores(spark, sf):
    """Four tree models (two boosted, a forest, symmetric boosted trees) and their mean on held-out sites: step areas per model."""
    rows = td.predictions(spark, sf)
    train = rows.filter("site_id % 2 = 0")
    scaler = models.fit_scaler(train, COLUMNS)
    scaled = models.scale(train, scaler)
    fitted, symmetric = models.fit_members(scaled, COLUMNS), {"symmetric": models.symmetric_member(scaled, COLUMNS)}
    scored = models.score_members(models.scale(rows.filter("site_id % 2 = 1"), scaler), fitted, COLUMNS, ["raw_index", "y", "meter"], symmetric)
    return metrics.score_columns_metrics(scored, [*fitted, *symmetric, "ensemble"], [])


@query()
def embedding_clusters(spark, sf):
    rows = td.table(spark, sf, "embeddings").filter("embedding is not null").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    from pyspark.ml.functions import array_to_vector

    return models.cluster(rows.withColumn("embedding", array_to_vector("embedding")), "embedding", 10).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query(f"WITH {P}, l AS (SELECT CASE WHEN site_id % 4 = 0 THEN 'fit' WHEN site_id % 4 = 1 THEN 'train' ELSE 'val' END AS dataset, score_a, y FROM p), {curve_sql('dataset', 'l')} SELECT dataset, {AREAS} FROM v GROUP BY dataset")
def areas_by_dataset(spark, sf):
    side = F.when(F.col("site_id") % 4 == 0, "fit").when(F.col("site_id") % 4 == 1, "train").otherwise("val")
    return metrics.roc_pr(preds(spark, sf).withColumn("dataset", side), ["dataset"])


@query(f"""WITH {P}, l AS (SELECT 'before' AS stage, score_a, y FROM p UNION ALL SELECT 'after', CASE WHEN reading = 1 THEN 1.0 WHEN building_id % 3 = 0 THEN 0.0 ELSE score_a END, y FROM p), {curve_sql('stage', 'l')},
t AS (SELECT count(*) FILTER (reading = 1) AS ones, count(*) FILTER (building_id % 3 = 0) AS masked FROM p) SELECT stage, {AREAS}, max(ones) AS ones, max(masked) AS masked FROM v, t GROUP BY stage""")
def rule_effect(spark, sf):
    rows = preds(spark, sf)
    ruled = F.when(F.col("reading") == 1, F.lit(1.0)).when(F.col("building_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("score"))
    long = rows.select("y", F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col("score")), F.struct(F.lit("after").alias("stage"), ruled.alias("score")))).alias("x")).select("y", "x.*")
    fired = rows.agg(F.count_if(F.col("reading") == 1).alias("ones"), F.count_if(F.col("building_id") % 3 == 0).alias("masked"))
    return metrics.roc_pr(long, ["stage"]).join(F.broadcast(fired))


@query(f"""WITH {P}, l AS (SELECT 'with' AS regime, score_a AS s, y, meter FROM p UNION ALL SELECT 'without', score_b, y, meter FROM p), {curve_sql('regime, meter', 'l', 's')}, m AS (SELECT regime, meter, {AREAS} FROM v GROUP BY ALL),
d AS (SELECT meter, round(max(roc_auc) FILTER (regime = 'without') - max(roc_auc) FILTER (regime = 'with'), 6) AS delta FROM m GROUP BY meter) SELECT meter, delta, CASE WHEN delta > 0.0005 THEN 'harmful' WHEN delta < -0.0005 THEN 'useful' ELSE 'neutral' END AS effect FROM d""")
def ablation_effects(spark, sf):
    from ohmflow.operators import splits

    cells = metrics.score_columns_metrics(preds(spark, sf), ["score_a", "score_b"], ["meter"])
    gaps = metrics.learner_gaps(cells, ["meter"], "model", "score_b", "score_a", "roc_auc").select("meter", F.col("gap").alias("delta"))
    return splits.ablation_class(gaps)
