"""Queries of the models that are grown for all units at once, with the same growth in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmflow.operators import metrics, trees
from ohmflow.plans.registry import query
from ohmflow.sources import testdata as td

FEATURES = ["reading", "score_a", "score_b"]
EDGES = {"reading": [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0], "score_a": [i / 10 + 0.05 for i in range(10)], "score_b": [i / 10 + 0.05 for i in range(8)]}
LEVELS = [["building_id", "meter"], ["meter"]]
MOST = max(map(len, EDGES.values())) + 1


def grown(levels: list[str], rounds: int, depth: int, symmetric: bool, least: int) -> str:
    """CTEs: l (rows of both sides with bins), u (units) and, for each round and level, the splits; m{round} holds cells with their scores, t{round} leaves."""
    bins = ", ".join(f"len(list_filter({EDGES[f]}, lambda e: e < {f})) AS x{i}" for i, f in enumerate(FEATURES))
    named = " UNION ALL ".join(f"SELECT {k} AS unit, x0, x1, x2, y FROM l WHERE site_id % 2 = 0" for k in levels)
    out = [f"{td.PREDICTIONS}", f"l AS (SELECT *, {bins} FROM p)", f"k AS ({named})", "cells AS (SELECT unit, x0, x1, x2, count(*) AS n, sum(y) AS pos FROM k GROUP BY ALL)",
           f"u AS (SELECT unit, sum(n) AS n, sum(pos) AS pos, round(ln(sum(pos) / (sum(n) - sum(pos))), 9) AS base FROM cells GROUP BY unit HAVING sum(pos) BETWEEN 1 AND sum(n) - 1 AND sum(n) >= {least})",
           "m0 AS (SELECT c.*, u.base AS score FROM cells c JOIN u USING (unit))"]
    for r in range(rounds):
        p = "(1 / (1 + exp(-score)))"
        out.append(f"d{r}_0 AS (SELECT unit, x0, x1, x2, n, CAST(round((pos - n * {p}) / 1e-9) AS BIGINT) AS g, CAST(round(n * {p} * (1 - {p}) / 1e-9) AS BIGINT) AS h, 1 AS node FROM m{r})")
        for k in range(depth):
            at, nodes = f"{r}_{k}", "unit" if symmetric else "unit, node"
            fit = "" if symmetric else f" AND left_n >= {least} AND all_n - left_n >= {least}"
            part = lambda g, h: f"({g} * 1e-9) * ({g} * 1e-9) / ({h} * 1e-9 + 1.0)"
            out += [
                f"b{at} AS (SELECT unit, node, f, bin, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM ({' UNION ALL '.join(f'SELECT unit, node, {i} AS f, x{i} AS bin, n, g, h FROM d{at}' for i in range(len(FEATURES)))}) GROUP BY ALL)",
                f"c{at} AS (SELECT unit, node, f, c, sum(n) AS left_n, sum(g) AS g, sum(h) AS h FROM b{at}, (SELECT unnest(range(0, {MOST - 1})) AS c) WHERE bin <= c GROUP BY ALL)",
                f"a{at} AS (SELECT unit, node, sum(n) AS all_n, sum(g) AS all_g, sum(h) AS all_h FROM b{at} WHERE f = 0 GROUP BY ALL)",
                f"e{at} AS (SELECT unit, node, f, c, CAST(round(round({part('g', 'h')} + {part('(all_g - g)', '(all_h - h)')} - {part('all_g', 'all_h')}, 6) * 1e6) AS BIGINT) AS gain FROM c{at} JOIN a{at} USING (unit, node) WHERE true{fit})",
                f"s{at} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {nodes} ORDER BY gain DESC, f, c) AS i FROM (SELECT {nodes}, f, c, sum(gain) AS gain FROM e{at} GROUP BY ALL) WHERE gain > 0) WHERE i = 1)",
                f"d{r}_{k + 1} AS (SELECT d.unit, x0, x1, x2, d.n, d.g, d.h, d.node * 2 + CASE WHEN s.unit IS NOT NULL AND list_value(x0, x1, x2)[s.f + 1] > s.c THEN 1 ELSE 0 END AS node FROM d{at} d LEFT JOIN s{at} s USING ({nodes}))",
            ]
        out += [
            f"t{r} AS (SELECT unit, node, round(0.5 * sum(g) * 1e-9 / (sum(h) * 1e-9 + 1.0), 9) AS v FROM d{r}_{depth} GROUP BY ALL)",
            f"m{r + 1} AS (SELECT m.unit, m.x0, m.x1, m.x2, m.n, m.pos, m.score + t.v AS score FROM m{r} m JOIN d{r}_{depth} USING (unit, x0, x1, x2) JOIN t{r} t USING (unit, node))",
        ]
    return ",\n".join(out)


def walked(rounds: int, depth: int, symmetric: bool, key: str, name: str, source: str = "l") -> str:
    """CTEs that lead every row of l through its unit's trees: {name} has raw_index and odds (null without a model)."""
    nodes = "unit" if symmetric else "unit, node"
    out = [f"{name}0_0 AS (SELECT l.*, u.unit, u.base AS odds, 1 AS node FROM {source} l JOIN u ON u.unit = {key})"]
    for r in range(rounds):
        for k in range(depth):
            out.append(f"{name}{r}_{k + 1} AS (SELECT w.* REPLACE (w.node * 2 + CASE WHEN s.unit IS NOT NULL AND list_value(x0, x1, x2)[s.f + 1] > s.c THEN 1 ELSE 0 END AS node) FROM {name}{r}_{k} w LEFT JOIN s{r}_{k} s USING ({nodes}))")
        out.append(f"{name}{r + 1}_0 AS (SELECT w.* REPLACE (w.odds + coalesce(t.v, 0) AS odds, 1 AS node) FROM {name}{r}_{depth} w LEFT JOIN t{r} t USING (unit, node))")
    out.append(f"{name} AS (SELECT raw_index, odds FROM {name}{rounds}_0)")
    return ",\n".join(out)


UNIT, METER = "'building_id|meter=' || building_id || '|' || meter || '|'", "'meter=' || meter || '|'"
ROUTED = f"""{grown([UNIT, METER], 2, 2, False, 5)},
{walked(2, 2, False, UNIT, 'wf')},
{walked(2, 2, False, METER, 'wc')},
z AS (SELECT l.raw_index, l.y, l.meter, l.site_id, round(1 / (1 + exp(-coalesce(wf.odds, wc.odds))), 6) AS score, CASE WHEN wf.odds IS NOT NULL THEN 'unit' WHEN wc.odds IS NOT NULL THEN 'fallback' ELSE 'none' END AS routed
  FROM l LEFT JOIN wf USING (raw_index) LEFT JOIN wc USING (raw_index))"""


def routed_rows(spark, sf):
    rows = td.predictions(spark, sf)
    models = trees.fit_units(rows.filter("site_id % 2 = 0"), LEVELS, FEATURES, EDGES)
    scored = trees.score_units(rows, models, LEVELS, FEATURES, EDGES)
    return scored.withColumn("routed", F.when(F.col("routed") == 0, "unit").when(F.col("routed") == 1, "fallback").otherwise("none"))


@query(f"WITH {ROUTED} SELECT raw_index, score, routed FROM z")
def unit_tree_scores(spark, sf):
    """Boosted trees of each building's meter, else of the meter, on all rows."""
    return routed_rows(spark, sf).select("raw_index", "score", "routed")


@query(f"""WITH {ROUTED}, g AS (SELECT meter, score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM z GROUP BY 1, 2),
q AS (SELECT 'pooled' AS level, '' AS name, s, sum(pos) AS pos, sum(neg) AS neg FROM g GROUP BY s UNION ALL SELECT 'meter', meter, s, pos, neg FROM g),
v AS (SELECT level, name, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS area FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY level, name ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM q) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM z) AS rows, (SELECT round(avg(CASE WHEN routed = 'unit' THEN 1.0 ELSE 0.0 END), 6) FROM z) AS coverage, (SELECT round(area, 6) FROM v WHERE level = 'pooled') AS pooled_auc, (SELECT round(avg(area), 6) FROM v WHERE level = 'meter') AS macro_auc""")
def unit_tree_report(spark, sf):
    """Pooled and macro areas of the routed scores and the share of rows that their own unit's model scored."""
    from ohmflow.sources.sinks import stored

    rows = stored(routed_rows(spark, sf).select("y", "meter", "score", "routed"), "routed")
    shares = rows.agg(F.count("*").alias("rows"), F.round(F.avg(F.when(F.col("routed") == "unit", 1.0).otherwise(0.0)), 6).alias("coverage"))
    pooled = metrics.roc_pr(rows, []).select(F.col("roc_auc").alias("pooled_auc"))
    macro = metrics.roc_pr(rows, ["meter"]).agg(F.round(F.avg("roc_auc"), 6).alias("macro_auc"))
    return shares.join(pooled).join(macro)


@query(f"WITH {grown([chr(39) + 'all' + chr(39)], 3, 3, True, 5)},\n{walked(3, 3, True, chr(39) + 'all' + chr(39), 'wa')} SELECT raw_index, round(1 / (1 + exp(-odds)), 6) AS score FROM wa")
def symmetric_tree_scores(spark, sf):
    """One booster of symmetric trees for the whole table, scored by its stored bits and leaves."""
    rows = td.predictions(spark, sf)
    model = trees.fit_units(rows.filter("site_id % 2 = 0"), [[]], FEATURES, EDGES, rounds=3, depth=3, symmetric=True).first()
    scored = rows.select("raw_index", trees.symmetric_score(model.asDict(recursive=True), FEATURES, EDGES, 3).alias("score")) if model else rows.select("raw_index", F.lit(None).cast("double").alias("score")).limit(0)
    return scored
