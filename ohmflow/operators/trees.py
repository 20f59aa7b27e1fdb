"""Boosted trees for all partition units at once.

A unit is a value of some key columns (a building's meter, a meter, the whole table). All units grow together: each level of a tree is one
aggregation of rows by (unit, node, feature, bin), so the number of jobs is that of levels, whatever the number of units. A task sums before it
shuffles and only bins of nodes meet, so a unit that holds most of the rows is no task of its own.

Rows are first reduced to distinct bin vectors with counts. Gradients are summed as whole numbers of 1e-9, so a model does not depend on how
rows are parted. Models are a table keyed by unit; a row is scored by the finest unit that has one.

Two kinds of tree: free (each node has its own split) and symmetric (one split for each level, shared by its nodes, so that a leaf is the
pattern of the splits' bits and scoring is a lookup).

Defined results: null features count as the lowest bin; rows with a null label or a null unit are not learned from; a unit of one class,
or of fewer rows than least_rows, has no model; a node that no split improves keeps its rows on the left; ties go to the first feature, then the lowest cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.operators.features import quantiles
from ohmflow.sources.sinks import stored

#: Gradients are whole numbers of this.
GRAIN = 1e-9

#: Models of a level that may be broadcast to score rows; more are joined by a shuffle.
BROADCAST_UNITS = 10_000


def default_edges(rows: DataFrame, features: list[str], bins: int = 16) -> dict[str, list[float]]:
    """Distinct inner quantiles of each feature."""
    points = [i / bins for i in range(1, bins)]
    return {f: sorted({v for v in quantiles(rows, [], f, points).first()["q"] if v is not None}) for f in features}


def binned(features: list[str], edges: dict[str, list[float]]) -> Column:
    """The bins of a row: of each feature the number of edges under it."""
    under = lambda f: sum((F.coalesce(F.lit(e) < F.col(f), F.lit(False)).cast("int") for e in edges[f]), F.lit(0))
    return F.array(*map(under, features))


def unit_key(columns: list[str]) -> Column:
    """A unit's name; null where a part is null, so such rows fall through to the next level."""
    return F.concat(F.lit("|".join(columns) + "="), *[p for c in columns for p in (F.col(c).cast("string"), F.lit("|"))])


def _walked(rows: DataFrame, splits: Column, depth: int) -> DataFrame:
    """rows and _node: the node (from 1) that the bins x reach after `depth` splits of a map node -> (f, c). A step is a column of its own, as one expression
    would hold each node three times."""
    out = rows.withColumn("_node", F.lit(1))
    for _ in range(depth):
        split = F.element_at(splits, F.col("_node"))
        out = out.withColumn("_node", F.col("_node") * 2 + F.coalesce((F.get(F.col("x"), split["f"]) > split["c"]).cast("int"), F.lit(0)))
    return out


def _add_tree(rows: DataFrame, tree: Column, depth: int) -> DataFrame:
    """rows with the leaf that the bins x reach in a tree added to score; where there is no tree nothing."""
    leaf = F.element_at(tree["leaves"], F.col("_node") - 2**depth + 1)
    return _walked(rows, tree["splits"], depth).withColumn("score", F.col("score") + F.coalesce(leaf, F.lit(0.0))).drop("_node")


def unit_cells(rows: DataFrame, levels: list[list[str]], features: list[str], edges: dict[str, list[float]], label: str = "y") -> DataFrame:
    """unit, x (bins), n, pos: the rows of each unit, reduced to distinct bins. levels: key columns of the units, the finest first; [] is one unit of all rows."""
    known = rows.filter(F.col(label).isNotNull()).select(*{c: None for columns in levels for c in columns}, binned(features, edges).alias("x"), F.col(label).cast("long").alias("y"))
    named = F.explode(F.array(*[unit_key(c) if c else F.lit("all") for c in levels])).alias("unit")
    return known.select(named, "x", "y").filter("unit is not null").groupBy("unit", "x").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def fit_units(rows: DataFrame, levels: list[list[str]], features: list[str], edges: dict[str, list[float]], label: str = "y", rounds: int = 2, depth: int = 2, rate: float = 0.5, ridge: float = 1.0, least_rows: int = 5, symmetric: bool = False) -> DataFrame:
    """unit, n, pos, base (log-odds of its rate), trees (array of splits: map node -> (f, c), which sends bins over c to the right; and leaves). levels: key
    columns of the units, the finest first; [] is one unit of all rows."""
    cells = stored(unit_cells(rows, levels, features, edges, label), "cells")
    return grow_units(cells, max(len(e) for e in edges.values()) + 1, rounds, depth, rate, ridge, least_rows, symmetric)


def grow_units(cells: DataFrame, most: int, rounds: int = 2, depth: int = 2, rate: float = 0.5, ridge: float = 1.0, least_rows: int = 5, symmetric: bool = False) -> DataFrame:
    """fit_units() of the stored unit_cells(). most: bins of a feature at most. Cells meet splits and trees in hash joins that build on the units' side, so
    the cells, which are the most rows, are never sorted; the leaves of a tree come from the sums of its last cuts."""
    units = cells.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter(f"pos between 1 and n - 1 and n >= {least_rows}")
    units = stored(units.withColumn("base", F.round(F.ln(F.col("pos") / (F.col("n") - F.col("pos"))), 9)), "units")
    models = units.withColumn("trees", F.array().cast("array<struct<splits:map<int,struct<f:int,c:int>>,leaves:array<double>>>"))
    data = cells.join(units.select("unit", F.col("base").alias("score")).hint("shuffle_hash"), "unit")
    for r in range(rounds):
        data = stored(data, "cells")
        p = 1 / (1 + F.exp(-F.col("score")))
        whole = lambda v: F.round(v / GRAIN).cast("long")
        based = data.select("unit", "x", "n", whole(F.col("pos") - F.col("n") * p).alias("g"), whole(F.col("n") * p * (1 - p)).alias("h"))
        growing = units.select("unit", F.create_map().cast("map<int,struct<f:int,c:int>>").alias("splits"))
        sums = based.groupBy("unit").agg(F.map_from_arrays(F.array(F.lit(0)), F.array(F.struct(F.sum("g").alias("g"), F.sum("h").alias("h")))).alias("sums")) if depth == 0 else None
        for level in range(depth):
            growing = stored(_next_level(based, growing, level, most, ridge, least_rows, symmetric, last=level == depth - 1), "splits")
        if sums is not None:
            growing = growing.join(sums, "unit")
        value = lambda s: F.coalesce(F.round(rate * s["g"] * GRAIN / (s["h"] * GRAIN + ridge), 9), F.lit(0.0))
        leaves = F.transform(F.sequence(F.lit(0), F.lit(2**depth - 1)), lambda i: value(F.element_at("sums", i)))
        tree = stored(growing.select("unit", F.struct("splits", leaves.alias("leaves")).alias("tree")), "tree")
        models = models.join(tree, "unit").withColumn("trees", F.concat("trees", F.array("tree"))).drop("tree")
        if r < rounds - 1:
            data = _add_tree(data.join(tree.hint("shuffle_hash"), "unit"), F.col("tree"), depth).drop("tree")
    return stored(models, "unit-models")


def _next_level(based: DataFrame, growing: DataFrame, level: int, most: int, ridge: float, least_rows: int, symmetric: bool, last: bool) -> DataFrame:
    """unit, splits with those of the nodes of this level: one aggregation over all units. After the last level also sums: map leaf (from 0) -> (g, h)."""
    met = based.join(growing.hint("shuffle_hash"), "unit") if level else based
    met = _walked(met, F.col("splits"), level).withColumnRenamed("_node", "node")
    placed = met.select("unit", "node", F.posexplode("x").alias("f", "bin"), "n", "g", "h")
    bins = placed.groupBy("unit", "node", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])
    # a bin's running sums belong to every cut from it up to the next bin
    feature = Window.partitionBy("unit", "node", "f")
    upto = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    left = bins.select("unit", "node", "f", "bin", F.lead("bin", 1, most).over(feature.orderBy("bin")).alias("_next"), *[F.sum(c).over(upto).alias(c) for c in ("n", "g", "h")], *[F.sum(c).over(feature).alias(f"all_{c}") for c in ("n", "g", "h")])
    part = lambda g, h: (g * GRAIN) * (g * GRAIN) / (h * GRAIN + ridge)
    g, h, all_g, all_h = (F.col(c) for c in ("g", "h", "all_g", "all_h"))
    gain = F.round(part(g, h) + part(all_g - g, all_h - h) - part(all_g, all_h), 6)
    fit = F.lit(True) if symmetric else (F.col("n") >= least_rows) & (F.col("all_n") - F.col("n") >= least_rows)
    left = stored(left, "cuts")
    # nodes of a symmetric level have to agree on a cut; else the lowest of equal ones is at a bin
    at = F.explode(F.sequence("bin", F.col("_next") - 1)) if symmetric else F.col("bin")
    cuts = left.withColumn("c", at).filter(F.col("c") < most - 1).filter(fit).withColumn("gain", F.round(gain * 1e6).cast("long"))
    nodes = ["unit"] if symmetric else ["unit", "node"]
    summed = cuts.groupBy(*nodes, "f", "c").agg(F.sum("gain").alias("gain")) if symmetric else cuts
    best = summed.filter("gain > 0").groupBy(*nodes).agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("c")).alias("c"))).alias("b")).select(*nodes, F.struct((-F.col("b.f")).alias("f"), (-F.col("b.c")).alias("c")).alias("split"))
    if symmetric:
        every = F.transform(F.sequence(F.lit(2**level), F.lit(2 ** (level + 1) - 1)), lambda k: F.struct(k.alias("k"), F.col("split").alias("v")))
        found = best.select("unit", F.map_from_entries(every).alias("more"))
    else:
        found = best.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("node", "split"))).alias("more"))
    grown = growing.join(found, "unit", "left").select("unit", F.when(F.col("more").isNull(), F.col("splits")).otherwise(F.map_concat("splits", "more")).alias("splits"))
    if not last:
        return grown
    # left of the cut is the last bin up to it; a node without a split has all on the left, as if cut after the last bin
    chosen = left.join(best.hint("shuffle_hash"), nodes, "left").filter(F.col("f") == F.coalesce(F.col("split.f"), F.lit(0)))
    under = F.when(F.col("bin") <= F.coalesce(F.col("split.c"), F.lit(most)), F.struct("bin", "g", "h"))
    ends = chosen.groupBy("unit", "node").agg(F.max(under).alias("l"), *[F.first(f"all_{c}").alias(c) for c in ("g", "h")])
    sides = ends.select("unit", "node", F.coalesce(F.col("l.g"), F.lit(0)).alias("lg"), F.coalesce(F.col("l.h"), F.lit(0)).alias("lh"), "g", "h")
    leaf = (F.col("node") - 2**level) * 2
    pair = lambda i, g, h: F.struct(i.alias("leaf"), F.struct(g.alias("g"), h.alias("h")).alias("s"))
    both = F.array(pair(leaf, F.col("lg"), F.col("lh")), pair(leaf + 1, F.col("g") - F.col("lg"), F.col("h") - F.col("lh")))
    sums = sides.groupBy("unit").agg(F.map_from_entries(F.flatten(F.collect_list(both))).alias("sums"))
    return grown.join(sums, "unit")


def _few(models: DataFrame) -> DataFrame:
    """models, to be broadcast if they are at most BROADCAST_UNITS."""
    return F.broadcast(models) if models.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS else models.hint("shuffle_hash")


def score_units(rows: DataFrame, models: DataFrame, levels: list[list[str]], features: list[str], edges: dict[str, list[float]], depth: int = 2, digits: int = 6) -> DataFrame:
    """rows, score (probability) and routed: the place in levels of the unit whose model scored the row; null where none has one. A level of few units is
    broadcast, so rows are not sent by a key that has few values."""
    out = rows
    for i, columns in enumerate(levels):
        key, own = (unit_key(columns), F.col("unit").startswith("|".join(columns) + "=")) if columns else (F.lit("all"), F.col("unit") == "all")
        named = models.filter(own).select(F.col("unit").alias(f"_u{i}"), F.col("base").alias(f"_b{i}"), F.col("trees").alias(f"_t{i}"))
        out = out.join(_few(named), key == F.col(f"_u{i}"), "left")
    first = lambda p: F.coalesce(*[F.col(f"_{p}{i}") for i in range(len(levels))])
    by = F.coalesce(*[F.when(F.col(f"_b{i}").isNotNull(), F.lit(i)) for i in range(len(levels))])
    kept = F.struct(*[F.col(c) for c in rows.columns]).alias("_row")
    odds = out.select(kept, binned(features, edges).alias("x"), first("b").alias("score"), first("t").alias("_trees"), by.alias("routed"))
    rounds = models.agg(F.max(F.size("trees"))).first()[0] or 0
    for r in range(rounds):
        odds = _add_tree(odds, F.get("_trees", F.lit(r)), depth)
    return odds.select("_row.*", F.round(1 / (1 + F.exp(-F.col("score"))), digits).alias("score"), "routed")


def symmetric_score(model: dict, features: list[str], edges: dict[str, list[float]], depth: int, digits: int = 6, bins: str | None = None) -> Column:
    """The probability by one stored symmetric model (a row of fit_units, as a dict), as a column: bits of the splits, then a lookup. bins: a column of
    binned() to score by, in place of the features."""
    odds = F.lit(float(model["base"]))
    for tree in model["trees"]:
        leaf = F.lit(0)
        for level in range(depth):
            split = tree["splits"].get(2**level)
            cut = edges[features[split["f"]]][split["c"]] if split and split["c"] < len(edges[features[split["f"]]]) else None
            over = None if cut is None else F.col(features[split["f"]]) > cut if bins is None else F.col(bins)[split["f"]] > split["c"]
            bit = F.lit(0) if cut is None else F.coalesce(over.cast("int"), F.lit(0))
            leaf = leaf * 2 + bit
        odds = odds + F.get(F.array(*map(F.lit, tree["leaves"])), leaf)
    return F.round(1 / (1 + F.exp(-odds)), digits)
