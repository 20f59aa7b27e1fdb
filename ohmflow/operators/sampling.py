"""Deterministic samples. A row's place is its md5 priority, so a sample is the same on any cluster and in any engine; all
draws are distributed limits or ranks within groups, never a rank over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.functions.scalar import priority
from ohmflow.functions.stable import stable_priority, unsigned_order
from ohmflow.operators.features import quantiles
from ohmflow.operators.scan import cell, cell_starts, digest_ranks, prefix_sums


#: A sample up to this size is a distributed limit; of a larger one only the last rows are.
LIMIT_ROWS = 10_000


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of least priority. Rows are counted by the first digits of their priority, until the cell in which the n-th lies is
    small; smaller cells are taken whole, so no task gathers a large sample."""
    placed = rows.withColumn("_p", priority(seed, F.col(key)))
    prefix, digits, taken = "", 0, None
    while n > LIMIT_ROWS and digits < 24:
        digits += 4
        of = placed.filter(F.startswith("_p", F.lit(prefix)))
        sums = sorted((r["_c"], r["n"]) for r in of.groupBy(F.substring("_p", 1, digits).alias("_c")).agg(F.count("*").alias("n")).collect())
        upto, last = 0, None
        for cell, size in sums:
            if upto + size > n:
                last = cell
                break
            upto += size
        if last is None:
            below = of
        else:
            below = of.filter(F.substring("_p", 1, digits) < last)
        taken = below if taken is None else taken.unionByName(below)
        if last is None:
            return taken.drop("_p")
        prefix, n = last, n - upto
    rest = placed.filter(F.startswith("_p", F.lit(prefix))).orderBy("_p", key).limit(n)
    return (rest if taken is None else taken.unionByName(rest)).drop("_p")


def ranked(rows: DataFrame, groups: list[str], key: str, seed: int = 0, name: str = "rank") -> DataFrame:
    """rows and their rank by priority within groups, from 0."""
    return rows.withColumn("_p", priority(seed, F.col(key))).withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy("_p", key)) - 1).drop("_p")


def spread_ranks(rows: DataFrame, groups: list[str], key: str, seed: int = 0, name: str = "rank") -> DataFrame:
    """ranked() for few large groups: no task gathers one. Rows of null groups are left out."""
    return digest_ranks(rows, groups, priority(seed, F.col(key)), key, name)


def per_group(rows: DataFrame, groups: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    return ranked(rows, groups, key, seed).filter(F.col("rank") < n).drop("rank")


def stable_sample(rows: DataFrame, groups: list[str], key: str, n: int, seed: int, step: bool = True) -> DataFrame:
    """At most n rows of each group, of least unsigned 64-bit priority; groups of any size are ranked by ranges."""
    placed = rows.withColumn("_p", unsigned_order(stable_priority(seed, F.col(key), step)))
    return prefix_sums(placed, groups, "_p", {"_i": F.lit(1)}).filter(F.col("_i_before") < n).select(*rows.columns)


def downsample(rows: DataFrame, key: str, label: str = "anomaly", seed: int = 10) -> DataFrame:
    """Two draws of as many negatives as there are positives, each with all positives: copy_id tells the draws."""
    pos = rows.filter(F.col(label) == 1)
    n = pos.count()
    parts = [sample(rows.filter(F.col(label) == 0), n, key, seed + i).unionByName(pos).withColumn("copy_id", F.lit(i)) for i in (0, 1)]
    return parts[0].unionByName(parts[1])


def balanced(rows: DataFrame, key: str, label: str = "anomaly", max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """As many negatives as positives, within max_rows."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n = min(counts.get(0, 0), counts.get(1, 0), (max_rows or 1 << 60) // 2)
    return sample(rows.filter(F.col(label) == 0), n, key, seed).unionByName(sample(rows.filter(F.col(label) == 1), n, key, seed))


def nested_balanced(rows: DataFrame, key: str, budgets: list[int], label: str = "anomaly", seed: int = 0) -> DataFrame:
    """budget and rows: alternating positives and negatives, every budget a prefix of the larger ones."""
    half = (max(budgets) + 1) // 2
    parts = [sample(rows.filter(F.col(label) == c), half, key, seed) for c in (0, 1)]
    placed = spread_ranks(parts[0].unionByName(parts[1]), [label], key, seed, "_k").withColumn("place", F.col("_k") * 2 + (1 - F.col(label))).drop("_k")
    return placed.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).filter(F.col("place") < F.col("budget"))


def shares(weights: list[float], total: int, room: list[int]) -> list[int]:
    """Largest-remainder shares of total by weight within each one's room: floors first, then one more at a time to the one that is
    furthest below its share, the first on ties, among those with room. Too little room is refused."""
    if total < 0 or sum(room) < total:
        raise ValueError("too few eligible rows")
    if sum(weights) <= 0:
        raise ValueError("no eligible support")
    wanted = [total * w / sum(weights) for w in weights]
    got = [min(int(x), r) for x, r in zip(wanted, room, strict=True)]
    left = total - sum(got)
    while left:
        some = [i for i in range(len(got)) if got[i] < room[i]]
        # whole rounds go to all with room: everyone's distance grows by one in each
        spread = max(wanted[i] - got[i] for i in some) - min(wanted[i] - got[i] for i in some)
        rounds = min(left // len(some), min(room[i] - got[i] for i in some)) if spread < 1 else 0
        if rounds:
            for i in some:
                got[i] += rounds
            left -= rounds * len(some)
            continue
        best = max(some, key=lambda i: (wanted[i] - got[i], -i))
        got[best] += 1
        left -= 1
    return got


def quotas(groups: DataFrame, total: int, weight: str, key: str, capacity: str | None = None) -> DataFrame:
    """groups and quota: shares() of total by weight, within capacity (the weights where none is named). The table is one of groups."""
    table = sorted(groups.select(key, F.col(weight).alias("_w"), F.col(capacity or weight).alias("_r")).collect(), key=lambda r: (r[0] is None, r[0]))
    got = shares([float(r["_w"]) for r in table], total, [int(r["_r"]) for r in table]) if table or total else []
    schema = f"_k {dict(groups.dtypes)[key]}, quota long"
    found = groups.sparkSession.createDataFrame([(r[0], n) for r, n in zip(table, got, strict=True)], schema)
    return groups.join(found, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def by_quota(rows: DataFrame, table: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Each group's rows up to its quota. Rows are counted by cells of priority; those of cells up to the one in which the quota ends go on, and
    are ranked within their cell, so no task gathers a group. table is one of groups."""
    p = priority(seed, F.col(key))
    celled = rows.withColumn("_cell", cell(p))
    within = cell_starts(celled, [group]).join(F.broadcast(table.select(group, "quota")), group).filter("_start < quota")
    ends = within.groupBy(group).agg(F.max("_cell").alias("_last"), F.max_by(F.col("quota") - F.col("_start"), "_cell").alias("_left"))
    some = celled.join(F.broadcast(ends), group).filter("_cell <= _last").withColumn("_in", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(p, key)))
    return some.filter("_cell < _last or _in <= _left").select(*rows.columns)


def stratified(rows: DataFrame, group: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows that keep the groups' shares."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_w"))
    return by_quota(rows, quotas(counts, n, "_w", group), group, key, seed)


def context(rows: DataFrame, size: int, tag: dict, key: str, label: str = "anomaly", seed: int = 0) -> DataFrame:
    """A context of exactly size rows (positive and even), half of either class, under an intervention: pooled, balanced over meters or
    sites, one meter heavy or excluded, or one source site. Each class is drawn by shares() over meters (sites for a site intervention);
    what a group lacks goes to the others, and too few eligible rows are refused."""
    if size <= 0 or size % 2:
        raise ValueError("a context has a positive, even number of rows")
    kind = tag["kind"]
    pool = rows
    if kind == "meter_excluded":
        pool = rows.filter(F.lower(F.col("meter").cast("string")) != str(tag["meter"]).lower())
    if kind == "site_source":
        pool = rows.filter(F.col("site_id").cast("string") == tag["site"])
    group = F.concat_ws("|", "site_id", "meter") if kind == "site_meter_balanced" else F.col("site_id" if kind.startswith("site") else "meter").cast("string")
    pool = pool.withColumn("_group", group)
    out = None
    for c in (0, 1):
        of = pool.filter(F.col(label) == c)
        counts = of.groupBy("_group").agg(F.count("*").alias("_have"))
        if kind.endswith("balanced"):
            counts = counts.withColumn("_w", F.lit(1.0))
        elif kind == "meter_heavy":
            heavy = F.lower("_group") == str(tag["meter"]).lower()
            others = counts.filter(~heavy).agg(F.sum("_have")).first()[0] or 1
            counts = counts.withColumn("_w", F.when(heavy, F.lit(tag["share"])).otherwise((1 - tag["share"]) * F.col("_have") / others))
        else:
            counts = counts.withColumn("_w", F.col("_have"))
        part = by_quota(of, quotas(counts, size // 2, "_w", "_group", "_have"), "_group", key, seed)
        out = part if out is None else out.unionByName(part)
    return out.drop("_group")


def nested_meter_order(series: DataFrame, key: str, site: str = "site_id", seed: int = 0) -> DataFrame:
    """series and position: an order of meter series whose every prefix spreads over sites in proportion: sorted by
    (rank within site / series of the site, site)."""
    k = ranked(series, [site], key, seed, "_k").withColumn("_n", F.count("*").over(Window.partitionBy(site)))
    # a table of series, not of readings
    return k.withColumn("position", F.row_number().over(Window.orderBy(F.round(F.col("_k") / F.col("_n"), 12), site)) - 1).drop("_k", "_n")


def matched_positives(rows: DataFrame, key: str, n: int, label: str = "anomaly", seed: int = 0) -> DataFrame:
    """The same number of distinct positives for every split, and two negative draws of that size."""
    return downsample(sample(rows.filter(F.col(label) == 1), n, key, seed).unionByName(rows.filter(F.col(label) == 0)), key, label, seed)


def dual_cap(rows: DataFrame, n: int, building_limit: int, segment_limit: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in priority order with at most so many per segment and per building: a segment lies in one building, so the
    caps are two ranks."""
    a = ranked(rows, ["building_id", "segment"], key, seed, "_s").filter(F.col("_s") < segment_limit)
    b = ranked(a, ["building_id"], key, seed, "_b").filter(F.col("_b") < building_limit)
    return sample(b.drop("_s", "_b"), n, key, seed)


def shuffle_labels(rows: DataFrame, groups: list[str], key: str, label: str = "anomaly", seed: int = 0) -> DataFrame:
    """rows with labels permuted within groups: the i-th row by key takes the label of the i-th row by priority."""
    own = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*groups).orderBy(key)))
    other = ranked(rows, groups, key, seed, "_j").select(*groups, (F.col("_j") + 1).alias("_i"), F.col(label).alias("shuffled"))
    return own.join(other, [*groups, "_i"]).drop("_i")


def replacements(slots: DataFrame, reserve: DataFrame, key: str, label: str = "anomaly", seed: int = 0) -> DataFrame:
    """slot, replacement, label: each slot gets a different reserve row of its label, paired by rank."""
    wanted = slots.groupBy(label).agg(F.count("*").alias("quota"))
    a = spread_ranks(slots.select(label, key), [label], key, seed, "_k").select(label, "_k", F.col(key).alias("slot"))
    b = spread_ranks(by_quota(reserve.select(label, key), wanted, label, key, seed), [label], key, seed, "_k").select(label, "_k", F.col(key).alias("replacement"))
    return a.join(b, [label, "_k"]).select("slot", "replacement", label)


def representativeness(draw: DataFrame, parent: DataFrame, value: str, label: str = "anomaly", digits: int = 6) -> DataFrame:
    """label, field, parent, draw, deviation of the quartiles: how far a draw's quantiles are from its parent's."""
    q = lambda rows, name: quantiles(rows, [label], value, [0.25, 0.5, 0.75], name)
    both = q(parent, "_p").join(q(draw, "_d"), label).select(label, F.posexplode(F.arrays_zip("_p", "_d")).alias("i", "x"))
    name = F.element_at(F.array(F.lit("q25"), F.lit("q50"), F.lit("q75")), F.col("i") + 1)
    return both.select(label, name.alias("field"), F.round("x._p", digits).alias("parent"), F.round("x._d", digits).alias("draw"), F.round(F.try_divide(F.col("x._d") - F.col("x._p"), F.nullif(F.abs("x._p"), F.lit(0.0))), digits).alias("deviation"))


def jaccard(selections: DataFrame, seed: str, item: str, digits: int = 6) -> DataFrame:
    """seed_a, seed_b, intersection_count, union_count, jaccard_similarity of every two seeds' selections."""
    sizes = selections.groupBy(seed).agg(F.count_distinct(item).alias("n"))
    s = selections.select(seed, item).distinct()
    common = s.alias("x").join(s.alias("y"), F.col(f"x.{item}") == F.col(f"y.{item}")).filter(F.col(f"x.{seed}") < F.col(f"y.{seed}")).groupBy(F.col(f"x.{seed}").alias("seed_a"), F.col(f"y.{seed}").alias("seed_b")).agg(F.count("*").alias("c"))
    pairs = sizes.alias("a").join(sizes.alias("b"), F.col(f"a.{seed}") < F.col(f"b.{seed}")).select(F.col(f"a.{seed}").alias("seed_a"), F.col(f"b.{seed}").alias("seed_b"), (F.col("a.n") + F.col("b.n")).alias("both"))
    found = pairs.join(common, ["seed_a", "seed_b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return found.select("seed_a", "seed_b", F.col("c").alias("intersection_count"), (F.col("both") - F.col("c")).alias("union_count"), F.round(F.try_divide(F.col("c").cast("double"), F.col("both") - F.col("c")), digits).alias("jaccard_similarity"))


def ladder(profiles: DataFrame, budgets: list[int], meters: list[str], seed: int = 0, redraws: int = 50) -> DataFrame:
    """budget, position, building_id, site_id, role: nested building sets drawn over sites in turn. A draw whose smallest
    budget lacks a meter is drawn anew as a whole. profiles is a table of buildings with <meter>_rows."""
    counts = profiles.select("building_id", "site_id", *[f"{m}_rows" for m in meters])
    for attempt in range(redraws):
        order = ranked(counts, ["site_id"], "building_id", seed + 1000 * attempt, "_k").withColumn("_p", priority(seed + 1000 * attempt, F.col("site_id")))
        placed = order.withColumn("position", F.row_number().over(Window.orderBy("_k", "_p", "site_id")) - 1)
        least = placed.filter(F.col("position") < min(budgets)).agg(*[F.coalesce(F.sum(f"{m}_rows"), F.lit(0)).alias(m) for m in meters]).first()
        if all(least[m] > 0 for m in meters):
            break
    else:
        raise ValueError("no draw covers every meter")
    return placed.withColumn("role", F.when(F.col("position") % 5 == 4, "early_stop").otherwise("fit")).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).filter(F.col("position") < F.col("budget")).select("budget", "position", "building_id", "site_id", "role")


def balanced_prefix_gap(nested: DataFrame, label: str = "anomaly") -> DataFrame:
    """Budgets whose classes differ by more than one row."""
    return nested.groupBy("budget").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).filter("abs(pos - neg) > 1")


def natural_contexts(rows: DataFrame, key: str, budgets: list[int], label: str = "anomaly", seed: int = 0) -> DataFrame:
    """budget and rows: contexts at the table's own class shares; quotas per budget, rows by priority, so budgets nest."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_w"))
    table = None
    for b in budgets:
        part = quotas(counts, b, "_w", label).select(label, F.lit(b).alias("budget"), "quota")
        table = part if table is None else table.unionByName(part)
    most = table.groupBy(label).agg(F.max("quota").alias("quota"))
    drawn = spread_ranks(by_quota(rows, most, label, key, seed), [label], key, seed, "_k")
    return drawn.join(F.broadcast(table), label).filter("_k < quota").drop("_k", "quota")


def half_flagged(rows: DataFrame, flag: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows, half of them flagged."""
    return sample(rows.filter(F.col(flag) == 1), n // 2, key, seed).unionByName(sample(rows.filter(F.col(flag) == 0), n - n // 2, key, seed))


def bounded_rows(rows: DataFrame, per_class: int, key: str, label: str = "anomaly", seed: int = 0) -> DataFrame:
    """At most per_class rows of either class and their place: positives and negatives in turn."""
    return per_class_ranks(rows, per_class, key, label, seed).withColumn("place", F.col("_k") * 2 + (1 - F.col(label))).drop("_k")


def per_class_ranks(rows: DataFrame, per_class: int, key: str, label: str, seed: int) -> DataFrame:
    parts = [sample(rows.filter(F.col(label) == c), per_class, key, seed) for c in (1, 0)]
    return spread_ranks(parts[0].unionByName(parts[1]), [label], key, seed, "_k")


def downsampled_ids(rows: DataFrame, key: str, order: list[str], label: str = "anomaly", seed: int = 10) -> DataFrame:
    """copy_id, order, key of downsample(): the raw ids with the columns of the order in which features were built. A table has no
    order; who needs one sorts by these."""
    return downsample(rows, key, label, seed).select("copy_id", *order, *[key] * (key not in order))


def index_sets(rows: DataFrame, side: str, fit_rows: int, score_rows: int, key: str, label: str = "anomaly", seed: int = 0) -> DataFrame:
    """role, key: fit (balanced, of the training side), train (of it), val and test (of their sides), with seeds one apart."""
    of = lambda s: rows.filter(F.col(side) == s)
    parts = {"fit": balanced(of("train"), key, label, fit_rows, seed), "train": sample(of("train"), score_rows, key, seed + 1), "val": sample(of("val"), score_rows, key, seed + 2), "test": sample(of("test"), score_rows, key, seed + 3)}
    out = None
    for role, part in parts.items():
        one = part.select(F.lit(role).alias("role"), key)
        out = one if out is None else out.unionByName(one)
    return out


def ladder_rows(rows: DataFrame, steps: DataFrame, budget: int, label: str = "anomaly") -> DataFrame:
    """rows of one budget's buildings and their role; a role without both classes is refused. steps: budget, building_id, role."""
    cell = rows.join(steps.filter(F.col("budget") == budget).select("building_id", "role"), "building_id")
    kinds = {r["role"]: (r["pos"], r["neg"]) for r in cell.groupBy("role").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).collect()}
    if not kinds or any(0 in k for k in kinds.values()):
        raise ValueError("a role of the ladder lacks a class")
    return cell


def building_quotas(buildings: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """building_id, position, rows, quota: each block of positions (up to a budget) shares out so many rows by its buildings' rows, so
    larger budgets keep the smaller ones' quotas. buildings: building_id, position, rows; blocks: (budget, rows of the block)."""
    out, start = None, 0
    for budget, total in blocks:
        block = buildings.filter((F.col("position") >= start) & (F.col("position") < budget))
        part = quotas(block, total, "rows", "building_id")
        out, start = part if out is None else out.unionByName(part), budget
    return out


def seeded_samples(rows: DataFrame, seeds: list[int], n: int, key: str) -> DataFrame:
    """seed and rows: one sample per seed."""
    out = None
    for s in seeds:
        part = sample(rows, n, key, s).withColumn("seed", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def ladder_sensitivity(profiles: DataFrame, budgets: list[int], seeds: list[int]) -> DataFrame:
    """seed, budget, buildings, sites, rows, anomalies, least_overlap (smallest Jaccard similarity with another seed's set of that budget),
    prefix (its buildings are those of the next smaller budget and more). profiles: building_id, site_id, rows, anomalies (a table of
    buildings)."""
    placed = None
    for s in seeds:
        order = profiles.withColumn("_p", priority(s, F.col("building_id"))).withColumn("position", F.row_number().over(Window.orderBy("_p", "building_id")) - 1).withColumn("seed", F.lit(s))
        placed = order if placed is None else placed.unionByName(order)
    chosen = placed.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).filter("position < budget")
    sums = chosen.groupBy("seed", "budget").agg(F.count("*").alias("buildings"), F.count_distinct("site_id").alias("sites"), F.sum("rows").alias("rows"), F.sum("anomalies").alias("anomalies"), F.collect_set("building_id").alias("_set"))
    x, y = sums.alias("x"), sums.alias("y")
    both = F.size(F.array_intersect("x._set", "y._set"))
    least = x.join(y, (F.col("x.budget") == F.col("y.budget")) & (F.col("x.seed") != F.col("y.seed"))).groupBy(F.col("x.seed").alias("seed"), F.col("x.budget").alias("budget")).agg(F.round(F.min(both / (F.size("x._set") + F.size("y._set") - both)), 6).alias("least_overlap"))
    before = F.lag("_set").over(Window.partitionBy("seed").orderBy("budget"))
    return sums.withColumn("prefix", F.coalesce(F.size(F.array_except(before, F.col("_set"))) == 0, F.lit(True))).drop("_set").join(least, ["seed", "budget"], "left")
