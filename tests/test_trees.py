"""Trees of all units at once against a plain booster, and against one split per unit."""

import math
import random

import pytest

from ohmflow.operators import metrics, models, trees

FEATURES = ["a", "b"]
EDGES = {"a": [0.2, 0.4, 0.6, 0.8], "b": [0.25, 0.5, 0.75]}


def plain_booster(rows, rounds, depth, symmetric, rate=0.5, ridge=1.0, least=5):
    """A function of a row (a, b) that gives the probability, grown on rows (a, b, y) one node at a time; None for one class."""
    pos, n = sum(r[2] for r in rows), len(rows)
    if pos in (0, n) or n < least:
        return None
    x = lambda r: [sum(e < (v if v is not None else -9) for e in EDGES[f]) for f, v in zip(FEATURES, r, strict=False)]
    base = round(math.log(pos / (n - pos)), 9)
    cells = [(x(r), r[2]) for r in rows]
    grown = []

    def leaf_of(splits, bins):
        node = 1
        for _ in range(depth):
            s = splits.get(node)
            node = 2 * node + bool(s and bins[s[0]] > s[1])
        return node

    def odds(bins):
        return base + sum(leaves.get(leaf_of(splits, bins), 0.0) for splits, leaves in grown)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-odds(b))) for b, _ in cells]
        g, h = [y - q for (_, y), q in zip(cells, p, strict=True)], [q * (1 - q) for q in p]
        splits = {}
        for level in range(depth):
            at, total = {}, {}
            for i, (bins, _) in enumerate(cells):
                node = 1
                for _ in range(level):
                    s = splits.get(node)
                    node = 2 * node + bool(s and bins[s[0]] > s[1])
                at.setdefault(node, []).append(i)
            for node, own in at.items():
                for f in range(2):
                    for c in range(4):
                        left = [i for i in own if cells[i][0][f] <= c]
                        if not symmetric and (len(left) < least or len(own) - len(left) < least):
                            continue
                        part = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)
                        gain = round(part(left) + part([i for i in own if i not in set(left)]) - part(own), 6)
                        key = (0 if symmetric else node, f, c)
                        total[key] = total.get(key, 0) + gain
            for owner in {k[0] for k in total}:
                gain, f, c = max((v, -k[1], -k[2]) for k, v in total.items() if k[0] == owner)
                if gain > 5e-7:
                    for node in [owner] if owner else range(2**level, 2 ** (level + 1)):
                        splits[node] = (-f, -c)
        sums = {}
        for i, (bins, _) in enumerate(cells):
            leaf = leaf_of(splits, bins)
            sums[leaf] = (sums.get(leaf, (0, 0))[0] + g[i], sums.get(leaf, (0, 0))[1] + h[i])
        grown.append((splits, {leaf: round(rate * a / (b + ridge), 9) for leaf, (a, b) in sums.items()}))
    return lambda r: 1 / (1 + math.exp(-odds(x(r))))


def planted(seed, units=6, each=90):
    """Units whose label depends on both features together, each in its own way; the last ones are tiny or of one class."""
    r = random.Random(seed)
    rows = []
    for u in range(units):
        for _ in range(each):
            a, b = r.random(), r.random()
            y = int(((a > 0.6) != (b > 0.5)) == (u % 2 == 0)) if r.random() < 0.93 else r.randint(0, 1)
            rows.append((len(rows), f"u{u}", "m", a if r.random() < 0.95 else None, b, y))
    rows += [(len(rows) + i, "one", "m", r.random(), r.random(), 0) for i in range(20)] + [(len(rows) + 50 + i, "tiny", "m", r.random(), r.random(), i % 2) for i in range(3)]
    return [*rows, (9000, None, "m", 0.5, 0.5, 1), (9001, "u0", "m", 0.1, 0.9, None), (9002, None, None, 0.5, 0.5, None)]


SCHEMA = "raw_index long, building string, meter string, a double, b double, y int"
LEVELS = [["building", "meter"], ["meter"]]


@pytest.mark.parametrize("symmetric", [False, True])
def test_equals_plain_boosters(spark, symmetric):
    rows = planted(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = trees.fit_units(df, LEVELS, FEATURES, EDGES, rounds=3, depth=2, symmetric=symmetric)
    got = {x.raw_index: (x.score, x.routed) for x in trees.score_units(df, found, LEVELS, FEATURES, EDGES).collect()}
    known = [r for r in rows if r[5] is not None]
    by = {u: plain_booster([r[3:] for r in known if r[1] == u and r[2]], 3, 2, symmetric) for u in {r[1] for r in rows} - {None}}
    coarse = plain_booster([r[3:] for r in known if r[2] == "m"], 3, 2, symmetric)
    assert by["one"] is None and by["tiny"] is None
    for i, u, m, a, b, _ in rows:
        own = by.get(u)
        want = (round((own or coarse)((a, b)), 6), 0 if own else 1) if m else (None, None)
        assert got[i][1] == want[1] and (want[0] is None and got[i][0] is None or abs(got[i][0] - want[0]) < 2e-6)


def test_better_than_one_split_and_the_same_on_other_partitions(spark):
    train, test = (spark.createDataFrame(planted(s, 8, 300), SCHEMA).filter("y is not null and building like 'u%'") for s in (5, 6))
    found = trees.fit_units(train, LEVELS, FEATURES, EDGES, rounds=4, depth=3)
    again = trees.fit_units(train.repartition(7, "a"), LEVELS, FEATURES, EDGES, rounds=4, depth=3)
    dump = lambda m: sorted((x.unit, x.n, x.pos, x.base, str(x.trees)) for x in m.collect())
    assert dump(found) == dump(again)
    scored = trees.score_units(test, found, LEVELS, FEATURES, EDGES, depth=3)
    area = metrics.roc_pr(scored, ["building"]).agg({"roc_auc": "min"}).first()[0]
    stump = models.route(test, models.unit_means(train, "building", "a"), models.unit_means(train, "meter", "a"), "building", "meter", "a")
    assert area > 0.85 > metrics.roc_pr(stump, ["building"]).agg({"roc_auc": "max"}).first()[0]


def test_jobs_do_not_grow_with_units(spark):
    seen = []
    for units in (2, 40):
        df = spark.createDataFrame(planted(3, units, 20), SCHEMA)
        tag = f"units-{units}"
        spark.sparkContext.setJobGroup(tag, tag)
        trees.fit_units(df, LEVELS, FEATURES, EDGES, rounds=1, depth=2)
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)))
    spark.sparkContext.setJobGroup("", "")
    assert seen[1] <= seen[0] + 3


def test_a_stored_symmetric_model_scores_as_columns(spark):
    df = spark.createDataFrame(planted(4), SCHEMA)
    edges = trees.default_edges(df, FEATURES, 4)
    assert all(len(e) == 3 for e in edges.values())
    model = trees.fit_units(df, [[]], FEATURES, edges, rounds=3, depth=3, symmetric=True)
    stored = model.first().asDict(recursive=True)
    both = trees.score_units(df, model, [[]], FEATURES, edges, depth=3).withColumn("s", trees.symmetric_score(stored, FEATURES, edges, 3))
    assert both.filter("abs(s - score) > 1e-9 or s is null").isEmpty()
    assert trees.fit_units(df.limit(0), LEVELS, FEATURES, edges).collect() == []
