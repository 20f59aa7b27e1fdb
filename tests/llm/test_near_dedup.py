"""Near-dedup against brute force."""

import random

import compare
import pytest

from ohmflow.llm import near_dedup

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    assert compare.differences(spark, compare.connect(SF), near_dedup.query, near_dedup.SQL, SF) == []


def brute(rows, size, percent):
    sets, parent = {}, {}
    for i, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_large_group_of_near_copies(spark, size):
    r = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 7)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))) for i in range(40)]
    rows += [(2000, ""), (2001, None), (2002, " \n "), (2003, "One"), (2004, "ONE"), (2005, "é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, size, 80).collect()}
    assert got == brute(rows, size, 80)


def test_edge_rows(spark):
    rows = [(None, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y"), (2, "a b c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)
    kept = near_dedup.deduplicate(df, 2, 80)
    assert kept.columns == df.columns and kept.count() == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).collect() == []


def test_long_paths_are_one_component(spark):
    """Paths in shuffled order of 1,000 nodes, rings, stars and a node linked to itself."""
    from ohmflow.llm import common

    r = random.Random(3)
    ids = r.sample(range(10**6), 1900)
    paths = [ids[:1000], ids[1000:1300], [*ids[1300:1400], ids[1300]]]
    links = [x for p in paths for x in zip(p, p[1:], strict=False)] + [(ids[1400], i) for i in ids[1401:1899]] + [(ids[1899], ids[1899])]
    wanted = {i: min(group) for group in (*paths, ids[1400:1899], ids[1899:]) for i in group}
    found = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(wanted) and {x.node: x.component for x in found} == wanted
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def boilerplate(n, seed=8):
    """Documents of sixty common and thirty own words; of every tenth one there is a near copy under a far id."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):
        own = [f"o{r.randrange(10**7)}" for _ in range(30)]
        rows.append((i, " ".join(common[:30] + own + common[30:])))
        if i % 10 == 0:
            own[r.randrange(30)] = "changed"
            rows.append((10**6 + i, " ".join(common[:30] + own + common[30:])))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_pairs_amid_common_text(spark, size):
    """Links that no centre of a bucket finds, since all its classes share their header and footer."""
    rows = boilerplate(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, size, 80).collect()}
    assert got == brute(rows, size, 80)
    assert sum(i != c for i, (_, c) in got.items()) == 15


def test_common_text_makes_no_square(spark):
    """Classes that share only their header and footer meet in no block."""
    rows = boilerplate(3000)
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    alone = source.selectExpr("doc_id as class_id", "doc_id as component")
    placed = near_dedup._by_prefixes(source, alone, 2, 80)
    met = placed.join(near_dedup._several(placed), "bucket").groupBy("bucket").count()
    assert met.agg({"count": "max"}).first()[0] < 20 and met.agg({"count": "sum"}).first()[0] < 20 * len(rows)
    near = [{x.class_id for x in g} for g in [placed.filter("class_id in (0, 1000000)").join(placed.filter("class_id in (0, 1000000)").groupBy("bucket").count().filter("count = 2"), "bucket").collect()]]
    assert near == [{0, 1000000}]
