"""Top-k, license scans and decontamination: SQL, brute force and edge rows."""

import math

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmflow.llm import decontam, license_scan, topk

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("module", [topk, license_scan, decontam])
def test_query_equals_sql(spark, module):
    assert compare.differences(spark, compare.connect(SF), module.query, module.SQL, SF) == []


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (50, [0.0, -1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 3, 32768), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    repeated = topk.quantised(spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [2.0, 1.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (11, [3e38, 1.0])], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(repeated, repeated.filter("vec_id % 50 = 0"), 3).collect())
    # each of the three query rows has its own results, in which the other rows of its id may stand; 3e38 takes part, beyond a long
    most = 2**63 - 1
    same = [(50, 1, 11, most), (50, 2, 7, 131072), (50, 3, 50, 65536)]
    assert got == sorted([*same, *same, (50, 1, 7, 131072), (50, 2, 11, 131072), (50, 3, 9, 65536)])
    empty = topk.quantised(df.limit(0))
    assert topk.top_k(empty, empty).collect() == []


def test_top_k_of_large_components(spark):
    """Finite components of any size take part, ranked by exact products."""
    r = np.random.default_rng(3)
    made = np.concatenate([r.normal(0, s, (60, 6)) for s in (1, 1e3, 6e5, 1e9, 1e17, 1e30)]).astype(np.float32)
    r.shuffle(made)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(50, [600000.0] * 6), (51, [-3e38] * 6), (52, [3e38] * 6), (53, [3.1e38] * 6)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect())
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows]
    want = []
    for at, (q, e) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for k, (i, f) in enumerate(whole) if k != at)[:5]
            want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_pivots_leave_clusters_out():
    """On clustered vectors most candidates of other clusters are left without an evaluation, and results stay exact."""
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (40, 16))
    x = np.floor(256 * (np.repeat(centres, 100, axis=0) + r.normal(0, 0.05, (4000, 16))))
    r.shuffle(x)
    ids, q = np.arange(4000), x[::50]
    pivots = topk.choose_pivots(x[:2000], topk.PIVOTS)
    least = topk.thresholds(q, x[:2000], 6)
    at, hit, score, evaluated = topk.search_block(q, topk.distances(q, pivots), ids, x, topk.distances(x, pivots), 6, least)
    assert evaluated < 0.5 * len(q) * len(x)
    products = (q @ x.T).astype(np.int64)
    for i in range(len(q)):
        assert [s for a, s in zip(at, score, strict=True) if a == i] == sorted(products[i].tolist(), reverse=True)[:6]


def test_licenses(spark):
    rows = [
        (1, "Under the MIT license, Under-The mit LICENSE"),
        (2, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"),
        (3, None),
        (4, ""),
        (5, "cc by ncé cc.by,nc apache license version 2"),
        (None, "Released under the MIT License."),
        (6, "licensed under cc by 4 0 international attribution"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(9))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(df).collect()}
    assert got[1] == (8, 2, 0, 4, "mit", "mit")
    assert got[2] == (14, 0, None, None, "", "gpl-3")
    assert got[3] == got[4] == (0, 0, None, None, "", "")
    assert got[5] == (10, 2, 3, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert got[None] == (5, 1, 1, 1, "mit", "mit")
    assert got[6][5] == "cc-by"
    assert license_scan.scan(df.limit(0)).collect() == []


def test_license_blocks(spark):
    """Blocks are stretches of words whatever the lines; words that are scattered over a text are none."""
    words = license_scan.TEMPLATES[14][1].split()
    wrap = lambda w, n: "\n * ".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    filler = " ".join(f"x{i}" for i in range(500))
    rows = [
        (1, "A\n/*\n * " + wrap([w.upper() for w in words], 9) + "\n */ code"),
        (2, filler + " " + wrap(words[:-4], 7) + " " + filler),
        (3, " ".join(f"{w} {filler}" for w in ("released", "under", "the", "mit", "license"))),
        (4, "released under the m\u0130t license or wor\u212a"),
        (5, "the mit license, released (as ever) under a"),
        (6, " ".join(words[:20])),
        (6, "  Under the MIT License  "),
    ]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[4] for g in got] == ["mit", "mit", "", "", "mit", "mit", "mit"] and got[5][1:4] == (4, 1, 0)


def test_leaks_tolerate_substitutions(spark):
    item = [f"q{i}" for i in range(30)]
    changed = list(item)
    for i in (4, 13, 22):
        changed[i] = "zz"
    rows = [(1, "a b " + " ".join(item) + " c"), (2, "x " + " ".join(changed)), (3, " ".join(item[:6])), (4, None), (5, ""), (6, " ".join(reversed(item))), (None, "A " + " ".join(item).upper()), (7, " ".join(item[10:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1): 30, (2, 1): 21, (None, 1): 30, (7, 1): 20}
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontam.leaks(docs.limit(0), bench).collect() == []
    assert decontam.leaks(docs, bench.limit(0)).collect() == []


def test_a_benchmark_too_large_for_broadcast_gives_the_same(spark, monkeypatch):
    # items 6 and 7 share a text, and one passage of item 0 stands in every document
    bench = spark.createDataFrame([(i, " ".join(f"i{min(i, 6)}w{k}" for k in range(20))) for i in range(8)] + [(8, "short"), (9, None)], "item_id long, text string")
    docs = bench.select((F.col("item_id") + 100).alias("doc_id"), F.concat_ws(" ", "text", F.lit("it says"), F.expr("transform(sequence(3, 15), k -> if(k = 9, 'zz', 'i0w' || k))"), F.lit("word " * 3000)).alias("text"))
    docs = docs.union(docs.limit(1)).unionByName(spark.createDataFrame([(None, "x"), (200, None)], "doc_id long, text string"))
    whole = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 40)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == whole and len(whole) == 7 + 10 + 2
