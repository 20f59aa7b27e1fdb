"""HTML extraction: articles of all given pages, held-out layouts, decoding, parsing and edge rows."""

import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmflow.llm import html_extract, html_templates, html_tree

SF = "/root/testdata/sf0.01"


def article(page):
    """Blocks of the given pages' article element, by expressions that know how these pages are written."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.Trees(*html_extract.training([p.html for p in pages[:150]]))


def blocks(model, page):
    nodes = html_tree.in_order(html_tree.parse(page))
    return html_extract.decoded(nodes, model.score(html_extract.features(nodes))) if nodes else []


def test_query_gives_every_article(spark, pages):
    got = {r.page_id: r for r in html_extract.query(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert (got[p.page_id].url, got[p.page_id].text) == (p.url, article(p.html))
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_held_out_layouts(model, pages):
    """Menus, side columns, notices, forms, adverts and comments of layouts that were not learned from, with texts of other pages."""
    r = random.Random(77)
    texts = [n.text for p in pages[150:] for n in html_tree.in_order(html_tree.parse(p.html)) if not n.tag]
    hit = kept = wanted = 0
    for _ in range(150):
        nodes = html_tree.in_order(html_tree.parse(html_templates.layout(r, texts, [" ".join(r.choice(texts).split()[: r.randint(1, 120)]) for _ in range(r.randint(1, 12))])))
        got = Counter(html_extract.decoded(nodes, model.score(html_extract.features(nodes))))
        want = Counter(n.text for n, y in zip(nodes, html_extract.labels(nodes), strict=True) if y and not n.tag)
        size = lambda c: sum(len(t) * n for t, n in c.items())
        hit, kept, wanted = hit + size(got & want), kept + size(got), wanted + size(want)
    assert hit / kept > 0.95 and hit / wanted > 0.95


def test_a_page_of_all_kinds(model):
    text = "A long sentence of the story, with stops and commas, that goes on for some time. " * 4
    page = f"""<!doctype html><html><head><title>T</title><style>p > a {{}}</style></head><body>
      <header class=site-header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
      <div id="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
      <main><article><h1>The&nbsp;story &amp; more</h1><p>{text}<p>Second <b>bold</b>&#32;part &lt;b&gt;<br>here
      <script>if (a < b) document.write("<p>no</p>")</script><!-- <p>no</p> --></p><div class="advert">Buy now</div><p>{text}</article></main>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other story</a></ul></aside>
      <section class="comments"><h3>Comments</h3><div class=comment><p>Nice, thanks.</p></div></section>
      <form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer>"""
    assert blocks(model, page) == ["The story & more", text.strip(), "Second bold part <b> here", text.strip()]


def test_parsing():
    tree = lambda page: [(n.tag, n.text) for n in html_tree.in_order(html_tree.parse(page))]
    assert tree("") == tree("<p> </p><div></div>") == []
    assert tree("a<b>b</b> c") == [("html", ""), ("", "ab c")]
    assert tree("<p>a<p>b") == tree("<p>a</p><p>b</p>") == [("html", ""), ("p", ""), ("", "a"), ("p", ""), ("", "b")]
    assert tree("<ul><li>a<ul><li>b</ul><li>c</ul>d") == [("html", ""), ("ul", ""), ("li", ""), ("", "a"), ("ul", ""), ("li", ""), ("", "b"), ("li", ""), ("", "c"), ("", "d")]
    assert tree("1 < 2 &amp;&am; &#x41; <!-- x <p> --> <a title='>'>q</a> <!-- open") == [("html", ""), ("", "1 < 2 &&am; A q")]
    assert tree("<script>x</script><SCRIPT>y</Script >z<style>open") == [("html", ""), ("", "z")]
    assert tree("<div>a</p></span>b</div></div>c") == [("html", ""), ("div", ""), ("", "a"), ("", "b"), ("", "c")]
    assert [n.depth for n in html_tree.in_order(html_tree.parse("<div><div><p>a"))] == [0, 1, 2, 3, 4]


def test_decoding_is_the_best_set_with_all_ancestors():
    r = random.Random(5)
    for _ in range(60):
        root = html_tree.Node("html", None)
        made = [root]
        for i in range(r.randint(1, 9)):
            up = r.choice([n for n in made if n.tag])
            made.append(html_tree.Node("div" if r.random() < 0.5 else "", up, text=f"t{i}"))
        nodes = html_tree.in_order(root)
        scores = np.array([r.uniform(-3, 3) for _ in nodes])
        parent = [nodes.index(n.parent) if n.parent else None for n in nodes]
        best, choice = 0.0, ()
        for bits in itertools.product((0, 1), repeat=len(nodes)):
            if all(not b or parent[i] is None or bits[parent[i]] for i, b in enumerate(bits)):
                total = sum(s for s, b in zip(scores, bits, strict=True) if b)
                if total > best:
                    best, choice = total, bits
        assert html_extract.decoded(nodes, scores) == [n.text for n, b in zip(nodes, choice, strict=False) if b and not n.tag]


def test_edge_rows(spark, model):
    long = "<article>" + "<p>Words of a long page, which has many blocks, one after the other.</p>" * 20_000 + "</article>"
    rows = [(None, None), (1, ""), (2, "   "), (3, "<nav><a href=x>y</a></nav>"), (4, "<p"), (5, "</div></p>"), (6, "<article><p>Same text of an article, twice.</p></article>"), (6, "<article><p>Same text of an article, twice.</p></article>"), (7, long), (8, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("Text", F.lit(3)).withColumn("score", F.lit(1))
    out = html_extract.extract(df, model)
    assert out.columns == ["page_id", "html", "url", "score", "text", "n_chars"]
    got = sorted(((r.page_id, r.text) for r in out.collect()), key=repr)
    assert len(got) == len(rows)
    found = {k: t for k, t in got}
    assert found[None] == found[1] == found[2] == found[3] == ""
    assert got.count((6, "Same text of an article, twice.")) == 2
    assert found[7].count("\n\n") == 19_999
    assert html_extract.extract(df.limit(0)).collect() == []
