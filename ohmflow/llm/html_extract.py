"""Main text of web pages by boosted trees over the nodes of a page.

A page is read into a tree of block elements whose leaves are runs of text (html_tree). Each node has features of its subtree (size,
density of links, tags and stops), its attribute words and those above it, its depth and its siblings. Gradient-boosted trees score
every node as article or not. Decoding is over the whole tree: the kept nodes are the set of largest total score in which a node
stands only with all its ancestors, so no text is kept out of a rejected section and no section is kept for nothing.

No table says which nodes are article, so labels come from markup and from layouts: a bounded sample of the given pages, labelled by
their own semantic elements where they have any, and texts of these pages set into random layouts whose parts are known
(html_templates). The model is a few thousand numbers, fitted in the driver on at most TRAIN_NODES nodes, and goes with the task; pages are
one pass without a shuffle. Each page is read whole.

Defined results: null and empty pages, and pages without article, have the text ''; broken markup is read as far as it goes; very long
pages are read whole, at some 20 bytes of memory a byte of markup for the one page at hand; null page_ids and repeated rows are results of
their own, the same for the same page; scores that tie (0) are rejected; extra columns are passed by, but text and n_chars are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back
from .html_templates import KINDS, layout
from .html_tree import Node, in_order, parse

#: Bounds of training: pages sampled (those of the lowest hashes), bytes of one, layouts for each, nodes.
SAMPLE_PAGES, SAMPLE_BYTES, LAYOUTS, TRAIN_NODES = 150, 65_536, 4, 24_000
TREES, DEPTH, BINS, RATE, RIDGE = 40, 5, 24, 0.25, 1.0
#: Nodes that a task scores together.
FLUSH = 20_000
#: Elements by what they say of their content.
TAGS = {
    "menu": {"nav", "menu"}, "head": {"header"}, "foot": {"footer"}, "side": {"aside"}, "form": {"form", "button", "label", "select", "option", "fieldset", "legend", "search", "dialog"}, "content": {"article", "main"},
    "title": {"h1", "h2", "h3", "h4", "h5", "h6"}, "para": {"p", "blockquote", "pre"}, "list": {"ul", "ol", "li", "dl", "dt", "dd"}, "table": {"table", "tr", "td", "th", "tbody", "thead"},
}
_KIND = {w: k for k, words in KINDS.items() for w in words.split()}
_TAG = {t: k for k, tags in TAGS.items() for t in tags}
_FLAGS = {k: i for i, k in enumerate([*(f"<{k}" for k in TAGS), *KINDS])}
_STOPS = ".,;:!?…。，"


def _flags(node: Node) -> int:
    """Kinds of a node's element and attribute words, as bits."""
    return sum(1 << i for i in {_FLAGS[f"<{_TAG[node.tag]}"] if node.tag in _TAG else None, *(_FLAGS.get(_KIND.get(t)) for t in node.tokens)} - {None})


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node of in_order()."""
    index = {id(n): i for i, n in enumerate(nodes)}
    up = [index[id(n.parent)] if n.parent else 0 for n in nodes]
    leaves, stops, words = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if not n.tag:
            leaves[i], words[i], stops[i] = 1, n.text.count(" ") + 1, sum(map(n.text.count, _STOPS))
        if i:
            leaves[up[i]] += leaves[i]
            words[up[i]] += words[i]
            stops[up[i]] += stops[i]
    beside: list[tuple] = [(0, 1, None, None, 1)] * len(nodes)  # place, siblings, the ones before and after, those of the same element
    for n in nodes:
        own = [c for c in n.children if c.chars]
        alike = Counter(c.tag for c in own)
        for k, c in enumerate(own):
            beside[index[id(c)]] = k, len(own), own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None, alike[c.tag]
    said, above, rows, before = [], [], [], 0
    size = lambda x: math.log1p(x.chars) if x else -1.0
    dense = lambda x: x.link_chars / x.chars if x else -1.0
    for i, n in enumerate(nodes):
        said.append(_flags(n) if n.tag else said[up[i]])
        above.append(said[i] | above[up[i]] if i else said[i])
        place, siblings, last, later, alike = beside[i]
        rows.append((
            size(n), dense(n), math.log1p(words[i] / leaves[i]), stops[i] / words[i], math.log1p(n.chars / (n.tags + 1)), n.links / words[i], n.depth, math.log1p(leaves[i]), place / siblings, math.log1p(siblings),
            before / nodes[0].chars, n.chars / nodes[0].chars, n.chars / nodes[up[i]].chars, size(last), size(later), dense(last), dense(later), alike / siblings, dense(n.parent), not n.tag,
        ))
        if not n.tag:
            before += n.chars
    bits = np.array([(a, b) for a, b in zip(said, above, strict=True)], dtype=np.int64)
    flags = bits[:, :, None] >> np.arange(len(_FLAGS)) & 1
    return np.hstack([np.array(rows, dtype=np.float32), flags.reshape(len(nodes), -1).astype(np.float32)])


class Trees:
    """Gradient-boosted trees of one depth over binned features: logistic loss, splits by gain of second-order sums."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
        n, width = binned.shape
        base = float(np.clip(y.mean(), 0.01, 0.99))
        self.start = math.log(base / (1 - base))
        score = np.full(n, self.start)
        self.split, self.cut, self.leaf = np.zeros((TREES, 2**DEPTH), np.int32), np.full((TREES, 2**DEPTH), np.inf, np.float32), np.zeros((TREES, 2**DEPTH))
        flat = binned + np.arange(width) * BINS
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = y - p, p * (1 - p)
            node = np.ones(n, np.int64)
            for level in range(DEPTH):
                first, count = 2**level, 2**level
                cell = ((node - first)[:, None] * (width * BINS) + flat).ravel()
                sums = [np.bincount(cell, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS) for v in (gradient, curve)]
                g, h = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
                all_g, all_h = (s[:, :1].sum(axis=2, keepdims=True) for s in sums)
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                best = gain.reshape(count, -1).argmax(axis=1)
                for k in range(count):
                    f, b = divmod(int(best[k]), BINS - 1)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        self.split[t, first + k], self.cut[t, first + k] = f, cuts[f][b]
                node = 2 * node + (x[np.arange(n), self.split[t, node]] > self.cut[t, node])
            leaf = node - 2**DEPTH
            self.leaf[t] = RATE * np.bincount(leaf, gradient, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + RIDGE)
            score += self.leaf[t, leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node is article."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + (x[rows, split[node]] > cut[node])
            out += leaf[node - 2**DEPTH]
        return out


def decoded(nodes: list[Node], scores: np.ndarray) -> list[str]:
    """Texts of the leaves in the best set of nodes that holds each node's ancestors."""
    index = {id(n): i for i, n in enumerate(nodes)}
    best = scores.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[index[id(nodes[i].parent)]] += best[i]
    kept, out = [False] * len(nodes), []
    for i, n in enumerate(nodes):
        kept[i] = best[i] > 0 and (i == 0 or kept[index[id(n.parent)]])
        if kept[i] and not n.tag:
            out.append(n.text)
    return out


def labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for the leaves of the article and what holds them: by data-keep where a page says so, else by semantic elements; None for a page with
    neither."""
    index = {id(n): i for i, n in enumerate(nodes)}
    out, inside, marked = np.zeros(len(nodes)), [], False
    for n in nodes:
        up = inside[index[id(n.parent)]] if n.parent else False
        keep = next((t[5:] for t in n.tokens if t.startswith("keep=")), None)
        kind = _TAG.get(n.tag)
        now = keep == "1" if keep else True if kind == "content" and not inside_rejected(n) else False if kind in ("menu", "head", "foot", "side", "form") else up
        marked |= keep is not None or kind == "content"
        inside.append(now)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if not n.tag:
            out[i] = inside[i]
        if out[i] and i:
            out[index[id(n.parent)]] = 1
    return out if marked else None


def inside_rejected(node: Node) -> bool:
    """Whether something above is no article by its element or names (a comment may be an article element)."""
    wrong = ("menu", "side", "foot", "comment", "ad", "form")
    while node := node.parent:
        if _TAG.get(node.tag) in wrong or any(_KIND.get(t) in wrong for t in node.tokens):
            return True
    return False


def training(pages: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of these pages and of layouts with their texts."""
    r = random.Random(seed)
    trees = [in_order(parse(p)) for p in pages]
    texts = [n.text for nodes in trees for n in nodes if not n.tag] or ["no text"]
    given = [x for nodes in trees if nodes and (y := labels(nodes)) is not None for x in [(features(nodes), y)]]
    made = []
    for _ in range(LAYOUTS * max(len(trees), 20)):
        article = [r.choice(texts) for _ in range(r.randint(1, 12))]
        nodes = in_order(parse(layout(r, texts, [" ".join(t.split()[: r.randint(1, 120)]) for t in article])))
        made.append((features(nodes), labels(nodes)))
    mixed = [*given, *made]
    r.shuffle(mixed)
    x, y = (np.concatenate(c) for c in zip(*mixed, strict=True))
    return x[:TRAIN_NODES], y[:TRAIN_NODES]


def fit(pages: DataFrame) -> Trees:
    """The model from a bounded sample of these pages: those of the lowest hashes of their markup, up to SAMPLE_BYTES each."""
    some = pages.select("html", F.xxhash64("html").alias("_h")).filter(F.octet_length("html") <= SAMPLE_BYTES)
    # first hashes alone, so that tasks send no pages that others' pages push out
    least = [r["_h"] for r in some.select("_h").distinct().orderBy("_h").limit(SAMPLE_PAGES).collect()]
    sample = some.filter(F.col("_h").isin(least)).groupBy("_h").agg(F.min("html").alias("html")).orderBy("_h")
    return Trees(*training([r.html for r in sample.collect()]))


def _texts(model: Trees):
    def run(batches):
        for batch in batches:
            found: list[str] = []
            waiting: list[list[Node]] = []
            held = 0

            def scored(waiting=waiting, found=found):
                full = [features(nodes) for nodes in waiting if nodes]
                scores = iter(np.split(model.score(np.concatenate(full)), np.cumsum([len(f) for f in full])[:-1]) if full else ())
                found.extend("\n\n".join(decoded(nodes, next(scores))) if nodes else "" for nodes in waiting)
                waiting.clear()

            for page in batch.column(batch.schema.get_field_index("html")):
                waiting.append(in_order(parse(page.as_py() or "")))
                held += len(waiting[-1])
                if held >= FLUSH:
                    scored()
                    held = 0
            scored()
            text = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text, pa.array([len(t) for t in found], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])
        give_back()

    return run


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """The rows of pages with text, the article's blocks joined by empty lines, and n_chars, its code points."""
    source = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    schema = StructType(source.schema.fields + StructType.fromDDL("text string, n_chars long").fields)
    return source.mapInArrow(_texts(model or fit(source)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).drop("html")
