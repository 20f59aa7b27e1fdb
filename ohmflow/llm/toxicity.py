"""A toxicity classifier with counterfactual regularisation.

A logistic model over hashed words and word beginnings of whole texts. Labelled texts are parted into sentences; for every
sentence that holds identity terms, copies with the terms swapped for those of other groups are made, and the loss adds the
squared change of the score between a sentence and its copies, so a group's name alone does not move the score.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, smallest hashes first; rows with
crc32(doc_id) mod FOLDS = 0 are never read for it); all documents are scored, in tasks, with a weight vector of fixed size.

Defined results: null and empty texts are scored by the model's bias, like any text without words; null doc_ids are scored
and count as not held out; repeated rows get equal scores; labels that are null or occur with both values for a document
are left out; without labelled rows every score is 0; very long texts are scored whole, word by word; a score of exactly 0.5 is a 1;
extra columns are passed by, whatever their names, except that score() replaces score and predicted; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back

FOLDS = 5
TRAIN_ROWS = 6_000
BITS = 20
PREFIXES = (4, 5)
#: Weight of the score change between a sentence and its counterfactual copies.
PENALTY = 1.0
#: Pull of every weight towards 0. Weights are not negative: evidence of harm in a long text is not outweighed by the rest of it.
SPARSE = 1e-4
ROUNDS = 80
#: Words whose share a worker remembers; later ones are worked out anew. Only speed depends on it.
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\n]+")

#: Identity terms, by attribute; terms of one attribute are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "elderly", "young"),
)
_GROUP = {term: group for group in IDENTITY for term in group}


def word_ids(word: str) -> list[int]:
    """Feature numbers of one word: the word and its first letters."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"w" + word.encode()) & mask] + [zlib.crc32(b"%d" % n + word[:n].encode()) & mask for n in PREFIXES if len(word) > n]


def vocabulary(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def counterfactuals(sentence: set[str]) -> list[set[str]]:
    """A sentence's words with its identity terms swapped: one copy for each step round the groups, two at most."""
    terms = [w for w in sentence if w in _GROUP]
    if not terms:
        return []
    swap = lambda w, k: _GROUP[w][(_GROUP[w].index(w) + k) % len(_GROUP[w])]
    return [(sentence - set(terms)) | {swap(w, k) for w in terms} for k in (1, 2)]


def swapped_sentences(texts: list[str | None]) -> tuple[list[set[str]], list[set[str]]]:
    """The words of all sentences with identity terms, once for each copy, and those of the copies."""
    origins, copies = [], []
    for text in texts:
        for sentence in map(vocabulary, _SENTENCE_END.split(text or "")):
            made = counterfactuals(sentence)
            copies += made
            origins += [sentence] * len(made)
    return origins, copies


class Rows:
    """Feature lists of word sets, for products with a weight vector."""

    def __init__(self, sets):
        known: dict[str, array] = {}
        columns, counts = array("i"), array("i")
        for words in sets:
            before = len(columns)
            for w in sorted(words):
                if w not in known:
                    known[w] = array("i", word_ids(w))
                columns.extend(known[w])
            counts.append(len(columns) - before)
        self.n = len(counts)
        self.columns = np.frombuffer(columns, dtype=np.int32) if columns else np.zeros(0, np.int32)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), np.frombuffer(counts, dtype=np.int32) if counts else 0)

    def keep(self, columns: np.ndarray, width: int) -> None:
        """Leaves only these columns, numbered from 0."""
        place = np.full(width, -1, dtype=np.int32)
        place[columns] = np.arange(len(columns), dtype=np.int32)
        at = place[self.columns]
        self.columns, self.rows = at[at >= 0], self.rows[at >= 0]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.rows], minlength=width)


def fit(texts: list[str | None], labels: list[int], penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps (Adam) on log loss + SPARSE * weights + penalty * mean squared score change."""
    width = 1 << BITS
    if not texts:
        return np.zeros(width), -math.inf
    y = np.array(labels, dtype=float)
    x = Rows(map(vocabulary, texts))
    # features of fewer than two documents are noise; the others are numbered anew
    seen = np.flatnonzero(np.bincount(x.columns, minlength=width) >= 2)
    x.keep(seen, width)
    origin, other = map(Rows, swapped_sentences(texts))
    origin.keep(seen, width)
    other.keep(seen, width)
    full, width = width, len(seen)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, min(0.5 / share, 3.0), 1.0)
    weight /= weight.sum()
    w, b = np.zeros(width), math.log(share / (1 - share))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = x.times(w) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = x.back(g, width) + SPARSE
        if origin.n:
            change = (origin.times(w) - other.times(w)) * (2 * penalty / origin.n)
            grad += origin.back(change, width) - other.back(change, width)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        rate = 0.08 * (1 - 0.5 * t / rounds)
        w = np.maximum(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6), 0)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    weights = np.zeros(full)
    weights[seen] = w
    return weights, b


class Scorer:
    """Scores texts; a word's share is worked out once and remembered, up to a fixed number of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        if self.bias == -math.inf:
            return 0.0
        known, total = self.known, self.bias
        if len(known) > REMEMBERED:
            known.clear()
        # in sorted order, so that equal texts get bit-equal sums in any process
        for w in sorted(vocabulary(text)):
            share = known.get(w)
            if share is None:
                share = known[w] = float(self.weights[word_ids(w)].sum())
            total += share
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """The model, from a bounded sample of labelled documents outside the held-out fold."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("marked")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).filter("toxic = top").drop("top")
    marks = marks.filter(~held_out(F.col("marked"))).orderBy(F.xxhash64("marked"), "marked").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("marked")).orderBy("doc_id", F.xxhash64("text")).select("text", "toxic").limit(rows)
    found = sample.toArrow()
    model = fit(found.column("text").to_pylist(), found.column("toxic").to_pylist(), penalty)
    del found
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs and score, predicted, under these names."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 2^BITS floats, whatever the data

    @F.pandas_udf("double")
    def scored(parts: pd.Series) -> pd.Series:
        scorer = Scorer(*shared.value)
        out = pd.Series([scorer.score(t) for t in parts], dtype="float64")
        del scorer
        give_back()
        return out

    return docs.withColumn(names[0], scored(F.col("text").cast("string"))).withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    likely, toxic = fresh(docs, "toxic_score", "is_toxic")
    return score(docs, train(docs, labels), (likely, toxic)).filter(F.col(toxic) == 0).drop(likely, toxic)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
