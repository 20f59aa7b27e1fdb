"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of at least MIN_LENGTH key characters that are not plain words: a run of lower-case or capitalised words
joined by marks is left out unless it is assigned to a secret's name. The forest sees a candidate's length, its character transitions
(share of changes between letters, digits and marks, and the mean log probability of its letter pairs under the pairs of all
corpus words), its dictionary coverage (share of its letters inside words that stand at least LEAST_SEEN times in the corpus),
whether it looks like a path or an address, and its neighbouring words (hashed to a few cells). It is trained on labelled findings.

Words and letter pairs are counted over all texts. Pairs of a-z are at most 676 rows; words stay in Spark: the letter runs of distinct
values are cut into pieces, which are joined with the words.

Labelled findings are given as (value, secret). Where none are given they are derived: values in issued key formats or
assigned to a secret's name are positive, addresses, numbers and plain words negative; ambiguous values are left out. The forest is
fitted on a bounded sample (at most TRAIN_ROWS of each class, smallest hashes first).

Defined results: null and empty texts have no findings; null doc_ids are kept; repeated rows repeat their findings; very long texts
are scanned whole, and words in a letter run are sought in stretches of STRETCH letters; a score of exactly 0.5 is a secret; if the
labelled findings have one class only, every candidate gets its share of positives as score; extra columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, give_back, materialize

MIN_LENGTH = 12
TRAIN_ROWS = 3000
LEAST_SEEN = 3
#: Letters of the words that coverage looks for, and of one stretch of a letter run.
SHORTEST, LONGEST, STRETCH = 3, 24, 64
TREES, DEPTH = 30, 8
CELLS = 16
#: log2 probability of a letter pair that no word has.
NO_PAIR = -20.0
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-.@:=]{%d,}" % MIN_LENGTH)
_PLAIN = re.compile(r"\A[A-Z]?[a-z]*(?:[\-./_:@][A-Z]?[a-z]*)*\Z")
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\s*[=:]\s*[\"']?\Z")
_VALUE = re.compile(r"(?i)\A(?:[a-z_.\-]*[=:])?(.*?)[.:=]*\Z")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[a-z]{%d,}" % SHORTEST)

#: Formats in which providers issue keys.
FORMATS = re.compile(r"\A(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9a-zA-Z]{24,})\Z")
#: Addresses and numbers that are no secrets.
BENIGN = re.compile(r"\A(?:[\d.:+\-/]+|[^@\s]+@[^@\s]+\.[a-z]+|(?:https?:)?//\S*|(?:[a-z]+[\-_./])+[a-z0-9]*\d{1,4}|\d{4}-\d{2}-\d{2}\S*)\Z")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, before: list[str], after: list[str], pairs: dict[str, float]) -> list[float]:
    """All features but the dictionary coverage."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    low = value.lower()
    steps = [pairs.get(low[i : i + 2], NO_PAIR) for i in range(n - 1) if low[i : i + 2].isalpha()]
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    near = [0.0] * CELLS
    for side, group in enumerate((before, after)):
        for w in group:
            near[(int(hashlib.md5(f"{side}{w}".encode()).hexdigest(), 16)) % CELLS] += 1.0
    return [float(n), changes, float(np.mean(steps)) if steps else 0.0, entropy, sum(k == 0 for k in kinds) / n, sum(k == 2 for k in kinds) / n, float("/" in value), float("@" in value), float(value.count(".")), *near]


def letter_runs(value: str) -> list[str]:
    """A value's letter runs in lower case, in stretches of STRETCH letters."""
    return [run[i : i + STRETCH] for run in _LETTERS.findall(value.lower()) for i in range(0, len(run), STRETCH)]


def find(text: str) -> list[tuple[int, int, bool]]:
    """Start and end of each candidate's value, and whether it is assigned to a secret's name."""
    out = []
    for m in _CANDIDATE.finditer(text):
        body = _VALUE.match(m.group(0))
        start, end = m.start() + body.start(1), m.start() + body.end(1)
        if end - start < MIN_LENGTH:
            continue
        named = bool(_NAMED.search(text[max(0, start - 24) : start]))
        if named or not _PLAIN.match(text[start:end]):
            out.append((start, end, named))
    return out


def derived_label(value: str, named: bool) -> int | None:
    if FORMATS.match(value) or (named and not BENIGN.match(value)):
        return 1
    return 0 if BENIGN.match(value) else None


def _scan(shared):
    def run(batches):
        pairs = shared.value
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for start, end, named in find(text or ""):
                    value = text[start:end]
                    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-2:]]
                    after = [w.lower() for w in _WORD.findall(text[end : end + 40])[:1]]
                    rows.append((doc_id, start, end - start, hashlib.sha256(value.encode()).hexdigest(), derived_label(value, named), letter_runs(value), sum(c.isalpha() for c in value), features(value, before, after, pairs)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "value_sha256", "derived", "runs", "letters", "features"])
            yield out.astype({"doc_id": "Int64", "derived": "Int32"})
        give_back()

    return run


def corpus_words(texts: DataFrame) -> DataFrame:
    """word, n: counts of all words of a-z, over whole texts of all rows."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.filter(F.col("word").rlike(r"\A[a-z]{2,}\z")).groupBy("word").agg(F.count("*").alias("n"))


def pair_logs(words: DataFrame) -> dict[str, float]:
    """log2 probabilities of letter pairs in all words: at most 676 rows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counts = {r["pair"]: r["n"] for r in words.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values()) or 1
    return {p: math.log2(n / total) for p, n in counts.items()}


def covered_letters(found: DataFrame, words: DataFrame) -> DataFrame:
    """value_sha256, covered: the letters of each distinct value that lie in a word of the dictionary."""
    spread = found.groupBy("value_sha256").agg(F.first("runs").alias("runs")).select("value_sha256", F.explode("runs").alias("run"))
    starts = spread.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.length("run") - SHORTEST + 1)).alias("at")).filter("at > 0")
    pieces = starts.select("run", "at", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("run") - F.col("at") + 1))).alias("size")).filter(f"size >= {SHORTEST} and at + size - 1 <= length(run)")
    hits = pieces.withColumn("word", F.expr("substring(run, at, size)")).join(words.filter(F.col("n") >= LEAST_SEEN).select("word"), "word", "left_semi")
    spots = F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("at", "size")), lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    return spread.join(hits.groupBy("run").agg(F.size(spots).alias("covered")), "run").groupBy("value_sha256").agg(F.sum("covered").alias("covered"))


def training_sample(known: DataFrame, rows: int) -> pd.DataFrame:
    """At most `rows` findings of each class by the smallest hashes; a threshold on the hash comes first, so that tasks send few more."""
    sizes = {r["secret"]: r["n"] for r in known.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    low = F.conv(F.substring("value_sha256", 1, 8), 16, 10).cast("long")
    parts = [known.filter((F.col("secret") == c) & (low < int(2**32 * min(1.0, 1.5 * rows / max(1, sizes.get(c, 0)))))).orderBy("value_sha256").limit(rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).toPandas().sort_values("value_sha256")


def scan(docs: DataFrame, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, start, length, value_sha256, score, secret: all candidates; secret where the forest finds it likelier than not. Values
    themselves are not returned. labelled: (value_sha256, secret 0/1) findings."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = materialize(corpus_words(texts), "words")
    shared = spark.sparkContext.broadcast(pair_logs(words))
    seen = materialize(texts.mapInPandas(_scan(shared), "doc_id long, start int, length int, value_sha256 string, derived int, runs array<string>, letters int, features array<double>"), "candidates")
    covered = covered_letters(seen, words)
    share = F.coalesce(F.col("covered"), F.lit(0)) / F.greatest(F.col("letters"), F.lit(1))
    found = materialize(seen.join(covered, "value_sha256", "left").select("doc_id", "start", "length", "value_sha256", "derived", F.concat("features", F.array(share)).alias("features")), "findings")
    drop_scratch(words, seen)
    known = found.withColumn("secret", F.col("derived")) if labelled is None else found.join(labelled.select("value_sha256", "secret").dropDuplicates(["value_sha256"]), "value_sha256")
    known = known.filter("secret is not null").select("value_sha256", "secret", "features").dropDuplicates(["value_sha256"])
    sample = training_sample(known, rows)
    positives = float(sample["secret"].mean()) if len(sample) else 0.0
    if positives in (0.0, 1.0):
        scored = found.withColumn("score", F.lit(positives))
    else:
        train = spark.createDataFrame(sample).withColumn("vector", array_to_vector("features")).withColumn("secret", F.col("secret").cast("double")).coalesce(1)
        model = RandomForestClassifier(featuresCol="vector", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(train)
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "length", "value_sha256", "score", (F.col("score") >= 0.5).alias("secret"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
