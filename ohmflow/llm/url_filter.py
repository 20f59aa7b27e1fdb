"""URL filters: rules by host and path, and a classifier over segmented names for the URLs that no rule fits.

Letter runs of a host's names, such as "newsreport", are split into words by a unigram model: of all splits, the Viterbi path with
the highest product of word probabilities wins; unknown pieces pay for each letter. Host and path words then go into a
multinomial naive Bayes model, whose two classes are the URLs that the rules allow and block. Words that the rules themselves
test (and the last host label) are no evidence of their own and left out, so the model does not just repeat the rules.

All word counts are over whole texts of all rows, and stay in Spark: distinct host names are cut into pieces, which are joined
with the counts, so a task holds the pieces of one name. Class counts are over all rows that a rule fits, by token hashed to one of
BUCKETS cells, so that every token counts and what tasks hold has a fixed size.

Defined results: a null URL, or one without "://", has an empty host and path, which no rule fits and the prior judges;
a letter run of more than LONGEST_NAME letters (no valid host label) is one word; repeated rows are judged alike; null page_ids are
kept; where the rules fit no row, both classes are equally likely, and ties are allowed; tokens that no ruled row has add nothing;
very long URLs are read whole; extra columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

LONGEST_WORD = 24
LONGEST_NAME = 63
#: log10 price of an unknown piece: this, and once more for each letter.
UNKNOWN = -2.0
#: Cells of the class counts.
BUCKETS = 1 << 20

#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_PART = r"\p{L}+|\p{N}+"


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(ascii_lower(raw), F.lit(""))).withColumn("path", F.coalesce(tail, F.lit("")))


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled: the longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return df.withColumn("rule", name).withColumn("ruled", verdict)


def rule_words(rules=RULES) -> list[str]:
    """The words and numbers that the rules test."""
    return sorted({w for host, path, _ in rules for w in re.findall(r"[^\W\d_]+|\d+", f"{host} {path}".lower())})


def parts(text: Column, rules) -> Column:
    """Letter and digit runs, without the words of rules."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_PART), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(rule_words(rules))) if rules else found


def host_parts(host: Column, rules) -> Column:
    """The parts of all labels but the last."""
    return parts(F.regexp_replace(host, r"[^.]*\.?\z", ""), rules)


def path_tokens(path: Column, rules) -> Column:
    return F.transform(parts(path, rules), lambda w: F.concat(F.lit("p:"), F.when(w.rlike(r"\A\p{N}"), F.lit("0")).otherwise(w)))


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def unigrams(texts: DataFrame, column: str) -> DataFrame:
    """word, n: counts of all words, over whole texts of all rows."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"<[^>]*>", " ")
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(1, LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segment(name: str, logs: dict[str, float]) -> list[str]:
    """The most probable split of a name into words; ties go to fewer and then longer first words."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            piece = name[start:end]
            price = logs.get(piece, UNKNOWN * (1 + len(piece)))
            options.append((best[start][0] + price, best[start][1] - 1, start))
        best.append(max(options))
    words, end = [], len(name)
    while end:
        start = best[end][2]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: each name (distinct letter runs) split. Its pieces are joined with the word counts."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    starts = names.filter(F.length("name") <= LONGEST_NAME).select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    pieces = starts.select("name", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("at") + 1))).alias("size"), "at").select("name", F.expr("substring(name, at, size)").alias("word")).distinct()
    known = pieces.join(counts, "word").join(F.broadcast(total)).groupBy("name").agg(F.collect_list(F.struct("word", F.log10(F.col("n") / F.col("total")).alias("log"))).alias("known"))

    @F.pandas_udf("array<string>")
    def split(some: pd.Series, known: pd.Series) -> pd.Series:
        logs = lambda pieces: {} if pieces is None else {p["word"]: p["log"] for p in pieces}
        return pd.Series([segment(name, logs(k)) if len(name) <= LONGEST_NAME else [name] for name, k in zip(some, known, strict=True)])

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


def naive_bayes(counts: DataFrame, allowed: int, blocked: int) -> tuple[np.ndarray, float]:
    """Log odds of block against allow for each bucket, Laplace-smoothed over the buckets in use, and of the classes.
    counts: bucket, n, bad."""
    found = counts.toPandas()
    n, bad = (found[c].to_numpy(dtype=np.float64) for c in ("n", "bad"))
    odds = np.zeros(BUCKETS, dtype=np.float64)
    if len(found):
        odds[found["bucket"].to_numpy()] = np.log((bad + 1) / (bad.sum() + len(found))) - np.log((n - bad + 1) / ((n - bad).sum() + len(found)))
    return odds, float(np.log((blocked + 1) / (allowed + 1)))


def filter_urls(pages: DataFrame, texts: DataFrame, column: str, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block by the model)."""
    spark = pages.sparkSession
    judged = apply_rules(split_url(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))), rules)
    # one row per host: its names' words, and how many URLs the rules allow and block
    hosts = materialize(judged.groupBy("host").agg(F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad")).withColumn("part", host_parts(F.col("host"), rules)), "hosts")
    spread = hosts.select("host", F.explode("part").alias("name"))
    names = spread.filter(~F.col("name").rlike(r"\A\p{N}")).select("name").distinct()
    words = materialize(segmented(names, unigrams(texts, column)), "names")
    tokens = spread.join(words, "name", "left").select("host", F.explode(F.coalesce("words", F.array(F.lit("0")))).alias("word")).select("host", F.concat(F.lit("h:"), "word").alias("token"))
    held = materialize(tokens.groupBy("host").agg(F.collect_list(bucket(F.col("token"))).alias("cells")), "tokens")
    of_hosts = held.join(hosts.filter("n > 0").select("host", "n", "bad"), "host").select(F.explode("cells").alias("bucket"), "n", "bad")
    ruled = judged.filter("ruled is not null").select(F.explode(F.transform(path_tokens(F.col("path"), rules), bucket)).alias("bucket"), (F.col("ruled") == "block").cast("long").alias("bad"))
    counts = of_hosts.unionByName(ruled.withColumn("n", F.lit(1).cast("long"))).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ruled = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    odds, prior = naive_bayes(counts, all_ruled["n"] - all_ruled["bad"], all_ruled["bad"])
    shared = spark.sparkContext.broadcast(odds)  # BUCKETS numbers, whatever the data

    @F.pandas_udf("double")
    def summed(cells: pd.Series) -> pd.Series:
        return pd.Series([float(shared.value[np.asarray(x, dtype=np.int64)].sum()) if x is not None and len(x) else 0.0 for x in cells], dtype="float64")

    of_host = held.select("host", summed("cells").alias("host_score"))
    scored = judged.withColumn("path_score", summed(F.transform(path_tokens(F.col("path"), rules), bucket))).join(of_host, "host", "left").withColumn("score", F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.col("path_score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise("allow")).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, pages, "html")
