"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask such as 1101101011 takes some positions of a ten-word window and ignores the others, so a window hashes alike
after words at ignored positions are replaced. The hashes of all windows of the corpus are joined with those of the
benchmark items; each hit fixes an alignment, around which the overlap is verified word by word: an equal word counts
+1, another word -MISMATCH, and the best stretch must reach MIN_SCORE.

The corpus is read once for its windows, whatever the number of benchmark words. Up to BROADCAST_WORDS words, counted before, the
item side is broadcast and nothing is shuffled. Of a larger benchmark two maps of fixed size tell which windows can have a hit (by
their first two words, then by their seeds); only these are shuffled, with the seeds in SALTS shares, so that a window that
many documents hold is many tasks' work. Only documents with a hit are then read again and joined with their alignments: another
map tells them, so that no other text is shuffled.

Defined results: words are runs of letters, digits and non-ASCII characters of the lower-cased text; null and empty texts
and documents or items with fewer words than a mask (10) have no windows and match nothing: benchmark items that short are not
protected; null doc_ids stay null in the result; repeated rows give one result, with the best score; very long texts are compared
whole; extra columns are passed by, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, fresh, materialize, native_map, without

#: 1 takes a position's word, 0 ignores it. All begin with the same two positions.
MASKS = ("1101101011", "1110010111", "1100111101")
SPAN = len(MASKS[0])
MISMATCH = 2
MIN_SCORE = 10
BROADCAST_WORDS = 50_000
SALTS = 8
#: Places of the map of seeds, 8 MB.
SEED_SPOTS = 1 << 26
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The lower-cased text's words, as 64-bit hashes."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def pair(x: Column, i: Column) -> Column:
    """The hash of the two words at i."""
    return F.xxhash64(x, F.get("h", i + 1))


def seeds_at(i: Column) -> Column:
    """The seeds of the window at i, one for each mask."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get("h", i + k) for k, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(MASKS)])


def windows(df: DataFrame, keep: list[str], near: Column | None = None) -> DataFrame:
    """keep, at (from 0), mask, seed: one row for each window and mask. near: for each word, whether the two words from there start a
    window of the other side; every mask takes these two, so other windows have no hit and are passed over."""
    if near is None:
        spots = F.when(F.size("h") >= SPAN, F.sequence(F.lit(0), F.size("h") - SPAN)).otherwise(F.array().cast("array<int>"))
    else:
        spots = F.filter(F.transform(near, lambda is_near, i: F.when(is_near, i).otherwise(-1)), lambda i: (i >= 0) & (i <= F.size("h") - SPAN))
    placed = df.select(*keep, F.explode(F.transform(spots, lambda i: F.struct(i.alias("at"), seeds_at(i).alias("seeds")))).alias("w"))
    return placed.select(*keep, "w.at", F.posexplode("w.seeds").alias("mask", "seed"))


def _best_stretch(a: Column, b: Column) -> Column:
    """Largest sum over a stretch of aligned words, +1 for equal and -MISMATCH for different ones."""
    step = lambda s, e: F.struct(F.greatest(s["run"] + e, F.lit(0)).alias("run"), F.greatest(s["best"], s["run"] + e).alias("best"))
    scores = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(-MISMATCH)))
    return F.aggregate(scores, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"])


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, n_matches (distinct alignments): documents that hold a passage of an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("h")).filter(F.size("h") >= SPAN)
    total = items.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = source.select("key", words(F.col("text")).alias("h"))
    seeds = windows(items, ["item_id"]).withColumnRenamed("at", "item_at")
    starts = items.select(F.explode(F.transform("h", pair)).alias("p")).distinct()
    if total <= BROADCAST_WORDS:
        known = ", ".join(f"{r['p']}L" for r in starts.collect()) or "null"
        near = F.expr(f"transform(h, (x, i) -> xxhash64(x, get(h, i + 1)) in ({known}))")  # as columns each literal would be a call to the JVM
        placed = windows(rows, ["key"], near)
        met = placed.join(F.broadcast(seeds), ["mask", "seed"])
    else:
        seeds = materialize(seeds, "seeds")
        wanted = native_map(seeds, "seed", SEED_SPOTS)
        starting = native_map(starts, "p")
        near = rows.select("key", "h", F.posexplode(F.transform("h", pair)).alias("at", "p")).filter((F.col("at") <= F.size("h") - SPAN) & starting(F.col("p")))
        placed = near.select("key", "at", F.posexplode(seeds_at(F.col("at"))).alias("mask", "seed")).filter(wanted(F.col("seed"))).withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int"))
        met = placed.join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["mask", "seed", "salt"])
    hits = materialize(met.select("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    if total > BROADCAST_WORDS:
        drop_scratch(seeds)
    # the item is laid over the document at each alignment
    wanted = native_map(hits, "key", 1 << 22)
    laid = hits.join(source.filter(wanted(F.col("key"))), "key").join(items.select("item_id", F.col("h").alias("item")), "item_id").select("doc_id", "item_id", "shift", "item", words(F.col("text")).alias("h"))
    first = F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("item"), F.size("h") - F.col("shift")) - first
    aligned = laid.select("doc_id", "item_id", "shift", F.slice("item", first + 1, length).alias("a"), F.slice("h", first + F.col("shift") + 1, length).alias("b"))
    scored = aligned.select("doc_id", "item_id", "shift", _best_stretch(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= min_score)
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").cast("long").alias("score"), F.count_distinct("shift").alias("n_matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """The documents without a benchmark passage, with all their columns. Rows without a doc_id stay unless their own text
    leaks: they are told by their text."""
    (key,) = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    plain = keyed.select(F.col(key).alias("doc_id"), "text")
    gone = leaks(plain, benchmark, min_score).select(F.col("doc_id").alias("leaking_text")).distinct()
    return without(keyed, materialize(gone, "gone"), key).drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
masks AS (SELECT unnest(['1101101011', '1110010111', '1100111101']) AS m),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS pos FROM dw WHERE len(w) >= 10),
ip AS (SELECT item_id, w, unnest(range(0, len(w) - 9)) AS pos FROM iw WHERE len(w) >= 10),
ds AS (SELECT doc_id, pos, m, list_transform(range(0, 10), lambda i: CASE WHEN m[i + 1] = '1' THEN w[pos + i + 1] ELSE '' END) AS s FROM dp, masks),
isd AS (SELECT item_id, pos, m, list_transform(range(0, 10), lambda i: CASE WHEN m[i + 1] = '1' THEN w[pos + i + 1] ELSE '' END) AS s FROM ip, masks),
hit AS (SELECT DISTINCT doc_id, item_id, ds.pos - isd.pos AS shift FROM ds JOIN isd ON ds.m = isd.m AND ds.s = isd.s),
eq AS (
  SELECT doc_id, item_id, shift, i, CASE WHEN dw.w[i + shift + 1] = iw.w[i + 1] THEN 1 ELSE -2 END AS e
  FROM (SELECT hit.*, unnest(range(greatest(-shift, 0), least(len(b.w), len(a.w) - shift))) AS i
        FROM hit JOIN dw a USING (doc_id) JOIN iw b USING (item_id)) JOIN dw USING (doc_id) JOIN iw USING (item_id)),
pre AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS p FROM eq),
best AS (
  SELECT doc_id, item_id, shift, max(p - low) AS score FROM (
    SELECT *, least(0, coalesce(min(p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM pre)
  GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(score) AS BIGINT) AS score, count(DISTINCT shift) AS n_matches FROM best WHERE score >= 10 GROUP BY doc_id, item_id
"""
