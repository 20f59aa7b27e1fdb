"""Exact top-k search by inner product with pivot-table elimination.

Distances of all vectors to many pivots are computed once. By the triangle inequality |d(q, p) - d(x, p)| bounds d(q, x)
from below, so q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 is bounded from above by the pivot with the largest gap. A query's
candidates are evaluated in the order of that bound until the next bound is under its k-th best score: what is left
cannot enter the result, so it is exact. A query begins with its k-th best score in the sample that pivots are chosen from, so
that no block of vectors has to find a threshold of its own; blocks whose best bound is under it are left without an evaluation.

Pivots are chosen on a bounded sample (PIVOT_SAMPLE rows, the smallest hashes of vec_id), farthest first; every vector is in
the table. Queries and vectors meet in blocks: a task holds one block of vectors and one of queries at a time, a shelf of
SHELF_BLOCKS query blocks meets each vector block, and the number of shelves and of deals of vectors grows with the tables. Blocks'
best rows are merged per query.

Defined results: vectors that are null, empty or hold null, NaN or infinite components (also after scaling) take no part; products
are exact for components of any size and ranked exactly, and a score beyond 64 bits is given as the largest or smallest long; vectors are compared with those of their own length; rows with a null
vec_id take no part. A query's own row is no candidate; every other row is, so of repeated rows (same vec_id) each is a
query and a candidate of its own and a query's other copies are among its results; ties go to the smaller vec_id; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS = 48
PIVOT_SAMPLE = 2000
BLOCK_ROWS = 4096
QUERY_ROWS = 256
#: Candidates of a query that are evaluated at once, in bound order.
STEP = 64
#: Blocks of queries that one shelf holds (about 60 MB at 64 components).
SHELF_BLOCKS = 256
#: Deals of the vector blocks: at least, and for each shelf (a query of 50 rows: both sides are copied about equally).
LEAST_DEALS, DEALS_PER_SHELF = 64, 50
#: Fixed value: the longs' bound, and the bytes in which any product of doubles fits.
LONG, WIDE = 1 << 63, 300


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of whole numbers in doubles: as doubles where every sum is under 2^53, else as Python integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in side] for side in (a.tolist(), b.tolist())]
    out = np.empty((len(a), len(b)), dtype=object)
    for i, x in enumerate(whole[0]):
        out[i] = [sum(v * w for v, w in zip(x, y, strict=True)) for y in whole[1]]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        gaps = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
        return np.sqrt(np.maximum(gaps, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal; fewer where the sample has fewer distinct rows."""
    sample = np.unique(sample, axis=0)
    if not len(sample):
        return sample
    chosen, gap = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def thresholds(q: np.ndarray, sample: np.ndarray, k: int) -> list:
    """Each query's k-th best score among the sampled rows, which are rows of the table; None where there are fewer."""
    if len(sample) < k:
        return [None] * len(q)
    return [sorted(row.tolist(), reverse=True)[k - 1] for row in _dot(q, sample)]


def search_block(q, q_piv, x_ids, x, x_piv, k, least):
    """Each query's k best rows of one block that reach its threshold: (number of the query, number of the row, score) lists, and the number of evaluations."""
    out_q, out_x, out_s, evaluated = [], [], [], 0
    with np.errstate(over="ignore", invalid="ignore"):
        q_sq, x_sq = (q**2).sum(1), (x**2).sum(1)
        for i in range(len(q)):
            lower = np.abs(x_piv - q_piv[i]).max(1)
            # distances are rounded; the bound is widened by more than that error, and is no bound where it leaves the doubles
            upper = (q_sq[i] + x_sq - lower * lower) / 2 + 1e-6 * (q_sq[i] + x_sq) + 1
            upper[np.isnan(upper)] = np.inf
            hope = np.flatnonzero(upper >= least[i]) if least[i] is not None else np.arange(len(upper))
            order = hope[np.argsort(-upper[hope], kind="stable")]
            rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(order), STEP):
                if len(scores) >= k and upper[order[at]] < scores[-1]:
                    break
                take = order[at : at + STEP]
                evaluated += len(take)
                rows = np.concatenate([rows, take])
                scores = np.concatenate([scores, _dot(q[i : i + 1], x[take])[0]])
                best = _best(x_ids[rows], scores, k)
                rows, scores = rows[best], scores[best]
            out_q += [i] * len(rows)
            out_x += rows.tolist()
            out_s += scores.tolist()
    return out_q, out_x, out_s, evaluated


def _blocks(rows: int, name: str, pivots: dict[int, bytes], extra: tuple[str, ...] = ()):
    """Packs a partition's vectors into blocks of equal dimension: ids, vectors, pivot distances and extra long columns, as bytes."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim):
            vectors, ids, *others = zip(*held.pop(dim), strict=True)
            vectors = np.array(vectors, dtype=np.float64)
            table = distances(vectors, np.frombuffer(pivots[dim]).reshape(-1, dim)) if dim in pivots else np.zeros((len(ids), 1))
            columns = {"ids": np.array(ids, np.int64), "vectors": vectors, "table": table} | {e: np.array(o, np.int64) for e, o in zip(extra, others, strict=True)}
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32())} | {f"{name}_{c}": [v.tobytes()] for c, v in columns.items()})

        for batch in batches:
            for vector, *row in zip(*(batch.column(c).to_pylist() for c in ("vector", "vec_id", *extra)), strict=True):
                held.setdefault(len(vector), []).append((vector, *row))
                if len(held[len(vector)]) >= rows:
                    yield block(len(vector))
        for dim in list(held):
            yield block(dim)

    return run


def _search(k: int, samples: dict[int, bytes]):
    """query_id, query_key, copies, vec_id, own (the row equals the query in id and vector), score, beyond (of scores beyond a long: bytes
    in their order)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, x_ids, keys, copies = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "x_ids", "q_key", "q_copies"))
                q, x = np.frombuffer(row["q_vectors"]).reshape(-1, dim), np.frombuffer(row["x_vectors"]).reshape(-1, dim)
                q_piv, x_piv = np.frombuffer(row["q_table"]).reshape(len(q), -1), np.frombuffer(row["x_table"]).reshape(len(x), -1)
                least = thresholds(q, np.frombuffer(samples.get(dim, b"")).reshape(-1, dim), k)
                at, hit, score, _ = search_block(q, q_piv, x_ids, x, x_piv, k, least)
                at, hit = np.array(at, np.int64), np.array(hit, np.int64)
                beyond = pa.array([None if -LONG <= s < LONG else (s + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big") for s in score], pa.binary())
                score = np.array([max(-LONG, min(LONG - 1, s)) for s in score], np.int64)
                own = (q_ids[at] == x_ids[hit]) & (q[at] == x[hit]).all(1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[at], keys[at], copies[at], x_ids[hit], own, score, beyond)], names=["query_id", "query_key", "copies", "vec_id", "own", "score", "beyond"])

    return run


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector array<double> of whole numbers) of the vectors that take part."""
    whole = vectors.filter("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(float("inf"))))
    # doubles from 2^53 on are whole numbers
    floor = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    return whole.filter(fit).select("vec_id", F.transform("embedding", lambda v: floor(v * scale)).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products among the other vectors. Both inputs are
    (vec_id, vector array<double> of whole numbers), and queries are rows of vectors."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vector").toPandas()["vector"]
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(np.asarray(v, dtype=np.float64))
    pivots = {dim: choose_pivots(np.array(rows), PIVOTS).tobytes() for dim, rows in by_dim.items()}
    samples = {dim: np.array(rows).tobytes() for dim, rows in by_dim.items()}
    # equal query rows are searched once
    asked = queries.groupBy("vec_id", "vector").agg(F.count("*").alias("copies")).withColumn("key", F.xxhash64("vector"))
    xs = materialize(vectors.mapInArrow(_blocks(BLOCK_ROWS, "x", pivots), "dim int, x_ids binary, x_vectors binary, x_table binary"), "vectors")
    qs = materialize(asked.mapInArrow(_blocks(QUERY_ROWS, "q", pivots, ("key", "copies")), "dim int, q_ids binary, q_vectors binary, q_table binary, q_key binary, q_copies binary"), "queries")
    # every vector block meets every shelf once. Shelves bound a task's memory; deals are as many as make both sides' copies alike
    shelves, blocks = max(1, -(-qs.count() // SHELF_BLOCKS)), max(1, xs.count())
    deals = min(blocks, max(LEAST_DEALS, DEALS_PER_SHELF * shelves))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    meet = ["dim", "deal", "shelf"]
    xs_dealt = xs.withColumn("deal", F.pmod(F.xxhash64("x_ids"), F.lit(deals)).cast("int")).withColumn("shelf", spread(shelves)).repartition(deals * shelves, *meet)
    qs_dealt = qs.withColumn("shelf", F.pmod(F.xxhash64("q_ids"), F.lit(shelves)).cast("int")).withColumn("deal", spread(deals)).repartition(deals * shelves, *meet)
    best = xs_dealt.join(qs_dealt.hint("merge"), meet).drop(*meet[1:])
    best = best.mapInArrow(_search(k + 1, samples), "query_id long, query_key long, copies long, vec_id long, own boolean, score long, beyond binary")
    # of the k + 1 best rows one that is the query's own row is taken out
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", F.desc("own"))
    top = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    owns = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = top.withColumn("owns", owns).filter("not (own and owns = 1)").withColumn("rank", F.col("place") - F.least("owns", F.lit(1))).filter(F.col("rank") <= k)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.row <> x.row AND len(q.e) = len(x.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
