"""Helpers that the text operators share: scratch tables, word hashing on Arrow buffers, connected components."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The upper-case letters that contracts fold, and what they fold to.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named a local master gets a temporary
    one; on a cluster that folder would be each machine's own, so it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = getattr(spark.sparkContext, "_ohmflow_scratch", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="ohmflow-")
        spark.sparkContext._ohmflow_scratch = own
    return own


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame | None) -> None:
    """Removes tables made by materialize() that nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        root = scratch_dir(spark).rstrip("/")
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.split(":", 1)[-1].lstrip("/") in parent:
                path = spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


# --- words on byte buffers -------------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at once; bounds the temporaries of a task, whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2000


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit keys."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept by the worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of at most CHUNK_ROWS whole rows and about `limit` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + CHUNK_ROWS, n)
        yield lo, hi
        lo = hi


def find_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word (ASCII white space and row ends part words)."""
    n = len(raw)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z folded."""
    up, down = _Powers.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z folded, split at ASCII white space) of all rows, and each row's first word index."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = find_words(raw, offsets)
    return hash_spans(raw, start, end), np.searchsorted(start, offsets)


def hash_shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size`-word shingles (a shorter row's whole sequence is one) and each row's first shingle index."""
    counts = np.diff(rows)
    have = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(have)])
    if not out_rows[-1]:
        return np.zeros(0, np.uint64), out_rows
    at = np.arange(out_rows[-1]) - np.repeat(out_rows[:-1] - rows[:-1], have)
    left = np.repeat(rows[1:], have) - at
    value = np.zeros(out_rows[-1], dtype=np.uint64)
    top = len(words) - 1
    for i in range(size):
        here = words[np.minimum(at + i, top)]
        value = np.where(left > i, mix64(value * np.uint64(0xD6E8FEB86659FD93) + here + np.uint64(i + 1)), value)
    return value, out_rows


# --- maps of wanted keys ---------------------------------------------------------------------------------------------

#: Bits of a map of keys: 2 MB, whatever the number of keys. A key on the map may be wanted; one off it is not.
SPOTS = 1 << 24


def spot(*columns: str) -> Column:
    """A key's place on the map."""
    return F.pmod(F.xxhash64(*columns), F.lit(SPOTS))


def key_map(keys: DataFrame, *columns: str) -> np.ndarray:
    """The map of these keys, merged from partial ones."""
    placed = keys.select(spot(*columns).alias("s")).selectExpr("s div 64 as at", "shiftleft(1L, cast(s % 64 as int)) as bit")
    parts = placed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(SPOTS // 64, dtype=np.int64)
    bits[parts["at"].to_numpy(dtype=np.int64)] = parts["bits"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def on_map(bits: np.ndarray, spots) -> np.ndarray:
    spots = np.asarray(spots).astype(np.uint64)
    return ((bits[(spots >> np.uint64(6)).astype(np.int64)] >> (spots & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe_wanted(spark: SparkSession, bits: np.ndarray):
    """A filter on a spot column: true for every wanted key and few others."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def check(spots: pd.Series) -> pd.Series:
        return pd.Series(on_map(shared.value, spots.to_numpy()))

    return check


def native_map(keys: DataFrame, key: str, spots: int = SPOTS):
    """The same filter without Python in the tasks: a function of a key column. The map is one array literal of
    spots / 64 longs, 2 MB by default, whatever the number of keys; two bits a key are set, so that a map with a million keys
    lets one other key in 60 pass."""
    words = spots // 64
    place = lambda c, n: F.pmod(F.xxhash64(F.lit(n), c), F.lit(spots))
    placed = keys.select(F.explode(F.array(place(F.col(key), 1), place(F.col(key), 2))).alias("s")).selectExpr("s div 64 as at", "shiftleft(1L, cast(s % 64 as int)) as bit")
    parts = placed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(words, dtype=np.int64)
    bits[parts["at"].to_numpy(dtype=np.int64)] = parts["bits"].to_numpy(dtype=np.int64)
    table = keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))})).scalar()
    here = lambda s: F.call_function("shiftrightunsigned", F.get(table, (s / 64).cast("int")), (s % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return lambda c: here(place(c, 1)) & here(place(c, 2))


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not in gone (a written table of one column, key); rows with a null key stay. Only rows on
    the map of gone keys are shuffled to them, the others pass by."""
    (column,) = gone.columns
    on = native_map(gone, column)
    known = F.coalesce(on(F.col(key)) & F.col(key).isNotNull(), F.lit(False))
    return docs.filter(~known).unionByName(docs.filter(known).join(gone, docs[key] == gone[column], "left_anti"))


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers are kept for later tasks and would hold their peak."""
    pa.default_memory_pool().release_unused()
    if trim := _libc_trim():
        trim(0)


@functools.cache
def _libc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another system's C library
        return None


# --- connected components --------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b). Links are turned into stars: a node's larger
    neighbours are linked to its smallest one, then its smaller neighbours are, until every node has one link, to a node
    without a smaller neighbour. Rounds grow with a power of the logarithm of a group's size (at most its square), and there is
    no limit on it; no round has more links than the one before. Rounds are written to the scratch folder, and only whether
    links are left comes to the driver."""
    given = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    edges, rounds = given.filter("a <> b"), 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = materialize(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        moved = large.join(low.filter("n > 1").select("a", "low"), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = materialize(low.select("a", F.col("low").alias("b")).union(moved).distinct(), "links")
        if rounds:
            drop_scratch(edges)
        drop_scratch(large)
        edges, rounds = small, rounds + 1
        many = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        if many.union(edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty():
            nodes = edges.union(edges.select("b", "b")).union(given.filter("a = b"))
            labels = materialize(nodes.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "labels")
            drop_scratch(edges)
            drop_scratch(given)
            return labels
