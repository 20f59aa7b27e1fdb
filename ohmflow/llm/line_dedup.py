"""Line dedup by winnowing over hashes of words.

Any passage of min_words words that stood earlier, wherever it starts and ends, holds a window of min_words equal words.
Hashes of word grams are winnowed: the smallest gram of each window is its fingerprint, and consecutive windows with one
fingerprint form a segment, so every window lies in one segment and equal windows have the same fingerprint. A segment that
stood earlier as a whole is a repeat. Of fingerprints that stand in different segments, the first copy of each segment is
taken to single windows, and a window that stood earlier is a repeat. Nothing is compared in pairs, so a fingerprint may
stand in any number of documents, and every repeat is found whichever document holds its first copy. All words of repeats
are deleted. Documents are ordered by doc_id, then by a hash of the text.

Any deleted run has an equal one earlier, so the first copy of every passage stays; of a window that overlaps its own first
copy only what follows that copy is deleted.

Defined results: null and empty texts come back unchanged; texts of white space have no words; null doc_ids come first in
the order and are no other id; rows with the same doc_id and text count as one document and get the same result; ties between equal documents go to the smaller doc_id; very long
texts are hashed whole, one at a time, at about 60 bytes of memory a byte; extra columns are passed by, whatever their names, except that
removed_words and n_runs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Powers, drop_scratch, find_words, fresh, give_back, hash_spans, key_map, materialize, maybe_wanted, mix64, row_chunks, spot, text_buffers

MIN_WORDS = 50
#: Words of a gram, and grams of which one is a fingerprint: together MIN_WORDS words.
GRAM = 26
WINDOW = 25


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: each word's hash, number of words (1) and first byte, and each row's first word index."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    start, end = find_words(raw, offsets)
    return hash_spans(raw, start, end), np.ones(len(start), np.int64), start, np.searchsorted(start, offsets)


class Spans:
    """Hashes of runs of words, by a sum of powers."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _Powers.get(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of `size` words from these on."""
        return mix64((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


class Segments:
    """Windows of `least` words of all rows, and the segments of consecutive windows with one fingerprint."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, least: int):
        counts = np.maximum(np.diff(rows) - least + 1, 0)
        n = len(hashes)
        #: first words of the windows
        self.windows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - rows[:-1], counts)
        if not len(self.windows):
            self.bounds = self.row = self.start = self.end = np.zeros(0, np.int64)
            self.prints = self.values = np.zeros(0, np.uint64)
            return
        spans = Spans(hashes)
        window = max(1, least // 2)
        gram = least - window + 1
        grams = spans.of(np.arange(n - gram + 1), gram)
        low, at, size = grams, np.arange(len(grams)), 1
        while size < window:  # the smallest of `window` grams, the rightmost of equal ones
            step = min(size, window - size)
            right = low[step:] <= low[:-step]
            low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
            size += step
        anchor = at[self.windows]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        #: first window of each segment, and the number of windows
        self.bounds = np.append(first, len(self.windows))
        self.row = np.repeat(np.arange(len(counts)), counts)[first]
        self.start, self.end = self.windows[first], self.windows[self.bounds[1:] - 1] + least
        self.prints, self.values = grams[anchor[first]], spans.of(self.start, self.end - self.start)


def _cuts(batch, least: int):
    """Of ranges of rows: the segments, each row's first word, and the columns doc_id and key of the range."""
    raw, offsets = text_buffers(batch.column("text"))
    for lo, hi in row_chunks(offsets):
        hashes, _, _, rows = units(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield Segments(hashes, rows, least), rows, batch.column("doc_id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo)


def _mark(least: int):
    def run(batches):
        for batch in batches:
            for found, rows, ids, keys in _cuts(batch, least):
                take = pa.array(found.row)
                start, end = (x - rows[found.row] for x in (found.start, found.end))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found.prints.view(np.int64)), pa.array(found.values.view(np.int64))],
                    names=["doc_id", "key", "start", "end", "print", "segment"],
                )
        give_back()

    return run


def _windows(least: int):
    """The windows of the segments in `wanted` (start, end) of each text."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            wanted = batch.column("wanted")
            parts = wanted.offsets.to_numpy()
            start, end = (wanted.values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "end"))
            for lo, hi in row_chunks(offsets):
                hashes, _, _, rows = units(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                mine = slice(parts[lo], parts[hi])
                sizes = end[mine] - start[mine] - least + 1
                row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(parts[lo : hi + 1])), sizes)
                at = np.repeat(start[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                values = Spans(hashes).of(rows[row] + at, least) if len(at) else np.zeros(0, np.uint64)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(at, pa.int32()), pa.array(values.view(np.int64))], names=["doc_id", "key", "start", "window"])
        give_back()

    return run


def _cut(names: dict[str, str]):
    """Texts without the words of their runs; removed_words, n_runs. names: the columns of text and runs."""

    def one(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[str, int, int]:
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        _, words, first, _ = units(raw, np.array([0, len(raw)]))
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(gone, starts, 1)
        np.add.at(gone, ends, -1)
        gone = np.cumsum(gone)[:-1] > 0
        bounds = np.append(first, len(data))
        bounds[0] = 0
        left = b"".join(data[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~gone)).rstrip(b" \t\n\r\x0b\x0c").decode()
        return left, int(words[gone].sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())

    def run(batches):
        for batch in batches:
            texts, runs = batch.column(names["text"]), batch.column(names["runs"])
            out, removed, counts = [], [], []
            for r in range(batch.num_rows):
                spans, text = runs[r].values, texts[r].as_py()
                whole = spans is None or not len(spans) or text is None
                left, words, n = (text, 0, 0) if whole else one(text, spans.field("start").to_numpy(), spans.field("end").to_numpy())
                out.append(left)
                removed.append(words)
                counts.append(n)
            others = [c for c in batch.schema.names if c not in names.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(out, pa.string()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())], names=[*others, names["text"], "removed_words", "n_runs"])
        give_back()

    return run


def _later(rows: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose value stands earlier, with its first place, and the written table of first places: joined from a table, a value
    that stands very often can be split over tasks."""
    first = materialize(rows.groupBy(value).agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(value, "first"), "first")
    return rows.join(first, value).filter("not (doc_id <=> first.doc_id and key = first.key and start = first.start)"), first


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, runs (start, end): the words to delete. docs: doc_id, key, text."""
    texts = docs.select("doc_id", "key", "text")
    marked = materialize(texts.mapInArrow(_mark(min_words), "doc_id long, key long, start int, end int, print long, segment long"), "segments")
    # fingerprints that stand more than once, and whether their segments differ
    prints = materialize(marked.groupBy("print").agg(F.count("*").alias("n"), F.min("segment").alias("lo"), F.max("segment").alias("hi")).filter("n > 1").selectExpr("print", "lo < hi as mixed"), "prints")
    often = maybe_wanted(docs.sparkSession, key_map(prints, "print"))
    repeated = materialize(marked.filter(often(spot("print"))).join(prints, "print"), "repeated")
    rows, first_segments = _later(repeated, "segment")
    later = materialize(rows.withColumn("own", F.expr(f"doc_id <=> first.doc_id and key = first.key and start - first.start < {int(min_words)}")), "later")
    # single windows: of the first copies of segments that differ, and of segments that overlap their first copy
    firsts = repeated.filter("mixed").groupBy("segment").agg(F.min(F.struct("doc_id", "key", "start", "end")).alias("first")).select("first.*")
    overlapping = later.filter("own")
    own_first = overlapping.select("first.doc_id", "first.key", "first.start", (F.col("first.start") + F.col("end") - F.col("start")).alias("end"))
    wanted = materialize(firsts.union(overlapping.select("doc_id", "key", "start", "end")).union(own_first), "wanted")
    # only the texts with such segments are shuffled to them
    starts = wanted.distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("wanted"))
    some = maybe_wanted(docs.sparkSession, key_map(wanted, "doc_id", "key"))
    held = texts.filter(some(spot("doc_id", "key"))).withColumnsRenamed({"doc_id": "t_id", "key": "t_key"})
    found = held.join(starts.hint("merge"), F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_key") == F.col("key"))).select("doc_id", "key", "text", "wanted")
    windows = materialize(found.mapInArrow(_windows(min_words), "doc_id long, key long, start int, window long"), "windows")
    after = F.expr(f"case when doc_id <=> first.doc_id and key = first.key then greatest(start, first.start + {int(min_words)}) else start end")
    rows, first_windows = _later(windows, "window")
    found = rows.select("doc_id", "key", after.alias("start"), (F.col("start") + min_words).alias("end"))
    runs = later.filter("not own").select("doc_id", "key", "start", "end").union(found)
    whole = materialize(runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("runs")), "runs")
    drop_scratch(marked, prints, repeated, first_segments, later, wanted, windows, first_windows)
    return whole


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs, texts without their later repeated runs, and removed_words, n_runs (which replace
    columns of these names)."""
    docs = docs.drop("removed_words", "n_runs")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    n_id, n_key, n_cut, n_runs, r_id, r_key = fresh(docs, "run_id", "run_key", "has_runs", "runs", "runs_id", "runs_key")
    runs = repeated_runs(plain, min_words).select(F.col("doc_id").alias(r_id), F.col("key").alias(r_key), F.col("runs").alias(n_runs))
    # only the texts of documents with runs are shuffled to them; the others pass by
    cut = maybe_wanted(docs.sparkSession, key_map(runs, r_id, r_key))
    keyed = docs.withColumn(n_id, F.col("doc_id").cast("long")).withColumn(n_key, F.xxhash64("text"))
    keyed = keyed.withColumn(n_cut, cut(spot(n_id, n_key)))
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string").alias("text")
    whole = keyed.filter(F.col(n_cut)).join(runs.hint("shuffle_hash"), F.col(n_id).eqNullSafe(F.col(r_id)) & (F.col(n_key) == F.col(r_key)), "left").select(*others, text, n_runs)
    rest = keyed.filter(~F.col(n_cut)).select(*docs.columns).withColumn("text", text).withColumn("removed_words", F.lit(0).cast("long")).withColumn("n_runs", F.lit(0).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return whole.mapInArrow(_cut({"text": "text", "runs": n_runs}), f"{kinds}, text string, removed_words long, n_runs long").select(*docs.columns, "removed_words", "n_runs").unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
