"""MinHash near-dedup with Odd sketches.

A document's MinHash samples serve twice: bands of them give candidates, and all of them, folded into one parity bitmap,
give an Odd sketch. The population count of two sketches' XOR estimates a high similarity closely, so most false
candidates go before their full sets are fetched; every remaining candidate is confirmed on the full sets.

Groups are never expanded into all pairs. Equal sets become one class first. In a band's bucket every class is compared
with one centre, the class that shares the most with others (linear in the bucket), and links are joined into components.
After a few rounds, in which only buckets of several components get another centre, what is left is exact: the classes of
such buckets are dealt by the shingles of their prefixes, the rarest fifth and one (a pair of similarity 0.8 shares one of
these), so that classes that have only common text in common do not meet. Of the classes that share such a shingle those
outside its largest component meet the others in blocks of BLOCK_ROWS, and only pairs of different components with alike
sizes, sketches and parities come out, so no link is lost to the centres.

Defined results: null or empty texts, and texts of white space, have no shingles and are linked with nothing; rows with a
null doc_id are returned with null component_id and kept = true; rows that share a doc_id count as one document; equal
texts are one class; very long texts are hashed whole, one at a time; ties go to the
smallest doc_id; deduplicate() passes all columns by, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop_scratch, give_back, hash_shingles, hash_words, key_map, materialize, mix64, on_map, row_chunks, spot, text_buffers, without

BANDS, ROWS = 24, 5
SKETCH_WORDS = 4  # 256 bits
#: Words of the whole set's parity bitmap. Two bitmaps never differ in more bits than the sets in members, so it rejects exactly.
PARITY_WORDS = 32
#: A pair goes on to its full sets unless the sketches' estimate is this far under the threshold (over four deviations).
SLACK = 0.2
#: Rounds in which the classes that the first centres leave apart meet other centres of their buckets.
ROUNDS = 1
#: Cells in which shingles are counted to tell rare ones. Only speed depends on them: any order of shingles gives the same pairs.
CELLS = 1 << 18
#: Classes of a bucket that one block holds in the comparison of components.
BLOCK_ROWS = 256

FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("parity", T.ArrayType(T.LongType())),
    ]
)


def _seeds(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _row_sets(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and the rows' new bounds."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(rows)))


def _features(size: int):
    def run(batches):
        seeds = _seeds(BANDS * ROWS)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in row_chunks(offsets):
                words, starts = hash_words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                values, rows = _row_sets(*hash_shingles(words, starts, size))
                counts = np.diff(rows)
                full = np.flatnonzero(counts)
                at = rows[:-1][full]
                n = len(full)
                least = np.empty((len(seeds), n), dtype=np.uint64)
                for i, seed in enumerate(seeds):
                    least[i] = np.minimum.reduceat((values ^ seed) * (seed | np.uint64(1)), at) if n else 0
                bands = np.zeros((BANDS, n), dtype=np.uint64)
                for b in range(BANDS):
                    for r in range(ROWS):
                        bands[b] = mix64(bands[b] * np.uint64(31) + least[b * ROWS + r] + np.uint64(b + 1))
                bits = np.zeros((n, 64 * SKETCH_WORDS), dtype=np.uint8)
                for i, seed in enumerate(seeds):
                    np.add.at(bits, (np.arange(n), (mix64(least[i] + seed) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS)), 1)
                sketch = np.packbits(bits & 1, axis=1).view(np.int64)
                width = 64 * PARITY_WORDS
                owner = np.repeat(np.arange(n), counts[full])
                spots = owner * width + (mix64(values + np.uint64(11)) >> np.uint64(32)).astype(np.int64) % width
                parity = np.packbits((np.bincount(spots, minlength=n * width) & 1).astype(np.uint8).reshape(n, width), axis=1).view(np.int64)
                set_a = np.add.reduceat(values, at) if n else values
                set_b = np.bitwise_xor.reduceat(mix64(values + np.uint64(7)), at) if n else values
                none = counts == 0
                place = np.cumsum(~none) - 1

                def per_row(column, none=none, place=place, kind=None):
                    picked = np.zeros(len(none), dtype=np.int64) if not len(column) else column[np.maximum(place, 0)]
                    return pa.array(picked, type=pa.int64(), mask=none)

                def lists(matrix, width, none=none):
                    ends = np.concatenate([[0], np.cumsum(np.where(none, 0, width))]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1), type=pa.int64()))

                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(counts, type=pa.int64()), per_row(set_a.view(np.int64)), per_row(set_b.view(np.int64)), lists(np.ascontiguousarray(bands.T).view(np.int64), BANDS), lists(sketch, SKETCH_WORDS), lists(parity, PARITY_WORDS)],
                    names=[f.name for f in FEATURES],
                )
        give_back()

    return run


def _wanted_sets(batches, size: int, bitmap: np.ndarray):
    """Of ranges of the documents on the map: their ids, their sets' members in one array, and each set's bounds."""
    for batch in batches:
        batch = batch.filter(pa.array(on_map(bitmap, batch.column("spot").to_numpy())))
        raw, offsets = text_buffers(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in row_chunks(offsets):
            words, starts = hash_words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            values, rows = _row_sets(*hash_shingles(words, starts, size))
            yield ids.slice(lo, hi - lo), values, rows


def _sets(size: int, shared):
    """Full sets of the documents whose id is on the map."""

    def run(batches):
        for ids, values, rows in _wanted_sets(batches, size, shared.value):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values.view(np.int64)))], names=["doc_id", "members"])
        give_back()

    return run


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _counted(size: int, shared):
    """(cell, n): how many of the wanted documents' shingles fall into each cell."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for _, values, _ in _wanted_sets(batches, size, shared.value):
            total += np.bincount(_cells(values), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])
        give_back()

    return run


def _prefixes(size: int, percent: int, shared, counts):
    """(doc_id, keys): of each wanted document the rarest shingles, as many as a similar set can't all lack."""

    def run(batches):
        often = counts.value
        for ids, values, rows in _wanted_sets(batches, size, shared.value):
            n = np.diff(rows)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, often[_cells(values)], row))
            kept = np.arange(len(values)) - np.repeat(rows[:-1], n) < np.repeat(n - -(-n * percent // 100) + 1, n)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order][kept].view(np.int64)))], names=["doc_id", "keys"])
        give_back()

    return run


def _by_prefixes(docs: DataFrame, open_classes: DataFrame, size: int, percent: int) -> DataFrame:
    """class_id, component, bucket: the classes by the shingles of their prefixes."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(key_map(open_classes.select(F.col("class_id").alias("doc_id")), "doc_id"))
    marked = docs.filter("doc_id is not null").select("doc_id", "text", spot("doc_id").alias("spot"))
    cells = marked.mapInArrow(_counted(size, shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    prefixes = marked.mapInArrow(_prefixes(size, percent, shared, context.broadcast(counts)), "doc_id long, keys array<long>")
    return prefixes.join(open_classes, F.col("doc_id") == F.col("class_id")).select("class_id", "component", F.explode("keys").alias("bucket")).distinct()


def _most_apart(percent: int) -> int:
    """Bits in which the sketches of a pair of at least this similarity may differ."""
    samples, bits = BANDS * ROWS, 64 * SKETCH_WORDS
    # J = 1 + bits / (4 samples) * ln(1 - 2 differ / bits), solved for the most bits that may differ
    return int(bits / 2 * (1 - np.exp(-4 * samples / bits * (1 - percent / 100 + SLACK))))


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes, Odd sketches and parities that a pair of at least this similarity has."""
    # sums of single words are compiled, a higher-order function would be interpreted for every pair
    apart = lambda c, n: sum((F.bit_count(F.col(f"{a}.{c}")[i].bitwiseXOR(F.col(f"{b}.{c}")[i])) for i in range(1, n)), F.bit_count(F.col(f"{a}.{c}")[0].bitwiseXOR(F.col(f"{b}.{c}")[0])))
    sizes = F.least(f"{a}.n_shingles", f"{b}.n_shingles") * 100 >= F.greatest(f"{a}.n_shingles", f"{b}.n_shingles") * percent
    # members in one set only: at most (1 - J) / (1 + J) of both sizes' sum
    few = apart("parity", PARITY_WORDS) * (100 + percent) <= (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) * (100 - percent)
    return sizes & (apart("sketch", SKETCH_WORDS) <= _most_apart(percent)) & few


def _alike_in_blocks(percent: int):
    """Of pairs of blocks (lists x and y of classes): the alike pairs of different components. The same tests as _alike()."""
    most = _most_apart(percent)

    def side(column: pa.ListArray, r: int):
        members = column[r].values
        plain = lambda name: members.field(name).to_numpy(zero_copy_only=False)
        bits = lambda name: members.field(name).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(members), -1)
        return plain("class_id"), plain("component"), plain("n_shingles"), bits("sketch"), bits("parity")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x_id, x_component, x_n, x_sketch, x_parity = side(batch.column("x"), r)
                y_id, y_component, y_n, y_sketch, y_parity = side(batch.column("y"), r)
                apart = sum(np.bitwise_count(x_sketch[:, None, w] ^ y_sketch[None, :, w]).astype(np.int32) for w in range(SKETCH_WORDS))
                near = (apart <= most) & (x_component[:, None] != y_component[None]) & (np.minimum(x_n[:, None], y_n[None]) * 100 >= np.maximum(x_n[:, None], y_n[None]) * percent)
                i, j = np.nonzero(near)
                few = np.bitwise_count(x_parity[i] ^ y_parity[j]).sum(1, dtype=np.int64) * (100 + percent) <= (x_n[i] + y_n[j]) * (100 - percent)
                a, b = x_id[i[few]], y_id[j[few]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts are read again where they lie: a bitmap of the wanted ids keeps
    all of them and few others, so that sets and not texts are shuffled."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    shared = docs.sparkSession.sparkContext.broadcast(key_map(wanted, "doc_id"))
    marked = docs.filter("doc_id is not null").select("doc_id", "text", spot("doc_id").alias("spot"))
    sets = marked.mapInArrow(_sets(size, shared), "doc_id long, members array<long>")
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    close = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").filter(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent)
    return close.select("a", "b")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) with alike sizes and sketches."""
    x, y = nodes.alias("x"), nodes.alias("y")
    joined = pairs.distinct().join(x, F.col("a") == F.col("x.class_id")).join(y, F.col("b") == F.col("y.class_id"))
    return materialize(joined.filter(_alike("x", "y", percent)).select("a", "b"), "near")


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = materialize(source.mapInArrow(_features(shingle), FEATURES), "features")
    named = features.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(
        named.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "sketch", "parity")).alias("first")).select("set_a", "set_b", "n_shingles", F.col("first.doc_id").alias("class_id"), "first.bands", "first.sketch", "first.parity"),
        "classes",
    )
    nodes = classes.select("class_id", "n_shingles", "sketch", "parity")
    entries = classes.select("class_id", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(entries.hint("merge").join(sizes, "bucket"), "buckets")
    # a bucket's centre is the class whose buckets are the fullest: the one that most copies come from
    weights = shared.groupBy("class_id").agg(F.sum("n").alias("weight"))
    centres = shared.join(weights, "class_id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("class_id")).alias("last"))).alias("c")).select("bucket", (-F.col("c.last")).alias("centre"))
    ordered = lambda rows: rows.filter("class_id <> centre").select(F.least("class_id", "centre").alias("a"), F.greatest("class_id", "centre").alias("b"))
    near = _near(ordered(shared.join(centres, "bucket")), nodes, percent)
    links = materialize(_confirm(source, near, shingle, percent), "links")
    made = [features, classes, shared, near, links]
    found = components(links)
    for turn in range(1, ROUNDS + 1):
        # buckets of several components: their classes with another centre of the bucket, drawn by a hash
        placed, mixed = _mixed(shared, found)
        drawn = placed.join(mixed, "bucket").groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "bucket", "class_id").alias("h"), F.col("class_id").alias("centre"), F.col("component").alias("other"))).alias("c")).select("bucket", "c.centre", "c.other")
        links, found = _more(source, _near(ordered(placed.join(drawn, "bucket").filter("component <> other")), nodes, percent), links, found, shingle, percent, made)
    # what is left: classes of mixed buckets by rare shingles; those outside a shingle's largest component against the others, in blocks
    placed, mixed = _mixed(shared, found)
    apart = materialize(placed.join(mixed, "bucket").select("class_id", "component").distinct(), "apart")
    placed = materialize(_by_prefixes(source, apart, shingle, percent), "prefixes")
    made += [apart, placed]
    mixed = _several(placed)
    parts = placed.join(mixed, "bucket").groupBy("bucket", "component").agg(F.count("*").alias("c"))
    whole = parts.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top")).select("bucket", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.c")).alias("m"))
    members = materialize(placed.select("class_id", "bucket", "component").join(whole, "bucket").join(nodes, "class_id"), "open")
    blocks = lambda rows, size, name: rows.groupBy("bucket", F.pmod(F.xxhash64("class_id"), F.ceil(F.col(size) / BLOCK_ROWS)).alias(f"at_{name}")).agg(F.collect_list(F.struct("class_id", "component", "n_shingles", "sketch", "parity")).alias(name))
    pairs = blocks(members.filter("component <> main"), "m", "x").join(blocks(members, "n", "y"), "bucket").select("x", "y")
    rest = materialize(pairs.mapInArrow(_alike_in_blocks(percent), "a long, b long").distinct(), "near")
    made.append(members)
    links, found = _more(source, rest, links, found, shingle, percent, made)
    of_class = classes.select("set_a", "set_b", "n_shingles", "class_id").join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    all_rows = features.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    result = all_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    result = materialize(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "class_id"), "documents")
    drop_scratch(*made, found)
    return result


def _more(source: DataFrame, near: DataFrame, links: DataFrame, found: DataFrame, shingle: int, percent: int, made: list) -> tuple[DataFrame, DataFrame]:
    """links and components with those of the pairs in near that hold on full sets."""
    made.append(near)
    if near.isEmpty():
        return links, found
    more = materialize(_confirm(source, near, shingle, percent), "links")
    made.append(more)
    if more.isEmpty():
        return links, found
    links = links.union(more)
    drop_scratch(found)
    return links, components(links)


def _mixed(shared: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their component, and the buckets that hold several."""
    placed = shared.select("class_id", "bucket").join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    return placed, _several(placed)


def _several(placed: DataFrame) -> DataFrame:
    """The buckets that hold several components."""
    return placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which near_duplicates() keeps one in each group, with all their columns. Rows that share a doc_id
    stay or go together; rows without one stay."""
    gone = near_duplicates(docs, shingle, percent).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return without(docs, materialize(gone, "gone"), "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2, 80)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
k AS (SELECT doc_id, list_sort(list(g)) AS g FROM s GROUP BY doc_id),
e AS (SELECT g, min(doc_id) AS class_id FROM k GROUP BY g)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept, coalesce(e.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id LEFT JOIN k USING (doc_id) LEFT JOIN e ON e.g = k.g
"""
