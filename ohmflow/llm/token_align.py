"""Alignment of the tokens of two tokenizers by composing fragments.

Byte offsets where tokens of A and of B both end cut a text into groups. Any byte range of a text gives a fragment: the tokens up to its
first shared end (an open prefix, whose beginning only the range before it knows), the groups closed inside, and the tokens after
its last shared end (an open suffix). compose() joins the fragments of neighbouring ranges; it is associative, so the ranges of a
very long text are tokenized in different tasks and reduced as a tree, FAN ranges at a time. A text that fits into one range is
one fragment and is never shuffled.

Neither tokenizer has a token across a single space between two other characters, so texts are cut there (a B file whose pieces would
cross such a space is not cut). Stretches between cuts repeat (words, mostly), so a task remembers their fragments. A stretch without a
cut is tokenized whole and its ranges become fragments by the places of the tokens' ends.

How often an id pair is linked corpus-wide is summed from each text's own counts. The table of pairs is broadcast up to
BROADCAST_PAIRS rows, which are counted first; a larger one is joined by a shuffle in which each pair stands SALTS times, so
that links of one frequent pair are spread. Both ways give the same rows.

Defined results: texts null or empty, and texts whose joined tokens of A or B are other bytes than a space and the text (U+2581 in
it, for example), have no tokens: zeros, no groups; their links count nowhere. Null doc_ids and repeated rows are results of their own, each row
counted; ties for a B id's highest count all count as best; strings of special tokens are plain text; very long texts are cut as
above, and the text of one document's groups meets in one task at the end; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialize
from .packing import PATTERN, byte_ranks, default_tokenizer

#: Bytes of a range; longer texts are spread over tasks.
RANGE_BYTES = 1 << 18
#: Fragments that one step of the tree composes.
FAN = 16
#: Stretches that a task remembers, and their longest one in characters. Only speed depends on them.
REMEMBERED, SHORT = 250_000, 48
#: Rows of the pair table (two ids and a count) that may be broadcast, and the copies of a pair beyond that.
BROADCAST_PAIRS, SALTS = 1 << 20, 32
#: Bytes of texts whose results a task holds before it gives them on.
FLUSH = 1 << 21
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Fragment:
    """What a byte range knows. Without a shared end (cut is False) all its tokens stand in the prefix. Ids are comma-joined, groups
    are `a|b` joined by semicolons; pairs counts the links, which are the shared ends."""

    good: bool = True
    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    head_a: str = ""
    head_b: str = ""
    body: str = ""
    tail_a: str = ""
    tail_b: str = ""
    pairs: Counter = field(default_factory=Counter)


def _plus(left: str, right: str, mark: str = ",") -> str:
    return f"{left}{mark}{right}" if left and right else left or right


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; Fragment() is neutral."""
    both = {"good": left.good and right.good, "n_a": left.n_a + right.n_a, "n_b": left.n_b + right.n_b, "cut": left.cut or right.cut, "pairs": left.pairs + right.pairs}
    if not left.cut:
        return Fragment(**both, head_a=_plus(left.head_a, right.head_a), head_b=_plus(left.head_b, right.head_b), body=right.body, tail_a=right.tail_a, tail_b=right.tail_b)
    open_a, open_b = _plus(left.tail_a, right.head_a), _plus(left.tail_b, right.head_b)
    if not right.cut:
        return Fragment(**both, head_a=left.head_a, head_b=left.head_b, body=left.body, tail_a=open_a, tail_b=open_b)
    return Fragment(**both, head_a=left.head_a, head_b=left.head_b, body=_plus(_plus(left.body, f"{open_a}|{open_b}", ";"), right.body, ";"), tail_a=right.tail_a, tail_b=right.tail_b)


def groups_of(whole: Fragment) -> str:
    """The groups of a fragment that covers a text; its last tokens end together, so nothing is left open behind."""
    return _plus(f"{whole.head_a}|{whole.head_b}", whole.body, ";") if whole.good and whole.cut else ""


def fragment(a: list[int], a_ends: np.ndarray, b: list[int], b_ends: np.ndarray, low: int = 0, high: int | None = None) -> Fragment:
    """The fragment of the bytes from low to high, of which the tokens that end in there are given by ids and ends."""
    if high is not None:
        (i, j), (k, m) = np.searchsorted(a_ends, [low, high], side="right"), np.searchsorted(b_ends, [low, high], side="right")
        a, a_ends, b, b_ends = a[i:j], a_ends[i:j], b[k:m], b_ends[k:m]
    _, ia, ib = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    out = Fragment(n_a=len(a), n_b=len(b), cut=bool(len(ia)))
    said = lambda ids: ",".join(map(str, ids))
    if not out.cut:
        out.head_a, out.head_b = said(a), said(b)
        return out
    stops_a, stops_b = (ia + 1).tolist(), (ib + 1).tolist()
    out.head_a, out.head_b = said(a[: stops_a[0]]), said(b[: stops_b[0]])
    out.body = ";".join(f"{said(a[i:j])}|{said(b[k:m])}" for i, j, k, m in zip(stops_a, stops_a[1:], stops_b, stops_b[1:], strict=False))
    out.tail_a, out.tail_b = said(a[stops_a[-1] :]), said(b[stops_b[-1] :])
    out.pairs = Counter(zip([a[i - 1] for i in stops_a], [b[i - 1] for i in stops_b], strict=True))
    return out


class Pair:
    """Both tokenizers, as a task uses them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(a_path)
        if ranks is None:
            raise ValueError(f"{a_path} is no byte-level BPE whose merges are ranks")
        self.encode_a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = {i: token for token, i in ranks.items()}
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = functools.partial(model.encode, num_threads=1)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.said_a, self.said_b = [str(i) for i in range(max(self.bytes_a) + 1)], [str(i) for i in range(len(pieces))]
        self.known: dict[str, tuple | None] = {}

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def tokens(self, stretch: str):
        """(A's ids, their ends, B's ids, their ends), or None where tokens are other bytes than a space and the stretch."""
        raw = b" " + stretch.encode()
        a, b = self.encode_a(" " + stretch), self.encode_b(stretch)
        bytes_a, bytes_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        return a, np.cumsum([len(x) for x in bytes_a]), b, np.cumsum([len(x) for x in bytes_b])

    def closed(self, stretch: str) -> tuple | None:
        """(groups, packed links, tokens of A and of B) of a stretch, which begins and ends with shared ends; None if its bytes differ."""
        found = self.tokens(stretch)
        if not found:
            return None
        whole = fragment(*found)
        return groups_of(whole), array("q", [(x << 32) | y for x, y in whole.pairs.elements()]).tobytes(), whole.n_a, whole.n_b

    def closed_all(self, stretches: list[str]) -> list[tuple | None]:
        """closed() of each, tokenized as one text: no token crosses the spaces between them."""
        simple = [i for i, s in enumerate(stretches) if not (s[0].isspace() or s[-1].isspace() or "\u2581" in s)] if self.cuts else []
        out: list[tuple | None] = [None] * len(stretches)
        found = self.tokens(" ".join([stretches[i] for i in simple])) if simple else None
        if not found:
            return [self.closed(s) for s in stretches]
        a, a_ends, b, b_ends = found
        said_a, said_b = [self.said_a[i] for i in a], [self.said_b[i] for i in b]
        _, ia, ib = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        ends = np.cumsum([len(stretches[i].encode()) + 1 for i in simple])
        packed = (np.array(a, np.int64)[ia] << 32 | np.array(b, np.int64)[ib]).tobytes()
        stops_a, stops_b = [0, *(ia + 1).tolist()], [0, *(ib + 1).tolist()]
        groups = [
            f"{said_a[i]}|{said_b[k]}" if j - i == 1 == m - k else f"{','.join(said_a[i:j])}|{','.join(said_b[k:m])}"
            for i, j, k, m in zip(stops_a, stops_a[1:], stops_b, stops_b[1:], strict=False)
        ]
        first = 0
        for i, last in zip(simple, (np.searchsorted(a_ends[ia], ends) + 1).tolist(), strict=True):
            out[i] = ";".join(groups[first:last]), packed[8 * first : 8 * last], stops_a[last] - stops_a[first], stops_b[last] - stops_b[first]
            first = last
        for i in set(range(len(stretches))).difference(simple):
            out[i] = self.closed(stretches[i])
        return out

    def lookup(self, texts: list[list[str]]):
        """A function from a stretch of these texts to its closed(); new ones are tokenized together and remembered."""
        known = self.known
        new = list({s: None for parts in texts for s in parts if s not in known and len(s) < RANGE_BYTES // 4})
        here = {}
        for s, found in zip(new, self.closed_all(new) if new else [], strict=True):
            if len(s) <= SHORT and len(known) < REMEMBERED:
                known[s] = found
            else:
                here[s] = found
        return lambda s: known[s] if s in known else here[s]


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    """Kept by the worker for its later tasks."""
    return Pair(a_path, b_path)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (rid, doc_id, place, good, n_a, n_b, cut, five texts, packed pairs, their counts)."""
    columns = list(zip(*rows, strict=True))
    keys, counts = columns[-2], columns[-1]
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
    flat, n = np.concatenate(keys), np.concatenate(counts)
    pairs = pa.StructArray.from_arrays([pa.array(flat >> 32, pa.int32()), pa.array(flat & 0xFFFFFFFF, pa.int32()), pa.array(n, pa.int32())], names=["a", "b", "n"])
    types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2 + [pa.bool_()] + [pa.string()] * 5
    arrays = [pa.array(c, t) for c, t in zip(columns[:-2], types, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=[c.split()[0] for c in _COLUMNS] + ["pairs"])


_COLUMNS = ["rid long", "doc_id long", "place long", "good boolean", "n_a long", "n_b long", "cut boolean", "head_a string", "head_b string", "body string", "tail_a string", "tail_b string"]
_SCHEMA = ", ".join(_COLUMNS) + ", pairs array<struct<a:int,b:int,n:int>>"
_NONE = np.zeros(0, np.int64)


def _row(rid, doc_id, place, f: Fragment) -> tuple:
    keys = np.array([(x << 32) | y for x, y in f.pairs], np.int64)
    return rid, doc_id, place, f.good, f.n_a, f.n_b, f.cut, f.head_a, f.head_b, f.body, f.tail_a, f.tail_b, keys, np.fromiter(f.pairs.values(), np.int64, len(f.pairs))


def _whole(rid, doc_id, place: int, found: list[tuple | None]) -> tuple:
    """The row of neighbouring stretches, each of which begins and ends with a shared end."""
    if None in found:
        return _row(rid, doc_id, place, Fragment(good=False))
    groups, packed, n_a, n_b = zip(*found, strict=True)
    keys, counts = np.unique(np.frombuffer(b"".join(packed), np.int64), return_counts=True)
    head, _, body = ";".join(groups).partition(";")
    head_a, _, head_b = head.partition("|")
    return rid, doc_id, place, True, sum(n_a), sum(n_b), True, head_a, head_b, body, "", "", keys, counts


def _rows(pair: Pair, rid, doc_id, place: int, parts: list[str], closed):
    """Rows of one range: one for its stretches together, unless a long stretch without a cut comes between, which has rows for its
    own ranges, at the places of whose edges tokens may lie across."""
    run: list = []
    start = at = place
    for part in parts:
        if len(part) < RANGE_BYTES // 4:
            run.append(closed(part))
            at += len(part.encode()) + 1
            continue
        if run:
            yield _whole(rid, doc_id, start, run)
        width, found = len(part.encode()) + 1, pair.tokens(part)
        for low in range(0, width, RANGE_BYTES):
            yield _row(rid, doc_id, at + low, fragment(*found, low, min(low + RANGE_BYTES, width)) if found else Fragment(good=False))
        at += width
        run, start = [], at
    if run:
        yield _whole(rid, doc_id, start, run)


def _fragments(a_path: str, b_path: str):
    def run(batches):
        pair = _pair(a_path, b_path)
        for batch in batches:
            ids, texts = [batch.column(i).to_pylist() for i in range(3)], batch.column(3)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + FLUSH, side="right")))
                parts = [pair.stretches(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                closed = pair.lookup(parts)
                rows = []
                for rid, doc_id, place, own in zip(*(c[lo:hi] for c in ids), parts, strict=True):
                    if len(own) and max(map(len, own)) < RANGE_BYTES // 4:
                        rows.append(_whole(rid, doc_id, place, [closed(s) for s in own]))
                    else:
                        rows += _rows(pair, rid, doc_id, place, own, closed)
                yield _record(rows)
                lo = hi
        give_back()

    return run


def _ranges(batches):
    """Texts cut at single spaces into ranges of RANGE_BYTES or a little more; place is the byte where a range begins."""
    for batch in batches:
        for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            place, lo, rows = 0, 0, []
            while lo < len(text):
                cut = _CUT.search(text, lo + RANGE_BYTES // 2)
                part = text[lo : cut.start()] if cut else text[lo:]
                rows.append((rid, doc_id, place, part))
                place += len(part.encode()) + 1
                lo = cut.end() if cut else len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rid", "doc_id", "place", "text"])


def _composed(table: pa.Table) -> pa.Table:
    """One step of the tree: the fragments of one parent, in order."""
    whole = Fragment()
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    for r in rows:
        pairs = Counter({(x["a"], x["b"]): x["n"] for x in r["pairs"]})
        whole = compose(whole, Fragment(*(r[c.split()[0]] for c in _COLUMNS[3:]), pairs=pairs))
    return pa.Table.from_batches([_record([_row(rows[0]["rid"], rows[0]["doc_id"], rows[0]["place"], whole)])])


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """One row per row of docs: rid (a number of the row), doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`) and pairs (a, b, n: how often
    tokens of these ids end together)."""
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("place"), F.col("text").cast("string").alias("text"))
    size = F.octet_length("text")
    run = _fragments(tokenizer_a or default_tokenizer(), tokenizer_b or default_pieces())
    short = source.filter((size > 0) & (size < RANGE_BYTES)).mapInArrow(run, _SCHEMA)
    without = source.filter((F.coalesce(size, F.lit(0)) == 0)).select("rid", "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b")), F.lit("").alias("groups"), F.array().cast("array<struct<a:int,b:int,n:int>>").alias("pairs"))
    long = source.filter(size >= RANGE_BYTES)
    longest = long.agg(F.max(size)).first()[0] or 0
    whole = short
    if longest:
        cut = long.select("rid", "doc_id", "text").mapInArrow(_ranges, "rid long, doc_id long, place long, text string").repartition("rid", "place")
        tree, step = cut.mapInArrow(run, _SCHEMA), RANGE_BYTES // 2
        while step <= longest:
            step *= FAN
            tree = tree.groupBy("rid", F.expr(f"place div {step}L")).applyInArrow(_composed, _SCHEMA)
        whole = short.unionByName(tree)
    nothing = F.array().cast("array<struct<a:int,b:int,n:int>>")
    head = F.concat("head_a", F.lit("|"), "head_b")
    done = whole.select(
        "rid", "doc_id", *(F.when(F.col("good"), F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b")),
        F.when(~F.col("good"), "").when(F.col("body") == "", head).otherwise(F.concat(head, F.lit(";"), "body")).alias("groups"), F.when(F.col("good"), F.col("pairs")).otherwise(nothing).alias("pairs"),
    )
    return done.unionByName(without).withColumn("n_groups", F.aggregate("pairs", F.lit(0).cast("long"), lambda n, p: n + p["n"]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Corpus-wide: a, b, count (links of the pair), best (no pair of that B id has more)."""
    counts = aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def link_scores(aligned: DataFrame) -> DataFrame:
    """rid, n_best and count_sum of the rows of a written table that have links."""
    counts = materialize(pair_counts(aligned), "pair-counts")
    links = aligned.select("rid", F.inline("pairs"))
    if counts.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), ["a", "b"])
    else:
        copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", (F.pmod(F.xxhash64("rid"), F.lit(SALTS))).cast("int")).join(copies, ["a", "b", "salt"])
    return met.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))


def query(spark, sf_dir: str) -> DataFrame:
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = materialize(aligned.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"), "aligned")
    scored = kept.drop("pairs").join(link_scores(kept), "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
