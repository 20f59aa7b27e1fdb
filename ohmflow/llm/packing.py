"""Packing by power-of-two decomposition.

A document's ids (its tokens, then the id that ends a document) are cut into pieces of 2048 ids and, for the rest, one
piece for each binary digit of its length. Every piece is a sequence of its own, of a power-of-two length, so sequences of
one length form a bucket, no sequence crosses documents and none needs padding. The job is one pass without a shuffle.

Defined results: a null text counts as empty, and an empty text has one piece, the end id; null doc_ids and repeated rows
are packed like any other row, each on its own; a very long text is encoded whole and gives one piece for every 2048 ids; extra
columns are passed by; an empty table gives no pieces. The tokenizer's special
strings in a text become its special ids, as its file declares them.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

LIMIT = 2048
END_ID = 1
#: Distinct chunks whose ids a worker remembers; later ones are encoded each time. Only speed depends on it.
REMEMBERED = 100_000
#: Fixed value: how byte-level BPE cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r" \s|\s |^ | $")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """A byte-level BPE file's ids by token bytes, if its merges are numbered in the order in which they apply; else None."""
    whole = json.loads(Path(path).read_text())
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or whole.get("normalizer"):
        return None
    vocab, special = model["vocab"], {t["content"] for t in whole.get("added_tokens", [])}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    # byte-level files write each byte as a printable character: printable ones as themselves, the rest from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}


class Encoder:
    """Ids of texts as the tokenizer file gives them.

    Byte-level BPE never merges across a single space between words, so the ids of a text are those of its chunks
    `" word"`; frequent chunks are remembered. Where the file's merges are plain ranks they are applied by tiktoken, which is
    several times as fast as tokenizers and gives the same ids (the tests compare them); other files, and texts that hold one of the
    file's special strings, go through tokenizers."""

    def __init__(self, path: str):
        self.path = path
        self.special = [t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.fast = None
        if ranks := byte_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, which few texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.fast(text)).tobytes() if self.fast else self._direct(text)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._direct(text)
        if self.fast is None or _ODD.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        known, whole = self.known, self._whole
        out = [whole(first)]
        for word in rest:
            piece = known.get(word)
            if piece is None:
                piece = whole(" " + word)
                if len(known) < REMEMBERED:
                    known[word] = piece
            out.append(piece)
        return b"".join(out)


def piece_lengths(total: int, limit: int = LIMIT) -> list[int]:
    """Whole sequences first, then the binary digits of the rest, largest first."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path: str, limit: int, end_id: int, keep_ids: bool):
    def run(batches):
        encoder = Encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, starts, lengths, sums, totals, parts = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = memoryview(encoder.ids(text.as_py() or "") + end)
                total, start = len(ids) // 4, 0
                for n in piece_lengths(total, limit):
                    piece = ids[4 * start : 4 * (start + n)]
                    at.append(row)
                    starts.append(start)
                    lengths.append(n)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
                    if keep_ids:
                        parts.append(piece)
                    start += n
            columns = [batch.column("doc_id").take(pa.array(at, type=pa.int64())), *(pa.array(x, type=pa.int64()) for x in (starts, lengths, sums, totals))]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])
        del encoder
        give_back()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece, which is a sequence: doc_id, start, length, ids_crc32, doc_tokens, ids (if kept), bucket (log2 of
    the length), sequence_id, offset. write_buckets() stores them by bucket."""
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit is a power of two")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = source.mapInArrow(_pieces(tokenizer or default_tokenizer(), limit, end_id, keep_ids), schema)
    return pieces.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences of one length in one folder, so that a reader draws equal-length batches."""
    pieces.write.partitionBy("bucket").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
