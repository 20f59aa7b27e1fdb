"""Fill-in-middle transformation with cuts found in an indexable skip list.

A text's units (white space with the word after it, or trailing white space) are the nodes of a skip list. Every lane carries two
widths for each link, the units and the code points that it spans. A node stands on lane k if k times in a row a hash of its
place is a multiple of FAN, so lanes thin out geometrically whatever the text. A cut after r units is found by going down: on each
lane links are followed while their unit widths still fit into what is left of r, and the code points passed are added up, so both
ranks are reached exactly after about FAN links a lane. A cut is then one slice of the text; nothing else is copied.

Which texts are transformed, how and where they are cut depends on doc_id and the seed only, so a lost task gives the same rows
again. It is one pass without a shuffle.

Defined results: null texts count as empty, and empty texts stay plain with 0 units, as do texts that hold one of the marks; a null doc_id
is hashed as an empty one; rows with one doc_id are cut by the same hashes, each on its own text; cuts that tie (equal ranks) give an
empty middle; very long texts are cut whole, at about 30 bytes of memory a code point for the one text at hand; extra columns are passed by,
whatever their names, but columns named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, mix64

SEED = 42
#: Percent of texts that are transformed, and of these the percent whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of how many nodes of a lane one, on average, stands on the next.
FAN = 8
#: Code points of output that a task holds before it gives them on.
FLUSH = 1 << 21
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"
_WHITE = np.zeros(128, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def unit_ends(text: str) -> np.ndarray:
    """The code point after each unit: a word's end, and the end of white space that no word follows."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    white = _WHITE[np.minimum(points, 127)] & (points < 128)
    after = np.append(white[1:], True)
    ends = np.flatnonzero(~white & after) + 1
    return np.append(ends, len(points)) if len(points) and white[-1] else ends


class SkipList:
    """Lanes from the lowest up: (node after each link, units of each link, code points of each link)."""

    def __init__(self, ends: np.ndarray):
        nodes, chars = np.arange(len(ends) + 1), np.concatenate([[0], ends])
        self.lanes, k = [], 0
        while True:
            self.lanes.append((nodes, np.diff(nodes), np.diff(chars[nodes])))
            k += 1
            up = mix64(nodes[1:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) % np.uint64(FAN) == 0
            nodes = np.concatenate([nodes[:1], nodes[1:][up]])
            if len(nodes) < 2:
                break

    def chars_before(self, rank: int) -> int:
        """Code points of the first `rank` units."""
        at = units = chars = 0
        for nodes, unit_width, char_width in reversed(self.lanes):
            link = int(np.searchsorted(nodes, at))  # every node of a lane stands on the lanes below it
            while link < len(unit_width) and units + unit_width[link] <= rank:
                units += int(unit_width[link])
                chars += int(char_width[link])
                link += 1
            at = int(nodes[link])
        return chars


def dice(seed: int, doc_id: int | None) -> list[int]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, seed: int, rate: int, suffix_first: int, marks: tuple[str, str, str]) -> tuple:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    one, two, three, four = dice(seed, doc_id)
    if not text or three % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    lanes = SkipList(ends)
    first, second = (lanes.chars_before(r) for r in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = marks
    if four % 100 < suffix_first:
        return n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    if len({*marks}) < 3 or any(a in b for a in marks for b in marks if a is not b) or any(not m for m in marks):
        raise ValueError("marks are three texts of which none holds another")
    added = [c.split()[0] for c in ADDED.split(", ")]
    kept = docs.drop(*added)
    wanted = kept.withColumns({"text": F.col("text").cast("string"), "doc_id": F.col("doc_id").cast("long")})
    names = wanted.columns
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            texts, ids = batch.column(names.index("text")), batch.column(names.index("doc_id"))
            lo, done, size = 0, [], 0
            for i in range(len(batch)):
                done.append(transformed(texts[i].as_py() or "", ids[i].as_py(), seed, rate, suffix_first, marks))
                size += len(done[-1][4])
                if size >= FLUSH or i == len(batch) - 1:
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, i + 1 - lo).columns, *columns], names=[*batch.schema.names, *added])
                    lo, done, size = i + 1, [], 0
        give_back()

    schema = StructType(wanted.schema.fields + StructType.fromDDL(ADDED).fields)
    return wanted.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    p, s, m = marks
    at = lambda mark: F.locate(mark, output)
    between = lambda mark, end: F.substr(output, at(mark) + F.lit(len(mark)), end - at(mark) - F.lit(len(mark)))
    middle = F.substr(output, at(m) + F.lit(len(m)))
    psm = F.concat(between(p, at(s)), middle, between(s, at(m)))
    spm = F.concat(between(p, at(m)), middle, between(s, at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
