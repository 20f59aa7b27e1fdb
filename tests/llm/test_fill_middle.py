"""Fill-in-middle: SQL, the skip list against counting, round trips and edge rows."""

import hashlib
import re

import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ohmflow.llm import fill_middle

SF = "/root/testdata/sf0.01"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output), by counting matches."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark):
    assert compare.differences(spark, compare.connect(SF), fill_middle.query, fill_middle.SQL, SF) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x85  é😀<", max_size=400), st.integers(0, 400))
def test_skip_list_reaches_every_rank(text, rank):
    units = UNITS.findall(text)
    ends = fill_middle.unit_ends(text)
    assert ends.tolist() == [sum(map(len, units[: i + 1])) for i in range(len(units))]
    rank %= len(units) + 1
    assert fill_middle.SkipList(ends).chars_before(rank) == len("".join(units[:rank]))


def test_lanes_thin_out_and_agree():
    ends = fill_middle.unit_ends(" ab\n" * 50_000)
    lanes = fill_middle.SkipList(ends).lanes
    assert len(lanes) > 4 and all(len(up[0]) < len(low[0]) / 4 for low, up in zip(lanes[:3], lanes[1:4], strict=True))
    found = fill_middle.SkipList(ends)
    assert all(found.chars_before(r) == (ends[r - 1] if r else 0) for r in (0, 1, 2, 4999, 25_000, len(ends) - 1, len(ends)))


def test_edge_rows(spark):
    long = "wörd  x " * 60_000
    texts = [None, "", " ", "a", " a b ", "x <S> y", "<P", "<<S", "😀 é\n\nb", "\x85a b c", long]
    rows = [(i, t) for i in (None, -1, *range(24)) for t in texts] + [(3, "a b c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Form", F.lit(1)).withColumn("units", F.lit("kept"))
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "units", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.units for r in got} == {"kept"} and {r.form for r in got} == {"plain", "psm", "spm"}
    key = lambda x: repr(x)
    assert sorted([(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted([plainly(*r) for r in rows], key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_other_marks_and_rates(spark):
    docs = spark.createDataFrame([(i, f"a{i} <P> b c d") for i in range(40)], "doc_id int, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = fill_middle.fill_in_middle(docs, seed=7, rate=100, suffix_first=0, marks=marks).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"psm"} and all(r.back == r.text and r.output.startswith("[pre]") for r in got)
