"""Alignment of two tokenizers: brute force over the registered query, the monoid's laws, long texts and edge rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ohmflow.llm import token_align

SF = "/root/testdata/sf0.01"


def brute(rows):
    """The rows of the query by the libraries themselves, each text whole."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = first.encode(f" {text}", add_special_tokens=False).ids if text else [], second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            found.append((doc_id, 0, 0, "", []))
            continue
        ends_a, ends_b = ({e: i + 1 for i, e in enumerate(np.cumsum([len(x) for x in own]).tolist())} for own in (bytes_a, bytes_b))
        links, groups, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            k, m = ends_a[end], ends_b[end]
            links.append((a[k - 1], b[m - 1]))
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            i, j = k, m
        counts.update(links)
        found.append((doc_id, len(a), len(b), ";".join(groups), links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((d, na, nb, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if x else "") for d, na, nb, g, x in found), key=repr
    )


def queried(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("rid", F.lit("x")).write.parquet(str(tmp_path / name / "documents.parquet"))
    return sorted(map(tuple, token_align.query(spark, str(tmp_path / name)).collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, token_align.query(spark, SF).collect()), key=repr) == brute(rows)


def test_edge_rows(spark, tmp_path):
    r = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "ß", "中文", "😀", "!", "\x1c", "\x85", " ", " the", "<|endoftext|>", "</s>", "<0x41>", "▁", "\0", "٣"]
    rows = [(None, None), (None, "a b"), (1, ""), (2, " "), (3, "  x"), (4, "x "), (5, "a▁b"), (6, "same text"), (6, "same text"), (7, "a"), (8, "the the"), (8, "\n the")]
    rows += [(100 + i, "".join(r.choices(parts, k=r.randint(1, 12)))) for i in range(400)]
    assert queried(spark, rows, tmp_path, "edges") == brute(rows)
    assert queried(spark, [], tmp_path, "none") == []


def test_very_long_texts(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choices("abcdeéß1!?", k=r.randint(1, 9))) for _ in range(5000)]
    spaced = " ".join(r.choices(words, k=120_000))
    unspaced = "-".join(r.choices(words, k=90_000))
    rows = [(1, spaced), (2, unspaced), (3, f"short {spaced[:300_000]} {unspaced[:400_000]}  two\nspaces"), (4, f"{spaced[:270_000]} ▁ odd"), (5, "a b c")]
    assert all(len(t) > token_align.RANGE_BYTES for _, t in rows[:4])
    assert queried(spark, rows, tmp_path, "long") == brute(rows)
    aligned = token_align.align(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "FlatMapGroupsInArrow" in aligned._jdf.queryExecution().toString()


def test_shuffled_pairs_give_the_same(spark, tmp_path, monkeypatch):
    rows = [(i, f"the {i} thing of things {i % 7}") for i in range(60)]
    whole = queried(spark, rows, tmp_path, "few")
    monkeypatch.setattr(token_align, "BROADCAST_PAIRS", 0)
    assert queried(spark, rows, tmp_path, "many") == whole == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=25), st.lists(st.integers(1, 4), min_size=1, max_size=25), st.lists(st.integers(1, 60), max_size=5), st.randoms())
def test_fragments_are_an_associative_monoid(a_widths, b_widths, edges, r):
    """Any cuts into byte ranges, composed in any bracketing, give the fragment of the whole."""
    total = max(sum(a_widths), sum(b_widths))
    a_widths, b_widths = (w + [total - sum(w)] * (total > sum(w)) for w in (a_widths, b_widths))
    a, b = list(range(len(a_widths))), list(range(100, 100 + len(b_widths)))
    ends = np.cumsum(a_widths), np.cumsum(b_widths)
    whole = token_align.fragment(a, ends[0], b, ends[1])
    bounds = sorted({0, total, *(e for e in edges if e < total)})
    parts = [token_align.fragment(a, ends[0], b, ends[1], low, high) for low, high in zip(bounds, bounds[1:], strict=False)]
    while len(parts) > 1:
        i = r.randrange(len(parts) - 1)
        parts[i : i + 2] = [token_align.compose(parts[i], parts[i + 1])]
    assert parts[0] == whole == token_align.compose(token_align.Fragment(), whole) == token_align.compose(whole, token_align.Fragment())
