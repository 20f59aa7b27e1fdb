"""License scans by an exact set-similarity join, in DataFrame functions only.

Templates are token sets. A text contains a template where a block, a stretch of at most SPREAD times the template's words wherever its
lines break, holds at least `percent` per cent of the template's tokens. Texts are first joined with templates as whole sets,
which no block can exceed. All template tokens are put in one global order, rarest first, by the number of documents that hold them:
- length filter: a text must have that many tokens of any template at all;
- prefix filter: it must have one of the template's rarest tokens (all but as many as may miss, and one more), and that one
  must be among the text's own rarest;
- positional filter: the tokens after that one, on either side, must still be enough.
Candidates come from an equality join on prefix tokens; their blocks are verified at every start on the words, so every block
that meets the threshold is found and no other.

The corpus is parted into words once, for a table of each text's template tokens and base places; only the candidates' texts are
read again, told by a map of fixed size, and no text is shuffled but theirs. The templates are a fixed list, broadcast because its
size is a constant of this module or checked against MAX_TEMPLATE_TOKENS.

Defined results: a null text counts as empty (no words, no labels, score 0); null doc_ids are kept; repeated rows each get
their row; equal texts have the same result; very long texts are scanned whole; labels are a set, so ties don't matter; extra columns are
left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, native_map

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 90
#: A block has at most so many times the template's words.
SPREAD = 2
MAX_TEMPLATE_TOKENS = 5000

#: Phrases that the base scan counts, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices that the join looks for, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0 international attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
)


def _words(text: Column) -> Column:
    """The words of a lower-cased text, with an empty first or last one where the text begins or ends with separators. lower() also
    folds letters beyond A-Z; of those only the Kelvin sign becomes one of a-z, so it is made another letter first."""
    return F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), SEPARATORS)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _stands(parts: list[str]):
    return lambda i: _all([F.get("words", i + k) == w for k, w in enumerate(parts)])


def _parsed(docs: DataFrame, phrases, vocabulary: list[str]) -> DataFrame:
    """doc_id, key, n_words, own (the template tokens that stand in the text), starts (places of each phrase, null without one)."""
    worded = docs.withColumn("words", _words(F.col("text"))).select("doc_id", "key", "words", F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.col("words")).alias("own"))
    # words begin at 0, or at 1 where the first is empty
    lead, size = (F.col("words")[0] == "").cast("int"), F.size("words")
    last = ((size > 1) & (F.element_at("words", -1) == "")).cast("int")
    starts, any_phrase = [], F.lit(False)
    for phrase, _ in phrases:
        parts = phrase.split()
        here = _all([F.array_contains("own", w) for w in dict.fromkeys(parts)])
        any_phrase = any_phrase | here
        places = F.filter(F.sequence(F.lit(0), size - len(parts)), _stands(parts))
        starts.append(F.when(here & (size >= len(parts)), F.transform(places, lambda i: i - lead)).otherwise(F.array().cast("array<int>")))
    return worded.select("doc_id", "key", (size - lead - last).cast("long").alias("n_words"), "own", F.when(any_phrase, F.array(*starts)).alias("starts"))


def token_order(parsed: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by the number of documents that hold them, rarest first, ties by token."""
    seen = {r["token"]: r["count"] for r in parsed.select(F.explode("own").alias("token")).groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def matches(docs: DataFrame, parsed: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """key, label, containment: the texts with a block that contains a template. docs: key, text; parsed: their tokens."""
    sets = [(label, text.split(), list(dict.fromkeys(text.split()))) for label, text in templates]
    order = token_order(parsed, sorted({w for _, _, s in sets for w in s}))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words, tokens in sets:
        tokens = sorted(tokens, key=rank.get)
        need = math.ceil(len(tokens) * percent / 100)
        rows += [(label, w, i, len(tokens), need, SPREAD * len(words), tokens) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    index = docs.sparkSession.createDataFrame(rows, "label string, token string, template_at int, template_size int, need int, span int, tokens array<string>")
    least = min(r[4] for r in rows)
    ordered, rare = F.array(*[F.lit(w) for w in order]), F.array(*[F.lit(w) for w in sorted({r[1] for r in rows})])
    # array_intersect keeps the order of its first argument: the text's tokens in the global order
    own = parsed.filter((F.size("own") >= least) & F.arrays_overlap("own", rare)).select("key", F.array_intersect(ordered, "own").alias("own")).distinct()
    probes = own.select("key", "own", F.posexplode("own").alias("own_at", "token"))
    joined = probes.join(F.broadcast(index), "token").filter((F.size("own") >= F.col("need")) & (F.col("own_at") <= F.size("own") - F.col("need")) & (1 + F.least(F.col("template_size") - F.col("template_at") - 1, F.size("own") - F.col("own_at") - 1) >= F.col("need")))
    whole = joined.filter(F.size(F.array_intersect("own", "tokens")) >= F.col("need"))
    candidates = materialize(whole.select("key", "label", "template_size", "need", "span", "tokens").distinct(), "candidates")
    some = native_map(candidates, "key", 1 << 22)
    texts = docs.select("key", "text").filter(some(F.col("key"))).groupBy("key").agg(F.first("text").alias("text")).select("key", _words(F.col("text")).alias("words"))
    blocks = candidates.join(texts, "key").withColumn("at", F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("tokens", F.get("words", i - 1))))
    common = F.array_max(F.transform("at", lambda i: F.size(F.array_intersect("tokens", F.slice("words", i, F.col("span"))))))
    return blocks.withColumn("common", common).filter("common >= need").select("key", "label", (F.col("common") / F.col("template_size")).alias("containment"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base phrase, else the best containment, else 0)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    vocabulary = sorted({w for text in [t for _, t in templates] + [p for p, _ in phrases] for w in text.split()})
    if len(vocabulary) > MAX_TEMPLATE_TOKENS:
        raise ValueError("the template list is too large to broadcast")
    parsed = materialize(_parsed(source, phrases, vocabulary), "tokens")
    found = matches(source, parsed, templates, percent).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    flat = F.flatten("starts")
    labels = F.filter(F.array(*[F.when(F.size(F.col("starts")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    both = parsed.withColumn("base", F.when(F.col("starts").isNotNull(), F.array_distinct(labels)).otherwise(F.array().cast("array<string>"))).join(found, "key", "left")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(flat), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(F.coalesce(flat, F.array().cast("array<int>"))) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    templates = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', '{text}')" for text, label in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {phrases}) AS v(label, phrase)),
hit AS (
  SELECT row, label, i FROM (SELECT row, w, label, p, unnest(range(0, len(w) - len(p) + 1)) AS i FROM w, p WHERE len(w) >= len(p) AND list_contains(w, p[1]))
  WHERE w[i + 1 : i + len(p)] = p),
b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM hit GROUP BY row),
t AS (SELECT no, label, string_split(text, ' ') AS all_words, list_distinct(string_split(text, ' ')) AS t FROM (VALUES {templates}) AS v(no, label, text)),
c AS (SELECT row, w, no, label, t, len(all_words) AS n, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i]))) AS pos FROM w, t WHERE len(list_intersect(list_distinct(w), t)) >= ceil(len(t) * {PERCENT} / 100)),
m AS (SELECT row, label, no, max(len(list_intersect(list_distinct(w[pos : pos + {SPREAD} * n - 1]), t))) AS common, max(len(t)) AS size FROM c GROUP BY row, label, no),
g AS (SELECT row, list(DISTINCT label) AS more, max(common / size) AS best FROM m WHERE common >= ceil(size * {PERCENT} / 100) GROUP BY row)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN g USING (row)
"""


SQL = _sql()
