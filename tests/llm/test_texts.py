"""Packing, line dedup, toxicity, URLs, quotes, secrets and the pipeline."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ohmflow.llm import line_dedup, packing, quote_link, secret_scan, toxicity, url_filter

SF = "/root/testdata/sf0.01"


# --- packing ---


def test_ids_equal_the_tokenizer_library(spark):
    from array import array

    encoder = packing.Encoder(packing.default_tokenizer())
    direct = lambda t: array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
    r = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "ß", "中", "😀", "!", "..", "\x1c", "\x85", " the", "<|endoftext|>", "٣", "̀"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)] + [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    assert all(encoder.ids(t) == direct(t) for t in texts)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(None, "x y"), (-1, None), (-2, ""), (-3, "word " * 5000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra).withColumn("length", F.lit(0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoder = packing.Encoder(packing.default_tokenizer())
    rows = packing.pack(docs).orderBy("doc_id", "start").collect()
    found = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.length == len(r.ids) == 1 << r.bucket
        assert r.start == len(found.setdefault(r.doc_id, [])) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        found[r.doc_id] += r.ids
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc_id, ids in found.items():
        assert np.array(ids, "<u4").tobytes() == encoder.ids(texts[doc_id] or "") + np.array([1], "<u4").tobytes()
    assert set(found) == set(texts)
    assert packing.pack(docs.limit(0)).collect() == []


def test_buckets_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).groupBy("bucket").count().count() >= 1


# --- line dedup ---


def brute_runs(rows, least):
    """Units repeated in runs of GRAM units or more that stood earlier, by comparing all positions."""
    docs = []
    for doc_id, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, words, _, _ = line_dedup.units(raw, np.array([0, len(raw)]))
        docs.append((doc_id, h.tolist(), words.tolist()))
    out = {}
    for j, (d, own, words) in enumerate(docs):
        gone = set()
        for i in range(j + 1):
            other = docs[i][1]
            for shift in range(-len(other), len(own)):
                if i == j and shift <= 0:
                    continue
                run = []
                for k in range(len(own) + 1):
                    if k < len(own) and 0 <= k - shift < len(other) and own[k] == other[k - shift]:
                        run.append(k)
                        continue
                    if len(run) >= line_dedup.GRAM + line_dedup.WINDOW - 1 and sum(words[x] for x in run) >= least:
                        gone |= set(run)
                    run = []
        out[d] = sum(words[x] for x in gone)
    return out


def test_repeated_runs_equal_brute_force(spark):
    r = random.Random(5)
    sentence = lambda: " ".join(f"v{r.randrange(3000)}" for _ in range(r.randint(4, 16))) + "."
    passage = [" ".join(sentence() for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(40):
        lines = [sentence() for _ in range(r.randint(1, 6))]
        if r.random() < 0.6:
            lines.insert(r.randrange(len(lines) + 1), r.choice(passage))
        rows.append((i, "\n".join(lines)))
    rows += [(40, rows[3][1]), (41, None), (42, ""), (43, " \n\t "), (44, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("runs", F.lit(1))
    out = {x.doc_id: x for x in line_dedup.dedup_lines(df, 50).collect()}
    assert {d: x.removed_words for d, x in out.items()} == brute_runs(rows, 50)
    texts = [x.text for x in out.values() if x.text]
    for p in passage:
        assert len(p.split()) < 50 or sum(p in t for t in texts) <= 1
    assert out[41].text is None and out[42].text == "" and out[43].text == " \n\t " and out[44].text == "one"
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_passage_inside_a_line_and_repeated_rows(spark):
    body = " ".join(f"Word{i} and more of it here." for i in range(14))
    rows = [(1, "Head one. " + body), (2, "Other head. " + body + " Tail stays."), (2, "Other head. " + body + " Tail stays."), (None, "x")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.text for x in out) == sorted([rows[0][1], "Other head. Tail stays.", "Other head. Tail stays.", "x"])


def test_a_null_id_is_no_other_id(spark):
    """The first copy stays whatever ids the copies have."""
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(None, t), (-1, t), (5, t), (-7, "x " + t)]
    out = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == {None: t, -1: "", 5: "", -7: "x"}
    out = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows[1:3], "doc_id long, text string")).collect()}
    assert out == {-1: t, 5: ""}


def window_brute(rows, least):
    """Words in windows of `least` words that stood earlier; of a window that overlaps its first copy, those after the copy."""
    first, out = {}, {}
    for d, text in rows:
        words = (text or "").lower().split()
        gone = set()
        for i in range(len(words) - least + 1):
            at, k = first.setdefault(tuple(words[i : i + least]), (d, i))
            if (at, k) != (d, i):
                gone |= set(range(max(i, k + least) if at == d else i, i + least))
        out[d] = " ".join(w for i, w in enumerate((text or "").split()) if i not in gone)
    return out


def test_repeats_between_later_documents(spark):
    """A first document that shares part of a passage only hides no repeat of the others."""
    r = random.Random(9)
    fresh = lambda n: [f"u{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(12):
        passage = sum(([*fresh(10), f"e{k}x{i}."] for i in range(5)), [])
        texts += [["S.", *passage[:33], *fresh(9)], ["S.", *passage[11:44], *fresh(9)], ["S.", *passage[22:], *fresh(20)], ["S.", *passage, *fresh(5)], ["T.", *passage, *fresh(3)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: x.text for d, x in out.items()} == window_brute(rows, 50) and all(out[d].removed_words == 55 for d in range(4, 60, 5))


def test_repeats_at_any_offset(spark):
    """Passages without sentence ends at other offsets, periodic text, and copies with changed words."""
    r = random.Random(10)
    fresh = lambda n: [f"u{r.randrange(10**6)}" for _ in range(n)]
    passage = fresh(50)
    texts = [fresh(5) + passage + fresh(1), fresh(12) + passage[:49] + fresh(3), fresh(16) + passage + ["z"], ["a"] * 130, fresh(3) + ["a"] * 70, ["b", "c", "d"] * 60]
    base = fresh(400)
    for _ in range(30):
        words = list(base)
        for _ in range(r.randint(1, 8)):
            words[r.randrange(400)] = fresh(1)[0]
        lo = r.randrange(300)
        texts.append(fresh(r.randint(0, 20)) + words[lo : lo + r.randint(40, 300)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {d: x.text for d, x in out.items()} == window_brute(rows, 50)
    assert out[2].removed_words == 50 and out[1].removed_words == 0 and out[3].text == " ".join(["a"] * 50)


# --- toxicity ---


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    found = scored.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97
    assert (found.predicted[found.toxic == 1]).mean() > 0.85


def test_counterfactual_penalty_lowers_identity_scores():
    r = random.Random(2)
    fill = lambda: " ".join(f"n{r.randrange(60)}" for _ in range(6))
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        term = "muslims" if r.random() < (0.7 if toxic else 0.1) else ""
        texts.append(f"{fill()} {term} {'awfulness' if toxic and r.random() < 0.8 else ''}")
        labels.append(int(toxic))
    gap = []
    for penalty in (0.0, 20.0):
        s = toxicity.Scorer(*toxicity.fit(texts, labels, penalty))
        gap.append(s.score("neighbours muslims meet") - s.score("neighbours christians meet"))
    assert gap[1] < gap[0] / 2


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad bad"), (2, "good"), (None, None), (4, ""), (4, "")], "doc_id long, text string").withColumn("score", F.lit(1.0)).withColumn("_n", F.lit(2))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs.drop("score"), toxicity.train(docs, none)).collect()
    assert [r.score for r in out] == [0.0] * 5
    assert [r.score for r in toxicity.keep_clean(docs, none).collect()] == [1.0] * 5
    assert toxicity.score(docs.limit(0).drop("score"), toxicity.train(docs, none)).collect() == []


# --- urls ---


def best_split(name, logs):
    """Best sum over all splits."""
    if not name:
        return 0.0
    return max(logs.get(name[:k], url_filter.UNKNOWN * (1 + k)) + best_split(name[k:], logs) for k in range(1, len(name) + 1))


def test_segmentation_is_the_best_split():
    logs = {"news": -2.0, "new": -2.2, "report": -2.5, "s": -3.0, "port": -2.6, "re": -2.4}
    assert url_filter.segment("newsreport", logs) == ["news", "report"]
    r = random.Random(4)
    for _ in range(200):
        name = "".join(r.choice("newsrpot") for _ in range(r.randint(1, 9)))
        words = url_filter.segment(name, logs)
        assert "".join(words) == name
        assert abs(sum(logs.get(w, url_filter.UNKNOWN * (1 + len(w))) for w in words) - best_split(name, logs)) < 1e-9


def test_rules_and_edges(spark):
    urls = ["http://A.Example.ORG/es/x?y", "https://example.org/en/12", "http://x.com/de/1#a", "http://x.com/fr/", "ftp://org", "http://org/", "no url", None, "://", "http://exampleorg/es/", "http://x.net/q?://z/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("h")).withColumn("html", F.lit("x news report"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages, pages, "html").collect()}
    assert [got[i].rule for i in range(11)] == ["example.org/es/", "example.org/en/1", "com/de/", "com/fr/", None, "org/", None, None, None, None, None]
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/x") and (got[7].host, got[7].path) == ("", "") and (got[10].host, got[10].path) == ("x.net", "/q")
    assert (got[4].host, got[4].path) == ("org", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[0].verdict == "block" and got[3].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), pages, "html").collect() == []


def brute_scores(rows):
    """The whole method in plain Python: counts of all words, splits, class counts of all tokens."""
    import math
    import re

    word_counts = {}
    for _, _, html in rows:
        for w in re.split(r"[^a-z]+", re.sub(r"<[^>]*>", " ", (html or "").lower())):
            if 0 < len(w) <= url_filter.LONGEST_WORD:
                word_counts[w] = word_counts.get(w, 0) + 1
    total = sum(word_counts.values())
    logs = {w: math.log10(n / total) for w, n in word_counts.items()}
    drop = {"org", "example", "es", "en", "1", "com", "fr", "de"}
    made = []
    for page, url, _ in rows:
        host, _, path = (url or "").partition("://")[2].partition("/")
        host, path = host.lower(), ("/" + path if path else "").split("?")[0].split("#")[0]
        tokens = []
        for part in re.findall(r"[a-z]+|[0-9]+", ".".join(host.split(".")[:-1])):
            if part not in drop:
                tokens += ["h:0"] if part[0].isdigit() else [f"h:{w}" for w in url_filter.segment(part, logs)]
        tokens += ["p:0" if p[0].isdigit() else f"p:{p}" for p in re.findall(r"[a-z]+|[0-9]+", path.lower()) if p not in drop]
        fits = [(len(h + p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        made.append((page, tokens, max(fits)[1] if fits else None))
    count = {"allow": {}, "block": {}}
    docs = {"allow": 0, "block": 0}
    for _, tokens, says in made:
        if says:
            docs[says] += 1
            for t in tokens:
                count[says][t] = count[says].get(t, 0) + 1
    kinds = set(count["allow"]) | set(count["block"])
    part = lambda t, c: (count[c].get(t, 0) + 1) / (sum(count[c].values()) + len(kinds))
    prior = math.log((docs["block"] + 1) / (docs["allow"] + 1))
    return {page: prior + sum(math.log(part(t, "block") / part(t, "allow")) for t in tokens if t in kinds) for page, tokens, _ in made}


def planted_pages(seed: int, n: int) -> list[tuple]:
    """Hosts of two joined words: trade words under blocked paths and hosts, news words under allowed ones; a third unruled."""
    r = random.Random(seed)
    bad, good = ["casino", "poker", "pills", "cheap", "bonus", "lotto"], ["news", "daily", "school", "garden", "music", "river"]
    rows = []
    for i in range(n):
        block = r.random() < 0.4
        name = "".join(r.choice(bad if block else good) for _ in range(2)) if r.random() < 0.9 else r.choice(["shopworld", "portal7"])
        tail = r.choice(["com/de/", "net/x/"] if block else ["org/en/", "com/fr/", "net/y/"])
        html = f"<p class='casinopoker'>{r.choice(bad)} {r.choice(good)} {r.choice(bad)}. {r.choice(good)} page</p>"
        rows.append((i, f"https://www.{name}.{tail}{r.choice(['shop', 'story'])}/{r.randrange(9000)}?q={i}", html))
    return rows


def test_url_scores_equal_brute_force_and_find_unruled_hosts(spark):
    rows = [*planted_pages(6, 400), (900, None, None), (901, "no url", "casino"), (902, "http://" + "x" * 70 + ".net/", ""), (903, "http://a1b2.example.net/" + "w/" * 3000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("score", F.lit("s")).repartition(4)
    got = {x.page_id: x for x in url_filter.filter_urls(df, df, "html").collect()}
    wanted = brute_scores([x for x in rows if x[0] != 902])
    assert len(got) == len(rows) and all(abs(got[i].score - wanted[i]) < 1e-6 for i in wanted)
    open_urls = [(got[i].verdict, "block" if "net/x/" in url else "allow") for i, url, _ in rows[:400] if got[i].rule is None and "shopworld" not in url and "portal7" not in url]
    assert len(open_urls) > 80 and sum(a == b for a, b in open_urls) / len(open_urls) > 0.97


# --- quotes ---


ROWS = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked_and_removed(spark):
    rows = [(1, 0, "user", "Hello there friend.\nHow are you?"), (1, 1, "assistant", "I am fine.\nThanks a lot."), (1, 2, "user", "Bob wrote:\n> I am fine!\n>> How are you?\nGood to hear."), (2, 0, "user", "> Thanks a lot.\nWhat was this?"), (3, 0, "user", None), (None, 0, "user", "> I am fine."), (4, 0, "user", "> never said"), (4, 0, "user", "> never said")]
    df = spark.createDataFrame(rows, ROWS).withColumn("position", F.lit(7)).withColumn("key", F.lit("k"))
    links = {(r.conv_id, r.turn, r.level): (r.source_conv, r.source_turn) for r in quote_link.passages(df.drop("key")).collect()}
    assert links == {(1, 2, 1): (1, 1), (1, 2, 2): (1, 0), (2, 0, 1): (1, 1), (4, 0, 1): (None, None)}
    out = {(r.conv_id, r.turn): r for r in quote_link.rebuild(df).collect()}
    assert out[1, 2].text == "Good to hear." and (out[1, 2].reply_conv, out[1, 2].reply_turn) == (1, 1)
    assert out[2, 0].thread_id == 1 and out[2, 0].text == "What was this?" and out[3, 0].text == ""
    assert out[None, 0].text == "" and out[4, 0].n_quotes == 1 and out[4, 0].n_linked == 0
    assert quote_link.rebuild(df).count() == len(rows)
    assert quote_link.rebuild(df.limit(0)).collect() == []


def planted_quotes(seed: int) -> list[tuple]:
    """Conversations whose messages quote earlier ones, some two levels deep, some wrapped anew, some from other conversations."""
    r = random.Random(seed)
    sentence = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(5, 14))).capitalize() + r.choice(".!?")
    rows, said = [], []
    for conv in range(60):
        for turn in range(r.randint(1, 6)):
            own = [" ".join(sentence() for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))]
            text, source = "\n".join(own), None
            if said and r.random() < 0.6:
                near = [x for x in said if x[0] == conv]
                source = r.choice(near if near and r.random() < 0.6 else said)
                quoted = "\n".join(source[2])
                if r.random() < 0.5:
                    words = quoted.split()
                    quoted = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
                deeper = r.choice(said)
                text = "On Monday, Ann wrote:\n>> " + deeper[2][0] + "\n> " + quoted.replace("\n", "\n> ") + "\n\n" + text
            rows.append((conv, turn, r.choice(["user", "assistant"]), text, None if source is None else source[:2]))
            said.append((conv, turn, own))
    return rows


def test_planted_quotes_equal_sql_and_keep_reply_order(spark, tmp_path):
    import compare

    rows = planted_quotes(3)
    extra = [(60, 0, "user", "> quoted by no one\n\n\n\nx  "), (60, 0, None, "a"), (None, 1, "user", "> a"), (61, None, "user", None), (62, 3, "user", ""), (62, 4, "user", "Sue said:\nno quote\n> \n>"), (63, 0, "user", "word " * 20000 + "\n> a")]
    spark.createDataFrame([x[:4] for x in rows] + extra, ROWS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare.differences(spark, con, quote_link.query, quote_link.SQL, str(tmp_path)) == []
    out = {(x.conv_id, x.turn): x for x in quote_link.query(spark, str(tmp_path)).collect()}
    linked = [(c, t, source) for c, t, _, _, source in rows if source]
    assert sum((out[c, t].reply_conv, out[c, t].reply_turn) == source for c, t, source in linked) >= 0.95 * len(linked) > 40
    for x in out.values():
        if x.reply_conv is not None:
            to = out[x.reply_conv, x.reply_turn]
            assert to.thread_id == x.thread_id and to.position < x.position
    assert all(">" not in x.text and "wrote:" not in x.text for c, x in out.items() if c[0] is not None and c[0] < 60)


def test_a_quote_of_a_later_turn_of_another_conversation(spark):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "two"), (1, 5, "user", "The fifth thing"), (2, 0, "user", "> the fifth thing\nyes")]
    out = {(x.conv_id, x.turn): (x.thread_id, x.position) for x in quote_link.rebuild(spark.createDataFrame(rows, ROWS)).collect()}
    assert out == {(1, 0): (1, 0), (1, 1): (1, 1), (1, 5): (1, 2), (2, 0): (1, 3)}


def test_a_quote_of_a_conversation_with_a_larger_id(spark, tmp_path):
    import compare

    # 2 quotes the only place of a sentence, in 7; 9 quotes it too; 3 says its quoted sentence itself, but later, and 8 has it too
    rows = [(2, 0, "user", "first"), (2, 1, "user", "> The only place of this.\nyes"), (2, 2, "user", "third"), (7, 0, "user", "opening"), (7, 1, "user", "The only place of this."), (9, 0, "user", "> The only place of this."),
            (3, 0, "user", "> Said in two places."), (3, 1, "user", "Said in two places."), (8, 4, "user", "Said in two places.")]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    out = {(x.conv_id, x.turn): x for x in quote_link.query(spark, str(tmp_path)).collect()}
    assert [(out[k].reply_conv, out[k].reply_turn) for k in [(2, 1), (9, 0), (3, 0)]] == [(7, 1), (7, 1), (8, 4)]
    assert [k for k, x in sorted(out.items(), key=lambda kx: kx[1].position) if x.thread_id == 2] == [(2, 0), (7, 0), (7, 1), (2, 1), (2, 2), (9, 0)]
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare.differences(spark, con, quote_link.query, quote_link.SQL, str(tmp_path)) == []


def test_planted_quotes_under_shuffled_ids(spark, tmp_path):
    import compare

    rows = planted_quotes(5)
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    spark.createDataFrame([(ids[c], *rest) for c, *rest in (x[:4] for x in rows)], ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    out = {(x.conv_id, x.turn): x for x in quote_link.query(spark, str(tmp_path)).collect()}
    linked = [((ids[c], t), (ids[source[0]], source[1])) for c, t, _, _, source in rows if source]
    later = [x for x in linked if x[1][0] > x[0][0]]
    for some in (linked, later):
        assert sum((out[m].reply_conv, out[m].reply_turn) == source for m, source in some) >= 0.95 * len(some) > 15
    for x in out.values():
        assert x.reply_conv is None or (out[x.reply_conv, x.reply_turn].thread_id == x.thread_id and out[x.reply_conv, x.reply_turn].position < x.position)
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare.differences(spark, con, quote_link.query, quote_link.SQL, str(tmp_path)) == []


def test_circles_of_replies_are_refused_as_by_brute_force(spark):
    r = random.Random(12)
    keys = [(c, t) for c in range(14) for t in range(4)]
    quotes = {k: r.choice([x for x in keys if x[0] != k[0]]) for k in keys if r.random() < 0.6}
    rows = [(c, t, "user", f"Sentence of {c} and {t}." + (f"\n> Sentence of {quotes[c, t][0]} and {quotes[c, t][1]}." if (c, t) in quotes else "")) for c, t in keys]
    rows.append(rows[5])
    before = lambda k: (k[0], k[1] - 1) if k[1] else None
    to, rounds = {k: quotes.get(k) or before(k) for k in keys}, 0
    while True:
        circle = set()
        for k in keys:
            way, at = [], k
            while at and at not in way:
                way.append(at)
                at = to[at]
            if at == k:
                circle.add(k)
        if not circle:
            break
        rounds += 1
        to |= {k: before(k) for k in circle if to[k] and to[k][0] > k[0]}
    out = list(quote_link.rebuild(spark.createDataFrame(rows, ROWS)).collect())
    assert rounds > 1 and len(out) == len(rows) and all(((x.reply_conv, x.reply_turn) if x.reply_conv is not None else None) == to[x.conv_id, x.turn] for x in out)
    place = {(x.thread_id, x.conv_id, x.turn): x.position for x in out}
    assert all(x.reply_conv is None or place[x.thread_id, x.reply_conv, x.reply_turn] < x.position for x in out)
    assert all(x.n_linked == ((x.conv_id, x.turn) in quotes) for x in out)


# --- secrets ---


def test_secrets_on_planted_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = secret_scan.scan(docs).join(docs, "doc_id").select("secret", F.expr("substring(text, start + 1, length)").alias("v")).toPandas()
    assert found.secret[found.v.str.match(r"AKIA[0-9A-Z]{16}$|[0-9a-f]{18,}$")].mean() > 0.95
    assert found.secret[found.v.str.match(r"[\d.]+$|.*@.*\.com$")].mean() < 0.02


def planted_findings(seed: int, n: int) -> list[tuple[str, str, int]]:
    """(text, value, secret): keys of letters and digits, of letters only and passwords of words, among paths, names, hashes of
    files, addresses and versions that look alike."""
    import string

    r = random.Random(seed)
    word = lambda: r.choice(["build", "river", "cache", "index", "module", "garden", "window", "report", "update", "server"])
    draw = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    out = []
    for _ in range(n):
        filler = " ".join(word() for _ in range(30))
        kind = r.randrange(8)
        value, text, secret = {
            0: lambda: (v := draw(string.ascii_letters + string.digits, 32), f"token = {v}", 1),
            1: lambda: (v := "AKIA" + draw(string.ascii_uppercase, 16), f"key id {v}", 1),
            2: lambda: (v := "".join(word() for _ in range(4)), f'password = "{v}"', 1),
            3: lambda: (v := draw(string.ascii_letters, 40), f"secret: {v}", 1),
            4: lambda: (v := f"{word()}/{word()}/{word()}{r.randrange(999)}", f"see file {v}", 0),
            5: lambda: (v := f"{word().capitalize()}{word().capitalize()}{word().capitalize()}", f"class {v}", 0),
            6: lambda: (v := f"{word()}.{word()}{r.randrange(99)}@{word()}.com", f"mail {v}", 0),
            7: lambda: (v := draw("0123456789abcdef", 40), f"commit {v}", 0),
        }[kind]()
        out.append((f"{filler} {text} {filler}", value, secret))
    return out


def test_labelled_findings_of_two_classes_on_held_out_values(spark):
    import hashlib

    planted = planted_findings(4, 1200)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted)], "doc_id long, text string").repartition(4)
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    truth = {sha(v): s for _, v, s in planted}
    given = spark.createDataFrame([(h, s) for h, s in truth.items() if int(h[:8], 16) % 2], "value_sha256 string, secret int")
    out = secret_scan.scan(docs, given).collect()
    assert {r.value_sha256 for r in out} >= set(truth)
    held = [(r.secret, truth[r.value_sha256]) for r in out if r.value_sha256 in truth and int(r.value_sha256[:8], 16) % 2 == 0]
    hit = sum(a and b for a, b in held)
    assert hit / sum(a for a, _ in held) > 0.97 and hit / sum(b for _, b in held) > 0.97


def test_secret_edges(spark):
    rows = [(1, None), (2, ""), (None, "password=b7db7aa4a5fcc78305 at 10.20.30.40:8080"), (3, "password=b7db7aa4a5fcc78305 at 10.20.30.40:8080")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0))
    out = secret_scan.scan(df).collect()
    assert len(out) == 4 and {r.start for r in out} == {9, 31}
    given = spark.createDataFrame([(out[0].value_sha256, 1)], "value_sha256 string, secret int")
    assert {r.score for r in secret_scan.scan(df, given).collect()} == {1.0}
    assert secret_scan.scan(df.limit(0)).collect() == []


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline
    from ohmflow.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0.5 * counts[0]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_edge_rows(spark):
    """Nulls, empty, very long and repeated rows, clashing columns and empty tables, through all stages."""
    import corpus_pipeline
    from ohmflow.llm import common

    t = " ".join(f"w{i}" for i in range(120))
    rows = [(None, t), (-1, t), (5, t), (5, t), (6, None), (7, ""), (8, " \n "), (9, "short one"), (9, "short one"), (10, " ".join(f"x{i}" for i in range(30_000))), (11, "y" * 300_000), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("run_id", F.lit(1)).withColumn("gone_id", F.lit("g")).withColumn("score", F.lit(0.5)).withColumn("removed_word", F.lit(2)).repartition(3)
    for some in (docs, docs.limit(0)):
        left = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = common.materialize(stage(spark, left, SF), name)
            assert left.columns == some.columns
        kept = sorted(((x.doc_id, x.text) for x in left.collect()), key=repr)
        # of the equal texts the first stays; rows without words or text are no copies of one another
        assert kept == (sorted([(None, t), (6, None), (7, ""), (8, " \n "), *[(9, "short one")] * 2, *rows[9:11], (None, None)], key=repr) if some is docs else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert packed.filter("length & (length - 1) <> 0").isEmpty() and (packed.count() > 0) == (some is docs)


def test_registered_queries_have_unique_columns(spark):
    from ohmflow.llm import registry

    assert len(registry.QUERIES) == 13 and set(registry.SQL) <= set(registry.QUERIES)
