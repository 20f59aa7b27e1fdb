"""Chat formatting by quotation linking.

A line's quote level is the number of '>' marks before it. Lines of one level in a row form a passage; level 0 is the
message's own text. A passage's lines are joined and parted into sentences, so that a mail client's line breaks don't matter, and
normalised (letters and digits, lower case); its units are the hashes of these sentences and of its single lines. Own texts
have the same units. Quoted units are joined to the earliest own one: in an earlier message of the same conversation, else in the
smallest other conversation that has it, whether its id is smaller or larger. A passage is linked to the message that holds most of its
units, and a message replies to the source of its shallowest, last linked passage, else to the message of the turn before.
Conversations that quote each other form one thread, rebuilt in reply order without quotes.

Ids are no times, so a link may go to a conversation with a larger id. Where replies run in a circle, those of its messages that reply to a
larger conversation reply to the turn before instead, until no circle is left; their passages stay linked. A circle has such a
message, since all other replies go to a smaller (conv_id, turn). Every message then has a place after the one that it
replies to: messages are ordered by the largest (conv_id, turn) on their way to the thread's root, then by the length of that way,
then by (conv_id, turn). Where no reply goes to a larger conversation that is the order of (conv_id, turn). Ways are followed by
doubling, in the threads with such a reply alone, so rounds grow with the logarithm of the longest way.

Only own units that a quote holds are shuffled (a map of fixed size tells them), one row per hash and conversation, so a line that
is said or quoted very often meets one row. Threads are numbered over ranges of rows, so a thread of any length is many tasks' work.

Defined results: null and empty texts are messages without lines; a quote whose source is not found stays unlinked and is
still taken out, and so is a line such as "... wrote:" right before a quote; rows without conv_id or turn are kept as their own thread (null)
and never a source; rows that repeat a conv_id and turn have quotes and texts of their own, one reply (that of the shallowest, then last, linked
passage of any) and places by role and text; ties go to the smallest conversation and turn; very long texts are parted whole; extra columns are left out,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_scratch, materialize, native_map

#: Shares of the conversations that have a unit, where the first of them is passed over.
SALTS = 16
_MARKS = r"^((?:[ \t]*>)*)[ \t]?"
_INTRODUCTION = r"\b(?:wrote|writes|said)\b.*:[ \t]*$"
_SENTENCE_END = r"[.!?]+(?:\s+|$)"


def level_of(raw: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(raw, _MARKS, 1), r"[^>]", ""))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def own_lines(text: Column) -> Column:
    """The lines of level 0 without introductions of quotes."""
    lines = lines_of(text)
    quoted = lambda raw: F.coalesce(level_of(raw) > 0, F.lit(False))
    return F.when(~F.coalesce(text, F.lit("")).contains(">"), lines).otherwise(F.filter(lines, lambda raw, i: ~quoted(raw) & ~(raw.rlike(_INTRODUCTION) & quoted(F.get(lines, i + 1)))))


def own_text(text: Column) -> Column:
    """The text without its quoted lines and without the introductions that stand right before them ('... wrote:')."""
    return F.trim(F.regexp_replace(F.array_join(own_lines(text), "\n"), r"\n{3,}", "\n\n"))


def units(lines: Column) -> Column:
    """Distinct normalised sentences and lines."""
    plain = lambda part: F.trim(F.regexp_replace(F.lower(part), r"[^\p{L}\p{N}]+", " "))
    parts = F.concat(F.split(F.array_join(lines, " "), _SENTENCE_END), lines)
    return F.array_distinct(F.filter(F.transform(parts, plain), lambda part: part != ""))


def quoted_units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, key (of the text), passage, level, units (number), hash: one row per unit of a quoted passage; a
    passage without letters and digits has one row, without hash."""
    quoting = messages.filter("conv_id is not null and turn is not null").filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "text").distinct()
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("key"), F.posexplode(lines_of(F.col("text"))).alias("at", "raw")).withColumn("level", level_of(F.col("raw")))
    # of one message
    order = Window.partitionBy("conv_id", "turn", "key").orderBy("at")
    starts = lines.withColumn("starts", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int")).withColumn("passage", F.sum("starts").over(order)).filter("level > 0")
    whole = starts.groupBy("conv_id", "turn", "key", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("raw", _MARKS, "").alias("line")))).alias("lines"))
    said = whole.withColumn("unit", units(F.col("lines.line"))).drop("lines")
    return said.select("conv_id", "turn", "key", "passage", "level", F.size("unit").alias("units"), F.explode_outer("unit").alias("one")).withColumn("hash", F.when(F.col("one").isNotNull(), F.xxhash64("one"))).drop("one")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, key, passage, level, units (number), source_conv, source_turn: quoted passages and the messages they come from."""
    quoted = materialize(quoted_units(messages), "quoted")
    wanted = native_map(quoted.filter("hash is not null"), "hash", 1 << 22)
    named = messages.filter("conv_id is not null and turn is not null")
    own = named.select("conv_id", "turn", F.explode(units(own_lines(F.col("text")))).alias("unit")).select("conv_id", "turn", F.xxhash64("unit").alias("hash")).filter(wanted(F.col("hash")))
    near = materialize(own.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn")), "own")
    place = F.struct("conv_id", F.col("near_turn").alias("turn"))
    far = materialize(near.groupBy("hash").agg(F.min(place).alias("far")), "far")
    # where the quoting conversation is itself the first to have a unit, but not before, the next one counts
    itself = quoted.join(far, "hash").filter("far.conv_id = conv_id and far.turn >= turn").select("hash", F.col("conv_id").alias("holder")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = near.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(itself.select("*", salts.alias("salt")), ["hash", "salt"])
    following = salted.filter("conv_id <> holder").groupBy("hash").agg(F.min(place).alias("next"))
    found = quoted.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left").join(following, "hash", "left")
    source = F.when(F.col("near_turn") < F.col("turn"), F.struct(F.col("conv_id"), F.col("near_turn").alias("turn"))).otherwise(F.when(F.col("far.conv_id") == F.col("conv_id"), F.col("next")).otherwise(F.col("far")))
    of = ["conv_id", "turn", "key", "passage", "level", "units"]
    votes = found.withColumn("source", source).groupBy(*of, "source").agg(F.count("*").alias("n"))
    best = votes.groupBy(*of).agg(F.max(F.when(F.col("source").isNotNull(), F.struct("n", (-F.col("source.conv_id")).alias("c"), (-F.col("source.turn")).alias("t")))).alias("best"))
    links = materialize(best.select(*of, (-F.col("best.c")).alias("source_conv"), (-F.col("best.t")).alias("source_turn")), "quotes")
    drop_scratch(quoted, near, far)
    return links


def followed(replies: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """replies: conv_id, turn, to_conv, to_turn (null at a root). Gives the ways (conv_id, turn, top: the largest (conv_id, turn) on the
    way to the root, steps) and the messages on circles (conv_id, turn), or None. Each round doubles the part of the way that is known."""
    ways = materialize(replies.select("conv_id", "turn", "to_conv", "to_turn", F.struct("conv_id", "turn").alias("top"), F.col("to_conv").isNotNull().cast("long").alias("steps")), "ways")
    longest, known = ways.count(), 1
    while not ways.filter("to_conv is not null").isEmpty():
        if known > longest:  # no way is that long: what is still open leads to a circle, and twice round it ends on its messages
            return ways, ways.filter("to_conv is not null").select(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn")).distinct()
        ends = ways.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("top").alias("on_top"), F.col("steps").alias("on_steps"), F.col("to_conv").alias("on_conv"), F.col("to_turn").alias("on_turn"))
        further = ways.filter("to_conv is not null").join(ends, ["to_conv", "to_turn"]).select("conv_id", "turn", F.col("on_conv").alias("to_conv"), F.col("on_turn").alias("to_turn"), F.greatest("top", "on_top").alias("top"), (F.col("steps") + F.col("on_steps")).alias("steps"))
        moved = materialize(ways.filter("to_conv is null").unionByName(further), "ways")
        drop_scratch(ways)
        ways, known = moved, known * 2
    return ways, None


def ordered_replies(plain: DataFrame, quotes: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The reply of each (conv_id, turn) as to_conv, to_turn, without circles, and the ways of the threads in which a reply goes to a larger
    conversation (None: there is no such reply)."""
    best = F.max(F.struct((-F.col("level")).alias("l"), "passage", "source_conv", "source_turn")).alias("to")
    linked = quotes.filter("source_conv is not null").groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", "to.source_conv", "to.source_turn")
    named = plain.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = named.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("last_turn"))
    whole = named.join(before, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
    last = F.when(F.col("last_turn").isNotNull(), F.col("conv_id"))
    replies = materialize(whole.select("conv_id", "turn", "last_turn", F.coalesce("source_conv", last).alias("to_conv"), F.coalesce("source_turn", "last_turn").alias("to_turn")), "replies")
    if replies.filter("to_conv > conv_id").isEmpty():
        return replies, None
    of = replies.join(threads, "conv_id")
    open_threads = of.filter("to_conv > conv_id").select("thread").distinct()
    part = materialize(of.join(open_threads, "thread", "left_semi").select(*replies.columns), "part")
    ways, circle = followed(part)
    while circle is not None:
        back = circle.withColumn("on_circle", F.lit(True))
        refused = F.coalesce("on_circle", F.lit(False)) & (F.col("to_conv") > F.col("conv_id"))
        mended = part.join(back, ["conv_id", "turn"], "left").select("conv_id", "turn", "last_turn", F.when(refused, last).otherwise(F.col("to_conv")).alias("to_conv"), F.when(refused, F.col("last_turn")).otherwise(F.col("to_turn")).alias("to_turn"))
        mended = materialize(mended, "part")
        drop_scratch(part, ways)
        part = mended
        ways, circle = followed(part)
    rest = replies.join(part.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    final = materialize(rest.unionByName(part), "replies")
    drop_scratch(replies, part)
    return final, ways


def rebuild(messages: DataFrame) -> DataFrame:
    """thread_id, position (in reply order, from 0), conv_id, turn, role, text (without quotes), reply_conv, reply_turn, n_quotes, n_linked."""
    plain = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    quotes = passages(plain)
    per = quotes.groupBy("conv_id", "turn", "key").agg(F.count("*").alias("n_quotes"), F.count("source_conv").alias("n_linked"))
    across = quotes.filter("source_conv <> conv_id").select(F.col("conv_id").alias("a"), F.col("source_conv").alias("b")).distinct()
    threads = components(across).withColumnsRenamed({"node": "conv_id", "component": "thread"})
    replies, ways = ordered_replies(plain, quotes, threads)
    whole = plain.withColumn("key", F.xxhash64("text")).join(replies, ["conv_id", "turn"], "left").join(per, ["conv_id", "turn", "key"], "left").join(threads, "conv_id", "left")
    whole = whole.withColumns({"top": F.struct("conv_id", "turn"), "steps": F.lit(0).cast("long")}) if ways is None else whole.join(ways.select("conv_id", "turn", "top", "steps"), ["conv_id", "turn"], "left")
    whole = whole.select(
        F.coalesce("thread", "conv_id").alias("thread_id"),
        F.coalesce("top.conv_id", "conv_id").alias("top_conv"),
        F.coalesce("top.turn", "turn").alias("top_turn"),
        F.coalesce("steps", F.lit(0)).alias("steps"),
        "conv_id",
        "turn",
        "role",
        own_text(F.col("text")).alias("text"),
        F.col("text").alias("whole_text"),
        F.col("to_conv").alias("reply_conv"),
        F.col("to_turn").alias("reply_turn"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    # ranges of rows are ranked on their own and moved by the number of the thread's rows in the ranges before
    dealt = materialize(whole.repartitionByRange("thread_id", "top_conv", "top_turn", "steps").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("thread_id", "part").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("thread_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("thread_id").alias("of_thread"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("shift"))
    placed = dealt.join(shifts, F.col("thread_id").eqNullSafe(F.col("of_thread")) & (F.col("part") == F.col("of_part")))
    order = Window.partitionBy("thread_id", "part").orderBy("top_conv", "top_turn", "steps", "conv_id", "turn", "role", "whole_text")
    drop_scratch(quotes, threads, replies, ways)
    return placed.select("thread_id", (F.col("shift") + F.row_number().over(order) - 1).cast("long").alias("position"), "conv_id", "turn", "role", "text", "reply_conv", "reply_turn", "n_quotes", "n_linked")


def query(spark, sf_dir: str) -> DataFrame:
    return rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Circles are refused once here; tables in which new ones arise from that are tested against brute force.
SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS t FROM conversations),
d AS (SELECT DISTINCT conv_id, turn, t, string_split_regex(t, '\r?\n') AS ls FROM m),
l AS (SELECT conv_id, turn, t, i, ls[i + 1] AS raw, length(regexp_replace(regexp_extract(ls[i + 1], '^((?:[ \t]*>)*)[ \t]?', 1), '[^>]', '', 'g')) AS level,
  regexp_replace(ls[i + 1], '^((?:[ \t]*>)*)[ \t]?', '') AS line FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM d)),
k AS (SELECT *, level = 0 AND NOT (regexp_matches(raw, '\b(?:wrote|writes|said)\b.*:[ \t]*$') AND coalesce(lead(level) OVER w, 0) > 0) AS own,
  CASE WHEN level <> coalesce(lag(level) OVER w, -1) THEN 1 ELSE 0 END AS starts FROM l WINDOW w AS (PARTITION BY conv_id, turn, t ORDER BY i)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn, t ORDER BY i) AS passage FROM k),
q AS (SELECT conv_id, turn, t, passage, level, list(line ORDER BY i) AS ls FROM g WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
o AS (SELECT conv_id, turn, t, list(raw ORDER BY i) FILTER (own) AS ls FROM g GROUP BY ALL),
qu AS (SELECT conv_id, turn, t, passage, level, list_distinct(list_filter(list_transform(list_concat(string_split_regex(array_to_string(ls, ' '), '[.!?]+(?:\s+|$)'), ls), lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '')) AS u FROM q),
ou AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(list_transform(list_concat(string_split_regex(array_to_string(ls, ' '), '[.!?]+(?:\s+|$)'), ls), lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> ''))) AS u
  FROM o WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ne AS (SELECT u, conv_id, min(turn) AS near FROM ou GROUP BY ALL),
fa AS (SELECT a.u, a.conv_id, min({'c': ne.conv_id, 't': near}) AS far FROM (SELECT DISTINCT conv_id, unnest(u) AS u FROM qu) a JOIN ne ON ne.u = a.u AND ne.conv_id <> a.conv_id GROUP BY ALL),
v AS (SELECT a.conv_id, a.turn, a.t, a.passage, a.level, CASE WHEN near < a.turn THEN {'c': a.conv_id, 't': near} ELSE far END AS s, count(*) AS n
  FROM (SELECT conv_id, turn, t, passage, level, unnest(u) AS u FROM qu) a LEFT JOIN ne ON ne.u = a.u AND ne.conv_id = a.conv_id LEFT JOIN fa ON fa.u = a.u AND fa.conv_id = a.conv_id GROUP BY ALL),
b AS (SELECT conv_id, turn, t, passage, first(s ORDER BY n DESC, s.c, s.t) AS s FROM v WHERE s IS NOT NULL GROUP BY ALL),
p AS (SELECT qu.conv_id, qu.turn, qu.t, count(*) AS n_quotes, count(s) AS n_linked FROM qu LEFT JOIN b USING (conv_id, turn, t, passage) GROUP BY ALL),
z AS (SELECT conv_id, turn, first(s ORDER BY level, passage DESC, s.c DESC, s.t DESC) AS s FROM qu JOIN b USING (conv_id, turn, t, passage) GROUP BY ALL),
y AS (SELECT x.*, s.c AS c1, s.t AS t1, CASE WHEN l.turn IS NOT NULL THEN x.conv_id END AS c0, l.turn AS t0 FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) x
  LEFT JOIN z USING (conv_id, turn) LEFT JOIN (SELECT DISTINCT conv_id, turn FROM m) l ON l.conv_id = x.conv_id AND l.turn = x.turn - 1),
e AS (SELECT DISTINCT qu.conv_id AS a, s.c AS b FROM qu JOIN b USING (conv_id, turn, t, passage) WHERE s.c <> qu.conv_id),
r AS (SELECT conv_id AS node, conv_id AS seen FROM m WHERE conv_id IS NOT NULL UNION SELECT r.node, x.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON x.a = r.seen),
h AS (SELECT node, min(seen) AS thread_id FROM r GROUP BY node),
f AS (SELECT y.*, thread_id, coalesce(c1, c0) AS rc, coalesce(t1, t0) AS rt, bool_or(coalesce(c1 > y.conv_id, false)) OVER (PARTITION BY thread_id) AS open FROM y JOIN h ON h.node = y.conv_id),
c1 AS (SELECT conv_id, turn, rc, rt FROM f WHERE open UNION SELECT c1.conv_id, c1.turn, f.rc, f.rt FROM c1 JOIN f ON f.conv_id = c1.rc AND f.turn = c1.rt),
g1 AS (SELECT f.conv_id, f.turn, open, CASE WHEN k.conv_id IS NOT NULL AND f.c1 > f.conv_id THEN c0 ELSE f.rc END AS rc, CASE WHEN k.conv_id IS NOT NULL AND f.c1 > f.conv_id THEN t0 ELSE f.rt END AS rt
  FROM f LEFT JOIN (SELECT DISTINCT conv_id, turn FROM c1 WHERE rc = conv_id AND rt = turn) k ON k.conv_id = f.conv_id AND k.turn = f.turn),
c2 AS (SELECT conv_id, turn, conv_id AS oc, turn AS ot FROM g1 WHERE open UNION SELECT c2.conv_id, c2.turn, g1.rc, g1.rt FROM c2 JOIN g1 ON g1.conv_id = c2.oc AND g1.turn = c2.ot WHERE g1.rc IS NOT NULL),
wa AS (SELECT conv_id, turn, max({'c': oc, 't': ot}) AS top, count(*) - 1 AS steps FROM c2 GROUP BY ALL),
w AS (SELECT h.thread_id, m.*, g1.rc AS reply_conv, g1.rt AS reply_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, o.ls, coalesce(top.c, m.conv_id) AS top_conv, coalesce(top.t, m.turn) AS top_turn, coalesce(steps, 0) AS steps
  FROM m LEFT JOIN h ON h.node = m.conv_id LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn AND p.t = m.t LEFT JOIN g1 ON g1.conv_id = m.conv_id AND g1.turn = m.turn LEFT JOIN wa ON wa.conv_id = m.conv_id AND wa.turn = m.turn
  LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.turn IS NOT DISTINCT FROM m.turn AND o.t = m.t)
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY top_conv NULLS FIRST, top_turn NULLS FIRST, steps, conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position, conv_id, turn, role,
  trim(regexp_replace(array_to_string(coalesce(ls, []), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS text, reply_conv, reply_turn, n_quotes, n_linked FROM w
"""
