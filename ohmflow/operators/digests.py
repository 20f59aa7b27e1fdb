"""Digests of ordered sets of ids: of a selection as one number, of a set of any size as a tree over ranges.

Ids are ranked by ranges of equal counts and cut into spans; a span's digest is the sha256 of its ids as little-endian bytes, and each level
above hashes the digests of FAN spans in order. No task holds more than a span or FAN digests, the root tells sets apart, and spans tell where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmflow.sources import sinks

FAN = 1024
SPAN = 65_536


def little_endian(ids: Column) -> Column:
    """The bytes of an array of longs, lowest byte first, as hexadecimal digits."""
    turned = lambda x: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substr(F.lpad(F.hex(x), 16, "0"), i, F.lit(2))), "")
    return F.array_join(F.transform(ids, turned), "")


def id_digest(rows: DataFrame, groups: list[str], key: str, most: int = 10_000_000) -> DataFrame:
    """groups, n, sha256 of each group's ids in order, as little-endian 64-bit numbers. For selections: a group of more than `most` ids, which
    would be one task's work, is refused; use id_tree() for those."""
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    if not sizes.filter(F.col("n") > most).isEmpty():
        raise ValueError(f"a group has more than {most} ids")
    ordered = F.array_sort(F.collect_list(F.col(key).cast("long")))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.sha2(F.unhex(little_endian(ordered)), 256).alias("sha256"))


def id_spans(rows: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """span, n, first, last, sha256 of runs of `span` ids in order."""
    cut = sinks.spans(rows.select(F.col(key).cast("long").alias("id")), "id", span)
    return cut.groupBy("span").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sha2(F.unhex(little_endian(F.array_sort(F.collect_list("id")))), 256).alias("sha256"))


def id_tree(rows: DataFrame, key: str, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """n, sha256: the root of the tree over a table's ids. An empty set has the digest of nothing."""
    level = sinks.stored(id_spans(rows, key, span).select("span", "n", "sha256"), "digests")
    while True:
        digest = F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "sha256"))), lambda x: x["sha256"]), "")), 256)
        up = level.groupBy(F.floor(F.col("span") / fan).alias("span")).agg(F.sum("n").alias("n"), digest.alias("sha256"))
        level = sinks.stored(up, "digests")
        if level.count() <= 1:
            return level.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("sha256"))


def differing_spans(a: DataFrame, b: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """span, first_a, last_a, first_b, last_b where two sets' spans differ; the least of them holds the first difference."""
    left, right = (id_spans(x, key, span).select("span", *[F.col(c).alias(f"{c}_{n}") for c in ("first", "last", "sha256")]) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, "span", "full").filter(~F.col("sha256_a").eqNullSafe(F.col("sha256_b"))).select("span", "first_a", "last_a", "first_b", "last_b")
