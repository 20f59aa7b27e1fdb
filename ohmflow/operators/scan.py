"""Running sums over ordered rows in parts of equal counts.

Rows are dealt to ranges of (groups, value) that hold about as many rows each, whatever the values or the sizes of groups, and written
once. A range sums up what it has of each group; only a group that goes on into other ranges needs what stands before, and of those a range has one
on either side, so what is carried is at most two rows for each range, whatever the number of groups. Each range is then one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmflow.sources.sinks import stored


#: Digits of a digest that name a row's cell: 4,096 cells of about equal counts in each group.
CELL_DIGITS = 3


def cell(digest: Column) -> Column:
    """The number of the cell that a digest in hexadecimal digits lies in; a null one comes first."""
    return F.coalesce(F.conv(F.substring(digest, 1, CELL_DIGITS), 16, 10).cast("int"), F.lit(-1))


def cell_starts(celled: DataFrame, groups: list[str]) -> DataFrame:
    """groups, _cell, _start, _n: the rows of the group in earlier cells and in this one. A group's window is one of cells."""
    counts = celled.groupBy(*groups, "_cell").agg(F.count("*").alias("_n"))
    return counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_cell")) - F.col("_n"))


def digest_ranks(rows: DataFrame, groups: list[str], digest: Column, key: str, name: str) -> DataFrame:
    """rows and their rank (from 0) by a digest, then key, within groups; rows of null groups are left out. Rows are counted by cell and ranked
    within cells, so that a large group is no task of its own. Rows are dealt before the digest is made, so it is not sent."""
    celled = rows.withColumn("_cell", cell(digest))
    starts = cell_starts(celled, groups).drop("_n")
    placed = celled.repartition(*groups, "_cell").withColumn("_in", F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(digest, key)))
    return placed.join(starts, [*groups, "_cell"]).select(*rows.columns, (F.col("_start") + F.col("_in") - 1).alias(name))


def prefix_sums(rows: DataFrame, groups: list[str], value: str, sums: dict[str, str | Column], descending: bool = False) -> DataFrame:
    """rows and, for each name of sums, name_before (of the rows of the group before this one in the order of value) and name_total (of the
    group). Rows of a group have values of their own; nulls come first, or last if descending."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"__{n}") for n, c in sums.items()])
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = stored(named.repartitionByRange(parts, *[F.col(g) for g in groups], order).withColumn("_part", F.spark_partition_id()), "ranges")
    parted = dealt.groupBy(*groups, "_part").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    pieces = parted.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_part", *[f"__{n}" for n in sums]))).alias("_pieces"))
    # groups of one range are left out: at most two rows for each range stay
    pieces = pieces.filter(F.size("_pieces") > 1)
    upto = lambda n: F.aggregate("_own", F.lit(0).cast(parted.schema[f"__{n}"].dataType), lambda s, p: s + F.coalesce(p[f"__{n}"], F.lit(0)))
    long = pieces.select(*groups, "_pieces", F.explode(F.sequence(F.lit(1), F.size("_pieces"))).alias("_i"))
    before = long.withColumn("_own", F.slice("_pieces", F.lit(1), F.col("_i") - 1)).select(*groups, F.element_at("_pieces", F.col("_i"))["_part"].alias("_at"), "_pieces", *[upto(n).alias(f"__{n}_carried") for n in sums])
    whole = before.withColumn("_own", F.col("_pieces")).select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_at", *[f"__{n}_carried" for n in sums], *[upto(n).alias(f"__{n}_whole") for n in sums])
    on = F.col("_part") == F.col("_at")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    met = dealt.repartitionById(parts, F.col("_part")).join(F.broadcast(whole), on, "left")
    part = Window.partitionBy("_part", *groups)
    earlier = part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = []
    for n in sums:
        out.append((zero(F.col(f"__{n}_carried")) + zero(F.sum(f"__{n}").over(earlier))).alias(f"{n}_before"))
        out.append(zero(F.coalesce(F.col(f"__{n}_whole"), F.sum(f"__{n}").over(part))).alias(f"{n}_total"))
    return met.select(*rows.columns, *out)
