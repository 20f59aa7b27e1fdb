"""Sinks, and what makes long jobs resumable."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ohmflow-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a table in the scratch folder: what is used often is computed once, and lost executors cost no earlier step."""
    path = scratch_folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_parquet(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_wide(rows: DataFrame, path: str, line: str, column: str, value: str, names: list[str]) -> None:
    """A CSV file with a line for each value of `line` and a column for each of names; columns are joined as text, so the plan has none for each name.
    Names and values need no quotes; (line, column) is a key."""
    spark = rows.sparkSession
    places = spark.createDataFrame(list(enumerate(names)), "_at int, _name string")
    cells = places.join(F.broadcast(rows.select(line).distinct())).join(rows.select(line, F.col(column).alias("_name"), F.col(value).cast("string").alias("_v")), [line, "_name"], "left")
    fields = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_v", F.lit("")).alias("_v")))), lambda x: x["_v"])
    lines = cells.groupBy(line).agg(F.array_join(fields, ",").alias("_fields")).select(F.concat_ws(",", F.col(line).cast("string"), "_fields"))
    lines.toDF(",".join([line, *names])).write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "").csv(path)


def write_json(rows: DataFrame, path: str, revision: str) -> None:
    """JSON lines with when and from which revision they were made."""
    rows.withColumn("generated_at_utc", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())).withColumn("revision", F.lit(revision)).write.mode("overwrite").json(path)


def submission(scores: DataFrame, path: str, key: str = "row_id", score: str = "score") -> None:
    """Id and score, one header per file."""
    write_csv(scores.select(key, F.col(score).alias("anomaly")), path)


def pending(units: DataFrame, done: DataFrame, digest: str = "digest", key: str = "unit_id") -> DataFrame:
    """Units without a finished result; a finished unit whose digest differs is refused."""
    clash = units.join(done.select(key, F.col(digest).alias("_d")), key).filter(~F.col(digest).eqNullSafe(F.col("_d")))
    if not clash.isEmpty():
        raise ValueError("a finished unit was made from other inputs")
    return units.join(done.select(key), key, "left_anti")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows and rank from 0 in key order, by ranges of equal counts."""
    from ohmflow.operators.scan import prefix_sums

    return prefix_sums(rows, [], key, {"rank": F.lit(1).cast("long")}).withColumn("rank", F.col("rank_before")).select(*rows.columns, "rank")


def spans(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows and span: contiguous runs of `size` rows in key order."""
    return ranked(rows, key).withColumn("span", F.floor(F.col("rank") / size)).drop("rank")


def remaining_batches(canonical: DataFrame, done_sites: DataFrame, size: int, key: str = "raw_index") -> DataFrame:
    """site_id, span, rows, first, last: what is left to score, in spans."""
    left = canonical.join(done_sites, "site_id", "left_anti")
    return spans(left, key, size).groupBy("span").agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
