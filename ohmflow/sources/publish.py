"""Tables that change as a whole: staged, verified, then published by a manifest.

A version's files are written to a folder of its own. It is read back and compared with the rows that were to be written by count and digest; only
then a manifest that names the files of every part is put in place, by creating a file that must not exist. Readers follow the last
manifest, so a job that dies at any step leaves the table before readable, and a job of the same name goes on from what it had staged.
A version may hold some parts only (redone units); the others stay with the files that they had.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Folder:
    """A folder of any file system that Spark's executors write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put(self, name: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed to a name that must be free."""
        beside = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) or not self.fs.rename(self.path(beside), self.path(name)):
            self.fs.delete(self.path(beside), False)
            raise FileExistsError(f"{name} was published by another job")

    def text(self, spark: SparkSession, name: str) -> str:
        return "\n".join(r.value for r in spark.read.text(f"{self.root}/{name}").collect())


def digest(rows: DataFrame) -> tuple[int, str]:
    """Count, and an order-free digest of the rows: the exclusive or and the sum of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    found = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return found["n"], f"{found['x'] or 0}/{found['s'] or 0}"


def manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions."""
    return [int(m[1]) for name in _Folder(spark, root).names("manifests") if (m := re.fullmatch(r"(\d+)\.json", name))]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The last manifest, or that of a version; without one, an empty table's."""
    known = manifests(spark, root)
    if not known:
        return {"version": 0, "parts": {}, "schema": None}
    at = version if version is not None else max(known)
    return json.loads(_Folder(spark, root).text(spark, f"manifests/{at:08d}.json"))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as last published, or as a version had it."""
    found = manifest(spark, root, version)
    if not found["schema"]:
        raise FileNotFoundError(f"nothing is published in {root}")
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(found["schema"])
    paths = sorted({f"{root.rstrip('/')}/{p}" for p in found["parts"].values()})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(rows: DataFrame, root: str, job: str, by: str | None = None) -> int:
    """Publishes rows as a new version and returns its number. by: a column whose values are parts; parts that rows do not hold stay as they were.
    job names the run: one that died after staging is not computed again, and one that was published is not published again."""
    spark, folder = rows.sparkSession, _Folder(rows.sparkSession, root)
    if not re.fullmatch(r"[\w.-]+", job):
        raise ValueError("a job's name has letters, digits, points and dashes")
    before = manifest(spark, root)
    done = {m["job"]: m["version"] for v in manifests(spark, root) for m in [manifest(spark, root, v)]}
    if job in done:
        return done[job]
    stage(rows, root, job, by)
    parts = before["parts"] if by else {}
    if by:
        parts = parts | {name: f"versions/{job}/data/{name}" for name in folder.names(f"versions/{job}/data") if name.startswith("_part=")}
    else:
        parts = {"": f"versions/{job}/data"}
    version = before["version"] + 1
    folder.put(f"manifests/{version:08d}.json", json.dumps({"version": version, "job": job, "parts": parts, "schema": json.loads(rows.schema.json())}))
    return version


def stage(rows: DataFrame, root: str, job: str, by: str | None = None) -> None:
    """Writes and verifies a version's files; nothing is done where that has been."""
    spark, folder = rows.sparkSession, _Folder(rows.sparkSession, root)
    if folder.exists(f"versions/{job}/verified"):
        return
    folder.remove(f"versions/{job}")
    data = f"{root.rstrip('/')}/versions/{job}/data"
    given = rows.withColumn("_part", F.col(by).cast("string")) if by else rows
    writer = given.write.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("_part") if by else writer).parquet(data)
    written = spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(data)
    wanted, found = digest(rows), digest(written)
    if wanted != found:
        folder.remove(f"versions/{job}")
        raise ValueError(f"{found[0]} rows were staged of {wanted[0]}, or others")
    folder.put(f"versions/{job}/verified", json.dumps(found))
