"""Versioned tables that only grow: a version is staged whole, checked, and then named by one small write.

Nothing that was published is ever changed. A reader sees the version of the highest number; a
publication that fails leaves only staged files that no version names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version bigint, label string, path string, file string, rows bigint, digest_xor bigint, digest_sum decimal(38,0)"


class Refused(ValueError):
    """A publication that a guard has refused; ``faults`` are its rows."""

    def __init__(self, message: str, faults: list) -> None:
        super().__init__(message)
        self.faults = faults


def file_digests(df: DataFrame) -> DataFrame:
    """file, rows, digest_xor, digest_sum of every file that a table reads: two order-free digests over all columns.

    Rows are hashed where they are read, so a file of any size needs no row of its own.
    """
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    named = df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), row.alias("h"))
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("digest_xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest_sum"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows of all versions; none where nothing was published."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame | None, int]:
    """The table of a version, by default the last one, and its number; (None, 0) where there is none."""
    found = versions(spark, root)
    if version is not None:
        found = found.where(F.col("version") == version)
    last = found.orderBy(F.desc("version")).select("version", "path").first()
    return (spark.read.parquet(last["path"]), last["version"]) if last else (None, 0)


def publish(df: DataFrame, root: str, label: str, expected: int | None = None, faults: DataFrame | None = None) -> int:
    """Publish ``df`` as the next version and return its number.

    Rows in ``faults`` refuse it before anything is written. With ``expected`` the version that the
    caller has read must still be the last one. The staged files are read back and counted; the
    manifest is then written under the version's number, which must not exist yet: of two
    publications of one number the second fails.
    """
    spark = df.sparkSession
    if faults is not None and (some := faults.limit(20).collect()):
        raise Refused(f"{label}: refused", some)
    before = current(spark, root)[1]
    if expected is not None and before != expected:
        raise Refused(f"{label}: version {expected} was read, {before} is the last one", [])
    path = f"{root}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    rows = file_digests(staged).select(F.lit(before + 1).cast("bigint").alias("version"), F.lit(label).alias("label"), F.lit(path).alias("path"), "file", "rows", "digest_xor", "digest_sum")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/{before + 1:09d}")
    return before + 1


def integrity_faults(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """file, fault: files of a version that are missing, not in its manifest, or hold other rows than stated."""
    table, number = current(spark, root, version)
    if table is None:
        return spark.createDataFrame([("-", "no_version")], "file string, fault string")
    stated = versions(spark, root).where(F.col("version") == number).select("file", F.struct("rows", "digest_xor", "digest_sum").alias("stated"))
    found = file_digests(table).select("file", F.struct("rows", "digest_xor", "digest_sum").alias("found"))
    j = stated.join(found, "file", "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("stated").isNull(), "unexpected").when(F.col("found") != F.col("stated"), "content")
    return j.select("file", fault.alias("fault")).where("fault IS NOT NULL")
