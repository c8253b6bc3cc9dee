"""Whole lookups of a stream: one certain answer a point, by the geometry version that was current, restated when a later one arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.operators.lookup import lookup
from areaframe.sources.published import current


def _answered(points: DataFrame, areas: DataFrame, closure: DataFrame, geometry: DataFrame, version: int) -> DataFrame:
    own = points.select("point_id", "x", "y").dropDuplicates(["point_id"])
    return lookup(own, areas, geometry, closure).join(own.hint("merge"), "point_id").withColumn("version", F.lit(version).cast("bigint"))


def batch_answers(areas: DataFrame, closure: DataFrame, root: str, target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that answers a batch by the version of the published geometry (area_id, role, rings)
    at ``root`` that is current then.

    A batch has one folder, named by its id, that is written whole: when Spark repeats a batch after a failure,
    its answers are replaced and not doubled.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        geometry, version = current(batch.sparkSession, root)
        if geometry is None:
            raise ValueError(f"no geometry is published at {root}")
        _answered(batch, areas, closure, geometry, version).write.mode("overwrite").parquet(f"{target}/batch-{batch_id}")

    return answer


def run_available(points: DataFrame, areas: DataFrame, closure: DataFrame, root: str, target: str, checkpoint: str) -> None:
    """Answer the points (point_id, x, y) that have arrived, and stop."""
    query = points.writeStream.foreachBatch(batch_answers(areas, closure, root, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def restate(spark: SparkSession, areas: DataFrame, closure: DataFrame, root: str, target: str) -> int:
    """Answer again what older versions have answered, by the current one, and return that version.

    Earlier answers stay where they are; ``answers`` shows the last. Doing it again changes nothing.
    """
    geometry, version = current(spark, root)
    given = spark.read.parquet(f"{target}/batch-*")
    old = given.groupBy("point_id").agg(F.max_by(F.struct("x", "y"), "version").alias("p"), F.max("version").alias("version")).where(F.col("version") < version)
    _answered(old.select("point_id", "p.*"), areas, closure, geometry, version).write.mode("overwrite").parquet(f"{target}/version-{version}")
    return version


def answers(spark: SparkSession, target: str) -> DataFrame:
    """Each point's answer by the last version that has answered it."""
    rows = spark.read.parquet(f"{target}/batch-*", f"{target}/version-*") if _restated(spark, target) else spark.read.parquet(f"{target}/batch-*")
    rest = [c for c in rows.columns if c != "point_id"]
    return rows.groupBy("point_id").agg(F.max_by(F.struct(*rest), "version").alias("a")).select("point_id", "a.*")


def _restated(spark: SparkSession, target: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(f"{target}/version-*")
    except AnalysisException:
        return False
    return True
