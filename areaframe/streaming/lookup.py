"""Streaming lookups: points against static polygons, and matches per area and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.operators.cells import Size, covering


def stream_lookup(points: DataFrame, cells: DataFrame, size: Size = 2.0) -> DataFrame:
    """Stream-static join: each arriving point (point_id, ts, x, y) with the areas that hold it.

    Stateless, so it appends; the static side is read once for each micro-batch.
    """
    return covering(points, cells, "point_id", "ts", size=size)


def window_counts(matches: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Matches per area and window of event time; points later than ``late`` are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return matches.withWatermark("ts", late).groupBy(w.alias("w"), "area_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "area_id", "n")


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; Parquet sink with exactly-once files."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
