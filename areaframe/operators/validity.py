"""Whether shapes are sound: rings that cross, overlap, repeat or lie where they may not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators import arrangement as A
from areaframe.sources.workspace import written


def faults(shapes: DataFrame) -> DataFrame:
    """area_id, fault of shapes (area_id, rings), in the order of gravity; sound shapes have no row.

    First what a ring alone shows (``geometry.issue``); a shape with such a fault is not looked at
    further. Then, all from edges cut at each other: ``overlapping_edges`` (a stretch that is run
    more than once: a spike, a repeated ring, parts that share an edge), ``crossing`` and ``crossing_holes`` (an
    outer ring, or the holes of a part, that cover some place other than not at all or once),
    ``hole_outside``, ``touching_itself`` (a ring that passes a point twice), ``nested_parts`` (parts that
    cover a place together more than once). Rings may run in either direction.
    """
    first = shapes.select("area_id", G.issue("rings").alias("fault"), "rings")
    plain = first.where("fault IS NOT NULL").select("area_id", "fault")
    sound = first.where("fault IS NULL").select("area_id", G.oriented("rings").alias("rings"))
    rings = sound.select("area_id", F.explode("rings").alias("r")).select("area_id", F.col("r.part").alias("part"), F.col("r.ring").alias("ring"), F.array("r").alias("rings"))
    several = F.max("part").over(Window.partitionBy("area_id")) > 0
    found = A.by_size(rings.withColumn("several", several), ["area_id"], _found)
    rows = plain.select("area_id", F.lit(-1).alias("rank"), "fault").unionByName(found)
    return rows.groupBy("area_id").agg(F.min_by("fault", "rank").alias("fault"), F.array_sort(F.collect_set("fault")).alias("faults"))


def _found(rings: DataFrame, few: bool) -> DataFrame:
    """area_id, rank, fault from the rings (area_id, part, ring, several, rings) of shapes with few edges or many."""
    edges = rings.select("area_id", "part", "ring", "several", F.explode(G.edges("rings")).alias("e")).select("area_id", "part", "ring", "several", "e.ax", "e.ay", "e.bx", "e.by")
    kept = (lambda df, name: df) if few else written
    noded, arranged = (A.noded_few, A.arranged_few) if few else (A.noded, A.arranged)
    edges = kept(edges, "ring-edges")

    # each ring as a side of its own: stretches that are run twice, and points that a ring passes twice
    sides = edges.withColumn("side", F.concat_ws("/", "part", "ring")).drop("part", "ring", "several")
    cut = kept(noded(sides, ["area_id"]), "ring-fragments")
    low, high = F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"))
    often = cut.groupBy("area_id", F.least(low, high).alias("l"), F.greatest(low, high).alias("h")).agg(F.sum("times").alias("n")).where("n > 1")
    twice = cut.groupBy("area_id", "side", "px", "py").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    # depths of outer rings and holes within a part, and of all parts together
    parts = edges.withColumn("side", F.when(F.col("ring") == 0, "A").otherwise("B")).drop("ring", "several")
    own = arranged(parts, ["area_id", "part"])
    ranked = lambda i, name: F.struct(F.lit(i).alias("rank"), F.lit(name).alias("fault"))
    depths = [
        F.when(F.expr("least(la, ra) < 0 OR greatest(la, ra) > 1"), ranked(1, "crossing")),
        F.when(F.expr("least(lb, rb) < -1 OR greatest(lb, rb) > 0"), ranked(2, "crossing_holes")),
        F.when(F.expr("la + lb < 0 OR ra + rb < 0"), ranked(3, "hole_outside")),
    ]
    own = own.select("area_id", F.explode(F.array_compact(F.array(*depths))).alias("f")).select("area_id", "f.rank", "f.fault")
    together = arranged(edges.where("several").select("area_id", F.lit("A").alias("side"), "ax", "ay", "bx", "by"), ["area_id"]).where("la > 1 OR ra > 1")

    found = [(often, 0, "overlapping_edges"), (twice, 4, "touching_itself"), (together, 5, "nested_parts")]
    return reduce(lambda a, b: a.unionByName(b), (df.select("area_id", F.lit(i).alias("rank"), F.lit(name).alias("fault")) for df, i, name in found), own)
