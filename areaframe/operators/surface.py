"""Whether a repair changes nothing but topology: a conjunction of checks, each of which can refuse it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.operators import arrangement as A
from areaframe.operators import validity
from areaframe.operators.contract import violations
from areaframe.operators.overlay import overlay_areas
from areaframe.sources.workspace import written

# What rounding may do to an area, and how far neighbours may overlap a candidate.
ROUND_OFF, ROUND_OFF_SHARE = 1e-6, 1e-12
MAX_OVERLAP, MAX_OVERLAP_SHARE = 1.0, 1e-7


def _holes(df: DataFrame) -> DataFrame:
    """area_id, hole (number), rings: each hole as a shape of its own."""
    h = df.select("area_id", F.posexplode(F.expr("filter(rings, r -> r.ring > 0)")).alias("hole", "r"))
    return h.select("area_id", "hole", F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("r.pts").alias("pts"))).alias("rings")).withColumn("rings", G.oriented("rings"))


def corroborated_holes(candidates: DataFrame, originals: DataFrame, neighbours: DataFrame) -> DataFrame:
    """area_id, hole, basis of every hole of a candidate: ``unchanged`` where the original has it as a ring of its own,
    ``complete_components`` where whole parts of neighbours (area_id, other_id, rings) fill it exactly, else null."""
    holes = written(_holes(candidates), "holes")
    known = _holes(originals).select("area_id", G.fingerprint("rings").alias("k")).distinct().withColumn("_same", F.lit(True))
    parts = neighbours.select("area_id", F.explode(F.expr("transform(array_distinct(transform(rings, r -> r.part)), k -> filter(rings, r -> r.part = k))")).alias("rings"))
    box = lambda df, p: df.select("*", *(c.alias(f"{p}{n}") for c, n in zip(G.bbox("rings"), "wsen", strict=True)))
    h = box(holes, "h").withColumnRenamed("rings", "hole_rings")
    inside = h.join(box(parts, "p").hint("merge"), "area_id").where("pw >= hw AND ps >= hs AND pe <= he AND pn <= hn").select("area_id", "hole", "rings")
    inside = written(inside, "components")
    key = ["area_id", "hole"]
    met = holes.join(inside.select(*key).distinct().hint("merge"), key, "left_semi")
    edges = A.shape_edges(inside, key, "A").unionByName(A.shape_edges(met, key, "B"))
    other = A.arranged(edges, key).where("la > 1 OR ra > 1 OR ((la > 0) <> (lb > 0)) <> ((ra > 0) <> (rb > 0))").select(*key).distinct()
    filled = met.select(*key).join(other.hint("merge"), key, "left_anti").withColumn("_filled", F.lit(True))
    j = holes.withColumn("k", G.fingerprint("rings")).join(known.hint("merge"), ["area_id", "k"], "left").join(filled.hint("merge"), key, "left")
    return j.select(*key, F.when(F.col("_same"), "unchanged").when(F.col("_filled"), "complete_components").alias("basis"))


def surface_checks(originals: DataFrame, candidates: DataFrame, neighbours: DataFrame) -> DataFrame:
    """area_id, topology_only, reasons of candidates (area_id, rings) for unsound originals (area_id, rings).

    ``neighbours`` (area_id, other_id, rings) are those of the same source. The original has to be unsound and the
    candidate sound; both have the same boundary, wherever they have vertices; the candidate is what an even-odd reading of
    the original covers; signed areas differ by rounding only; where the number of holes has changed each hole is
    corroborated; neighbours overlap the candidate by next to nothing. A check that cannot be made fails.
    """
    o = written(originals.select("area_id", "rings"), "originals")
    c = written(candidates.select("area_id", G.oriented("rings").alias("rings")), "candidates")
    n = written(neighbours.select("area_id", "other_id", G.oriented("rings").alias("rings")), "neighbours")
    flag = lambda df, name: df.select("area_id").distinct().withColumn(name, F.lit(True)).hint("merge")
    unsound = flag(validity.faults(o), "_unsound")
    broken = flag(validity.faults(c), "_broken")
    edges = A.shape_edges(o, ["area_id"], "A").unionByName(A.shape_edges(c, ["area_id"], "B"))
    low, high = F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"))
    both = A.noded(edges, ["area_id"]).groupBy("area_id", F.least(low, high).alias("l"), F.greatest(low, high).alias("h")).agg(F.collect_set("side").alias("sides"))
    moved = flag(both.where("size(sides) < 2"), "_moved")
    uneven = flag(A.arranged(edges, ["area_id"]).where("(lp = 1) <> (lb > 0) OR (rp = 1) <> (rb > 0)"), "_uneven")
    count = lambda df, name, size: df.select("area_id", F.expr("size(filter(rings, r -> r.ring > 0))").alias(name), F.abs(G.area("rings")).alias(size)).hint("merge")
    bare = flag(corroborated_holes(c, o, n).where("basis IS NULL"), "_bare")
    pair = F.concat_ws("\u0001", "area_id", "other_id").alias("area_id")
    pairs = n.select(F.col("area_id").alias("a"), F.concat_ws("\u0001", "area_id", "other_id").alias("b"))
    overlap = overlay_areas(pairs, c, n.select(pair, "rings")).groupBy(F.col("a").alias("area_id")).agg(F.sum(F.greatest("intersection", F.lit(0.0))).alias("_overlap")).hint("merge")
    j = c.select("area_id")
    for side in (unsound, broken, moved, uneven, bare, overlap, count(o, "_o_holes", "_o_area"), count(c, "_c_holes", "_c_area")):
        j = j.join(side, "area_id", "left")
    shared = F.coalesce("_overlap", F.lit(0.0))
    checks = violations(
        invalid_source=F.col("_unsound"),
        valid_candidate=F.col("_broken").isNull(),
        boundary_unchanged=F.col("_moved").isNull(),
        even_odd_agrees=F.col("_uneven").isNull(),
        area_roundoff_only=F.abs(F.col("_c_area") - F.col("_o_area")) <= F.greatest(F.lit(ROUND_OFF), ROUND_OFF_SHARE * F.col("_c_area")),
        exclusions_corroborated=(F.col("_o_holes") == F.col("_c_holes")) | F.col("_bare").isNull(),
        neighbour_overlap_bounded=(shared <= MAX_OVERLAP) & (shared <= MAX_OVERLAP_SHARE * F.col("_c_area")),
    )
    return j.select("area_id", (F.size(checks) == 0).alias("topology_only"), checks.alias("reasons"))
