"""Review of unapproved geometry: measured checks, repairs, joint decisions, regression probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators import validity
from areaframe.operators.overlay import self_faces
from areaframe.sources.workspace import written

# Limits of a minor correction.
MAX_AREA_M2, MAX_PROVEN_M2, MAX_SHARE, MAX_SHIFT_M = 100.0, 6000.0, 1e-4, 5.0


def repair_ledger(candidates: DataFrame) -> DataFrame:
    """area_id, repaired_area, n_edges: even-odd fill of candidates (area_id, rings)."""
    faces = self_faces(candidates)
    return faces.groupBy("area_id").agg(F.sum(F.expr("(px * qy - py * qx) / 2D")).alias("repaired_area"), F.count(F.lit(1)).alias("n_edges"))


def retraced(geometry: DataFrame) -> DataFrame:
    """Edges that a geometry runs out and back along: area_id, ax, ay, bx, by."""
    e = geometry.select("area_id", F.explode(G.edges("rings")).alias("e")).select("area_id", "e.ax", "e.ay", "e.bx", "e.by")
    flip = F.expr("ax > bx OR (ax = bx AND ay > by)")
    ends = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    u = e.select("area_id", *(F.when(flip, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in ends.items()), flip.alias("back"))
    return u.groupBy("area_id", "ax", "ay", "bx", "by").agg(F.count_if("back").alias("n_back"), F.count_if(~F.col("back")).alias("n_out")).where("n_back > 0 AND n_back = n_out").drop("n_back", "n_out")


def decide(measured: DataFrame) -> DataFrame:
    """decision and reasons for rows with overlap_m2, overlap_share, changed_m2, changed_share, shift_m, proven.

    Null measures never approve anything.
    """
    small = F.coalesce((F.col("overlap_m2") <= 1) & (F.col("overlap_share") <= 1e-7), F.lit(False))
    limit = F.when(F.col("proven"), MAX_PROVEN_M2).otherwise(MAX_AREA_M2)
    checks = {
        "changed_area": F.col("changed_m2") <= limit,
        "changed_share": F.col("changed_share") <= MAX_SHARE,
        "shift": F.col("shift_m") <= MAX_SHIFT_M,
    }
    reasons = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    out = measured.withColumn("reasons", F.when(small, F.array().cast("array<string>")).otherwise(reasons))
    return out.withColumn("decision", F.when(small, "topology_only").when(F.size("reasons") == 0, "minor_correction").otherwise("keep_review"))


def joint(decisions: DataFrame, group: str = "group") -> DataFrame:
    """Approve the members of a group together or not at all."""
    ok = F.bool_and(F.col("decision") != "keep_review").over(Window.partitionBy(group))
    return decisions.withColumn("approved", ok)


def apply_review(areas: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approved areas (id, approved) become validated and lose the issues that held them back."""
    j = areas.join(approvals.where("approved").select("id", F.lit(True).alias("_ok")), "id", "left")
    held = j.withColumn("assignment_status", F.when(F.col("_ok"), "validated_source").otherwise(F.col("assignment_status")))
    return held.withColumn("issues", F.when(F.col("_ok"), F.array().cast("array<string>")).otherwise(F.col("issues"))).drop("_ok")


def promote_regions(areas: DataFrame) -> DataFrame:
    """Regions (level region) of which every current municipality is settled become ``validated_derived``; those
    with one that is not fall back to ``unreviewed_repair``, and regions without members stay as they are."""
    settled = F.col("assignment_status").isin("validated_source", "validated_derived")
    members = areas.where("level = 'municipality' AND lifecycle_status = 'current'").groupBy(F.col("parent_id").alias("id")).agg(F.bool_and(settled).alias("_all"))
    j = areas.join(members.hint("merge"), "id", "left")
    status = F.when((F.col("level") == "region") & F.col("_all"), "validated_derived").when((F.col("level") == "region") & ~F.col("_all"), "unreviewed_repair").otherwise(F.col("assignment_status"))
    return j.withColumn("assignment_status", status).drop("_all")


def review_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """level, assignment_status, n_before, n_after: the counts that a report has to state anew."""
    count = lambda df, n: df.groupBy("level", "assignment_status").agg(F.count(F.lit(1)).alias(n))
    return count(before, "n_before").join(count(after, "n_after"), ["level", "assignment_status"], "full").na.fill(0, ["n_before", "n_after"])


def decision_counts(decisions: DataFrame) -> DataFrame:
    """decision, n, n_approved: how often each decision was taken, and how often its group was approved."""
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_if("approved").alias("n_approved"))


def changed_answers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Probes (point_id, direct) whose assignment differs between two versions."""
    j = before.select("point_id", F.col("direct").alias("old")).join(after.select("point_id", F.col("direct").alias("new")), "point_id", "full")
    return j.where(~F.col("old").eqNullSafe(F.col("new")))


def representative_points(geometry: DataFrame) -> DataFrame:
    """area_id, x, y inside each geometry: the middle of the widest inner stretch of a scan line.

    The line lies halfway between the two middle vertex heights of the first outer ring, so
    that it crosses this ring and meets none of its vertices.
    """
    ring = geometry.select("area_id", "rings", F.expr("filter(rings, r -> r.ring = 0)[0]").alias("r"))
    ys = ring.select("area_id", "rings", F.expr("array_sort(array_distinct(transform(r.pts, p -> p.y)))").alias("ys"))
    lines = ys.select("area_id", F.expr("(ys[CAST(size(ys) DIV 2 AS INT) - 1] + ys[CAST(size(ys) DIV 2 AS INT)]) / 2D").alias("y"), F.explode(G.edges("rings")).alias("e"))
    hits = lines.where("(e.ay > y) <> (e.by > y)").select("area_id", "y", F.expr("(e.bx - e.ax) * (y - e.ay) / nullif(e.by - e.ay, 0D) + e.ax").alias("x"))
    xs = hits.groupBy("area_id", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = F.expr("transform(filter(sequence(1, size(xs) - 1), i -> i % 2 = 1), i -> named_struct('w', get(xs, i) - get(xs, i - 1), 'm', (get(xs, i) + get(xs, i - 1)) / 2D))")
    return xs.withColumn("best", F.array_max(spans)).select("area_id", F.col("best.m").alias("x"), "y")


def simplified(geometry: DataFrame, tolerance: float) -> DataFrame:
    """area_id, part, ring, pts: rings simplified by Douglas-Peucker; a ring that would collapse stays whole.

    Rings are independent, so they are dealt out ring by ring.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for pts in df["pts"]:
                xy = np.array([(p["x"], p["y"]) for p in pts])
                keep = _douglas_peucker(xy, tolerance)
                out.append([{"x": float(x), "y": float(y)} for x, y in (xy[keep] if keep.sum() >= 4 else xy)])
            yield df.assign(pts=out)

    rings = geometry.select("area_id", F.explode("rings").alias("r")).select("area_id", "r.part", "r.ring", "r.pts")
    return rings.mapInPandas(run, rings.schema)


def display_shapes(geometry: DataFrame, tolerance: float) -> DataFrame:
    """area_id, rings, basis: shapes simplified for display; one that is not sound any more afterwards (rings that
    cross, parts that come to lie in each other) is shown in full."""
    rings = simplified(geometry, tolerance).groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("part", "ring", "pts"))).alias("simple"))
    rings = written(rings, "simplified")
    broken = validity.faults(rings.select("area_id", F.col("simple").alias("rings"))).select("area_id", F.lit(True).alias("broken"))
    j = geometry.select("area_id", "rings").join(rings.hint("merge"), "area_id").join(broken.hint("merge"), "area_id", "left")
    return j.select("area_id", F.when(F.col("broken"), F.col("rings")).otherwise(F.col("simple")).alias("rings"), F.when(F.col("broken"), "full").otherwise("simplified").alias("basis"))


def _douglas_peucker(xy: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    if len(xy) > 3:  # a closed ring is split at the point farthest from its start
        far = int(np.argmax(np.hypot(*(xy - xy[0]).T)))
        keep[far] = True
        todo = [(0, far), (far, len(xy) - 1)]
    else:
        todo = [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        length = np.hypot(*d)
        off = np.hypot(*p.T) if length == 0 else np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep
