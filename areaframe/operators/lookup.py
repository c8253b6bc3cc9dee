"""Point lookup: which areas hold each point, and how certain that is.

Every point gives exactly one row, whatever it meets; what is unknown is never read as "no".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaframe.operators.cells import cover, sized
from areaframe.sources.workspace import written

IDS = T.ArrayType(T.StringType())


def lookup(points: DataFrame, areas: DataFrame, geometry: DataFrame, closure: DataFrame) -> DataFrame:
    """One layer: point_id, matched (direct and their ancestors), direct, pending, n_unknown,
    n_disagreements, ambiguous, status.

    ``areas`` are the visible, current areas; ``geometry`` (area_id, role, rings) may hold
    assignment geometry and, for what is not approved, candidate, review and bbox geometry.
    Areas with no extent at all are unknown for every point. The closure is joined to the
    few areas, not to the points. Areas, visible geometry and chains are read several times, so
    each is written once.
    """
    areas = written(areas.select("id", "level", "scheme", "edition"), "lookup-areas")
    info = areas.select(F.col("id").alias("area_id"), "level", F.coalesce(F.when(F.col("level") == "city_area", F.col("scheme")).otherwise(F.col("edition")), F.lit("")).alias("track"))
    visible = written(geometry.join(info, "area_id", "left_semi"), "lookup-shapes")
    n_unknown = info.join(visible.select("area_id").distinct(), "area_id", "left_anti").count()
    hits = cover(points, visible, "point_id")
    # each area with its ancestors, those of its own level, and those that have geometry
    assigned = visible.where("role = 'assignment'").select(F.col("area_id").alias("ancestor_id"), F.lit(True).alias("has")).distinct()
    levels = areas.select(F.col("id").alias("ancestor_id"), F.col("level").alias("up_level"))
    chains = closure.join(assigned, "ancestor_id", "left").join(levels, "ancestor_id", "left")
    chains = info.join(chains, info.area_id == chains.id, "left").groupBy("area_id", "level", "track").agg(
        F.collect_set("ancestor_id").alias("up"),
        F.collect_set(F.when(F.col("has"), F.col("ancestor_id"))).alias("up_shaped"),
        F.collect_set(F.when(F.col("up_level") == F.col("level"), F.col("ancestor_id"))).alias("up_same"),
    )
    hits = hits.join(sized(written(chains, "lookup-chains")), "area_id")
    direct = F.col("role") == "assignment"
    by_point = hits.groupBy("point_id").agg(
        F.collect_set(F.when(direct, F.struct("area_id", "level", "track", "up", "up_shaped", "up_same"))).alias("d"),
        F.array_sort(F.collect_set(F.when(~direct, F.col("area_id")))).alias("pending"),
    )
    out = points.select("point_id").join(by_point, "point_id", "left")
    out = out.withColumn("d", F.expr("coalesce(d, cast(array() AS array<struct<area_id: string, level: string, track: string, up: array<string>, up_shaped: array<string>, up_same: array<string>>>))"))
    out = out.withColumn("direct", F.expr("array_sort(transform(d, x -> x.area_id))")).withColumn("pending", F.coalesce("pending", F.array().cast(IDS)))
    out = out.withColumn("matched", F.expr("array_sort(array_union(direct, flatten(transform(d, x -> x.up))))"))
    out = out.withColumn("n_disagreements", F.expr("aggregate(d, 0, (a, x) -> a + size(array_except(x.up_shaped, direct)))"))
    # leaves: direct areas that are no same-level ancestor of another
    out = out.withColumn("leaves", F.expr("filter(d, x -> NOT exists(d, y -> array_contains(y.up_same, x.area_id)))"))
    out = out.withColumn("ambiguous", F.expr("size(leaves) > size(array_distinct(transform(leaves, x -> concat(x.level, '|', x.track))))"))
    unsure = (F.size("pending") > 0) | F.lit(n_unknown > 0) | (F.col("n_disagreements") > 0)
    status = F.when(unsure, "review_required").when(F.col("ambiguous"), "ambiguous").when(F.size("direct") > 0, "matched").otherwise("no_match")
    return out.select("point_id", "matched", "direct", "pending", F.lit(n_unknown).alias("n_unknown"), "n_disagreements", "ambiguous", status.alias("status"))


def worst(*results: DataFrame) -> DataFrame:
    """Merge the results of several layers: the worst status, distinct ids.

    Each row carries all that the merge needs, so one shuffle on the point suffices.
    """
    rank = F.expr("CASE status WHEN 'review_required' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'matched' THEN 2 ELSE 3 END")
    rows = results[0].withColumn("rank", rank)
    for r in results[1:]:
        rows = rows.unionByName(r.withColumn("rank", rank))
    out = rows.groupBy("point_id").agg(F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched"), F.sum("n_disagreements").alias("n_disagreements"))
    return out.select("point_id", "matched", "n_disagreements", F.expr("element_at(array('review_required', 'ambiguous', 'matched', 'no_match'), rank + 1)").alias("status"))


def escalate_partial(result: DataFrame, areas: DataFrame, coverage: DataFrame, editions: list[str]) -> DataFrame:
    """Electoral partial coverage: a point that matched nothing, or not every chosen edition,
    needs review when what it missed is only partly covered (coverage: edition, status)."""
    incomplete = coverage.where(F.col("edition").isin(editions) & F.col("status").isin("partial", "unavailable")).agg(F.array_sort(F.collect_set("edition"))).first()[0]
    names = areas.where(F.col("edition").isin(editions)).select(F.col("id").alias("area_id"), "edition")
    seen = result.select("point_id", F.explode("direct").alias("area_id")).join(sized(names), "area_id").groupBy("point_id").agg(F.collect_set("edition").alias("seen"))
    out = result.join(seen, "point_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast(IDS)))
    missed = F.array_except(F.array(*(F.lit(e) for e in incomplete)).cast(IDS), F.col("seen"))
    return out.withColumn("status", F.when(F.size(missed) > 0, "review_required").otherwise(F.col("status"))).drop("seen")


def ordered_matches(result: DataFrame, areas: DataFrame, points: DataFrame) -> DataFrame:
    """point_id, position, matches: the matched ids by level rank, then id; ``points`` (point_id, position)
    give the order of the request. A point without a match has an empty list."""
    m = result.select("point_id", F.explode("matched").alias("id")).join(sized(areas.select("id", "level_rank")), "id")
    m = m.groupBy("point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level_rank", "id"))), lambda x: x["id"]).alias("matches"))
    return points.select("point_id", "position").join(m, "point_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast(IDS)))
