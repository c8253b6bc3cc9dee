"""Polygon overlay: regions of arrangements, as areas, as outlines and as whole shapes.

All steps are joins and aggregates keyed by pair and cell, so overlays of whole releases, and of
shapes with very many vertices, run as one distributed plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.operators import arrangement as A
from areaframe.sources.workspace import written


def pair_shapes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, side ('A', 'B'), rings for the pairs (a, b) of two (area_id, rings) tables."""
    pairs = written(pairs.select("a", "b"), "pairs").hint("merge")

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return pairs.join(df.select(F.col("area_id").alias(key), "rings"), key).select("a", "b", F.lit(name).alias("side"), "rings")

    return side(left, "a", "A").unionByName(side(right, "b", "B"))


def _sides(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, side, rings of two tables (key, rings)."""
    return a.select(*key, F.lit("A").alias("side"), "rings").unionByName(b.select(*key, F.lit("B").alias("side"), "rings"))


def overlay_areas(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, area_a, area_b, intersection, outside_a (a minus b), outside_b, union_area, in square units."""
    arcs = A.arranged_shapes(pair_shapes(pairs, left, right), ["a", "b"])
    named = {"area_a": "a", "area_b": "b", "intersection": "intersection", "union_area": "union"}
    sums = arcs.groupBy("a", "b").agg(*(A.region_area(r).alias(n) for n, r in named.items()))
    return sums.withColumn("outside_a", F.expr("area_a - intersection")).withColumn("outside_b", F.expr("area_b - intersection"))


def boundary(pairs: DataFrame, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Directed boundary fragments of intersection, union, difference (a minus b) or symmetric difference."""
    return A.region_edges(A.arranged_shapes(pair_shapes(pairs, left, right), ["a", "b"]), how, ["a", "b"])


def shapes(pairs: DataFrame, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """a, b, rings of intersection, union, difference or symmetric difference; empty results give no row."""
    return A.region_polygons(pair_shapes(pairs, left, right), ["a", "b"], how)


def united(members: DataFrame, by: str) -> DataFrame:
    """The union of each group of members (``by``, rings), which may overlap or share edges in part: ``by``, rings."""
    return A.region_polygons(members.select(by, F.lit("A").alias("side"), "rings"), [by], "a")


def coverage(parents: DataFrame, children: DataFrame, key: list[str]) -> DataFrame:
    """key, covered, outside, uncovered, repeated: the union of all children (key, rings) of a key against its parent (key, rings).

    All children are laid over each other at once, so what two of them share counts once in
    ``covered`` and is what ``repeated`` measures.
    """
    named = {"covered": "intersection", "outside": "difference", "uncovered": "outside_b", "repeated": "repeated"}
    return A.arranged_shapes(_sides(children, parents, key), key).groupBy(*key).agg(*(A.region_area(r).alias(n) for n, r in named.items()))


def dissolve(members: DataFrame, by: str) -> DataFrame:
    """Outline edges of each group of adjacent members (``by``, rings): shared edges cancel.

    An aggregate on the undirected edge, so a group of any size is spread over all tasks.
    """
    e = members.select(by, F.explode(G.edges("rings")).alias("e")).select(by, "e.ax", "e.ay", "e.bx", "e.by")
    forward = F.expr("ax < bx OR (ax = bx AND ay < by)")
    ends = [F.when(forward, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("ax", "bx", "lx"), ("ay", "by", "ly"), ("bx", "ax", "hx"), ("by", "ay", "hy"))]
    net = e.select(by, *ends, F.when(forward, 1).otherwise(-1).alias("d")).groupBy(by, "lx", "ly", "hx", "hy").agg(F.sum("d").alias("net"))
    return net.where("net <> 0")


def outline_measures(outline: DataFrame, by: str) -> DataFrame:
    """Edges and enclosed area of dissolved outlines."""
    return outline.groupBy(by).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.expr("net * (lx * hy - ly * hx) / 2D")).alias("area"))


def outline_edges(outline: DataFrame, by: str) -> DataFrame:
    """Directed edges (by, px, py, qx, qy) of dissolved outlines, for ``arrangement.polygons``."""
    at = lambda a, b: F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b))
    return outline.select(by, at("lx", "hx").alias("px"), at("ly", "hy").alias("py"), at("hx", "lx").alias("qx"), at("hy", "ly").alias("qy"))


def self_faces(shapes_: DataFrame) -> DataFrame:
    """Even-odd repair of self-crossing shapes (area_id, rings): area_id, px, py, qx, qy.

    Edges are cut at their crossings with each other; a fragment stays where exactly one of
    its sides is inside, turned so that the inside lies on its left.
    """
    return A.region_edges(A.arranged_shapes(_one_side(shapes_), ["area_id"]), "odd", ["area_id"])


def _one_side(shapes_: DataFrame) -> DataFrame:
    return shapes_.select("area_id", F.lit("A").alias("side"), "rings")


def repaired(shapes_: DataFrame) -> DataFrame:
    """area_id, rings: the even-odd repair as whole rings."""
    return A.region_polygons(_one_side(shapes_), ["area_id"], "odd")


def unproven(candidate: DataFrame, proof: DataFrame, key: list[str]) -> DataFrame:
    """key, area: where candidate and proof (key, rings) cover different places; no row where they are equal,
    whatever vertices they have."""
    arcs = A.arranged_shapes(_sides(candidate, proof, key), key).where("((la > 0) <> (lb > 0)) <> ((ra > 0) <> (rb > 0))")
    return arcs.groupBy(*key).agg(A.region_area("symmetric difference").alias("area"))
