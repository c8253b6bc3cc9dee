"""Spatial joins as equi-joins on grid cells.

Spark has no spatial index; a polygon is spread over the cells that its edges touch and those
that lie wholly inside, and a point has one cell. A cell carries only the edges that touch it
and whether its centre is inside; a point is inside or not by the edges between it and the
centre, so a shape of any number of vertices costs a point no more than what is near it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.sources.workspace import written

#: A counted side is broadcast up to this many rows, and cells up to this many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
CELL = 2.0
#: Cells that a polygon's box may have on average when the size is chosen.
CELLS_EACH = 16
#: Bytes of an edge and of the rest of a cell's row in memory.
_EDGE_BYTES, _ROW_BYTES = 40, 96

Size = float | tuple[float, float]


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted rows prove it small; sort-merge otherwise."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def _xy(size: Size) -> tuple[float, float]:
    return size if isinstance(size, tuple) else (size, size)


def cell(x: str, size: float = CELL) -> Column:
    return F.floor(F.col(x) / F.lit(size)).cast("int")


def cell_size(geometry: DataFrame, each: int = CELLS_EACH) -> tuple[float, float]:
    """Width and height of cells for (area_id, rings): half of the median box, and larger where
    few large boxes would have too many cells. One aggregate over the boxes."""
    box = geometry.select(*G.bbox("rings")).select((F.col("east") - F.col("west")).alias("w"), (F.col("north") - F.col("south")).alias("h"))
    r = box.agg(F.count("w").alias("n"), F.percentile_approx("w", 0.5).alias("mw"), F.percentile_approx("h", 0.5).alias("mh"), F.sum("w").alias("w"), F.sum("h").alias("h"), F.sum(F.col("w") * F.col("h")).alias("a")).first()
    if not r["n"]:
        return CELL, CELL
    x, y = (max(v / 2, 1e-6) if math.isfinite(v) else CELL for v in (r["mw"], r["mh"]))
    while r["a"] / (x * y) + r["w"] / x + r["h"] / y > each * r["n"] and x < 360:
        x, y = 2 * x, 2 * y
    return x, y


def with_cells(boxes: DataFrame, size: Size = CELL) -> DataFrame:
    """One row for each cell that the box west, south, east, north touches: cx, cy."""
    x, y = _xy(size)
    return boxes.withColumn("cx", F.explode(_span("west", "east", x))).withColumn("cy", F.explode(_span("south", "north", y)))


def _span(a: str, b: str, size: float) -> Column:
    return F.sequence(cell(a, size), cell(b, size))


def polygon_cells(geometry: DataFrame, size: Size = CELL) -> DataFrame:
    """area_id, role, cx, cy, inside, edges: the cells of (area_id, role, rings), which hold their
    centre (even-odd) or are touched by an edge's box.

    The rings of all rows of one area and role form one geometry. Edges are dealt out one by
    one, so no geometry has to fit a task.
    """
    x, y = _xy(size)
    key = ["area_id", "role"]
    e = geometry.select(*key, F.explode(G.edges("rings")).alias("e")).select(*key, "e.ax", "e.ay", "e.bx", "e.by")
    e = e.withColumns({"west": F.least("ax", "bx"), "east": F.greatest("ax", "bx"), "south": F.least("ay", "by"), "north": F.greatest("ay", "by")})
    touched = with_cells(e, size).groupBy(*key, "cx", "cy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    # where the edges cross the lines through the centres of each row of cells
    rows = e.withColumn("cy", F.explode(_span("south", "north", y))).withColumn("_y", (F.col("cy") + 0.5) * F.lit(y))
    rows = rows.where("(ay > _y) <> (by > _y)").select(*key, "cy", "ax", "ay", "bx", "by", F.expr("(bx - ax) * (_y - ay) / (by - ay) + ax").alias("_x"))
    rows = rows.groupBy(*key, "cy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_es"), F.min("_x").alias("_w"), F.max("_x").alias("_e"))
    inner = rows.withColumn("cx", F.explode(_span("_w", "_e", x)))
    inner = inner.where(F.expr(f"size(filter(_es, e -> {G.LEFT_OF.format(x=f'((cx + 0.5D) * {x!r}D)', y=f'((cy + 0.5D) * {y!r}D)')})) % 2 = 1")).select(*key, "cx", "cy", F.lit(True).alias("inside"))
    both = touched.hint("merge").join(inner.hint("merge"), [*key, "cx", "cy"], "full")
    return both.select(*key, "cx", "cy", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("edges", F.array().cast("array<struct<ax: double, ay: double, bx: double, by: double>>")).alias("edges"))


def cells_bytes(cells: DataFrame) -> int:
    """What the rows of ``polygon_cells`` take in memory."""
    r = cells.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("edges")).first()
    return r["rows"] * _ROW_BYTES + r["edges"] * _EDGE_BYTES


def covered(size: Size) -> Column:
    """Whether x, y is on an edge of its cell, or inside by the edges crossed on the way from the
    cell's centre: up or down to its height, then along.

    An edge through the way's corner counts by the side on which it goes on; the
    rules are those of the rows above, as if the centre lay a little to the right. All sides are
    judged by the same two products, so rounding never lets an edge count on one leg and not on the other.
    """
    sx, sy = _xy(size)
    x, y = f"((cx + 0.5D) * {sx!r}D)", f"((cy + 0.5D) * {sy!r}D)"
    level = f"((e.ay > y) <> (e.by > y) AND {G.LEFT_OF.format(x=x, y='y')} <> {G.LEFT_OF.format(x='x', y='y')})"
    upright = f"((e.ax > {x}) <> (e.bx > {x}) AND {G.ABOVE.format(x=x, y='y')} <> {G.ABOVE.format(x=x, y=y)})"
    on = f"exists(edges, e -> {G.ON_EDGE.format(x='x', y='y')})"
    crossed = f"aggregate(edges, 0, (n, e) -> n + IF({level}, 1, 0) + IF({upright}, 1, 0)) % 2 = 1"
    return F.expr(f"CASE WHEN size(edges) = 0 THEN inside ELSE ({on} OR (inside <> ({crossed}))) END")


def covering(points: DataFrame, cells: DataFrame, *keep: str, size: Size = CELL) -> DataFrame:
    """Point-in-polygon join, boundary inclusive: point columns ``keep``, area_id, role.

    ``cells`` are those of ``polygon_cells`` of the same size, cheap to read twice. Points without
    a finite position match nothing. A hot cell is split by AQE, since the polygon side of a
    cell is small.
    """
    x, y = _xy(size)
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("x", "y", *keep)
    p = p.withColumn("cx", cell("x", x)).withColumn("cy", cell("y", y))
    met = p.join(F.broadcast(cells) if cells_bytes(cells) <= BROADCAST_BYTES else cells.hint("merge"), ["cx", "cy"])
    return met.where(covered(size)).select(*keep, "area_id", "role")


def cover(points: DataFrame, geometry: DataFrame, *keep: str) -> DataFrame:
    """``covering`` with cells of a size that suits the geometry (area_id, role, rings), written once."""
    size = cell_size(geometry)
    return covering(points, written(polygon_cells(geometry, size), "cells"), *keep, size=size)


def nested_loop(points: DataFrame, geometry: DataFrame, *keep: str) -> DataFrame:
    """The same join by bounding boxes alone, with all edges of a shape for each point: a cross-check.

    Boxes and points meet in upright strips as wide as the mean box, so a box has about two of them.
    """
    g = geometry.select("area_id", "role", G.edges("rings").alias("edges"), *G.bbox("rings"))
    wide = g.agg(F.avg(F.col("east") - F.col("west"))).first()[0]
    strip = max(wide, 1e-6) if wide and math.isfinite(wide) else CELL
    g = g.withColumn("cx", F.explode(_span("west", "east", strip)))
    p = points.where("x IS NOT NULL AND NOT isnan(x)").withColumn("cx", cell("x", strip))
    met = p.join(g.hint("merge"), "cx").where("x >= west AND x <= east AND y >= south AND y <= north")
    return met.where(G.covers("edges", "x", "y")).select(*keep, "area_id", "role")


def box_pairs(left: DataFrame, right: DataFrame, size: Size | None = None, least: float | None = None) -> DataFrame:
    """Distinct pairs (a, b) of two (area_id, rings) tables whose boxes overlap or touch; where ``least`` is
    given, only those whose boxes share enough for an overlap of more than that.

    Each pair is met in one cell only: the one that holds the lower left corner of what
    the two boxes share, so no distinct is needed. The cells follow the boxes unless a size is given.
    """
    x, y = _xy(size or cell_size(left.select("rings").unionByName(right.select("rings"))))
    box = lambda df, s: with_cells(df.select(F.col("area_id").alias(s), *G.bbox("rings")), (x, y)).select(s, "cx", "cy", *(F.col(c).alias(f"{s}_{c}") for c in ("west", "south", "east", "north")))
    met = box(left, "a").join(box(right, "b").hint("merge"), ["cx", "cy"])
    met = met.where("a_west <= b_east AND b_west <= a_east AND a_south <= b_north AND b_south <= a_north")
    if least is not None:  # half of it, so that rounding loses no pair
        met = met.where(f"(least(a_east, b_east) - greatest(a_west, b_west)) * (least(a_north, b_north) - greatest(a_south, b_south)) > {least / 2!r}D")
    home = (F.col("cx") == F.floor(F.greatest("a_west", "b_west") / x)) & (F.col("cy") == F.floor(F.greatest("a_south", "b_south") / y))
    return met.where(home).select("a", "b")
