"""Arrangements: the edges of any number of shapes cut at each other, with the depth of cover on both sides.

Edges of one key (a pair of areas, a parent with its children, an area by itself) are compared
only within cells whose size follows the mean edge, so a ring of any number of vertices
costs about as many rows as it has edges. A scan along each row of cells gives the depth at
the centres of the cells; from there an edge is reached within its cell. Every
region that can be told by depths (a union, a difference, a stretch covered twice, a repair by
even and odd) is then a filter, and its area a sum.

Keys of few edges, which most are, need no cells: their shapes are dealt by key once, and from there each edge meets
every other of its key within the task, up to whole rings. Which keys are few is counted first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators.cells import covering, cell_size, polygon_cells, sized
from areaframe.sources.workspace import written

#: Distance, relative to the coordinates, within which a vertex lies on an edge.
TOLERANCE = 1e-12
#: Cells are this many mean edges wide. The odd factor keeps their centres off round coordinates.
_WIDE = 2.0173
MEASURES = ["da", "db", "na"]
#: A key of at most so many edges is arranged within a task, where each edge meets every other.
KEY_EDGES = 256
#: Edges, before they are cut, that a task is given where there are more than the session's partitions hold.
TASK_EDGES = 250_000


def shape_edges(shapes: DataFrame, key: list[str], side: str, rings: str = "rings") -> DataFrame:
    """key, side ('A' or 'B'), ax, ay, bx, by of shapes (key, rings)."""
    return shapes.select(*key, F.lit(side).alias("side"), F.explode(G.edges(rings)).alias("e")).select(*key, "side", "e.ax", "e.ay", "e.bx", "e.by")


def edges_of(shapes: DataFrame, key: list[str]) -> DataFrame:
    """The same of shapes (key, side, rings)."""
    return shapes.select(*key, "side", F.explode(G.edges("rings")).alias("e")).select(*key, "side", "e.ax", "e.ay", "e.bx", "e.by")


def _in_cells(edges: DataFrame, margin: str = "1e-9D") -> DataFrame:
    """Edges with the cells (cx, cy) of width ``size`` that they pass: column by column, and in each only the rows they reach there."""
    low = f"least(ax, bx) - {margin} * size"
    high = f"greatest(ax, bx) + {margin} * size"
    out = edges.withColumn("cx", F.explode(F.expr(f"sequence(CAST(floor(({low}) / size) AS BIGINT), CAST(floor(({high}) / size) AS BIGINT))")))
    # the edge's height where it enters and leaves the column
    at = "IF(ax = bx, {end}, greatest(least(ay, by), least(greatest(ay, by), ay + (by - ay) * ({x} - ax) / (bx - ax))))"
    left, right = (at.format(end=end, x=f"greatest(least(ax, bx), least(greatest(ax, bx), (cx + {i}) * size))") for end, i in (("ay", 0), ("by", 1)))
    out = out.withColumns({"_l": F.expr(left), "_r": F.expr(right)})
    span = f"sequence(CAST(floor((least(_l, _r) - {margin} * size) / size) AS BIGINT), CAST(floor((greatest(_l, _r) + {margin} * size) / size) AS BIGINT))"
    return out.withColumn("cy", F.explode(F.expr(span))).drop("_l", "_r")


def _with_size(edges: DataFrame, key: list[str]) -> DataFrame:
    each = edges.groupBy(*key).agg((_WIDE * F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).alias("size"))
    return edges.join(sized(written(each, "sizes")), key)


def _cut_at(pairs: DataFrame) -> DataFrame:
    """Pairs of edges (ax, ay, bx, by and oax, oay, obx, oby) that come near each other, with a point (t, x, y) ``cut`` in each of three rows where the second cuts the first, null where it does not."""
    near = F.expr("least(ax, bx) <= greatest(oax, obx) + _tol AND least(oax, obx) <= greatest(ax, bx) + _tol AND least(ay, by) <= greatest(oay, oby) + _tol AND least(oay, oby) <= greatest(ay, by) + _tol")
    met = pairs.withColumn("_tol", F.expr(f"{TOLERANCE!r}D * greatest(1D, abs(ax), abs(ay), abs(bx), abs(by), abs(oax), abs(oay), abs(obx), abs(oby))")).where(near)
    met = met.withColumns({"_e": F.expr("sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))"), "_o": F.expr("sqrt((obx - oax) * (obx - oax) + (oby - oay) * (oby - oay))")})
    from_e = "(((bx - ax) * ({y} - ay) - (by - ay) * ({x} - ax)) / _e)"
    from_o = "(((obx - oax) * ({y} - oay) - (oby - oay) * ({x} - oax)) / _o)"
    met = met.withColumns({n: F.expr(d.format(x=x, y=y)) for n, d, x, y in (("_oa", from_e, "oax", "oay"), ("_ob", from_e, "obx", "oby"), ("_ea", from_o, "ax", "ay"), ("_eb", from_o, "bx", "by"))})
    # one row for each end of the other edge and one for a crossing: behind the generator the formulas are a method of their own, short enough for the JVM to compile
    met = met.withColumn("_which", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    met = met.withColumns({"_d": F.expr("IF(_which = 0, _oa, _ob)"), "_x": F.expr("IF(_which = 0, oax, obx)"), "_y": F.expr("IF(_which = 0, oay, oby)")})
    met = met.withColumn("_at", F.expr("((_x - ax) * (bx - ax) + (_y - ay) * (by - ay)) / (_e * _e)"))
    vertex = "IF(abs(_d) <= _tol AND _at > 0 AND _at < 1 AND NOT (_x = ax AND _y = ay) AND NOT (_x = bx AND _y = by), named_struct('t', _at, 'x', _x, 'y', _y), NULL)"
    # of two crossing edges the lesser decides where, so both get the same point
    first = "(ax < oax OR (ax = oax AND (ay < oay OR (ay = oay AND (bx < obx OR (bx = obx AND by < oby))))))"
    t, u = "(_ea / (_ea - _eb))", "(_oa / (_oa - _ob))"
    crossing = f"""IF(_oa * _ob < 0 AND _ea * _eb < 0 AND least(abs(_oa), abs(_ob), abs(_ea), abs(_eb)) > _tol, named_struct('t', {t},
        'x', IF({first}, ax + {t} * (bx - ax), oax + {u} * (obx - oax)), 'y', IF({first}, ay + {t} * (by - ay), oay + {u} * (oby - oay))), NULL)"""
    return met.withColumn("cut", F.expr(f"IF(_which < 2, {vertex}, {crossing})"))


def _fragments(cut: DataFrame, key: list[str]) -> DataFrame:
    """key, side, times, px, py, qx, qy of edges with their ``cuts``."""
    pts = """concat(array(named_struct('x', ax, 'y', ay)), transform(array_sort(coalesce(cuts, array()), (m, n) -> CASE WHEN m.t < n.t THEN -1 WHEN m.t > n.t THEN 1 ELSE 0 END),
        c -> named_struct('x', c.x, 'y', c.y)), array(named_struct('x', bx, 'y', by)))"""
    cut = cut.select(*key, "side", "times", F.expr(pts).alias("pts"))
    cut = cut.select(*key, "side", "times", F.explode(F.expr("transform(sequence(1, size(pts) - 1), i -> named_struct('p', pts[i - 1], 'q', pts[i]))")).alias("s"))
    return cut.select(*key, "side", "times", F.col("s.p.x").alias("px"), F.col("s.p.y").alias("py"), F.col("s.q.x").alias("qx"), F.col("s.q.y").alias("qy")).where("px <> qx OR py <> qy")


def noded(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, side, px, py, qx, qy: edges (key, side, ax, ay, bx, by) cut wherever another of their key meets them.

    A vertex within the tolerance of an edge cuts it at that vertex; two edges that cross are both
    cut at one point. So what meets anywhere shares a node with equal coordinates.
    """
    e = edges.where("ax <> bx OR ay <> by")
    # equal edges of a side are one with a count; the id is taken from the content, so a rerun gives the same
    e = e.groupBy(*key, "side", "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("times"))
    e = written(_with_size(e, key), "edges")
    end = ["ax", "ay", "bx", "by"]
    celled = _in_cells(e.select(*key, *end, "size").distinct())
    one = celled.alias("e")
    two = celled.select(*key, "cx", "cy", *(F.col(c).alias(f"o{c}") for c in end)).alias("o")
    met = one.join(two.hint("merge"), [*key, "cx", "cy"]).where("NOT (ax = oax AND ay = oay AND bx = obx AND by = oby)")
    met = _cut_at(met).select(*key, *end, "cut").where("cut IS NOT NULL")
    cuts = met.groupBy(*key, *end).agg(F.collect_set("cut").alias("cuts"))
    return _fragments(e.join(cuts.hint("merge"), [*key, *end], "left"), key)


def arcs(fragments: DataFrame, key: list[str]) -> DataFrame:
    """key, px, py, qx, qy, da, db, na: each stretch once, from its lesser end, with what side A and B
    have to its left more than to its right, and whether an odd number of A's edges (na) lie on it."""
    forward = F.expr("px < qx OR (px = qx AND py < qy)")
    ends = {n: F.when(forward, F.col(p)).otherwise(F.col(q)) for n, p, q in (("_px", "px", "qx"), ("_py", "py", "qy"), ("_qx", "qx", "px"), ("_qy", "qy", "py"))}
    f = fragments.withColumns({**ends, "_d": F.when(forward, F.col("times")).otherwise(-F.col("times"))})
    of = lambda s, c: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(F.lit(0)))
    g = f.groupBy(*key, "_px", "_py", "_qx", "_qy").agg(of("A", "_d").alias("da"), of("B", "_d").alias("db"), (of("A", "times") % 2).alias("na"))
    return g.where("da <> 0 OR db <> 0 OR na <> 0").withColumnsRenamed({"_px": "px", "_py": "py", "_qx": "qx", "_qy": "qy"})


def arranged(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, px, py, qx, qy and for both sides of each stretch the depths la, ra (of side A), lb, rb (of B) and the parities lp, rp of A.

    A depth is the number of shapes of a side that cover the place, if interiors lie to the left of
    their edges; the parity needs no direction.
    """
    arc = arcs(noded(edges, key), key)
    arc = arc.withColumnsRenamed({"px": "ax", "py": "ay", "qx": "bx", "qy": "by"})
    arc = written(_with_size(arc, key), "arcs")
    own = arc.withColumns({"mx": F.expr("(ax + bx) / 2D"), "my": F.expr("(ay + by) / 2D")})
    own = own.withColumns({"cx": F.expr("CAST(floor(mx / size) AS BIGINT)"), "cy": F.expr("CAST(floor(my / size) AS BIGINT)")})
    # the depths at the centre of each cell that holds an arc's middle: a scan over all crossings of its row's centre line
    centre = own.select(*key, "cx", "cy", F.expr("(cx + 0.5D) * size").alias("x")).distinct().withColumns({m: F.lit(0).cast("bigint") for m in MEASURES})
    lines = arc.withColumn("cy", F.explode(F.expr("sequence(CAST(floor(least(ay, by) / size - 0.5D) AS BIGINT), CAST(floor(greatest(ay, by) / size + 0.5D) AS BIGINT))"))).withColumn("y", F.expr("(cy + 0.5D) * size"))
    lines = lines.where("(ay > y) <> (by > y)").withColumn("x", F.expr("ax + (bx - ax) * (y - ay) / (by - ay)"))
    up = F.expr("IF(by > ay, 1, -1)")
    lines = lines.select(*key, F.lit(None).cast("bigint").alias("cx"), "cy", "x", (F.col("da") * up).alias("da"), (F.col("db") * up).alias("db"), "na")
    scan = Window.partitionBy(*key, "cy").orderBy(F.desc("x"), F.col("cx").isNull())  # what lies exactly above a centre is not to its right
    centre = lines.unionByName(centre.select(*lines.columns)).select(*key, "cx", "cy", *(F.sum(m).over(scan.rowsBetween(Window.unboundedPreceding, 0)).alias(f"c_{m}") for m in MEASURES)).where("cx IS NOT NULL")
    # from the centre up or down to the middle's height, then along to the middle; its own arc is not crossed
    near = _in_cells(arc).select(*key, "cx", "cy", *(F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by", *MEASURES)))
    j = own.join(near.hint("merge"), [*key, "cx", "cy"]).withColumns({"x0": F.expr("(cx + 0.5D) * size"), "y0": F.expr("(cy + 0.5D) * size")})
    high = "(oay + (oby - oay) * (x0 - oax) / nullif(obx - oax, 0D))"
    above = f"IF({high} < {{y}} OR ({high} = {{y}} AND (oby - oay) * (obx - oax) <= 0), 1, 0)"
    across = "(oax + (obx - oax) * (my - oay) / nullif(oby - oay, 0D))"
    same = "(oax = ax AND oay = ay AND obx = bx AND oby = by)"
    j = j.withColumns(
        {
            "_v": F.expr(f"IF((oax > x0) <> (obx > x0), ({above.format(y='my')} - {above.format(y='y0')}) * IF(obx > oax, 1, -1), 0)"),
            "_h": F.expr(f"IF((oay > my) <> (oby > my), (IF(NOT {same} AND {across} > mx, 1, 0) - IF({across} > x0, 1, 0)) * IF(oby > oay, 1, -1), 0)"),
        }
    )
    steps = [F.sum(F.expr(f"(_v + _h) * o{m}")).alias(f"s_{m}") for m in MEASURES]
    w = j.groupBy(*key, "cx", "cy", "ax", "ay", "bx", "by", *MEASURES).agg(*steps).join(centre.hint("merge"), [*key, "cx", "cy"])
    return _both_sides(w, key, lambda m: F.col(f"c_{m}") + F.col(f"s_{m}"))


def _both_sides(found: DataFrame, key: list[str], at: Callable[[str], Column]) -> DataFrame:
    """Arcs with the depths and parities on both sides, from ``at`` a measure beside their middles: to the
    right of an arc that rises, and above one that is level."""
    right = F.expr("by > ay")
    out = found
    for m, left_, right_ in (("da", "la", "ra"), ("db", "lb", "rb"), ("na", "lp", "rp")):
        out = out.withColumns({left_: F.when(right, at(m) + F.col(m)).otherwise(at(m)), right_: F.when(right, at(m)).otherwise(at(m) - F.col(m))})
    out = out.withColumns({p: F.pmod(p, F.lit(2)) for p in ("lp", "rp")})
    return out.select(*key, F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"), "la", "ra", "lb", "rb", "lp", "rp")


def by_size(shapes: DataFrame, key: list[str], how: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``how`` of shapes (key, rings, ...) and whether their keys have few edges: in one go where all have, else
    of the keys with few edges and of the others, as one table. The shapes are written once, and those of keys
    with few edges dealt by key before they become edges."""
    s = written(shapes, "shapes")
    each = s.groupBy(*key).agg(F.sum(F.expr("aggregate(rings, 0L, (n, r) -> n + size(r.pts))")).alias("n"))
    r = each.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    tasks = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), (r["all"] or 0) // TASK_EDGES)
    deal = lambda df: df.repartition(tasks, *key)
    if (r["most"] or 0) <= KEY_EDGES:
        return how(deal(s), True)
    many = written(each.where(F.col("n") > KEY_EDGES).select(*key), "many-edges").hint("merge")
    return how(deal(s.join(many, key, "left_anti")), True).unionByName(how(s.join(many, key, "left_semi"), False))


def _beside(rows: DataFrame, key: list[str], own: list[str], other: list[str]) -> DataFrame:
    """Each row of a key beside every row of it: key, own, and other with an o before the name."""
    g = rows.groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_l"))
    pairs = g.select(*key, "_l", F.explode("_l").alias("_e")).select(*key, "_e", F.explode("_l").alias("_o"))
    return pairs.select(*key, "_e.*", *(F.col(f"_o.{c}").alias(f"o{c}") for c in other))


def noded_few(edges: DataFrame, key: list[str]) -> DataFrame:
    """``noded`` for keys of few edges, within the tasks that hold them."""
    end = ["ax", "ay", "bx", "by"]
    e = edges.where("(ax <> bx OR ay <> by) AND ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL").groupBy(*key, "side", *end).agg(F.count(F.lit(1)).alias("times"))
    met = _cut_at(_beside(e, key, ["side", "times", *end], end))  # an edge meets itself, so none is lost
    cut = met.groupBy(*key, "side", "times", *end).agg(F.collect_set("cut").alias("cuts"))
    return _fragments(cut, key)


def arranged_few(edges: DataFrame, key: list[str]) -> DataFrame:
    """``arranged`` for keys of few edges, within the tasks that hold them: all crossings to the right of a middle are counted."""
    arc = arcs(noded_few(edges, key), key).withColumnsRenamed({"px": "ax", "py": "ay", "qx": "bx", "qy": "by"})
    cols = ["ax", "ay", "bx", "by", *MEASURES]
    j = _beside(arc, key, cols, cols).withColumns({"mx": F.expr("(ax + bx) / 2D"), "my": F.expr("(ay + by) / 2D")})
    across = "(oax + (obx - oax) * (my - oay) / nullif(oby - oay, 0D))"
    same = "(oax = ax AND oay = ay AND obx = bx AND oby = by)"
    j = j.withColumn("_h", F.expr(f"IF((oay > my) <> (oby > my) AND NOT {same} AND {across} > mx, IF(oby > oay, 1, -1), 0)"))
    found = j.groupBy(*key, *cols).agg(*(F.sum(F.expr(f"_h * o{m}")).alias(f"s_{m}") for m in MEASURES))
    return _both_sides(found, key, lambda m: F.col(f"s_{m}"))


def arranged_shapes(shapes: DataFrame, key: list[str]) -> DataFrame:
    """``arranged`` of shapes (key, side, rings): keys of few edges within tasks, the others by cells."""
    return by_size(shapes, key, lambda s, few: (arranged_few if few else arranged)(edges_of(s, key), key))


CROSS = "(px * qy - py * qx) / 2D"
#: Regions by the depths at a place; {0} is l or r.
REGIONS = {
    "a": "{0}a > 0", "b": "{0}b > 0", "intersection": "{0}a > 0 AND {0}b > 0", "union": "({0}a > 0 OR {0}b > 0)", "difference": "{0}a > 0 AND {0}b <= 0", "outside_b": "{0}b > 0 AND {0}a <= 0",
    "symmetric difference": "({0}a > 0) <> ({0}b > 0)", "repeated": "{0}a > 1", "odd": "{0}p = 1",
}


def region_area(region: str) -> Column:
    """An aggregate: the area of a region over the arcs of a group."""
    l, r = (REGIONS[region].format(s) for s in "lr")
    return F.sum(F.expr(f"(IF({l}, 1, 0) - IF({r}, 1, 0)) * {CROSS}"))


def region_edges(arcs_: DataFrame, region: str, key: list[str]) -> DataFrame:
    """key, px, py, qx, qy: the directed outline of a region, which lies to the left."""
    l, r = (REGIONS[region].format(s) for s in "lr")
    kept = arcs_.where(f"({l}) <> ({r})")
    at = lambda a, b: F.expr(f"IF({l}, {a}, {b})")
    return kept.select(*key, at("px", "qx").alias("px"), at("py", "qy").alias("py"), at("qx", "px").alias("qx"), at("qy", "py").alias("qy"))


def _next(edges: DataFrame, key: list[str], turn: str) -> DataFrame:
    """Edges with the id of the edge that follows: of those that leave an edge's end, the first clockwise
    from where it came (``left``, which keeps to the region), or the first the other way (``right``)."""
    here = edges.select(*key, "id", F.col("qx").alias("x"), F.col("qy").alias("y"), F.expr("atan2(py - qy, px - qx)").alias("w"))
    out = edges.select(*key, F.col("id").alias("next"), F.col("px").alias("x"), F.col("py").alias("y"), F.expr("atan2(qy - py, qx - px)").alias("v"))
    angle = "w - v" if turn == "left" else "v - w"
    j = here.join(out.hint("merge"), [*key, "x", "y"]).withColumn("_turn", F.expr(f"pmod({angle}, 2D * pi())"))
    j = j.withColumn("_turn", F.expr("IF(_turn < 1e-12D, 2D * pi(), _turn)"))
    return j.groupBy("id").agg(F.min_by("next", "_turn").alias("next"))


def _walk(links: DataFrame) -> DataFrame:
    """id, ring, back: the least id of each cycle of links (id, next), and the steps from an id on to that.

    Pointer doubling: after k rounds each row knows the least of the 2^k ids that follow. When
    no row learns more, all have gone round.
    """
    state = written(links.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("bigint").alias("back"), F.lit(1).cast("bigint").alias("reach")), "walk")
    while True:
        on = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("back").alias("_back"), F.col("reach").alias("_reach"))
        step = state.join(on.hint("merge"), "next")
        less = F.col("_ring") < F.col("ring")
        step = step.select("id", F.col("_next").alias("next"), F.when(less, F.col("_ring")).otherwise(F.col("ring")).alias("ring"), F.when(less, F.col("reach") + F.col("_back")).otherwise(F.col("back")).alias("back"), (F.col("reach") + F.col("_reach")).alias("reach"), less.alias("learnt"))
        step = written(step, "walk")
        if step.where("learnt").isEmpty():
            return step.select("id", "ring", "back")
        state = step.drop("learnt")


def stitched(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, ring, pts, area: the closed rings of directed edges (key, px, py, qx, qy) whose region lies to the left.

    Outer rings run with a positive area, holes with a negative one. Where rings touch at a node, each
    goes on along its own side; a ring that passes one node twice is divided there, so a hole
    that touches its outer ring is a ring of its own. Edges that do not close give no ring.
    """
    e = edges.groupBy(*key, "px", "py", "qx", "qy").agg(F.count(F.lit(1)).alias("_n"))
    e = written(e.drop("_n").withColumn("id", F.monotonically_increasing_id()), "directed")  # written once, so ids stay
    links = written(_next(e, key, "left"), "links")
    walked = _walk(links)
    passed = e.select("id", *key, F.col("qx").alias("x"), F.col("qy").alias("y")).join(walked.hint("merge"), "id")
    twice = passed.groupBy(*key, "ring", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not (twice := written(twice, "touching")).isEmpty():
        ringed = e.join(walked.select("id", "ring").hint("merge"), "id")
        ins = ringed.join(twice.select(*key, "ring", F.col("x").alias("qx"), F.col("y").alias("qy")).hint("merge"), [*key, "ring", "qx", "qy"], "left_semi")
        outs = ringed.join(twice.select(*key, "ring", F.col("x").alias("px"), F.col("y").alias("py")).hint("merge"), [*key, "ring", "px", "py"], "left_semi")
        ends = ins.select(*key, "ring", "id", "px", "py", "qx", "qy").unionByName(outs.select(*key, "ring", "id", "px", "py", "qx", "qy")).distinct()
        again = _next(ends, [*key, "ring"], "right").join(ins.select("id").hint("merge"), "id", "left_semi")
        links = written(links.join(again.withColumnRenamed("next", "_again").hint("merge"), "id", "left").select("id", F.coalesce("_again", "next").alias("next")), "links")
        walked = _walk(links)
    ordered = e.join(walked.hint("merge"), "id").groupBy(*key, "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("_p"))
    return _closed(ordered, key)


def _closed(ordered: DataFrame, key: list[str]) -> DataFrame:
    """key, ring, pts, area from the points ``_p`` (o, x, y) of each ring: the least id begins; then those that are most steps away from it."""
    pts = F.expr("transform(array(transform(concat(filter(_p, p -> p.o = 0), filter(_p, p -> p.o <> 0)), p -> named_struct('x', p.x, 'y', p.y))), p -> concat(p, array(p[0])))[0]")
    area = F.expr("aggregate(sequence(1, size(pts) - 1), 0D, (a, i) -> a + (pts[i - 1].x * pts[i].y - pts[i].x * pts[i - 1].y) / 2D)")
    return ordered.select(*key, "ring", pts.alias("pts")).withColumn("area", area)


def polygons(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, rings (part, ring, pts): stitched rings as geometries, each hole with the smallest outer ring around it."""
    r = written(stitched(edges, key), "rings")
    shells, holes = r.where("area > 0"), r.where("area < 0")
    of = F.concat_ws("\u0001", *(F.col(c).cast("string") for c in key))  # only the rings of one key are compared
    geometry = shells.select(F.col("ring").cast("string").alias("area_id"), of.alias("role"), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), "pts")).alias("rings"))
    size = cell_size(geometry)
    middle = lambda c: F.expr(f"(pts[0].{c} + pts[1].{c}) / 2D")
    points = holes.select(F.col("ring").alias("hole"), of.alias("_of"), middle("x").alias("x"), middle("y").alias("y"))
    around = covering(points, written(polygon_cells(geometry, size), "cells"), "hole", "_of", size=size).where("role = _of")
    outer = shells.select(F.col("ring").cast("string").alias("area_id"), F.struct("area", "ring").alias("_outer"))
    around = around.join(outer.hint("merge"), "area_id").groupBy("hole").agg(F.min("_outer")["ring"].alias("shell"))
    rows = shells.select(*key, F.col("ring").alias("shell"), F.lit(-1).cast("bigint").alias("hole"), "pts")
    rows = rows.unionByName(holes.join(around.hint("merge"), F.col("ring") == F.col("hole"), "left").select(*key, "shell", F.col("ring").alias("hole"), "pts"))
    return _assembled(rows, key)


def _assembled(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, rings (part, ring, pts) of rings (key, shell, hole, pts): a part for each shell, which has -1 as hole."""
    g = rows.groupBy(*key, "shell").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "pts"))), lambda x: x["pts"]).alias("rs"))
    g = g.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("shell", "rs"))).alias("parts"))
    return g.select(*key, F.expr("flatten(transform(parts, (p, i) -> transform(p.rs, (r, k) -> named_struct('part', i, 'ring', k, 'pts', r))))").alias("rings"))


def _followed(rows: DataFrame, key: list[str], turn: str, among: str) -> DataFrame:
    """Rows (key, edges: id, px, py, qx, qy, next, ring, back, n) with ``next`` by ``_next`` of the edges that meet ``among``, and where each lies on its ring by pointer doubling."""
    angle = {"left": "w - v", "right": "v - w"}[turn]
    pairs = rows.select(*key, "edges", F.explode("edges").alias("e")).select(*key, "e", F.explode("edges").alias("o"))
    pairs = pairs.withColumn("_goes", F.expr(f"o.px = e.qx AND o.py = e.qy AND {among}")).where("_goes OR o.id = e.id")
    pairs = pairs.withColumns({"w": F.expr("atan2(e.py - e.qy, e.px - e.qx)"), "v": F.expr("atan2(o.qy - o.py, o.qx - o.px)")}).withColumn("_turn", F.expr(f"pmod({angle}, 2D * pi())"))
    pairs = pairs.withColumn("_turn", F.expr("IF(_goes, IF(_turn < 1e-12D, 2D * pi(), _turn), NULL)"))
    e = pairs.groupBy(*key, "e").agg(F.min_by("o.id", "_turn").alias("next"))
    e = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("e.id", "e.px", "e.py", "e.qx", "e.qy", F.coalesce("next", "e.next").alias("next")))).alias("l"))
    less = "s[r.on].ring < r.ring"
    step = f"IF(r.on IS NULL, r, named_struct('on', s[r.on].on, 'ring', IF({less}, s[r.on].ring, r.ring), 'back', IF({less}, r.reach + s[r.on].back, r.back), 'reach', r.reach + s[r.on].reach))"
    walk = f"aggregate(sequence(0, CAST(ceil(log2(size(l))) AS INT)), transform(l, x -> named_struct('on', x.next, 'ring', x.id, 'back', 0L, 'reach', 1L)), (s, k) -> transform(s, r -> {step}))"
    e = e.withColumn("w", F.expr(walk)).select(*key, F.posexplode("l").alias("i", "x"), F.expr("w").alias("w")).select(*key, "x.*", F.expr("w[i].on").alias("on"), F.expr("w[i].ring").alias("ring"), F.expr("w[i].back").alias("back"))
    return e


def polygons_few(edges: DataFrame, key: list[str]) -> DataFrame:
    """``polygons`` for keys of few edges, within the tasks that hold them."""
    end = ["px", "py", "qx", "qy"]
    g = edges.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(*end))).alias("l"))
    g = g.select(*key, F.expr("transform(l, (x, i) -> named_struct('id', i, 'px', x.px, 'py', x.py, 'qx', x.qx, 'qy', x.qy, 'next', CAST(NULL AS INT), 'ring', CAST(NULL AS INT), 'n', 0L))").alias("edges"))
    e = _followed(g, key, "left", "TRUE").where("on IS NOT NULL")
    # where a ring passes a node more than once it is divided
    e = e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key, "ring", "qx", "qy")))
    again = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", *end, "next", "ring", "n"))).alias("edges"))
    place = "array_position(transform(edges, y -> y.id), {}) - 1"  # ids are places again if some edges did not close
    again = again.withColumn("edges", F.expr(f"transform(edges, x -> named_struct('id', CAST({place.format('x.id')} AS INT), 'px', x.px, 'py', x.py, 'qx', x.qx, 'qy', x.qy, 'next', CAST({place.format('x.next')} AS INT), 'ring', x.ring, 'n', x.n))"))
    e = _followed(again, key, "right", "e.n > 1 AND o.ring = e.ring")
    ordered = e.groupBy(*key, "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("_p"))
    r = _closed(ordered, key).where("area <> 0")
    # each hole goes to the smallest outer ring around it
    r = r.groupBy(*key).agg(F.collect_list(F.struct("ring", "pts", "area")).alias("rs"))
    r = r.select(*key, F.explode("rs").alias("r"), F.filter("rs", lambda x: x["area"] > 0).alias("shells"))
    r = r.select(*key, "r", F.explode_outer(F.when(F.col("r.area") < 0, F.col("shells")).otherwise(F.array("r"))).alias("s"))
    r = r.withColumns({"x": F.expr("(r.pts[0].x + r.pts[1].x) / 2D"), "y": F.expr("(r.pts[0].y + r.pts[1].y) / 2D"), "_rings": F.expr("array(named_struct('part', 0, 'ring', 0, 'pts', s.pts))")})
    around = F.expr("r.area > 0") | (F.col("s").isNotNull() & G.covers(f"({G.EDGES.format(rings='_rings')})", "x", "y"))
    r = r.groupBy(*key, F.col("r.ring").alias("ring")).agg(F.min(F.when(around, F.struct("s.area", "s.ring")))["ring"].alias("shell"), F.first("r.pts").alias("pts"), F.first("r.area").alias("area"))
    return _assembled(r.select(*key, "shell", F.expr("IF(area > 0, -1, ring)").alias("hole"), "pts"), key)


def region_polygons(shapes: DataFrame, key: list[str], region: str) -> DataFrame:
    """key, rings: a region of the arrangement of shapes (key, side, rings) as whole rings."""

    def how(s: DataFrame, few: bool) -> DataFrame:
        arcs_, whole = (arranged_few, polygons_few) if few else (arranged, polygons)
        return whole(region_edges(arcs_(edges_of(s, key), key), region, key), key)

    return by_size(shapes, key, how)
