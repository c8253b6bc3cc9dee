"""Circle discovery: every municipality that reaches a circle, or the reasons why that is not known."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaframe.operators.cells import BROADCAST_BYTES, Size, cell, cell_size, cells_bytes, covered, polygon_cells
from areaframe.sources.workspace import written

#: Metres by which an accepted distance may exceed the radius.
BAND = 0.01
#: Share by which a distance on the mean sphere may differ from the ellipsoid's (0.56 % at most).
SPHERE = 0.01
_A, _F = 6378137.0, 1 / 298.257223563
_B = _A * (1 - _F)
#: The least radius of curvature, so that no envelope is too small.
_LEAST = _B * _B / _A
_MEAN = (2 * _A + _B) / 3
_E2 = _F * (2 - _F)
#: The same for a distance by Lambert's formula at the place that is nearest on the sphere (3e-5 at most).
FINE = 2e-4
#: Circles that one task meets with edges; each may reach very many of them.
CIRCLES_EACH = 5_000
#: Cells across the envelope of a usual circle; smaller ones cost more cells than they spare edges.
ACROSS = 8
#: Roles that leave a circle incomplete; ``stable`` takes back what ``review`` does.
_OPEN = ("candidate", "bbox", "review", "stable")


def envelopes(circles: DataFrame) -> DataFrame:
    """One or two boxes for each circle (circle_id, x, y, radius_m): west, south, east, north.

    A circle over a pole takes all longitudes; one over the antimeridian is split.
    """
    c = circles.withColumn("_d", F.expr(f"radius_m / {_LEAST!r}D * 1.000001D")).withColumn("_p", F.radians("y"))
    south, north = F.degrees(F.col("_p") - F.col("_d")), F.degrees(F.col("_p") + F.col("_d"))
    c = c.withColumn("south", F.greatest(south, F.lit(-90.0))).withColumn("north", F.least(north, F.lit(90.0)))
    polar = (south <= -90) | (north >= 90)
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.try_divide(F.sin("_d"), F.cos("_p"))))))
    c = c.withColumn("_h", half).withColumn("_w", F.col("x") - F.col("_h")).withColumn("_e", F.col("x") + F.col("_h"))
    box = F.expr(
        """CASE WHEN _h >= 180D THEN array(named_struct('w', -180D, 'e', 180D))
        WHEN _w < -180D THEN array(named_struct('w', -180D, 'e', _e), named_struct('w', _w + 360D, 'e', 180D))
        WHEN _e > 180D THEN array(named_struct('w', _w, 'e', 180D), named_struct('w', -180D, 'e', _e - 360D))
        ELSE array(named_struct('w', _w, 'e', _e)) END"""
    )
    c = c.withColumn("_box", F.explode(box))
    return c.select("circle_id", "x", "y", "radius_m", F.col("_box.w").alias("west"), "south", F.col("_box.e").alias("east"), "north")


def distance(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres on WGS 84 by Vincenty's inverse formula; used within a few hundred kilometres."""
    u1, u2 = np.arctan((1 - _F) * np.tan(np.radians(lat1))), np.arctan((1 - _F) * np.tan(np.radians(lat2)))
    ell = lam = np.radians(lon2 - lon1)
    for _ in range(30):
        sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        s = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(np.cos(u1) * np.cos(u2) * np.sin(lam), sin_s, out=np.zeros_like(s), where=sin_s != 0)
        cos2 = 1 - sin_a**2
        cos_m = cos_s - np.divide(2 * np.sin(u1) * np.sin(u2), cos2, out=np.zeros_like(s), where=cos2 > 0)
        c = _F / 16 * cos2 * (4 + _F * (4 - 3 * cos2))
        new = ell + (1 - c) * _F * sin_a * (s + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
        if np.max(np.abs(new - lam), initial=0) < 1e-13:
            break
        lam = new
    k = cos2 * (_A**2 - _B**2) / _B**2
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    ds = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
    return _B * big_a * (s - ds)


def _haversine(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres on a sphere of the mean radius."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * _MEAN * np.arcsin(np.sqrt(np.minimum(a, 1)))


def nearest(p: pd.DataFrame, metric=distance) -> np.ndarray:
    """Least distance in metres from (x, y) to each straight lon/lat edge, by narrowing an interval."""
    x, y, ax, ay, bx, by = (p[c].to_numpy() for c in ("x", "y", "ax", "ay", "bx", "by"))
    at = lambda t: metric(x, y, ax + t * (bx - ax), ay + t * (by - ay))
    g = (np.sqrt(5) - 1) / 2
    low, high = np.zeros(len(p)), np.ones(len(p))
    a, b = high - g * (high - low), low + g * (high - low)
    da, db = at(a), at(b)
    for _ in range(48):  # one of the two inner places is kept at each step
        nearer = da < db
        high, low = np.where(nearer, b, high), np.where(nearer, low, a)
        new = np.where(nearer, high - g * (high - low), low + g * (high - low))
        dn = at(new)
        a, b, da, db = np.where(nearer, new, b), np.where(nearer, a, new), np.where(nearer, dn, db), np.where(nearer, da, dn)
    return np.minimum.reduce([at((low + high) / 2), at(np.zeros(len(p))), at(np.ones(len(p)))])


def within(p: pd.DataFrame) -> np.ndarray:
    """Whether each edge comes within radius_m and BAND. The sphere settles all but a few: its
    distances are within SPHERE of the ellipsoid's."""
    near, radius = nearest(p, _haversine), p.radius_m.to_numpy()
    out = near * (1 + SPHERE) <= radius
    close = ~out & (near * (1 - SPHERE) <= radius + BAND)
    out[close] = nearest(p[close]) <= radius[close] + BAND
    return out


def _bounds(boxes: DataFrame) -> DataFrame:
    """Adds to envelopes what ``_OUT``, ``_IN`` and ``_fine`` compare with: x beside the box, weights of a degree
    of longitude and latitude that no distance in the envelope falls below, and the limits of both."""
    b = boxes.withColumns({"_d": F.expr(f"radius_m / {_LEAST!r}D * 1.000001D"), "_p": F.radians("y")})
    polar = "(_p - _d <= -pi() / 2D OR _p + _d >= pi() / 2D)"
    b = b.withColumn("_h", F.expr(f"IF({polar}, 0D, asin(least(1D, sin(_d) / cos(_p))))"))
    # where the haversine is convex in a box twice as wide and high
    convex = f"NOT {polar} AND _d BETWEEN 0D AND 0.1D AND abs(_p) + 2D * _d < 1.57D AND _h < 0.7D AND cos(_p) / cos(abs(_p) + 2D * _d) * pow(sin(2D * _h), 2) <= 0.9D * cos(2D * _h)"
    # the least and the greatest radius of curvature around the circle: those of the meridian nearest to, of the normal farthest from the equator
    flat = f"{_LEAST * (1 - 1e-6)!r}D / pow(1D - {_E2!r}D * pow(sin(greatest(0D, abs(_p) - 2D * _d)), 2), 1.5D)"
    steep = f"({_A * (1 + 1e-6)!r}D / sqrt(1D - {_E2!r}D * pow(sin(least(pi() / 2D, abs(_p) + 2D * _d)), 2)))"
    sinc = "IF({0} > 1e-6D, sin({0} / 2D) / ({0} / 2D), 1D)"
    return b.select(
        *boxes.columns,
        F.expr("CASE WHEN x > east THEN x - 360D WHEN x < west THEN x + 360D ELSE x END").alias("_x"),
        F.expr(f"IF({polar}, 0D, cos(_p) * least(cos(radians(south)), cos(radians(north))) * pow({sinc.format('_h')}, 2))").alias("_kx"),
        F.expr(f"IF(_d < pi(), pow({sinc.format('_d')}, 2), 0D)").alias("_ky"),
        F.expr(f"pow(degrees((radius_m + {BAND!r}D) / ({flat})) * 1.0001D, 2)").alias("_far"),
        F.expr(f"pow(sin(least(pi() / 2D, radius_m / (2D * {steep}))), 2)").alias("_near"),
        F.expr(f"atan({1 - _F!r}D * tan(_p))").alias("_b"),
        F.when(F.expr(convex), F.col("_d") * 2).alias("_dd"),
        (F.col("_h") * 2).alias("_hh"),
    )


#: Where along an edge it comes nearest with those weights, and that its distance there is beyond the radius on
#: any sphere and ellipsoid, or that the haversine of this one place is within it on both.
_T = "least(1D, greatest(0D, coalesce(((_x - ax) * (bx - ax) * _kx + (y - ay) * (by - ay) * _ky) / nullif((bx - ax) * (bx - ax) * _kx + (by - ay) * (by - ay) * _ky, 0D), 0D)))"
_OUT = "pow(_x - ax - _t * (bx - ax), 2) * _kx + pow(y - ay - _t * (by - ay), 2) * _ky > _far"
_IN = "pow(sin(radians(ay + _t * (by - ay) - y) / 2D), 2) + cos(radians(y)) * cos(radians(ay + _t * (by - ay))) * pow(sin(radians(ax + _t * (bx - ax) - _x) / 2D), 2) <= _near"



def _let(name: str, value: str, then: str) -> str:
    """SQL for ``then`` with a name for a value, which is evaluated once, and not compiled with what surrounds it."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _fine() -> str:
    """SQL for 2 within the radius, 0 beyond it and BAND, 1 not known, by the place that is nearest on the sphere.

    A Newton step leads there. The haversine is convex around the circle, so its tangent there is a bound from below;
    Lambert's formula gives the distance on the ellipsoid. Slope, curve and hav are twice those of the haversine.
    """
    edge = "named_struct('p', radians(y), 'c', cos(radians(y)), 'dp', radians(by - ay), 'dl', radians(bx - ax))"
    at = lambda t, then: _let("w", f"named_struct('p', radians(ay + {t} * (by - ay)), 'l', radians(ax + {t} * (bx - ax) - _x))", _let("v", "named_struct('sp', sin(w.p), 'cp', cos(w.p), 'sl', sin(w.l), 'h', 2D * pow(sin(w.l / 2D), 2), 'd', w.p - o.p)", then))
    slope = "(sin(v.d) * o.dp + o.c * (v.cp * v.sl * o.dl - v.sp * o.dp * v.h))"
    curve = "(cos(v.d) * o.dp * o.dp + o.c * (v.cp * ((1D - v.h) * o.dl * o.dl - o.dp * o.dp * v.h) - 2D * v.sp * v.sl * o.dp * o.dl))"
    hav = "(2D * pow(sin(v.d / 2D), 2) + o.c * v.cp * v.h)"
    # what the slope can take away on the part of the edge that lies in the envelope
    reach = "least(1.5D * _hh / nullif(abs(o.dl), 0D), 1.5D * _dd / nullif(abs(o.dp), 0D))"
    least = _let("r", reach, _let("k", slope, f"1D + least(0D, k * greatest(-t, -r), k * least(1D - t, r)) / nullif({hav}, 0D)"))
    x = "(g - sin(g)) * pow(sin((_b + q) / 2D) * cos((q - _b) / 2D) / cos(g / 2D), 2)"
    y = "(g + sin(g)) * pow(cos((_b + q) / 2D) * sin((q - _b) / 2D) / sin(g / 2D), 2)"
    out = f"CASE WHEN m * {1 + FINE!r}D <= radius_m THEN 2 WHEN m * sqrt(greatest(0D, {least})) * {1 - FINE!r}D > radius_m + {BAND!r}D THEN 0 ELSE 1 END"
    out = _let("m", f"{_A!r}D * (g - {_F / 2!r}D * ({x} + {y}))", out)
    out = _let("g", "2D * asin(sqrt(least(1D, pow(sin((q - _b) / 2D), 2) + cos(_b) * cos(q) * v.h / 2D)))", f"IF(g > 0D, {out}, 1)")
    out = _let("q", f"atan({1 - _F!r}D * tan(w.p))", out)
    out = at("t", f"IF(abs(v.d) <= _dd AND abs(w.l) <= _hh, {out}, 1)")
    return _let("o", edge, _let("t", at("_t", f"least(1D, greatest(0D, coalesce(_t - {slope} / nullif({curve}, 0D), _t)))"), out))


def _state(size: Size) -> Column:
    """2 for an edge within the radius and for a shape that holds the centre, 0 beyond it and BAND, 1 for what is left to
    ``within``. One place on an edge (``_t``) or a bound from below settles most of them."""
    return F.when(F.col("home"), F.when(covered(size), 2).otherwise(0)).otherwise(F.expr(f"CASE WHEN ({_IN}) THEN 2 WHEN ({_OUT}) THEN 0 WHEN _dd IS NULL THEN 1 ELSE {_fine()} END"))


def _met(circles: DataFrame, cells: DataFrame, size: Size) -> DataFrame:
    """circle_id, x, y, radius_m, area_id, role, ax, ay, bx, by, state: the edges that may be near a circle, and the
    shapes that hold its centre (state 2, without an edge).

    ``cells`` are broadcast, so all rows of a circle stay in the task that has it.
    """
    x, y = size
    span = lambda a, b, s: F.sequence(cell(a, s), cell(b, s))
    none = F.array().cast("array<struct<cx: int, cy: int, home: boolean>>")
    at = lambda cx, cy, home: F.struct(cx.alias("cx"), cy.alias("cy"), F.lit(home).alias("home"))
    grid = F.flatten(F.transform(span("west", "east", x), lambda i: F.transform(span("south", "north", y), lambda j: at(i, j, False))))
    home = F.when(F.expr("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"), F.array(at(cell("x", x), cell("y", y), True)))
    b = _bounds(envelopes(circles))
    b = b.withColumn("_c", F.explode(F.concat(F.coalesce(grid, none), F.coalesce(home, none)))).select(*b.columns, "_c.*")
    # cells as wholes for centres, and edge by edge for envelopes
    key, ends = ["area_id", "role", "cx", "cy"], ("ax", "ay", "bx", "by")
    whole = cells.select(*key, F.lit(True).alias("home"), "inside", "edges", *(F.lit(None).cast("double").alias(c) for c in ends))
    single = cells.select(*key, F.lit(False).alias("home"), F.explode("edges").alias("e")).select(*key, "home", F.lit(None).cast("boolean").alias("inside"), F.lit(None).cast(dict(cells.dtypes)["edges"]).alias("edges"), "e.*")
    met = b.join(F.broadcast(whole.unionByName(single)), ["cx", "cy", "home"])
    # an edge is met in the first cell that its box and the envelope share
    beside = "least(ax, bx) <= east AND west <= greatest(ax, bx) AND least(ay, by) <= north AND south <= greatest(ay, by)"
    first = f"cx = floor(greatest(west, least(ax, bx)) / {x!r}D) AND cy = floor(greatest(south, least(ay, by)) / {y!r}D)"
    met = met.where(f"home OR ({beside} AND {first})").withColumn("_t", F.expr(_T))
    columns = ("circle_id", "x", "y", "radius_m", "area_id", "role", *ends)
    met = met.select(*columns, _state(size).alias("state"))
    # a filter would be pushed below and repeat all formulas; a generator is not
    return met.select(*columns, F.explode(F.when(F.col("state") > 0, F.array("state"))).alias("state"))


def _meetings(circles: DataFrame, geometry: DataFrame) -> list[DataFrame]:
    """``_met`` for parts of the areas, each small enough to be broadcast; ``circles`` are dealt by circle_id."""
    size = cell_size(geometry)
    wide = envelopes(circles).select(F.percentile_approx(F.col("east") - F.col("west"), 0.5).alias("w"), F.percentile_approx(F.col("north") - F.col("south"), 0.5).alias("h")).first()
    size = tuple(max(s, v / ACROSS) if v and np.isfinite(v) else s for s, v in zip(size, wide))
    cells = written(polygon_cells(geometry, size), "cells")
    n = 4 * cells_bytes(cells) // BROADCAST_BYTES + 1  # edge by edge they take up to four times as much
    return [_met(circles, cells.where(f"pmod(xxhash64(area_id), {n}) = {i}") if n > 1 else cells, size) for i in range(n)]


def _dealt(circles: DataFrame) -> DataFrame:
    return circles.repartition(circles.count() // CIRCLES_EACH + 1, "circle_id")


def circle_hits(circles: DataFrame, geometry: DataFrame) -> DataFrame:
    """circle_id, area_id, role: geometries that hold the centre or come within the radius.

    Cells find the geometries that hold a centre and, by the envelopes, the edges that may be near. The engine
    settles all but very few of those, which reach the NumPy kernel. Distances up to BAND beyond the radius count as within.
    """
    key = ["circle_id", "area_id", "role"]
    kind = dict(circles.dtypes)["circle_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield p.loc[within(p), key].drop_duplicates()

    parts = []
    for met in _meetings(_dealt(circles), geometry):
        parts += [met.where("state = 2").select(*key), met.where("state = 1").drop("state").mapInPandas(run, f"circle_id {kind}, area_id string, role string")]
    return reduce(DataFrame.unionByName, parts).distinct()


def _tallied(circles: DataFrame, geometry: DataFrame, lists: bool) -> DataFrame:
    """The circles with n_u, n_d, n_legacy, n_open, first: how many areas leave each of them incomplete for want of geometry or
    by a dispute (n_legacy: disputes before ``stable`` counts), how many areas the engine could not settle, and with ``lists`` the first 20 of n_u and n_d.

    All rows of a circle are counted in the task that has it, none of them are exchanged.
    """
    circles = _dealt(circles)
    state = lambda *roles: F.max(F.when(F.col("role").isin(*roles), F.col("state")).otherwise(0))
    counts = {"n_u": "count_if(u = 2)", "n_d": "count_if(u = 0 AND r = 2 AND s = 0)", "n_legacy": "count_if(u = 0 AND r = 2)", "n_open": "count_if(u = 1 OR (u = 0 AND (r = 1 OR (r = 2 AND s = 1))))"}
    parts = []
    for met in _meetings(circles, geometry):
        areas = met.groupBy("circle_id", "area_id").agg(state("candidate", "bbox").alias("u"), state("review").alias("r"), state("stable").alias("s"))
        first = "slice(array_sort(collect_set(IF(u = 2 OR (u = 0 AND r = 2 AND s = 0), area_id, NULL))), 1, 20)" if lists else "CAST(NULL AS array<string>)"
        parts.append(areas.groupBy("circle_id").agg(*(F.expr(v).alias(k) for k, v in counts.items()), *([F.expr(first).alias("first")] if lists else [])))
    tally = parts[0]
    if len(parts) > 1:
        merged = [F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 20).alias("first")] if lists else []
        tally = reduce(DataFrame.unionByName, parts).groupBy("circle_id").agg(*(F.sum(c).alias(c) for c in counts), *merged)
    return circles.join(tally.hint("merge"), "circle_id", "left").na.fill(0, list(counts))


def discover(circles: DataFrame, municipalities: DataFrame, geometry: DataFrame, stable: DataFrame | None = None, listed: bool = True) -> DataFrame:
    """One row a circle: circle_id, status, n_matches, matches, n_affected, affected (first 20), reasons.

    ``municipalities`` (area_id) are all that could match; ``geometry`` their assignment,
    bbox and candidate geometry, and as ``review`` the disputed part of a changed boundary.
    ``stable`` (area_id, rings) is what no dispute touches: a circle that reaches it matches
    in spite of the dispute. An area with no extent leaves every circle incomplete. Where not
    ``listed``, affected is left out: who only counts need not gather them.
    """
    lost = _unlocated(municipalities, geometry)
    known, rest, hits = _sorted(circles, geometry, stable, lost, listed)
    known = known.select("circle_id", F.array().cast("array<string>").alias("m"), (F.col("first") if listed else F.array().cast("array<string>")).alias("p"), "n_u", "n_d")
    out = _answers(known, *lost).unionByName(_decided(rest, hits, *lost))
    return out if listed else out.drop("affected")


def compare_rules(circles: DataFrame, municipalities: DataFrame, geometry: DataFrame, stable: DataFrame) -> DataFrame:
    """circle_id, legacy_status, status, n_legacy, n_matches, change: circles answered without and with what disputes leave untouched.

    ``change`` is ``unchanged``, ``completed`` (the disputes no longer matter), ``fewer_affected``, or ``regressed``,
    which no circle may be: an answer that was complete has to stay as it was.
    """
    lost = _unlocated(municipalities, geometry)
    known, rest, hits = _sorted(circles, geometry, stable, lost, False)
    hits = written(hits, "circle-hits")
    columns = ("status", "n_matches", "matches", "n_affected")
    old = _decided(rest, hits.withColumn("roles", F.array_remove("roles", "stable")).where("size(roles) > 0"), *lost).select("circle_id", F.struct(*columns).alias("o"))
    new = _decided(rest, hits, *lost).select("circle_id", F.struct(*columns).alias("n"))
    j = old.join(new.hint("merge"), "circle_id")
    change = F.when(F.col("o").eqNullSafe(F.col("n")), "unchanged").when((F.col("o.status") == "incomplete") & (F.col("n.status") == "complete"), "completed")
    change = change.when((F.col("n.status") == "incomplete") & (F.col("o.status") == "incomplete") & (F.col("n.n_affected") < F.col("o.n_affected")), "fewer_affected").otherwise("regressed")
    j = j.select("circle_id", F.col("o.status").alias("legacy_status"), "n.status", F.col("o.n_matches").alias("n_legacy"), "n.n_matches", change.alias("change"))
    held = F.lit("incomplete")
    known = known.select("circle_id", held.alias("legacy_status"), held.alias("status"), F.lit(0).alias("n_legacy"), F.lit(0).alias("n_matches"), F.when(F.col("n_d") == F.col("n_legacy"), "unchanged").otherwise("fewer_affected").alias("change"))
    return j.unionByName(known.where("circle_id IS NOT NULL"))


def _unlocated(municipalities: DataFrame, geometry: DataFrame) -> tuple[list[str], int]:
    """The first 20 areas without any extent, and how many there are."""
    unlocated = municipalities.join(geometry.select("area_id").distinct(), "area_id", "left_anti").select("area_id")
    return [r[0] for r in unlocated.orderBy("area_id").limit(20).collect()], unlocated.count()


def _sorted(circles: DataFrame, geometry: DataFrame, stable: DataFrame | None, lost: tuple[list[str], int], listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Circles that are incomplete and whose counts are known (see ``_tallied``), the other circles, and what those reach: circle_id, area_id, roles.

    An incomplete circle answers with counts, so what it reaches is counted where it is found and never exchanged. All shapes are
    met only by circles that may be complete, whose answer lists them.
    """
    parts = geometry.select("area_id", "role", "rings")
    if stable is not None:
        parts = parts.unionByName(stable.select("area_id", F.lit("stable").alias("role"), "rings"))
    parts = written(parts, "circle-shapes")
    doubtful = parts.where(F.col("role").isin(*_OPEN))
    state = written(_tallied(circles.select("circle_id", "x", "y", "radius_m"), doubtful, listed), "circle-state")
    bad, tied = F.expr(f"n_u + n_d + {lost[1]} > 0"), F.col("n_open") > 0
    n = state.agg(F.count_if(bad & tied).alias("tied"), F.count_if(~bad).alias("free")).first()
    hits = [circle_hits(state.where(w).select("circle_id", "x", "y", "radius_m"), g) for m, w, g in ((n["tied"], bad & tied, doubtful), (n["free"], ~bad, parts)) if m]
    hits = reduce(DataFrame.unionByName, hits) if hits else state.where("false").select("circle_id", F.lit("").alias("area_id"), F.lit("").alias("role"))
    return state.where(bad & ~tied), state.where(~bad | tied), hits.groupBy("circle_id", "area_id").agg(F.collect_set("role").alias("roles"))


def _decided(circles: DataFrame, hits: DataFrame, missing: list[str], n_missing: int) -> DataFrame:
    disputed = F.array_contains("roles", "review") & ~F.array_contains("roles", "stable")
    ungiven = F.array_contains("roles", "candidate") | F.array_contains("roles", "bbox")
    hits = hits.withColumn("reason", F.when(ungiven, "municipal_geometry_unavailable").when(disputed, "boundary_disagreement"))
    sums = hits.groupBy("circle_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("reason").isNull(), F.col("area_id")))).alias("m"),
        F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.col("area_id")))).alias("p"),
        F.count(F.when(F.col("reason") == "municipal_geometry_unavailable", 1)).alias("n_u"),
        F.count(F.when(F.col("reason") == "boundary_disagreement", 1)).alias("n_d"),
    )
    none = F.array().cast("array<string>")
    out = circles.select("circle_id").join(sums, "circle_id", "left").withColumn("m", F.coalesce("m", none)).withColumn("p", F.coalesce("p", none))
    return _answers(out.na.fill(0, ["n_u", "n_d"]), missing, n_missing)


def _answers(counted: DataFrame, missing: list[str], n_missing: int) -> DataFrame:
    """Rows of ``discover`` from circle_id, m (sorted matches), p (affected, at least the first 20 of them), n_u, n_d."""
    none = F.array().cast("array<string>")
    lost = F.array(*(F.lit(x) for x in missing)).cast("array<string>")
    affected = F.array_sort(F.array_union(F.coalesce("p", none), lost))
    n_affected = (F.col("n_u") + F.col("n_d") + n_missing).cast("int")
    bad = n_affected > 0
    reasons = F.concat_ws(
        ",",
        F.when(F.col("n_d") > 0, F.concat(F.lit("boundary_disagreement:"), F.col("n_d").cast("string"))),
        F.when(F.col("n_u") > 0, F.concat(F.lit("municipal_geometry_unavailable:"), F.col("n_u").cast("string"))),
        F.lit(f"municipal_extent_unlocated:{n_missing}" if n_missing else None).cast("string"),
    )
    return counted.select(
        "circle_id",
        F.when(bad, "incomplete").otherwise("complete").alias("status"),
        F.when(bad, 0).otherwise(F.size("m")).alias("n_matches"),
        F.when(bad, none).otherwise(F.col("m")).alias("matches"),
        n_affected.alias("n_affected"),
        F.when(bad, F.slice(affected, 1, 20)).otherwise(none).alias("affected"),
        reasons.alias("reasons"),
    )


def page(result: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of each complete circle's sorted matches."""
    return result.where("status = 'complete'").select("circle_id", F.posexplode("matches").alias("pos", "area_id")).where((F.col("pos") >= offset) & (F.col("pos") < offset + limit))
