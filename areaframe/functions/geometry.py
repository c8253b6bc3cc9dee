"""Geometry as nested arrays: every function is a Column expression that Spark runs in the JVM.

A geometry is an array of rings (part, ring, pts); interiors lie to the left of the edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = """flatten(transform({rings}, (r, k) -> transform(sequence(1, size(r.pts) - 1), i -> named_struct(
    'part', r.part, 'ring', r.ring, 'seq', i, 'ax', r.pts[i - 1].x, 'ay', r.pts[i - 1].y, 'bx', r.pts[i].x, 'by', r.pts[i].y))))"""


def edges(rings: str = "rings") -> Column:
    """Directed edges (part, ring, seq, ax, ay, bx, by) of a rings column."""
    return F.expr(f"CASE WHEN {rings} IS NULL THEN NULL ELSE {EDGES.format(rings=rings)} END")


def box_rings(x0: str, y0: str, x1: str, y1: str, part: int = 0, ring: int = 0) -> str:
    """SQL for one rectangular ring; a hole (ring > 0) runs clockwise."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    if ring:
        corners.reverse()
    pts = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in corners)
    return f"named_struct('part', {part}, 'ring', {ring}, 'pts', array({pts}))"


def points(rings: str = "rings") -> str:
    return f"flatten(transform({rings}, r -> r.pts))"


def bbox(rings: str = "rings") -> list[Column]:
    """west, south, east, north."""
    p = points(rings)
    return [F.expr(f"{f}(transform({p}, p -> p.{c}))").alias(n) for n, f, c in (("west", "array_min", "x"), ("south", "array_min", "y"), ("east", "array_max", "x"), ("north", "array_max", "y"))]


def area(rings: str = "rings") -> Column:
    """Planar area: the shoelace sum over all edges, holes taken off by their direction."""
    return F.expr(f"aggregate({EDGES.format(rings=rings)}, 0D, (a, e) -> a + (e.ax * e.by - e.bx * e.ay) / 2D)")


# Two products that are equal for a point on an edge's line; which is the greater gives the side. They are taken from
# the edge's middle, so that both diagonals of a box are judged as the box's own formula |y - yc| * w <= |x - xc| * h does.
_RISE = "(({y} - (least(e.ay, e.by) + abs(e.by - e.ay) / 2D)) * (e.bx - e.ax))"
_RUN = "(({x} - (least(e.ax, e.bx) + abs(e.bx - e.ax) / 2D)) * (e.by - e.ay))"
ON_EDGE = f"({{x}} BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND {{y}} BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by) AND ({_RISE} = {_RUN} OR {{x}} = e.ax AND {{y}} = e.ay OR {{x}} = e.bx AND {{y}} = e.by))"
#: Whether a point is left of an edge that spans its height, and whether one lies above an edge that spans its x; a
#: point on the edge counts as to the right of it, and as above one that does not rise to the right.
LEFT_OF = f"IF(e.by > e.ay, {_RISE} > {_RUN}, {_RISE} < {_RUN})"
ABOVE = f"(IF(e.bx > e.ax, {_RISE} > {_RUN}, {_RISE} < {_RUN}) OR ({_RISE} = {_RUN} AND (e.by - e.ay) * (e.bx - e.ax) <= 0D))"
CROSSES = f"((e.ay > {{y}}) <> (e.by > {{y}}) AND {LEFT_OF})"


def covers(edges_: str, x: str, y: str) -> Column:
    """Whether edges enclose (even-odd) or hold a point; the boundary counts as inside."""
    on = f"exists({edges_}, e -> {ON_EDGE.format(x=x, y=y)})"
    inside = f"size(filter({edges_}, e -> {CROSSES.format(x=x, y=y)})) % 2 = 1"
    return F.expr(f"({on} OR {inside})")


def counts(rings: str = "rings") -> list[Column]:
    """n_parts, n_holes, n_vertices (closing points not counted)."""
    return [
        F.expr(f"size(array_distinct(transform({rings}, r -> r.part)))").alias("n_parts"),
        F.expr(f"size(filter({rings}, r -> r.ring > 0))").alias("n_holes"),
        F.expr(f"aggregate({rings}, 0, (a, r) -> a + size(r.pts) - 1)").alias("n_vertices"),
    ]


def issue(rings: str = "rings") -> Column:
    """The first structural fault of a geometry, or null: missing, empty, open or short ring, non-finite."""
    return F.expr(
        f"""CASE WHEN {rings} IS NULL THEN 'missing' WHEN size({rings}) = 0 THEN 'empty'
        WHEN exists({rings}, r -> r.pts IS NULL OR size(r.pts) < 4) THEN 'short_ring'
        WHEN exists({points(rings)}, p -> p.x IS NULL OR p.y IS NULL OR isnan(p.x) OR isnan(p.y) OR abs(p.x) = double('inf') OR abs(p.y) = double('inf')) THEN 'not_finite'
        WHEN exists({rings}, r -> r.pts[0] <> r.pts[size(r.pts) - 1]) THEN 'open_ring' END"""
    )


def oriented(rings: str = "rings") -> Column:
    """Rings turned so that interiors lie to the left: outer rings with a positive area, holes with a negative one."""
    size_ = "aggregate(sequence(1, size(r.pts) - 1), 0D, (a, i) -> a + (r.pts[i - 1].x * r.pts[i].y - r.pts[i].x * r.pts[i - 1].y))"
    return F.expr(f"transform({rings}, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', IF(({size_} < 0) = (r.ring = 0), reverse(r.pts), r.pts)))")


def canonical_text(rings: str = "rings") -> Column:
    """Coordinates as text in a fixed order of rings, each turned to begin at its least point."""
    turned = "concat(slice(o, m, size(o)), slice(o, 1, m - 1))"
    one = f"""transform(array(transform(slice(r.pts, 1, size(r.pts) - 1), p -> concat(p.x, ' ', p.y))), o ->
        array_join(transform(array(array_position(o, array_min(o))), m -> array_join({turned}, ','))  , ''))[0]"""
    one = one.replace("m - 1", "int(m) - 1").replace("slice(o, m,", "slice(o, int(m),")
    return F.expr(f"array_join(array_sort(transform({rings}, r -> {one})), ';')")


def fingerprint(rings: str = "rings") -> Column:
    return F.sha2(canonical_text(rings), 256)


# GRS 80 and the Lambert conformal conic EPSG:3347.
_A, _E = 6378137.0, math.sqrt(2 / 298.257222101 - (1 / 298.257222101) ** 2)
_LAT0, _LON0, _LAT1, _LAT2, _X0, _Y0 = 63.390675, -91.86666666666666, 49.0, 77.0, 6200000.0, 3000000.0


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_P1, _P2 = math.radians(_LAT1), math.radians(_LAT2)
LCC_N = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
LCC_F = _m(_P1) / (LCC_N * _t(_P1) ** LCC_N)
LCC_R0 = _A * LCC_F * _t(math.radians(_LAT0)) ** LCC_N


def lcc_sql(lon: str, lat: str) -> tuple[str, str]:
    """SQL (Spark and DuckDB) for EPSG:3347 easting and northing of degrees."""
    s = f"({_E!r} * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {_E / 2!r}))"
    r, th = f"({_A * LCC_F!r} * pow({t}, {LCC_N!r}))", f"({LCC_N!r} * radians({lon} - ({_LON0!r})))"
    return f"({_X0!r} + {r} * sin({th}))", f"({_Y0!r} + {LCC_R0!r} - {r} * cos({th}))"


def projected(rings: str = "rings") -> Column:
    """The rings in EPSG:3347 metres."""
    x, y = lcc_sql("p.x", "p.y")
    return F.expr(f"transform({rings}, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', transform(r.pts, p -> named_struct('x', {x}, 'y', {y}))))")


def unprojected_sql(x: str, y: str, rounds: int = 6) -> tuple[str, str]:
    """SQL for degrees from EPSG:3347 metres; the latitude is iterated ``rounds`` times."""
    dx, dy = f"({x} - {_X0!r})", f"({LCC_R0!r} - ({y} - {_Y0!r}))"
    t = f"pow(sqrt({dx} * {dx} + {dy} * {dy}) / {_A * LCC_F!r}, {1 / LCC_N!r})"
    lat = f"(pi() / 2 - 2 * atan({t}))"
    step = f"aggregate(sequence(1, {rounds}), {lat}, (p, i) -> pi() / 2 - 2 * atan({t} * pow((1 - {_E!r} * sin(p)) / (1 + {_E!r} * sin(p)), {_E / 2!r})))"
    return f"(degrees(atan2({dx}, {dy}) / {LCC_N!r}) + ({_LON0!r}))", f"degrees({step})"


def densified(rings: str, step: float) -> Column:
    """Rings with points added so that no edge spans more than ``step`` in x or y."""
    pieces = f"greatest(1, CAST(ceil(greatest(abs(b.x - a.x), abs(b.y - a.y)) / {step!r}D) AS INT))"
    leg = f"transform(array(named_struct('a', r.pts[i - 1], 'b', r.pts[i])), s -> transform(sequence(0, {pieces.replace('b.', 's.b.').replace('a.', 's.a.')} - 1), k -> named_struct('x', s.a.x + (s.b.x - s.a.x) * k / {pieces.replace('b.', 's.b.').replace('a.', 's.a.')}, 'y', s.a.y + (s.b.y - s.a.y) * k / {pieces.replace('b.', 's.b.').replace('a.', 's.a.')})))[0]"
    return F.expr(f"transform({rings}, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', concat(flatten(transform(sequence(1, size(r.pts) - 1), i -> {leg})), array(r.pts[0]))))")


def without_small(rings: str, least: float) -> Column:
    """Parts whose outer ring, and holes whose ring, enclose less than ``least`` are left out."""
    size_ = "abs(aggregate(sequence(1, size(r.pts) - 1), 0D, (a, i) -> a + (r.pts[i - 1].x * r.pts[i].y - r.pts[i].x * r.pts[i - 1].y) / 2D))"
    return F.expr(f"transform(array(filter({rings}, r -> {size_} >= {least!r}D)), kept -> filter(kept, r -> exists(kept, o -> o.part = r.part AND o.ring = 0)))[0]")


GEOJSON = "struct<type: string, coordinates: array<array<array<array<double>>>>>"


def to_geojson(rings: str = "rings") -> Column:
    """A MultiPolygon document as JSON text."""
    part = f"transform(array_sort(array_distinct(transform({rings}, r -> r.part))), k -> transform(array_sort(filter({rings}, r -> r.part = k), (a, b) -> a.ring - b.ring), r -> transform(r.pts, p -> array(p.x, p.y))))"
    return F.expr(f"to_json(named_struct('type', 'MultiPolygon', 'coordinates', {part}))")


def document_issue(column: str) -> Column:
    """The first fault of a GeoJSON document that no ring can have: missing, empty, a kind other than polygons, a third coordinate."""
    kind = f"get_json_object({column}, '$.type')"
    many = f"from_json({column}, '{GEOJSON}').coordinates"
    single = f"array(from_json({column}, 'struct<type: string, coordinates: array<array<array<double>>>>').coordinates)"
    some = f"IF({kind} = 'MultiPolygon', {many}, {single})"
    return F.expr(
        f"""CASE WHEN {column} IS NULL OR trim({column}) IN ('', 'null') THEN 'missing' WHEN {kind} IS NULL OR {kind} NOT IN ('Polygon', 'MultiPolygon') THEN 'unsupported'
        WHEN coalesce(size(flatten({some})), 0) <= 0 THEN 'empty' WHEN exists(flatten(flatten({some})), q -> size(q) > 2) THEN 'has_z' END"""
    )


def from_geojson(column: str) -> Column:
    """Rings of a Polygon or MultiPolygon document; null for anything else."""
    many = f"from_json({column}, '{GEOJSON}')"
    single = f"from_json({column}, 'struct<type: string, coordinates: array<array<array<double>>>>')"
    rings = "flatten(transform({c}, (p, i) -> transform(p, (r, k) -> named_struct('part', i, 'ring', k, 'pts', transform(r, q -> named_struct('x', q[0], 'y', q[1]))))))"
    return F.expr(f"CASE get_json_object({column}, '$.type') WHEN 'MultiPolygon' THEN {rings.format(c=f'{many}.coordinates')} WHEN 'Polygon' THEN {rings.format(c=f'array({single}.coordinates)')} END")
