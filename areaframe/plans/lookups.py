"""Queries about points, polygons and circles, with closed-form oracles.

The oracles use rectangle arithmetic on the fixture's formulas, not the edge algorithms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.operators import catalogue, cells, circle, hierarchy, lifecycle, lookup, overlay, review
from areaframe.sources import fixtures as X

# --- shared oracle text -----------------------------------------------------------------

MUNI = X.MUNI.format(supplier="supplier")
CITY = X.CITY.format(customer="customer", muni="muni")
POINTS = X.POINTS.format(events="events")
IN_MUNI = """((shape IN ('plain','hole') AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
    AND NOT (shape='hole' AND x>x0+.25e0*w AND x<x0+.75e0*w AND y>y0+2e0 AND y<y0+4e0))
  OR (shape='multipart' AND ((x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y0+5e0) OR (x BETWEEN x0+.4e0*w AND x0+.6e0*w AND y BETWEEN y0+6e0 AND y0+7e0))))"""
# on or between the two diagonals, left and right of where they cross
IN_BOWTIE = """(shape='bowtie' AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND abs(y-(y0+4e0))*w <= abs(x-(x0+w/2e0))*8e0)"""
IN_STRIP = "(s_suppkey%19=6 AND shape IN ('plain','hole','multipart') AND x BETWEEN x1-.1e0*w AND x1 AND y BETWEEN y0 AND y1)"
PENDING = f"({IN_BOWTIE} OR (shape='bbox' AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) OR {IN_STRIP})"
BASE = f"WITH muni AS ({MUNI}), pts AS ({POINTS})"
FULL = f"{BASE}, city AS ({CITY})"
GRID = {
    "fed-2": "SELECT 'f2-'||i||'-'||j AS id, i, j, -132e0+4e0*i AS x0, -132e0+4e0*i+4e0 AS x1, 40e0+4e0*j AS y0, 40e0+4e0*j+4e0 AS y1 FROM range(18) a(i), range(11) b(j)",
    "fed-1": "SELECT 'f1-'||i||'-'||j AS id, i, j, -132e0+5e0*i AS x0, -132e0+5e0*i+5e0 AS x1, 40e0+5e0*j AS y0, 40e0+5e0*j+5e0 AS y1 FROM range(15) a(i), range(9) b(j)",
}


# --- helpers ------------------------------------------------------------------------------


def _muni_geometry(spark: SparkSession, d: str, *roles: str) -> DataFrame:
    g = X.municipal_geometry(X.municipalities(spark, d))
    return g.where(F.col("role").isin(*roles)) if roles else g


def _admin(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Visible areas and geometry of the administrative layer."""
    areas = X.areas(spark, d).where("layer IN ('shared', 'administrative')")
    shaped = areas.where("level IN ('municipality', 'city_area')")
    geometry = _muni_geometry(spark, d).unionByName(X.city_geometry(X.city_slices(spark, d)))
    return shaped, geometry


def _federal(spark: SparkSession, d: str, *editions: str) -> tuple[DataFrame, DataFrame]:
    areas = X.areas(spark, d).where("layer = 'federal'").where(F.col("edition").isin(*editions))
    geometry = X.federal_geometry(spark, editions[0])
    for e in editions[1:]:
        geometry = geometry.unionByName(X.federal_geometry(spark, e))
    return areas, geometry.select("area_id", "role", "rings")


def _closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(X.areas(spark, d))


# --- point queries -------------------------------------------------------------------------


def point_lookup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cells.cover(X.points(spark, d), _muni_geometry(spark, d, "assignment"), "point_id").select("point_id", "area_id")


def lookup_counts_by_area(spark: SparkSession, d: str) -> DataFrame:
    hits = point_lookup_pairs(spark, d)
    return hits.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_points"))


def lineitem_counts_by_area(spark: SparkSession, d: str) -> DataFrame:
    """The larger table as points: counts of line items per municipality."""
    li = X.table(spark, d, "lineitem").select(F.expr("-131D + ((l_orderkey * 7919 + l_linenumber * 31) % 67000) / 1000D AS x"), F.expr("41D + ((l_orderkey * 104729 + l_partkey) % 42000) / 1000D AS y"), "l_quantity")
    hits = cells.cover(li, _muni_geometry(spark, d, "assignment"), "l_quantity")
    return hits.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").cast("double").alias("quantity"))


def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = _muni_geometry(spark, d, "candidate", "review", "bbox")
    return cells.cover(X.points(spark, d), g, "point_id").select("point_id", "area_id").distinct()


def _status_row(df: DataFrame) -> DataFrame:
    return df.select("point_id", "status", F.size("matched").alias("n_matched"), F.size("direct").alias("n_direct"), F.size("pending").alias("n_pending"), F.col("n_unknown").cast("int").alias("n_unknown"), F.col("n_disagreements").cast("int").alias("n_disagreements"), "ambiguous")


def point_lookup_status(spark: SparkSession, d: str) -> DataFrame:
    areas, geometry = _admin(spark, d)
    return _status_row(lookup.lookup(X.points(spark, d), areas, geometry, _closure(spark, d)))


def federal_lookup_status(spark: SparkSession, d: str) -> DataFrame:
    areas, geometry = _federal(spark, d, "fed-2")
    return _status_row(lookup.lookup(X.points(spark, d), areas, geometry, _closure(spark, d)))


def partial_edition_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Both federal editions; the historical one is declared partial, so what it missed needs review."""
    areas, geometry = _federal(spark, d, "fed-1", "fed-2")
    found = lookup.lookup(X.points(spark, d), areas, geometry, _closure(spark, d))
    declared = X.table(spark, d, "region").where("r_regionkey = 3").select(F.lit("fed-1").alias("edition"), F.lit("partial").alias("status"))
    return lookup.escalate_partial(found, areas, declared, ["fed-1", "fed-2"]).select("point_id", "status")


def point_lookup_multilayer(spark: SparkSession, d: str) -> DataFrame:
    closure = _closure(spark, d)
    one = lookup.lookup(X.points(spark, d), *_located_cities(spark, d), closure)
    two = lookup.lookup(X.points(spark, d), *_federal(spark, d, "fed-2"), closure)
    return lookup.worst(one, two).select("point_id", "status", F.size("matched").alias("n_matched"), F.col("n_disagreements").cast("int").alias("n_disagreements"))


def _located_cities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """City areas with their municipalities' assignment geometry, where that exists."""
    areas, geometry = _admin(spark, d)
    geometry = geometry.where("role = 'assignment'")
    return areas.join(geometry.select(F.col("area_id").alias("id")).distinct(), "id", "left_semi"), geometry


def ambiguous_points(spark: SparkSession, d: str) -> DataFrame:
    """Points that two slices of one scheme share."""
    hits = cells.cover(X.points(spark, d), X.city_geometry(X.city_slices(spark, d)), "point_id")
    track = X.areas(spark, d).where("level = 'city_area'").select(F.col("id").alias("area_id"), "scheme")
    return hits.join(cells.sized(track), "area_id").groupBy("point_id", "scheme").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def parent_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """City areas that hold a point which their municipality's geometry leaves out."""
    slices = X.city_slices(spark, d)
    hits = cells.cover(X.points(spark, d), X.city_geometry(slices), "point_id", "x", "y")
    up = slices.select(F.concat(F.lit("a-"), F.col("c_custkey").cast("string")).alias("area_id"), F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("ancestor_id"))
    g = _muni_geometry(spark, d, "assignment").select(F.col("area_id").alias("ancestor_id"), G.edges("rings").alias("edges"))
    j = hits.join(cells.sized(up), "area_id").join(cells.sized(g), "ancestor_id")
    return j.where(~G.covers("edges", "x", "y")).select("point_id", "area_id", "ancestor_id")


def representative_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every municipality's representative point finds it (a metamorphic check as a query)."""
    g = _muni_geometry(spark, d, "assignment")
    p = review.representative_points(g).withColumnRenamed("area_id", "point_id")
    return cells.cover(p, g, "point_id").where("point_id = area_id").select("area_id")


# --- measures and overlays -----------------------------------------------------------------


def bbox(spark: SparkSession, d: str) -> DataFrame:
    g = _muni_geometry(spark, d, "assignment").select("area_id", *G.bbox("rings"))
    nation = X.municipalities(spark, d).select(F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("area_id"), "s_nationkey")
    return g.join(nation, "area_id").groupBy("s_nationkey").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def vertex_stats(spark: SparkSession, d: str) -> DataFrame:
    return _muni_geometry(spark, d, "assignment").select("area_id", *G.counts("rings"), F.round(G.area("rings"), 6).alias("planar_area"))


def area_km2(spark: SparkSession, d: str) -> DataFrame:
    g = _muni_geometry(spark, d, "assignment").select("area_id", G.projected("rings").alias("rings"))
    return g.select("area_id", F.round(G.area("rings") / 1e6, 2).alias("km2"))


def _cast(x: str, y: str) -> tuple[str, str]:
    return G.lcc_sql(x, y)


def _area_sql(corners: list[tuple[str, str]]) -> str:
    """Shoelace of projected corners, relative to the first so that the sum stays exact."""
    xy = [_cast(*c) for c in corners]
    terms = []
    for (ax, ay), (bx, by) in zip(xy, xy[1:] + xy[:1], strict=True):
        terms.append(f"({ax} * {by} - {bx} * {ay})")
    return f"(({' + '.join(terms)}) / 2e0)"


def _box_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    return _area_sql([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def pairwise_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities against the federal grid: what each pair shares, in square degrees."""
    m, f = _muni_geometry(spark, d, "assignment"), _federal(spark, d, "fed-2")[1]
    o = overlay.overlay_areas(cells.box_pairs(m, f), m, f)
    return o.where("intersection > 1e-9").select(F.col("a").alias("area_id"), F.col("b").alias("district_id"), F.round("intersection", 6).alias("shared"))


MUNI_BOXES = """boxes AS (SELECT 'm-'||s_suppkey AS area_id, s_nationkey, x0 AS bx0, x1 AS bx1, y0 AS by0, CASE WHEN shape='multipart' THEN y0+5e0 ELSE y1 END AS by1, 1e0 AS sgn FROM muni WHERE shape IN ('plain','hole','multipart')
 UNION ALL SELECT 'm-'||s_suppkey, s_nationkey, x0+.4e0*w, x0+.6e0*w, y0+6e0, y0+7e0, 1e0 FROM muni WHERE shape='multipart'
 UNION ALL SELECT 'm-'||s_suppkey, s_nationkey, x0+.25e0*w, x0+.75e0*w, y0+2e0, y0+4e0, -1e0 FROM muni WHERE shape='hole')"""
# the same boxes after they moved east, and what each area has in common with where it was
MOVED_BOXES = """moved AS (SELECT area_id, b.s_nationkey, bx0+.05e0*w*(s_suppkey%8) AS bx0, bx1+.05e0*w*(s_suppkey%8) AS bx1, by0, by1, sgn FROM boxes b JOIN muni ON area_id='m-'||s_suppkey),
  kept AS (SELECT area_id, any_value(s_nationkey) AS s_nationkey, sum(i) AS i, any_value(a) AS a FROM (SELECT n.area_id, n.s_nationkey, n.sgn*o.sgn*greatest(0e0, least(n.bx1,o.bx1)-greatest(n.bx0,o.bx0))*greatest(0e0, least(n.by1,o.by1)-greatest(n.by0,o.by0)) AS i FROM moved n JOIN boxes o USING(area_id))
    JOIN (SELECT area_id, sum(sgn*(bx1-bx0)*(by1-by0)) AS a FROM boxes GROUP BY 1) USING(area_id) GROUP BY area_id)"""
SHARED = "sgn*greatest(0e0, least(bx1,x1)-greatest(bx0,x0))*greatest(0e0, least(by1,y1)-greatest(by0,y0))"


def child_coverage(spark: SparkSession, d: str) -> DataFrame:
    """City slices against their municipality, by scheme."""
    city = X.city_slices(spark, d)
    kids = X.city_geometry(city).join(city.select(F.concat(F.lit("a-"), F.col("c_custkey").cast("string")).alias("area_id"), F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("parent_id"), F.col("scheme").alias("track")), "area_id")
    out = lifecycle.child_coverage(kids, _muni_geometry(spark, d, "assignment"))
    return out.select("parent_id", F.col("track").alias("scheme"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("covered", "outside", "uncovered")))


def _moved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Municipalities with an assignment, and their extents moved east by 0.05 w (s_suppkey % 8)."""
    m = X.municipalities(spark, d).where("shape IN ('plain', 'hole', 'multipart')")
    old = X.municipal_geometry(m).where("role = 'assignment'")
    new = X.municipal_geometry(m.withColumn("x0", F.expr("x0 + .05D * w * (s_suppkey % 8)")).withColumn("x1", F.expr("x1 + .05D * w * (s_suppkey % 8)"))).where("role = 'assignment'")
    return m, old, new


def extent_compare(spark: SparkSession, d: str) -> DataFrame:
    _, old, new = _moved(spark, d)
    return lifecycle.compare_extents(old, new).select("area_id", F.round("old_share", 6).alias("old_share"), F.round("new_share", 6).alias("new_share"))


def adjustment_groups(spark: SparkSession, d: str) -> DataFrame:
    m, old, new = _moved(spark, d)
    # a threshold between two steps of the shift, so that rounding decides nothing
    compared = lifecycle.compare_extents(old, new, least=0.78)
    changes = m.select(F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("area_id"), (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 3).alias("group"))
    return lifecycle.adjust_groups(changes, compared).select("area_id", "group", "sufficient", "applied")


def best_overlap_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """The federal district that holds most of each municipality."""
    m, f = _muni_geometry(spark, d, "assignment"), _federal(spark, d, "fed-2")[1]
    b = lifecycle.best_overlap(m, f, cells.box_pairs(m, f))
    return b.select("area_id", F.round("fraction", 6).alias("fraction"), F.round("runner_up", 6).alias("runner_up"), "accepted")


def dissolve_area(spark: SparkSession, d: str) -> DataFrame:
    """Regions as the union of all members that have an extent, as whole rings."""
    m = X.municipalities(spark, d).select(F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("area_id"), "s_nationkey")
    g = _muni_geometry(spark, d, "assignment").join(m, "area_id")
    out = overlay.united(g, "s_nationkey")
    parts, holes = (F.expr(f"CAST(size(filter(rings, r -> r.ring {op} 0)) AS BIGINT)") for op in ("=", ">"))
    return out.select("s_nationkey", parts.alias("n_parts"), holes.alias("n_holes"), F.round(G.area("rings"), 6).alias("area"))


def repair_ledger(spark: SparkSession, d: str) -> DataFrame:
    out = review.repair_ledger(_muni_geometry(spark, d, "candidate"))
    return out.select("area_id", F.round("repaired_area", 5).alias("repaired_area"), F.col("n_edges").cast("long").alias("n_edges"))


def display_simplify(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles with points added every half degree lose exactly those again."""
    g = _muni_geometry(spark, d, "assignment").withColumn("rings", G.densified("rings", 0.5))
    s = review.simplified(g, 1e-9)
    return s.groupBy("area_id").agg(F.sum(F.size("pts") - 1).cast("long").alias("n_vertices"))


# --- circles -------------------------------------------------------------------------------


def _circles(spark: SparkSession, d: str) -> DataFrame:
    """One circle for every event: 1 to 100 km around its point."""
    return X.points(spark, d).select(F.col("point_id").alias("circle_id"), "x", "y", F.expr("1000D * (1 + point_id % 100) AS radius_m"))


def circle_envelopes(spark: SparkSession, d: str) -> DataFrame:
    e = circle.envelopes(_circles(spark, d))
    return e.select("circle_id", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


def circle_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Circles against the municipalities that have an extent."""
    g = _muni_geometry(spark, d)
    munis = g.select("area_id").distinct()
    out = circle.discover(_circles(spark, d), munis, g, listed=False)
    return out.select("circle_id", "status", "n_matches", "n_affected", F.array_join("matches", ",").alias("matches"), "reasons")


def circle_discovery_unlocated(spark: SparkSession, d: str) -> DataFrame:
    """All municipalities, those without any extent too: every circle is incomplete."""
    g = _muni_geometry(spark, d)
    munis = X.municipalities(spark, d).select(F.concat(F.lit("m-"), F.col("s_suppkey").cast("string")).alias("area_id"))
    return circle.discover(_circles(spark, d), munis, g, listed=False).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        point_lookup_pairs, lookup_counts_by_area, lineitem_counts_by_area, review_candidates, point_lookup_status, federal_lookup_status, partial_edition_lookup, point_lookup_multilayer,
        ambiguous_points, parent_disagreements, representative_lookup, bbox, vertex_stats, area_km2, pairwise_overlap, child_coverage, extent_compare, adjustment_groups,
        best_overlap_crosswalk, dissolve_area, repair_ledger, display_simplify, circle_envelopes, circle_discovery, circle_discovery_unlocated,
    )
}

_MUNI_LEVEL = "CASE WHEN s_nationkey%6<>5 THEN 4 ELSE 3 END"  # ancestors of a city area: municipality, region or not, province, country
_DIRECT = f"""direct AS (SELECT event_id, 'm-'||s_suppkey AS area_id, s_suppkey, s_nationkey, 'municipality' AS level, '' AS track FROM pts JOIN muni ON {IN_MUNI}
  UNION ALL SELECT event_id, 'a-'||c_custkey, m.s_suppkey, m.s_nationkey, 'city_area', scheme FROM pts JOIN city c ON x BETWEEN c.x0 AND c.x1 AND y BETWEEN cy0 AND cy1 JOIN muni m ON m.s_suppkey=c.s_suppkey)"""
_UPS = """ups AS (SELECT event_id, area_id AS id FROM direct UNION SELECT event_id, 'm-'||s_suppkey FROM direct
  UNION SELECT event_id, 'g-'||s_nationkey FROM direct WHERE s_nationkey%6<>5 UNION SELECT event_id, 'p-'||n_regionkey FROM direct JOIN nation ON n_nationkey=s_nationkey UNION SELECT event_id, 'c' FROM direct)"""

_GRID_HITS = "hits AS (SELECT event_id, g.id, g.i FROM pts JOIN ({grid}) g ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"

ORACLES = {
    "point_lookup_pairs": f"{BASE} SELECT event_id AS point_id, 'm-'||s_suppkey AS area_id FROM pts JOIN muni ON {IN_MUNI}",
    "lookup_counts_by_area": f"{BASE} SELECT 'm-'||s_suppkey AS area_id, count(*) AS n_points FROM pts JOIN muni ON {IN_MUNI} GROUP BY 1",
    "lineitem_counts_by_area": f"""WITH muni AS ({MUNI}), li AS (SELECT -131e0+((l_orderkey*7919+l_linenumber*31)%67000)/1000e0 AS x, 41e0+((l_orderkey*104729+l_partkey)%42000)/1000e0 AS y, l_quantity FROM lineitem)
      SELECT 'm-'||s_suppkey AS area_id, count(*) AS n_items, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM li JOIN muni ON {IN_MUNI} GROUP BY 1""",
    # the upright sides of a bow-tie hold their points whatever the products of the diagonals round to
    "review_candidates": f"""{BASE} SELECT DISTINCT event_id AS point_id, 'm-'||s_suppkey AS area_id FROM pts JOIN muni ON {PENDING}
      OR (shape='bowtie' AND x BETWEEN x0 AND x1 AND (x=x0 OR x=x1) AND y BETWEEN y0 AND y1)""",
    "point_lookup_status": f"""{FULL}, {_DIRECT}, {_UPS},
      dis AS (SELECT d.event_id, count(*) AS n FROM direct d JOIN muni m ON m.s_suppkey=d.s_suppkey JOIN pts p ON p.event_id=d.event_id WHERE d.level='city_area' AND m.shape IN ('plain','hole','multipart') AND NOT {IN_MUNI} GROUP BY 1),
      amb AS (SELECT event_id, bool_or(n>1) AS a FROM (SELECT event_id, level, track, count(*) AS n FROM direct GROUP BY ALL) GROUP BY 1),
      pend AS (SELECT event_id, count(DISTINCT s_suppkey) AS n FROM pts JOIN muni ON {PENDING} GROUP BY 1),
      nd AS (SELECT event_id, count(*) AS n FROM direct GROUP BY 1), nm AS (SELECT event_id, count(*) AS n FROM ups GROUP BY 1), un AS (SELECT count(*) AS n FROM muni WHERE shape='unknown')
      SELECT p.event_id AS point_id, CASE WHEN coalesce(pend.n,0)>0 OR un.n>0 OR coalesce(dis.n,0)>0 THEN 'review_required' WHEN amb.a THEN 'ambiguous' WHEN nd.n>0 THEN 'matched' ELSE 'no_match' END AS status,
        CAST(coalesce(nm.n,0) AS INT) AS n_matched, CAST(coalesce(nd.n,0) AS INT) AS n_direct, CAST(coalesce(pend.n,0) AS INT) AS n_pending, CAST(un.n AS INT) AS n_unknown, CAST(coalesce(dis.n,0) AS INT) AS n_disagreements, coalesce(amb.a,false) AS ambiguous
      FROM pts p CROSS JOIN un LEFT JOIN dis USING(event_id) LEFT JOIN amb USING(event_id) LEFT JOIN pend USING(event_id) LEFT JOIN nd USING(event_id) LEFT JOIN nm USING(event_id)""",
    "federal_lookup_status": f"""WITH pts AS ({POINTS}), {_GRID_HITS.format(grid=GRID["fed-2"])}, s AS (SELECT event_id, count(*) AS n, count(DISTINCT i%5) AS np FROM hits GROUP BY 1)
      SELECT p.event_id AS point_id, CASE WHEN n>1 THEN 'ambiguous' WHEN n=1 THEN 'matched' ELSE 'no_match' END AS status, CAST(coalesce(n+np+1,0) AS INT) AS n_matched, CAST(coalesce(n,0) AS INT) AS n_direct,
        0 AS n_pending, 0 AS n_unknown, 0 AS n_disagreements, coalesce(n>1,false) AS ambiguous FROM pts p LEFT JOIN s USING(event_id)""",
    "partial_edition_lookup": f"""WITH pts AS ({POINTS}), h1 AS (SELECT event_id, count(*) AS n FROM pts JOIN ({GRID["fed-1"]}) g ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1),
      h2 AS (SELECT event_id, count(*) AS n FROM pts JOIN ({GRID["fed-2"]}) g ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1)
      SELECT p.event_id AS point_id, CASE WHEN h1.n IS NULL THEN 'review_required' WHEN h1.n>1 OR h2.n>1 THEN 'ambiguous' ELSE 'matched' END AS status FROM pts p LEFT JOIN h1 USING(event_id) LEFT JOIN h2 USING(event_id)""",
    "point_lookup_multilayer": f"""{FULL}, {_DIRECT}, {_UPS}, {_GRID_HITS.format(grid=GRID["fed-2"])},
      dis AS (SELECT d.event_id, count(*) AS n FROM direct d JOIN muni m ON m.s_suppkey=d.s_suppkey JOIN pts p ON p.event_id=d.event_id WHERE d.level='city_area' AND m.shape IN ('plain','hole','multipart') AND NOT {IN_MUNI} GROUP BY 1),
      amb AS (SELECT event_id, bool_or(n>1) AS a FROM (SELECT event_id, level, track, count(*) AS n FROM direct GROUP BY ALL) GROUP BY 1),
      s1 AS (SELECT p.event_id, CASE WHEN coalesce(dis.n,0)>0 THEN 0 WHEN amb.a THEN 1 WHEN amb.a IS NOT NULL THEN 2 ELSE 3 END AS r FROM pts p LEFT JOIN dis USING(event_id) LEFT JOIN amb USING(event_id)),
      s2 AS (SELECT p.event_id, CASE WHEN n>1 THEN 1 WHEN n=1 THEN 2 ELSE 3 END AS r FROM pts p LEFT JOIN (SELECT event_id, count(*) AS n FROM hits GROUP BY 1) USING(event_id)),
      al AS (SELECT event_id, count(*) AS n FROM (SELECT event_id, id FROM ups UNION SELECT event_id, id FROM hits UNION SELECT event_id, 'p-'||(i%5) FROM hits UNION SELECT event_id, 'c' FROM hits) GROUP BY 1)
      SELECT p.event_id AS point_id, CASE least(s1.r,s2.r) WHEN 0 THEN 'review_required' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'matched' ELSE 'no_match' END AS status, CAST(coalesce(al.n,0) AS INT) AS n_matched, CAST(coalesce(dis.n,0) AS INT) AS n_disagreements
      FROM pts p JOIN s1 USING(event_id) JOIN s2 USING(event_id) LEFT JOIN al USING(event_id) LEFT JOIN dis USING(event_id)""",
    "ambiguous_points": f"{FULL} SELECT event_id AS point_id, scheme, count(*) AS n FROM pts JOIN city ON x BETWEEN x0 AND x1 AND y BETWEEN cy0 AND cy1 GROUP BY 1,2 HAVING count(*)>1",
    "parent_disagreements": f"{FULL} SELECT event_id AS point_id, 'a-'||c_custkey AS area_id, 'm-'||m.s_suppkey AS ancestor_id FROM pts JOIN city c ON x BETWEEN c.x0 AND c.x1 AND y BETWEEN cy0 AND cy1 JOIN muni m ON m.s_suppkey=c.s_suppkey WHERE m.shape IN ('hole','multipart','plain') AND NOT {IN_MUNI.replace('x0', 'm.x0').replace('x1', 'm.x1')}",
    "representative_lookup": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id FROM muni WHERE shape IN ('plain','hole','multipart')",
    "bbox": f"WITH muni AS ({MUNI}) SELECT s_nationkey, min(x0) AS west, min(y0) AS south, max(x1) AS east, max(CASE WHEN shape='multipart' THEN y0+7e0 ELSE y1 END) AS north FROM muni WHERE shape IN ('plain','hole','multipart') GROUP BY 1",
    "vertex_stats": f"""WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, CASE WHEN shape='multipart' THEN 2 ELSE 1 END AS n_parts, CASE WHEN shape='hole' THEN 1 ELSE 0 END AS n_holes, CASE WHEN shape='plain' THEN 4 ELSE 8 END AS n_vertices,
      round(CASE shape WHEN 'plain' THEN w*8e0 WHEN 'hole' THEN w*8e0-w ELSE w*5e0+.2e0*w END, 6) AS planar_area FROM muni WHERE shape IN ('plain','hole','multipart')""",
    "area_km2": f"""WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, round(CASE shape WHEN 'plain' THEN {_box_sql("x0", "y0", "x1", "y1")}
      WHEN 'hole' THEN {_box_sql("x0", "y0", "x1", "y1")} - {_box_sql("(x0+.25e0*w)", "(y0+2e0)", "(x0+.75e0*w)", "(y0+4e0)")}
      ELSE {_box_sql("x0", "y0", "x1", "(y0+5e0)")} + {_box_sql("(x0+.4e0*w)", "(y0+6e0)", "(x0+.6e0*w)", "(y0+7e0)")} END / 1e6, 2) AS km2 FROM muni WHERE shape IN ('plain','hole','multipart')""",
    "pairwise_overlap": f"WITH muni AS ({MUNI}), {MUNI_BOXES} SELECT area_id, id AS district_id, round(sum({SHARED}), 6) AS shared FROM boxes, ({GRID['fed-2']}) g GROUP BY 1,2 HAVING sum({SHARED})>1e-9",
    "child_coverage": f"""WITH muni AS ({MUNI}), city AS ({CITY}), {MUNI_BOXES}, c AS (SELECT c_custkey, 'm-'||s_suppkey AS parent_id, scheme, x0, x1, cy0 AS y0, cy1 AS y1 FROM city),
      parent AS (SELECT area_id, sum(sgn*(bx1-bx0)*(by1-by0)) AS a FROM boxes GROUP BY 1),
      inside AS (SELECT parent_id, scheme, sum({SHARED}) AS s FROM c JOIN boxes ON area_id=parent_id GROUP BY 1,2), own AS (SELECT parent_id, scheme, sum((x1-x0)*(y1-y0)) AS o FROM c GROUP BY 1,2)
      SELECT parent_id, scheme, round(s,6)+0e0 AS covered, round(o-s,6)+0e0 AS outside, round(a-s,6)+0e0 AS uncovered FROM inside JOIN own USING(parent_id, scheme) JOIN parent ON area_id=parent_id""",
    "extent_compare": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, {MOVED_BOXES} SELECT area_id, round(i/a,6) AS old_share, round(i/a,6) AS new_share FROM kept""",
    "adjustment_groups": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, {MOVED_BOXES}, g AS (SELECT area_id, s_nationkey*10+CAST(substr(area_id,3) AS INT)%3 AS "group", i/a>=.78e0 AS sufficient FROM kept) SELECT *, bool_and(sufficient) OVER (PARTITION BY "group") AS applied FROM g""",
    "best_overlap_crosswalk": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, o AS (SELECT area_id, id, sum({SHARED}) AS s FROM boxes, ({GRID['fed-2']}) g GROUP BY 1,2 HAVING sum({SHARED})>1e-9), a AS (SELECT area_id, sum(sgn*(bx1-bx0)*(by1-by0)) AS a FROM boxes GROUP BY 1),
      r AS (SELECT area_id, s/a AS f, row_number() OVER (PARTITION BY area_id ORDER BY s DESC) AS k FROM o JOIN a USING(area_id))
      SELECT x.area_id, round(x.f,6) AS fraction, round(coalesce(y.f,0e0),6) AS runner_up, x.f>=0.9e0 AND coalesce(y.f,0e0)<=0.1e0 AS accepted FROM r x LEFT JOIN r y ON y.area_id=x.area_id AND y.k=2 WHERE x.k=1""",
    "dissolve_area": f"""WITH muni AS ({MUNI}), p AS (SELECT *, k-row_number() OVER (PARTITION BY s_nationkey ORDER BY k) AS run FROM muni WHERE shape IN ('plain','hole','multipart'))
      SELECT s_nationkey, count(DISTINCT run)+count(*) FILTER (shape='multipart') AS n_parts, count(*) FILTER (shape='hole') AS n_holes, round(sum(CASE shape WHEN 'plain' THEN w*8e0 WHEN 'hole' THEN w*7e0 ELSE w*5.2e0 END),6) AS area FROM p GROUP BY 1""",
    "repair_ledger": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, round(w*8e0/2e0,5) AS repaired_area, CAST(6 AS BIGINT) AS n_edges FROM muni WHERE shape='bowtie'",
    "display_simplify": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, CAST(CASE WHEN shape='plain' THEN 4 ELSE 8 END AS BIGINT) AS n_vertices FROM muni WHERE shape IN ('plain','hole','multipart')",
    "circle_envelopes": f"""WITH pts AS ({POINTS}), c AS (SELECT event_id, x, y, 1000e0*(1+event_id%100)/{circle._LEAST!r}*1.000001e0 AS d FROM pts), h AS (SELECT *, degrees(asin(sin(d)/cos(radians(y)))) AS h FROM c)
      SELECT event_id AS circle_id, round(x-h,6) AS west, round(degrees(radians(y)-d),6) AS south, round(x+h,6) AS east, round(degrees(radians(y)+d),6) AS north FROM h""",
    "circle_discovery_unlocated": f"WITH muni AS ({MUNI}) SELECT 'incomplete' AS status, count(*) AS n FROM events",
}
