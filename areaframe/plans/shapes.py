"""Queries about the soundness of shapes, unions of many, revision logs and proofs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators import hierarchy, lifecycle, overlay, plan_contracts, release, review, surface, validity
from areaframe.plans import lookups
from areaframe.plans.lookups import MOVED_BOXES, MUNI, MUNI_BOXES
from areaframe.plans.records import _id
from areaframe.sources import fixtures as X
from areaframe.sources.workspace import written

SHAPED = "shape IN ('plain', 'hole', 'multipart')"


def _ring(pts: list[tuple[str, str]], part: int, ring: int) -> str:
    xy = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in pts)
    return f"named_struct('part', {part}, 'ring', {ring}, 'pts', array({xy}))"


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """All municipal shapes, most of them with a fault of one kind by their number, as area_id, rings; a bow-tie stays one."""
    own = X.municipalities(spark, d).where("shape <> 'unknown' AND shape <> 'bbox'")
    g = X.municipal_geometry(own).where("role IN ('assignment', 'candidate')").select("area_id", "rings")
    m = own.withColumn("area_id", _id("m-", "s_suppkey")).join(g, "area_id")
    hole = "concat(rings, array({}))".format
    mid = "x0 + .5D * w", "y0 + 1D"
    kinds = {
        # a hole that touches its outer ring at one point is sound
        1: hole(_ring([("x0 + .1D * w", "y0"), ("x0 + .05D * w", "y0 + 1D"), ("x0 + .15D * w", "y0 + 1D"), ("x0 + .1D * w", "y0")], 0, 9)),
        2: hole(G.box_rings("x0 + .05D * w", "y0 + .5D", "x0 + .15D * w", "y0 + 1D", 9)),
        3: "concat(rings, array(named_struct('part', 9, 'ring', 0, 'pts', rings[0].pts)))",
        4: hole(G.box_rings("x0 + .2D * w", "y0 + 8.2D", "x0 + .4D * w", "y0 + 8.6D", 0, 9)),
        5: "array(" + _ring([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x1", "y1 + 1D"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")], 0, 0) + ")",
        6: "transform(rings, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', slice(r.pts, 1, 4)))",
        7: "array(" + _ring([("x0", "y0"), mid, ("x1", "y0"), ("x1", "y0 + 2D"), mid, ("x0", "y0 + 2D"), ("x0", "y0")], 0, 0) + ")",
        8: f"concat(rings, array({G.box_rings('x0 + .05D * w', 'y0 + .2D', 'x0 + .15D * w', 'y0 + .8D', 0, 8)}, {G.box_rings('x0 + .1D * w', 'y0 + .4D', 'x0 + .2D * w', 'y0 + 1D', 0, 9)}))",
    }
    kind = " ".join(f"WHEN s_suppkey % 9 = {i} THEN {rings}" for i, rings in kinds.items())
    return m.select("area_id", F.expr(f"CASE WHEN shape = 'bowtie' THEN rings {kind} ELSE rings END").alias("rings"))


def geometry_validity(spark: SparkSession, d: str) -> DataFrame:
    """The gravest fault of every municipal shape, or none."""
    g = written(_planted(spark, d), "planted")
    return g.select("area_id").join(validity.faults(g).select("area_id", "fault"), "area_id", "left")


def document_issues(spark: SparkSession, d: str) -> DataFrame:
    """Shapes as GeoJSON documents, some of them missing, empty, of another kind, with heights, or with an open ring."""
    g = _planted(spark, d).select("area_id", F.regexp_extract("area_id", r"\d+", 0).cast("int").alias("k"), G.to_geojson("rings").alias("doc"))
    doc = F.when(F.col("k") % 7 == 1, None).when(F.col("k") % 7 == 2, '{"type": "Point", "coordinates": [1, 2]}').when(F.col("k") % 7 == 3, F.regexp_replace("doc", r"(\[-?[0-9.]+,[0-9.]+)\]", "$1,7.5]"))
    doc = doc.when(F.col("k") % 7 == 4, '{"type": "MultiPolygon", "coordinates": []}').when(F.col("k") % 7 == 5, "null").otherwise(F.col("doc"))
    g = g.withColumn("doc", doc).withColumns({"issue": G.document_issue("doc"), "rings": G.from_geojson("doc")}).withColumn("shape_issue", G.issue("rings"))
    return g.select("area_id", F.when(F.col("issue").isNotNull(), F.col("issue")).otherwise(F.col("shape_issue")).alias("issue"))


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """City slices of which the odd ones lie a quarter of their height further up, and their municipalities."""
    up = "CASE WHEN c_custkey % 2 = 1 THEN .25D * (cy1 - cy0) ELSE 0D END"
    city = X.city_slices(spark, d).withColumn("_up", F.expr(up)).withColumns({"cy0": F.expr("cy0 + _up"), "cy1": F.expr("cy1 + _up")})
    kids = X.city_geometry(city).join(city.select(_id("a-", "c_custkey").alias("area_id"), _id("m-", "s_suppkey").alias("parent_id"), F.col("scheme").alias("track")), "area_id")
    return written(kids, "moved-slices"), X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'")


def union_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What overlapping children cover of parents with holes and several parts: once, more than once, not, and beyond."""
    out = lifecycle.child_coverage(*_slices(spark, d))
    return out.select("parent_id", F.col("track").alias("scheme"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("covered", "outside", "uncovered", "repeated")))


def child_union_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parents are approved only where the union of the children is the parent; an overlap does not make up for a gap."""
    out = release.child_union(lifecycle.child_coverage(*_slices(spark, d)), 1e-6)
    return out.select("parent_id", F.col("track").alias("scheme"), "approved")


def closure_walks(spark: SparkSession, d: str) -> DataFrame:
    """Chains of forty customers, of which every fourth chain is closed to a cycle: the scope of each, with limits."""
    c = X.table(spark, d, "customer").select("c_custkey", F.count(F.lit(1)).over(Window.partitionBy(F.expr("c_custkey div 40"))).alias("n"))
    start = F.col("c_custkey") % 40 == 0
    closed = start & (F.expr("c_custkey div 40") % 4 == 2) & (F.col("n") == 40)
    parent = F.when(closed, F.col("c_custkey") + 39).when(~start, F.col("c_custkey") - 1)
    areas = written(c.select(_id("x-", "c_custkey").alias("id"), F.when(parent.isNotNull(), F.concat(F.lit("x-"), parent.cast("string"))).alias("parent_id")), "chains")
    return hierarchy.scope(areas, areas.select(F.col("id").alias("root_id")), most_members=30, most_depth=20)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A revision log of all municipalities and regions: renames, retirements, boundaries, deferred boundaries, new areas, regions."""
    m = X.municipalities(spark, d).withColumn("area_id", _id("m-", "s_suppkey"))
    own = X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'").select("area_id", "rings")
    m = m.join(own, "area_id", "left")
    none, cut, strip = "CAST(NULL AS {})".format(dict(own.dtypes)["rings"]), f"array({G.box_rings('x0', 'y0', 'x1 - .1D * w', 'y1')})", f"array({G.box_rings('x1 - .1D * w', 'y0', 'x1', 'y1')})"
    note = F.expr("IF(s_suppkey % 7 = 3, NULL, 'minutes')").alias("evidence")

    def rows(where: str, id_: str, seq: int, operation: str, name: str = "CAST(NULL AS STRING)", full: str = none, review: str = none) -> DataFrame:
        return m.where(where).select(F.expr(id_).alias("id"), F.lit(seq).alias("seq"), F.lit(operation).alias("operation"), note, F.expr(name).alias("name"), F.expr(full).alias("full"), F.expr(review).alias("review"))

    log = rows("s_suppkey % 6 < 2", "area_id", 1, "metadata", name="concat('Name ', s_suppkey)")
    log = log.unionByName(rows("s_suppkey % 6 = 0", "area_id", 2, "retire"))
    log = log.unionByName(rows("s_suppkey % 5 = 2", "area_id", 3, "boundary", full=cut, review=f"IF(s_suppkey % 3 = 0, {strip}, {none})"))
    log = log.unionByName(rows("s_suppkey % 5 = 3", "area_id", 4, "deferred_boundary", name="IF(s_suppkey % 4 = 0, concat('Later ', s_suppkey), NULL)", full=f"IF(s_suppkey % 15 = 3, {cut}, rings)", review=strip))
    log = log.unionByName(rows("s_suppkey % 6 = 2", "concat('m-new-', s_suppkey)", 5, "new", name="concat('New ', s_suppkey)", full=f"array({G.box_rings('x0', 'y0', 'x1', 'y1')})"))
    n = X.table(spark, d, "nation").where("n_nationkey % 6 <> 5").withColumns({"x0": F.expr("-130D + (n_nationkey % 5) * 13D"), "y0": F.expr("42D + floor(n_nationkey / 5) * 8D")})
    regions = n.select(_id("g-", "n_nationkey").alias("id"), F.lit(6).alias("seq"), F.lit("region").alias("operation"), F.lit("minutes").alias("evidence"), F.lit(None).cast("string").alias("name"), F.expr(none).alias("full"), F.expr(f"array({G.box_rings('x0', 'y0', 'x0 + 13D', 'y0 + 8D')})").alias("review"))
    return log.unionByName(regions)


def _administrative(spark: SparkSession, d: str) -> DataFrame:
    return X.areas(spark, d).where("level IN ('municipality', 'region')")


def revision_log(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities and regions after the whole log, several revisions of one id in their order."""
    log = _log(spark, d).select("id", "seq", "operation", "name")
    return lifecycle.apply_revisions(_administrative(spark, d), log).select("id", "name", "lifecycle_status")


def revised_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Geometry rows by role after the log."""
    out = lifecycle.revise_geometry(X.municipal_geometry(X.municipalities(spark, d)), _log(spark, d))
    return out.groupBy("area_id", "role").agg(F.round(F.sum(F.abs(G.area("rings"))), 6).alias("area"))


def revision_faults(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.revision_faults(_administrative(spark, d), X.municipal_geometry(X.municipalities(spark, d)), _log(spark, d))


def revision_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reports that are right but for one province, where each counts one too many."""
    log = _log(spark, d).where("operation <> 'new'")
    areas = _administrative(spark, d)
    report = log.join(areas.select("id", "province_id"), "id").groupBy("province_id", "operation").agg((F.count(F.lit(1)) + F.when(F.col("province_id") == "p-2", 1).otherwise(0)).alias("reported"))
    return lifecycle.revision_counts(areas, log, report)


def migration_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Successors with points added on every edge, as the parts of both predecessors; every fifth lacks the second."""
    m = X.municipalities(spark, d).where(SHAPED)
    w = Window.partitionBy("s_nationkey").orderBy("k")
    pairs = m.withColumns({"nk": F.lead("k").over(w), "other": F.lead("s_suppkey").over(w)}).where("nk = k + 1").select("s_suppkey", "other")
    own = X.municipal_geometry(m).where("role = 'assignment'").select("area_id", "rings")
    rows = pairs.select(_id("s-", "s_suppkey").alias("successor_id"), "s_suppkey", F.posexplode(F.array("s_suppkey", "other")).alias("nth", "k")).withColumn("area_id", _id("m-", "k"))
    rows = written(rows.join(own, "area_id"), "predecessors")
    made = rows.where("s_suppkey % 5 <> 0 OR nth = 0").withColumn("rings", F.expr("transform(rings, r -> named_struct('part', r.part + 10 * nth, 'ring', r.ring, 'pts', r.pts))"))
    made = made.groupBy("successor_id").agg(F.flatten(F.collect_list("rings")).alias("rings")).select(F.col("successor_id").alias("area_id"), G.densified("rings", 0.7).alias("rings"))
    out = release.migration_proofs(rows.select("successor_id", "rings"), made)
    return out.select("successor_id", "proven", F.round("differs", 6).alias("differs"))


def slivers_cut(spark: SparkSession, d: str) -> DataFrame:
    """Extents that moved east, without the slivers that they took from others, as whole rings."""
    from areaframe.operators import cells

    _, old, new = lookups._moved(spark, d)
    slivers = written(release.sliver_correction(cells.box_pairs(new, old).where("a <> b"), new, old, 1e9, 0.151), "slivers")
    return release.cut_slivers(slivers, new, old).select("area_id", F.round("area", 6).alias("area"))


def repaired_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that cross themselves as whole rings by even and odd, with the fault of the repair, if any."""
    g = X.municipal_geometry(X.municipalities(spark, d)).where("role = 'candidate'")
    r = written(overlay.repaired(g.select("area_id", "rings")), "repaired")
    out = r.select("area_id", F.size("rings").cast("bigint").alias("n_rings"), F.round(G.area("rings"), 5).alias("area"))
    return out.join(validity.faults(r).select("area_id", "fault"), "area_id", "left")


def display_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Shapes simplified for display; every third has a notch with a part of its own inside, which simplifying would swallow."""
    m = X.municipalities(spark, d)
    notch = _ring([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0 + .6D * w", "y1"), ("x0 + .6D * w", "y1 - .005D"), ("x0 + .4D * w", "y1 - .005D"), ("x0 + .4D * w", "y1"), ("x0", "y1"), ("x0", "y0")], 0, 0)
    part = G.box_rings("x0 + .45D * w", "y1 - .004D", "x0 + .55D * w", "y1 - .002D", 1)
    rings = F.expr(f"IF(s_suppkey % 3 = 0, array({notch}, {part}), array({G.box_rings('x0', 'y0', 'x1', 'y1')}))")
    g = m.select(_id("m-", "s_suppkey").alias("area_id"), (F.col("s_suppkey") % 3).alias("k"), rings.alias("rings"))
    g = written(g.select("area_id", F.when(F.col("k") == 0, F.col("rings")).otherwise(G.densified("rings", 0.5)).alias("rings")), "dense")
    return review.display_shapes(g, 0.01).select("area_id", "basis", G.counts("rings")[2].cast("bigint").alias("n_vertices"))


def region_plan_faults(spark: SparkSession, d: str) -> DataFrame:
    """Nations as regions, whole or by their members, with a fault of another kind in each of some."""
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = written(s.select(_id("m-", "s_suppkey").alias("area_id"), _id("p-", "n_regionkey").alias("province_id"), F.col("s_nationkey").alias("division_id"), F.col("s_name").alias("name"), F.lit("T").alias("type"), "s_suppkey"), "municipalities")
    n = F.col("division_id")
    g = m.groupBy("division_id", "province_id").agg(F.array_sort(F.collect_list("area_id")).alias("ids"), F.array_sort(F.collect_list(F.struct(F.col("area_id").alias("id"), "name", "type"))).alias("members"))
    named = n % 2 == 0
    ids = F.array().cast("array<string>")
    plan = g.select(
        F.when(n % 11 == 3, F.concat(F.lit("x-"), n.cast("string"))).otherwise(F.concat_ws("-", "province_id", n.cast("string"))).alias("region_id"), "province_id", F.concat(F.lit("R"), n.cast("string")).alias("name"),
        F.when(n % 7 == 5, "").otherwise("region").alias("kind"), F.lit("official").alias("basis"), F.when(~named, F.array(n)).otherwise(F.array().cast("array<int>")).alias("division_ids"),
        F.when(named, F.when(n == 8, F.concat("ids", F.array(F.lit("m-none")))).when(n == 10, F.concat("ids", F.slice("ids", 1, 1))).otherwise(F.col("ids"))).otherwise(ids).alias("member_ids"),
        F.when(n % 9 == 1, F.transform("members", lambda x: F.struct(x["id"].alias("id"), F.lit("old").alias("name"), x["type"].alias("type")))).otherwise(F.col("members")).alias("members"),
        F.when(named & (n != 14), "selected_members").otherwise("whole_divisions").alias("coverage_policy"), (F.size("ids") + F.when(n == 6, 1).otherwise(0)).alias("expected_count"),
        F.sha2(F.concat(F.array_join(F.when(n == 13, F.reverse("ids")).otherwise(F.col("ids")), "\n"), F.lit("\n")), 256).alias("digest"),
    )
    return plan_contracts.region_plan_faults(written(plan, "plan"), m)


def city_plan_faults(spark: SparkSession, d: str) -> DataFrame:
    """Customers as city areas of their nation's first municipality, from two sources."""
    s = X.table(spark, d, "supplier")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    first = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s"))
    c = X.table(spark, d, "customer").join(first, "c_nationkey").withColumn("parent", _id("m-", "s"))
    code = k.cast("string")
    plan = c.select(
        F.when(k % 50 == 3, F.concat("parent", F.lit("-x"), code)).otherwise(F.concat_ws("-", "parent", code)).alias("id"), F.when(k % 70 == 9, "q").when(k % 2 == 0, "a").otherwise("b").alias("source"), code.alias("source_id"), F.col("parent").alias("parent_id"),
        F.when(k % 90 == 4, "?").otherwise(F.concat(F.lit("N"), n.cast("string"))).alias("parent_name"), F.when(k % 110 == 5, " ").otherwise(F.col("c_name")).alias("name"),
    )
    plan = written(plan.withColumn("name", F.trim("name")), "city-plan")
    counts = plan.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    parents = first.select(_id("m-", "s").alias("parent_id"), F.concat(F.lit("N"), n.cast("string")).alias("name"), "c_nationkey").join(counts, "parent_id").select("parent_id", "name", F.when(n % 6 == 1, "all").otherwise("partial").alias("coverage_policy"), (F.col("n") + F.when(n % 8 == 2, 1).otherwise(0)).alias("expected_count"))
    sources = plan.where("source <> 'q'").groupBy("source").agg(F.count(F.lit(1)).alias("expected_count")).withColumn("crs", F.when(F.col("source") == "b", "EPSG:3347").otherwise("EPSG:4326"))
    municipalities = s.select(_id("m-", "s_suppkey").alias("area_id"), F.concat(F.lit("N"), F.when(F.col("s_nationkey") % 10 == 7, 0).otherwise(F.col("s_nationkey")).cast("string")).alias("name"))
    return plan_contracts.city_plan_faults(plan, written(parents, "parents"), sources, municipalities)


def surface_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Outlines that run into a hole through one point, bow-ties and sound boxes with their repairs; some repairs move
    the boundary, some holes are filled by a neighbour, some neighbours reach into the candidate."""
    m = X.municipalities(spark, d).withColumns({"area_id": _id("m-", "s_suppkey"), "v": F.col("s_suppkey") % 6})
    box = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    hole = [("x0", "y0 + 4D"), ("x0 + .5D * w", "y0 + 5D"), ("x0 + .5D * w", "y0 + 3D")]
    one = _ring([*box, *hole, hole[0], box[0]], 0, 0)
    two = f"array({_ring([*box, hole[0], box[0]], 0, 0)}, {_ring([*hole, hole[0]], 0, 1)})"
    moved = f"array({_ring([*box, hole[0], box[0]], 0, 0)}, {_ring([hole[0], ('x0 + .5D * w', 'y0 + 5.5D'), hole[2], hole[0]], 0, 1)})"
    bow = _ring([box[0], box[2], box[1], box[3], box[0]], 0, 0)
    mid = ("x0 + .5D * w", "y0 + 4D")
    lobes = f"array({_ring([box[0], mid, box[3], box[0]], 0, 0)}, {_ring([box[1], box[2], mid, box[1]], 1, 0)})"
    plain = f"array({G.box_rings('x0', 'y0', 'x1', 'y1')})"
    original = F.expr(f"CASE v WHEN 1 THEN array({bow}) WHEN 2 THEN {plain} ELSE array({one}) END")
    candidate = F.expr(f"CASE v WHEN 1 THEN {lobes} WHEN 2 THEN {plain} WHEN 3 THEN {moved} ELSE {two} END")
    fill = f"array({_ring([hole[0], hole[2], hole[1], hole[0]], 0, 0)})"
    near = f"array({G.box_rings('x1', 'y0', 'x1 + 1D', 'y1')})"
    into = f"array({G.box_rings('x1 - .01D * w', 'y0', 'x1 + 1D', 'y1')})"
    g = written(m.select("area_id", "s_suppkey", "v", original.alias("original"), candidate.alias("candidate"), F.expr(fill).alias("fill"), F.expr(f"IF(v = 4, {into}, {near})").alias("near")), "surfaces")
    others = g.select("area_id", F.lit("near").alias("other_id"), F.col("near").alias("rings")).unionByName(g.where("v IN (0, 3, 4) OR s_suppkey % 12 = 5").select("area_id", F.lit("fill").alias("other_id"), F.col("fill").alias("rings")))
    out = surface.surface_checks(g.select("area_id", F.col("original").alias("rings")), g.select("area_id", F.col("candidate").alias("rings")), others)
    return out.select("area_id", "topology_only", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {
    f.__name__: f
    for f in (
        geometry_validity, document_issues, union_coverage, child_union_gaps, closure_walks, revision_log, revised_geometry, revision_faults, revision_counts, migration_proofs, slivers_cut, repaired_shapes,
        display_fallback, region_plan_faults, city_plan_faults, surface_approvals,
    )
}

# strips of equal cover between all heights at which a parent or a child of it begins or ends
_STRIPS = f"""WITH muni AS ({MUNI}), city AS ({X.CITY.format(customer="customer", muni="muni")}),
  kid AS (SELECT 'm-'||s_suppkey AS parent_id, scheme, cy0+u AS y0, cy1+u AS y1 FROM (SELECT *, CASE WHEN c_custkey%2=1 THEN .25e0*(cy1-cy0) ELSE 0e0 END AS u FROM city) WHERE s_suppkey IN (SELECT s_suppkey FROM muni WHERE {SHAPED})),
  piece AS (SELECT 'm-'||s_suppkey AS parent_id, w, shape, y0 FROM muni WHERE {SHAPED}), pair AS (SELECT DISTINCT parent_id, scheme FROM kid),
  cut AS (SELECT parent_id, scheme, y0 AS y FROM kid UNION SELECT parent_id, scheme, y1 FROM kid UNION SELECT parent_id, scheme, y0+h FROM pair JOIN piece USING(parent_id), (VALUES (0e0),(2e0),(4e0),(5e0),(6e0),(7e0),(8e0)) t(h)),
  strip AS (SELECT parent_id, scheme, y AS a, lead(y) OVER (PARTITION BY parent_id, scheme ORDER BY y) AS b FROM cut),
  s AS (SELECT s.parent_id, s.scheme, b-a AS h, w, (a+b)/2e0-piece.y0 AS m, shape, (SELECT count(*) FROM kid k WHERE k.parent_id=s.parent_id AND k.scheme=s.scheme AND k.y0<(a+b)/2e0 AND k.y1>(a+b)/2e0) AS n FROM strip s JOIN piece USING(parent_id) WHERE b>a),
  t AS (SELECT *, CASE WHEN m<0e0 OR m>8e0 THEN 0e0 WHEN shape='plain' THEN w WHEN shape='hole' THEN CASE WHEN m BETWEEN 2e0 AND 4e0 THEN .5e0*w ELSE w END WHEN m<5e0 THEN w WHEN m BETWEEN 6e0 AND 7e0 THEN .2e0*w ELSE 0e0 END AS pw FROM s),
  c AS (SELECT parent_id, scheme, sum(CASE WHEN n>0 THEN h*pw ELSE 0e0 END) AS covered, sum(CASE WHEN n>0 THEN h*(w-pw) ELSE 0e0 END) AS outside, sum(CASE WHEN n=0 THEN h*pw ELSE 0e0 END) AS uncovered, sum(CASE WHEN n>1 THEN h*w ELSE 0e0 END) AS repeated FROM t GROUP BY 1,2)"""

_LOGGED = f"WITH muni AS ({MUNI}), k AS (SELECT *, {SHAPED} AS shaped, s_suppkey%7=3 AS mute FROM muni)"

ORACLES = {
    "geometry_validity": f"""WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, CASE WHEN shape='bowtie' THEN 'crossing' ELSE CASE s_suppkey%9 WHEN 2 THEN 'nested_parts' WHEN 3 THEN 'overlapping_edges' WHEN 4 THEN 'hole_outside'
      WHEN 5 THEN 'overlapping_edges' WHEN 6 THEN 'open_ring' WHEN 7 THEN 'touching_itself' WHEN 8 THEN 'crossing_holes' END END AS fault FROM muni WHERE shape NOT IN ('unknown','bbox')""",
    "document_issues": f"""WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, CASE s_suppkey%7 WHEN 1 THEN 'missing' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'has_z' WHEN 4 THEN 'empty' WHEN 5 THEN 'missing'
      ELSE CASE WHEN shape<>'bowtie' AND s_suppkey%9=6 THEN 'open_ring' END END AS issue FROM muni WHERE shape NOT IN ('unknown','bbox')""",
    "union_coverage": f"{_STRIPS} SELECT parent_id, scheme, round(covered,6)+0e0 AS covered, round(outside,6)+0e0 AS outside, round(uncovered,6)+0e0 AS uncovered, round(repeated,6)+0e0 AS repeated FROM c",
    "child_union_gaps": f"{_STRIPS} SELECT parent_id, scheme, outside<=1e-6 AND uncovered<=1e-6 AS approved FROM c",
    "closure_walks": """WITH c AS (SELECT c_custkey AS k, c_custkey%40 AS i, count(*) OVER (PARTITION BY c_custkey//40) AS n, c_custkey//40%4=2 AS cyc FROM customer)
      SELECT 'x-'||k AS root_id, CASE WHEN cyc AND n=40 THEN 40 ELSE n-1-(k-min(k) OVER (PARTITION BY k//40)) END AS members, CAST(CASE WHEN cyc AND n=40 THEN 40 ELSE n-1-(k-min(k) OVER (PARTITION BY k//40)) END AS INT) AS max_depth,
        CASE WHEN cyc AND n=40 THEN 'cycle' WHEN n-1-(k-min(k) OVER (PARTITION BY k//40))>30 THEN 'too_many_members' WHEN n-1-(k-min(k) OVER (PARTITION BY k//40))>20 THEN 'too_deep' END AS fault FROM c""",
    "revision_log": """SELECT 'm-'||s_suppkey AS id, CASE WHEN s_suppkey%5=3 AND s_suppkey%4=0 THEN 'Later '||s_suppkey WHEN s_suppkey%6<2 THEN 'Name '||s_suppkey ELSE 'Municipalité '||s_suppkey END AS name, CASE WHEN s_suppkey%6=0 THEN 'superseded' ELSE 'current' END AS lifecycle_status FROM supplier
      UNION ALL SELECT 'm-new-'||s_suppkey, 'New '||s_suppkey, 'current' FROM supplier WHERE s_suppkey%6=2 UNION ALL SELECT 'g-'||n_nationkey, n_name, 'current' FROM nation WHERE n_nationkey%6<>5""",
    "revised_geometry": f"""{_LOGGED}, own AS (SELECT *, CASE shape WHEN 'plain' THEN 8e0*w WHEN 'hole' THEN 7e0*w WHEN 'multipart' THEN 5.2e0*w END AS a FROM k), r AS (
      SELECT s_suppkey, 'assignment' AS role, CASE WHEN s_suppkey%5=2 OR s_suppkey%15=3 THEN 7.2e0*w ELSE a END AS area FROM own WHERE shaped OR s_suppkey%5=2 OR s_suppkey%15=3
      UNION ALL SELECT s_suppkey, CASE WHEN shaped OR s_suppkey%5=2 OR s_suppkey%15=3 THEN 'review' ELSE 'candidate' END, .8e0*w FROM own WHERE (s_suppkey%5=2 AND s_suppkey%3=0) OR s_suppkey%5=3 OR (s_suppkey%19=6 AND shaped AND s_suppkey%5 NOT IN (2,3))
      UNION ALL SELECT s_suppkey, CASE shape WHEN 'bowtie' THEN 'candidate' ELSE 'bbox' END, CASE shape WHEN 'bowtie' THEN 0e0 ELSE 8e0*w END FROM own WHERE shape IN ('bowtie','bbox') AND s_suppkey%5 NOT IN (2,3))
      SELECT 'm-'||s_suppkey AS area_id, role, round(area,6) AS area FROM r UNION ALL SELECT 'm-new-'||s_suppkey, 'assignment', round(8e0*w,6) FROM own WHERE s_suppkey%6=2 UNION ALL SELECT 'g-'||n_nationkey, 'candidate', 104e0 FROM nation WHERE n_nationkey%6<>5""",
    "revision_faults": f"""{_LOGGED} SELECT 'm-'||s_suppkey AS id, 1 AS seq, 'evidence' AS fault FROM k WHERE s_suppkey%6<2 AND mute UNION ALL SELECT 'm-'||s_suppkey, 2, 'evidence' FROM k WHERE s_suppkey%6=0 AND mute
      UNION ALL SELECT 'm-'||s_suppkey, 3, unnest(list_filter([CASE WHEN mute THEN 'evidence' END, CASE WHEN NOT shaped THEN 'not_approved' END, CASE WHEN NOT shaped AND s_suppkey%3<>0 THEN 'candidate' END], lambda x: x IS NOT NULL)) FROM k WHERE s_suppkey%5=2
      UNION ALL SELECT 'm-'||s_suppkey, 4, unnest(list_filter([CASE WHEN mute THEN 'evidence' END, CASE WHEN NOT shaped AND s_suppkey%15=3 THEN 'not_approved' END, CASE WHEN s_suppkey%15=3 THEN 'same_boundary' END], lambda x: x IS NOT NULL)) FROM k WHERE s_suppkey%5=3
      UNION ALL SELECT 'm-new-'||s_suppkey, 5, 'evidence' FROM k WHERE s_suppkey%6=2 AND mute""",
    "revision_counts": """WITH o AS (SELECT s_suppkey AS k, unnest(list_filter([CASE WHEN s_suppkey%6<2 THEN 'metadata' END, CASE WHEN s_suppkey%6=0 THEN 'retire' END, CASE WHEN s_suppkey%5=2 THEN 'boundary' END, CASE WHEN s_suppkey%5=3 THEN 'deferred_boundary' END], lambda x: x IS NOT NULL)) AS operation FROM supplier JOIN nation ON n_nationkey=s_nationkey WHERE n_regionkey=2),
      n AS (SELECT operation, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'region', count(*) FROM nation WHERE n_regionkey=2 AND n_nationkey%6<>5) SELECT 'p-2' AS province_id, operation, n, n+1 AS reported FROM n WHERE n>0""",
    "migration_proofs": f"""WITH muni AS ({MUNI}), p AS (SELECT s_suppkey, k, lead(k) OVER o AS nk, lead(CASE shape WHEN 'plain' THEN 8e0*w WHEN 'hole' THEN 7e0*w ELSE 5.2e0*w END) OVER o AS oa FROM muni WHERE {SHAPED} WINDOW o AS (PARTITION BY s_nationkey ORDER BY k))
      SELECT 's-'||s_suppkey AS successor_id, s_suppkey%5<>0 AS proven, CASE WHEN s_suppkey%5<>0 THEN 0e0 ELSE round(oa,6) END AS differs FROM p WHERE nk=k+1""",
    "slivers_cut": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, {MOVED_BOXES}, p AS (SELECT n.area_id AS a, o.area_id AS b, sum(n.sgn*o.sgn*greatest(0e0, least(n.bx1,o.bx1)-greatest(n.bx0,o.bx0))*greatest(0e0, least(n.by1,o.by1)-greatest(n.by0,o.by0))) AS v FROM moved n JOIN boxes o ON n.area_id<>o.area_id GROUP BY 1,2)
      SELECT p.a AS area_id, round(any_value(kept.a)-sum(v),6) AS area FROM p JOIN kept ON kept.area_id=p.a WHERE v>1e-9 GROUP BY 1 HAVING bool_and(v<=.151e0*kept.a)""",
    "repaired_shapes": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, CAST(2 AS BIGINT) AS n_rings, round(w*8e0/2e0,5) AS area, CAST(NULL AS VARCHAR) AS fault FROM muni WHERE shape='bowtie'",
    # a box loses its other corners where they are within the tolerance of its diagonal; a ring that would collapse stays whole
    "display_fallback": f"""WITH muni AS ({MUNI}), t AS (SELECT s_suppkey, s_suppkey%3=0 AS notched, 8e0*w/sqrt(w*w+64e0)>.01e0 AS wide FROM muni)
      SELECT 'm-'||s_suppkey AS area_id, CASE WHEN notched AND wide THEN 'full' ELSE 'simplified' END AS basis, CAST(CASE WHEN notched THEN 12 WHEN wide THEN 4 ELSE 34 END AS BIGINT) AS n_vertices FROM t""",
    "region_plan_faults": """WITH n AS (SELECT DISTINCT n_nationkey AS n, n_regionkey AS p FROM nation JOIN supplier ON s_nationkey=n_nationkey), c AS (SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1)
      SELECT CASE WHEN n%11=3 THEN 'x-'||n ELSE 'p-'||p||'-'||n END AS region_id, unnest(list_filter([CASE WHEN n%11=3 THEN 'identity' END, CASE WHEN n%7=5 THEN 'labels' END, CASE WHEN n=10 THEN 'selected_once' END, CASE WHEN n=8 THEN 'known' END, CASE WHEN n%9=1 THEN 'attributes' END,
        CASE WHEN n=14 THEN 'coverage' END, CASE WHEN n=6 THEN 'count' END, CASE WHEN n=13 AND c>1 THEN 'digest' END], lambda x: x IS NOT NULL)) AS fault FROM n JOIN c USING(n)""",
    "city_plan_faults": """WITH f AS (SELECT s_nationkey AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1), c AS (SELECT c_custkey AS k, n, s FROM customer JOIN f ON n=c_nationkey), p AS (SELECT DISTINCT n, s FROM c)
      SELECT 'area' AS "of", 'm-'||s||'-'||CASE WHEN k%50=3 THEN 'x' ELSE '' END||k AS id, unnest(list_filter([CASE WHEN k%70=9 THEN 'source' END, CASE WHEN k%90=4 THEN 'parent' END, CASE WHEN k%50=3 THEN 'identity' END, CASE WHEN k%110=5 THEN 'name' END], lambda x: x IS NOT NULL)) AS fault FROM c
      UNION ALL SELECT 'parent', 'm-'||s, unnest(list_filter([CASE WHEN n%10=7 THEN 'name' END, CASE WHEN n%6=1 THEN 'policy' END, CASE WHEN n%8=2 THEN 'count' END], lambda x: x IS NOT NULL)) FROM p UNION ALL SELECT 'source', 'b', 'crs' WHERE EXISTS (SELECT 1 FROM c WHERE k%70<>9 AND k%2=1)""",
    "surface_approvals": """WITH s AS (SELECT s_suppkey AS k, s_suppkey%6 AS v FROM supplier) SELECT 'm-'||k AS area_id, v=0 OR k%12=5 AS topology_only,
      CASE v WHEN 0 THEN '' WHEN 1 THEN 'area_roundoff_only' WHEN 2 THEN 'invalid_source' WHEN 3 THEN 'boundary_unchanged,even_odd_agrees,area_roundoff_only,exclusions_corroborated' WHEN 4 THEN 'neighbour_overlap_bounded' ELSE CASE WHEN k%12=5 THEN '' ELSE 'exclusions_corroborated' END END AS reasons FROM s""",
}
