"""Conformance of editions, layers, repairs and bundles: escalation, qualification and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.operators.cells import box_pairs, sized
from areaframe.operators.overlay import boundary, overlay_areas
from areaframe.sources.workspace import written

# Thresholds of a city layer and of sibling overlap.
OUTSIDE_REJECT, OUTSIDE_REVIEW, LEAST_COVERED = 0.10, 0.01, 0.90
SIBLING_AREA, SIBLING_SHARE = 1.0, 1e-6


def escalate_municipal(result: DataFrame, located: DataFrame, coverage: DataFrame, explicit: bool) -> DataFrame:
    """Municipal lookups (point_id, status) against the coverage of the municipality that holds the point.

    ``located`` (point_id, area_id) are the municipalities by point, ``coverage`` (area_id,
    status). Review is required where coverage is unverified, unavailable, partial or
    historical only, where it is a reference and no edition was chosen, and where no
    municipality is located and none was chosen.
    """
    bad = F.col("cover").isin("unverified", "unavailable", "partial", "historical_only") | ((F.col("cover") == "reference") & F.lit(not explicit)) | F.col("cover").isNull()
    c = located.join(sized(coverage.select("area_id", F.col("status").alias("cover"))), "area_id", "left").groupBy("point_id").agg(F.bool_or(bad).alias("bad"))
    out = result.join(c, "point_id", "left")
    raised = F.coalesce("bad", F.lit(not explicit))
    return out.withColumn("status", F.when(raised, "review_required").otherwise(F.col("status"))).drop("bad")


def edition_overlaps(districts: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of districts (area_id, rings) that share more than ``least``: of one edition, or of
    the same ``by`` where several are given."""
    pairs = box_pairs(districts, districts, least=least).where("a < b")
    if by:
        of = lambda k: districts.select(F.col("area_id").alias(k), F.col(by).alias(f"_{k}")).hint("merge")
        pairs = written(pairs.join(of("a"), "a").join(of("b"), "b").where("_a = _b").select("a", "b"), "edition-pairs")
    return overlay_areas(pairs, districts, districts).where(F.col("intersection") > least).select("a", "b", "intersection")


def current_overlaps(candidates: DataFrame, assigned: DataFrame, least: float = 0.0) -> DataFrame:
    """Candidates against current assignments of the same level, layer, scheme and edition (``track``)."""
    pairs = box_pairs(candidates, assigned)
    t = lambda df, k: df.select(F.col("area_id").alias(k), F.col("track").alias(f"t{k}"))
    pairs = pairs.join(t(candidates, "a"), "a").join(t(assigned, "b"), "b").where("ta = tb AND a <> b").select("a", "b")
    return overlay_areas(pairs, candidates, assigned).where(F.col("intersection") > least).select("a", "b", "intersection", "outside_a")


def qualify_layer(measures: DataFrame) -> DataFrame:
    """Status of the members of a city layer (area_id, area, outside, overlap, covered_share).

    Over 10 % outside the parent is rejected, over 1 % needs review of the parent; an
    overlap of siblings beyond max(1, 1e-6 of the area) needs review; a layer that covers
    under 90 % of its parent stays a reference.
    """
    share = F.round(F.try_divide("outside", "area"), 9)  # so that rounding decides no tie
    status = (
        F.when(share.isNull() | (share > OUTSIDE_REJECT), "rejected")
        .when(share > OUTSIDE_REVIEW, "unreviewed_parent")
        .when(F.col("overlap") > F.greatest(F.lit(SIBLING_AREA), SIBLING_SHARE * F.col("area")), "unreviewed_overlap")
        .when(F.col("covered_share") < LEAST_COVERED, "display_reference")
        .otherwise("validated_source")
    )
    return measures.select("area_id", F.round(share, 6).alias("outside_share"), status.alias("status"))


def stable_core(full: DataFrame, disputes: DataFrame) -> DataFrame:
    """What no dispute touches: boundary fragments of full minus dispute, one dispute an area: a, px, py, qx, qy."""
    pairs = disputes.select(F.col("area_id").alias("a"), F.col("area_id").alias("b"))
    return boundary(pairs, full, disputes, "difference")


def same_boundary(left: DataFrame, right: DataFrame) -> DataFrame:
    """area_id, same: whether two versions have the same undirected edges, as often."""

    def undirected(df: DataFrame, side: int) -> DataFrame:
        e = df.select("area_id", F.explode(G.edges("rings")).alias("e")).select("area_id", F.array_sort(F.array(F.struct("e.ax", "e.ay"), F.struct(F.col("e.bx").alias("ax"), F.col("e.by").alias("ay")))).alias("edge"))
        return e.withColumn("side", F.lit(side))

    both = undirected(left, 1).unionByName(undirected(right, -1))
    net = both.groupBy("area_id", "edge").agg(F.sum("side").alias("net"))
    return net.groupBy("area_id").agg(F.bool_and(F.col("net") == 0).alias("same"))


def holes_matched(shapes: DataFrame, components: DataFrame) -> DataFrame:
    """area_id, part, ring, matched: holes whose outline is that of a whole component (rings) elsewhere: the same
    vertices in the same order, wherever a ring begins and whichever way it runs."""
    one = lambda r: F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), r["pts"].alias("pts")))
    hole = shapes.select("area_id", F.explode(F.expr("filter(rings, r -> r.ring > 0)")).alias("r"))
    hole = hole.select("area_id", F.col("r.part").alias("part"), F.col("r.ring").alias("ring"), one(F.col("r")).alias("rings")).withColumn("rings", G.oriented("rings"))
    whole = components.select(F.explode(F.expr("filter(rings, r -> r.ring = 0)")).alias("r")).select(one(F.col("r")).alias("rings")).withColumn("rings", G.oriented("rings"))
    known = whole.select(G.fingerprint("rings").alias("k")).distinct().withColumn("matched", F.lit(True))
    return hole.withColumn("k", G.fingerprint("rings")).join(known.hint("merge"), "k", "left").select("area_id", "part", "ring", F.coalesce("matched", F.lit(False)).alias("matched"))


def corridor_distance(changed: DataFrame, reference: DataFrame, size: float) -> DataFrame:
    """area_id, distance: how far the vertices of a changed line lie from the nearest reference edge.

    Points meet edges in cells of ``size`` or the ones beside them; a vertex without an edge
    in reach counts as infinitely far. Coordinates are planar.
    """
    p = changed.select("area_id", F.explode(F.expr(G.points("rings"))).alias("p")).select("area_id", "p.x", "p.y").distinct()
    p = p.withColumn("pid", F.monotonically_increasing_id()).withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    e = reference.select("area_id", F.explode(G.edges("rings")).alias("e")).select("area_id", "e.ax", "e.ay", "e.bx", "e.by")
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size) - 1, F.floor(F.greatest(a, b) / size) + 1)
    e = e.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    j = p.join(e, ["area_id", "cx", "cy"], "left")
    t = F.expr("least(1D, greatest(0D, coalesce(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0D), 0D)))")
    j = j.withColumn("t", t).withColumn("d", F.hypot(F.expr("x - ax - t * (bx - ax)"), F.expr("y - ay - t * (by - ay)")))
    near = j.groupBy("area_id", "pid").agg(F.coalesce(F.min("d"), F.lit(float("inf"))).alias("d"))
    return near.groupBy("area_id").agg(F.max("d").alias("distance"))


def envelope_faults(geometry: DataFrame, envelopes: DataFrame) -> DataFrame:
    """area_id, n: vertices of a geometry outside its stored envelope (west, south, east, north)."""
    p = geometry.select("area_id", F.explode(F.expr(G.points("rings"))).alias("p"))
    j = p.join(envelopes, "area_id").where("p.x < west OR p.x > east OR p.y < south OR p.y > north")
    return j.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))


def repair_envelope(ledger: DataFrame) -> DataFrame:
    """Adds usable: whether the box of a repair may stand for the area (no vertex lost, one part kept)."""
    ok = (F.col("lost_vertices") == 0) & (F.col("n_parts") == 1) & F.col("west").isNotNull()
    return ledger.withColumn("usable", F.coalesce(ok, F.lit(False)))


def artefacts(documents: DataFrame) -> DataFrame:
    """Content-addressed documents (bundle_id, body): sha256, bytes, the bundles that share it."""
    d = documents.withColumn("sha256", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    return d.groupBy("sha256", "bytes").agg(F.array_sort(F.collect_set("bundle_id")).alias("bundles"))


def bundle_documents(members: DataFrame, geometry: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Geometry document of each bundle (bundle_id, area_id): body, vertices, box and a status when it is too large."""
    f = members.join(geometry, "area_id").select("bundle_id", "area_id", G.to_geojson("rings").alias("g"), *G.bbox("rings"), G.counts("rings")[2])
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("area_id", "g"))), lambda x: x["g"]), ","), F.lit("]"))
    d = f.groupBy("bundle_id").agg(body.alias("body"), F.sum("n_vertices").alias("n_vertices"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    return d.withColumn("status", F.when(F.octet_length("body") > limit_bytes, "too_large").otherwise("ready"))


def bundle_faults(bundle: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bundle_id, id, parent_id) that are neither a scope root nor below another member."""
    inner = bundle.select("bundle_id", F.col("id").alias("parent_id")).withColumn("has", F.lit(True))
    r = roots.select("bundle_id", F.col("root_id").alias("id")).withColumn("root", F.lit(True))
    j = bundle.join(inner, ["bundle_id", "parent_id"], "left").join(r, ["bundle_id", "id"], "left")
    return j.where("has IS NULL AND root IS NULL").select("bundle_id", "id", F.lit("detached").alias("fault"))


def pending_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Source rows to be mapped to catalogue ids: only of sources with a pending repair; the id by family."""
    wanted = sources.where("pending").select("table", "source", "prefix")
    return rows.join(wanted, ["table", "source"]).withColumn("area_id", F.coalesce(F.col("area_code"), F.concat("prefix", "code"))).select("table", "source", "area_id")
