"""Display bundles of any size: documents in parts, chained digests, and their verification by recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators.hierarchy import ancestors
from areaframe.sources.workspace import written

#: Ranges of hashes within which the members of a bundle are summed first.
RANGES = 256


def features(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """bundle_id, area_id, body, bytes, vertices and box of every member with a display geometry."""
    f = members.join(geometry.hint("merge"), "area_id").select("bundle_id", "area_id", "rings")
    body = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct("area_id")), F.lit(',"geometry":'), G.to_geojson("rings"), F.lit("}"))
    return f.select("bundle_id", "area_id", body.alias("body"), F.octet_length(body).cast("bigint").alias("bytes"), G.counts("rings")[2].cast("bigint").alias("vertices"), *G.bbox("rings"))


def placed(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Feature rows with the part of their bundle's document that they belong to.

    Members are ordered by a hash of their id. Sums are taken within ranges of that hash first, then over
    the RANGES ranges of a bundle, so no task orders a whole bundle. A part begins anew with
    each multiple of ``limit_bytes``; it exceeds that by one feature at most.
    """
    h = rows.withColumn("_h", F.xxhash64("area_id")).withColumn("_r", F.shiftrightunsigned("_h", 56))
    each = h.groupBy("bundle_id", "_r").agg(F.sum("bytes").alias("_sum"))
    before = Window.partitionBy("bundle_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    each = written(each.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"), "bundle-ranges")
    inside = Window.partitionBy("bundle_id", "_r").orderBy("_h", "area_id").rowsBetween(Window.unboundedPreceding, -1)
    out = h.withColumn("_own", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(each.hint("merge"), ["bundle_id", "_r"])
    return out.withColumn("part", F.expr(f"(_start + _own) div {limit_bytes}")).drop("_r", "_start", "_own")


def parts(members: DataFrame, geometry: DataFrame, limit_bytes: int = 4 << 20) -> DataFrame:
    """bundle_id, part, body, sha256, bytes, features, vertices and box of the parts of every bundle's document."""
    rows = placed(features(members, geometry), limit_bytes)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_h", "area_id", "body"))), lambda x: x["body"])
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}"))
    d = rows.groupBy("bundle_id", "part").agg(body.alias("body"), F.count(F.lit(1)).alias("features"), F.sum("vertices").alias("vertices"), *(f(c).alias(c) for f, c in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))))
    return d.withColumns({"sha256": F.sha2("body", 256), "bytes": F.octet_length("body").cast("bigint")})


def descriptors(members: DataFrame, parts_: DataFrame) -> DataFrame:
    """bundle_id, areas, available, coverage, status, vertices, box, sha256: what a bundle states about itself.

    Its digest is that of its parts' digests in order, one a line.
    """
    chain = F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: x["sha256"]), "\n"), F.lit("\n")), 256)
    g = parts_.groupBy("bundle_id").agg(chain.alias("sha256"), F.sum("features").alias("available"), F.sum("vertices").alias("vertices"), F.sum("bytes").alias("bytes"), *(f(c).alias(c) for f, c in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))))
    j = members.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("areas")).join(g.hint("merge"), "bundle_id", "left").na.fill(0, ["available", "vertices", "bytes"])
    coverage = F.when(F.col("available") == 0, "none").when(F.col("available") == F.col("areas"), "complete").otherwise("partial")
    return j.withColumns({"coverage": coverage, "status": F.when(F.col("available") == 0, "unavailable").otherwise("ready")})


def verification(stated: DataFrame, stored: DataFrame, stored_members: DataFrame, members: DataFrame, geometry: DataFrame, limit_bytes: int = 4 << 20) -> DataFrame:
    """bundle_id, fault: published bundles against the catalogue they were made from.

    ``stated`` are descriptors, ``stored`` the parts, ``stored_members`` the listed members. Everything is made
    again from ``members`` and ``geometry``: another list of members, other contents of a part, a part
    whose bytes do not have their digest, other boxes, counts or chained digests are each a fault.
    """
    now = written(parts(members, geometry, limit_bytes), "bundle-parts")
    faults = []
    for a, b, name in ((stored_members, members, "unexpected_member"), (members, stored_members, "missing_member")):
        rows = a.select("bundle_id", "area_id").exceptAll(b.select("bundle_id", "area_id"))
        faults.append(rows.select("bundle_id", F.lit(name).alias("fault")))
    p = stored.select("bundle_id", "part", "sha256", F.sha2("body", 256).alias("own")).join(now.select("bundle_id", "part", F.col("sha256").alias("want")).hint("merge"), ["bundle_id", "part"], "full")
    bad = F.when(F.col("sha256").isNull(), "missing_part").when(F.col("want").isNull(), "unexpected_part").when(F.col("own") != F.col("sha256"), "altered_bytes").when(F.col("sha256") != F.col("want"), "stale_part")
    faults.append(p.select("bundle_id", bad.alias("fault")).where("fault IS NOT NULL"))
    columns = ["areas", "available", "vertices", "coverage", "status", "sha256", "west", "south", "east", "north"]
    j = stated.select("bundle_id", F.struct(*columns).alias("s")).join(descriptors(members, now).select("bundle_id", F.struct(*columns).alias("n")).hint("merge"), "bundle_id", "full")
    different = lambda *c: ~F.struct(*(F.col(f"s.{x}") for x in c)).eqNullSafe(F.struct(*(F.col(f"n.{x}") for x in c)))
    names = F.array(
        F.when(F.col("s").isNull(), F.lit("missing_bundle")).when(F.col("n").isNull(), F.lit("unexpected_bundle")),
        F.when(F.col("s").isNotNull() & F.col("n").isNotNull() & different("west", "south", "east", "north"), F.lit("box")),
        F.when(F.col("s").isNotNull() & F.col("n").isNotNull() & different("areas", "available", "vertices", "coverage", "status"), F.lit("counts")),
        F.when(F.col("s").isNotNull() & F.col("n").isNotNull() & different("sha256"), F.lit("digest")),
    )
    faults.append(j.select("bundle_id", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("fault")))
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.distinct()


def consumer_faults(bundle: DataFrame, roots: DataFrame, stated: DataFrame, stored: DataFrame, sources: DataFrame) -> DataFrame:
    """bundle_id, fault: what a consumer can check of bundles without the catalogue.

    ``bundle`` are the listed areas (bundle_id, id, parent_id, available, source_ids), ``roots`` the scope roots
    (bundle_id, root_id), ``sources`` the listed sources (bundle_id, source_id). Roots are listed and lie
    below no other member; every other member reaches a root; no id is listed twice and no source is unknown;
    counts, boxes and digests are those of the parts.
    """
    ids = bundle.select("bundle_id", "id", "parent_id")
    key = lambda c: F.concat_ws("\u0001", "bundle_id", c)
    inner = ids.select(key("id").alias("id"), F.when(F.col("parent_id").isNotNull(), key("parent_id")).alias("parent_id"), "bundle_id")
    listed = inner.select("bundle_id", "id").distinct()
    tree = written(inner.join(listed.select(F.col("id").alias("parent_id"), F.lit(True).alias("_in")).hint("merge"), "parent_id", "left").select("id", F.when(F.col("_in"), F.col("parent_id")).alias("parent_id"), "bundle_id"), "bundle-tree")
    above = ancestors(tree)
    root = roots.select("bundle_id", key("root_id").alias("id"))
    unlisted = root.join(listed.select("id").hint("merge"), "id", "left_anti").select("bundle_id", F.lit("root_not_listed").alias("fault"))
    nested = root.join(tree.where("parent_id IS NOT NULL").select("id").hint("merge"), "id", "left_semi").select("bundle_id", F.lit("root_below_member").alias("fault"))
    reached = above.join(root.select(F.col("id").alias("ancestor_id")).hint("merge"), "ancestor_id", "left_semi").select("id").unionByName(root.select("id")).distinct()
    loose = listed.join(reached.hint("merge"), "id", "left_anti").select("bundle_id", F.lit("detached_member").alias("fault"))
    twice = ids.groupBy("bundle_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bundle_id", F.lit("repeated_id").alias("fault"))
    used = bundle.select("bundle_id", F.explode("source_ids").alias("source_id")).distinct()
    unknown = used.join(sources.select("bundle_id", "source_id").distinct().hint("merge"), ["bundle_id", "source_id"], "left_anti").select("bundle_id", F.lit("unknown_source").alias("fault"))
    counted = bundle.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("areas"), F.count_if("available").alias("available"))
    held = descriptors(bundle.select("bundle_id", F.col("id").alias("area_id")), stored.withColumn("sha256", F.sha2("body", 256)))
    j = stated.alias("s").join(counted.alias("c").hint("merge"), "bundle_id", "left").join(held.alias("h").hint("merge"), "bundle_id", "left")
    same = lambda a, b, *c: F.struct(*(F.col(f"{a}.{x}") for x in c)).eqNullSafe(F.struct(*(F.col(f"{b}.{x}") for x in c)))
    names = F.array(
        F.when(~same("s", "c", "areas", "available") | ~same("s", "h", "available", "vertices", "coverage"), F.lit("counts")),
        F.when(~same("s", "h", "west", "south", "east", "north"), F.lit("box")),
        F.when(~same("s", "h", "sha256"), F.lit("digest")),
    )
    stats = j.select("bundle_id", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("fault"))
    out = unlisted
    for f in (nested, loose, twice, unknown, stats):
        out = out.unionByName(f)
    return out.distinct()
