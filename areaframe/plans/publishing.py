"""Queries about imports, published versions, bundles, streams of whole answers and circle rules, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators import bundles, circle, hierarchy, imports, overlay
from areaframe.plans import lookups
from areaframe.plans.lookups import CITY, IN_STRIP, MUNI
from areaframe.plans.records import _id, _stream_points
from areaframe.sources import fixtures as X
from areaframe.sources import published
from areaframe.sources.workspace import shared_path, written
from areaframe.streaming import answers

SHAPED = "shape IN ('plain', 'hole', 'multipart')"

# --- imports ---------------------------------------------------------------------------------


def _wards(spark: SparkSession, d: str) -> DataFrame:
    """City slices as features of one source for each municipality. In every fourth municipality the even and the odd
    slices of a scheme are one ward each; elsewhere a few wards cross themselves or have an open ring."""
    w = Window.partitionBy("s_suppkey", "scheme").orderBy("c_custkey")
    c = X.city_slices(spark, d).withColumn("j", F.row_number().over(w) - 1).withColumn("four", F.col("s_suppkey") % 4 == 0)
    pts = lambda *xy: "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in xy) + ")"
    cross = pts(("x0", "cy0"), ("x1", "cy1"), ("x1", "cy0"), ("x0", "cy1"), ("x0", "cy0"))
    open_ = pts(("x0", "cy0"), ("x1", "cy0"), ("x1", "cy1"), ("x0", "cy1"))
    one = f"array(named_struct('part', 0, 'ring', 0, 'pts', CASE WHEN NOT four AND c_custkey % 23 = 5 THEN {cross} WHEN NOT four AND c_custkey % 23 = 6 THEN {open_} END))"
    rings = F.expr(f"IF(four OR c_custkey % 23 NOT IN (5, 6), array({G.box_rings('x0', 'cy0', 'x1', 'cy1')}), {one})")
    code = F.when(F.col("four"), F.concat(F.lit("p"), (F.col("j") % 2).cast("string"))).otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return c.select(_id("w-", "s_suppkey").alias("source"), F.col("c_custkey").alias("row_id"), code.alias("code"), F.concat(F.lit("Ward "), code).alias("name"), F.create_map(F.lit("scheme"), F.col("scheme")).alias("props"), rings.alias("rings"), "s_suppkey", "scheme")


def _editions(spark: SparkSession, d: str, wards: DataFrame) -> DataFrame:
    """One edition for each municipality and scheme; every seventh expects one district more."""
    e = wards.groupBy("s_suppkey", "scheme").agg(F.count_distinct("code").alias("n"))
    expected = F.col("n") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(0)
    return e.select(
        F.concat_ws("-", F.lit("e"), "s_suppkey", "scheme").alias("id"), _id("m-", "s_suppkey").alias("authority_id"), "scheme", F.lit(True).alias("default"), _id("w-", "s_suppkey").alias("source"),
        F.lit("2024-06-01").alias("effective_date"), expected.alias("expected_count"), "s_suppkey",
    )


def _old_editions(spark: SparkSession, d: str) -> DataFrame:
    s = X.table(spark, d, "supplier").where("s_suppkey % 3 = 0")
    return s.select(_id("o-", "s_suppkey").alias("id"), _id("m-", "s_suppkey").alias("authority_id"), F.when(F.col("s_suppkey") % 2 == 0, "default").otherwise("other").alias("scheme"), F.lit(True).alias("default"))


def _imported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wards = written(_wards(spark, d), "wards")
    editions = written(_editions(spark, d, wards), "editions")
    rules = editions.select(F.col("id").alias("edition"), F.lit("scheme").alias("field"), F.array("scheme").alias("values"))
    rows = imports.district_rows(wards.drop("s_suppkey", "scheme"), editions, rules)
    areas, geometry = imports.districts(rows, editions)
    return written(areas, "district-areas"), written(geometry, "district-geometry"), editions


def municipal_import(spark: SparkSession, d: str) -> DataFrame:
    """Every district of the new editions with what is wrong with its shape, and its geometry rows."""
    areas, geometry, _ = _imported(spark, d)
    g = geometry.groupBy(F.col("area_id").alias("id")).agg(F.first("role").alias("role"), F.round(F.sum(G.area("rings")), 6).alias("area"))
    return areas.join(g.hint("merge"), "id", "left").select("id", "edition", "authority_id", "issue", "assignment_status", "role", "area")


def municipal_import_checks(spark: SparkSession, d: str) -> DataFrame:
    areas, geometry, editions = _imported(spark, d)
    return imports.edition_checks(areas, geometry, editions, 1e-6).select("edition", "n", "n_unavailable", "n_overlaps", "count_agrees")


def municipal_import_faults(spark: SparkSession, d: str) -> DataFrame:
    """A plan with editions that exist, of unknown authorities, without a source, with a bad date, and two defaults."""
    wards = _wards(spark, d)
    k = F.col("s_suppkey")
    e = _editions(spark, d, wards).withColumn("authority_id", F.when(k % 11 == 2, "m-x").otherwise(F.col("authority_id"))).withColumn("source", F.when(k % 13 == 3, "w-x").otherwise(F.col("source")))
    e = e.withColumns({"effective_date": F.when(k % 17 == 4, "2024-13-01").when(k % 5 == 0, None).otherwise(F.col("effective_date")), "scheme": F.when(k % 19 == 5, "default").otherwise(F.col("scheme"))})
    old = e.where(k % 10 == 1).select("id")
    sources = wards.groupBy("source").agg(F.count(F.lit(1)).alias("n_features"))
    return imports.edition_faults(e, old, X.areas(spark, d).where("level = 'municipality'"), sources)


def edition_merge(spark: SparkSession, d: str) -> DataFrame:
    """Which editions are the default after the import."""
    new = _editions(spark, d, _wards(spark, d))
    return imports.merged_editions(_old_editions(spark, d), new).select("id", "default")


def published_import(spark: SparkSession, d: str) -> DataFrame:
    """Versions of the table of editions: the old ones, the import, and a second import of the same that is refused."""
    root = shared_path(spark, "editions")
    new = written(_editions(spark, d, _wards(spark, d)), "editions")
    published.publish(_old_editions(spark, d), root, "before")
    refused = 0
    for label in ("import", "again"):
        now, version = published.current(spark, root)
        faults = new.select("id").intersect(now.select("id"))
        try:
            published.publish(imports.merged_editions(now, new), root, label, version, faults)
        except published.Refused as e:
            refused = len(e.faults)
    v = published.versions(spark, root).groupBy("version", "label").agg(F.sum("rows").alias("rows"))
    read = published.current(spark, root)[0].agg(F.lit(99).cast("bigint").alias("version"), F.lit("read").alias("label"), F.count(F.lit(1)).alias("rows"))
    return v.unionByName(read).withColumn("refused", F.lit(refused > 0))


def release_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a version before and after a foreign file came into its folder."""
    root = shared_path(spark, "release")
    orders = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    published.publish(orders.repartition(4, "o_orderkey"), root, "orders")
    sound = published.integrity_faults(spark, root).select(F.lit("sound").alias("state"), "fault").collect()  # no row if all is well
    path = published.versions(spark, root).first()["path"]
    orders.where("o_orderkey % 100 = 0").coalesce(1).write.mode("append").parquet(path)
    after = published.integrity_faults(spark, root).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    return after.select("fault", "n", F.lit(len(sound)).cast("bigint").alias("n_before"))


# --- bundles ---------------------------------------------------------------------------------


def _bundled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every municipality and city area as a member of its nation's bundle, and the shapes of those that have one."""
    m = X.municipalities(spark, d).select(_id("b-", "s_nationkey").alias("bundle_id"), _id("m-", "s_suppkey").alias("area_id"), "s_suppkey")
    c = X.city_slices(spark, d)
    kids = c.select("s_suppkey", _id("a-", "c_custkey").alias("area_id")).join(m.select("bundle_id", "s_suppkey"), "s_suppkey")
    g = X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'").select("area_id", "rings").unionByName(X.city_geometry(c).select("area_id", "rings"))
    return written(m.drop("s_suppkey").unionByName(kids.select("bundle_id", "area_id")), "members"), written(g, "shapes")


def bundle_descriptors(spark: SparkSession, d: str) -> DataFrame:
    members, g = _bundled(spark, d)
    out = bundles.descriptors(members, written(bundles.parts(members, g, 32 << 10), "bundle-parts"))
    return out.select("bundle_id", "areas", "available", "coverage", "status", "vertices", *(F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")))


def bundle_verification(spark: SparkSession, d: str) -> DataFrame:
    """Published bundles of which each fifth has other shapes, a member missing in its list, another box, or altered bytes."""
    members, g = _bundled(spark, d)
    n = F.regexp_extract("bundle_id", r"\d+", 0).cast("int") % 5
    moved = F.expr("transform(rings, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', transform(r.pts, p -> named_struct('x', p.x + 1, 'y', p.y))))")
    was = members.join(g, "area_id").select("area_id", F.when(n == 1, moved).otherwise(F.col("rings")).alias("rings"))
    made = bundles.parts(members, was)
    stored = written(made.withColumn("body", F.when(n == 4, F.concat("body", F.lit(" "))).otherwise(F.col("body"))), "stored-parts")
    stated = bundles.descriptors(members, stored).withColumn("west", F.when(n == 3, F.col("west") - 1).otherwise(F.col("west")))
    first = members.where(n == 2).groupBy("bundle_id").agg(F.min("area_id").alias("area_id"))
    listed = members.join(first, ["bundle_id", "area_id"], "left_anti")
    return bundles.verification(written(stated, "stated"), stored, listed, members, g)


def bundle_consumer_faults(spark: SparkSession, d: str) -> DataFrame:
    """Bundles of regions as a consumer sees them, each seventh with another fault."""
    members, g = _bundled(spark, d)
    parents = X.areas(spark, d).select(F.col("id").alias("area_id"), "parent_id")
    n = F.regexp_extract("bundle_id", r"\d+", 0).cast("int")
    shown = g.select("area_id", F.lit(True).alias("available"))
    rows = members.where(n % 6 != 5).join(parents.hint("merge"), "area_id").join(shown.hint("merge"), "area_id", "left").select("bundle_id", F.col("area_id").alias("id"), "parent_id", F.coalesce("available", F.lit(False)).alias("available"))
    region = rows.select("bundle_id").distinct().select("bundle_id", F.concat(F.lit("g-"), n.cast("string")).alias("id"), F.lit("p").alias("parent_id"), F.lit(False).alias("available"))
    bundle = written(rows.unionByName(region.where(n % 7 != 1)), "bundle")
    roots = region.select("bundle_id", F.col("id").alias("root_id"))
    stored = written(bundles.parts(members.where(n % 6 != 5), g), "stored-parts")
    stated = bundles.descriptors(bundle.select("bundle_id", F.col("id").alias("area_id")), stored).withColumn("areas", F.when(n % 7 == 4, F.col("areas") + 1).otherwise(F.col("areas")))
    municipal = F.col("id").startswith("m-")
    again = bundle.where(municipal & (n % 7 == 3))
    seen = bundle.unionByName(again).withColumn("parent_id", F.when(municipal & (n % 7 == 5), "x").otherwise(F.col("parent_id")))
    seen = seen.withColumn("source_ids", F.array(F.when(municipal & (n % 7 == 2), "s-9").otherwise("s-1")))
    sources = region.select("bundle_id", F.lit("s-1").alias("source_id"))
    out = bundles.consumer_faults(seen, roots, written(stated, "stated"), stored, sources)
    return out.where("fault <> 'counts' OR " + "CAST(regexp_extract(bundle_id, '[0-9]+', 0) AS INT) % 7 <> 3")


# --- streams and circles -----------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str) -> tuple[str, str, DataFrame, DataFrame]:
    areas = X.areas(spark, d).where("layer = 'administrative' AND level IN ('municipality', 'city_area')")
    areas, closure = written(areas, "areas"), written(hierarchy.ancestors(X.areas(spark, d)), "closure")
    root, target = shared_path(spark, "geometry"), shared_path(spark, "answers")
    g = X.municipal_geometry(X.municipalities(spark, d)).unionByName(X.city_geometry(X.city_slices(spark, d)))
    published.publish(g, root, "first")
    answers.run_available(_stream_points(spark, d), areas, closure, root, target, shared_path(spark, "stream-state"))
    return root, target, areas, closure


def _columns(df: DataFrame) -> DataFrame:
    size = lambda c, n: F.size(c).alias(n)
    return df.select("point_id", "status", size("matched", "n_matched"), size("direct", "n_direct"), size("pending", "n_pending"), F.col("n_unknown").cast("int").alias("n_unknown"), F.col("n_disagreements").cast("int").alias("n_disagreements"), "ambiguous")


def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """The whole lookup of every arriving point: status, closure and uncertainty."""
    return _columns(answers.answers(spark, _streamed(spark, d)[1]))


def stream_restated(spark: SparkSession, d: str) -> DataFrame:
    """The same after a later version of the geometry, without the disputes, has arrived and all was restated twice."""
    root, target, areas, closure = _streamed(spark, d)
    g, version = published.current(spark, root)
    published.publish(g.where("role <> 'review'"), root, "second", version)
    answers.restate(spark, areas, closure, root, target)
    answers.restate(spark, areas, closure, root, target)
    return _columns(answers.answers(spark, target)).where("n_pending >= 0")


def circle_rules(spark: SparkSession, d: str) -> DataFrame:
    """Circles of all events without and with what the disputes leave untouched: how many change in which way."""
    g = written(X.municipal_geometry(X.municipalities(spark, d)), "municipal")
    disputed = g.where("role = 'review'").select("area_id", "rings")
    full = g.where("role = 'assignment'").select("area_id", "rings").join(disputed.select("area_id"), "area_id", "left_semi")
    pairs = disputed.select(F.col("area_id").alias("a"), F.col("area_id").alias("b"))
    stable = written(overlay.shapes(pairs, full, disputed, "difference").select(F.col("a").alias("area_id"), "rings"), "stable")
    out = circle.compare_rules(lookups._circles(spark, d), g.select("area_id").distinct(), g, stable)
    return out.groupBy("legacy_status", "status", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        municipal_import, municipal_import_checks, municipal_import_faults, edition_merge, published_import, release_integrity, bundle_descriptors, bundle_verification, bundle_consumer_faults,
        stream_status, stream_restated, circle_rules,
    )
}

_WARDS = f"""WITH muni AS ({MUNI}), city AS ({CITY}), c AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey, scheme ORDER BY c_custkey)-1 AS j, s_suppkey%4=0 AS four FROM city),
  w AS (SELECT *, CASE WHEN four THEN 'p'||(j%2) ELSE 'c'||c_custkey END AS code FROM c), e AS (SELECT s_suppkey AS k, scheme, count(DISTINCT code) AS n FROM w GROUP BY 1,2)"""

ORACLES = {
    "municipal_import": f"""{_WARDS} SELECT 'd-e-'||s_suppkey||'-'||scheme||'-'||code AS id, 'e-'||s_suppkey||'-'||scheme AS edition, 'm-'||s_suppkey AS authority_id, CASE WHEN any_value(NOT four AND c_custkey%23=5) THEN 'crossing' WHEN any_value(NOT four AND c_custkey%23=6) THEN 'open_ring' END AS issue,
      CASE WHEN any_value(NOT four AND c_custkey%23=5) THEN 'unreviewed_repair' WHEN any_value(NOT four AND c_custkey%23=6) THEN 'missing_geometry' ELSE 'validated_source' END AS assignment_status,
      CASE WHEN any_value(NOT four AND c_custkey%23=5) THEN 'candidate' WHEN any_value(NOT four AND c_custkey%23=6) THEN NULL ELSE 'assignment' END AS role,
      CASE WHEN any_value(NOT four AND c_custkey%23=5) THEN round(sum((x1-x0)*(cy1-cy0))/2e0,6) WHEN any_value(NOT four AND c_custkey%23=6) THEN NULL ELSE round(sum((x1-x0)*(cy1-cy0)),6) END AS area FROM w GROUP BY s_suppkey, scheme, code""",
    "municipal_import_checks": f"""{_WARDS} SELECT 'e-'||k||'-'||e.scheme AS edition, n, (SELECT count(*) FROM w WHERE w.s_suppkey=k AND w.scheme=e.scheme AND NOT four AND c_custkey%23 IN (5,6)) AS n_unavailable, CAST(0 AS BIGINT) AS n_overlaps, k%7<>0 AS count_agrees FROM e""",
    "municipal_import_faults": f"""{_WARDS}, x AS (SELECT k, 'e-'||k||'-'||scheme AS id, count(*) OVER (PARTITION BY CASE WHEN k%11=2 THEN -1 ELSE k END, CASE WHEN k%19=5 THEN 'default' ELSE scheme END) AS n FROM e)
      SELECT id, unnest(list_filter([CASE WHEN k%10=1 THEN 'new' END, CASE WHEN k%11=2 THEN 'authority' END, CASE WHEN k%13=3 THEN 'source' END, CASE WHEN k%17=4 THEN 'effective_date' END, CASE WHEN n>1 THEN 'one_default' END], lambda v: v IS NOT NULL)) AS fault FROM x""",
    "edition_merge": f"""{_WARDS}, o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey%2=0 THEN 'default' ELSE 'other' END AS scheme FROM supplier WHERE s_suppkey%3=0)
      SELECT 'e-'||k||'-'||scheme AS id, true AS "default" FROM e UNION ALL SELECT 'o-'||o.k, NOT EXISTS (SELECT 1 FROM e WHERE e.k=o.k AND e.scheme=o.scheme) FROM o""",
    "published_import": f"""{_WARDS}, o AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey%3=0), v AS (SELECT o.n AS a, o.n+(SELECT count(*) FROM e) AS b FROM o)
      SELECT CAST(1 AS BIGINT) AS version, 'before' AS label, a AS rows, true AS refused FROM v UNION ALL SELECT 2, 'import', b, true FROM v UNION ALL SELECT 99, 'read', b, true FROM v""",
    "release_integrity": "SELECT 'unexpected' AS fault, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_before FROM (SELECT count(*) FROM orders)",
    "bundle_descriptors": f"""WITH muni AS ({MUNI}), city AS ({CITY}), r AS (SELECT s_nationkey AS n, {SHAPED} AS has, CASE shape WHEN 'plain' THEN 4 ELSE 8 END AS v, x0, x1, y0, CASE WHEN shape='multipart' THEN y0+7e0 ELSE y1 END AS y1 FROM muni
      UNION ALL SELECT m.s_nationkey, true, 4, c.x0, c.x1, cy0, cy1 FROM city c JOIN muni m USING(s_suppkey))
      SELECT 'b-'||n AS bundle_id, count(*) AS areas, count(*) FILTER (has) AS available, CASE WHEN count(*) FILTER (has)=0 THEN 'none' WHEN bool_and(has) THEN 'complete' ELSE 'partial' END AS coverage, CASE WHEN count(*) FILTER (has)=0 THEN 'unavailable' ELSE 'ready' END AS status,
        CAST(coalesce(sum(v) FILTER (has),0) AS BIGINT) AS vertices, round(min(x0) FILTER (has),9) AS west, round(min(y0) FILTER (has),9) AS south, round(max(x1) FILTER (has),9) AS east, round(max(y1) FILTER (has),9) AS north FROM r GROUP BY n""",
    "bundle_verification": f"""WITH muni AS ({MUNI}), city AS ({CITY}), n AS (SELECT s_nationkey AS n, bool_or({SHAPED}) OR s_nationkey IN (SELECT m.s_nationkey FROM city JOIN muni m USING(s_suppkey)) AS has FROM muni GROUP BY 1)
      SELECT 'b-'||n AS bundle_id, unnest(CASE n%5 WHEN 1 THEN CASE WHEN has THEN ['stale_part','box','digest'] ELSE [] END WHEN 2 THEN ['missing_member'] WHEN 3 THEN CASE WHEN has THEN ['box'] ELSE [] END WHEN 4 THEN CASE WHEN has THEN ['altered_bytes'] ELSE [] END ELSE [] END) AS fault FROM n""",
    "bundle_consumer_faults": f"""WITH muni AS ({MUNI}), n AS (SELECT DISTINCT s_nationkey AS n FROM muni WHERE s_nationkey%6<>5)
      SELECT 'b-'||n AS bundle_id, unnest(CASE n%7 WHEN 1 THEN ['root_not_listed','detached_member'] WHEN 2 THEN ['unknown_source'] WHEN 3 THEN ['repeated_id'] WHEN 4 THEN ['counts'] WHEN 5 THEN ['detached_member'] ELSE [] END) AS fault FROM n""",
    "stream_status": lookups.ORACLES["point_lookup_status"],
    "stream_restated": lookups.ORACLES["point_lookup_status"].replace(f" OR {IN_STRIP}", ""),
}
