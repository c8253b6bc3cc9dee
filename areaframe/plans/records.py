"""Queries about the hierarchy, editions, population, releases, bundles and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.functions import text as T
from areaframe.operators import catalogue, cells, conformance, contract, editions, hierarchy, lifecycle, population
from areaframe.operators.overlay import overlay_areas
from areaframe.plans.lookups import BASE, CITY, GRID, IN_MUNI, MUNI, MUNI_BOXES, SHARED
from areaframe.sources import fixtures as X
from areaframe.sources import readers
from areaframe.sources.workspace import shared_path, written
from areaframe.streaming import lookup as stream


def _s(c: str):
    return F.col(c).cast("string")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), _s(c))


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(X.areas(spark, d))


def descendant_scope(spark: SparkSession, d: str) -> DataFrame:
    areas = X.areas(spark, d)
    roots = areas.where("level IN ('country', 'province', 'region')").select(F.col("id").alias("root_id"))
    out = hierarchy.scope(areas, roots)
    return out.select("root_id", F.col("members").cast("long").alias("members"), F.col("max_depth").cast("int").alias("max_depth"))


def child_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.child_counts(X.areas(spark, d))


def siblings(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.sibling_counts(X.areas(spark, d).where("layer IN ('shared', 'administrative')"))


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    areas = X.areas(spark, d)
    listing = catalogue.browse(areas, hierarchy.ancestors(areas), level="municipality", within="p-1")
    return catalogue.ordered_page(listing, 0, 20).select("id", "name", "total", "next_offset")


def search_folded(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.browse(X.areas(spark, d), search="MUNICIPALITE 1").select("id", "name")


def identity_digest(spark: SparkSession, d: str) -> DataFrame:
    return contract.identity_digest(X.areas(spark, d), "level")


def identity_diff(spark: SparkSession, d: str) -> DataFrame:
    """Customers that placed orders against all customers."""
    known = X.table(spark, d, "customer").select(_s("c_custkey").alias("id"))
    seen = X.table(spark, d, "orders").select(_s("o_custkey").alias("id"))
    return contract.identity_diff(known, seen)


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """The tree after every region of an odd nation was taken out."""
    areas = X.areas(spark, d)
    return hierarchy.orphans(areas.where(~((F.col("level") == "region") & (F.substring("id", 3, 10).cast("int") % 2 == 1))))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return contract.duplicates(X.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def _editions(spark: SparkSession, d: str) -> DataFrame:
    """The two federal editions over all provinces of the tables."""
    provinces = X.table(spark, d, "region").agg(F.array_sort(F.collect_list(_id("p-", "r_regionkey"))).alias("provinces"))
    rows = F.array(*(F.struct(F.lit(e).alias("id"), F.lit(life).alias("status"), F.lit(life == "current").alias("default"), F.lit((nx + 1) * (ny + 1)).alias("expected_count")) for e, (_, _, nx, ny, life) in X.GRIDS.items()))
    return provinces.select("provinces", F.explode(rows).alias("e")).select("e.id", F.lit("federal").alias("layer"), "e.status", "e.default", "e.expected_count", "provinces")


def edition_coverage(spark: SparkSession, d: str) -> DataFrame:
    districts = X.areas(spark, d).where("layer = 'federal'")
    declared = X.table(spark, d, "region").where("r_regionkey = 3").select(F.lit("fed-2").alias("edition"), _id("p-", "r_regionkey").alias("province_id"), F.lit("partial").alias("declared"))
    return editions.coverage(districts, declared, _editions(spark, d))


def selection_coverage(spark: SparkSession, d: str) -> DataFrame:
    provinces = X.table(spark, d, "region").select(_id("p-", "r_regionkey").alias("province_id"))
    return editions.selection_coverage(provinces, edition_coverage(spark, d), ["fed-2"])


def municipal_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities as authorities, their customers as wards; every third customer's is historical."""
    areas = X.areas(spark, d)
    authorities = areas.where("level = 'municipality'").select(F.col("id").alias("authority_id"), "province_id")
    wards = X.city_slices(spark, d).select(_id("m-", "s_suppkey").alias("authority_id"), (F.col("c_custkey") % 3 != 0).alias("current"))
    declared = X.municipalities(spark, d).where("s_suppkey % 9 = 2").select(_id("m-", "s_suppkey").alias("authority_id"), F.lit("reference").alias("declared"))
    cover = editions.municipal_coverage(authorities, wards, declared)
    return cover.groupBy("province_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_current").alias("n_current"))


def default_replacement(spark: SparkSession, d: str) -> DataFrame:
    """A new default edition for the provinces with an even key takes over there."""
    now = _editions(spark, d).select("id", "layer", "default", "provinces")
    new = X.table(spark, d, "region").where("r_regionkey % 2 = 0").agg(F.array_sort(F.collect_list(_id("p-", "r_regionkey"))).alias("provinces"))
    out = editions.replace_defaults(now, new.select(F.lit("fed-3").alias("id"), F.lit("federal").alias("layer"), F.lit(True).alias("default"), "provinces"))
    return out.select("id", "default", F.array_join("provinces", ",").alias("provinces"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    symbol = F.when(k % 23 == 0, "x").when(k % 29 == 0, "..").when(k % 31 == 0, "E").otherwise("")
    value, reason, flags = T.census_symbol(F.col("v"), F.col("symbol"))
    raw = X.table(spark, d, "supplier").select(_id("m-", "s_suppkey").alias("area_id"), (k * 137 % 100000).alias("v"), symbol.alias("symbol"))
    return raw.select("area_id", value.alias("value"), reason.alias("reason"), F.array_join(flags, ",").alias("flags"), F.lit(True).alias("matched"))


def symbol_decode(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).drop("matched")


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    n = X.table(spark, d, "supplier").count()
    o = X.table(spark, d, "orders")
    count = F.when(F.col("o_orderkey") % 997 != 0, F.col("o_orderkey") % 40)
    return o.select(F.concat(F.lit("m-"), (F.col("o_custkey") % n).cast("string")).alias("gain_id"), F.concat(F.lit("m-"), ((F.col("o_custkey") + 1) % n).cast("string")).alias("loss_id"), count.alias("n"))


def population_adjusted(spark: SparkSession, d: str) -> DataFrame:
    munis = X.areas(spark, d).where("level = 'municipality'").select(F.col("id").alias("area_id"))
    facts = _facts(spark, d).select("area_id", "value", "reason", "matched")
    return population.adjusted(munis, facts, _transfers(spark, d))


def population_coverage(spark: SparkSession, d: str) -> DataFrame:
    info = X.areas(spark, d).where("level = 'municipality'").select(F.col("id").alias("area_id"), "level", "province_id")
    return population.coverage(population_adjusted(spark, d).join(info, "area_id"))


def stale_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """A plan made before the municipalities divisible by ten moved their eastern border."""
    m = X.municipalities(spark, d)
    before = lifecycle.fingerprints(X.municipal_geometry(m))
    after = lifecycle.fingerprints(X.municipal_geometry(m.withColumn("x1", F.expr("CASE WHEN s_suppkey % 10 = 0 THEN x1 - .05D * w ELSE x1 END"))))
    return population.stale(before, after)


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Foreign names without accents, in upper case, against provinces and municipalities."""
    areas = X.areas(spark, d)
    nation, muni = X.table(spark, d, "nation"), areas.where("level = 'municipality'")
    a = nation.select(_id("n-", "n_nationkey").alias("foreign_id"), F.lit("region").alias("kind"), _id("p-", "n_regionkey").alias("province_id"), F.array(F.upper("n_name")).alias("names"))
    b = muni.select(F.concat(F.lit("f-"), "id").alias("foreign_id"), F.lit("municipality").alias("kind"), "province_id", F.array(F.upper(F.translate("name", "é", "e"))).alias("names"))
    out = catalogue.reconcile(a.unionByName(b), areas)
    return out.select("foreign_id", "status", F.array_join("area_ids", ",").alias("area_ids"))


def succession(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring municipalities of any shape merge in pairs, each second pair against a published extent that lies further east."""
    m = X.municipalities(spark, d).where("shape IN ('plain', 'hole', 'multipart')")
    w = Window.partitionBy("s_nationkey").orderBy("k")
    pairs = m.withColumns({"nk": F.lead("k").over(w), "other": F.lead("s_suppkey").over(w), "ox1": F.lead("x1").over(w)}).where("nk = k + 1")
    rows = pairs.select(_id("s-", "s_suppkey").alias("successor_id"), F.explode(F.array("s_suppkey", "other")).alias("s_suppkey"))
    g = X.municipal_geometry(m).where("role = 'assignment'")
    members = written(rows.select("successor_id", _id("m-", "s_suppkey").alias("area_id")).join(g, "area_id").select("successor_id", "area_id", "rings"), "members")
    moved = pairs.where("s_suppkey % 2 = 0").select(_id("s-", "s_suppkey").alias("area_id"), F.expr(f"array({G.box_rings('x0 + .07D * (s_suppkey % 8) * w', 'y0', 'ox1 + .07D * (s_suppkey % 8) * w', 'y1')})").alias("rings"))
    out = lifecycle.succeed(members, moved).withColumn("deferred", F.when(F.regexp_extract("successor_id", r"\d+", 0).cast("int") % 2 == 0, F.col("deferred")))
    parts, holes = (F.expr(f"CAST(size(filter(rings, r -> r.ring {op} 0)) AS BIGINT)") for op in ("=", ">"))
    return out.select("successor_id", F.array_join("predecessor_ids", ",").alias("predecessors"), parts.alias("n_parts"), holes.alias("n_holes"), F.round("area", 6).alias("area"), "deferred")


def region_ledger(spark: SparkSession, d: str) -> DataFrame:
    munis = X.municipalities(spark, d).select(_id("m-", "s_suppkey").alias("area_id"), F.col("s_nationkey").alias("division_id"), "s_suppkey")
    member = munis.where("s_suppkey % 4 <> 3").select("area_id", _id("g-", "division_id").alias("region_id"))
    return lifecycle.region_ledger(munis.drop("s_suppkey"), member)


def release_diff(spark: SparkSession, d: str) -> DataFrame:
    """Orders as two releases: some gone, some new, some with another priority or status."""
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 11 <> 0")
    new = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END")).withColumn("o_orderpriority", F.expr("CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END"))
    out = lifecycle.release_diff(old, new, "o_orderkey", ["o_orderpriority", "o_orderstatus"])
    return out.select("o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


def source_scope(spark: SparkSession, d: str) -> DataFrame:
    """Sources registered for provinces, regions and single municipalities, as they apply to each municipality."""
    areas = X.areas(spark, d)
    usage = areas.where("level IN ('province', 'region')").select(F.col("id").alias("area_id"), F.concat(F.lit("src-"), "level").alias("source_id"))
    own = X.municipalities(spark, d).where("s_suppkey % 3 = 0").select(_id("m-", "s_suppkey").alias("area_id"), F.lit("src-own").alias("source_id"))
    out = catalogue.applicable_sources(areas, hierarchy.ancestors(areas), usage.unionByName(own))
    return out.where(F.col("id").startswith("m-")).select("id", F.array_join("source_ids", ",").alias("source_ids"))


def bundle_members(spark: SparkSession, d: str) -> DataFrame:
    areas = X.areas(spark, d).where("layer IN ('shared', 'administrative') AND level NOT IN ('region', 'city_area')")
    munis = X.municipalities(spark, d)
    # municipalities hang on the province here: regions are left out of the bundle
    areas = areas.withColumn("parent_id", F.when(F.col("level") == "municipality", F.col("province_id")).otherwise(F.col("parent_id")))
    roots = areas.where("level = 'province'").select(F.col("id").alias("root_id"))
    return catalogue.bundle_members(areas, hierarchy.ancestors(areas, 3), roots, X.municipal_geometry(munis))


def html_membership(spark: SparkSession, d: str) -> DataFrame:
    """Membership lists made from nations (headers) and suppliers (members), one page a region."""
    n = X.table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.lit(-1).cast("bigint").alias("k"), F.format_string('<li class="list-group-item indent-2">N%d - %s</li>', "n_nationkey", "n_name").alias("li"))
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("n_regionkey", "n_nationkey", F.col("s_suppkey").alias("k"), F.format_string('<li class="list-group-item indent-3">S%d - %s</li>', "s_suppkey", "s_name").alias("li"))
    pages = n.unionByName(s).groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "k", "li"))), lambda x: x["li"]), "\n").alias("html"))
    return readers.list_members(pages)


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    out = e.groupBy("event_type").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"), F.count("value").alias("n"))
    return out.select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), F.round("most", 6).alias("most"), "n")


def evidence_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))
    return catalogue.evidence_nodes(docs).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def display_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Displays exist for even municipalities, and for one number beyond the last."""
    areas = X.areas(spark, d).where("level = 'municipality'")
    g = X.municipal_geometry(X.municipalities(spark, d)).select("area_id", "role")
    even = X.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(_id("m-", "s_suppkey").alias("area_id"), F.lit("display").alias("role"))
    extra = X.table(spark, d, "supplier").agg((F.max("s_suppkey") + 1).alias("k")).select(_id("m-", "k").alias("area_id"), F.lit("display").alias("role"))
    return contract.display_gaps(areas, g.unionByName(even).unionByName(extra))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Build report: one pass over the areas of each level."""
    a = X.areas(spark, d)
    return a.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("assignment_status").isin("missing_geometry", "unreviewed_repair")).alias("n_open"), F.max(F.length("name")).alias("max_chars"))


def municipal_escalation(spark: SparkSession, d: str) -> DataFrame:
    """Points in municipalities, raised where that municipality's coverage is not settled."""
    p = X.points(spark, d)
    located = cells.cover(p, _assigned(spark, d), "point_id").select("point_id", "area_id").distinct()
    wards = X.city_slices(spark, d).groupBy(_id("m-", "s_suppkey").alias("area_id")).agg(F.count_if(F.col("c_custkey") % 3 != 0).alias("n"))
    status = F.when(F.substring("area_id", 3, 12).cast("int") % 9 == 2, "reference").when(F.col("n") > 0, "included").otherwise("historical_only")
    base = p.select("point_id", F.lit("matched").alias("status"))
    return conformance.escalate_municipal(base, located, wards.select("area_id", status.alias("status")), explicit=False)


def edition_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """City slices of both schemes as one edition: pairs that share area."""
    g = X.city_geometry(X.city_slices(spark, d))
    out = conformance.edition_overlaps(g, 1e-9)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("intersection", 6).alias("shared"))


def city_layer_status(spark: SparkSession, d: str) -> DataFrame:
    """City slices qualified by what lies outside their municipality, what siblings share and what they cover.

    Every fourth slice is narrower and every tenth taller than the tiling, so that all rules
    meet cases. Square degrees count as 1e10 square metres.
    """
    city = X.city_slices(spark, d).withColumns({"x1": F.expr("CASE WHEN c_custkey % 4 = 1 THEN x0 + .7D * (x1 - x0) ELSE x1 END"), "cy1": F.expr("CASE WHEN c_custkey % 10 = 0 THEN cy1 + .2D * (cy1 - cy0) ELSE cy1 END")})
    info = city.select(_id("a-", "c_custkey").alias("area_id"), _id("m-", "s_suppkey").alias("parent_id"), F.col("scheme").alias("track"))
    kids = written(X.city_geometry(city).join(info, "area_id"), "city-slices")
    parents = X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'")
    pairs = kids.join(parents.select(F.col("area_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("area_id").alias("a"), F.col("parent_id").alias("b"))
    outside = overlay_areas(pairs, kids, parents).select(F.col("a").alias("area_id"), "outside_a")
    track = F.concat_ws("|", "parent_id", "track").alias("track")
    siblings = kids.select("area_id", "rings", track)
    shared = conformance.current_overlaps(siblings, siblings).groupBy(F.col("a").alias("area_id")).agg(F.sum("intersection").alias("shared"))
    cover = lifecycle.child_coverage(kids, parents).select("parent_id", "track", F.round(F.col("covered") / (F.col("covered") + F.col("uncovered")), 9).alias("covered_share"))
    m = kids.join(outside, "area_id", "left").join(shared, "area_id", "left").join(cover, ["parent_id", "track"], "left")
    unit = 1e10
    m = m.select("area_id", (G.area("rings") * unit).alias("area"), (F.col("outside_a") * unit).alias("outside"), (F.coalesce("shared", F.lit(0.0)) * unit).alias("overlap"), "covered_share")
    return conformance.qualify_layer(m).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stable_core_area(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities without the strip that their boundary change disputes."""
    g = X.municipal_geometry(X.municipalities(spark, d))
    f = conformance.stable_core(g.where("role = 'assignment'"), g.where("role = 'review'").select("area_id", "rings"))
    return f.groupBy(F.col("a").alias("area_id")).agg(F.round(F.sum(F.expr("(px * qy - py * qx) / 2D")), 5).alias("area"))


def bundle_documents(spark: SparkSession, d: str) -> DataFrame:
    """One geometry document for each nation, deduplicated by content."""
    m = X.municipalities(spark, d).select(_id("m-", "s_suppkey").alias("area_id"), _id("b-", "s_nationkey").alias("bundle_id"))
    docs = conformance.bundle_documents(m, X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'"))
    return docs.select("bundle_id", F.col("n_vertices").cast("long").alias("n_vertices"), "west", "north", "status")


def _stream_points(spark: SparkSession, d: str) -> DataFrame:
    schema = X.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return spark.sql(X.POINTS, events=events).withColumnRenamed("event_id", "point_id").withColumn("ts", F.col("ts").cast("timestamp"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return X.municipal_geometry(X.municipalities(spark, d)).where("role = 'assignment'")


def _stream_matches(spark: SparkSession, d: str) -> DataFrame:
    size = cells.cell_size(_assigned(spark, d))
    return stream.stream_lookup(_stream_points(spark, d), written(cells.polygon_cells(_assigned(spark, d), size), "cells"), size)


def stream_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = shared_path(spark, "stream-lookup")
    stream.run_available(_stream_matches(spark, d), out, shared_path(spark, "stream-state"))
    return spark.read.parquet(out).select("point_id", "area_id")


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly matches per area; the last hours stay open until the watermark passes them."""
    out = shared_path(spark, "stream-windows")
    stream.run_available(stream.window_counts(_stream_matches(spark, d)), out, shared_path(spark, "stream-state"))
    done = spark.read.parquet(out)
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "area_id", "n")


QUERIES = {
    f.__name__: f
    for f in (
        ancestors, descendant_scope, child_counts, siblings, browse_page, search_folded, identity_digest, identity_diff, orphans, duplicates, edition_coverage, selection_coverage, municipal_coverage,
        default_replacement, symbol_decode, population_adjusted, population_coverage, stale_crosswalk, reconcile, succession, region_ledger, release_diff, source_scope, bundle_members, html_membership,
        latency_summary, evidence_nodes, display_gaps, coverage_report, municipal_escalation, edition_overlaps, city_layer_status, stable_core_area, bundle_documents, stream_lookup, stream_window_counts,
    )
}

AREAS = f"""muni AS ({MUNI}), city AS ({CITY}), areas AS (
  SELECT 'c' AS id, 'Country' AS name, 'country' AS level, 'shared' AS layer, NULL AS parent_id, NULL AS province_id, NULL AS scheme, NULL AS edition, 'current' AS life, 'hierarchy_only' AS st
  UNION ALL SELECT 'p-'||r_regionkey, r_name, 'province', 'shared', 'c', 'p-'||r_regionkey, NULL, NULL, 'current', 'hierarchy_only' FROM region
  UNION ALL SELECT 'g-'||n_nationkey, n_name, 'region', 'administrative', 'p-'||n_regionkey, 'p-'||n_regionkey, NULL, NULL, 'current', 'validated_derived' FROM nation WHERE n_nationkey%6<>5
  UNION ALL SELECT 'm-'||s_suppkey, 'Municipalité '||s_suppkey, 'municipality', 'administrative', CASE WHEN s_nationkey%6<>5 THEN 'g-'||s_nationkey ELSE 'p-'||n_regionkey END, 'p-'||n_regionkey, NULL, NULL, 'current',
    CASE WHEN shape IN ('unknown','bbox') THEN 'missing_geometry' WHEN shape='bowtie' THEN 'unreviewed_repair' ELSE 'validated_source' END FROM muni JOIN nation ON n_nationkey=s_nationkey
  UNION ALL SELECT 'a-'||c_custkey, 'Area '||c_custkey, 'city_area', 'administrative', 'm-'||s_suppkey, 'p-'||n_regionkey, scheme, NULL, 'current', 'validated_source' FROM city JOIN (SELECT s_suppkey, s_nationkey FROM muni) m USING(s_suppkey) JOIN nation ON n_nationkey=s_nationkey
  UNION ALL SELECT 'f2-'||i||'-'||j, 'District f2-'||i||'-'||j, 'electoral_district', 'federal', 'p-'||(i%5), 'p-'||(i%5), NULL, 'fed-2', 'current', 'validated_source' FROM range(18) a(i), range(11) b(j)
  UNION ALL SELECT 'f1-'||i||'-'||j, 'District f1-'||i||'-'||j, 'electoral_district', 'federal', 'p-'||(i%5), 'p-'||(i%5), NULL, 'fed-1', 'historical', 'validated_source' FROM range(15) a(i), range(9) b(j))"""
CLOSURE = "anc AS (SELECT id, parent_id AS ancestor_id, 1 AS depth FROM areas WHERE parent_id IS NOT NULL UNION ALL SELECT anc.id, p.parent_id, depth+1 FROM anc JOIN areas p ON p.id=ancestor_id WHERE p.parent_id IS NOT NULL)"
COVER = f"""grid AS (SELECT 'fed-2' AS edition, i FROM ({GRID['fed-2']}) UNION ALL SELECT 'fed-1', i FROM ({GRID['fed-1']})), cov AS (SELECT edition, province_id, n_rows, 0 AS n_unavailable, CASE WHEN edition='fed-2' AND province_id='p-3' THEN 'partial' WHEN n_rows=0 THEN 'unavailable' ELSE 'included' END AS status
  FROM (SELECT e.edition, 'p-'||r_regionkey AS province_id, (SELECT count(*) FROM grid g WHERE g.edition=e.edition AND g.i%5=r_regionkey) AS n_rows FROM region, (SELECT 'fed-1' AS edition UNION ALL SELECT 'fed-2') e))"""
FACTS = """facts AS (SELECT s_suppkey, CASE WHEN s_suppkey%23=0 OR s_suppkey%29=0 THEN NULL ELSE s_suppkey*137%100000 END AS value, CASE WHEN s_suppkey%23=0 THEN 'suppressed' WHEN s_suppkey%29=0 THEN 'not_available' END AS reason,
  CASE WHEN s_suppkey%31=0 AND s_suppkey%23<>0 AND s_suppkey%29<>0 THEN 'use_with_caution' ELSE '' END AS flags FROM supplier)"""
ADJUSTED = f"""{FACTS}, n AS (SELECT count(*) AS n FROM supplier), t AS (SELECT o_custkey%n.n AS g, (o_custkey+1)%n.n AS l, CASE WHEN o_orderkey%997<>0 THEN o_orderkey%40 END AS v FROM orders, n),
  d AS (SELECT k, sum(v) AS delta, count(*) AS n, count(*) FILTER (v IS NULL) AS u FROM (SELECT g AS k, v FROM t UNION ALL SELECT l, -v FROM t) GROUP BY 1),
  adj AS (SELECT 'm-'||s_suppkey AS area_id, s_suppkey, CASE WHEN reason IS NULL AND coalesce(u,0)=0 THEN CAST(value+coalesce(delta,0) AS BIGINT) END AS population, coalesce(reason, CASE WHEN u>0 THEN 'transfer_not_available' END) AS reason, coalesce(n,0) AS n_adjustments FROM facts LEFT JOIN d ON k=s_suppkey)"""

ORACLES = {
    "ancestors": f"WITH RECURSIVE {AREAS}, {CLOSURE} SELECT id, ancestor_id, depth FROM anc",
    "descendant_scope": f"WITH RECURSIVE {AREAS}, {CLOSURE} SELECT a.id AS root_id, count(anc.id) AS members, CAST(coalesce(max(depth),0) AS INT) AS max_depth FROM areas a LEFT JOIN anc ON ancestor_id=a.id WHERE level IN ('country','province','region') GROUP BY 1",
    "child_counts": f"WITH {AREAS} SELECT parent_id, layer, count(*) AS n_children FROM areas WHERE parent_id IS NOT NULL AND life='current' GROUP BY 1,2",
    "siblings": f"WITH {AREAS} SELECT id, count(*) OVER (PARTITION BY parent_id, coalesce(scheme,'default'))-1 AS n_siblings FROM areas WHERE parent_id IS NOT NULL AND layer IN ('shared','administrative')",
    "browse_page": f"WITH {AREAS}, l AS (SELECT id, name FROM areas WHERE level='municipality' AND province_id='p-1'), c AS (SELECT count(*) AS n FROM l) SELECT id, name, CAST(n AS INT) AS total, CASE WHEN n>20 THEN 20 END AS next_offset FROM l, c ORDER BY strip_accents(lower(name)), id LIMIT 20",
    "search_folded": f"WITH {AREAS} SELECT id, name FROM areas WHERE life<>'superseded' AND contains(strip_accents(lower(name)), 'municipalite 1')",
    "identity_digest": f"WITH {AREAS} SELECT level, sha256(string_agg(id, chr(10) ORDER BY id)||chr(10)) AS digest, count(*) AS n FROM areas GROUP BY 1",
    "identity_diff": "WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(coalesce(c_custkey,k) AS VARCHAR) AS id, CASE WHEN k IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'duplicate' END AS fault FROM customer FULL JOIN o ON k=c_custkey WHERE k IS NULL OR c_custkey IS NULL OR n>1",
    "orphans": f"WITH {AREAS}, k AS (SELECT * FROM areas WHERE NOT (level='region' AND TRY_CAST(substr(id,3) AS INT)%2=1)) SELECT id, 'missing_parent' AS fault FROM k WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM k)",
    "duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1",
    "edition_coverage": f"WITH {COVER} SELECT * FROM cov",
    "selection_coverage": f"WITH {COVER} SELECT province_id, status FROM cov WHERE edition='fed-2'",
    "municipal_coverage": f"""WITH {AREAS}, w AS (SELECT s_suppkey, count(*) FILTER (c_custkey%3<>0) AS n_current, count(*) FILTER (c_custkey%3=0) AS n_historical FROM city GROUP BY 1)
      SELECT province_id, CASE WHEN m.s_suppkey%9=2 THEN 'reference' WHEN coalesce(n_current,0)>0 THEN 'included' WHEN coalesce(n_historical,0)>0 THEN 'historical_only' ELSE 'unverified' END AS status, count(*) AS n, CAST(sum(coalesce(n_current,0)) AS BIGINT) AS n_current
      FROM muni m JOIN areas ON id='m-'||m.s_suppkey LEFT JOIN w ON w.s_suppkey=m.s_suppkey GROUP BY 1,2""",
    "default_replacement": """WITH p AS (SELECT string_agg('p-'||r_regionkey, ',' ORDER BY 'p-'||r_regionkey) AS a, string_agg('p-'||r_regionkey, ',' ORDER BY 'p-'||r_regionkey) FILTER (r_regionkey%2=0) AS e FROM region)
      SELECT 'fed-1' AS id, false AS "default", a AS provinces FROM p UNION ALL SELECT 'fed-2', false, a FROM p UNION ALL SELECT 'fed-3', true, e FROM p""",
    "symbol_decode": f"WITH {FACTS} SELECT 'm-'||s_suppkey AS area_id, value, reason, flags FROM facts",
    "population_adjusted": f"WITH {ADJUSTED} SELECT area_id, population, reason, n_adjustments FROM adj",
    "population_coverage": f"""WITH {ADJUSTED}, r AS (SELECT 'municipality' AS level, 'p-'||n_regionkey AS province_id, population FROM adj JOIN supplier USING(s_suppkey) JOIN nation ON n_nationkey=s_nationkey)
      SELECT level, province_id, count(population) AS n_known, count(*) FILTER (population=0) AS n_zero, count(*)-count(population) AS n_missing, CAST(sum(population) AS BIGINT) AS population FROM r GROUP BY GROUPING SETS ((level),(province_id))""",
    "stale_crosswalk": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, 'changed' AS fault FROM muni WHERE s_suppkey%10=0 AND shape<>'unknown'",
    "reconcile": """SELECT 'n-'||n_nationkey AS foreign_id, CASE WHEN n_nationkey%6<>5 THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN n_nationkey%6<>5 THEN 'g-'||n_nationkey ELSE '' END AS area_ids FROM nation
      UNION ALL SELECT 'f-m-'||s_suppkey, 'matched', 'm-'||s_suppkey FROM supplier""",
    "succession": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, q AS (SELECT *, CASE shape WHEN 'plain' THEN 8e0*w WHEN 'hole' THEN 7e0*w ELSE 5.2e0*w END AS a FROM muni WHERE shape IN ('plain','hole','multipart')),
      p AS (SELECT *, lead(k) OVER o AS nk, lead(s_suppkey) OVER o AS other, lead(shape) OVER o AS oshape, lead(a) OVER o AS oa, lead(x1) OVER o AS ox1 FROM q WINDOW o AS (PARTITION BY s_nationkey ORDER BY k)),
      i AS (SELECT s_suppkey, any_value(a+oa) AS old, any_value((ox1-p.x0)*8e0) AS new, sum(sgn*greatest(0e0,least(bx1,ox1+t)-greatest(bx0,p.x0+t))*greatest(0e0,least(by1,p.y1)-greatest(by0,p.y0))) AS i FROM (SELECT *, .07e0*(s_suppkey%8)*w AS t FROM p WHERE nk=k+1) p JOIN boxes ON area_id IN ('m-'||s_suppkey,'m-'||other) GROUP BY 1)
      SELECT 's-'||p.s_suppkey AS successor_id, least('m-'||p.s_suppkey,'m-'||other)||','||greatest('m-'||p.s_suppkey,'m-'||other) AS predecessors, 1+CAST(shape='multipart' AS BIGINT)+CAST(oshape='multipart' AS BIGINT) AS n_parts,
        CAST(shape='hole' AS BIGINT)+CAST(oshape='hole' AS BIGINT) AS n_holes, round(a+oa,6) AS area, CASE WHEN p.s_suppkey%2=0 THEN NOT (i>=.8e0*old AND i>=.8e0*new) END AS deferred FROM p JOIN i USING(s_suppkey) WHERE nk=k+1""",
    "region_ledger": "SELECT s_nationkey AS division_id, count(*) FILTER (s_suppkey%4<>3) AS n_assigned, count(*) FILTER (s_suppkey%4=3) AS n_unassigned, CASE WHEN count(*) FILTER (s_suppkey%4=3)=0 THEN 'assigned' WHEN count(*) FILTER (s_suppkey%4<>3)=0 THEN 'unassigned' ELSE 'partially_assigned' END AS state FROM supplier GROUP BY 1",
    "release_diff": """WITH n AS (SELECT o_orderkey, o_orderkey%11<>0 AS a, o_orderkey%13<>0 AS b, o_orderkey%17=0 AND o_orderstatus<>'Z' AS s, o_orderkey%19=0 AND o_orderpriority IS NOT NULL AS p FROM orders)
      SELECT o_orderkey, CASE WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a AND b THEN concat_ws(',', CASE WHEN p THEN 'o_orderpriority' END, CASE WHEN s THEN 'o_orderstatus' END) END AS "columns" FROM n WHERE (a OR b) AND (NOT a OR NOT b OR s OR p)""",
    "source_scope": "SELECT 'm-'||s_suppkey AS id, concat_ws(',', CASE WHEN s_suppkey%3=0 THEN 'src-own' END, 'src-province', CASE WHEN s_nationkey%6<>5 THEN 'src-region' END) AS source_ids FROM supplier",
    "bundle_members": f"""WITH muni AS ({MUNI}), b AS (SELECT 'p-'||n_regionkey AS root_id, count(*) AS n_members, count(*) FILTER (shape IN ('plain','hole','multipart')) AS n_shaped, count(*) FILTER (shape='bowtie') AS n_candidate FROM muni JOIN nation ON n_nationkey=s_nationkey GROUP BY 1)
      SELECT *, CASE WHEN n_shaped=n_members THEN 'complete' WHEN n_shaped>0 THEN 'partial' ELSE 'none' END AS coverage FROM b""",
    "html_membership": "SELECT n_regionkey AS page_id, 'N'||n_nationkey AS group_code, 'S'||s_suppkey AS code, trim(s_name) AS name FROM supplier JOIN nation ON n_nationkey=s_nationkey",
    "latency_summary": "SELECT event_type, round(quantile_cont(value,0.5),6) AS median, round(quantile_disc(value,0.95),6) AS p95, round(max(value),6) AS most, count(value) AS n FROM events GROUP BY 1",
    "display_gaps": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS id, 'missing_display' AS fault FROM muni WHERE s_suppkey%2<>0 AND shape IN ('plain','hole','multipart','bowtie') UNION ALL SELECT 'm-'||(max(s_suppkey)+1), 'unknown_display' FROM supplier",
    "coverage_report": f"WITH {AREAS} SELECT level, count(*) AS n, count(*) FILTER (st IN ('missing_geometry','unreviewed_repair')) AS n_open, CAST(max(length(name)) AS INT) AS max_chars FROM areas GROUP BY 1",
    "municipal_escalation": f"""{BASE}, city AS ({CITY}), w AS (SELECT s_suppkey, count(*) FILTER (c_custkey%3<>0) AS n FROM city GROUP BY 1),
      l AS (SELECT event_id, bool_or(w.s_suppkey IS NULL OR m.s_suppkey%9=2 OR w.n=0) AS bad FROM pts JOIN muni m ON {IN_MUNI.replace('s_suppkey', 'm.s_suppkey')} LEFT JOIN w ON w.s_suppkey=m.s_suppkey GROUP BY 1)
      SELECT p.event_id AS point_id, CASE WHEN coalesce(bad,true) THEN 'review_required' ELSE 'matched' END AS status FROM pts p LEFT JOIN l USING(event_id)""",
    "edition_overlaps": f"""WITH muni AS ({MUNI}), city AS ({CITY}), c AS (SELECT 'a-'||c_custkey AS id, x0, x1, cy0, cy1 FROM city)
      SELECT p.id AS a, q.id AS b, round((least(p.x1,q.x1)-greatest(p.x0,q.x0))*(least(p.cy1,q.cy1)-greatest(p.cy0,q.cy0)),6) AS shared FROM c p JOIN c q ON p.id<q.id AND p.x0<q.x1-1e-9 AND q.x0<p.x1-1e-9 AND p.cy0<q.cy1-1e-9 AND q.cy0<p.cy1-1e-9
      WHERE (least(p.x1,q.x1)-greatest(p.x0,q.x0))*(least(p.cy1,q.cy1)-greatest(p.cy0,q.cy0))>1e-9""",
    "city_layer_status": f"""WITH muni AS ({MUNI}), city AS ({CITY}), {MUNI_BOXES}, c AS (SELECT c_custkey, 'm-'||s_suppkey AS pid, scheme, x0, CASE WHEN c_custkey%4=1 THEN x0+.7e0*(x1-x0) ELSE x1 END AS x1, cy0 AS y0, CASE WHEN c_custkey%10=0 THEN cy1+.2e0*(cy1-cy0) ELSE cy1 END AS y1 FROM city),
      s AS (SELECT c_custkey, pid, scheme, any_value((x1-x0)*(y1-y0)) AS a, sum({SHARED}) AS i FROM c JOIN boxes ON area_id=pid GROUP BY 1,2,3), pa AS (SELECT area_id AS pid, sum(sgn*(bx1-bx0)*(by1-by0)) AS pa FROM boxes GROUP BY 1),
      tw AS (SELECT p.pid, p.scheme, greatest(p.x0,q.x0) AS x0, least(p.x1,q.x1) AS x1, greatest(p.y0,q.y0) AS y0, least(p.y1,q.y1) AS y1 FROM c p JOIN c q ON p.pid=q.pid AND p.scheme=q.scheme AND p.c_custkey<q.c_custkey AND p.x0<q.x1 AND q.x0<p.x1 AND p.y0<q.y1 AND q.y0<p.y1),
      tws AS (SELECT pid, scheme, sum({SHARED}) AS t FROM tw JOIN boxes ON area_id=pid GROUP BY 1,2),
      v AS (SELECT pid, scheme, round((sum(i)-coalesce(any_value(t),0e0))/any_value(pa),9) AS cov FROM s JOIN pa USING(pid) LEFT JOIN tws USING(pid, scheme) GROUP BY 1,2), o AS (SELECT p.c_custkey, sum(greatest(0e0,least(p.x1,q.x1)-greatest(p.x0,q.x0))*greatest(0e0,least(p.y1,q.y1)-greatest(p.y0,q.y0))) AS o FROM c p JOIN c q ON p.pid=q.pid AND p.scheme=q.scheme AND p.c_custkey<>q.c_custkey GROUP BY 1),
      r AS (SELECT c.c_custkey, round((a-i)/a,9) AS share, coalesce(o,0e0)*1e10 AS o, a*1e10 AS a, cov FROM c LEFT JOIN s USING(c_custkey) LEFT JOIN o USING(c_custkey) LEFT JOIN v ON v.pid=c.pid AND v.scheme=c.scheme)
      SELECT CASE WHEN share IS NULL OR share>0.1 THEN 'rejected' WHEN share>0.01 THEN 'unreviewed_parent' WHEN o>greatest(1e0,1e-6*a) THEN 'unreviewed_overlap' WHEN cov<0.9 THEN 'display_reference' ELSE 'validated_source' END AS status, count(*) AS n FROM r GROUP BY 1""",
    "stable_core_area": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, round(CASE shape WHEN 'plain' THEN w*7.2e0 WHEN 'hole' THEN w*7.2e0-w ELSE w*5e0*.9e0+.2e0*w END, 5) AS area FROM muni WHERE s_suppkey%19=6 AND shape IN ('plain','hole','multipart')",
    "bundle_documents": f"WITH muni AS ({MUNI}) SELECT 'b-'||s_nationkey AS bundle_id, CAST(sum(CASE WHEN shape='plain' THEN 4 ELSE 8 END) AS BIGINT) AS n_vertices, min(x0) AS west, max(CASE WHEN shape='multipart' THEN y0+7e0 ELSE y1 END) AS north, 'ready' AS status FROM muni WHERE shape IN ('plain','hole','multipart') GROUP BY 1",
    "stream_window_counts": f"""{BASE}, m AS (SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS h, CAST(ts AS TIMESTAMP) AS ts, 'm-'||s_suppkey AS area_id FROM pts JOIN muni ON {IN_MUNI})
      SELECT strftime(h, '%Y-%m-%d %H:%M') AS window_start, area_id, count(*) AS n FROM m WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM m) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
    "evidence_nodes": """SELECT fullkey AS path, CASE WHEN type IN ('UBIGINT','BIGINT') THEN 'BIGINT' ELSE type END AS kind, count(*) AS n, count(DISTINCT atom) AS n_values FROM events, json_tree(props) GROUP BY 1, 2""",
    "stream_lookup": f"{BASE} SELECT event_id AS point_id, 'm-'||s_suppkey AS area_id FROM pts JOIN muni ON {IN_MUNI}",
}
