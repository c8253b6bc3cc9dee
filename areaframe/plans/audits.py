"""Queries that audit releases: guards, ledgers, proofs, reviews and listings, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.functions import text as T
from areaframe.operators import catalogue, cells, conformance, contract, editions, hierarchy, lifecycle, lookup, overlay, population, release, review
from areaframe.plans import lookups, records
from areaframe.plans.lookups import BASE, GRID, IN_MUNI, MOVED_BOXES, MUNI, MUNI_BOXES, SHARED
from areaframe.plans.records import ADJUSTED, AREAS, CLOSURE, _id
from areaframe.sources import fixtures as X
from areaframe.sources.workspace import dealt, written

SHAPED = "shape IN ('plain', 'hole', 'multipart')"


def _k() -> Column:
    return F.col("s_suppkey")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "supplier")


def _munis(spark: SparkSession, d: str) -> DataFrame:
    return X.areas(spark, d).where("level = 'municipality'")


def _shapes(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return X.municipal_geometry(X.municipalities(spark, d).where(where)).where("role = 'assignment'")


def _eastern(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities of which those divisible by ten moved their eastern border."""
    return X.municipalities(spark, d).withColumn("x1", F.expr("CASE WHEN s_suppkey % 10 = 0 THEN x1 - .05D * w ELSE x1 END"))


def display_roots(spark: SparkSession, d: str) -> DataFrame:
    return release.display_roots(X.areas(spark, d)).select("id")


def source_identity(spark: SparkSession, d: str) -> DataFrame:
    """Customers by their own key, and every fourth by its nation and name instead."""
    own = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey"))
    return X.table(spark, d, "customer").select("c_custkey", T.source_identity(own, F.lit("name-"), F.col("c_name")).alias("identity"))


def layer_visibility(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.in_layer(X.areas(spark, d), "municipal").select("id", "level")


def scope_relations(spark: SparkSession, d: str) -> DataFrame:
    """One record for every area: how it relates to the province p-1."""
    areas = X.areas(spark, d)
    return catalogue.scope_relation(areas.select(F.concat(F.lit("r-"), "id").alias("record_id"), F.col("id").alias("area_id")), hierarchy.ancestors(areas), "p-1")


def succession_symmetry(spark: SparkSession, d: str) -> DataFrame:
    """Even suppliers succeed themselves and the next one; every seventh predecessor does not know."""
    s = _suppliers(spark, d)
    none = F.array().cast("array<string>")
    new = s.where(_k() % 2 == 0).select(_id("s-", "s_suppkey").alias("id"), F.array(_id("m-", "s_suppkey"), F.concat(F.lit("m-"), (_k() + 1).cast("string"))).alias("predecessor_ids"), none.alias("successor_ids"))
    old = s.select(_id("m-", "s_suppkey").alias("id"), none.alias("predecessor_ids"), F.when(_k() % 7 != 0, F.array(F.concat(F.lit("s-"), (_k() - _k() % 2).cast("string")))).otherwise(none).alias("successor_ids"))
    return contract.asymmetric_succession(new.unionByName(old))


def approved_changes(spark: SparkSession, d: str) -> DataFrame:
    """The release difference without the changes of status that were approved."""
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 11 <> 0")
    new = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END")).withColumn("o_orderpriority", F.expr("CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END"))
    allowed = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("o_orderstatus").alias("column"))
    out = lifecycle.release_diff(old, new, "o_orderkey", ["o_orderpriority", "o_orderstatus"], allowed)
    return out.select("o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


def count_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation against fifteen for each supplier."""
    expected = _suppliers(spark, d).groupBy(F.col("s_nationkey").alias("nation")).agg((15 * F.count(F.lit(1))).alias("expected"))
    return contract.count_check(X.table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), expected, "nation")


def rule_selection(spark: SparkSession, d: str) -> DataFrame:
    """Two editions that select customers by market segment and nation."""
    props = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), props.alias("props"))
    rules = spark.sql("SELECT * FROM VALUES ('e1', 'segment', array('BUILDING', 'MACHINERY')), ('e1', 'nation', array('1', '2', '3')), ('e2', 'segment', array('FURNITURE')) AS t(edition, field, values)")
    return editions.rule_rows(rows, rules)


def source_record_faults(spark: SparkSession, d: str) -> DataFrame:
    """Supplier keys as seven-digit municipal codes; every ninth has a foreign division, every tenth no name."""
    csd = (_k() + 1000000).cast("string")
    rows = _suppliers(spark, d).select("s_suppkey", csd.alias("csd"), F.when(_k() % 9 == 0, "9999").otherwise(F.substring(csd, 1, 4)).alias("cd"), F.substring(csd, 1, 2).alias("pr"), F.when(_k() % 10 == 0, " ").otherwise(F.col("s_name")).alias("name"))
    return contract.source_record_violations(rows).select("s_suppkey", F.array_join("violations", ",").alias("violations"))


def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    _, old, new = lookups._moved(spark, d)
    pairs = old.select(F.col("area_id").alias("a"), F.col("area_id").alias("b"))
    f = overlay.boundary(pairs, old, new, "symmetric difference")
    return f.groupBy(F.col("a").alias("area_id")).agg(F.round(F.sum(F.expr("(px * qy - py * qx) / 2D")), 6).alias("area"))


def retraced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Even plain municipalities with a spike that runs out and back at their north-eastern corner."""
    pts = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x1", "y1 + 1D"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))) + ")"
    g = X.municipalities(spark, d).where("shape = 'plain' AND s_suppkey % 2 = 0").select(_id("m-", "s_suppkey").alias("area_id"), F.expr(f"array(named_struct('part', 0, 'ring', 0, 'pts', {pts}))").alias("rings"))
    return review.retraced(g)


def boundary_equality(spark: SparkSession, d: str) -> DataFrame:
    return conformance.same_boundary(_shapes(spark, d), X.municipal_geometry(_eastern(spark, d)).where("role = 'assignment'"))


def hole_components(spark: SparkSession, d: str) -> DataFrame:
    """Holes of municipalities, of which the even ones are filled by a component of their own."""
    fill = X.municipalities(spark, d).where("shape = 'hole' AND s_suppkey % 2 = 0").select(F.expr(f"array({G.box_rings('x0+.25D*w', 'y0+2D', 'x0+.75D*w', 'y0+4D')})").alias("rings"))
    return conformance.holes_matched(_shapes(spark, d), fill)


def corridor_distances(spark: SparkSession, d: str) -> DataFrame:
    _, old, new = lookups._moved(spark, d)
    return conformance.corridor_distance(new, old, 4.0).select("area_id", F.round("distance", 6).alias("distance"))


def envelope_violations(spark: SparkSession, d: str) -> DataFrame:
    """Stored boxes, of which every fifth is a tenth too narrow."""
    m = X.municipalities(spark, d).where(SHAPED)
    boxes = m.select(_id("m-", "s_suppkey").alias("area_id"), F.col("x0").alias("west"), F.col("y0").alias("south"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN x1 - .1D * w ELSE x1 END").alias("east"), F.col("y1").alias("north"))
    return conformance.envelope_faults(_shapes(spark, d), boxes)


def small_parts_removed(spark: SparkSession, d: str) -> DataFrame:
    g = _shapes(spark, d).withColumn("rings", G.without_small("rings", 0.95))
    return g.select("area_id", F.size("rings").alias("n_rings"), F.round(G.area("rings"), 6).alias("area"))


def revised_areas(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities after revisions: every sixth retired, the next renamed, and the one after split off anew."""
    s = _suppliers(spark, d)
    op = F.when(_k() % 6 == 0, "retire").when(_k() % 6 == 1, "metadata").when(_k() % 6 == 2, "new")
    id_ = F.when(_k() % 6 == 2, _id("m-new-", "s_suppkey")).otherwise(_id("m-", "s_suppkey"))
    r = s.select(id_.alias("id"), F.lit(1).alias("seq"), op.alias("operation"), F.when(_k() % 6 != 0, _id("Name ", "s_suppkey")).alias("name")).where("operation IS NOT NULL")
    # an earlier revision of the same areas: its retirement stays, whatever is renamed later
    r = r.unionByName(s.where(_k() % 6 == 1).select(_id("m-", "s_suppkey").alias("id"), F.lit(0).alias("seq"), F.lit("retire").alias("operation"), F.lit(None).cast("string").alias("name")))
    return lifecycle.apply_revisions(_munis(spark, d), r).select("id", "name", "lifecycle_status")


def renamed_areas(spark: SparkSession, d: str) -> DataFrame:
    a = _munis(spark, d).select("id", "name", F.array(F.upper("id")).alias("aliases"))
    names = _suppliers(spark, d).where(_k() % 4 == 1).select(_id("m-", "s_suppkey").alias("id"), F.when(_k() % 8 == 1, F.upper(_id("m-", "s_suppkey"))).otherwise(_id("Ville ", "s_suppkey")).alias("new_name"))
    return lifecycle.rename(a, names).select("id", "name", F.array_join("aliases", ",").alias("aliases"))


def edition_row_faults(spark: SparkSession, d: str) -> DataFrame:
    """City slices as the wards of an edition for each municipality; some editions expect one more, or another province."""
    city = X.city_slices(spark, d)
    m = X.municipalities(spark, d).join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    rows = city.join(m, "s_suppkey").select(_id("a-", "c_custkey").alias("id"), _id("e-", "s_suppkey").alias("edition"), F.lit("municipal").alias("layer"), _id("p-", "n_regionkey").alias("province_id"))
    n = city.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))
    e = m.join(n, "s_suppkey").select(_id("e-", "s_suppkey").alias("id"), F.when(_k() % 4 == 0, "federal").otherwise("municipal").alias("layer"), F.array(F.when(_k() % 7 == 0, "p-x").otherwise(_id("p-", "n_regionkey"))).alias("provinces"), F.when(_k() % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("expected_count"))
    return contract.edition_rows(rows, e).select("id", F.array_join("violations", ",").alias("violations"))


def surroundings(spark: SparkSession, d: str) -> DataFrame:
    areas = X.areas(spark, d).where("layer IN ('shared', 'administrative')")
    near = hierarchy.surrounding_counts(areas, areas.where("level = 'municipality'").select("id"))
    return near.where("n_near > 0")


def population_accounts(spark: SparkSession, d: str) -> DataFrame:
    """A crosswalk that forgets every eleventh municipality, has every twentieth twice and one too many."""
    s = _suppliers(spark, d)
    matched = s.where((_k() % 5 != 0) & (_k() % 11 != 0)).select(_id("m-", "s_suppkey").alias("area_id"))
    extra = s.agg((F.max("s_suppkey") + 1).alias("k")).select(_id("m-", "k").alias("area_id"))
    unavailable = s.where(((_k() % 5 == 0) & (_k() % 11 != 0)) | (_k() % 20 == 3)).select(_id("m-", "s_suppkey").alias("area_id"))
    return population.crosswalk_account(_munis(spark, d).select(F.col("id").alias("area_id")), matched.unionByName(extra), unavailable)


def automatic_population_plan(spark: SparkSession, d: str) -> DataFrame:
    """Territories that are unchanged and lose or gain nothing in the transfers of every fiftieth clerk."""
    code = F.substring("area_id", 3, 20).alias("code")
    now = lifecycle.fingerprints(X.municipal_geometry(X.municipalities(spark, d))).select("area_id", code, "fingerprint")
    census = lifecycle.fingerprints(X.municipal_geometry(_eastern(spark, d))).select(code, "fingerprint")
    n = _suppliers(spark, d).count()
    t = X.table(spark, d, "nation").select(F.concat(F.lit("m-"), (F.col("n_nationkey") % n).cast("string")).alias("gain_id"), F.concat(F.lit("m-"), ((F.col("n_nationkey") * 3 + 1) % n).cast("string")).alias("loss_id"))
    return population.automatic_plan(now, census, t)


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as measured corrections, decided one by one and approved by customer."""
    k = F.col("o_orderkey")
    m = X.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("group"), (k % 7).cast("double").alias("overlap_m2"), F.when(k % 3 == 0, 1e-8).otherwise(1e-6).alias("overlap_share"),
        (k % 211).cast("double").alias("changed_m2"), F.when(k % 13 != 0, (k % 17) * 1e-5).alias("changed_share"), (k % 9).cast("double").alias("shift_m"), (k % 4 == 0).alias("proven"),
    )
    return review.joint(review.decide(m)).select("o_orderkey", "decision", F.array_join("reasons", ",").alias("reasons"), "approved")


def changed_probe_answers(spark: SparkSession, d: str) -> DataFrame:
    """Points whose municipalities differ after the eastern borders moved."""

    def direct(m: DataFrame) -> DataFrame:
        hits = cells.cover(X.points(spark, d), X.municipal_geometry(m).where("role = 'assignment'"), "point_id")
        return X.points(spark, d).select("point_id").join(hits.groupBy("point_id").agg(F.array_sort(F.collect_set("area_id")).alias("direct")), "point_id", "left").withColumn("direct", F.coalesce("direct", F.array().cast("array<string>")))

    out = review.changed_answers(direct(X.municipalities(spark, d)), direct(_eastern(spark, d)))
    return out.select("point_id", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


def bundle_choices(spark: SparkSession, d: str) -> DataFrame:
    """Customers prefer their first order's group over the second's; groups with an open order are not ready."""
    o = X.table(spark, d, "orders")
    roots = o.groupBy(F.col("o_custkey").alias("root_id")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    roots = roots.select("root_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("a").alias("group_id")), F.struct(F.lit(2).alias("rank"), F.col("b").alias("group_id")))).alias("x")).select("root_id", "x.group_id", "x.rank")
    members = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), (F.col("l_linestatus") == "O").alias("missing"))
    return catalogue.bundle_plan(roots, o.select(F.col("o_orderkey").alias("group_id")), members)


def group_plan_faults(spark: SparkSession, d: str) -> DataFrame:
    """Orders as groups of their parts, in line order."""
    g = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return catalogue.group_plan_faults(g.select("group_id", F.transform("x", lambda p: p["l_partkey"]).alias("municipality_ids")))


def boundary_features(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities, every fourteenth superseded, with display boundaries for the even ones."""
    a = _munis(spark, d).withColumn("lifecycle_status", F.when(F.substring("id", 3, 20).try_cast("long") % 14 == 0, "superseded").otherwise("current"))
    shown = _suppliers(spark, d).where(_k() % 2 == 0).select(_id("m-", "s_suppkey").alias("area_id"), F.lit("display").alias("role"))
    return release.boundary_features(a, X.municipal_geometry(X.municipalities(spark, d)).select("area_id", "role").unionByName(shown))


def ordered_matches(spark: SparkSession, d: str) -> DataFrame:
    """Federal matches of every point by level, in the order of the request."""
    areas, geometry = lookups._federal(spark, d, "fed-2")
    all_areas = X.areas(spark, d)
    points = X.points(spark, d)
    found = lookup.lookup(points, areas, geometry, hierarchy.ancestors(all_areas))
    out = lookup.ordered_matches(found, all_areas, points.select("point_id", (F.col("point_id") * 3).alias("position")))
    return out.select("point_id", "position", F.array_join("matches", ",").alias("matches"))


def one_way_merges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring municipalities as mergers, against published extents that are whole boxes and reach further east."""
    from pyspark.sql.window import Window

    m = X.municipalities(spark, d).where(SHAPED)
    w = Window.partitionBy("s_nationkey").orderBy("k")
    pairs = m.withColumns({"nk": F.lead("k").over(w), "other": F.lead("s_suppkey").over(w), "ox1": F.lead("x1").over(w)}).where("nk = k + 1")
    rows = pairs.select(_id("s-", "s_suppkey").alias("successor_id"), F.explode(F.array("s_suppkey", "other")).alias("k")).select("successor_id", _id("m-", "k").alias("area_id"))
    members = rows.join(_shapes(spark, d), "area_id").select("successor_id", "area_id", "rings")
    reference = pairs.select(_id("s-", "s_suppkey").alias("area_id"), F.expr(f"array({G.box_rings('x0', 'y0', 'ox1 + .06D * (s_suppkey % 8) * w', 'y1')})").alias("rings"))
    return release.one_way_merge(members, reference).select("successor_id", F.round("share", 6).alias("share"), "accepted")


def audit_ledger(spark: SparkSession, d: str) -> DataFrame:
    """An audit of all suppliers that forgets every eleventh, and has other names, states and no evidence now and then."""
    s = _suppliers(spark, d)
    base = s.select(_id("m-", "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = s.where(_k() % 11 != 0).select(_id("m-", "s_suppkey").alias("id"), F.when(_k() % 13 == 0, "?").otherwise(F.col("s_name")).alias("name"), F.when(_k() % 7 == 0, "done").otherwise("qualified_complete").alias("status"), F.when(_k() % 5 == 0, "").otherwise("minutes").alias("evidence"))
    again = s.where(_k() % 17 == 1).select(_id("m-", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("qualified_partial").alias("status"), F.lit("minutes").alias("evidence"))
    return release.audit_ledger(base, rows.unionByName(again.join(rows.select("id"), "id", "left_semi")))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    areas = _munis(spark, d)
    wards = X.city_slices(spark, d).select(_id("m-", "s_suppkey").alias("authority_id"), (F.col("c_custkey") % 3 != 0).alias("current"))
    declared = X.municipalities(spark, d).where("s_suppkey % 9 = 2").select(_id("m-", "s_suppkey").alias("authority_id"), F.lit("reference").alias("declared"))
    return release.coverage_gaps(editions.municipal_coverage(areas.select(F.col("id").alias("authority_id"), "province_id"), wards, declared), areas)


def issues_listing(spark: SparkSession, d: str) -> DataFrame:
    issue = F.when(F.col("assignment_status") == "missing_geometry", F.array(F.lit("no_geometry"))).otherwise(F.array().cast("array<string>"))
    return release.listing(X.areas(spark, d).withColumn("issues", issue), issues_only=True, query="MUNICIPALITE").select("id", "name")


def review_inventory(spark: SparkSession, d: str) -> DataFrame:
    status = lambda df: df.select("id", F.col("assignment_status").alias("status"))
    areas = X.areas(spark, d)
    disputed = X.municipal_geometry(X.municipalities(spark, d)).where("role = 'review'").select(F.col("area_id").alias("id"), F.lit("boundary_change").alias("status"))
    return release.review_inventory(municipality=status(areas.where("level = 'municipality'")), region=status(areas.where("level = 'region'")), boundary=disputed)


def child_union_approval(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities that are exactly the union of their city slices, by scheme."""
    city = X.city_slices(spark, d)
    kids = X.city_geometry(city).join(city.select(_id("a-", "c_custkey").alias("area_id"), _id("m-", "s_suppkey").alias("parent_id"), F.col("scheme").alias("track")), "area_id")
    out = release.child_union(lifecycle.child_coverage(kids, _shapes(spark, d)), 1e-6)
    return out.select("parent_id", F.col("track").alias("scheme"), "approved")


def sliver_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Extents that moved east against the municipalities as they stand: what may be cut off."""
    _, old, new = lookups._moved(spark, d)
    pairs = cells.box_pairs(new, old).where("a <> b")
    return release.sliver_correction(pairs, new, old, 1e9, 0.151).select("a", "b", F.round("overlap", 6).alias("overlap"), "correctable")


def relationship_evidence(spark: SparkSession, d: str) -> DataFrame:
    """City slices whose eastern border lies a fifth beyond their municipality's."""
    city = X.city_slices(spark, d).withColumn("x1", F.expr("CASE WHEN c_custkey % 2 = 0 THEN x1 + .2D * (x1 - x0) ELSE x1 END"))
    kids = X.city_geometry(city).join(city.select(_id("a-", "c_custkey").alias("area_id"), _id("m-", "s_suppkey").alias("parent_id"), "scheme"), "area_id")
    munis = _shapes(spark, d)
    kids = kids.join(munis.select(F.col("area_id").alias("parent_id")), "parent_id", "left_semi").where("scheme = 'alt'")
    out = release.relationship_evidence(kids, munis, cells.box_pairs(kids, munis), cells.box_pairs(kids, kids), 1e-6)
    return out.select("area_id", F.round("outside", 5).alias("outside"), F.size("others").alias("n_others"), F.size("peers").alias("n_peers"), "reason")


def proof_faults(spark: SparkSession, d: str) -> DataFrame:
    """Approvals made before the eastern borders moved; the inventory lists all but every third."""
    m = X.municipalities(spark, d)
    proofs = lifecycle.fingerprints(X.municipal_geometry(m)).withColumnRenamed("area_id", "id")
    now = lifecycle.fingerprints(X.municipal_geometry(_eastern(spark, d).where("s_suppkey % 15 <> 1")))
    return release.verify_proofs(proofs, now, m.where("s_suppkey % 3 <> 0").select(_id("m-", "s_suppkey").alias("id")))


def ring_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The moved eastern borders as ring repairs of which only those divisible by twenty were pinned, and one in seven in vain."""

    def rings(m: DataFrame) -> DataFrame:
        g = X.municipal_geometry(m).where("role = 'assignment'").select("area_id", F.explode("rings").alias("r"))
        return g.select("area_id", "r.part", "r.ring", F.sha2(F.to_json("r.pts"), 256).alias("digest"))

    pins = X.municipalities(spark, d).where(f"{SHAPED} AND (s_suppkey % 20 = 0 OR s_suppkey % 7 = 1)").select(_id("m-", "s_suppkey").alias("area_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"))
    return release.ring_repair(rings(X.municipalities(spark, d)), rings(_eastern(spark, d)), pins)


def reverified_population(spark: SparkSession, d: str) -> DataFrame:
    """Stored records, of which every tenth was altered, against those computed anew."""
    now = records.population_adjusted(spark, d).select("area_id", "population")
    stored = now.withColumn("population", F.when(F.substring("area_id", 3, 20).try_cast("long") % 10 == 3, F.col("population") + 1).otherwise(F.col("population")))
    return lifecycle.same_rows(stored, now)


def import_state(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer as an import: every twenty-third order has another status than what is stored."""
    o = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new = o.withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 23 = 0 THEN '#' ELSE o_orderstatus END")).where("o_custkey % 10 <> 3")
    return release.import_state(o, new, "o_custkey", "o_orderkey", "o_orderstatus").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def evidence_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as evidence records that name areas with or without prefix, only a province, or nothing."""
    areas = X.areas(spark, d)
    none = F.array().cast("array<string>")
    ids = F.when(_k() % 4 == 0, F.array(_k().cast("string"), _id("g-", "s_nationkey"))).when(_k() % 4 == 1, F.array(F.lit("nowhere"))).otherwise(none)
    rows = _suppliers(spark, d).select(_k().alias("record_id"), ids.alias("ids"), F.when(_k() % 4 != 3, _id("R", "s_nationkey")).alias("province"), F.when(_k() % 2 == 1, F.lit("c")).alias("inherited"))
    provinces = X.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(_id("R", "n_nationkey").alias("province"), _id("p-", "n_regionkey").alias("area_id"))
    return release.infer_scopes(rows, areas, provinces, "m-")


def selected_records(spark: SparkSession, d: str) -> DataFrame:
    """Coverage records of every area as an explicit choice of the second edition shows them for p-1."""
    areas = X.areas(spark, d)
    rows = areas.select(F.col("id").alias("record_id"), "layer", "edition", F.when(F.length("id") % 2 == 0, "default_selection").otherwise("authority_inventory").alias("basis"))
    relations = catalogue.scope_relation(areas.select(F.col("id").alias("record_id"), F.col("id").alias("area_id")), hierarchy.ancestors(areas), "p-1")
    return release.selected_records(rows, relations, "federal", ["fed-2"], explicit=True)


def catalogue_summary(spark: SparkSession, d: str) -> DataFrame:
    return release.summary(X.areas(spark, d)).select("layer", "n", "n_open", F.array_join("limitations", ",").alias("limitations"))


def group_listing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as groups of suppliers; every fiftieth supplier is no root, and some groups have no map."""
    g = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.collect_set(_id("m-", "l_suppkey")).alias("members"))
    roots = _suppliers(spark, d).where(_k() % 50 != 7).select(_id("m-", "s_suppkey").alias("id"))
    maps = X.table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("group_id"), F.when(F.col("o_orderkey") % 2 == 0, "ready").otherwise("too_large").alias("map_status"))
    return release.group_listing(g, roots, maps)


def reproduced_groups(spark: SparkSession, d: str) -> DataFrame:
    """Line items as extracted groups; parts divisible by ten got a new id, which some reviewed lists do not know."""
    li = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("id"))
    li = written(li.repartition(dealt(li), "group_id", "id").distinct(), "groups")
    updates = li.where("id % 10 = 0").select("group_id", F.col("id").alias("previous_id"), (-F.col("id")).alias("current_id"))
    reviewed = li.withColumn("id", F.expr("CASE WHEN id % 10 = 0 AND group_id % 7 <> 0 THEN -id ELSE id END"))
    return release.reproduced_groups(li, updates, reviewed)


def bundle_attributions(spark: SparkSession, d: str) -> DataFrame:
    li = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), contract.attribution(F.col("l_returnflag"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus"))).alias("attribution"))
    return release.attributions(li).select("bundle_id", F.array_join("attributions", "; ").alias("attributions"))


def regional_members(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities by region after every tenth moved to the next nation and every seventh left."""
    s = _suppliers(spark, d)
    before = s.select(_id("m-", "s_suppkey").alias("area_id"), _id("g-", "s_nationkey").alias("region_id"))
    moves = s.where((_k() % 10 == 0) | (_k() % 7 == 0)).select(_id("m-", "s_suppkey").alias("area_id"), F.when(_k() % 10 == 0, F.concat(F.lit("g-"), ((F.col("s_nationkey") + 1) % 25).cast("string"))).alias("region_id"))
    now, _ = lifecycle.move_members(before, moves)
    return release.regional_members(now, X.table(spark, d, "nation").select(_id("g-", "n_nationkey").alias("region_id"))).select("region_id", "n_members", F.array_join("member_ids", ",").alias("members"))


def municipal_totals(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return release.municipal_totals(e.select(_id("p-", "n_regionkey").alias("province_id"), (F.col("c_custkey") % 30).alias("expected_count"), (F.col("c_custkey") % 3 == 0).alias("default")))


def import_guards(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders as a plan, those without a balance as what exists."""
    plan = X.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return release.guard(plan, X.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


def incomplete_responses(spark: SparkSession, d: str) -> DataFrame:
    """Line items by return flag, as a server that reported the orders only."""
    li = X.table(spark, d, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    reported = X.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("reported"))
    return release.complete_responses(li, reported, "l_returnflag", "key")


def migration_faults(spark: SparkSession, d: str) -> DataFrame:
    """A migrated membership that forgot some moves, lost members and has some of its own."""
    s = _suppliers(spark, d)
    m = s.where(_k() % 9 != 0).select(_id("m-", "s_suppkey").alias("area_id"), _id("g-", "s_nationkey").alias("region_id"))
    moves = s.where(_k() % 4 == 0).select(_id("m-", "s_suppkey").alias("area_id"), F.lit("g-x").alias("region_id"))
    got = s.where(_k() % 10 != 1).select(_id("m-", "s_suppkey").alias("area_id"), F.when((_k() % 4 == 0) & (_k() % 3 != 0), "g-x").otherwise(_id("g-", "s_nationkey")).alias("region_id"))
    return release.migration_faults(m, moves, got)


def plan_faults(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a plan of new areas below municipalities; unknown areas, other provinces and repetitions."""
    n = _suppliers(spark, d).count()
    c = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("m-"), (F.col("c_custkey") % (n + 3)).cast("string")).alias("area_id"), F.concat(F.lit("p-"), (F.col("c_custkey") % 6).cast("string")).alias("parent_id"))
    return release.plan_faults(c, X.areas(spark, d)).select("id", F.array_join("violations", ",").alias("violations"))


def province_overview(spark: SparkSession, d: str) -> DataFrame:
    """Provinces and the boxes of their municipalities, moved beyond the antimeridian for the third."""
    m = X.municipalities(spark, d).join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    far = F.when(F.col("n_regionkey") == 3, 360.0).otherwise(0.0)
    boxes = m.where("n_regionkey <> 2").groupBy(_id("p-", "n_regionkey").alias("province_id")).agg(F.min("x0").alias("west"), F.min("y0").alias("south"), F.max(F.col("x1") + far).alias("east"), F.max("y1").alias("north"))
    extra = m.agg(F.min("x0").alias("west"), F.min("y0").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north")).select(F.lit("p-9").alias("province_id"), "*")
    return release.overview(X.table(spark, d, "region").select(_id("p-", "r_regionkey").alias("province_id")), boxes.unionByName(extra))


QUERIES = {
    f.__name__: f
    for f in (
        display_roots, source_identity, layer_visibility, scope_relations, succession_symmetry, approved_changes, count_mismatches, rule_selection, source_record_faults, symmetric_difference, retraced_edges,
        boundary_equality, hole_components, corridor_distances, envelope_violations, small_parts_removed, revised_areas, renamed_areas, edition_row_faults, surroundings, population_accounts,
        automatic_population_plan, review_decisions, changed_probe_answers, bundle_choices, group_plan_faults, boundary_features, ordered_matches, one_way_merges, audit_ledger, coverage_gaps, issues_listing,
        review_inventory, child_union_approval, sliver_corrections, relationship_evidence, proof_faults, ring_repairs, reverified_population, import_state, evidence_scopes, selected_records, catalogue_summary,
        group_listing, reproduced_groups, bundle_attributions, regional_members, municipal_totals, import_guards, incomplete_responses, migration_faults, plan_faults, province_overview,
    )
}

_S = "shape IN ('plain','hole','multipart')"
_M2 = "muni2 AS (SELECT * REPLACE (CASE WHEN s_suppkey%10=0 THEN x1-.05e0*w ELSE x1 END AS x1) FROM muni)"
_WARDS = "w AS (SELECT s_suppkey, count(*) FILTER (c_custkey%3<>0) AS n_current, count(*) FILTER (c_custkey%3=0) AS n_historical FROM city GROUP BY 1)"
_FAULTS = lambda **checks: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in checks.items()) + ")"

ORACLES = {
    "display_roots": f"WITH {AREAS} SELECT id FROM areas WHERE level IN ('municipality','region')",
    "source_identity": "SELECT c_custkey, CASE WHEN c_custkey%4<>0 THEN CAST(c_custkey AS VARCHAR) ELSE 'name-'||c_name END AS identity FROM customer",
    "layer_visibility": f"WITH {AREAS} SELECT id, level FROM areas WHERE layer='municipal' OR level IN ('country','province','municipality','region')",
    "scope_relations": f"WITH RECURSIVE {AREAS}, {CLOSURE} SELECT 'r-'||id AS record_id, CASE WHEN id='p-1' THEN 'direct' WHEN id='c' THEN 'inherited' ELSE 'descendant' END AS relation FROM areas WHERE id IN ('p-1','c') OR id IN (SELECT id FROM anc WHERE ancestor_id='p-1')",
    "succession_symmetry": """WITH u AS (SELECT 's-'||s_suppkey AS new, 'm-'||(s_suppkey+o) AS old FROM supplier, range(2) r(o) WHERE s_suppkey%2=0), d AS (SELECT 's-'||(s_suppkey-s_suppkey%2) AS new, 'm-'||s_suppkey AS old FROM supplier WHERE s_suppkey%7<>0)
      SELECT coalesce(u.new,d.new) AS new, coalesce(u.old,d.old) AS old, CASE WHEN u.new IS NULL THEN 'successor_only' ELSE 'predecessor_only' END AS fault FROM u FULL JOIN d ON u.new=d.new AND u.old=d.old WHERE u.new IS NULL OR d.new IS NULL""",
    "approved_changes": f"SELECT * FROM ({records.ORACLES['release_diff']}) WHERE NOT (change='changed' AND columns='o_orderstatus' AND o_orderkey%3=0)",
    "count_mismatches": "WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, 15*count(*) AS expected FROM supplier GROUP BY 1) SELECT nation, coalesce(expected,0) AS expected, coalesce(n,0) AS n FROM s FULL JOIN c USING(nation) WHERE coalesce(expected,0)<>coalesce(n,0)",
    "rule_selection": "SELECT 'e1' AS edition, c_custkey AS row_id FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey IN (1,2,3) UNION ALL SELECT 'e2', c_custkey FROM customer WHERE c_mktsegment='FURNITURE'",
    "source_record_faults": "SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey%9=0 THEN 'division_prefix,province_prefix' END, CASE WHEN s_suppkey%10=0 THEN 'label' END) AS violations FROM supplier WHERE s_suppkey%9=0 OR s_suppkey%10=0",
    "symmetric_difference": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, {MOVED_BOXES} SELECT area_id, round(2e0*(a-i),6) AS area FROM kept WHERE a-i>1e-9""",
    "retraced_edges": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, x1 AS ax, y1 AS ay, x1 AS bx, y1+1e0 AS \"by\" FROM muni WHERE shape='plain' AND s_suppkey%2=0",
    "boundary_equality": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, s_suppkey%10<>0 AS same FROM muni WHERE {_S}",
    "hole_components": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, 0 AS part, 1 AS ring, s_suppkey%2=0 AS matched FROM muni WHERE shape='hole'",
    "corridor_distances": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, round(.05e0*w*(s_suppkey%8),6) AS distance FROM muni WHERE {_S}",
    "envelope_violations": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, CAST(2 AS BIGINT) AS n FROM muni WHERE {_S} AND s_suppkey%5=0",
    "small_parts_removed": f"""WITH muni AS ({MUNI}), r AS (SELECT s_suppkey, CASE shape WHEN 'multipart' THEN 5e0*w ELSE 8e0*w END AS body, CASE shape WHEN 'multipart' THEN .2e0*w ELSE 0e0 END AS part, CASE shape WHEN 'hole' THEN w ELSE 0e0 END AS hole FROM muni WHERE {_S}),
      k AS (SELECT *, body>=.95e0 AS b, part>=.95e0 AS p, hole>=.95e0 AND body>=.95e0 AS h FROM r)
      SELECT 'm-'||s_suppkey AS area_id, CAST(b AS INT)+CAST(p AS INT)+CAST(h AS INT) AS n_rings, round(CASE WHEN b THEN body ELSE 0e0 END+CASE WHEN p THEN part ELSE 0e0 END-CASE WHEN h THEN hole ELSE 0e0 END,6) AS area FROM k""",
    "revised_areas": """SELECT 'm-'||s_suppkey AS id, CASE WHEN s_suppkey%6=1 THEN 'Name '||s_suppkey ELSE 'Municipalité '||s_suppkey END AS name, CASE WHEN s_suppkey%6<2 THEN 'superseded' ELSE 'current' END AS lifecycle_status FROM supplier
      UNION ALL SELECT 'm-new-'||s_suppkey, 'Name '||s_suppkey, 'current' FROM supplier WHERE s_suppkey%6=2""",
    "renamed_areas": """SELECT 'm-'||s_suppkey AS id, CASE WHEN s_suppkey%8=1 THEN 'M-'||s_suppkey WHEN s_suppkey%4=1 THEN 'Ville '||s_suppkey ELSE 'Municipalité '||s_suppkey END AS name,
      CASE WHEN s_suppkey%8=1 THEN 'Municipalité '||s_suppkey WHEN s_suppkey%4=1 THEN 'M-'||s_suppkey||',Municipalité '||s_suppkey ELSE 'M-'||s_suppkey END AS aliases FROM supplier""",
    "edition_row_faults": f"""WITH muni AS ({MUNI}), city AS ({X.CITY.format(customer='customer', muni='muni')}), r AS (SELECT 'a-'||c_custkey AS id, {_FAULTS(layer="s_suppkey%4<>0", province="s_suppkey%7<>0", count="s_suppkey%5<>0")} AS violations FROM city)
      SELECT * FROM r WHERE violations<>''""",
    "surroundings": f"""WITH RECURSIVE {AREAS}, {CLOSURE}, adm AS (SELECT * FROM areas WHERE layer IN ('shared','administrative')), chain AS (SELECT id, ancestor_id AS step FROM anc UNION ALL SELECT id, id FROM areas)
      SELECT c.id, count(DISTINCT o.id) AS n_near FROM chain c JOIN adm m ON m.id=c.id AND m.level='municipality' JOIN adm s ON s.id=c.step JOIN adm o ON o.parent_id=s.parent_id AND coalesce(o.scheme,'default')=coalesce(s.scheme,'default') AND o.id<>c.step GROUP BY 1""",
    "population_accounts": """WITH r AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey%5<>0 AND s_suppkey%11<>0 UNION ALL SELECT max(s_suppkey)+1 FROM supplier UNION ALL SELECT s_suppkey FROM supplier WHERE (s_suppkey%5=0 AND s_suppkey%11<>0) OR s_suppkey%20=3), n AS (SELECT k, count(*) AS n FROM r GROUP BY 1)
      SELECT 'm-'||coalesce(s_suppkey,k) AS area_id, CASE WHEN s_suppkey IS NULL THEN 'not_active' WHEN n IS NULL THEN 'not_accounted' ELSE 'accounted_twice' END AS fault FROM supplier FULL JOIN n ON k=s_suppkey WHERE s_suppkey IS NULL OR n IS NULL OR n>1""",
    "automatic_population_plan": f"""WITH muni AS ({MUNI}), n AS (SELECT count(*) AS n FROM supplier), t AS (SELECT n_nationkey%n AS k FROM nation, n UNION SELECT (n_nationkey*3+1)%n FROM nation, n)
      SELECT 'm-'||s_suppkey AS area_id, CAST(s_suppkey AS VARCHAR) AS code, 'unchanged_territory' AS basis FROM muni WHERE shape<>'unknown' AND s_suppkey%10<>0 AND s_suppkey NOT IN (SELECT k FROM t)""",
    "review_decisions": """WITH m AS (SELECT o_orderkey, o_custkey, o_orderkey%7<=1 AND o_orderkey%3=0 AS small, concat_ws(',', CASE WHEN o_orderkey%211>CASE WHEN o_orderkey%4=0 THEN 6000 ELSE 100 END THEN 'changed_area' END, CASE WHEN o_orderkey%13=0 OR (o_orderkey%17)*1e-5>1e-4 THEN 'changed_share' END, CASE WHEN o_orderkey%9>5 THEN 'shift' END) AS reasons FROM orders),
      r AS (SELECT o_orderkey, o_custkey, CASE WHEN small THEN 'topology_only' WHEN reasons='' THEN 'minor_correction' ELSE 'keep_review' END AS decision, CASE WHEN small THEN '' ELSE reasons END AS reasons FROM m)
      SELECT o_orderkey, decision, reasons, bool_and(decision<>'keep_review') OVER (PARTITION BY o_custkey) AS approved FROM r""",
    "changed_probe_answers": f"""{BASE}, {_M2}, a AS (SELECT event_id, string_agg('m-'||s_suppkey, ',' ORDER BY 'm-'||s_suppkey) AS ids FROM pts, muni WHERE {IN_MUNI} GROUP BY 1), b AS (SELECT event_id, string_agg('m-'||s_suppkey, ',' ORDER BY 'm-'||s_suppkey) AS ids FROM pts, muni2 WHERE {IN_MUNI} GROUP BY 1)
      SELECT event_id AS point_id, coalesce(a.ids,'') AS old, coalesce(b.ids,'') AS new FROM a FULL JOIN b USING(event_id) WHERE coalesce(a.ids,'')<>coalesce(b.ids,'')""",
    "bundle_choices": """WITH r AS (SELECT o_custkey AS root_id, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1), ok AS (SELECT l_orderkey AS g FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linestatus='O') AND l_orderkey IN (SELECT o_orderkey FROM orders))
      SELECT root_id, CASE WHEN a IN (SELECT g FROM ok) THEN a WHEN b IN (SELECT g FROM ok) THEN b END AS group_id FROM r""",
    "group_plan_faults": """WITH g AS (SELECT l_orderkey AS group_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS m FROM lineitem GROUP BY 1), t AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey)>1)
      SELECT group_id, 'not_sorted_unique' AS fault FROM g WHERE m<>list_sort(list_distinct(m)) UNION ALL SELECT DISTINCT l_orderkey, 'shared_member' FROM lineitem JOIN t USING(l_partkey)""",
    "boundary_features": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS id, 'full' AS resolution, s_suppkey%14<>0 AS suitable FROM muni WHERE {_S} UNION ALL SELECT 'm-'||s_suppkey, 'display', false FROM supplier WHERE s_suppkey%2=0",
    "ordered_matches": f"""{BASE}, hit AS (SELECT event_id, id, i FROM pts, ({GRID['fed-2']}) g WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), m AS (SELECT DISTINCT event_id, 0 AS r, 'c' AS id FROM hit UNION SELECT event_id, 1, 'p-'||(i%5) FROM hit UNION SELECT event_id, 5, id FROM hit)
      SELECT event_id AS point_id, event_id*3 AS position, coalesce(string_agg(id, ',' ORDER BY r, id), '') AS matches FROM pts LEFT JOIN m USING(event_id) GROUP BY event_id""",
    "one_way_merges": f"""WITH muni AS ({MUNI}), p AS (SELECT s_suppkey, k, w, CASE shape WHEN 'plain' THEN 8e0*w WHEN 'hole' THEN 7e0*w ELSE 5.2e0*w END AS a, lead(k) OVER o AS nk, lead(w) OVER o AS ow, lead(CASE shape WHEN 'plain' THEN 8e0*w WHEN 'hole' THEN 7e0*w ELSE 5.2e0*w END) OVER o AS oa FROM muni WHERE {_S} WINDOW o AS (PARTITION BY s_nationkey ORDER BY k)),
      s AS (SELECT s_suppkey, (a+oa)/(8e0*(w+ow+.06e0*(s_suppkey%8)*w)) AS v FROM p WHERE nk=k+1) SELECT 's-'||s_suppkey AS successor_id, round(v,6) AS share, round(v,9)>=.9e0 AS accepted FROM s""",
    "audit_ledger": f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey%11<>0 AS there, s_suppkey%17=1 AS again FROM supplier), f AS (SELECT 'm-'||k AS id, unnest(string_split({_FAULTS(audited_once="there AND NOT again", name="NOT there OR k%13<>0 OR again AND '?'>'S'", status="NOT there OR k%7<>0 OR again AND 'done'>'qualified_partial'", evidence="NOT there OR k%5<>0")}, ',')) AS fault FROM s)
      SELECT id, fault FROM f WHERE fault<>''""",
    "coverage_gaps": f"""WITH {AREAS}, {_WARDS}, c AS (SELECT province_id, CASE WHEN m.s_suppkey%9=2 THEN 'reference' WHEN coalesce(n_current,0)>0 THEN 'included' WHEN coalesce(n_historical,0)>0 THEN 'historical_only' ELSE 'unverified' END AS s, st FROM muni m JOIN areas ON id='m-'||m.s_suppkey LEFT JOIN w ON w.s_suppkey=m.s_suppkey)
      SELECT province_id, count(*) FILTER (s<>'included') AS n_gaps, count(*) FILTER (st<>'validated_source') AS n_pending FROM c GROUP BY 1 HAVING n_gaps+n_pending>0""",
    "issues_listing": f"WITH {AREAS} SELECT id, name FROM areas WHERE st='missing_geometry' AND level='municipality'",
    "review_inventory": f"WITH {AREAS} SELECT 'municipality' AS \"table\", id, st AS status FROM areas WHERE level='municipality' AND st<>'validated_source' UNION ALL SELECT 'boundary', 'm-'||s_suppkey, 'boundary_change' FROM muni WHERE s_suppkey%19=6 AND {_S}",
    "child_union_approval": f"WITH muni AS ({MUNI}), city AS ({X.CITY.format(customer='customer', muni='muni')}) SELECT DISTINCT 'm-'||s_suppkey AS parent_id, scheme, shape='plain' AS approved FROM city JOIN (SELECT s_suppkey, shape FROM muni WHERE {_S}) m USING(s_suppkey)",
    "sliver_corrections": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, {MOVED_BOXES}, p AS (SELECT n.area_id AS a, o.area_id AS b, sum(n.sgn*o.sgn*greatest(0e0, least(n.bx1,o.bx1)-greatest(n.bx0,o.bx0))*greatest(0e0, least(n.by1,o.by1)-greatest(n.by0,o.by0))) AS v FROM moved n JOIN boxes o ON n.area_id<>o.area_id GROUP BY 1,2)
      SELECT p.a, b, round(v,6) AS overlap, v<=.151e0*kept.a AS correctable FROM p JOIN kept ON kept.area_id=p.a WHERE v>1e-9""",
    "relationship_evidence": f"""WITH muni AS ({MUNI}), {MUNI_BOXES}, city AS ({X.CITY.format(customer='customer', muni='muni')}), k AS (SELECT 'a-'||c_custkey AS a, s_suppkey, x0, CASE WHEN c_custkey%2=0 THEN x1+.2e0*(x1-x0) ELSE x1 END AS x1, cy0 AS y0, cy1 AS y1 FROM city WHERE scheme='alt' AND s_suppkey IN (SELECT s_suppkey FROM muni WHERE {_S})),
      o AS (SELECT a, area_id, sum({SHARED}) AS v, 'm-'||k.s_suppkey AS own, max((x1-x0)*(y1-y0)) AS area FROM k, boxes WHERE bx0<x1 AND x0<bx1 AND by0<y1 AND y0<by1 GROUP BY ALL), e AS (SELECT k.a, (k.x1-k.x0)*(k.y1-k.y0)-coalesce(max(v) FILTER (area_id=own),0) AS outside, count(*) FILTER (area_id<>own AND v>1e-6) AS n_others FROM k LEFT JOIN o ON o.a=k.a GROUP BY k.a, k.x0, k.x1, k.y0, k.y1),
      p AS (SELECT k.a, count(*) AS n_peers, bool_or(q.x0>=k.x0 AND q.x1<=k.x1 AND q.y0>=k.y0 AND q.y1<=k.y1 OR k.x0>=q.x0 AND k.x1<=q.x1 AND k.y0>=q.y0 AND k.y1<=q.y1) AS inn FROM k JOIN k q ON k.a<>q.a AND (least(k.x1,q.x1)-greatest(k.x0,q.x0))>0 AND (least(k.y1,q.y1)-greatest(k.y0,q.y0))>0 AND (least(k.x1,q.x1)-greatest(k.x0,q.x0))*(least(k.y1,q.y1)-greatest(k.y0,q.y0))>1e-6 GROUP BY 1)
      SELECT a AS area_id, round(greatest(outside,0),5) AS outside, CAST(n_others AS INT) AS n_others, CAST(coalesce(n_peers,0) AS INT) AS n_peers, CASE WHEN n_others>0 THEN 'parent_extent_crosses_other_municipalities' WHEN outside>1e-6 THEN 'parent_extent_unmatched_requires_source_reconciliation' WHEN inn THEN 'contained_peer_requires_semantic_hierarchy' WHEN n_peers>0 THEN 'peer_overlap_requires_ownership_evidence' END AS reason FROM e LEFT JOIN p USING(a)""",
    "proof_faults": f"WITH muni AS ({MUNI}), f AS (SELECT 'm-'||s_suppkey AS id, CASE WHEN s_suppkey%15=1 THEN 'no_geometry' WHEN s_suppkey%10=0 THEN 'changed' WHEN s_suppkey%3=0 THEN 'not_in_inventory' END AS fault FROM muni WHERE shape<>'unknown') SELECT * FROM f WHERE fault IS NOT NULL",
    "ring_repairs": f"WITH muni AS ({MUNI}) SELECT 'm-'||s_suppkey AS area_id, 'other_ring_changed' AS fault FROM muni WHERE {_S} AND s_suppkey%10=0 AND NOT (s_suppkey%20=0 OR s_suppkey%7=1) UNION ALL SELECT 'm-'||s_suppkey, 'ring_not_changed' FROM muni WHERE {_S} AND (s_suppkey%20=0 OR s_suppkey%7=1) AND s_suppkey%10<>0",
    "reverified_population": f"WITH {ADJUSTED}, x AS (SELECT area_id, population FROM adj WHERE population IS NOT NULL AND s_suppkey%10=3) SELECT area_id, population+1 AS population, 'left' AS side FROM x UNION ALL SELECT area_id, population, 'right' FROM x",
    "import_state": "WITH c AS (SELECT o_custkey, CASE WHEN o_custkey%10=3 THEN 'gone' WHEN bool_or(o_orderkey%23=0 AND o_orderstatus<>'#') THEN 'changed' ELSE 'unchanged' END AS state FROM orders GROUP BY 1) SELECT state, count(*) AS n FROM c GROUP BY 1",
    "evidence_scopes": """WITH r AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), own AS (SELECT k, 'm-'||k AS a FROM r WHERE k%4=0 UNION ALL SELECT k, 'g-'||n FROM r WHERE k%4=0 AND n%6<>5)
      SELECT k AS record_id, a AS area_id FROM own UNION ALL SELECT k, coalesce(CASE WHEN k%4<>3 AND n%2=0 THEN 'p-'||n_regionkey END, CASE WHEN k%2=1 THEN 'c' END) AS a FROM r JOIN nation ON n_nationkey=n WHERE k%4<>0 AND a IS NOT NULL""",
    "selected_records": f"WITH RECURSIVE {AREAS}, {CLOSURE} SELECT id AS record_id, 'descendant' AS relation, edition, 'authority_inventory' AS basis FROM areas WHERE layer='federal' AND edition='fed-2' AND length(id)%2=1 AND id IN (SELECT id FROM anc WHERE ancestor_id='p-1')",
    "catalogue_summary": f"""WITH {AREAS}, g AS (SELECT layer, count(*) AS n, count(*) FILTER (st='missing_geometry') AS a, count(*) FILTER (st='unreviewed_repair') AS b, count(*) FILTER (life<>'current') AS c FROM areas GROUP BY 1)
      SELECT layer, n, a+b AS n_open, concat_ws(',', CASE WHEN a>0 THEN 'missing_geometry' END, CASE WHEN b>0 THEN 'unreviewed_repair' END, CASE WHEN c>0 THEN 'holds_history' END) AS limitations FROM g""",
    "group_listing": """WITH m AS (SELECT l_orderkey AS g, 'm-'||l_suppkey AS id, max(CASE WHEN s_suppkey IS NULL OR s_suppkey%50=7 THEN 1 ELSE 0 END) AS miss FROM lineitem LEFT JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1,2), s AS (SELECT g, sum(miss) AS n, min(id) AS first FROM m GROUP BY 1),
      r AS (SELECT g, n, first, CASE WHEN g%3<>0 AND o_orderkey IS NOT NULL THEN CASE WHEN g%2=0 THEN 'ready' ELSE 'too_large' END ELSE 'unsupported' END AS map_status FROM s LEFT JOIN orders ON o_orderkey=g)
      SELECT g AS group_id, CASE WHEN n>0 THEN 'unresolved' ELSE 'complete' END AS membership, CAST(n AS BIGINT) AS n_missing, CASE WHEN n=0 AND map_status<>'unsupported' THEN first END AS anchor, map_status FROM r""",
    "reproduced_groups": "WITH g AS (SELECT DISTINCT l_orderkey AS group_id FROM lineitem WHERE l_partkey%10=0 AND l_partkey<>0 AND l_orderkey%7=0) SELECT group_id, 'not_reviewed' AS fault FROM g UNION ALL SELECT group_id, 'not_extracted' FROM g",
    "bundle_attributions": "WITH a AS (SELECT DISTINCT l_orderkey AS g, 'Contains information from '||l_returnflag||CASE WHEN l_linenumber%2=0 THEN ', '||l_linestatus ELSE '' END AS t FROM lineitem) SELECT g AS bundle_id, string_agg(t, '; ' ORDER BY t) AS attributions FROM a GROUP BY 1",
    "regional_members": """WITH m AS (SELECT 'm-'||s_suppkey AS id, CASE WHEN s_suppkey%10=0 THEN 'g-'||((s_nationkey+1)%25) WHEN s_suppkey%7=0 THEN NULL ELSE 'g-'||s_nationkey END AS r FROM supplier)
      SELECT 'g-'||n_nationkey AS region_id, count(id) AS n_members, coalesce(string_agg(id, ',' ORDER BY id), '') AS members FROM nation LEFT JOIN m ON r='g-'||n_nationkey GROUP BY 1""",
    "municipal_totals": "SELECT 'p-'||n_regionkey AS province_id, count(*) AS editions, CAST(sum(c_custkey%30) AS BIGINT) AS all_districts, CAST(coalesce(sum(c_custkey%30) FILTER (c_custkey%3=0),0) AS BIGINT) AS default_districts FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1",
    "import_guards": "SELECT DISTINCT c_custkey AS id, 'exists' AS fault FROM customer JOIN orders ON o_custkey=c_custkey WHERE c_acctbal<0",
    "incomplete_responses": """WITH g AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS reported, count(*) AS n, count(DISTINCT l_orderkey||'-'||l_linenumber) AS u FROM lineitem GROUP BY 1)
      SELECT l_returnflag, reported, n, CASE WHEN n<>reported THEN 'incomplete' ELSE 'repeated_ids' END AS fault FROM g WHERE n<>reported OR n<>u""",
    "migration_faults": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey%4=0 THEN 'g-x' WHEN s_suppkey%9<>0 THEN 'g-'||s_nationkey END AS want, CASE WHEN s_suppkey%10=1 THEN NULL WHEN s_suppkey%4=0 AND s_suppkey%3<>0 THEN 'g-x' ELSE 'g-'||s_nationkey END AS got FROM supplier)
      SELECT 'm-'||k AS area_id, CASE WHEN want IS NULL THEN 'unexpected' WHEN got IS NULL THEN 'lost' ELSE 'other_region' END AS fault FROM s WHERE want IS DISTINCT FROM got""",
    "plan_faults": f"""WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT c_custkey, c_custkey%(n+3) AS k, c_custkey%6 AS p, count(*) OVER (PARTITION BY c_custkey%(n+3)) AS times FROM customer, n), j AS (SELECT c_custkey, p, r_regionkey, n_regionkey, times FROM c LEFT JOIN supplier ON s_suppkey=k LEFT JOIN nation ON n_nationkey=s_nationkey LEFT JOIN region ON r_regionkey=p),
      r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, {_FAULTS(known="n_regionkey IS NOT NULL", parent="r_regionkey IS NOT NULL", province="n_regionkey IS NOT DISTINCT FROM r_regionkey", once="times=1")} AS violations FROM j) SELECT * FROM r WHERE violations<>''""",
    "province_overview": f"""WITH muni AS ({MUNI}), has AS (SELECT DISTINCT n_regionkey AS r FROM muni JOIN nation ON n_nationkey=s_nationkey WHERE n_regionkey<>2) SELECT 'p-'||r_regionkey AS province_id, 'shown' AS fault FROM region WHERE r_regionkey NOT IN (SELECT r FROM has)
      UNION ALL SELECT 'p-3', 'extent' FROM has WHERE r=3 UNION ALL SELECT 'p-9', 'known'""",
}
