"""What a release has to prove: guards, ledgers, proofs, listings and features handed to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.functions.text import fold_text
from areaframe.operators.contract import violations
from areaframe.operators.arrangement import region_polygons
from areaframe.operators.overlay import overlay_areas, unproven
from areaframe.sources.workspace import dealt

# The states that a municipal audit may report, those of settled areas, and the
# least share of a published extent that its predecessors must cover.
AUDIT_STATES = ["qualified_complete", "qualified_partial", "missing_boundary", "source_blocked", "no_qualifying_source_found", "pending_municipal_site_review"]
SETTLED = ["validated_source", "validated_derived"]
LEAST_MERGED = 0.90

def _ids() -> Column:
    return F.array().cast("array<string>")


def display_roots(areas: DataFrame) -> DataFrame:
    """Areas that may head a display: current municipalities and regions of the administrative layer."""
    return areas.where("level IN ('municipality', 'region') AND layer = 'administrative' AND lifecycle_status <> 'superseded'")


def boundary_features(areas: DataFrame, geometry: DataFrame) -> DataFrame:
    """id, resolution, suitable: the boundaries that can be fetched, and whether they may assign points.

    Only full assignment geometry of areas that are not superseded is suitable.
    """
    g = geometry.where("role IN ('assignment', 'display')").select(F.col("area_id").alias("id"), F.when(F.col("role") == "assignment", "full").otherwise("display").alias("resolution"))
    j = areas.select("id", "lifecycle_status").join(g, "id")
    return j.select("id", "resolution", ((F.col("resolution") == "full") & (F.col("lifecycle_status") != "superseded")).alias("suitable"))


def complete_responses(rows: DataFrame, reported: DataFrame, source: str, key: str) -> DataFrame:
    """Layers (``source``) whose rows are not as many, or not as distinct, as the server reported (``reported``)."""
    got = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_ids"))
    j = reported.join(got, source, "full").na.fill(0, ["reported", "n", "n_ids"])
    fault = F.when(F.col("n") != F.col("reported"), "incomplete").when(F.col("n") != F.col("n_ids"), "repeated_ids")
    return j.select(source, "reported", "n", fault.alias("fault")).where("fault IS NOT NULL")


def guard(plan: DataFrame, existing: DataFrame, id_: str = "id") -> DataFrame:
    """Ids of a plan that exist already; an import needs this to be empty."""
    return plan.select(id_).intersect(existing.select(id_)).withColumn("fault", F.lit("exists"))


def one_way_merge(members: DataFrame, reference: DataFrame, least: float = LEAST_MERGED) -> DataFrame:
    """Mergers (successor_id, area_id, rings) against published extents: successor_id, share, accepted.

    Only the share of the published extent that the predecessors cover counts; what they hold
    beyond it does not.
    """
    r = reference.select(F.col("area_id").alias("successor_id"))
    pairs = members.join(r, "successor_id", "left_semi").select(F.col("area_id").alias("a"), F.col("successor_id").alias("b"))
    o = overlay_areas(pairs, members.select("area_id", "rings").dropDuplicates(["area_id"]), reference)  # an area may be in several plans
    share = F.try_divide(F.sum("intersection"), F.first("area_b"))
    return o.groupBy(F.col("b").alias("successor_id")).agg(share.alias("share")).withColumn("accepted", F.coalesce(F.round("share", 9) >= least, F.lit(False)))


def audit_ledger(baseline: DataFrame, audited: DataFrame, complete: bool = False) -> DataFrame:
    """id, fault: every baseline area (id, name) is audited (id, name, status, evidence) once, with a known state."""
    rows = audited.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("a_name"), F.min("status").alias("status"), F.min("evidence").alias("evidence"))
    j = baseline.select("id", "name", F.lit(True).alias("known")).join(rows, "id", "full")
    checks = violations(
        known=F.col("known"),
        audited_once=F.col("n") == 1,
        name=F.col("n").isNull() | (F.col("a_name") == F.col("name")),
        status=F.col("n").isNull() | F.col("status").isin(AUDIT_STATES),
        evidence=F.col("n").isNull() | (F.length("evidence") > 0),
        finished=F.lit(not complete) | (F.col("status") != "pending_municipal_site_review"),
    )
    return j.select("id", F.explode(checks).alias("fault"))


def coverage_gaps(cover: DataFrame, areas: DataFrame, within: DataFrame | None = None, editions: list[str] | None = None) -> DataFrame:
    """province_id, n_gaps, n_pending: what is partial, historical or unknown, and areas that are not settled.

    ``within`` (province_id) narrows both to a scope; ``editions`` narrows areas of editions to those chosen.
    """
    if within is not None:
        cover, areas = (df.join(within.select("province_id").distinct().hint("merge"), "province_id", "left_semi") for df in (cover, areas))
    if editions is not None:
        areas = areas.where(F.col("edition").isNull() | F.col("edition").isin(editions))
    gaps = cover.where(~F.col("status").isin("included")).groupBy("province_id").agg(F.count(F.lit(1)).alias("n_gaps"))
    pending = areas.where(~F.col("assignment_status").isin(*SETTLED, "hierarchy_only")).groupBy("province_id").agg(F.count(F.lit(1)).alias("n_pending"))
    return gaps.join(pending, "province_id", "full").na.fill(0, ["n_gaps", "n_pending"])


def listing(areas: DataFrame, issues_only: bool = False, query: str = "") -> DataFrame:
    """Rows with issues, and with a text in their folded name."""
    out = areas.where(F.size("issues") > 0) if issues_only else areas
    return out.where(F.contains(fold_text("name"), fold_text(F.lit(query)))) if query else out


def review_inventory(**tables: DataFrame) -> DataFrame:
    """table, id, status of all rows (id, status) that are not approved, over all tables."""
    out = None
    for name, df in sorted(tables.items()):
        rows = df.where(~F.coalesce(F.col("status").isin(*SETTLED, "hierarchy_only"), F.lit(False))).select(F.lit(name).alias("table"), "id", "status")
        out = rows if out is None else out.unionByName(rows)
    return out


def child_union(coverage: DataFrame, least: float = 1e-9) -> DataFrame:
    """parent_id, track, approved: whether the children are exactly the parent, from lifecycle.child_coverage."""
    same = (F.abs("uncovered") <= least) & (F.abs("outside") <= least)
    return coverage.select("parent_id", "track", F.coalesce(same, F.lit(False)).alias("approved"))


def sliver_correction(pairs: DataFrame, candidates: DataFrame, assigned: DataFrame, most: float, share: float) -> DataFrame:
    """a, b, overlap, correctable: overlaps of candidates with assigned areas that are mere slivers and may be cut off."""
    o = overlay_areas(pairs, candidates, assigned).where("intersection > 1e-9")
    return o.select("a", "b", F.col("intersection").alias("overlap"), ((F.col("intersection") <= most) & (F.col("intersection") <= share * F.col("area_a"))).alias("correctable"))


def cut_slivers(slivers: DataFrame, candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """area_id, rings, area: candidates (area_id, rings) without the correctable overlaps (a, b, correctable) of ``sliver_correction``.

    A candidate with an overlap that may not be cut stays as it is and gets no row.
    """
    whole = slivers.groupBy("a").agg(F.bool_and("correctable").alias("all")).where("all").select("a")
    pairs = slivers.join(whole.hint("merge"), "a", "left_semi").select("a", "b")
    own = candidates.select(F.col("area_id").alias("a"), "rings").join(whole.hint("merge"), "a", "left_semi")
    others = pairs.join(assigned.select(F.col("area_id").alias("b"), "rings").hint("merge"), "b").select("a", "rings")
    sides = own.select("a", F.lit("A").alias("side"), "rings").unionByName(others.select("a", F.lit("B").alias("side"), "rings"))
    out = region_polygons(sides, ["a"], "difference")
    return out.select(F.col("a").alias("area_id"), "rings", G.area("rings").alias("area"))


def migration_proofs(predecessors: DataFrame, successors: DataFrame) -> DataFrame:
    """successor_id, proven, differs: whether a successor (area_id, rings) covers exactly what its predecessors (successor_id, rings) cover together.

    Both are cut at each other first, so neither has to have the other's vertices; ``differs`` is the area
    that only one of them covers.
    """
    s = successors.select(F.col("area_id").alias("successor_id"), "rings")
    diff = unproven(s, predecessors.select("successor_id", "rings"), ["successor_id"])
    ids = s.select("successor_id").unionByName(predecessors.select("successor_id")).distinct()
    j = ids.join(diff.hint("merge"), "successor_id", "left")
    return j.select("successor_id", F.col("area").isNull().alias("proven"), F.coalesce("area", F.lit(0.0)).alias("differs"))


def relationship_evidence(candidates: DataFrame, parents: DataFrame, others: DataFrame, peers: DataFrame, least: float = 1e-9) -> DataFrame:
    """area_id, outside, others, peers, reason: what a candidate (area_id, parent_id, rings) shares with whom.

    ``others`` and ``peers`` are pairs (a, b) that may meet, with the areas of the second table in
    ``parents`` and ``candidates``; its own parent and itself are left out.
    """
    own = candidates.select(F.col("area_id").alias("a"), F.col("parent_id").alias("b"))
    outside = overlay_areas(own, candidates, parents).select(F.col("a").alias("area_id"), F.greatest("outside_a", F.lit(0.0)).alias("outside"))
    met = others.join(own, ["a", "b"], "left_anti")
    o = overlay_areas(met, candidates, parents).where(F.col("intersection") > least).groupBy(F.col("a").alias("area_id")).agg(F.array_sort(F.collect_set("b")).alias("others"))
    p = overlay_areas(peers.where("a <> b"), candidates, candidates).where(F.col("intersection") > least)
    within = (F.col("outside_a") <= least) | (F.col("outside_b") <= least)
    p = p.groupBy(F.col("a").alias("area_id")).agg(F.array_sort(F.collect_set("b")).alias("peers"), F.bool_or(within).alias("contained"))
    j = candidates.select("area_id").join(outside, "area_id", "left").join(o, "area_id", "left").join(p, "area_id", "left")
    reason = F.when(F.size("others") > 0, "parent_extent_crosses_other_municipalities").when(F.col("outside") > least, "parent_extent_unmatched_requires_source_reconciliation")
    reason = reason.when(F.col("contained"), "contained_peer_requires_semantic_hierarchy").when(F.size("peers") > 0, "peer_overlap_requires_ownership_evidence")
    return j.select("area_id", "outside", F.coalesce("others", _ids()).alias("others"), F.coalesce("peers", _ids()).alias("peers"), reason.alias("reason"))


def verify_proofs(proofs: DataFrame, fingerprints: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, fault: approvals (id, fingerprint) whose geometry is gone or another, or that the inventory does not list."""
    j = proofs.join(fingerprints.select(F.col("area_id").alias("id"), F.col("fingerprint").alias("now")), "id", "left")
    j = j.join(inventory.select("id").distinct().withColumn("listed", F.lit(True)), "id", "left")
    fault = F.when(F.col("now").isNull(), "no_geometry").when(F.col("now") != F.col("fingerprint"), "changed").when(F.col("listed").isNull(), "not_in_inventory")
    return j.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def ring_repair(before: DataFrame, after: DataFrame, pins: DataFrame) -> DataFrame:
    """area_id, fault: single ring repairs (pins: area_id, part, ring) that changed more, or other rings, than stated.

    Rings are (area_id, part, ring, digest).
    """
    key = ["area_id", "part", "ring"]
    j = before.join(after.withColumnRenamed("digest", "now"), key, "full").where("NOT (digest <=> now)")
    j = j.select(*key).join(pins.select(*key).withColumn("pinned", F.lit(True)), key, "left")
    other = j.where("pinned IS NULL").select("area_id", F.lit("other_ring_changed").alias("fault"))
    idle = pins.select(*key).join(j.select(*key), key, "left_anti").select("area_id", F.lit("ring_not_changed").alias("fault"))
    return other.unionByName(idle).distinct()


def import_state(stored: DataFrame, computed: DataFrame, by: str, *columns: str) -> DataFrame:
    """``by``, state: unchanged where both tables have the same digest of all rows, changed, new or gone."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
        return df.groupBy(by).agg(F.bit_xor(F.xxhash64(row)).alias(f"x_{name}"), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)")).alias(f"s_{name}"), F.count(F.lit(1)).alias(f"n_{name}"))

    j = digest(stored, "a").join(digest(computed, "b"), by, "full")
    same = (F.col("x_a") == F.col("x_b")) & (F.col("s_a") == F.col("s_b")) & (F.col("n_a") == F.col("n_b"))
    return j.select(by, F.when(F.col("n_a").isNull(), "new").when(F.col("n_b").isNull(), "gone").when(same, "unchanged").otherwise("changed").alias("state"))


def infer_scopes(records: DataFrame, areas: DataFrame, provinces: DataFrame, prefix: str) -> DataFrame:
    """record_id, area_id: the areas that a record names (ids, with or without prefix), else its province, else what it inherits.

    ``provinces`` are (province, area_id); records have ids, province and inherited.
    """
    known = areas.select("id")
    named = records.select("record_id", F.explode(F.array_union("ids", F.transform("ids", lambda x: F.concat(F.lit(prefix), x)))).alias("id"))
    own = named.join(known, "id", "left_semi").select("record_id", F.col("id").alias("area_id")).distinct()
    rest = records.join(own.select("record_id").distinct(), "record_id", "left_anti").join(provinces, "province", "left")
    return own.unionByName(rest.select("record_id", F.coalesce("area_id", "inherited").alias("area_id")).where("area_id IS NOT NULL"))


def selected_records(records: DataFrame, relations: DataFrame, layer: str, editions: list[str], explicit: bool = False) -> DataFrame:
    """record_id, relation, edition, basis of the records (record_id, layer, edition, basis) that a selection shows.

    Records of other layers and editions are left out, and with an explicit choice of editions
    also what only describes the defaults.
    """
    shown = records.where((F.col("layer") == layer) & (F.col("edition").isNull() | F.col("edition").isin(editions)))
    if explicit:
        shown = shown.where("basis <> 'default_selection'")
    return shown.join(relations, "record_id").select("record_id", "relation", "edition", "basis")


def summary(areas: DataFrame, editions: list[str] | None = None) -> DataFrame:
    """layer, n, n_open, limitations: counts, and what a reader has to know about each layer.

    With ``editions`` only areas of these count beside those that belong to no edition; a layer of which nothing
    is chosen keeps its row and says so.
    """
    layers = areas.select("layer").distinct()
    if editions is not None:
        areas = areas.where(F.col("edition").isNull() | F.col("edition").isin(editions))
    g = areas.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("assignment_status") == "missing_geometry").alias("n_missing"),
        F.count_if(F.col("assignment_status") == "unreviewed_repair").alias("n_repair"),
        F.count_if(F.col("lifecycle_status") != "current").alias("n_past"),
    )
    flags = {"missing_geometry": "n_missing > 0", "unreviewed_repair": "n_repair > 0", "holds_history": "n_past > 0"}
    flags["not_selected"] = "n = 0"
    listed = F.filter(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in flags.items())), lambda x: x.isNotNull())
    g = layers.join(g.hint("merge"), "layer", "left").na.fill(0)
    return g.select("layer", "n", (F.col("n_missing") + F.col("n_repair")).alias("n_open"), listed.alias("limitations"))


def viewports(roots: DataFrame, boxes: DataFrame) -> DataFrame:
    """area_id, basis, west, south, east, north: what to show for a requested root (area_id, bundle_id): its own box
    (area_id, west, ...), or the box of all in its bundle that have one."""
    names = ["west", "south", "east", "north"]
    j = roots.join(boxes.hint("merge"), "area_id", "left")
    ends = (F.min, F.min, F.max, F.max)
    whole = j.groupBy("bundle_id").agg(*(f(c).alias(f"_{c}") for f, c in zip(ends, names, strict=True)))
    j = j.join(whole.hint("merge"), "bundle_id")
    basis = F.when(F.col("west").isNotNull(), "root_display").when(F.col("_west").isNotNull(), "available_features")
    return j.select("area_id", basis.alias("basis"), *(F.coalesce(c, f"_{c}").alias(c) for c in names))


def group_listing(groups: DataFrame, roots: DataFrame, maps: DataFrame) -> DataFrame:
    """group_id, membership, n_missing, anchor, map_status: groups (group_id, members) with what is known of them.

    A group is complete when all members are roots; only then does it have a map, anchored at
    its first member.
    """
    m = groups.select("group_id", F.explode("members").alias("id")).join(roots.select("id").withColumn("has", F.lit(True)), "id", "left")
    m = m.groupBy("group_id").agg(F.count_if(F.col("has").isNull()).alias("n_missing"), F.min("id").alias("first"))
    j = m.join(maps, "group_id", "left").withColumn("map_status", F.coalesce("map_status", F.lit("unsupported")))
    anchor = F.when((F.col("n_missing") == 0) & (F.col("map_status") != "unsupported"), F.col("first"))
    return j.select("group_id", F.when(F.col("n_missing") > 0, "unresolved").otherwise("complete").alias("membership"), "n_missing", anchor.alias("anchor"), "map_status")


def reproduced_groups(extracted: DataFrame, updates: DataFrame, reviewed: DataFrame) -> DataFrame:
    """group_id, fault: groups (group_id, id) that, with the reviewed id updates (group_id, previous_id, current_id), differ."""
    n = dealt(extracted)
    key = ["group_id", "id"]
    now = extracted.repartition(n, *key).join(updates.withColumnRenamed("previous_id", "id").repartition(n, *key).hint("merge"), key, "left").select("group_id", F.coalesce("current_id", "id").alias("id"), F.lit(1).alias("n"))
    both = now.union(reviewed.select("group_id", "id", F.lit(-1).alias("n"))).repartition(n, "group_id")  # rows of both, those reviewed counted down
    apart = both.groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0")
    return apart.select("group_id", F.when(F.col("n") > 0, "not_reviewed").otherwise("not_extracted").alias("fault")).distinct()


def attributions(members: DataFrame) -> DataFrame:
    """bundle_id, attributions: the distinct attribution lines of its members, sorted."""
    return members.groupBy("bundle_id").agg(F.array_sort(F.collect_set("attribution")).alias("attributions"))


def regional_members(membership: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, n_members, member_ids of every region after migrations; a region without members is kept."""
    m = membership.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list("area_id")).alias("member_ids"))
    return regions.select("region_id").join(m, "region_id", "left").withColumn("n_members", F.coalesce("n_members", F.lit(0))).withColumn("member_ids", F.coalesce("member_ids", _ids()))


def municipal_totals(editions: DataFrame) -> DataFrame:
    """province_id, editions, all_districts, default_districts from editions (province_id, expected_count, default)."""
    return editions.groupBy("province_id").agg(F.count(F.lit(1)).alias("editions"), F.sum("expected_count").alias("all_districts"), F.coalesce(F.sum(F.when(F.col("default"), F.col("expected_count"))), F.lit(0)).alias("default_districts"))


def migration_faults(membership: DataFrame, moves: DataFrame, result: DataFrame) -> DataFrame:
    """area_id, fault: whether a migrated membership is the old one with exactly the stated moves."""
    want = membership.join(moves.select("area_id", F.col("region_id").alias("to"), F.lit(True).alias("moved")), "area_id", "full").select("area_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("region_id")).alias("want"))
    j = want.where("want IS NOT NULL").join(result.select("area_id", F.col("region_id").alias("got")), "area_id", "full")
    fault = F.when(F.col("want").isNull(), "unexpected").when(F.col("got").isNull(), "lost").when(F.col("want") != F.col("got"), "other_region")
    return j.select("area_id", fault.alias("fault")).where("fault IS NOT NULL")


def plan_faults(plan: DataFrame, areas: DataFrame, expected: int | None = None) -> DataFrame:
    """id, violations of a plan (id, area_id, parent_id): unknown or repeated areas, parents of another province, the count."""
    a = areas.select(F.col("id").alias("area_id"), F.col("province_id").alias("p_area"))
    p = areas.select(F.col("id").alias("parent_id"), F.col("province_id").alias("p_parent"))
    j = plan.join(a, "area_id", "left").join(p, "parent_id", "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("area_id")))
    checks = violations(known=F.col("p_area").isNotNull(), parent=F.col("p_parent").isNotNull(), province=F.col("p_area").eqNullSafe(F.col("p_parent")), once=F.col("_n") == 1)
    out = j.select("id", checks.alias("violations")).where("size(violations) > 0")
    if expected is None or plan.count() == expected:
        return out
    return out.unionByName(plan.sparkSession.createDataFrame([("plan", ["count"])], "id string, violations array<string>"))


def overview(provinces: DataFrame, displays: DataFrame) -> DataFrame:
    """province_id, fault: every province has a display with a box inside WGS 84, and no other has."""
    j = provinces.select("province_id", F.lit(True).alias("known")).join(displays, "province_id", "full")
    checks = violations(known=F.col("known"), shown=F.col("west").isNotNull(), extent=F.col("west").isNull() | (F.col("west").between(-180, 180) & F.col("east").between(-180, 180) & F.col("south").between(-90, 90) & F.col("north").between(-90, 90) & (F.col("west") <= F.col("east"))))
    return j.select("province_id", F.explode(checks).alias("fault"))
