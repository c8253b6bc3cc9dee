"""Changes between versions: succession, boundary changes, renames, membership, release diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions import geometry as G
from areaframe.operators.contract import violations
from areaframe.operators.overlay import coverage, overlay_areas, united

LEAST_OVERLAP = 0.80


def compare_extents(old: DataFrame, new: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """area_id, old_share, new_share, sufficient: what old and new extent have in common, both ways."""
    pairs = old.select(F.col("area_id").alias("a")).join(new.select(F.col("area_id").alias("b")), F.col("a") == F.col("b"))
    o = overlay_areas(pairs, old, new)
    shares = o.select(F.col("a").alias("area_id"), F.try_divide("intersection", "area_a").alias("old_share"), F.try_divide("intersection", "area_b").alias("new_share"))
    return shares.withColumn("sufficient", (F.col("old_share") >= least) & (F.col("new_share") >= least))


def adjust_groups(changes: DataFrame, comparison: DataFrame) -> DataFrame:
    """All or nothing: the changes (area_id, group) of a group apply only if all are sufficient."""
    j = changes.join(comparison, "area_id", "left").withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))
    return j.withColumn("applied", F.bool_and("sufficient").over(Window.partitionBy("group")))


def succeed(predecessors: DataFrame, new_extent: DataFrame | None = None, least: float = LEAST_OVERLAP) -> DataFrame:
    """Mergers (successor_id, area_id, rings): successor_id, predecessor_ids, rings, area, deferred.

    The successor is the union of its predecessors, as whole rings whatever vertices they share. With a
    published new extent it is deferred when the two have less than ``least`` in common.
    """
    ids = predecessors.groupBy("successor_id").agg(F.array_sort(F.collect_set("area_id")).alias("predecessor_ids"))
    shape = united(predecessors.select("successor_id", "rings"), "successor_id")
    out = ids.join(shape.hint("merge"), "successor_id", "left").withColumn("area", G.area("rings"))
    if new_extent is None:
        return out.withColumn("deferred", F.lit(False))
    extent = new_extent.select(F.col("area_id").alias("successor_id"), "rings")
    both = predecessors.select("successor_id", "rings").join(extent.select("successor_id"), "successor_id", "left_semi")
    shares = coverage(extent, both, ["successor_id"])
    enough = (F.col("covered") >= least * (F.col("covered") + F.col("outside"))) & (F.col("covered") >= least * (F.col("covered") + F.col("uncovered")))
    j = out.join(shares.select("successor_id", enough.alias("_enough")).hint("merge"), "successor_id", "left")
    return j.withColumn("deferred", ~F.coalesce("_enough", F.lit(False))).drop("_enough")


def rename(areas: DataFrame, names: DataFrame) -> DataFrame:
    """Apply renames (id, new_name); the old name becomes an alias."""
    j = areas.join(names, "id", "left")
    kept = F.when(F.col("new_name").isNotNull(), F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).otherwise(F.col("aliases"))
    now = F.coalesce("new_name", "name")
    return j.withColumn("aliases", F.array_sort(F.array_except(F.array_distinct(kept), F.array(now)))).withColumn("name", now).drop("new_name")


# The operations of a revision log, those that carry geometry, and the level that each applies to.
OPERATIONS = ["metadata", "new", "retire", "boundary", "deferred_boundary", "region"]
GEOMETRIC = ["new", "boundary", "deferred_boundary", "region"]
OPERATION_LEVEL = {"metadata": "municipality", "new": "municipality", "retire": "municipality", "boundary": "municipality", "deferred_boundary": "municipality", "region": "region"}


def _last(column: str, when: Column | None = None) -> Column:
    """The last value by ``seq`` that is not null, or of the rows where ``when`` holds."""
    return F.max_by(column, F.when(F.col(column).isNotNull() if when is None else when, F.col("seq")))


def apply_revisions(areas: DataFrame, revisions: DataFrame) -> DataFrame:
    """Fold a log (id, seq, operation, columns to set) into the areas, in the order of ``seq``.

    A column takes the last value of its own that any revision sets, so a retirement keeps an
    earlier change of name. ``retire`` supersedes, ``new`` adds an area that is not there, and the later of both
    counts. One aggregate over the log, whatever its length.
    """
    sets = [c for c in revisions.columns if c not in ("id", "seq", "operation")]
    life = F.when(F.col("operation") == "retire", "superseded").when(F.col("operation") == "new", "current")
    last = [_last(c).alias(f"r_{c}") for c in sets]
    r = revisions.withColumn("_life", life).groupBy("id").agg(*last, _last("_life").alias("_life"), F.bool_or(F.col("operation") == "new").alias("_new"))
    j = areas.withColumn("_base", F.lit(True)).join(r.hint("merge"), "id", "full").where("_base OR _new")
    for c in sets:
        j = j.withColumn(c, F.coalesce(f"r_{c}", c)) if c in areas.columns else j.withColumn(c, F.col(f"r_{c}"))
    return j.withColumn("lifecycle_status", F.coalesce("_life", "lifecycle_status")).select(*areas.columns)


def revise_geometry(geometry: DataFrame, revisions: DataFrame) -> DataFrame:
    """Geometry (area_id, role, rings) after a log (id, seq, operation, full, review).

    A geometric revision replaces what was uncertain about an area: candidates, boxes and disputes
    go, ``review`` becomes its dispute, or its candidate where it has no assignment; ``full`` its
    assignment. Of several the last decides, and the last ``full`` that is not null.
    """
    g = revisions.where(F.col("operation").isin(GEOMETRIC))
    r = g.groupBy(F.col("id").alias("area_id")).agg(_last("full").alias("full"), F.max_by("review", "seq").alias("review"))
    kept = geometry.join(r.select("area_id", F.col("full").isNotNull().alias("_full")).hint("merge"), "area_id", "left")
    kept = kept.where(F.col("_full").isNull() | ((F.col("role") == "assignment") & ~F.col("_full"))).drop("_full")
    assigned = geometry.where("role = 'assignment'").select("area_id").distinct().withColumn("_had", F.lit(True))
    full = r.where("full IS NOT NULL").select("area_id", F.lit("assignment").alias("role"), F.col("full").alias("rings"))
    role = F.when(F.col("full").isNotNull() | F.col("_had"), "review").otherwise("candidate")
    review = r.where("review IS NOT NULL").join(assigned.hint("merge"), "area_id", "left").select("area_id", role.alias("role"), F.col("review").alias("rings"))
    return kept.select("area_id", "role", "rings").unionByName(full).unionByName(review)


def revision_faults(areas: DataFrame, geometry: DataFrame, revisions: DataFrame) -> DataFrame:
    """id, seq, fault of revisions (id, seq, operation, evidence, full, review) that may not be applied.

    A revision may name areas of the base or of an earlier ``new``, of its operation's level. It neither
    approves an area without assignment nor takes an assignment away; a deferred boundary keeps the one there is.
    """
    born = revisions.where("operation = 'new'").groupBy("id").agg(F.min("seq").alias("_born"))
    base = areas.select("id", F.col("level").alias("_level"))
    own = geometry.where("role = 'assignment'").select(F.col("area_id").alias("id"), G.fingerprint("rings").alias("_own"))
    j = revisions.join(base.hint("merge"), "id", "left").join(born.hint("merge"), "id", "left").join(own.hint("merge"), "id", "left")
    op = F.col("operation")
    known = F.col("_level").isNotNull() | (F.col("_born") < F.col("seq"))
    wanted = F.create_map(*(F.lit(x) for kv in OPERATION_LEVEL.items() for x in kv))[op]
    geometric = op.isin("boundary", "deferred_boundary", "region")
    pending = F.col("_own").isNull() & F.col("_level").isNotNull()
    checks = violations(
        operation=op.isin(OPERATIONS),
        evidence=F.coalesce(F.length("evidence") > 0, F.lit(False)),
        known=F.when(op == "new", F.col("_level").isNull() & (F.col("_born") == F.col("seq"))).otherwise(known),
        level=F.col("_level").isNull() | (F.col("_level") == wanted),
        no_geometry=F.col("full").isNull() & F.col("review").isNull() | ~op.isin("metadata", "retire"),
        not_approved=~geometric | ~pending | F.col("full").isNull(),
        not_withdrawn=~op.isin("boundary", "deferred_boundary") | F.col("full").isNotNull() | pending,
        candidate=~geometric | ~pending | F.col("review").isNotNull(),
        same_boundary=(op != "deferred_boundary") | F.col("full").isNull() | F.coalesce(G.fingerprint("full") == F.col("_own"), F.lit(False)),
    )
    return j.select("id", "seq", F.explode(checks).alias("fault"))


def revision_counts(areas: DataFrame, revisions: DataFrame, report: DataFrame) -> DataFrame:
    """province_id, operation, n, reported: operations of which other numbers of areas are reported (province_id, operation, reported)."""
    got = revisions.join(areas.select("id", "province_id").hint("merge"), "id", "left").groupBy("province_id", "operation").agg(F.count_distinct("id").alias("n"))
    j = got.join(report, ["province_id", "operation"], "full").na.fill(0, ["n", "reported"])
    return j.where("n <> reported").select("province_id", "operation", "n", "reported")


def move_members(membership: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The membership after moves (area_id, region_id or null), and the regions to dissolve anew."""
    j = membership.alias("m").join(moves.alias("v").withColumn("moved", F.lit(True)), "area_id", "full")
    now = j.select("area_id", F.when(F.col("moved"), F.col("v.region_id")).otherwise(F.col("m.region_id")).alias("region_id")).where("region_id IS NOT NULL")
    touched = membership.join(moves.select("area_id"), "area_id", "left_semi").select("region_id").unionByName(moves.select("region_id")).where("region_id IS NOT NULL").distinct()
    return now, touched


def region_ledger(municipalities: DataFrame, membership: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Divisions (municipalities: area_id, division_id): assigned, unassigned and the state of each.

    ``excluded`` (division_id) are left out of regions on purpose; one with an assigned municipality is in ``conflict``.
    """
    j = municipalities.join(membership.select("area_id", "region_id"), "area_id", "left")
    g = j.groupBy("division_id").agg(F.count_if(F.col("region_id").isNotNull()).alias("n_assigned"), F.count_if(F.col("region_id").isNull()).alias("n_unassigned"))
    state = F.when(F.col("n_unassigned") == 0, "assigned").when(F.col("n_assigned") == 0, "unassigned").otherwise("partially_assigned")
    if excluded is not None:
        g = g.join(excluded.select("division_id", F.lit(True).alias("_out")).distinct().hint("merge"), "division_id", "left")
        state = F.when(F.col("_out") & (F.col("n_assigned") > 0), "conflict").when(F.col("_out"), "excluded").otherwise(state)
    return g.withColumn("state", state).select("division_id", "n_assigned", "n_unassigned", "state")


def build_regions(plan: DataFrame, municipalities: DataFrame) -> DataFrame:
    """area_id, region_id from a plan (region_id, division_ids, member_ids): all municipalities (area_id, division_id)
    of its divisions, and those it names. A municipality that two regions claim is in both rows."""
    by = plan.select("region_id", F.explode("division_ids").alias("division_id")).join(municipalities.hint("merge"), "division_id").select("area_id", "region_id")
    named = plan.select("region_id", F.explode("member_ids").alias("area_id")).join(municipalities.select("area_id").hint("merge"), "area_id", "left_semi").select("area_id", "region_id")
    return by.unionByName(named).distinct()


def release_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """key, change (added, removed, changed), changed column names; null-safe.

    With ``allowed`` (key, column) only changes that are not on the list remain.
    """
    a = old.select(F.col(key), F.struct(*columns).alias("o"))
    b = new.select(F.col(key), F.struct(*columns).alias("n"))
    j = a.join(b, key, "full")
    names = F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    change = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.when(~F.col("o").eqNullSafe(F.col("n")), "changed")).otherwise(change)
    out = j.select(key, change.alias("change"), F.when(change == "changed", F.filter(names, lambda x: x.isNotNull())).alias("columns")).where("change IS NOT NULL")
    if allowed is None:
        return out
    lists = allowed.groupBy(key).agg(F.collect_set("column").alias("ok"))
    rest = out.join(lists, key, "left")
    return rest.where((F.col("change") != "changed") | (F.size(F.array_except("columns", F.coalesce("ok", F.array().cast("array<string>")))) > 0)).drop("ok")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other does not have, as often as they differ."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def best_overlap(sources: DataFrame, targets: DataFrame, pairs: DataFrame, winner: float = 0.90, runner: float = 0.10) -> DataFrame:
    """The target that holds most of each source, accepted when it is clear: area_id, target_id, fraction, runner_up, accepted."""
    o = overlay_areas(pairs, sources, targets).withColumn("fraction", F.try_divide("intersection", "area_a"))
    w = Window.partitionBy("a").orderBy(F.desc("fraction"), F.desc("b"))
    r = o.withColumn("_n", F.row_number().over(w)).withColumn("runner_up", F.coalesce(F.lead("fraction").over(w), F.lit(0.0))).where("_n = 1")
    return r.select(F.col("a").alias("area_id"), F.col("b").alias("target_id"), "fraction", "runner_up", ((F.col("fraction") >= winner) & (F.col("runner_up") <= runner)).alias("accepted"))


def child_coverage(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (area_id, parent_id, track, rings) against their parents: parent_id, track, covered, outside, uncovered, repeated.

    The children of a parent and track are united first: what they cover twice is no cover of the rest.
    """
    kids = children.join(parents.select(F.col("area_id").alias("parent_id")), "parent_id", "left_semi").select("parent_id", "track", "rings")
    whole = parents.select(F.col("area_id").alias("parent_id"), "rings").hint("merge").join(kids.select("parent_id", "track").distinct(), "parent_id")
    return coverage(whole.select("parent_id", "track", "rings"), kids, ["parent_id", "track"])


def fingerprints(geometry: DataFrame) -> DataFrame:
    """area_id, fingerprint over all roles, sorted."""
    one = F.concat_ws(":", "role", G.fingerprint("rings"))
    return geometry.groupBy("area_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("fingerprint"))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
