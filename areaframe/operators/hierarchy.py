"""The tree of areas: closure, scopes, counts, siblings, and the faults it may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaframe.sources.workspace import dealt, written


def ancestors(areas: DataFrame, depth: int | None = None) -> DataFrame:
    """Closure table: id, ancestor_id, depth (1: the parent; the least number of steps), of any depth.

    The number of steps doubles each round, and every round is written, so a chain of n areas takes
    log2(n) rounds. Each pair is held once with its least depth, so a cycle ends too: its
    areas are their own ancestors (``cycles``). With ``depth`` only pairs up to that many steps are returned.
    """
    pairs = areas.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor_id")).withColumn("depth", F.lit(1))
    step, reach = written(_least(pairs), "parents"), 1
    while True:
        ends = step.where(F.col("depth") == reach)
        if ends.isEmpty():  # nothing lies as far as could be reached
            break
        step, reach = written(_twice(step, ends), "closure"), 2 * reach
    return step if depth is None else step.where(F.col("depth") <= depth)


def _twice(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs of twice the depth. Beyond ``ends``, the pairs of the greatest depth so far, a longer
    one goes on by a known one, so it is made once and not at every place where it could be divided."""
    n = dealt(pairs)
    first = ends.select("id", F.col("ancestor_id").alias("_via"), F.col("depth").alias("_less")).repartition(n, "_via")
    on = pairs.select(F.col("id").alias("_via"), "ancestor_id", "depth").repartition(n, "_via")
    longer = first.join(on.hint("merge"), "_via").select("id", "ancestor_id", (F.col("_less") + F.col("depth")).alias("depth"))
    return _least(pairs.unionByName(longer).repartition(2 * n, "id", "ancestor_id"))


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth"))


def cycles(areas: DataFrame) -> DataFrame:
    """Areas that are their own ancestor, at any distance."""
    return ancestors(areas).where("id = ancestor_id").select("id")


def scope(areas: DataFrame, roots: DataFrame, most_members: int | None = None, most_depth: int | None = None) -> DataFrame:
    """root_id, members, max_depth, fault: the walk below each root (root_id).

    ``fault`` names a cycle through the root, or the limit that a scope exceeds; nothing is left out of a scope.
    """
    pairs = ancestors(areas)
    n = dealt(pairs)
    below = pairs.withColumn("root_id", F.col("ancestor_id")).repartition(n, "root_id").join(roots.repartition(n, "root_id").hint("merge"), "root_id")
    counts = below.groupBy("root_id").agg(F.count(F.lit(1)).alias("members"), F.max("depth").alias("max_depth"), F.bool_or(F.col("id") == F.col("root_id")).alias("_cycle"))
    out = roots.join(counts.hint("merge"), "root_id", "left").na.fill(0, ["members", "max_depth"])
    fault = F.when(F.col("_cycle"), "cycle")
    if most_members is not None:
        fault = fault.when(F.col("members") > most_members, "too_many_members")
    if most_depth is not None:
        fault = fault.when(F.col("max_depth") > most_depth, "too_deep")
    return out.withColumn("fault", fault).drop("_cycle")


def child_counts(areas: DataFrame) -> DataFrame:
    """parent_id, layer, n_children, for current areas."""
    return areas.where("parent_id IS NOT NULL AND lifecycle_status = 'current'").groupBy("parent_id", "layer").agg(F.count(F.lit(1)).alias("n_children"))


def orphans(areas: DataFrame) -> DataFrame:
    """id, fault: a parent that does not exist, that is the area itself, or that was superseded."""
    a, p = areas.alias("a"), areas.select("id", "lifecycle_status").alias("p")
    j = a.where("parent_id IS NOT NULL").join(p, F.col("a.parent_id") == F.col("p.id"), "left")
    fault = F.when(F.col("a.id") == F.col("a.parent_id"), "self_parent").when(F.col("p.id").isNull(), "missing_parent").when(F.col("p.lifecycle_status") == "superseded", "superseded_parent")
    return j.select(F.col("a.id").alias("id"), fault.alias("fault")).where("fault IS NOT NULL")


def sibling_counts(areas: DataFrame) -> DataFrame:
    """id, n_siblings: areas with the same parent and the same scheme.

    Counted by group, not by joining the group with itself.
    """
    group = areas.where("parent_id IS NOT NULL").withColumn("scheme", F.coalesce("scheme", F.lit("default")))
    sizes = group.groupBy("parent_id", "scheme").agg((F.count(F.lit(1)) - 1).alias("n_siblings"))
    return group.select("id", "parent_id", "scheme").join(sizes, ["parent_id", "scheme"]).select("id", "n_siblings")


def surroundings(areas: DataFrame, of: DataFrame) -> DataFrame:
    """Siblings of each area in ``of`` (id) and of all its ancestors: id, near_id.

    An area has one chain, so every sibling is met once; their number alone is ``surrounding_counts``.
    """
    other = areas.select(F.col("id").alias("near_id"), F.col("parent_id").alias("_p"), F.coalesce("scheme", F.lit("default")).alias("_s"))
    return _chain(areas, of).join(other.hint("merge"), ["_p", "_s"]).where("near_id <> step").select("id", "near_id")


def surrounding_counts(areas: DataFrame, of: DataFrame) -> DataFrame:
    """id, n_near: how many siblings an area and its ancestors have, counted by group."""
    sizes = areas.groupBy(F.col("parent_id").alias("_p"), F.coalesce("scheme", F.lit("default")).alias("_s")).agg((F.count(F.lit(1)) - 1).alias("_n"))
    return _chain(areas, of).join(sizes.hint("merge"), ["_p", "_s"]).groupBy("id").agg(F.sum("_n").alias("n_near"))


def _chain(areas: DataFrame, of: DataFrame) -> DataFrame:
    """id, step: each area and its ancestors, with parent and scheme of the step."""
    chain = of.join(ancestors(areas).hint("merge"), "id").select("id", F.col("ancestor_id").alias("step")).unionByName(of.select("id", F.col("id").alias("step")))
    own = areas.select(F.col("id").alias("step"), F.col("parent_id").alias("_p"), F.coalesce("scheme", F.lit("default")).alias("_s"))
    return chain.join(own.hint("merge"), "step")


def in_layer(areas: DataFrame, layer: str, editions: list[str] | None = None) -> DataFrame:
    """Areas visible in a layer: countries and provinces always, electoral districts by edition."""
    visible = (F.col("layer") == layer) | F.col("level").isin("country", "province")
    if layer == "municipal":
        visible |= F.col("level").isin("municipality", "region")
    if editions is not None:
        visible &= F.col("edition").isNull() | F.col("edition").isin(editions)
    return areas.where(visible)
