"""Browsing, provenance, evidence, bundles and reconciliation of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions.text import fold_text


def browse(areas: DataFrame, closure: DataFrame | None = None, *, level: str | None = None, layer: str | None = None, parent: str | None = None, within: str | None = None, search: str | None = None, history: bool = False) -> DataFrame:
    """The filters of a catalogue listing; ``search`` ignores case and accents."""
    out = areas if history else areas.where("lifecycle_status <> 'superseded'")
    for column, value in (("level", level), ("layer", layer), ("parent_id", parent)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if within is not None:
        out = out.join(closure.where(F.col("ancestor_id") == within).select("id"), "id", "left_semi")
    if search is not None:
        key = fold_text(F.lit(search))
        out = out.where(F.contains(fold_text("name"), key))
    return out


def ordered_page(listing: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page in catalogue order (folded name, id) with the total of the listing."""
    total = listing.count()
    keyed = listing.withColumn("_key", fold_text("name")).orderBy("_key", "id").offset(offset).limit(limit)
    more = offset + limit
    return keyed.withColumn("total", F.lit(total)).withColumn("next_offset", F.lit(more if more < total else None).cast("int")).drop("_key")


def applicable_sources(areas: DataFrame, closure: DataFrame, usage: DataFrame) -> DataFrame:
    """area id, source_ids: sources used by the area itself or by an ancestor."""
    chain = closure.select("id", F.col("ancestor_id").alias("area_id")).unionByName(areas.select("id", F.col("id").alias("area_id")))
    return chain.join(usage, "area_id").groupBy("id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def scope_relation(records: DataFrame, closure: DataFrame, area: str) -> DataFrame:
    """record_id, relation of its scopes (record_id, area_id) to ``area``: direct, inherited or descendant."""
    up = closure.where(F.col("id") == area).select(F.col("ancestor_id").alias("area_id"), F.lit(1).alias("r"))
    down = closure.where(F.col("ancestor_id") == area).select(F.col("id").alias("area_id"), F.lit(2).alias("r"))
    own = closure.sparkSession.createDataFrame([(area, 0)], "area_id string, r int")
    j = records.join(up.unionByName(down).unionByName(own), "area_id").groupBy("record_id").agg(F.min("r").alias("r"))
    return j.select("record_id", F.expr("element_at(array('direct', 'inherited', 'descendant'), r + 1)").alias("relation"))


def evidence_nodes(documents: DataFrame, depth: int = 64) -> DataFrame:
    """doc_id, path, kind, value: all nodes of a JSON document (doc_id, json).

    Levels are opened until none is left; documents deeper than ``depth`` are an error.
    """
    level = documents.select("doc_id", F.lit("$").alias("path"), F.try_parse_json("json").alias("v"))
    out = level
    step = "SELECT l.doc_id, l.path || CASE WHEN x.key IS NULL THEN '[' || x.pos || ']' ELSE '.' || x.key END AS path, x.value AS v FROM {l} l, LATERAL variant_explode(l.v) x"
    for _ in range(depth):
        level = documents.sparkSession.sql(step, l=level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise ValueError(f"documents are nested deeper than {depth} levels")
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    return out.where("v IS NOT NULL").select("doc_id", "path", kind.alias("kind"), F.expr("CASE WHEN schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)' THEN NULL ELSE CAST(v AS STRING) END").alias("value"))


def register_sources(mentions: DataFrame) -> DataFrame:
    """Sources mentioned by records (record_id, role, title, url), once each by digest, with their roles."""
    d = F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))), 256)
    return mentions.withColumn("source_id", d).groupBy("source_id").agg(F.min("title").alias("title"), F.min("url").alias("url"), F.array_sort(F.collect_set("role")).alias("roles"), F.count_distinct("record_id").alias("n_records"))


def unscoped_sources(registered: DataFrame, usage: DataFrame) -> DataFrame:
    """Registered sources (source_id) that no area uses (area_id, source_id): they are said to apply, but to nothing that is known."""
    return registered.join(usage.select("source_id").distinct().hint("merge"), "source_id", "left_anti")


def bundle_members(areas: DataFrame, closure: DataFrame, roots: DataFrame, geometry: DataFrame) -> DataFrame:
    """root_id, n_members, n_shaped, n_candidate, coverage of the area sets below each root (root_id)."""
    members = closure.select(F.col("ancestor_id").alias("root_id"), "id").join(roots, "root_id", "left_semi").unionByName(roots.select("root_id", F.col("root_id").alias("id")))
    shapes = geometry.groupBy(F.col("area_id").alias("id")).agg(F.bool_or(F.col("role") == "assignment").alias("a"), F.bool_or(F.col("role") == "candidate").alias("c"))
    j = members.join(areas.select("id", "assignment_status"), "id").where("assignment_status <> 'hierarchy_only'").join(shapes, "id", "left").na.fill(False, ["a", "c"])
    g = j.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_members"), F.count_if("a").alias("n_shaped"), F.count_if(~F.col("a") & F.col("c")).alias("n_candidate"))
    cover = F.when(F.col("n_shaped") == F.col("n_members"), "complete").when(F.col("n_shaped") > 0, "partial").otherwise("none")
    return g.withColumn("coverage", cover)


def bundle_plan(roots: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Preferred group of each root (root_id, group_id, rank), the next one where members are missing."""
    state = groups.join(members, "group_id", "left").groupBy("group_id").agg(F.bool_or(F.coalesce("missing", F.lit(True))).alias("missing"))
    j = roots.join(state, "group_id", "left").where(~F.coalesce("missing", F.lit(True)))
    w = Window.partitionBy("root_id").orderBy("rank", "group_id")
    best = j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("root_id", "group_id")
    return roots.select("root_id").distinct().join(best, "root_id", "left")


def group_plan_faults(groups: DataFrame) -> DataFrame:
    """Members (group_id, municipality_ids) out of order, repeated, or in two groups."""
    own = groups.where("municipality_ids <> array_sort(array_distinct(municipality_ids))").select("group_id", F.lit("not_sorted_unique").alias("fault"))
    m = groups.select("group_id", F.explode("municipality_ids").alias("m"))
    twice = m.groupBy("m").agg(F.collect_set("group_id").alias("g")).where("size(g) > 1").select(F.explode("g").alias("group_id")).distinct()
    return own.unionByName(twice.withColumn("fault", F.lit("shared_member")))


def reconcile(foreign: DataFrame, areas: DataFrame) -> DataFrame:
    """Foreign inventory (foreign_id, kind, province_id, names) against current areas: foreign_id, status, area_ids.

    Names meet on their folded form within kind and province; one candidate is a match,
    several are ambiguous, none is unmatched.
    """
    f = foreign.select("foreign_id", F.col("kind").alias("level"), "province_id", F.explode("names").alias("n")).withColumn("key", fold_text("n")).select("foreign_id", "level", "province_id", "key")
    a = areas.where("lifecycle_status = 'current'").select("id", "level", "province_id", fold_text("name").alias("key"))
    met = f.join(a, ["level", "province_id", "key"]).groupBy("foreign_id").agg(F.array_sort(F.collect_set("id")).alias("area_ids"))
    out = foreign.select("foreign_id").join(met, "foreign_id", "left").withColumn("area_ids", F.coalesce("area_ids", F.array().cast("array<string>")))
    return out.withColumn("status", F.when(F.size("area_ids") == 1, "matched").when(F.size("area_ids") > 1, "ambiguous").otherwise("unmatched"))


def status_histogram(areas: DataFrame, *by: str) -> DataFrame:
    return areas.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def page_total(df: DataFrame) -> Column:
    return F.lit(df.count())
