"""What a plan has to hold before anything is built from it: regions of divisions or members, and city areas of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.operators.contract import violations

# How a plan says what its areas cover.
MEMBER_POLICIES, PARENT_POLICIES = ["selected_members", "whole_divisions"], ["partial", "citywide"]


def _text(c: str, most: int) -> Column:
    return F.coalesce(F.length(c).between(1, most), F.lit(False))


def region_plan_faults(plan: DataFrame, municipalities: DataFrame) -> DataFrame:
    """region_id, fault of regions (region_id, province_id, name, kind, basis, division_ids, member_ids, members, coverage_policy,
    expected_count, digest) against municipalities (area_id, province_id, division_id, name, type).

    A region takes whole divisions or names its members, one way only, each once and all of its province; ``members``
    (id, name, type) are those it was planned with. No municipality is in two regions. ``digest`` is the SHA-256 of the
    sorted ids, one a line.
    """
    m = municipalities.select("area_id", F.col("province_id").alias("_p"), "division_id", F.struct(F.col("area_id").alias("id"), "name", "type").alias("_now"))
    by_division = plan.select("region_id", F.explode("division_ids").alias("division_id")).join(m.hint("merge"), "division_id", "left").select("region_id", F.concat_ws("/", F.lit("d"), F.col("division_id").cast("string")).alias("wanted"), "area_id", "_p", "_now")
    by_name = plan.select("region_id", F.explode("member_ids").alias("area_id")).join(m.drop("division_id").hint("merge"), "area_id", "left").select("region_id", F.col("area_id").alias("wanted"), F.when(F.col("_p").isNotNull(), F.col("area_id")).alias("area_id"), "_p", "_now")
    rows = by_division.unionByName(by_name)
    rows = rows.withColumn("_regions", F.size(F.collect_set("region_id").over(Window.partitionBy("area_id"))))
    of = plan.select("region_id", F.col("province_id").alias("_of"))
    g = rows.join(of.hint("merge"), "region_id").groupBy("region_id").agg(
        F.count_if(F.col("area_id").isNull()).alias("n_unknown"),
        F.count_if(F.col("area_id").isNotNull() & (F.col("_p") != F.col("_of"))).alias("n_foreign"),
        F.count_if(F.col("area_id").isNotNull() & (F.col("_regions") > 1)).alias("n_shared"),
        F.array_sort(F.collect_set("area_id")).alias("ids"),
        F.array_sort(F.collect_set("_now")).alias("now"),
    )
    j = plan.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("region_id"))).join(g.hint("merge"), "region_id", "left")
    named, whole = F.coalesce(F.size("member_ids"), F.lit(0)) > 0, F.coalesce(F.size("division_ids"), F.lit(0)) > 0
    given = F.when(named, F.size("member_ids") == F.size(F.array_distinct("member_ids"))).otherwise(F.size("division_ids") == F.size(F.array_distinct("division_ids")))
    checks = violations(
        once=F.col("_times") == 1,
        identity=F.col("region_id").startswith(F.concat("province_id", F.lit("-"))),
        labels=_text("name", 500) & _text("kind", 500) & _text("basis", 500),
        one_selection=named != whole,
        selected_once=~(named | whole) | given,
        known=F.coalesce("n_unknown", F.lit(0)) == 0,
        province=F.coalesce("n_foreign", F.lit(0)) == 0,
        exclusive=F.coalesce("n_shared", F.lit(0)) == 0,
        attributes=F.array_sort("members").eqNullSafe(F.col("now")),
        coverage=F.col("coverage_policy") == F.when(named, MEMBER_POLICIES[0]).otherwise(MEMBER_POLICIES[1]),
        count=F.size("ids") == F.col("expected_count"),
        digest=F.sha2(F.concat(F.array_join("ids", "\n"), F.lit("\n")), 256) == F.col("digest"),
    )
    return j.select("region_id", F.explode(checks).alias("fault"))


def city_plan_faults(plan: DataFrame, parents: DataFrame, sources: DataFrame, municipalities: DataFrame) -> DataFrame:
    """of, id, fault of city areas (id, source, source_id, parent_id, parent_name, name), their parents (parent_id, name,
    coverage_policy, expected_count) and sources (source, crs, expected_count); municipalities are (area_id, name).

    An id is that of its parent with the source's code; no id and no code of a source comes twice. Parents are
    municipalities by their present name, and parents and sources state how many areas they have.
    """
    p = parents.select("parent_id", F.col("name").alias("_name")).dropDuplicates(["parent_id"])
    s = sources.select("source", F.lit(True).alias("_source")).distinct()
    j = plan.withColumns({"_ids": F.count(F.lit(1)).over(Window.partitionBy("id")), "_codes": F.count(F.lit(1)).over(Window.partitionBy("source", "source_id"))})
    j = j.join(p.hint("merge"), "parent_id", "left").join(s.hint("merge"), "source", "left")
    rows = violations(
        once=F.col("_ids") == 1,
        code_once=F.col("_codes") == 1,
        source=F.col("_source"),
        parent=F.col("_name") == F.col("parent_name"),
        identity=F.col("id") == F.concat_ws("-", "parent_id", "source_id"),
        name=_text("name", 200),
    )
    out = j.select(F.lit("area").alias("of"), "id", F.explode(rows).alias("fault"))
    n = plan.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n"))
    k = parents.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("parent_id"))).join(n.hint("merge"), "parent_id", "left").join(municipalities.select(F.col("area_id").alias("parent_id"), F.col("name").alias("_now")).hint("merge"), "parent_id", "left")
    checks = violations(once=F.col("_times") == 1, known=F.col("_now").isNotNull(), name=F.col("_now").isNull() | (F.col("_now") == F.col("name")), policy=F.col("coverage_policy").isin(PARENT_POLICIES), count=F.coalesce("_n", F.lit(0)) == F.col("expected_count"), some=F.col("expected_count") > 0)
    out = out.unionByName(k.select(F.lit("parent").alias("of"), F.col("parent_id").alias("id"), F.explode(checks).alias("fault")))
    c = plan.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    q = sources.join(c.hint("merge"), "source", "left")
    counted = violations(crs=F.col("crs") == "EPSG:4326", count=F.coalesce("_n", F.lit(0)) == F.col("expected_count"))
    return out.unionByName(q.select(F.lit("source").alias("of"), F.col("source").alias("id"), F.explode(counted).alias("fault"))).distinct()
