"""Editions of electoral boundaries: selection, coverage, replacement of defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def selected(editions: DataFrame, layer: str, ids: list[str] | None = None) -> list[str]:
    """The chosen editions of a layer, or its defaults; unknown and foreign ids are errors."""
    own = {r["id"]: r["default"] for r in editions.where(F.col("layer") == layer).select("id", "default").collect()}  # a few rows a layer
    if ids is None:
        return sorted(k for k, default in own.items() if default)
    if wrong := sorted(set(ids) - own.keys()):
        raise ValueError(f"not editions of {layer}: {wrong}")
    return sorted(set(ids))


def coverage(districts: DataFrame, declared: DataFrame, editions: DataFrame) -> DataFrame:
    """edition, province_id, rows, unavailable, status: inventory against declarations.

    A declaration wins; otherwise no rows is unavailable, some without geometry is partial.
    """
    rows = districts.groupBy("edition", "province_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("assignment_status") == "unavailable").alias("n_unavailable"))
    wanted = editions.select(F.col("id").alias("edition"), F.explode("provinces").alias("province_id"))
    j = wanted.join(rows, ["edition", "province_id"], "left").join(declared, ["edition", "province_id"], "left").na.fill(0, ["n_rows", "n_unavailable"])
    derived = F.when(F.col("n_rows") == F.col("n_unavailable"), "unavailable").when(F.col("n_unavailable") > 0, "partial").otherwise("included")
    return j.select("edition", "province_id", "n_rows", "n_unavailable", F.coalesce("declared", derived).alias("status"))


def selection_coverage(provinces: DataFrame, cover: DataFrame, chosen: list[str]) -> DataFrame:
    """province_id, status of the chosen editions: included, partial, unavailable or not_selected."""
    c = cover.where(F.col("edition").isin(chosen)).groupBy("province_id").agg(F.bool_and(F.col("status") == "included").alias("full"), F.bool_or(F.col("status").isin("included", "partial")).alias("some"))
    status = F.when(F.col("full").isNull(), "not_selected").when(F.col("full"), "included").when(F.col("some"), "partial").otherwise("unavailable")
    return provinces.join(c, "province_id", "left").select("province_id", status.alias("status"))


def municipal_coverage(authorities: DataFrame, districts: DataFrame, declared: DataFrame) -> DataFrame:
    """authority_id, province_id, n_current, n_historical, status for each municipal authority."""
    d = districts.groupBy("authority_id").agg(F.count_if("current").alias("n_current"), F.count_if(~F.col("current")).alias("n_historical"))
    j = authorities.join(d, "authority_id", "left").join(declared, "authority_id", "left").na.fill(0, ["n_current", "n_historical"])
    derived = F.when(F.col("n_current") > 0, "included").when(F.col("n_historical") > 0, "historical_only").otherwise("unverified")
    return j.select("authority_id", "province_id", "n_current", "n_historical", F.coalesce("declared", derived).alias("status"))


def coverage_rollup(cover: DataFrame) -> DataFrame:
    """province_id, n, and a histogram of the statuses."""
    by = cover.groupBy("province_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("province_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))


def replace_defaults(current: DataFrame, new: DataFrame) -> DataFrame:
    """Union of editions in which a new default takes that role from older ones of its layer and province."""
    rows = current.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    rows = rows.select("*", F.explode("provinces").alias("province"))
    taken = F.max(F.col("is_new") & F.col("default")).over(Window.partitionBy("layer", "province"))
    rows = rows.withColumn("keeps", F.col("default") & (F.col("is_new") | ~taken))
    return rows.groupBy("id", "layer").agg(F.bool_and("keeps").alias("default"), F.array_sort(F.collect_set("province")).alias("provinces"))


def rule_rows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that meet all of an edition's rules (edition, field, values); ``rows`` have a map ``props``.

    An edition keeps a row when every one of its fields has an allowed value.
    """
    need = rules.groupBy("edition").agg(F.count(F.lit(1)).alias("need"))
    met = rows.select("row_id", F.explode("props").alias("field", "value")).join(rules, "field").where(F.array_contains("values", F.col("value")))
    return met.groupBy("edition", "row_id").agg(F.countDistinct("field").alias("met")).join(need, "edition").where("met = need").select("edition", "row_id")


def merged_features(rows: DataFrame, by: str) -> DataFrame:
    """Rows of one id merged: parts numbered on, and whether all agree on the name."""
    parts = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("row_id", "rings"))).alias("g"), F.count_distinct("name").alias("names"), F.min("name").alias("name"))
    rings = F.expr(
        """transform(array(1 + array_max(flatten(transform(g, x -> transform(x.rings, r -> r.part))))), m ->
        flatten(transform(g, (x, i) -> transform(x.rings, r -> named_struct('part', CAST(r.part + i * m AS INT), 'ring', r.ring, 'pts', r.pts)))))[0]"""
    )
    return parts.select(by, "name", rings.alias("rings"), (F.col("names") == 1).alias("name_agrees"))
