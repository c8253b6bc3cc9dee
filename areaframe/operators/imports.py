"""Imports of municipal editions: what a plan may bring in, the districts it makes, and what they replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaframe.functions.text import is_date
from areaframe.operators import validity
from areaframe.operators.conformance import edition_overlaps
from areaframe.operators.contract import violations
from areaframe.operators.editions import merged_features, rule_rows
from areaframe.operators.overlay import repaired
from areaframe.sources.workspace import written


def edition_faults(new: DataFrame, old: DataFrame, authorities: DataFrame, sources: DataFrame) -> DataFrame:
    """id, fault of new editions (id, authority_id, scheme, default, source, effective_date, expected_count).

    An edition is new, of a known authority (id, level municipality or region), with a source (source,
    n_features) that is there; its date is a date or null, and one edition at most of an authority and scheme is the default.
    """
    j = new.join(old.select("id", F.lit(True).alias("_old")).distinct().hint("merge"), "id", "left")
    j = j.join(authorities.select(F.col("id").alias("authority_id"), F.col("level").alias("_level")).hint("merge"), "authority_id", "left")
    j = j.join(sources.select("source", F.col("n_features").alias("_n")).hint("merge"), "source", "left")
    w = Window.partitionBy("authority_id", "scheme")
    j = j.withColumns({"_defaults": F.sum(F.col("default").cast("int")).over(w), "_times": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    checks = violations(
        new=F.col("_old").isNull(),
        once=F.col("_times") == 1,
        authority=F.col("_level").isin("municipality", "region"),
        source=F.col("_n") > 0,
        effective_date=F.col("effective_date").isNull() | is_date(F.col("effective_date")),
        one_default=~F.col("default") | (F.col("_defaults") == 1),
    )
    return j.select("id", F.explode(checks).alias("fault"))


def district_rows(features: DataFrame, editions: DataFrame, rules: DataFrame) -> DataFrame:
    """id, edition, code, name, rings, name_agrees: the districts of editions (id, source) from features
    (source, row_id, code, name, props, rings) that meet all of an edition's rules; rows of one code are its parts."""
    own = features.join(editions.select(F.col("id").alias("edition"), "source").hint("merge"), "source")
    ruled = rules.select("edition").distinct()
    keyed = own.withColumn("row_id", F.struct("edition", "row_id"))
    met = rule_rows(keyed.select("row_id", "props").join(ruled.hint("merge"), F.col("row_id.edition") == F.col("edition"), "left_semi"), rules).where("row_id.edition = edition").select("row_id")
    free = keyed.join(ruled.hint("merge"), "edition", "left_anti").select("row_id")
    kept = keyed.join(met.unionByName(free).hint("merge"), "row_id", "left_semi")
    merged = merged_features(kept.withColumn("key", F.struct("edition", "code")), "key")
    id_ = F.concat_ws("-", F.lit("d"), "key.edition", "key.code")
    return merged.select(id_.alias("id"), F.col("key.edition").alias("edition"), F.col("key.code").alias("code"), "name", "rings", "name_agrees")


def districts(rows: DataFrame, editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas (id, name, edition, authority_id, scheme, issue, assignment_status) and geometry (area_id, role, rings) of district rows.

    A sound shape is assigned. One that is not is missing, unless its repair is sound: that becomes a
    candidate that nobody has approved yet.
    """
    rows = written(rows, "districts")
    shapes = rows.select(F.col("id").alias("area_id"), "rings")
    faults = written(validity.faults(shapes), "district-faults")
    bad = shapes.join(faults.where("fault NOT IN ('missing', 'empty', 'short_ring', 'not_finite', 'open_ring')").hint("merge"), "area_id", "left_semi")
    mended = written(repaired(bad), "district-repairs")
    mended = written(mended.join(validity.faults(mended).hint("merge"), "area_id", "left_anti"), "sound-repairs")
    j = rows.join(faults.select(F.col("area_id").alias("id"), F.col("fault").alias("issue")).hint("merge"), "id", "left")
    j = j.join(mended.select(F.col("area_id").alias("id"), F.lit(True).alias("_mended")).hint("merge"), "id", "left")
    j = j.join(editions.select(F.col("id").alias("edition"), "authority_id", "scheme").hint("merge"), "edition")
    status = F.when(F.col("issue").isNull(), "validated_source").when(F.col("_mended"), "unreviewed_repair").otherwise("missing_geometry")
    areas = j.select("id", "name", "edition", "authority_id", "scheme", "issue", status.alias("assignment_status"))
    sound = shapes.join(faults.hint("merge"), "area_id", "left_anti").select("area_id", F.lit("assignment").alias("role"), "rings")
    return areas, sound.unionByName(mended.select("area_id", F.lit("candidate").alias("role"), "rings"))


def merged_editions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new editions (id, authority_id, scheme, default, ...): a new default takes that role in its authority and scheme."""
    taken = new.where("default").select("authority_id", "scheme").distinct().withColumn("_taken", F.lit(True))
    kept = old.join(taken.hint("merge"), ["authority_id", "scheme"], "left").withColumn("default", F.col("default") & F.col("_taken").isNull()).drop("_taken")
    return kept.unionByName(new.select(*old.columns))


def edition_checks(areas: DataFrame, geometry: DataFrame, editions: DataFrame, least: float) -> DataFrame:
    """edition, n, n_unavailable, n_overlaps, overlap_area, count_agrees: what has to be known about imported editions.

    Districts are compared within their edition only; overlaps up to ``least`` do not count.
    """
    a = areas.groupBy("edition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("assignment_status") != "validated_source").alias("n_unavailable"))
    of = areas.select(F.col("id").alias("area_id"), "edition")
    shapes = written(geometry.where("role = 'assignment'").join(of.hint("merge"), "area_id").select("area_id", "rings", "edition"), "edition-shapes")
    pairs = edition_overlaps(shapes, least, "edition").join(of.select(F.col("area_id").alias("a"), "edition").hint("merge"), "a")
    o = pairs.groupBy("edition").agg(F.count(F.lit(1)).alias("n_overlaps"), F.sum("intersection").alias("overlap_area"))
    j = editions.select(F.col("id").alias("edition"), "expected_count").join(a.hint("merge"), "edition", "left").join(o.hint("merge"), "edition", "left").na.fill(0, ["n", "n_unavailable", "n_overlaps"]).na.fill(0.0, ["overlap_area"])
    return j.select("edition", "n", "n_unavailable", "n_overlaps", "overlap_area", (F.col("n") == F.col("expected_count")).alias("count_agrees"))
