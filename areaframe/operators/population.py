"""Census population: guarded crosswalk, official transfers, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjusted(areas: DataFrame, facts: DataFrame, transfers: DataFrame) -> DataFrame:
    """area_id, population, reason, n_adjustments.

    count = census gained minus lost. A missing census value keeps its reason, a transfer
    without a count makes the result unknown, and an area without a fact is unmatched:
    nothing unknown is read as zero.
    """
    gain = transfers.select(F.col("gain_id").alias("area_id"), F.col("n").alias("delta"))
    loss = transfers.select(F.col("loss_id").alias("area_id"), (-F.col("n")).alias("delta"))
    sums = gain.unionByName(loss).groupBy("area_id").agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("n_adjustments"), F.count_if(F.col("delta").isNull()).alias("n_unknown"))
    j = areas.select("area_id").join(facts, "area_id", "left").join(sums, "area_id", "left").na.fill(0, ["n_adjustments", "n_unknown"])
    unknown = F.when(F.col("matched").isNull(), "unmatched").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("n_unknown") > 0, "transfer_not_available")
    total = F.when(unknown.isNull(), F.col("value") + F.coalesce("delta", F.lit(0)))
    return j.select("area_id", total.alias("population"), unknown.alias("reason"), "n_adjustments")


def crosswalk_account(areas: DataFrame, matches: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Active municipalities that the plan does not account for exactly once."""
    rows = matches.select("area_id").unionByName(unavailable.select("area_id")).groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    j = areas.select("area_id").withColumn("active", F.lit(True)).join(rows, "area_id", "full")
    fault = F.when(F.col("active").isNull(), "not_active").when(F.col("n").isNull(), "not_accounted").when(F.col("n") > 1, "accounted_twice")
    return j.select("area_id", fault.alias("fault")).where("fault IS NOT NULL")


def coverage(records: DataFrame) -> DataFrame:
    """Known, zero, missing and total population, by level and by province in one pass."""
    return (
        records.groupingSets([["level"], ["province_id"]], "level", "province_id")
        .agg(
            F.count_if(F.col("population").isNotNull()).alias("n_known"),
            F.count_if(F.col("population") == 0).alias("n_zero"),
            F.count_if(F.col("population").isNull()).alias("n_missing"),
            F.sum("population").alias("population"),
        )
        .select("level", "province_id", "n_known", "n_zero", "n_missing", "population")
    )


def stale(plan: DataFrame, current: DataFrame) -> DataFrame:
    """Plan rows (area_id, fingerprint) whose territory has changed or is gone."""
    j = plan.join(current.withColumnRenamed("fingerprint", "now"), "area_id", "left")
    return j.where("now IS NULL OR now <> fingerprint").select("area_id", F.when(F.col("now").isNull(), "gone").otherwise("changed").alias("fault"))


def automatic_plan(current: DataFrame, census: DataFrame, transfers: DataFrame) -> DataFrame:
    """Same code, same territory, no transfer: area_id, code, basis."""
    moved = transfers.select(F.col("gain_id").alias("area_id")).unionByName(transfers.select(F.col("loss_id").alias("area_id"))).distinct()
    same = current.join(census.withColumnRenamed("fingerprint", "census_fingerprint"), "code").where("fingerprint = census_fingerprint")
    return same.join(moved, "area_id", "left_anti").select("area_id", "code", F.lit("unchanged_territory").alias("basis"))


def with_population(page: DataFrame, records: DataFrame) -> DataFrame:
    """Pages enriched with population; what has no record says so."""
    return page.join(records, "area_id", "left").withColumn("reason", F.when(F.col("population").isNull() & F.col("reason").isNull(), "no_source").otherwise(F.col("reason")))
