"""Contracts: every check returns the rows that violate it, never a silent pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaframe.functions.text import is_date, is_public_url, valid_position


def identity_digest(df: DataFrame, by: str, id_: str = "id") -> DataFrame:
    """SHA-256 of each group's sorted ids, one a line; and its count."""
    return df.groupBy(by).agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(id_)), "\n"), F.lit("\n")), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def large_identity_digest(df: DataFrame, by: str, id_: str = "id") -> DataFrame:
    """An order-free digest for groups that should not be gathered: xor and sum of 64-bit hashes."""
    h = F.xxhash64(id_)
    return df.groupBy(by).agg(F.bit_xor(h).alias("digest_xor"), F.sum(h.cast("decimal(38,0)")).alias("digest_sum"), F.count(F.lit(1)).alias("n"))


def identity_diff(expected: DataFrame, actual: DataFrame, id_: str = "id") -> DataFrame:
    """id, fault: missing, unexpected or duplicate."""
    e = expected.select(F.col(id_).alias("e")).distinct()
    a = actual.groupBy(F.col(id_).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    j = e.join(a, F.col("e") == F.col("a"), "full")
    fault = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return j.select(F.coalesce("e", "a").alias("id"), fault.alias("fault")).where("fault IS NOT NULL")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def count_check(df: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """Groups whose count is not the expected one (columns of the key and ``expected``)."""
    got = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    j = expected.join(got, list(key), "full").na.fill(0, ["n", "expected"])
    return j.where("n <> expected")


def violations(**checks: Column) -> Column:
    """Names of the checks that a row fails, in the order given; a null check fails."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    return F.filter(found, lambda x: x.isNotNull())


def source_record_violations(df: DataFrame) -> DataFrame:
    """Ids of municipality, division and province: digits, and each the prefix of the next."""
    return df.withColumn(
        "violations",
        violations(
            municipality_id=F.col("csd").rlike(r"^\d{7}$"),
            division_prefix=F.col("csd").startswith(F.col("cd")) & F.col("cd").rlike(r"^\d{4}$"),
            province_prefix=F.col("cd").startswith(F.col("pr")) & F.col("pr").rlike(r"^\d{2}$"),
            label=F.length(F.trim("name")).between(1, 200),
        ),
    ).where("size(violations) > 0")


def edition_violations(editions: DataFrame, today: str) -> DataFrame:
    """Editions whose dates do not hold: effective before the end, nothing changed in future, a default is current."""
    start, end = F.col("effective_date").try_cast("date"), F.col("valid_to").try_cast("date")
    checks = violations(
        effective_date=F.col("effective_date").isNull() | is_date(F.col("effective_date")),
        valid_to=F.col("valid_to").isNull() | is_date(F.col("valid_to")),
        ordered=start.isNull() | end.isNull() | (start < end),
        not_future=start.isNull() | (start <= F.lit(today).cast("date")) | ~F.col("default"),
        default_is_current=~F.col("default") | (F.col("status") == "current"),
        evidence=F.col("evidence_url").isNull() | is_public_url(F.col("evidence_url")),
    )
    return editions.withColumn("violations", checks).where("size(violations) > 0")


def edition_rows(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """District rows that disagree with their edition: layer, status, province, count."""
    counts = rows.groupBy("edition").agg(F.count(F.lit(1)).alias("n_rows"))
    e = editions.select(F.col("id").alias("edition"), F.col("layer").alias("e_layer"), "provinces", "expected_count").join(counts, "edition", "left")
    j = rows.join(e, "edition", "left")
    checks = violations(
        edition_known=F.col("e_layer").isNotNull(),
        layer=F.col("layer") == F.col("e_layer"),
        province=F.array_contains("provinces", F.col("province_id")),
        count=F.col("n_rows") == F.col("expected_count"),
    )
    return j.select("id", "edition", checks.alias("violations")).where("size(violations) > 0")


def extent_violations(df: DataFrame) -> DataFrame:
    """Bounding boxes (area_id, west, south, east, north) outside WGS 84 or the wrong way round."""
    ok = violations(position=valid_position(F.col("west"), F.col("south")) & valid_position(F.col("east"), F.col("north")), ordered=(F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")))
    return df.withColumn("violations", ok).where("size(violations) > 0")


def asymmetric_succession(areas: DataFrame) -> DataFrame:
    """id, other, fault: a predecessor that does not name its successor, or the reverse."""
    up = areas.select(F.col("id").alias("new"), F.explode("predecessor_ids").alias("old")).withColumn("u", F.lit(True))
    down = areas.select(F.col("id").alias("old"), F.explode("successor_ids").alias("new")).withColumn("d", F.lit(True))
    j = up.join(down, ["new", "old"], "full")
    return j.where("u IS NULL OR d IS NULL").select("new", "old", F.when(F.col("u").isNull(), "successor_only").otherwise("predecessor_only").alias("fault"))


def display_gaps(areas: DataFrame, geometry: DataFrame) -> DataFrame:
    """id, fault: located areas without display geometry, and displays of unknown areas."""
    located = geometry.where("role IN ('assignment', 'candidate')").select(F.col("area_id").alias("id")).distinct().withColumn("located", F.lit(True))
    shown = geometry.where("role = 'display'").select(F.col("area_id").alias("id")).distinct().withColumn("shown", F.lit(True))
    known = areas.select("id").withColumn("known", F.lit(True))
    j = known.join(located, "id", "full").join(shown, "id", "full")
    fault = F.when(F.col("shown") & F.col("known").isNull(), "unknown_display").when(F.col("located") & F.col("shown").isNull(), "missing_display")
    return j.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def redistribution_approved(source: str = "source") -> Column:
    """A source may be handed on when its licence is named and approved and no condition is open."""
    return F.expr(f"coalesce({source}.licence IS NOT NULL AND {source}.status = 'approved' AND forall({source}.conditions, c -> c.met), false)")


def attribution(authority: Column, licence: Column) -> Column:
    return F.when(authority.isNull(), "Source not stated").otherwise(F.concat(F.lit("Contains information from "), authority, F.when(licence.isNotNull(), F.concat(F.lit(", "), licence)).otherwise("")))
