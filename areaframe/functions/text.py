"""Text and value functions of the catalogue."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Province codes by the two leading digits of a municipal id.
PROVINCES = {"10": "NL", "11": "PE", "12": "NS", "13": "NB", "24": "QC", "35": "ON", "46": "MB", "47": "SK", "48": "AB", "59": "BC", "60": "YT", "61": "NT", "62": "NU"}


@F.pandas_udf(StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """Case-folded, compatibility-decomposed, without combining marks: the search key of a name."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "-"), F.lit("-"))


def stable_string(c: Column) -> Column:
    """A publisher's number as text: integral values lose their fraction."""
    n = c.try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)), n.cast("bigint").cast("string")).otherwise(c.cast("string"))


def code(c: Column, width: int, prefix: str = "") -> Column:
    """Zero-filled to ``width``; longer codes are left alone."""
    s = c.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))


def composite(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def province(c: Column) -> Column:
    pairs = [F.lit(x) for kv in PROVINCES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.substring(c, 1, 2))


def record_digest(*columns: str) -> Column:
    """SHA-256 of a record as JSON with sorted keys; a null field is kept, so that it differs from an absent one."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def source_identity(own: Column, prefix: Column, other: Column) -> Column:
    """A feature's identity: its own code, or else a prefix and the code of another field."""
    return F.coalesce(own.cast("string"), F.concat(prefix, other.cast("string")))


def is_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c.try_cast("date"), "yyyy-MM-dd") == c, F.lit(False))


def is_public_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https://[^\s/@]+(/\S*)?$"), F.lit(False))


def is_integral(c: Column) -> Column:
    d = c.try_cast("decimal(20,4)")
    return F.coalesce(d == F.floor(d), F.lit(False))


def aliases_without_name(aliases: Column, name: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(aliases), F.array(name)))


def census_symbol(value: Column, symbol: Column) -> tuple[Column, Column, Column]:
    """count, unavailable reason and quality flags of a census cell; unknown is never zero."""
    s = F.coalesce(F.trim(symbol), F.lit(""))
    reason = F.when(s == "x", "suppressed").when(s == "..", "not_available").when(s == "...", "not_applicable").when(value.isNull(), "missing_value")
    flags = F.when(s == "r", F.array(F.lit("revised"))).when(s == "E", F.array(F.lit("use_with_caution"))).otherwise(F.array().cast("array<string>"))
    return F.when(reason.isNull(), value), reason, flags


def fraction(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def valid_position(x: Column, y: Column) -> Column:
    return F.coalesce(~F.isnan(x) & ~F.isnan(y) & x.between(-180, 180) & y.between(-90, 90), F.lit(False))
