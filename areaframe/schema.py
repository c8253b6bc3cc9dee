"""Statuses, levels and table shapes of the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

# The order of the levels, and the statuses by precedence.
LEVELS = {"country": 0, "province": 1, "region": 2, "municipality": 3, "city_area": 4, "electoral_district": 5}
LOOKUP_STATUS = ["review_required", "ambiguous", "matched", "no_match"]
ASSIGNMENT_STATUS = ["hierarchy_only", "validated_source", "validated_derived", "unreviewed_repair", "missing_geometry", "unreviewed_parent", "unreviewed_overlap", "unavailable", "display_reference"]
MUNICIPAL_COVERAGE = ["included", "reference", "partial", "at_large", "unverified", "unavailable", "historical_only"]
ROLES = ["assignment", "candidate", "review", "bbox", "display"]

#: part and ring number (0: outer), then a closed ring of points; interior on the left.
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("pts", T.ArrayType(POINT))]))

AREA = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("id", "source_id", "name", "level")),
        T.StructField("level_rank", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("kind", "layer", "parent_id", "province_id", "scheme", "edition", "assignment_status", "lifecycle_status", "uncertainty_basis")),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("issues", T.ArrayType(T.StringType())),
    ]
)
GEOMETRY = T.StructType([T.StructField("area_id", T.StringType()), T.StructField("role", T.StringType()), T.StructField("rings", RINGS)])
