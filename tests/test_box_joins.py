"""Joins by boxes must not compare more than what lies near each other."""

from pyspark.sql import functions as F

from areaframe.functions import geometry as G
from areaframe.operators import cells, conformance


def slices(spark, n):
    """n narrow boxes beside each other within one degree, which touch and do not overlap, but for the last."""
    r = spark.range(n).select(F.concat(F.lit("a-"), F.format_string("%05d", "id")).alias("area_id"), F.lit("assignment").alias("role"), (F.col("id") / n).alias("x0"), ((F.col("id") + 1) / n).alias("x1"))
    r = r.withColumn("x0", F.expr(f"IF(x1 = 1D, x0 - .5D / {n}, x0)"))
    return r.select("area_id", "role", F.expr(f"array({G.box_rings('x0', '0D', 'x1', '1D')})").alias("rings"))


def test_pairs_of_boxes_that_only_touch_reach_no_overlay(spark):
    g = slices(spark, 300)
    assert cells.box_pairs(g, g, least=1e-9).where("a < b").collect() == [("a-00298", "a-00299")]
    assert cells.box_pairs(g, g).where("a < b").count() == 299
    assert [(r["a"], r["b"]) for r in conformance.edition_overlaps(g, 1e-9).collect()] == [("a-00298", "a-00299")]


def test_box_joins_are_no_nested_loops(spark):
    g = slices(spark, 300)
    p = spark.range(500).select(F.col("id").alias("point_id"), (F.col("id") / 499).alias("x"), F.lit(0.5).alias("y"))
    met = cells.nested_loop(p, g, "point_id")
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(met.collect()) == sorted(cells.cover(p, g, "point_id").collect())
