"""What circles settle without the kernel has to agree with it."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from areaframe.operators import circle


def test_bounds_agree_with_the_kernel_and_settle_most_edges(spark):
    r = np.random.default_rng(5)
    n = 4000
    y = np.where(np.arange(n) % 8 == 0, r.uniform(-89.9, 89.9, n), r.uniform(40, 83, n))
    x = np.where(np.arange(n) % 8 == 1, 179.9, r.uniform(-180, 180, n))
    radius = 1000.0 * r.integers(1, 101, n)
    c = pd.DataFrame({"circle_id": np.arange(n), "x": x, "y": y, "radius_m": radius})
    reach = np.degrees(radius / 6.37e6)
    c["ax"], c["ay"] = (x + 540 + 2 * reach * r.normal(size=n) / np.cos(np.radians(y))) % 360 - 180, np.clip(y + 2 * reach * r.normal(size=n), -90, 90)
    c["bx"], c["by"] = np.clip(c.ax + reach * r.normal(size=n), -180, 180), np.clip(c.ay + reach * r.normal(size=n), -90, 90)
    want = pd.Series(circle.within(c), c.circle_id)
    edges = spark.createDataFrame(c[["circle_id", "ax", "ay", "bx", "by"]])
    met = circle._bounds(circle.envelopes(spark.createDataFrame(c[["circle_id", "x", "y", "radius_m"]]))).join(edges, "circle_id")
    met = met.where("least(ax, bx) <= east AND west <= greatest(ax, bx) AND least(ay, by) <= north AND south <= greatest(ay, by)")
    got = met.withColumn("_t", F.expr(circle._T)).select("circle_id", F.expr(circle._IN).alias("sure"), F.expr(circle._OUT).alias("far")).toPandas()
    held = want[got.circle_id].to_numpy()
    assert held[got.sure].all() and not held[got.far & ~got.sure].any()
    assert held.sum() > 200 and (~(got.sure | got.far)).mean() < 0.2
