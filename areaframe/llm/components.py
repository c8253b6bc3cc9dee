"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaframe.llm.common import parts, write_table


def _both(first: tuple[str, str], second: tuple[str, str]) -> Column:
    """Two edges for each row, in one pass."""
    return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (first, second))))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Hang the larger (or, small star: the smaller) neighbours of each node on the least of them; in n partitions."""
    both = edges.select(_both(("u", "v"), ("v", "u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.hint("merge").join(least, "u").coalesce(n)
    out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(_both(("v", "m"), ("u", "m")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the smallest node it reaches) for every node of the edges (u, v).

    Each round writes its edges to the shared folder; the rounds end when nothing changes,
    after about log2 of the longest path.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = write_table(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        n = parts(edges)
        edges = write_table(_star(_star(edges.coalesce(n), True, n), False, n), "edges")
        if (now := state(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.coalesce(parts(edges)).select(_both(("u", "v"), ("v", "v"))).select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
