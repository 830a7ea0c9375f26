"""Weakly connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.scratch import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected edge list, as rows ``(node, root)`` with the smallest node as root.

    Only nodes that have an edge to another node are returned; nulls and self-loops are ignored and repeated
    edges count once. Every step is a map-side combined ``min`` per node and one equi-join back to the edges, so a
    hub of any degree is never gathered into one task; each round is written to the shared folder. The number of
    rounds grows with the logarithm of the largest component.
    """
    flat = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    now = cut(flat.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v")
        now = cut(small.distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
