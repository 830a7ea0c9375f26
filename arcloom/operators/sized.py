"""Joins whose tasks stay of one size, however large the tables are.

Spark joins a shuffle's partitions up to so many compressed bytes. Ids compress to a few bytes each and take a sort or a hash table
fifty and more, so what is left to Spark can meet in a few tasks of gigabytes. Here the number of partitions follows the tables' size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.scratch import cut

#: Rows that are sent to every executor at most, and Spark's estimate of a partition's bytes in files.
FEW, PART = 500_000, 4_000_000


def parts(*frames: DataFrame) -> int:
    """How many partitions frames that meet by a key need; Spark's own number if it can't tell their size."""
    spark = frames[0].sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in frames)
    return usual if size >= 1 << 50 else max(min(usual, spark.sparkContext.defaultParallelism), -(-size // PART))


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    return df.repartition(n or parts(df), *keys)


def follow(frontier: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """The frontier's rows with the links from their ``id``. A frontier of a few rows goes to the links, which then aren't shuffled."""
    if rows <= FEW:
        return links.join(F.broadcast(frontier), F.col("near") == F.col("id"))
    n = parts(frontier, links)
    return dealt(frontier, "id", n=n).join(dealt(links, "near", n=n), F.col("id") == F.col("near"))


def among(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose ``key`` is (for ``left_anti``: is not) in column ``id`` of a frame that is written already."""
    ids = ids.select(F.col("id").alias(key))
    if ids.count() <= FEW:
        return df.join(F.broadcast(ids), key, how)
    n = parts(df, ids)
    return dealt(df, key, n=n).join(dealt(ids, key, n=n), key, how)


def absent(ids: DataFrame, known: DataFrame) -> DataFrame:
    """The different ``id`` of one frame that another lacks, written; null is never known."""
    n = parts(ids, known)
    return cut(dealt(ids.select("id"), "id", n=n).distinct().join(dealt(known.select("id"), "id", n=n), "id", "left_anti"))


def with_ends(links: DataFrame, known: DataFrame) -> DataFrame:
    """The links (written already) that lead to known nodes. Mostly all do, so it is the missing ends that are looked for."""
    return among(links, "far", absent(links.select(F.col("far").alias("id")), known), "left_anti").where("far IS NOT NULL")
