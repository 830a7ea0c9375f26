"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import chosen, local, small_batches


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, each: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[object, int, bytes]], dict[int, int]]:
    """At most ``each`` labelled documents of either class, by the id's hash over all of them, and the classes' sizes.

    ``learn`` picks the rows of ``labels`` that may be learned from. Labels other than 0 and 1 and null ids or texts
    take no part; of an id with several labels the largest counts, of one with several texts that of the smallest hash.
    """
    small_batches(docs.sparkSession)
    rows = labels.where(learn & F.col(id_col).isNotNull()).where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    sizes = {int(y): int(n) for y, n in rows.groupBy("y").count().collect()}
    keys = [(k, y) for y in (0, 1) for k in chosen(rows.where(F.col("y") == y), id_col, each)]
    if not keys:
        return [], sizes
    few = local(docs.sparkSession, f"{id_col} {labels.schema[id_col].dataType.simpleString()}, y int", *zip(*keys, strict=True))
    found = docs.select(id_col, F.col(text_col).cast("binary").alias("text")).where("text is not null").join(F.broadcast(few), id_col)
    found = found.groupBy(id_col, "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sorted((r[id_col], int(r["y"]), bytes(r["text"])) for r in found.toLocalIterator()), sizes
