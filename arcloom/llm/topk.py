"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcloom.scratch import cut

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 4096, 8192


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, q, v array<long>)`` with floor(scale * x) of each component; vectors that are null or hold null or non-finite components go."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    usable = x.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.col(id_col).isNotNull()
    return df.where(usable).select(F.col(id_col).alias("id"), F.col("_q").alias("q"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term (component), the vectors in which it isn't zero, and its weights there."""
    width = max(map(len, vectors), default=0)
    dense = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    return [(at, dense[at, t]) for t in range(width) for at in [np.flatnonzero(dense[:, t])]]


def scores(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """One query's scores over ``n`` candidates: each of its terms scatters the weighted postings."""
    total = np.zeros(n, np.int64)
    for t in np.flatnonzero(query[: len(lists)]):
        at, weight = lists[t]
        if len(at) == n:
            total += query[t] * weight
        else:
            total[at] += query[t] * weight
    return total


def best(total: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest, ties to the smaller id: partition selection, then a sort of what's left."""
    if len(total) > k:
        least = total[np.argpartition(-total, k - 1)[:k]].min()
        at = np.flatnonzero(total >= least)
    else:
        at = np.arange(len(total))
    return at[np.lexsort((ids[at], -total[at]))][:k]


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row, all other rows being its candidates.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``; ties go to the smaller id, and fewer rows come back if
    there are fewer candidates. A row is a candidate of every query with another id; rows without an id are left out, as in the query's SQL; rows that repeat an id each
    count. Vectors of different lengths meet as if padded with zeros, so an empty one scores 0. Products are exact while they and their sums fit 64 bits.

    Candidates and queries are dealt into blocks of a fixed size and each pair of blocks meets in one task, which
    accumulates dense scores over the candidate block's postings and keeps ``k`` rows a query; those are merged.
    """
    marked = df.select(id_col, vector_col, F.coalesce(is_query, F.lit(False)).alias("_q"))
    vectors = cut(quantized(marked, id_col, vector_col, scale))
    asked = vectors.where("q").dropDuplicates(["id", "v"])
    total, n_asked = vectors.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-total // CANDIDATES)), max(1, -(-n_asked // QUERIES))
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = vectors.select("id", "v", block(1, c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    q = asked.select("id", "v", block(2, q_blocks).alias("qb"), every(c_blocks).alias("cb"))

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        lists, ids = postings(list(candidates["v"])), candidates["id"].to_numpy()
        found: list[tuple] = []
        for one, v in zip(queries["id"], queries["v"], strict=True):
            total = scores(np.asarray(v, np.int64), lists, len(ids))
            other = np.flatnonzero(ids != one)
            found += [(one, ids[i], int(total[i])) for i in other[best(total[other], ids[other], k)]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    met = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
