"""Filters of a fixed size that tell which few of many rows have to move."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import lean

#: Bits of a filter of documents: a fixed size whatever the corpus. It only lets too much through as it fills.
DOC_BITS = 1 << 25
KEY = "_key of the filter"


@dataclass
class Bits:
    """A filter over 64-bit hashes, eight bits to a byte; it travels compressed."""

    words: np.ndarray

    def __getstate__(self) -> tuple[bytes, int]:
        return pa.compress(self.words.tobytes(), "zstd", asbytes=True), len(self.words)

    def __setstate__(self, state: tuple[bytes, int]) -> None:
        self.words = np.frombuffer(pa.decompress(state[0], state[1], "zstd", asbytes=True), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h % np.uint64(8 * len(self.words))).astype(np.int64)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def filter_of(hashes: DataFrame, bits: int) -> Bits:
    """The filter of the column ``hash``; bitmaps are made where the rows are and only they come to the driver."""
    return filters_of(hashes.select("hash", F.lit(1).alias("count")), [(bits, 0)])[0][0]


def filters_of(counts: DataFrame, sizes: list[tuple[int, int]]) -> tuple[list[Bits], int]:
    """For each ``(bits, least)`` the filter of the hashes in ``hash, count`` with a count above ``least``, all in one pass, and the sum of all counts."""
    places = []
    for k, (bits, least) in enumerate(sizes):
        at = F.pmod(F.col("hash"), F.lit(bits)) + 1
        places.append(F.when(F.col("count") > least, F.struct(F.lit(k).alias("k"), F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))))
    each = counts.select("count", F.explode(F.array(*places)).alias("at")).where("at IS NOT NULL")
    words, total = [np.zeros(bits >> 3, np.uint8) for bits, _ in sizes], 0
    for k, b, m, n in each.groupBy("at.k", "at.b").agg(F.bitmap_construct_agg(F.col("at.p")), F.sum(F.col("count").cast("bigint"))).collect():
        words[k][(b - 1) << 12 : b << 12] = np.frombuffer(m, np.uint8)
        total += n if k == 0 else 0
    return [Bits(w) for w in words], total


def passing(bits: Broadcast, yes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows whose column ``KEY`` is (or isn't) in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = bits.value.has(batch.column(KEY).to_numpy().view(np.uint64))
            some = batch.filter(pa.array(own == yes))
            if some.num_rows:
                yield some

    return run


def changed(docs: DataFrame, key: Column, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with ``change`` (a join, say) applied to the rows whose 64-bit ``key`` is among the column ``hash`` of ``keys``.

    Only rows that a filter of a fixed size takes for those are changed, and so shuffled; ``change`` must keep the others among them, and all columns.
    """
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(keys, DOC_BITS))
    keyed = docs.withColumn(KEY, key)
    stay, go = (keyed.mapInArrow(lean(passing(bits, yes)), keyed.schema).drop(KEY) for yes in (False, True))
    return stay.unionAll(change(go))
