"""Finding benchmark passages in documents: SimHash of item-sized windows, then exact weighted-shingle similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arcloom.llm.common import lean, raw, small_batches
from arcloom.llm.filters import changed
from arcloom.scratch import cut

SHINGLE, SIMILARITY = 5, 0.8
#: Of 64 bits. At a similarity of 0.8 about 10 bits differ, with a deviation of 3: the radius is more than three deviations off. Two blocks
#: of 32 bits filter best: one in twenty random pairs has a block within half the radius, while eight blocks would let nearly all through.
RADIUS, BLOCKS = 20, 2
#: Pairs of windows and items whose blocks are compared at a time.
AT_A_TIME = 1 << 21
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes.
ITEM_BYTES = 8 << 20
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words: lower-cased (A-Z), without ASCII punctuation, divided at white space."""
        if len(self) > 250_000:
            self.clear()
        words = text.lower().translate(None, _PUNCTUATION).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * _MULTIPLIERS[j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def signed_bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1, bitorder="little").view(np.uint64)[..., 0]


@dataclass
class Sized:
    """The items of one length: multi-index over the blocks of their fingerprints."""

    ids: list[int]
    prints: np.ndarray
    counts: list[Counter]

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for every fingerprint within the radius: by the pigeonhole principle one of the
        blocks of such a pair differs in at most ``RADIUS // BLOCKS`` bits, so the blocks miss none; then all bits decide."""
        step = max(1, AT_A_TIME // len(self.prints))
        items = self.prints.view(np.uint32).reshape(-1, BLOCKS)
        for k in range(0, len(prints), step):
            some = np.ascontiguousarray(prints[k : k + step])
            blocks = some.view(np.uint32).reshape(-1, BLOCKS)
            maybe = reduce(np.logical_or, (np.bitwise_count(blocks[:, b, None] ^ items[None, :, b]) <= RADIUS // BLOCKS for b in range(BLOCKS)))
            w, i = np.nonzero(maybe)
            near = np.bitwise_count(some[w] ^ self.prints[i]) <= RADIUS
            yield from zip((w[near] + k).tolist(), i[near].tolist(), strict=True)


class Benchmark:
    """The items of one pass, by shingle size (an item of fewer words is one shingle) and number of shingles."""

    def __init__(self, items: list[tuple[int, bytes]]):
        hashes, grouped, seeds = WordHashes(), defaultdict(list), defaultdict(lambda: defaultdict(set))
        for item, text in sorted(items, key=lambda x: (x[0] is None, "" if x[0] is None else x[0], x[1])):
            words = hashes.of(text)
            if len(words):
                k = min(SHINGLE, len(words))
                h = shingles(words, k)
                grouped[k, len(h)].append((item, h))
                for x in h.tolist():
                    seeds[k][x].add(len(h))
        self.sized = {key: Sized([i for i, _ in x], fingerprint(np.stack([signed_bits(h).sum(0) for _, h in x])), [Counter(h.tolist()) for _, h in x]) for key, x in grouped.items()}
        self.seeds = {k: (np.array(sorted(x), np.uint64), [sorted(x[h]) for h in sorted(x)]) for k, x in seeds.items()}
        self.filter = {}
        for k, (known, _) in self.seeds.items():
            self.filter[k] = np.zeros(1 << 20, bool)
            self.filter[k][known >> np.uint64(44)] = True

    def find(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """For each item found, the most similar window: (similarity, first word, words)."""
        found: dict[int, tuple[float, int, int]] = {}
        for k, (known, sizes) in self.seeds.items():
            h = shingles(words, k)
            at = np.flatnonzero(self.filter[k][h >> np.uint64(44)])
            if not len(at):
                continue
            place = np.searchsorted(known, h[at])
            hit = known[np.minimum(place, len(known) - 1)] == h[at]
            by_size = defaultdict(list)
            for p, s in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
                for size in sizes[s]:
                    by_size[size].append(p)
            for size, places in by_size.items():
                self._windows(h, k, size, places, found)
        return found

    def _windows(self, h: np.ndarray, k: int, size: int, places: list[int], found: dict) -> None:
        """Every window of ``size`` shingles that holds a shingle of an item so large."""
        n = min(size, len(h))
        sized = self.sized[k, size]
        edges = np.zeros(len(h) + 2, np.int32)
        p = np.array(places)
        np.add.at(edges, np.maximum(p - n + 1, 0), 1)
        np.add.at(edges, np.minimum(p, len(h) - n) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for i in range(0, len(part), 4096):
                a, b = int(part[i]), int(part[min(i + 4096, len(part)) - 1])
                sums = np.cumsum(np.concatenate([np.zeros((1, 64), np.int32), signed_bits(np.ascontiguousarray(h[a : b + n]))]), axis=0)
                prints = fingerprint(sums[n:] - sums[:-n])
                for w, item in sized.within(prints):
                    similarity = self.similarity(h[a + w : a + w + n], sized.counts[item])
                    best = found.get(sized.ids[item], (0.0, 0, 0))
                    if similarity >= SIMILARITY and similarity > best[0]:
                        found[sized.ids[item]] = (similarity, a + w, n + k - 1)

    @staticmethod
    def similarity(window: np.ndarray, item: Counter) -> float:
        """Weighted Jaccard: shingles weigh as often as they occur."""
        own = Counter(window.tolist())
        both = sum(min(n, item[x]) for x, n in own.items() if x in item)
        return both / (sum(own.values()) + sum(item.values()) - both)


def passes(benchmark: DataFrame, id_col: str, text_col: str, most: int = ITEM_BYTES) -> Iterator[Benchmark]:
    """The benchmark in parts of a bounded size, of which one is held at a time; most benchmarks are one part."""
    part, held = [], 0
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col)
    for item, text in rows.toLocalIterator():
        if part and held + len(text) > most:
            yield Benchmark(part)
            part, held = [], 0
        part.append((item, text.encode()))
        held += len(text)
    if part:
        yield Benchmark(part)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words`` for each document and each benchmark item it holds.

    A document holds an item if a window of as many words (or the whole document, if shorter) has a weighted
    Jaccard similarity of at least 0.8 of five-word shingles with it; the most similar window is given, the earliest of
    equals. Words are lower-cased and without ASCII punctuation. Only windows that share a shingle with an item of
    their size are looked at, which loses none, as no other reaches any similarity. Null texts and texts or items without words hold
    nothing; rows that repeat an id are one document each; two rows of one item id count as that item, and so do rows without an id, with a null item_id; empty tables give no rows.
    The documents are read in place, without a shuffle, once for each bounded part of the benchmark; with several, each part's result is written before
    the next part is taken, so that driver and executors hold one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, similarity double, first_word long, n_words long"
    names = [x.split()[0] for x in kinds.split(", ")]
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def one(items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, b = WordHashes(), items.value
            for batch in batches:
                rows = [(i, item, *x) for i, text in enumerate(raw(batch, "text")) for item, x in sorted(b.find(words.of(text)).items(), key=lambda found: (found[0] is None, found[1][1], str(found[0])))]
                row, item, similarity, first, n = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, item_kind), pa.array(similarity, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names)

        return narrow.mapInArrow(lean(run), kinds)

    found, before = [], None
    for part in passes(benchmark, item_col, item_text):
        if before is not None:
            found.append(cut(one(before)))
            before.destroy()
        before = spark.sparkContext.broadcast(part)
    if before is not None:
        found.append(one(before))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], kinds)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. A row with a null id stays unless a row with a null id holds one.
    Only documents that a filter takes for such are shuffled."""
    bad = cut(leaks(docs, benchmark, id_col, text_col).select("doc_id").distinct())
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, own = docs.toDF(*at.values()), at[id_col]
    kept = changed(rows, F.xxhash64(own), bad.select(F.xxhash64("doc_id").alias("hash")), lambda some: some.join(bad, some[own].eqNullSafe(bad["doc_id"]), "left_anti"))
    return kept.toDF(*docs.columns)
