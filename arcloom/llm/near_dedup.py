"""SimHash near-duplicate classes by a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import give_back, lean, raw, small_batches, summed
from arcloom.llm.filters import DOC_BITS, changed, filter_of
from arcloom.llm.spans import Texts, grouped, mixed
from arcloom.operators.components import star_components
from arcloom.scratch import cut

SEED = 42
RADIUS = 4
#: First segment and number of segments of the bands to which the 32 two-bit segments are dealt.
BANDS = ((0, 5), (5, 5), (10, 5), (15, 5), (20, 4), (24, 4), (28, 4))
#: Words of a shingle where similarity itself decides, bits of a shingle by which occurrences are counted, and bits of the filter of shared shingles.
SIMILAR_WORDS, COUNT_BITS, TOKEN_BITS = 5, 20, 1 << 27
#: Multipliers of the words of a set's fingerprint, one for each 64 of its bits, and its radius. At a similarity of 0.8 a bit differs with a probability of at most
#: 0.162, or 0.1875 for sets of four and five shingles: over the radius is one such pair in 10^14 or more, or one in 3 * 10^10; within it four of a million random pairs.
PRINT_WORDS, SIMILAR_RADIUS = (0x9E3779B185EBCA87, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), 92
_F = [f"f{k}" for k in range(len(PRINT_WORDS))]
_KINDS = ", ".join(f"{f} long" for f in _F)
_EVEN_BITS = 0x5555555555555555
_BYTE_ONES = np.uint64(0x0101010101010101)
_STEP = 1 << 16


def simhash(text: bytes, words_in_shingle: int) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    if n <= words_in_shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    stops = (ends[words_in_shingle - 1 :] - 1).tolist()
    starts = [0, *ends[: n - words_in_shingle].tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """``(doc_id, h, fp)`` of every row: the id, a hash of the text, and the SimHash's 64 bits as a long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x, words_in_shingle) for x in raw(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps)], ["doc_id", "h", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, h long, fp long")


def _popcounts(fp: Column) -> Column:
    """The embedding: in each two-bit segment, the number of its bits that are set (0 to 2)."""
    low, high = fp.bitwiseAND(F.lit(_EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings, all segments at once.

    A segment's difference is 2 if one side is 0 and the other 2 (the high bits differ and no low bit is set),
    otherwise 1 if the low bits differ.
    """
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(_EVEN_BITS)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_EVEN_BITS))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints with at most ``radius`` (less than the number of bands) differing bits, each once.

    A flipped bit changes one segment's popcount by one, so the Manhattan distance of the embeddings is at most
    the Hamming distance, and at most ``radius`` of the seven bands of segments differ at all. The grid's cells are the counts of the others, for every
    choice of so many bands: two fingerprints meet in an equi-join on the cell, under the first choice on which they agree; Manhattan over all segments
    and then the bits themselves decide. At radius 4 a cell has 13 or more segments, so one pair of random fingerprints in 50,000 meets. Crowded cells Spark's skew join divides among tasks.
    """
    need = len(BANDS) - radius
    if need < 1:
        raise ValueError(f"{len(BANDS)} bands find links of at most {len(BANDS) - 1} bits")
    masks = [((1 << 2 * n) - 1) << 2 * first for first, n in BANDS]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    choices = list(combinations(range(len(BANDS)), need))
    first = []
    for agreeing in range(1 << len(BANDS)):
        bands = tuple(k for k in range(len(BANDS)) if agreeing >> k & 1)[:need]
        first.append(choices.index(bands) if len(bands) == need else -1)
    cells = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.col("v").bitwiseAND(F.lit(signed(sum(masks[i] for i in c))))).alias("cell")) for k, c in enumerate(choices)]
    met = fps.select("fp", _popcounts(F.col("fp")).alias("v")).select("fp", "v", F.explode(F.array(*cells)).alias("c"))
    a, b = (met.select(F.col("fp").alias(x), F.col("v").alias(f"v{x}"), F.col("c.k").alias(f"k{x}"), F.col("c.cell").alias("cell")) for x in "ab")
    apart = F.col("va").bitwiseXOR(F.col("vb"))
    agreeing = sum((F.when(apart.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, m in enumerate(masks)), F.lit(0))
    once = F.element_at(F.array(*map(F.lit, first)), agreeing + 1) == F.col("ka")
    near = (_manhattan(F.col("va"), F.col("vb")) <= radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return a.hint("merge").join(b, "cell").where((F.col("a") < F.col("b")) & near & (F.col("ka") == F.col("kb")) & once).select("a", "b")


def _classes(members: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, least)`` of every fingerprint; ``least`` is its first row ``(no id, id, h)``, null ids last."""
    nodes = cut(members.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")))
    roots = star_components(links(nodes, radius), "a", "b")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """Classes of documents whose fingerprints are linked, directly or through others.

    Returns ``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (the smallest id of the class; null if all
    its ids are null), a row for each input row, repeated rows included. Null and empty texts have fingerprint zero
    and are linked like any other; an empty table gives no rows; other columns of the input are ignored. Only distinct
    fingerprints are joined, so a group of copies costs one row however large it is, and no task holds a group.
    """
    members = cut(fingerprints(docs, id_col, text_col, words_in_shingle))
    rooted = _classes(members, radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of_fp = cut(rooted.join(named, "root").select("fp", F.col("first.doc_id").alias("component_id")))
    return members.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """The input's rows without near-duplicates: of each class the row with the smallest id stays (null ids last).

    Of rows that repeat that id, the one whose text has the smallest hash stays. All columns are returned as they were.
    """
    members = cut(fingerprints(docs, id_col, text_col, words_in_shingle))
    first = _classes(members, radius).groupBy("root").agg(F.min("least").alias("f"))
    return _kept(docs, members, first, id_col, text_col)


def _kept(docs: DataFrame, members: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that column ``f`` of ``first`` names by id and text hash, one each, with all columns as they were; ``members`` has
    ``doc_id, h`` of every row. Only rows that may go are shuffled."""
    keep = cut(first.select(F.col("f.doc_id").alias("id"), F.col("f.h").alias("h")))
    rows = members.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["id"]) & rows["h"].eqNullSafe(keep["h"]), "left")
    moving = kept.where((F.col("n") > 1) | keep["h"].isNull()).select(F.xxhash64("doc_id", rows["h"]).alias("hash"))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*at.values()).withColumn("h", F.xxhash64(at[text_col]))

    def change(some: DataFrame) -> DataFrame:
        left = some.join(keep.withColumnRenamed("h", "kh"), some[at[id_col]].eqNullSafe(F.col("id")) & (some["h"] == F.col("kh")), "left_semi")
        return left.dropDuplicates([at[id_col], "h"])

    return changed(own, F.xxhash64(at[id_col], "h"), moving, change).select(*(F.col(x).alias(c) for c, x in at.items()))


class ShingleSets:
    """The different shingles of ``SIMILAR_WORDS`` words of some texts (of fewer words: all of them as one), as hashes: ``text`` and ``token``
    of each, by text; how many each text has (``n``), and a hash of each text's whole set (``s``)."""

    def __init__(self, texts: Texts):
        k, n = SIMILAR_WORDS, len(texts.hashes)
        at = np.flatnonzero((texts.first + texts.n)[texts.text] - np.arange(n) >= k)
        short = np.flatnonzero(texts.n < k)  # texts without words have the hash of none
        token = np.concatenate([texts.sums.of(at, at + k), texts.sums.of(texts.first[short], texts.first[short] + texts.n[short])])
        text = np.concatenate([texts.text[at], short])
        order = np.lexsort((token, text))
        token, text = token[order], text[order]
        new = np.append(True, (token[1:] != token[:-1]) | (text[1:] != text[:-1]))[: len(token)]
        self.token, self.text = token[new], text[new]
        self.n = np.bincount(self.text, minlength=len(texts.n))
        starts = np.cumsum(self.n) - self.n
        whole = mixed(self.token * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
        self.s = np.add.reduceat(whole, starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)

    def prints(self) -> np.ndarray:
        """The SimHash of each set, as rows of 64-bit words: a bit is 1 if set in over half the shingles' hashes."""
        parts = -(-self.n // 255)  # of as many shingles as a byte can count
        part = np.cumsum(parts) - parts
        first = np.repeat(np.cumsum(self.n) - self.n - 255 * part, parts) + 255 * np.arange(parts.sum())
        out = np.zeros((len(PRINT_WORDS), len(self.n)), np.int64)
        for w, multiplier in enumerate(PRINT_WORDS):
            h, ones = mixed(self.token * np.uint64(multiplier)), np.zeros((len(self.n), 8, 8), np.int64)
            for k in range(8):
                counted = np.add.reduceat(h >> np.uint64(k) & _BYTE_ONES, first).view(np.uint8).reshape(-1, 8)
                ones[:, :, k] = np.add.reduceat(counted, part, axis=0, dtype=np.int64)
            out[w] = np.packbits(2 * ones.reshape(-1, 64) > self.n[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
        return out

    def prefix(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of which one at least is shared by any two sets of similarity 0.8: the rarest fifth (and one more) of each. Their
        places, their ranks in their set, and a number that orders each set's last such token among all tokens."""
        rarity = np.bitwise_count(_smeared(counts[self.token >> np.uint64(64 - COUNT_BITS)]))
        order = np.lexsort((self.token, rarity, self.text))
        rank, size = np.arange(len(order)) - np.repeat(np.cumsum(self.n) - self.n, self.n), self.n - (4 * self.n + 4) // 5 + 1
        place = (rarity.astype(np.uint64) << np.uint64(57) | self.token >> np.uint64(7)).view(np.int64)
        last = place[order[np.cumsum(self.n) - self.n + size - 1]]
        some = rank < np.repeat(size, self.n)
        return order[some], rank[some], last


def _smeared(x: np.ndarray) -> np.ndarray:
    """Each number with all bits below its highest one set."""
    for k in (1, 2, 4, 8, 16):
        x = x | x >> np.uint32(k)
    return x


def _sets(batch: pa.RecordBatch) -> Iterator[ShingleSets]:
    for _, texts in grouped([x.lower() for x in raw(batch, "text")]):
        yield ShingleSets(texts)


def _counts(texts: DataFrame) -> np.ndarray:
    """In how many texts shingles occur, by the first bits of their hashes: a table of a fixed size, whatever the corpus. It tells apart what many texts say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for x in _sets(batch):
                np.add.at(n, (x.token >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["n"])

    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    total = summed(texts.coalesce(tasks).mapInArrow(lean(run), "n binary"), tasks, np.uint32)
    return np.zeros(1 << COUNT_BITS, np.uint32) if total is None else total


def _sizes_fit() -> Column:
    return 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")


def _within(radius: int) -> Column:
    """Whether fingerprints of sets have at most ``radius`` differing bits: first the Manhattan distance of their embeddings, which is no more, then the bits."""
    a, b = ([F.col(f"{f}{x}") for f in _F] for x in "ab")
    manhattan = sum((_manhattan(_popcounts(x), _popcounts(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    bits = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return (manhattan <= radius) & (bits <= radius)


def _grid(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets of fitting sizes whose fingerprints have 1 to ``RADIUS`` differing bits in their first word, by the grid join of ``links``, and are within ``SIMILAR_RADIUS``."""
    met = links(cut(sets.select(F.col("f0").alias("fp")).distinct())).toDF("f0a", "f0b")
    a, b = (sets.select(F.col("s").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", *_F))) for x in "ab")
    return met.join(a, "f0a").join(b, "f0b").where(_sizes_fit() & _within(SIMILAR_RADIUS)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_links(texts: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different shingle sets, by their hashes, of Jaccard similarity 0.8 or more, each once; ``own`` has ``s, n`` and the fingerprint of each set.

    The fingerprint is a SimHash of 256 bits of the set. Pairs that differ in few bits of its first word meet in the grid of their popcounts. At a similarity of 0.8 about 10 bits of
    a word differ, and no grid that is sure to meet such pairs tells them from others; so the rest of the pairs meet in cells that their shingles name, which lose none. Both kinds go on if the Manhattan distance of
    the embeddings and then the bits are within the radius (see there), and whole sets decide.

    The cells of the rest: in any one order of all shingles, sets so similar share a shingle among the first fifth of each (and one more). Rare
    ones come first, so that what many texts say makes no candidates unless it is most of a text. Only shingles that two different sets have among
    their first (a filter of a fixed size says which may be) are joined. Shared shingles that aren't among the first of both come after the last of the set
    whose first ones end earlier, and after the last shared one of each; where what can follow is too little for a similarity of 0.8, as it is if
    two sets of equal size share less than an eleventh of their shingles among their first, the pair goes. Only sets in the pairs that stay are gathered, to decide.
    """
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(_counts(texts))

    def first(shared: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in _sets(batch):
                    at, rank, last = x.prefix(counts.value)
                    if shared:
                        some = shared.value.has(x.token[at])
                        at, rank = at[some], rank[some]
                    of = x.text[at]
                    columns = {"s": x.s[of], "token": x.token[at].view(np.int64)}
                    if shared:
                        columns |= {"n": x.n[of].astype(np.int32), "rank": rank.astype(np.int32), "last": last[of]} | dict(zip(_F, x.prints()[:, of], strict=True))
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

        return lean(run)

    kinds = "s long, token long"
    twice = texts.mapInArrow(first(None), kinds).groupBy(F.col("token").alias("hash")).agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b")
    shared = spark.sparkContext.broadcast(filter_of(twice.select("hash"), TOKEN_BITS))
    give_back(spark)
    prefixes = cut(texts.mapInArrow(first(shared), f"{kinds}, n int, rank int, last long, {_KINDS}").distinct())
    give_back(spark)
    a, b = (prefixes.select(F.col("s").alias(x), "token", *(F.col(c).alias(f"{c}{x}") for c in ("n", "rank", "last", *_F))) for x in "ab")
    in_grid = F.bit_count(F.col("f0a").bitwiseXOR(F.col("f0b"))).between(1, RADIUS)
    fits = (F.col("a") < F.col("b")) & _sizes_fit() & ~in_grid & _within(SIMILAR_RADIUS)
    met = a.hint("merge").join(b, "token").where(fits).groupBy("a", "b").agg(F.count("*").alias("k"), F.max("ranka").alias("i"), F.max("rankb").alias("j"), *(F.first(f"{c}{x}").alias(f"{c}{x}") for c in ("n", "last") for x in "ab"))
    behind = F.expr("(4 * if(lasta = lastb, greatest(na, nb), if(lasta < lastb, na, nb)) + 4) div 5 - 1")
    follow = F.least(behind, F.expr("na - 1 - i"), F.expr("nb - 1 - j"))
    rest = met.where(9 * (F.col("k") + follow) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")
    pairs = cut(_grid(own).unionAll(rest))
    give_back(spark)
    asked = spark.sparkContext.broadcast(filter_of(pairs.select(F.explode(F.array("a", "b")).alias("hash")).distinct(), DOC_BITS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _sets(batch):
                own = np.flatnonzero(asked.value.has(x.s.view(np.uint64)))
                stops = np.cumsum(x.n)
                sets = [x.token[stops[i] - x.n[i] : stops[i]].view(np.int64) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(x.s[own]), pa.array(sets, pa.list_(pa.int64()))], ["s", "set"])

    sets = cut(texts.mapInArrow(lean(whole), "s long, set array<long>").dropDuplicates(["s"]))
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("set").alias("y")), "b")
    shared_tokens = F.size(F.array_intersect("x", "y"))
    links = cut(both.where(5 * shared_tokens >= 4 * (F.size("x") + F.size("y") - shared_tokens)).select("a", "b"))
    for x in (counts, shared, asked):
        x.destroy()
    give_back(spark)
    return links


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without near-duplicates: texts whose sets of five-word shingles (lower-cased, white space apart) have a Jaccard similarity
    of 0.8 or more are linked, directly or through others, and of each class the row with the smallest id stays (null ids last). See ``similar_links``.

    Null and empty texts are equal. Of rows that repeat the id that stays, the one whose text has the smallest hash does. All columns are returned as they were.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate([np.zeros((2 + len(_F), 0), np.int64), *(np.vstack([x.s, x.n, x.prints()]) for x in _sets(batch))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *map(pa.array, rows)], ["doc_id", "h", "s", "n", *_F])

    members = cut(narrow.mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, h long, s long, n long, {_KINDS}"))
    give_back(docs.sparkSession)
    nodes = cut(members.groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")))
    roots = star_components(similar_links(narrow.select("text"), members.select("s", "n", *_F).distinct()), "a", "b")
    give_back(docs.sparkSession)
    rooted = nodes.join(roots, nodes["s"] == roots["node"], "left").select(F.coalesce("root", "s").alias("root"), "least")
    return _kept(docs, members, rooted.groupBy("root").agg(F.min("least").alias("f")), id_col, text_col)
