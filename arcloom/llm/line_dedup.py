"""Removing passages that repeat anywhere in the corpus: runs of 50 words first, then content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import lean, raw, small_batches
from arcloom.llm.filters import DOC_BITS, Bits, filter_of, filters_of
from arcloom.llm.spans import Texts, grouped, mixed, sliding
from arcloom.scratch import cut

#: Words of the shortest run that is found wherever it stands; words of the hashes of which a run's smallest is its sign.
RUN, GRAM = 50, 25
_SIGNS = RUN - GRAM + 1
#: Words that the two lines of a chunk's middle have at least.
LEAST_WORDS = 10
#: Bits of the filters of hashes that repeat and of those that repeat often: fixed sizes whatever the corpus. They only let too much through as they fill.
SOME_BITS, MANY_BITS = 1 << 27, 1 << 24
#: Places of one hash beyond which they are dealt to several groups, and places in all for which one more group is made.
MANY, EACH_GROUP = 1000, 4_000_000
#: Places of which one partition more is made.
EACH_PARTITION = 500_000
#: Rows that a task compares at a time, and keys of a dealt group that it keeps.
_ROWS, _KEPT = 1 << 14, 1 << 20


def _first(*keys: np.ndarray) -> np.ndarray:
    """Whether each place is the first one with its keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        order = np.lexsort(keys)
        same = np.ones(len(out) - 1, bool)
        for k in keys:
            ordered = k[order]
            same &= ordered[1:] == ordered[:-1]
        out[order[1:]] = ~same
    return out


class Runs:
    """All runs of ``RUN`` words of some texts: the first word ``at`` of each, its text, its sign, and its digest.

    A run's sign is the smallest hash of ``GRAM`` words in it, so equal runs have equal signs and runs that overlap mostly
    share one; sign and digest together are 128 bits.
    """

    def __init__(self, texts: Texts):
        n = len(texts.hashes)
        self.at, self.signs = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.marks = np.zeros(0, np.int64)
        if n >= RUN:
            places = np.arange(n - GRAM + 1)
            self.grams = texts.sums.of(places, places + GRAM)
            least = sliding(self.grams, _SIGNS, np.minimum)
            left = np.repeat(texts.first + texts.n, texts.n) - np.arange(n)
            whole = left[: len(least)] >= RUN
            edge = np.zeros(_SIGNS - 1, np.uint64)
            most = sliding(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), _SIGNS, np.maximum)
            self.at = np.flatnonzero(whole)
            self.signs = least[self.at]
            self.marks = np.flatnonzero(most == self.grams)
        self.text = texts.text[self.at]
        self.texts = texts

    def digests(self, at: np.ndarray) -> np.ndarray:
        return self.texts.sums_again.of(at, at + RUN)

    def marked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, sign, whether it is the text's first)`` of the places whose hash is some run's sign."""
        text = self.texts.text[self.marks]
        signs = self.grams[self.marks] if len(self.marks) else np.zeros(0, np.uint64)
        return text, signs, _first(signs, text)

    def again(self) -> np.ndarray:
        """Whether each run stands earlier in its own text. Only texts that repeat a sign are looked at."""
        text, _, first = self.marked()
        out = np.zeros(len(self.at), bool)
        some = np.zeros(len(self.texts.n), bool)
        some[text[~first]] = True
        mine = np.flatnonzero(some[self.text])
        if len(mine):
            out[mine] = ~_first(self.digests(self.at[mine]), self.signs[mine], self.text[mine])
        return out


class Chunks:
    """The lines of some texts and the chunks that content defines.

    A hash rolls over the hashes of two lines; where it is smaller than at a neighbouring line, the two lines are the middle of a chunk,
    which the line before and the line after belong to as far as they are equal too. The choice
    depends on four lines, so it resists shifts, and of each three lines in a row two are a middle.
    """

    def __init__(self, texts: Texts):
        self.texts = texts
        ends = texts.line_ends()
        ends[(texts.first + texts.n - 1)[texts.n > 0]] = True
        self.after = np.flatnonzero(ends) + 1
        self.start = np.concatenate([[0], self.after[:-1]]) if len(self.after) else self.after
        self.text = texts.text[self.start]
        lines = texts.sums.of(self.start, self.after) if len(self.after) else np.zeros(0, np.uint64)
        n, none = len(lines), np.uint64(0)
        pair = np.append(self.text[1:] == self.text[:-1], False)[:n]
        rolled = mixed(lines * np.uint64(0x9E3779B185EBCA87) + np.roll(lines, -1))
        before, behind = np.append(False, pair[:-1])[:n], np.append(pair[1:], False)[:n]
        least = (before & (rolled <= np.roll(rolled, 1))) | (behind & (rolled <= np.roll(rolled, -1))) | (~before & ~behind)
        words = self.after - self.start
        #: The first of the two lines of each middle, the middle's hash, and hashes of the lines beside it.
        self.middle = np.flatnonzero(pair & least & (words + np.roll(words, -1) >= LEAST_WORDS))
        self.hashes = rolled[self.middle]
        self.has_before, self.has_after = before[self.middle], behind[self.middle]
        self.left = np.where(self.has_before, np.roll(lines, 1)[self.middle], none)
        self.right = np.where(self.has_after, np.roll(lines, -2)[self.middle], none)

    def line(self, i: int) -> bytes:
        """The line's words with one space between them."""
        return b" ".join(self.texts.data[self.texts.starts[self.start[i]] : self.texts.ends[self.after[i] - 1]].split())

    def lines(self, m: int) -> tuple[bytes, bytes, bytes]:
        """Bytes of the ``m``-th chunk: the line before (empty if there is none), the middle, and the line after."""
        i = int(self.middle[m])
        return self.line(i - 1) if self.has_before[m] else b"", self.line(i) + b"\n" + self.line(i + 1), self.line(i + 2) if self.has_after[m] else b""

    def again(self) -> np.ndarray:
        """Whether each line belongs to a chunk, or a part of one, that stands earlier in its own text."""
        out = np.zeros(len(self.start), bool)
        text = self.text[self.middle]
        first = _first(self.hashes, text)
        some = np.zeros(len(self.texts.n), bool)
        some[text[~first]] = True
        seen, of = set(), -1
        for m in np.flatnonzero(some[text]).tolist() if len(text) else []:
            if text[m] != of:
                seen, of = set(), text[m]
            for lines, kind, key in _parts(int(self.middle[m]), *self.lines(m)):
                if (kind, key) in seen:
                    out[lines] = True
                seen.add((kind, key))
        return out


def _parts(i: int, before: bytes, middle: bytes, after: bytes) -> Iterator[tuple[slice, int, bytes]]:
    """``(lines that go if the key is known, kind, key)`` of a chunk whose middle starts at line ``i``."""
    yield slice(i, i + 2), 0, middle
    if before:
        yield slice(i - 1, i + 2), 1, before + b"\n" + middle
    if after:
        yield slice(i, i + 3), 2, middle + b"\n" + after


def _signs(docs: DataFrame) -> DataFrame:
    """The different signs of each text's runs, as a column ``hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for _, texts in grouped(raw(batch, "text")):
                _, signs, first = Runs(texts).marked()
                out.append(signs[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["hash"])

    return docs.select("text").mapInArrow(lean(run), "hash long")


@dataclass
class Repeats:
    """Filters of the hashes that repeat and of those that repeat often, the number of groups that the latter are dealt to, and of all their places."""

    some: Bits
    many: Bits
    groups: int
    places: int


def _repeats(hashes: DataFrame) -> Repeats:
    (some, many), total = filters_of(hashes.groupBy("hash").count(), [(SOME_BITS, 1), (MANY_BITS, MANY)])
    return Repeats(some, many, 16 + total // EACH_GROUP, total)


def _segments(batch: pa.RecordBatch, repeats: Repeats) -> Iterator[pa.RecordBatch]:
    """Of each text's runs whose sign is in the filter, those that stand first in their text: neighbours of one sign as one row with their digests."""
    for first, texts in grouped(raw(batch, "text")):
        runs = Runs(texts)
        kept = np.flatnonzero(repeats.some.has(runs.signs) & ~runs.again())
        if not len(kept):
            continue
        at, sign, text = runs.at[kept], runs.signs[kept], runs.text[kept]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (sign[1:] != sign[:-1]) | (text[1:] != text[:-1]))
        starts = np.flatnonzero(new)
        bounds = pa.py_buffer((8 * np.append(starts, len(at))).astype(np.int32).tobytes())
        keys = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(runs.digests(at).tobytes())])
        yield _rows(batch, first + text[starts], (at - texts.first[text])[starts], sign[starts], keys, repeats)


def _middles(batch: pa.RecordBatch, repeats: Repeats) -> Iterator[pa.RecordBatch]:
    """Of each text's chunks whose middle is in the filter, one row for each that isn't as it was before in the text: lengths and bytes of its parts.
    Texts none of whose ``marks`` are in it aren't looked at."""
    marks, of = _marks(batch)
    batch = batch.filter(pa.array(np.bincount(of[repeats.some.has(marks)], minlength=batch.num_rows) > 0))
    for first, texts in grouped(raw(batch, "text")):
        chunks = Chunks(texts)
        text = chunks.text[chunks.middle]
        kept = np.flatnonzero(repeats.some.has(chunks.hashes) & _first(chunks.hashes, chunks.left, chunks.right, text))
        if not len(kept):
            continue
        no = np.searchsorted(chunks.text, np.arange(len(texts.n)))
        keys = [len(x).to_bytes(4, "little") + len(y).to_bytes(4, "little") + x + y + z for x, y, z in map(chunks.lines, kept.tolist())]
        yield _rows(batch, first + text[kept], chunks.middle[kept] - no[text[kept]], chunks.hashes[kept], pa.array(keys, pa.binary()), repeats)


def _marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of the column ``marks``, and the row of each."""
    lists = batch.column("marks")
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def _rows(batch: pa.RecordBatch, row: np.ndarray, k: np.ndarray, hashes: np.ndarray, keys: pa.Array, repeats: Repeats) -> pa.RecordBatch:
    at = pa.array(row)
    h = batch.column("h").take(at)
    group = (mixed(h.to_numpy().view(np.uint64)) % np.uint64(repeats.groups)).astype(np.int32)
    deal = np.where(repeats.many.has(hashes), group, np.int32(-1))
    columns = [batch.column("id").take(at), h, pa.array(k.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(deal), keys]
    return pa.RecordBatch.from_arrays(columns, ["id", "h", "k", "hash", "deal", "keys"])


def _compared(places: DataFrame, n: int, kind: str, later: Callable[[pa.Table, list], tuple]) -> DataFrame:
    """Runs ``later`` over all places (about ``n``) of a hash in the order of places; gives ``(id, h, a, b)`` of the words or lines that go.

    A hash that many texts have is dealt to groups; the first key of each group then is compared among groups by one minimum for each key, combined before the shuffle.
    """
    order = ["hash", "deal", F.col("id").isNull(), "id", "h", "k"]
    fields = f"id {kind}, h long, a int, b int, hash long, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, state = [], 0, [None, None, None]
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _ROWS or sum(x.nbytes for x in held) >= 1 << 24:
                yield from _later(pa.Table.from_batches(held), state, later, fields)
                held, n = [], 0
        if held:
            yield from _later(pa.Table.from_batches(held), state, later, fields)

    parts = max(2 * places.sparkSession.sparkContext.defaultParallelism, n // EACH_PARTITION)
    done = cut(places.repartition(parts, "hash", "deal").sortWithinPartitions(*order).mapInArrow(lean(run), fields))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "a")
    open_ = done.where("key IS NOT NULL")
    least = open_.groupBy("hash", "key").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1").drop("n")
    more = cut(open_.join(least, ["hash", "key"]).where(~place.eqNullSafe(F.col("least"))))
    return done.where("key IS NULL").select("id", "h", "a", "b").union(more.select("id", "h", "a", "b"))


def _later(rows: pa.Table, state: list, later: Callable, fields: str) -> Iterator[pa.RecordBatch]:
    """What goes of some rows in order, and the first keys of dealt groups. Rows of the same place count once; ``state`` is the
    last group, its keys so far, and the last place."""
    rows = rows.combine_chunks()
    last = [tuple(rows.column(name)[i].as_py() for name in ("hash", "h", "k", "id")) for i in (0, -1)]
    same = np.zeros(len(rows), bool)
    same[0], state[2] = last[0] == state[2], last[1]
    if len(rows) > 1:
        equal = np.ones(len(rows) - 1, bool)
        for name in ("hash", "h", "k", "id"):
            x = rows.column(name).combine_chunks()
            a, b = x[1:], x[:-1]
            equal &= pc.fill_null(pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))), False).to_numpy(zero_copy_only=False)
        same[1:] = equal
    rows = rows.filter(pa.array(~same)).combine_chunks()
    if not len(rows):
        return
    row, a, b, hashes, keys = later(rows, state)
    at = pa.array(row, pa.int64())
    columns = [rows.column("id").combine_chunks().take(at), rows.column("h").combine_chunks().take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())]
    if len(row):
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in fields.split(", ")])


def _later_runs(rows: pa.Table, state: list) -> tuple:
    """Runs whose digest an earlier place of the same sign has: ranges ``(row, a, b)`` of the runs' first words, and the others of dealt signs."""
    hashes, deal, k = (rows.column(c).to_numpy() for c in ("hash", "deal", "k"))
    keys = rows.column("keys").combine_chunks()
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    digests = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    n = np.diff(offsets) // 8
    group = np.cumsum(np.append(True, (hashes[1:] != hashes[:-1]) | (deal[1:] != deal[:-1])))
    row = np.repeat(np.arange(len(rows)), n)
    known = state[1] if state[0] == (hashes[0], deal[0]) else np.zeros(0, np.uint64)
    every, of = np.concatenate([known, digests]), np.concatenate([np.ones(len(known), np.int64), group[row]])
    first = _first(every, of)
    kept = every[(of == group[-1]) & first]
    state[:2] = (hashes[-1], deal[-1]), kept if deal[-1] < 0 or len(kept) < _KEPT else kept[:0]
    first = first[len(known) :]
    word = k[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    gone = np.flatnonzero(~first)
    starts = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (row[gone[1:]] != row[gone[:-1]]))[: len(gone)])
    stops = np.append(starts[1:], len(gone))[: len(starts)] - 1
    row_of, a, b = row[gone[starts]], word[gone[starts]], word[gone[stops]] + 1
    open_ = np.flatnonzero(first & (deal[row] >= 0))
    key = [None] * len(row_of) + [x.tobytes() for x in digests[open_]]
    return np.append(row_of, row[open_]), np.append(a, word[open_]), np.append(b, word[open_] + 1), np.append(np.zeros(len(row_of), np.int64), hashes[row[open_]]), key


def _later_chunks(rows: pa.Table, state: list) -> tuple:
    """Lines of chunks whose bytes an earlier place of the same middle has, and the keys of the others of dealt middles."""
    row, first, after, of_hash, open_keys = [], [], [], [], []
    columns = (rows.column(c).to_pylist() for c in ("hash", "deal", "k", "keys"))
    for r, (h, deal, k, keys) in enumerate(zip(*columns, strict=True)):
        if state[0] != (h, deal):
            state[:2] = (h, deal), set()
        a = 8 + int.from_bytes(keys[:4], "little")
        b = a + int.from_bytes(keys[4:8], "little")
        for lines, kind, key in _parts(k, keys[8:a], keys[a:b], keys[b:]):
            known = (kind, key) in state[1]
            if known or deal >= 0:
                row.append(r), first.append(lines.start), after.append(lines.stop), of_hash.append(h), open_keys.append(None if known else bytes([kind]) + key)
            state[1].add((kind, key))
        if deal >= 0 and len(state[1]) >= _KEPT:
            state[1].clear()
    return row, first, after, of_hash, open_keys


def _moved(base: DataFrame, drops: DataFrame, rebuild: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: str) -> tuple[DataFrame, Broadcast]:
    """``rebuild`` over all documents, and the broadcast that it needs; only those that a filter of a fixed size takes for documents with drops are shuffled, compressed, to meet them."""
    spark = base.sparkSession
    per_doc = drops.groupBy("id", "h").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))).alias("_drop"))
    bits = spark.sparkContext.broadcast(filter_of(drops.select(F.xxhash64("id", "h").alias("hash")), DOC_BITS))
    names = base.columns

    def part(moving: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = bits.value.has(batch.column("_d").to_numpy().view(np.uint64))
                some = batch.filter(pa.array(own == moving))
                if not some.num_rows:
                    continue
                if moving:
                    packed = [None if x is None else pa.compress(x, "zstd", asbytes=True) for x in some.column("text").cast(pa.binary()).to_pylist()]
                    sizes = [None if x is None else len(x) for x in some.column("text").cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names if c != "text"), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], [*(c for c in names if c != "text"), "packed", "size"])
                else:
                    yield from rebuild(iter([some]))

        return run

    keyed = base.withColumn("_d", F.xxhash64("id", "h"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    stay = keyed.mapInArrow(lean(part(False)), fields)
    go = keyed.mapInArrow(lean(part(True)), f"{kinds}, packed binary, size long")
    met = go.join(per_doc.withColumnsRenamed({"id": "_id", "h": "_h"}), go["id"].eqNullSafe(F.col("_id")) & go["h"].eqNullSafe(F.col("_h")), "left").drop("_id", "_h")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else pa.decompress(x, size, "zstd", asbytes=True) for x, size in zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield from rebuild(iter([pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c != "text"), pa.array(texts, pa.binary()), batch.column("_drop")], [*(c for c in names if c != "text"), "text", "_drop"])]))

    return stay.unionByName(met.mapInArrow(lean(unpacked), fields)), bits


def _drops_of(batch: pa.RecordBatch, at: int) -> np.ndarray | None:
    """The ranges ``(a, b)`` listed for the row."""
    if "_drop" not in batch.schema.names:
        return None
    x = batch.column("_drop")[at].values
    if x is None or not len(x):
        return None
    codes = x.to_numpy()
    return np.stack([codes >> 32, codes & 0xFFFFFFFF], 1)


def _covered(n: int, ranges: np.ndarray, more: int = 0) -> np.ndarray:
    """Which of ``n`` places the ranges cover, each ``more`` places longer."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, ranges[:, 0], 1)
    np.add.at(steps, np.minimum(ranges[:, 1] + more, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _without(texts: Texts, i: int, gone: np.ndarray) -> bytes:
    """The ``i``-th text without the words that go. A range at a line's end goes without the line's break."""
    first, (a, b) = texts.first[i], texts.offsets[i : i + 2]
    text, n = texts.data[a : b - 1], len(gone)
    edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    out, at = [], 0
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        start, stop = int(texts.starts[first + lo] - a), int(texts.ends[first + hi - 1] - a)
        end = int(texts.starts[first + hi] - a) if hi < n else len(text)
        before = text[int(texts.ends[first + lo - 1] - a) : start] if lo else b""
        out.append(text[at:start])
        at = stop if lo and b"\n" not in before and b"\n" in text[stop:end] else end
    out.append(text[at:])
    left = b"".join(out)
    return left if text.endswith(b"\n") else left.rstrip()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every later occurrence of a run of 50 words and of a multi-line chunk removed, wherever in the corpus it repeats.

    First go runs of 50 words. They start at any word, so a repeated passage of 50 words or more goes whole, to the word, however its lines are cut; white
    space between words doesn't count. Then, in what is left, go chunks of lines. A line ends at a line break or after a sentence's last mark, blank lines
    don't count, and a chunk's middle is two lines of ten words at least which a rolling hash over line hashes chooses (see ``Chunks``); the lines beside it go if they repeat with it. So
    of a repeated passage of three lines or more, any two neighbours of which have ten words, every line goes. A text that goes on repeating itself keeps the first turn.

    All columns come back, ``text_col`` without what was removed, with ``n_lines`` (of the input, blank ones too) and ``n_removed`` (lines that
    went wholly or in part; an input column of one of these names is replaced). The first occurrence, by id (nulls last), text hash and place, stays. Runs are equal if
    128 bits of hash are; a chunk equal in hash but not in bytes is another chunk. Rows that repeat both id and text are one document and get the same
    result; a null text stays null with no lines; an empty text has one line; an empty table gives no rows.

    Hashes alone find what may repeat: for runs the smallest hash of 25 words in each, for chunks the hash of the middle. Filters of a fixed
    number of bits, which only let too much through as they fill, limit what is then grouped by hash and compared in the order of places. A hash that many texts share is dealt to
    groups, whose first keys meet by a combined minimum, so no task holds all of its places. Only documents that lose something are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [i for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    names = [docs.columns[i] for i in others]
    text_at, id_at = names.index(text_col), names.index(id_col)
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(F.col(f"c{i}").alias(f"c{j}") for j, i in enumerate(others)))
    kept = [f"c{j}" for j in range(len(others)) if j != text_at]
    base = placed.select(*kept, F.col(f"c{id_at}").alias("id"), F.xxhash64(f"c{text_at}").alias("h"), F.col(f"c{text_at}").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    place = f"id {kind}, h long, k int, hash long, deal int, keys binary"

    def found(some: DataFrame, hashes: DataFrame, rows: Callable, later: Callable) -> DataFrame:
        """``(id, h, a, b)`` of what goes."""
        known = _repeats(hashes)
        repeats = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from rows(batch, repeats.value)

        gone = _compared(some.mapInArrow(lean(run), place), known.places, kind, later)
        repeats.destroy()
        return gone

    def without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, n_lines, n_gone, null, marks, n_marks = raw(batch, "text"), [], [], batch.column("text").is_null().to_pylist(), [], []
            out = list(before)
            for first, texts in grouped(before):
                runs, same = Runs(texts), True
                again = runs.at[runs.again()]
                counts, ends, of = texts.line_counts(), None, np.searchsorted(again, np.append(texts.first, len(texts.hashes)))
                for i in range(len(texts.n)):
                    own, more = again[of[i] : of[i + 1]], _drops_of(batch, first + i)
                    n_lines.append(0 if null[first + i] else int(counts[i]))
                    n_gone.append(0)
                    if len(own) or more is not None:
                        starts = own - texts.first[i]
                        ranges = np.stack([starts, starts + 1], 1)
                        gone = _covered(int(texts.n[i]), ranges if more is None else np.concatenate([ranges, more]), RUN - 1)
                        ends = texts.line_ends() if ends is None else ends
                        lines = np.cumsum(np.append(0, ends[texts.first[i] : texts.first[i] + texts.n[i]][:-1]))
                        n_gone[-1] = len(np.unique(lines[gone]))
                        out[first + i], same = _without(texts, i, gone), False
                chunks = Chunks(texts if same else Texts(out[first : first + len(texts.n)]))
                marks.append(chunks.hashes)
                n_marks.append(np.bincount(chunks.text[chunks.middle], minlength=len(texts.n)))
            offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *n_marks])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *marks]).view(np.int64)))
            yield _result(batch, {i: x for i, x in enumerate(out) if x is not before[i]}, [*kept, "id", "h"], n_lines=pa.array(n_lines, pa.int32()), n_removed=pa.array(n_gone, pa.int32()), marks=lists)

    def without_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, of = _marks(batch)
            again = np.bincount(of[~_first(marks, of)], minlength=batch.num_rows) > 0
            asked = [i for i in range(batch.num_rows) if again[i] or _drops_of(batch, i) is not None]
            out, n_gone = {}, batch.column("n_removed").to_pylist()
            for first, texts in grouped(batch.column("text").take(pa.array(asked, pa.int64())).cast(pa.binary()).to_pylist()):
                chunks = Chunks(texts)
                lost, of = chunks.again(), np.searchsorted(chunks.text, np.arange(len(texts.n) + 1))
                for k, i in enumerate(asked[first : first + len(texts.n)]):
                    mine = slice(of[k], of[k + 1])
                    gone, more = lost[mine], _drops_of(batch, i)
                    if more is not None:
                        gone = gone | _covered(len(gone), more)
                    if gone.any():
                        n_gone[i] += int(gone.sum())
                        out[i] = _without(texts, k, np.repeat(gone, chunks.after[mine] - chunks.start[mine]))
            yield _result(batch, out, kept, n_lines=batch.column("n_lines"), n_removed=pa.array(n_gone, pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    own = [f"{c} {kinds[c]}" for c in kept]
    counted = "text string, n_lines int, n_removed int"
    some = base.where(F.col("text").isNotNull()).select("id", "h", "text")
    moved, bits = _moved(base, found(some, _signs(some), _segments, _later_runs), without_runs, ", ".join([*own, f"id {kind}", "h long", counted, "marks array<long>"]))
    once = cut(moved)
    bits.destroy()
    marked = once.where(F.size("marks") > 0).select("id", "h", "text", "marks")
    twice, _ = _moved(once, found(marked, marked.select(F.explode(F.array_distinct("marks")).alias("hash")), _middles, _later_chunks), without_chunks, ", ".join([*own, counted]))
    return twice.select(*(F.col("text" if j == text_at else f"c{j}").alias(c) for j, c in enumerate(names)), "n_lines", "n_removed")


def _result(batch: pa.RecordBatch, changed: dict[int, bytes], columns: list[str], **made: pa.Array) -> pa.RecordBatch:
    """The batch with some texts changed, its ``columns``, and what was ``made``."""
    text = batch.column("text")
    if changed:
        text = pa.array([changed.get(i, x) for i, x in enumerate(text.cast(pa.binary()).to_pylist())], pa.binary())
    text = text.cast(pa.string())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), text, *made.values()], [*columns, "text", *made])
