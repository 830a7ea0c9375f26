"""Packing documents into token sequences by best-fit decreasing."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcloom.llm.common import kept, lean, raw, small_batches
from arcloom.llm.spans import Places, Texts, grouped
from arcloom.scratch import cut

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps, and the longest such word in bytes.
CACHED_WORDS, CACHED_BYTES = 1 << 19, 64
#: Words of letters that are encoded together.
TOGETHER = 256
#: Pieces of one length that are numbered in one task.
PIECES_PER_BUCKET = 50_000
#: Marks after a letter or digit that the tokenizer takes for a word by itself.
MARKS = b".,"


class WordIds:
    """Token ids of texts.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in turn. The ids of
    words are kept in flat arrays behind a hash table that is asked for all words of some texts at once; when it is
    full, the words that weren't used since the last time go. A text that may hold a special token's string is encoded whole.
    """

    def __init__(self, path: str | None, words: int = CACHED_WORDS):
        self.words = words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        """Entry 0 is the id that ends a document."""
        self.places = Places(2 * self.words)
        self.hashes, self.used = np.zeros(self.words + 1, np.uint64), np.zeros(self.words + 1, bool)
        self.stops, self.ids, self.n = np.ones(self.words + 1, np.int64), np.zeros(1 << 16, np.uint32), 1

    def _keep_used(self) -> None:
        """Make room: words that were met no second time since the last time go, or all, if that isn't half of them."""
        kept = np.flatnonzero(self.used[1 : self.n]) + 1
        if len(kept) > self.words // 2:
            kept = kept[:0]
        hashes, stops, ids = self.hashes[kept], self.stops, self.ids
        first, n = stops[kept - 1], stops[kept] - stops[kept - 1]
        self._clear()
        self._add(hashes, _spans(ids, first, n), n)

    def _add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        first, of = self.stops[self.n - 1], slice(self.n, self.n + len(hashes))
        self.hashes[of], self.stops[of] = hashes, first + np.cumsum(n)
        while len(self.ids) < first + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first : first + len(ids)] = ids
        self.places.insert(hashes, np.arange(of.start, of.stop, dtype=np.int32))
        self.n = of.stop

    # encoding

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn and how many each has. Words of letters are encoded many at a time and divided after
        the tokens that end a word; if the count doesn't come out, and for all other words, one by one."""
        readable = [w.decode("utf-8", "replace") for w in words]
        letters = [i for i, w in enumerate(readable) if w.isalpha()]
        single = [i for i, w in enumerate(readable) if not w.isalpha()]
        groups = [letters[k : k + TOGETHER] for k in range(0, len(letters), TOGETHER)]
        order, parts, counts = [], [], []
        for group, line in zip(groups, self.tokenizer.encode_batch_fast([" ".join([readable[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(line.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):
                single += group
                continue
            order += group
            parts.append(ids)
            counts.append(np.diff(stops, prepend=0))
        for x in self.tokenizer.encode_batch_fast([readable[i] for i in single], add_special_tokens=False):
            parts.append(np.array(x.ids, np.uint32))
            counts.append([len(x.ids)])
        ids, n = np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([np.zeros(0, np.int64), *counts])
        back = np.argsort([*order, *single]).astype(np.int64)
        return _spans(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, 0], np.uint32)

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, id 0 after each, and where each text's end."""
        h = np.maximum(texts.hashes, np.uint64(1))
        entry = self.places.find(h)
        new = np.flatnonzero(entry == 0)
        own, first, back = np.unique(h[new], return_index=True, return_inverse=True)
        if self.n + len(own) > self.words:
            self._keep_used()
            entry = self.places.find(h)
            new = np.flatnonzero(entry == 0)
            own, first, back = np.unique(h[new], return_index=True, return_inverse=True)
        self.used[entry] = True
        a, b = texts.starts[new[first]], texts.ends[new[first]]
        long = b - a > CACHED_BYTES
        kept = np.flatnonzero(~long)[: self.words - self.n]
        once = np.setdiff1d(np.arange(len(own)), kept)
        order = np.concatenate([kept, once])
        ids, n = self._encode([texts.data[i:j] for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True)])
        place = np.empty(len(own), np.int32)
        place[order] = self.n + np.arange(len(own), dtype=np.int32)
        entry[new] = place[back]
        of_kept = int(n[: len(kept)].sum())
        self._add(own[kept], ids[:of_kept], n[: len(kept)])
        every, stops = self.ids, self.stops
        if len(once):  # these have entries for the time of this call only
            every = np.concatenate([self.ids[: self.stops[self.n - 1]], ids[of_kept:]])
            stops = np.concatenate([self.stops[: self.n], self.stops[self.n - 1] + np.cumsum(n[len(kept) :])])
        bounds = texts.first + texts.n
        entry = np.insert(entry, bounds, 0)
        first = np.where(entry, stops[entry - 1], 0)
        n = stops[entry] - first
        return _spans(every, first, n), np.cumsum(n)[bounds + np.arange(len(bounds))]


def _spans(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The spans of ``x`` that start at ``first`` and have ``n`` values, one after the other."""
    return x[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int, with_ids: bool, words_kept: int = CACHED_WORDS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, n`` (and ``ids``, if asked for) of every piece of every document; ``n`` counts a task's pieces."""
    small_batches(docs.sparkSession)
    fields = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, n long" + ", ids binary" * with_ids
    names, keeps = [f.split()[0] for f in fields.split(", ")], f"{words_kept} words of {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made = kept(keeps, lambda: WordIds(tokenizer, words_kept)), 0
        for batch in batches:
            texts = raw(batch, "text")
            special = {i: words.whole(x) for i, x in enumerate(texts) if b"<|" in x}
            row, piece, start, length, crc, cut_ids = [], [], [], [], [], []
            for first, group in grouped([b"" if i in special else x.lower() for i, x in enumerate(texts)], MARKS):
                ids, stops = words.of(group)
                at = 0
                for k, stop in enumerate(stops.tolist(), first):
                    own, at = special.get(k, ids[at:stop]), stop
                    for i, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        row.append(k), piece.append(i), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.astype("<u4", copy=False)))
                        if with_ids:
                            cut_ids.append(part.astype("<u4", copy=False).tobytes())
            of_row = batch.column("doc_id").take(pa.array(row, pa.int64()))
            columns = [of_row, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(made, made + len(row)))]
            made += len(row)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(cut_ids, pa.binary())] * with_ids, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run, keeps), fields)


class Capacities:
    """A segment tree over remaining capacities: how many open bins have each, and the least that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open bin has."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` items of each length.

    Returns runs ``(length, first rank, items to a bin, first bin, offset)``: the items of that length from that
    rank on fill consecutive bins, so many to a bin, from that offset on; the next run of the length ends it. Items
    of one length can't be told apart, so bins with the same history are handled together, and the work depends on
    the number of lengths (at most ``capacity``), not on the number of items. Each item goes into the tightest bin
    that holds it: after one item the same bin is tighter still, so it takes as many as fit.
    """
    tree, bins, runs, fresh = Capacities(capacity), {}, [], 0

    def push(left: int, first: int, n: int) -> None:
        if n and left:
            bins.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, fresh, -(-todo // (capacity // length))
                fresh += n
            else:
                first, n = bins[left].pop()
                tree.add(left, -n)
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, each, first, capacity - left))
                push(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < n and 0 < todo < each:
                runs.append((length, rank, todo, first + full, capacity - left))
                push(left - todo * length, first + full, 1)
                todo, full = 0, full + 1
            push(left, first + full, n - full)
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, words_kept: int = CACHED_WORDS) -> DataFrame:
    """Pack every document's token ids, and id 0 after them, into as few sequences as best-fit decreasing finds.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``, if asked for) for each
    piece; only documents of over ``capacity`` ids are cut. A null or empty text is the end id alone; repeated rows
    are packed each by itself; null ids stay null; an empty table gives no rows; other columns are ignored. Ties go to any order.
    Of ``words_kept`` words each worker keeps the ids, which only saves time.

    Only the count of each length, at most ``capacity`` numbers, comes to the driver. Pieces of one length get their
    ranks in salted buckets, so a length that a third of the pieces have is spread out, even if these repeat one row; the runs of the plan, whose
    number the capacity bounds, then turn a rank into a bin and an offset.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, id_col, text_col, tokenizer, capacity, with_ids, words_kept))
    counts = {int(r[0]): int(r[1]) for r in made.groupBy("length").count().collect()}
    buckets = max(64, sum(counts.values()) // PIECES_PER_BUCKET)
    runs = sorted(best_fit_decreasing(counts, capacity))
    arrays = [np.array(x, np.int64) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 5
    plan, columns = spark.sparkContext.broadcast(arrays), [c for c in made.columns if c != "n"]

    bucketed = made.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(buckets)))
    before = bucketed.groupBy("length", "_b").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "_b", "_before")
    ranked = bucketed.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "n"))).join(before, ["length", "_b"])
    ranked = ranked.select(*columns, (F.col("_before") + F.col("_n") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, each, first, offset = plan.value
        key = (lengths << 44) + ranks
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (n << 44) + r, "right") - 1
            i = r - ranks[at]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + i // each[at]), pa.array(offset[at] + i % each[at] * n)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name != "n")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
