"""A hashed maximum-entropy language model with a class-factored softmax."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.common import lean, raw, small_batches
from arcloom.llm.spans import Places, Texts, grouped, mixed
from arcloom.scratch import cut

#: The hash that stands for the end token; words have larger ones.
END = 1
#: Bytes of texts in a block.
BLOCK_BYTES = 16 << 20
#: Tokens whose logits are held at a time.
STEP = 1024


@dataclass(frozen=True)
class Settings:
    """Words fall into classes and these into ``members`` cells. The most frequent words have cells by themselves, dealt in turn to
    ``top`` classes; others share the cells of ``spelled`` classes, chosen by their first three bytes, by their hash.
    Each round takes gradients from all tokens of its share of the documents; together they take each document once."""

    top: int = 16
    spelled: int = 16
    members: int = 32
    buckets: int = 16384
    rounds: int = 2
    batch: int = 8192
    rate: float = 0.8

    @property
    def classes(self) -> int:
        return self.top + self.spelled

    @property
    def cells(self) -> int:
        return self.classes * self.members

    @property
    def class_rows(self) -> int:
        """Feature rows of the class: cells of the last word and of the one before (a skip), the class of the third last, hashed pairs of cells."""
        return 2 * self.cells + self.classes + self.buckets

    @property
    def member_rows(self) -> int:
        """Feature rows of the member: the class itself, and hashed with the cells of the last word and of the one before."""
        return self.classes + 2 * self.buckets


@dataclass
class Tokens:
    """The tokens of some texts in turn, an end token after each text: hashes, hashes of the first three bytes, place in the text; ``n`` of each text."""

    hashes: np.ndarray
    spelling: np.ndarray
    place: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> "Tokens":
        stops = texts.first + texts.n
        hashes = np.insert(np.maximum(texts.hashes, np.uint64(END + 1)), stops, np.uint64(END))
        spelling, size = np.zeros(len(texts.starts), np.uint64), texts.ends - texts.starts
        for k in range(3):
            at = np.minimum(texts.starts + k, len(texts.bytes) - 1)
            spelling = spelling << np.uint64(8) | np.where(size > k, texts.bytes[at], 0).astype(np.uint64)
        n = texts.n + 1
        return cls(hashes, np.insert(mixed(spelling * np.uint64(0x9E3779B185EBCA87)), stops, np.uint64(0)), np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n), n)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Documents gathered into compressed blocks of a bounded size, ``(block, payload)``; a block's id is unique."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for x in part:
                    writer.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

        part, held_bytes = [], 0
        for batch in batches:
            part.append(batch)
            held_bytes += batch.nbytes
            if held_bytes >= BLOCK_BYTES:
                yield flush()
                part, held_bytes = [], 0
        if part:
            yield flush()

    return narrow.mapInArrow(lean(run), "block long, payload binary")


@contextlib.contextmanager
def one_by_one(spark: SparkSession) -> Iterator[None]:
    """Within it, what is planned gives Python workers one row, a whole block, in a batch: neither side holds more of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        yield
    finally:
        small_batches(spark)


def opened(payload: pa.Scalar) -> Iterator[pa.RecordBatch]:
    """A block's rows ``id, text, held``, read from the payload without a copy of it."""
    yield from pa.ipc.open_stream(payload.as_buffer())


def _texts(batch: pa.RecordBatch, which: np.ndarray | None = None) -> Iterator[tuple[int, Tokens]]:
    """``(number of the first text, tokens)`` of the batch's texts, or of those chosen."""
    texts = raw(batch, "text")
    for first, part in grouped([x.lower() for x in (texts if which is None else [texts[i] for i in np.flatnonzero(which)])]):
        yield first, Tokens.of(part)


def vocabulary(blocks: DataFrame, s: Settings) -> DataFrame:
    """``(block, hash, k, n)``: for each different token of a block the cell that it has if it isn't frequent, and its count in the block's
    training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                parts = []
                for rows in opened(payload):
                    held = rows.column("held").to_numpy(zero_copy_only=False)
                    for first, t in _texts(rows):
                        learned = np.repeat(~held[first : first + len(t.n)], t.n).astype(np.int64)
                        parts.append(_summed(t.hashes, _shared_cell(t.hashes, t.spelling, s), learned))
                h, k, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
                for i in range(0, len(h), 50_000):
                    of = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[of]), block)), pa.array(h[of].view(np.int64)), pa.array(k[of]), pa.array(n[of])], ["block", "hash", "k", "n"])

    return blocks.mapInArrow(lean(run), "block long, hash long, k int, n long")


def _summed(h: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, the cell of each, and sums of ``n``."""
    order = np.argsort(h)
    ordered = h[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(h)])
    return ordered[first], k[order[first]], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _shared_cell(h: np.ndarray, spelling: np.ndarray, s: Settings) -> np.ndarray:
    """The cell of words that have none by themselves."""
    k = (s.top + (spelling % np.uint64(s.spelled)).astype(np.int32)) * s.members + (h >> np.uint64(40)).astype(np.int32) % s.members
    return np.where(h == END, 0, k).astype(np.int32)


@dataclass
class Model:
    """Hashes of the frequent words in the order of their ranks, weights of the two factors, and counts within cells."""

    settings: Settings
    frequent: np.ndarray
    classes: np.ndarray | None = None
    members: np.ndarray | None = None
    mass: np.ndarray | None = None
    discount: np.ndarray | None = None
    unknown: np.ndarray | None = None
    tokens: int = 0
    types: int = 0

    def __post_init__(self) -> None:
        s, n = self.settings, len(self.frequent)
        self.places = Places(max(1 << 12, 4 * s.cells))
        self.places.insert(self.frequent, np.arange(1, n + 1, dtype=np.int32))
        rank = np.arange(n)
        self.own = np.concatenate([[0], rank % s.top * s.members + rank // s.top])
        if self.classes is None:
            self.classes, self.members = np.zeros((s.class_rows, s.classes), np.float32), np.zeros((s.member_rows, s.members), np.float32)

    def cells(self, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The cell of each token, given the one it has if it isn't frequent."""
        at = self.places.find(h)
        return np.where(at > 0, self.own[at], shared)

    def features(self, cells: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each token the rows of its class's features and of its member's, from the tokens before it; before a document stands the end token."""
        s = self.settings
        start = self.own[1]
        one, two, three = (np.where(place < d, start, np.concatenate([np.full(min(d, len(cells)), start), cells[:-d]])) for d in (1, 2, 3))
        own = cells // s.members
        pair = lambda a, b: (a * s.cells + b) * 2654435761 % 4294967296 // 64 % s.buckets
        return (
            [one, s.cells + two, 2 * s.cells + three // s.members, 2 * s.cells + s.classes + pair(one, two)],
            [own, s.classes + pair(own, one), s.classes + s.buckets + pair(own, two)],
        )

    def log_cells(self, cells: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 of each token's cell's probability: of its class by one softmax, of its member within the class by the other."""
        s = self.settings
        of_class, of_member = self.features(cells, place)
        return _log_softmax(self.classes, of_class, cells // s.members) + _log_softmax(self.members, of_member, cells % s.members)


def _logits(table: np.ndarray, rows: list[np.ndarray], z: np.ndarray, part: np.ndarray) -> None:
    """The sums of the rows, into ``z``; of very large ones each row's largest is taken off, so that no exponential overflows."""
    np.take(table, rows[0], axis=0, out=z, mode="clip")
    for r in rows[1:]:
        np.take(table, r, axis=0, out=part, mode="clip")
        z += part
    if z.max() > 60 or z.min() < -60:
        z -= z.max(1, keepdims=True)


def _log_softmax(table: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log10 of each label's probability; tokens are taken a few at a time, into the same two arrays."""
    out = np.empty(len(labels))
    z, part = np.empty((2, STEP, table.shape[1]), np.float32)
    every, ones = np.arange(STEP), np.ones(table.shape[1], np.float32)
    for i in range(0, len(labels), STEP):
        m = min(STEP, len(labels) - i)
        a = z[:m]
        _logits(table, [r[i : i + m] for r in rows], a, part[:m])
        picked = a[every[:m], labels[i : i + m]].astype(np.float64)
        np.exp(a, out=a)
        out[i : i + m] = picked - np.log(a @ ones, dtype=np.float64)
    return out / np.log(10)


def _step(table: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, rate: float) -> None:
    """A gradient step of the log loss on some tokens. Rows seen more often move less, and a row that many of these
    tokens share moves by the root of their number, so that no step overshoots."""
    n = len(labels)
    z, part = np.empty((2, n, table.shape[1]), np.float32)
    _logits(table, rows, z, part)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(table.shape[1], np.float32)))[:, None]
    z[np.arange(n), labels] -= 1
    for r in rows:
        order = np.argsort(r.astype(np.uint16) if len(table) <= 1 << 16 else r, kind="stable")
        ordered = r[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        own, times = ordered[first], np.diff(first, append=n)
        seen[own] += times
        np.take(z, order, axis=0, out=part, mode="clip")
        table[own] -= (rate / np.sqrt(seen[own] * times))[:, None] * np.add.reduceat(part, first, axis=0)


def train_round(blocks: DataFrame, model: Model, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: every task takes gradient steps over its documents of this turn, from the shared weights; the
    weights' changes are averaged by the number of tokens."""
    s = model.settings
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        now = [m.classes.copy(), m.members.copy()]
        seen, taken = [np.ones(len(x), np.float32) for x in now], 0
        for batch in batches:
            for payload in batch.column("payload"):
                for rows in opened(payload):
                    mine = ~rows.column("held").to_numpy(zero_copy_only=False) & (np.arange(rows.num_rows) % s.rounds == turn)
                    for _, t in _texts(rows, mine):
                        cells = m.cells(t.hashes, _shared_cell(t.hashes, t.spelling, s))
                        of_class, of_member = m.features(cells, t.place)
                        for i in range(0, len(cells), s.batch):
                            of = slice(i, i + s.batch)
                            _step(now[0], [r[of] for r in of_class], cells[of] // s.members, seen[0], s.rate)
                            _step(now[1], [r[of] for r in of_member], cells[of] % s.members, seen[1], s.rate)
                        taken += len(cells)
        if taken:
            changes = np.concatenate([(now[0] - m.classes).ravel(), (now[1] - m.members).ravel()])
            changes *= np.float32(taken)
            yield pa.RecordBatch.from_arrays([pa.array([taken], pa.int64()), pa.array([changes.tobytes()], pa.binary())], ["n", "change"])

    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    with one_by_one(blocks.sparkSession):
        total = averaged(blocks.coalesce(tasks).mapInArrow(lean(run), "n long, change binary"), tasks, model.classes.size + model.members.size)
    return total[: model.classes.size].reshape(model.classes.shape), total[model.classes.size :].reshape(model.members.shape)


def averaged(changes: DataFrame, tasks: int, size: int) -> np.ndarray:
    """The sum of ``change``, arrays of ``size`` numbers, over the sum of ``n``: eight at a time on the executors, the last few on the driver.
    All of it goes through the Python workers that the gradients have; an RDD's functions would start others beside them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.float32)
        for batch in batches:
            for k, x in zip(batch.column("n").to_pylist(), batch.column("change"), strict=True):
                n += k
                total += np.frombuffer(x.as_buffer(), np.float32)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "change"])

    while tasks > 8:
        tasks = -(-tasks // 8)
        changes = changes.repartition(tasks).mapInArrow(lean(add), "n long, change binary")
    n, total = 0, np.zeros(size, np.float32)
    for r in changes.collect():
        n += r["n"]
        total += np.frombuffer(r["change"], np.float32)
    return total / np.float32(max(1, n))


def statistics(words: DataFrame, s: Settings) -> Model:
    """The model's frequent words, and absolute discounting within each shared cell from the counts of all its words; ``words``
    has ``hash, k, c`` of every training token. Both factors start at the cells' counts."""
    top = [r[0] for r in words.where(F.col("hash") != END).orderBy(F.desc("c"), "hash").select("hash").limit(s.top * s.members - 1).collect()]
    model = Model(s, np.array([END, *top], np.int64).view(np.uint64))
    is_top = F.col("hash").isin([END, *top])
    rows = words.groupBy(F.when(is_top, F.col("hash")).alias("h"), F.when(~is_top, F.col("k")).alias("k")).agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).collect()
    mass, types, ones, twos = np.zeros((4, s.cells))
    for h, k, *x in rows:
        at = k if h is None else int(model.cells(np.array([h], np.int64).view(np.uint64), np.zeros(1, np.int32))[0])
        mass[at], types[at], ones[at], twos[at] = x
    alone = np.arange(s.cells) < s.top * s.members
    model.discount = np.where(alone, 0, np.clip(np.divide(ones, ones + 2 * twos, out=np.full(s.cells, 0.5), where=ones + twos > 0), 0.1, 0.9))
    model.mass = mass
    model.unknown = np.divide(model.discount * types, mass, out=np.where(alone, 0.0, 1.0), where=(mass > 0) & ~alone)
    model.tokens, model.types = int(mass.sum()), int(types.sum())
    by_class = mass.reshape(s.classes, s.members)
    model.classes[: s.cells] = np.log(by_class.sum(1) + 1) - np.log(mass.sum() + s.classes)
    model.members[: s.classes] = np.log(by_class + 1) - np.log(by_class.sum(1, keepdims=True) + s.members)
    return model


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Score every whole text by a model learned from the texts that aren't held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for each input row. ``score`` is log10 of the
    text's probability: P(class | words before) times P(member | class, words before), each by a trained softmax over hashed features, and for
    words that share a cell times P(word | cell) by absolute discounting over all training counts. A word that training hasn't seen is the unknown word of its cell,
    so the probabilities of all known words and all unknown ones sum to 1. Null and empty texts are the end token
    alone; a null ``held`` is false; repeated rows count and are scored each; an empty table gives no rows; without training rows
    every word is unknown.

    Documents are gathered into blocks of a bounded size; a block gets the counts of its own words, so no task holds the
    vocabulary, and a frequent word costs one row for each block, in a join that may divide it among tasks. Words are told apart by 64 bits of hash.
    """
    small_batches(docs.sparkSession)
    blocks = cut(blocks_of(docs, id_col, text_col, held))
    with one_by_one(docs.sparkSession):
        pairs = cut(vocabulary(blocks, settings))
    words = cut(pairs.where("n > 0").groupBy("hash").agg(F.min("k").alias("k"), F.sum("n").alias("c")))
    model = statistics(words, settings)
    if model.tokens:
        for turn in range(settings.rounds):
            changes = train_round(blocks, model, turn)
            model.classes, model.members = model.classes + changes[0], model.members + changes[1]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counted = pairs.select("block", "hash", "k").join(words.select("hash", "c"), "hash", "left").select("block", "hash", "k", F.coalesce("c", F.lit(0)).alias("c"))

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        m = shared.value
        h, c = counts.column("hash").to_numpy().view(np.uint64), counts.column("c").to_numpy().astype(np.float64)
        cell = m.cells(h, counts.column("k").to_numpy())
        alone = cell < settings.top * settings.members
        with np.errstate(divide="ignore", invalid="ignore"):
            within = np.where(alone, 0.0, np.log10(np.where(c > 0, (c - m.discount[cell]) / m.mass[cell], m.unknown[cell])))
        base, known = np.log10((c + 1) / (m.tokens + m.types + 1)), (c > 0).astype(np.float64)
        index = Places(1 << max(10, int(4 * len(h)).bit_length()))
        index.insert(h, np.arange(1, len(h) + 1, dtype=np.int32))
        ids, out, held_out = [], [], []
        for rows in opened(block.column("payload")[0]):
            ids.append(rows.column("id"))
            held_out.append(rows.column("held"))
            for _, t in _texts(rows):
                at = index.find(t.hashes) - 1
                total = within[at] + m.log_cells(cell[at], t.place)
                firsts = np.cumsum(t.n) - t.n
                out.append([t.n, np.add.reduceat(known[at], firsts), np.add.reduceat(base[at], firsts), np.add.reduceat(total, firsts)])
        n, n_known, base_score, full = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = [pa.chunked_array(ids), pa.chunked_array(held_out), pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base_score), pa.array(full)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, kinds)
