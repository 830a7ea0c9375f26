"""A byte-level convolutional network for text quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.calibrate import logit, platt, sigmoid, threshold
from arcloom.llm.common import lean, raw, small_batches
from arcloom.llm.labelled import sample

DECIDES = 0.7
#: Bytes of a chunk, from one to the next, and convolved at a time.
CHUNK, STRIDE, PART = 512, 448, 64
AT_A_TIME = 448 * 256


@dataclass(frozen=True)
class Settings:
    """``each`` bounds the sample: so many labelled documents of either class."""

    width: int = 6
    filters: int = 10
    each: int = 700
    epochs: int = 4
    rate: float = 0.05
    calibration: float = 0.25


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text if len(text) >= CHUNK else text + b"\0" * (CHUNK - len(text)), np.uint8)


class Network:
    """Filters over bytes, the maximum of each in every chunk, and mean and maximum of those over the chunks."""

    def __init__(self, s: Settings, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.s = s
        self.filters = rng.normal(0, 0.15, (s.width, 256, s.filters)).astype(np.float32)
        self.offset = np.zeros(s.filters, np.float32)
        self.out = rng.normal(0, 0.3, 2 * s.filters).astype(np.float32)
        self.bias = 0.0

    def pairs(self) -> np.ndarray:
        """What two neighbouring bytes add at each even place of a filter."""
        f = self.filters
        return np.stack([(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, self.s.width, 2)])

    def responses(self, b: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        n = len(b) - self.s.width + 1
        if pairs is None:
            z = self.filters[0][b[:n]]
            for j in range(1, self.s.width):
                z += self.filters[j][b[j : j + n]]
            return z
        two = b[:-1].astype(np.int32) << 8 | b[1:]
        z = pairs[0][two[:n]]
        for j in range(1, len(pairs)):
            z += pairs[j][two[2 * j : 2 * j + n]]
        return z

    def chunk_maxima(self, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The filters' maxima in all chunks of a text of any length; the last chunk ends where the text does."""
        out = []
        for i in range(0, max(1, len(b) - (CHUNK - STRIDE)), AT_A_TIME):
            z = self.responses(b[i : i + AT_A_TIME + CHUNK - STRIDE], pairs)
            parts = np.maximum.reduceat(z, np.arange(0, len(z), PART), axis=0)
            last = max(1, -(-(len(parts) - CHUNK // PART) // (STRIDE // PART)) + 1)
            out += [parts[k * (STRIDE // PART) : k * (STRIDE // PART) + CHUNK // PART].max(0) for k in range(last)]
        return np.stack(out) + self.offset

    def logit(self, b: np.ndarray, pairs: np.ndarray) -> float:
        hidden = np.maximum(self.chunk_maxima(b, pairs), 0)
        return float(np.concatenate([hidden.mean(0), hidden.max(0)]) @ self.out + self.bias)

    def step(self, b: np.ndarray, y: int, weight: float, rate: float, memory: dict) -> None:
        n = self.s.filters
        z = self.responses(b)
        starts = range(0, max(1, len(b) - (CHUNK - STRIDE)), STRIDE)
        places = np.stack([i + z[i : i + CHUNK - self.s.width + 1].argmax(0) for i in starts])
        best = z[places, np.arange(n)] + self.offset
        hidden = np.maximum(best, 0)
        top = hidden.argmax(0)
        features = np.concatenate([hidden.mean(0), hidden.max(0)])
        error = weight * float(sigmoid(features @ self.out + self.bias) - y)
        back = np.repeat(error * self.out[None, :n] / len(best), len(best), axis=0)
        back[top, np.arange(n)] += error * self.out[n:]
        back *= best > 0

        def update(name, value, grad):
            seen = memory.setdefault(name, np.zeros_like(value))
            seen += grad * grad
            value -= rate * grad / (np.sqrt(seen) + 1e-4)

        update("out", self.out, error * features)
        self.bias -= rate * 0.1 * error
        update("offset", self.offset, back.sum(0))
        grad = np.zeros_like(self.filters)
        each = np.broadcast_to(np.arange(n), places.shape)
        for j in range(self.s.width):
            np.add.at(grad[j], (b[places + j], each), back)
        update("filters", self.filters, grad)


@dataclass
class Model:
    network: Network
    slope: float
    cut: float

    def score(self, z: float) -> float:
        return float(sigmoid(self.slope * (z - self.cut) + logit(DECIDES)))


def fit(rows: list[tuple[object, int, bytes]], sizes: dict[int, int], s: Settings) -> Model | None:
    """Train on three quarters of the sample, calibrate on the rest: there each class weighs as in all labelled rows."""
    if len({y for _, y, _ in rows}) < 2:
        return None
    rng, net = np.random.default_rng(0), Network(s)
    data, y = [_bytes(x) for *_, x in rows], np.array([y for _, y, _ in rows])
    order = rng.permutation(len(rows))
    held = order[: int(len(rows) * s.calibration)] if len(rows) >= 40 else order
    train = order[len(held) :] if len(rows) >= 40 else order
    memory: dict = {}
    share = np.bincount(y, minlength=2) / len(y)
    for epoch in range(s.epochs):
        for i in rng.permutation(train):
            net.step(data[i], y[i], 0.5 / share[y[i]], s.rate / (1 + epoch), memory)
    pairs = net.pairs()
    z, truth = np.array([net.logit(data[i], pairs) for i in held]), y[held].astype(float)
    weight = np.array([sizes[int(v)] / max(1, (truth == v).sum()) for v in truth])
    weight *= len(weight) / weight.sum()
    slope, _ = platt(z, truth, weight)
    return Model(net, slope, threshold(z, truth, weight))


def score(docs: DataFrame, labels: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from the bytes of its whole text alone.

    Chunks of 512 bytes, each overlapping the next by 64, cover the text; shorter texts (and null ones, as empty) are filled up with zero
    bytes. Labels come only from rows that aren't ``held``, at most ``settings.each`` of either class. ``score`` is a calibrated
    probability, moved so that the threshold of highest F1 lies at 0.7; ``predicted`` is 1 from there on. Without labels
    of both classes every score is 1; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    spark, s = docs.sparkSession, settings
    rows, sizes = sample(docs, labels, label_col, ~held, s.each, id_col, text_col)
    shared = spark.sparkContext.broadcast(fit(rows, sizes, s))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pairs = m.network.pairs() if m else None
        for batch in batches:
            scores = [m.score(m.network.logit(_bytes(x), pairs)) if m else 1.0 for x in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= DECIDES).cast("int"))
