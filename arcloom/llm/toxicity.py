"""A convolutional text classifier for toxicity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm import language
from arcloom.llm.calibrate import logit, platt, sigmoid, threshold
from arcloom.llm.common import WordIndex, lean, raw, small_batches
from arcloom.llm.labelled import sample

DECIDES = 0.3
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words that are convolved at a time; parts overlap by the widest filter.
STRIDE = 8192


@dataclass(frozen=True)
class Settings:
    """``each`` bounds the sample: so many labelled documents of either class."""

    buckets: int = 1 << 15
    width: int = 12
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    beginning: int = 4
    each: int = 1500
    epochs: int = 4
    rate: float = 0.05
    calibration: float = 0.25
    language: language.Settings = language.Settings(train_rows=2000, epochs=4)


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, lower-cased."""
    return text.decode("utf-8", "replace").lower().encode().translate(None, _PUNCTUATION).split()


def buckets_of(word: bytes, s: Settings) -> tuple[int, int]:
    """A word's embedding is the sum of two hashed ones: its own, and that of its beginning, which inflected forms share."""
    return zlib.crc32(word) % s.buckets, zlib.crc32(b"^" + word[: s.beginning]) % s.buckets


def encoded(text: bytes, s: Settings) -> np.ndarray:
    """The two buckets of each word; a text shorter than the widest filter is filled up with the empty bucket."""
    words = words_of(text)
    pairs = np.array([buckets_of(w, s) for w in words], np.int64).reshape(-1, 2)
    short = max(s.widths) - len(pairs)
    return np.concatenate([pairs, np.full((short, 2), s.buckets)]) if short > 0 else pairs


class Network:
    """Embeddings, filters of several widths over them, the maximum over all places, and a logistic output."""

    def __init__(self, s: Settings, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.s = s
        self.embedding = rng.normal(0, 0.05, (s.buckets + 1, s.width)).astype(np.float32)
        self.embedding[s.buckets] = 0
        self.filters = [rng.normal(0, 0.5 / np.sqrt(w * s.width), (w, s.width, s.filters)).astype(np.float32) for w in s.widths]
        self.offset = np.zeros((len(s.widths), s.filters), np.float32)
        self.out = rng.normal(0, 0.1, len(s.widths) * s.filters).astype(np.float32)
        self.bias = 0.0

    def start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """The first component of the embeddings starts as the log odds of a text with that bucket, and the first filter of
        each width looks at it; the rest starts at random."""
        seen = np.zeros((2, self.s.buckets + 1))
        for pairs, label in zip(texts, y, strict=True):
            seen[label, np.unique(pairs)] += 1
        n = np.bincount(y, minlength=2)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        self.embedding[:, 0] = np.where(seen.sum(0) > 0, np.clip(odds, -3, 3), 0) / 3
        self.embedding[self.s.buckets] = 0
        for i, f in enumerate(self.filters):
            f[:, 0, 0] = 1 / len(f)
            self.out[i * self.s.filters] = 1.0

    def pooled(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each filter its highest response and the place of it."""
        e = self.embedding[pairs].sum(1)
        best, places = [], []
        for f, b in zip(self.filters, self.offset, strict=True):
            n = len(e) - len(f) + 1
            z = e[:n] @ f[0]
            for j in range(1, len(f)):
                z += e[j : j + n] @ f[j]
            at = z.argmax(0)
            best.append(z[at, np.arange(z.shape[1])] + b)
            places.append(at)
        return np.stack(best), np.stack(places)

    def step(self, pairs: np.ndarray, y: int, weight: float, rate: float, memory: dict) -> None:
        """One stochastic gradient step, of a size that shrinks for each parameter with its past gradients."""
        best, places = self.pooled(pairs)
        hidden = np.maximum(best, 0).ravel()
        error = weight * float(sigmoid(hidden @ self.out + self.bias) - y)
        back = (error * self.out).reshape(best.shape) * (best > 0)

        def update(name, value, grad, at=...):
            seen = memory.setdefault(name, np.full_like(value, 1e-3))
            seen[at] += grad * grad
            value[at] -= rate * grad / np.sqrt(seen[at])

        rows, grads = [], []
        for i, f in enumerate(self.filters):
            here = pairs[places[i][:, None] + np.arange(len(f))]  # filter, place in it, two buckets
            rows.append(np.moveaxis(here, 2, 0).reshape(-1))
            grads.append(np.tile((back[i][:, None, None] * f.transpose(2, 0, 1)).reshape(-1, f.shape[1]), (2, 1)))
            update(("filter", i), f, (back[i][:, None, None] * self.embedding[here].sum(2)).transpose(1, 2, 0))
        update("out", self.out, error * hidden)
        update("offset", self.offset, back)
        self.bias -= rate * 0.1 * error
        rows, own = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(rows), self.s.width), np.float32)
        np.add.at(total, own, np.concatenate(grads))
        real = rows < self.s.buckets
        update("embedding", self.embedding, total[real], rows[real])

    def logit(self, pairs: np.ndarray) -> float:
        return float(np.maximum(self.pooled(pairs)[0], 0).ravel() @ self.out + self.bias)

    def tables(self) -> "Tables":
        """Each filter's part at each of its places, for every bucket at once: scoring then only looks up and adds."""
        return Tables(self.s, np.concatenate([self.embedding @ part for f in self.filters for part in f], axis=1), self.offset.ravel(), self.out, self.bias)


@dataclass
class Tables:
    s: Settings
    parts: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float

    def logit(self, rows: np.ndarray) -> float:
        """The network's output for a whole text, given its words' rows of ``parts``; they are convolved a part at a time."""
        widest, n = max(self.s.widths), self.s.filters
        best = np.full(n * len(self.s.widths), -np.inf, np.float32)
        for i in range(0, max(1, len(rows) - widest + 1), STRIDE):
            p = rows[i : i + STRIDE + widest - 1]
            if len(p) < widest:
                p = np.concatenate([p, np.zeros((widest - len(p), p.shape[1]), np.float32)])
            column = 0
            for k, w in enumerate(self.s.widths):
                m = len(p) - w + 1
                z = p[:m, column : column + n]
                for j in range(1, w):
                    z = z + p[j : j + m, column + j * n : column + (j + 1) * n]
                column += w * n
                best[k * n : (k + 1) * n] = np.maximum(best[k * n : (k + 1) * n], z.max(0))
        return float(np.maximum(best + self.offset, 0) @ self.out + self.bias)


@dataclass
class Model:
    tables: Tables
    slope: float
    intercept: float
    cuts: dict[str, float]  # by language, and at "" for all
    languages: language.Model | None

    def index(self) -> WordIndex:
        """For each word its row of ``parts``, and what it adds to the language model's sums."""
        parts, s, m = self.tables.parts, self.tables.s, self.languages

        def make(words: list[bytes]) -> np.ndarray:
            pairs = np.array([buckets_of(w, s) for w in words])
            own = parts[pairs[:, 0]] + parts[pairs[:, 1]]
            return np.concatenate([own, m.sums(words)], axis=1) if m else own

        return WordIndex(make, parts.shape[1] + (m.table.shape[1] + 1 if m else 0))

    def read(self, text: bytes, index: WordIndex) -> tuple[float, str]:
        """The network's output and the language of a whole text."""
        width, words = self.tables.parts.shape[1], words_of(text)
        rows = index.gather(words) if words else np.zeros((0, index.rows.shape[1]), np.float32)
        lang = ""
        if self.languages and words:
            total = rows[:, width:].sum(0, dtype=np.float64)
            lang = self.languages.languages[int((total[:-1] / max(total[-1], 1) + self.languages.bias).argmax())]
        return self.tables.logit(rows[:, :width]), lang

    def score(self, z: float, lang: str) -> float:
        """The calibrated probability, moved so that the language's threshold lies at ``DECIDES``."""
        return float(sigmoid(self.slope * (z - self.cuts.get(lang, self.cuts[""])) + logit(DECIDES)))


def fit(rows: list[tuple[object, int, bytes]], sizes: dict[int, int], languages: language.Model | None, s: Settings) -> Model | None:
    """Train on three quarters of the sample, calibrate on the rest: there each class weighs as in all labelled rows.

    A cut lies midway between that of highest F1, which a few rows can move, and that of an even calibrated chance.
    """
    if len({y for _, y, _ in rows}) < 2:
        return None
    rng, net = np.random.default_rng(0), Network(s)
    texts = [encoded(x, s) for *_, x in rows]
    y = np.array([y for _, y, _ in rows])
    order = rng.permutation(len(rows))
    held = order[: int(len(rows) * s.calibration)] if len(rows) >= 40 else order
    train = order[len(held) :] if len(rows) >= 40 else order
    net.start([texts[i] for i in train], y[train])
    memory: dict = {}
    share = np.bincount(y, minlength=2) / len(y)
    for epoch in range(s.epochs):
        for i in rng.permutation(train):
            net.step(texts[i], y[i], 0.5 / share[y[i]], s.rate / (1 + epoch), memory)
    tables = net.tables()
    z = np.array([net.logit(texts[i]) for i in held])
    truth = y[held].astype(float)
    weight = np.array([sizes[int(v)] / max(1, (truth == v).sum()) for v in truth])
    weight *= len(weight) / weight.sum()
    slope, intercept = platt(z, truth, weight)
    even = -intercept / slope
    cut = lambda own: (threshold(z[own], truth[own], weight[own]) + even) / 2
    model = Model(tables, slope, intercept, {"": cut(weight > 0)}, languages)
    if languages:
        index = model.index()
        langs = [model.read(rows[i][2], index)[1] for i in held]
        for lang in sorted({*langs} - {""}):
            own = np.array([x == lang for x in langs])
            if (truth[own] == 1).sum() >= 15 and (truth[own] == 0).sum() >= 15:
                model.cuts[lang] = cut(own)
    return model


def score(docs: DataFrame, labels: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from its whole text alone.

    Labels come only from rows that aren't ``held``, at most ``settings.each`` of either class. ``score`` is a calibrated
    probability, moved so that the cut for the text's language (as a model of languages, trained from
    the same rows' texts, reads it) lies at 0.3; ``predicted`` is 1 from there on. Null and empty texts are scored as a text
    without words; without labels of both classes every score is 0; repeated rows are scored each; an empty table
    gives no rows; of other columns of the documents only ``lang_col`` is read, in training the language model.
    """
    spark, s = docs.sparkSession, settings
    rows, sizes = sample(docs, labels, label_col, ~held, s.each, id_col, text_col)
    languages = language.train(docs, ~held, id_col, text_col, lang_col, s.language) if rows and lang_col in docs.columns else None
    shared = spark.sparkContext.broadcast(fit(rows, sizes, languages, s))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = m.index() if m else None
        for batch in batches:
            scores = [m.score(*m.read(x, index)) if m else 0.0 for x in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= DECIDES).cast("int"))
