"""Language identification from averaged hashed subword embeddings."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.common import WordIndex, chosen, lean, raw, small_batches, with_keys

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Sizes and rates. ``train_rows`` bounds the labelled sample, drawn by the id's hash from all allowed rows."""

    buckets: int = 1 << 14
    width: int = 16
    gram: int = 3
    train_rows: int = 4000
    epochs: int = 6
    rate: float = 0.5
    calibration: float = 0.25
    rejected: float = 0.001


def subwords(word: bytes, s: Settings) -> list[int]:
    """Hash buckets of a word with its ends marked, and of each character n-gram (of its UTF-8 bytes)."""
    marked = b"<" + word + b">"
    g = s.gram
    return [zlib.crc32(marked) % s.buckets, *[zlib.crc32(marked[i : i + g]) % s.buckets for i in range(len(marked) - g + 1)]]


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words without white space; empty if no character of the text is a letter."""
    readable = text.decode("utf-8", "replace")
    return readable.lower().encode().split() if any(map(str.isalpha, readable)) else []


def bag(words: list[bytes], s: Settings, seen: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of a text and how often each occurs: at most one entry for each bucket, however long the text."""
    if len(seen) > 100_000:
        seen.clear()
    total = np.zeros(s.buckets, np.int64)
    for word, n in Counter(words).items():
        if word not in seen:
            seen[word] = subwords(word, s)
        np.add.at(total, seen[word], n)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def index(self) -> WordIndex:
        """For each word, the sum of its subwords' rows, and their number."""
        return WordIndex(self.sums, self.table.shape[1] + 1)

    def sums(self, words: list[bytes]) -> np.ndarray:
        found = [subwords(w, self.settings) for w in words]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        return np.concatenate([np.add.reduceat(self.table[flat], np.cumsum(n) - n), n[:, None]], axis=1)

    def probabilities(self, words: list[bytes], index: WordIndex) -> np.ndarray:
        total = index.gather(words).sum(0, dtype=np.float64) if words else np.zeros(len(self.languages) + 1)
        z = (total[:-1] / max(total[-1], 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], s: Settings) -> Model:
    """Stochastic gradient descent on the softmax's log loss, then temperature and rejection threshold on held rows.

    The threshold is the confidence under which ``s.rejected`` of the rightly labelled calibration rows fall, and never
    more than an even chance, so that plain text stays.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(0)
    embedding = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
    weights, bias = np.zeros((s.width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(bags))
    held = order[: int(len(order) * s.calibration)] if len(order) >= 20 else order
    train = order[len(held) :] if len(order) >= 20 else order
    shares = [(at, n / max(1, n.sum())) for at, n in bags]
    steps, done = max(1, s.epochs * len(train)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(train):
            at, share = shares[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            mean = share @ embedding[at]
            error = _softmax(mean @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embedding[at] -= 20 * rate * share[:, None] * back
    table = embedding @ weights
    logits = np.array([share @ table[at] + bias for at, share in (shares[i] for i in held)]).reshape(len(held), len(languages))
    truth = y[held]
    temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).sum())
    best = _softmax(logits / temperature)
    right = best.max(1)[best.argmax(1) == truth]
    threshold = min(0.5, float(np.quantile(right, s.rejected))) if len(right) else 0.0
    return Model(s, languages, table.astype(np.float32), bias, float(temperature), threshold)


def bags_of(docs: DataFrame, id_col: str, text_col: str, s: Settings, *more: str) -> DataFrame:
    """``(id, more, buckets, counts)`` of documents, made on the executors."""
    small_batches(docs.sparkSession)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            made = [bag(words_of(x), s, seen) for x in raw(batch, "text")]
            kept = [batch.column(c) for c in ("id", *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary())], ["id", *more, "buckets", "counts"])

    return docs.select(F.col(id_col).alias("id"), *more, F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {docs.schema[id_col].dataType.simpleString()}{kinds}, buckets binary, counts binary")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model | None:
    """A model from the rows for which ``learn`` holds, with non-null language, text and id; None if there are none.

    At most ``settings.train_rows`` rows are used, chosen by the id's hash over the whole table; of an id with several texts that of the smallest hash.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keys = chosen(labelled.select(id_col), id_col, settings.train_rows)
    one = F.min(F.struct(F.xxhash64(text_col), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))).alias("one")
    few = with_keys(labelled.select(id_col, lang_col, text_col), id_col, keys).groupBy(id_col).agg(one)
    few = few.select(id_col, F.col("one.lang").alias(lang_col), F.col("one.text").alias(text_col))
    rows = bags_of(few, id_col, text_col, settings, lang_col).collect()
    rows = sorted(((r["id"], r[lang_col], bytes(r["buckets"]), bytes(r["counts"])) for r in rows if len(r["buckets"])))
    if not rows:
        return None
    return fit([(np.frombuffer(b, np.int32), np.frombuffer(n, np.float32)) for *_, b, n in rows], [r[1] for r in rows], settings)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``'s columns, ``lang_pred, score, accepted`` for every row, read from its whole text alone.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null or has no letter (or nothing was
    learned); ``score`` is the calibrated probability. ``accepted`` is false for ``und`` and where the score is under the
    model's threshold. Repeated rows are scored each; an empty table gives no rows; the text column itself may be kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or (id_col,)
    fields = docs.select(*keep).schema
    names = [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = m.index() if m else None
        for batch in batches:
            langs, scores, accepted = [], [], []
            for text in raw(batch, "text"):
                words = words_of(text) if m else []
                if not words:
                    langs.append(UNKNOWN), scores.append(0.0), accepted.append(False)
                    continue
                p = m.probabilities(words, index)
                k = int(p.argmax())
                langs.append(m.languages[k]), scores.append(float(p[k])), accepted.append(bool(p[k] >= m.threshold))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names)

    given = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = given.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double, accepted boolean")
    return out.toDF(*keep, *names[len(keep) :])
