"""Document quality: random-indexing word vectors, pooled, and a small network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, bucket_of, chunks, labelled_sample, ship

#: Bytes that no word's core begins or ends with: ASCII but for digits and letters.
_EDGE = bytes(c for c in range(128) if not chr(c).isalnum())
#: Longer tokens are not remembered, so that a worker's memory is bounded by the number of remembered ones.
_LONG = 64


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are learned from; the rest sizes the vectors and the network."""

    sample: int = 6000
    slots: int = 1 << 15
    size: int = 64
    nonzero: int = 6
    hidden: int = 24
    epochs: int = 400
    seed: int = 7


class Words:
    """Words to slots: hashed cores, and for what surrounds a core and for its letter case a few slots of their own."""

    def __init__(self, slots: int):
        self.slots, self.memory = slots, {}

    def slot(self, token: bytes) -> int:
        if (s := self.memory.get(token)) is None:
            rest = token.lstrip(_EDGE)
            core = rest.rstrip(_EDGE)
            odd = (token[: len(token) - len(rest)] + rest[len(core) :]).strip(b".,")
            if odd or not core:
                name = b"\0edge" + odd[:3]
            elif len(core) > 1 and core.isupper():
                name = b"\0upper"
            else:
                name = core.lower()
            s = xxhash.xxh32_intdigest(name) % self.slots
            if len(token) <= _LONG:
                self.memory[token] = s
        return s

    def slots_of(self, text: bytes) -> np.ndarray:
        """A slot per word; a word equal to the one before it is in the slot of repetitions."""
        words = text.split()
        if len(self.memory) > 500_000:
            self.memory.clear()
        memory, slot = self.memory, self.slot
        out = np.fromiter([memory[w] if w in memory else slot(w) for w in words], np.int64, len(words))
        if len(out) > 1:
            again = np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), bool, len(words) - 1)
            out[1:][again] = 0
        return out


class Model:
    """Random-indexing vectors for slots, pooled by their mean, and a network of two layers over them."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def _vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        """Each slot has a sparse random index vector; its word vector adds those of the neighbours in the sample."""
        s = self.settings
        rng = np.random.default_rng(s.seed)
        index = np.zeros((s.slots, s.size), np.float32)
        for _ in range(s.nonzero):
            index[np.arange(s.slots), rng.integers(0, s.size, s.slots)] += rng.choice(np.float32([-1, 1]), s.slots)
        context = np.zeros_like(index)
        for row in rows:
            near = np.zeros((len(row), s.size), np.float32)
            for step in (1, 2):
                if len(row) > step:
                    near[step:] += index[row[:-step]]
                    near[:-step] += index[row[step:]]
            np.add.at(context, row, near)
        size = np.linalg.norm(context, axis=1, keepdims=True)
        return index + context / np.maximum(size, 1)

    def _pool(self, row: np.ndarray) -> np.ndarray:
        """Mean of a document's word vectors, and its length."""
        out = np.zeros(self.settings.size + 1, np.float32)
        if len(row):
            slots, count = np.unique(row, return_counts=True)
            out[:-1] = count.astype(np.float32) @ self.table[slots] / len(row)
            out[-1] = np.log1p(len(row))
        return out

    def fit(self, texts: list[bytes], labels: list[int]) -> Model:
        s, words = self.settings, Words(self.settings.slots)
        rows, y = [words.slots_of(t) for t in texts], np.array(labels, np.float32)
        self.constant = float(y.mean()) if len(y) else 0.5
        self.trained = 0 < y.sum() < len(y)
        if not self.trained:
            return self
        self.table = self._vectors(rows)
        x = np.stack([self._pool(r) for r in rows])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(s.seed + 1)
        test = rng.permutation(len(y)) < len(y) // 5
        fit_x, fit_y = (x[~test], y[~test]) if y[~test].min() != y[~test].max() else (x, y)
        self.a = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)).astype(np.float32)
        self.b, self.c, self.d = np.zeros(s.hidden, np.float32), rng.normal(0, 0.3, s.hidden).astype(np.float32), np.float32(0)
        params = [self.a, self.b, self.c, self.d]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        balance = np.where(fit_y == 1, 0.5 / fit_y.mean(), 0.5 / (1 - fit_y.mean()))
        for step in range(1, s.epochs + 1):
            h = np.tanh(fit_x @ params[0] + params[1])
            error = (_sigmoid(h @ params[2] + params[3]) - fit_y) * balance / len(fit_y)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [fit_x.T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], error.sum()]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.a, self.b, self.c, self.d = params
        margin = self._margin(x[test])
        self.heat, self.shift = _calibrated(margin, y[test])
        return self

    def _margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.a + self.b) @ self.c + self.d

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.full(len(rows), self.constant)
        x = (np.stack([self._pool(r) for r in rows]) - self.mean) / self.scale
        return _sigmoid(self._margin(x).astype(np.float64) / self.heat + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature, and the offset that undoes class weights, with the least log loss on held-back rows."""
    best = (np.inf, 1.0, 0.0)
    for heat in np.geomspace(0.25, 8, 21):
        for shift in np.linspace(-3, 3, 25):
            p = np.clip(_sigmoid(margin / heat + shift), 1e-6, 1 - 1e-6)
            loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0
            best = min(best, (loss, float(heat), float(shift)))
    return best[1], best[2]


def _fitted(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None, folds: int, settings: Settings):
    spark = docs.sparkSession
    ship(spark)
    sample = labelled_sample(spark, docs if train_docs is None else train_docs, labels, "quality", folds, settings.sample)
    return spark.sparkContext.broadcast(Model(settings).fit([t.encode() for t, _ in sample], [y for _, y in sample]))


def score_quality(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, folds: int = 5, threshold: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each whole text.

    Learns from at most ``settings.sample`` labelled rows of ``train_docs`` (else ``docs``) whose crc32(doc_id) modulo
    ``folds`` is not 0, and from their texts alone. Null and empty texts are scored as a document without words. Without
    labels of both classes every score is the share of label 1 (0.5 without any). A null doc_id is in the fold of the empty
    text. Repeated rows are each scored; of an id's contradicting labels the larger counts. Other columns are ignored.
    """
    settings = settings or Settings()
    model = _fitted(docs, labels, train_docs, folds, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(settings.slots)
        for part in chunks(batches, "text"):
            score = model.value.score([words.slots_of(t) for t in as_bytes(part, "text")])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text's score (see ``score_quality``) is at the threshold or over."""
    settings = settings or Settings()
    model = _fitted(docs, labels, None, folds, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(settings.slots)
        for part in chunks(batches, "text"):
            score = model.value.score([words.slots_of(t) for t in as_bytes(part, "text")])
            yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
