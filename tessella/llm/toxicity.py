"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, MEMO_ENTRIES, bounded_batches, mix64, owns_memory
from .labelled import Logistic, class_weights, labelled_sample, remainder, sigmoid

BITS = 22
STEMS = (4, 5)
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
#: Strengths of sparsity that are tried; the one whose weights say most about the calibrating part of the sample is taken.
L1 = (2.0, 4.0, 8.0)
EPOCHS, TRIAL_EPOCHS = 8, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Slots of a text: words, their stems (first letters), pairs of neighbours, pairs over one word."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.table = np.empty((MEMO_ENTRIES + 65_538, 1 + len(STEMS)), np.uint64)

    def _number(self, word: bytes) -> int:
        k = self.at[word] = len(self.at)
        # stems are of characters, so that a cut doesn't split one
        text = word.decode("utf-8", "replace")
        stems = [xxhash.xxh64_intdigest(text[:n].encode(), seed=n) for n in STEMS]
        self.table[k] = [xxhash.xxh64_intdigest(word), *stems]
        return k

    def __call__(self, text: bytes) -> np.ndarray:
        """Slot numbers, with repetitions; slot 0 is the intercept."""
        words = text.translate(ALNUM).split()
        out, at = [np.zeros(1, np.int64)], self.at
        for start in range(0, len(words), 65_536):  # with two words more, for the pairs
            part = words[start : start + 65_538]
            if len(at) + len(part) > len(self.table):
                at.clear()
            rows = self.table[[at[w] if w in at else self._number(w) for w in part]]
            h = rows[:, 0]
            grams = [rows.ravel(), h[:-1] * _STEP + h[1:], (h[:-2] ^ _STEP) * _STEP + h[2:]]
            out += [(mix64(g.copy()) >> np.uint64(64 - BITS)).astype(np.int64) for g in grams]
        return np.concatenate(out)


class Ftrl:
    """Weights of presence features with per-coordinate rates and L1 sparsity."""

    def __init__(self, l1: float):
        self.l1 = np.float32(l1)
        self.z = np.zeros(1 << BITS, np.float32)
        self.n = np.zeros(1 << BITS, np.float32)

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (np.clip(z, -self.l1, self.l1) - z) / ((np.float32(BETA) + root) / np.float32(ALPHA) + np.float32(L2))

    def weights(self, i) -> np.ndarray:
        return self._weights(self.z[i], np.sqrt(self.n[i]))

    def learn(self, i: np.ndarray, y: int) -> None:
        z, n = self.z[i], self.n[i]
        root = np.sqrt(n)
        w = self._weights(z, root)
        g = np.float32(sigmoid(float(w.sum())) - y)
        n += g * g
        self.z[i] = z + g - (np.sqrt(n) - root) / np.float32(ALPHA) * w
        self.n[i] = n


def fitted(seen: list[tuple[np.ndarray, int]], l1: float, epochs: int) -> np.ndarray:
    """Weights after some rounds over (slots, label), in an order that is always the same."""
    ftrl, order = Ftrl(l1), np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            ftrl.learn(*seen[k])
    return ftrl.weights(slice(None))


def loss(curve: Logistic, margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(curve(margins[:, None]), 1e-9, 1 - 1e-9)
    return float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean())


class Model:
    """Sparse weights, and the curve that turns their sum into a score.

    Four fifths of the sample teach the weights; the last fifth picks the sparsity and calibrates.
    """

    def __init__(self, rows: list[tuple[bytes, int]], sizes: dict[int, int]):
        total = sum(sizes.values())
        self.prior = sizes.get(1, 0) / total if total else 0.5
        self.slots, self.values, self.curve = np.zeros(0, np.int64), np.zeros(0, np.float32), None
        train, rest = [r for k, r in enumerate(rows) if k % 5], rows[::5]
        y = np.array([y for _, y in rest])
        if len(set(y.tolist())) < 2 or len({y for _, y in train}) < 2:
            return
        features = Features()
        seen = [(np.unique(features(t)).astype(np.int32), y) for t, y in train]
        judged = [np.unique(features(t)) for t, _ in rest]
        weight = class_weights(y, sizes)
        trials = []
        for l1 in L1:
            w = fitted(seen, l1, TRIAL_EPOCHS)
            margins = np.array([w[i].sum(dtype=np.float64) for i in judged])
            trials.append((loss(Logistic(margins[:, None], y, weight, ridge=1e-3), margins, y, weight), -l1))
        w = fitted(seen, -min(trials)[1], EPOCHS)
        self.slots = np.flatnonzero(w)
        self.values = w[self.slots]
        margins = np.array([w[i].sum(dtype=np.float64) for i in judged])
        self.curve = Logistic(margins[:, None], y, weight, ridge=1e-3)

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.slots] = self.values
        return w

    def margins(self, w: np.ndarray, features: Features, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            i = features(text)
            out[k] = w[np.unique(i[w[i] != 0])].sum(dtype=np.float64)
        return out

    def scores(self, w: np.ndarray, features: Features, texts: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.prior)
        return self.curve(self.margins(w, features, texts)[:, None])


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("toxicity", None)
        w, features = held.value.dense(), Features()
        for batch in batches:
            s = held.value.scores(w, features, [t or b"" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 3, held: int = 1) -> Model:
    learn = remainder(id_col, modulus) != held
    return Model(*labelled_sample(docs, labels, label, learn, id_col, text_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.7).

    Labels are learnt from a bounded sample of rows whose crc32(id) mod modulus isn't held; the score reads
    nothing but the whole text. Null texts count as empty, and empty texts are scored too. Without
    labels of both classes every score is the share of label 1, or 0.5 without any. A null id isn't
    held out. One row for each row of docs.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label, modulus, held))
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col, modulus) == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return out.mapInArrow(_score(kept), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, whose text isn't predicted toxic; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("toxicity", None)
        w, features = kept.value.dense(), Features()
        for batch in batches:
            s = kept.value.scores(w, features, [(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < 0.7))

    return docs.mapInArrow(run, docs.schema)
