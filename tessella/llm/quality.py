"""Compression classifier: how much smaller dictionaries of good and of bad texts make a text.

A zstandard dictionary is trained on the good half-sample and one on the bad. The score is a calibrated function of one
number, the difference of a text's compressed sizes under the two, over its length.
"""

from __future__ import annotations

import pickle
import subprocess
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, owns_memory
from .labelled import Logistic, class_weights, labelled_sample, remainder

DICT_BYTES = 112_640
#: Samples that the trainer chooses from: texts of the sample in pieces of this length.
PIECE = 2_000
#: Each block is compressed alone, so that a long text is measured against the dictionaries all along.
BLOCK = 1_024
LEVEL = 3


#: Distinct runs of eight bytes that a class must hold for a dictionary to be trained on it. The native trainer dies of classes that repeat a few bytes.
LEAST_GRAMS = 1_000
_TRAIN = """
import pickle, sys, zstandard
size, pieces = pickle.load(sys.stdin.buffer)
sys.stdout.buffer.write(zstandard.train_dictionary(size, pieces).as_bytes())
"""


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary of all pieces of all texts; of a class with under LEAST_GRAMS distinct runs of eight bytes, the pieces themselves.

    The trainer runs in a process of its own: should it die of other content, the pieces take its place there too, and the caller lives.
    """
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    grams: set[bytes] = set()
    for p in pieces:
        grams.update(p[i : i + 8] for i in range(len(p) - 7))
        if len(grams) >= LEAST_GRAMS:
            size = min(DICT_BYTES, max(sum(map(len, pieces)) // 4, 256))
            done = subprocess.run([sys.executable, "-c", _TRAIN], input=pickle.dumps((size, pieces)), capture_output=True, check=False)
            if done.returncode == 0:
                return done.stdout
            break
    return b"".join(pieces)[-DICT_BYTES:]


class Sizes:
    """The difference of a text's compressed sizes by the good and the bad dictionary, over its length."""

    def __init__(self, good: bytes, bad: bytes):
        plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for content in (good, bad):
            if len(content) >= 8:
                d = zstandard.ZstdCompressionDict(content)
                d.precompute_compress(level=LEVEL)
                self.by.append(zstandard.ZstdCompressor(dict_data=d, **plain))
            else:
                self.by.append(zstandard.ZstdCompressor(**plain))

    def __call__(self, text: bytes) -> float:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.by)
        return (good - bad) / (len(text) + 16)


class Model:
    """Dictionaries from half of a sample, calibrated on the other half."""

    def __init__(self, rows: list[tuple[bytes, int]], sizes: dict[int, int]):
        self.good, self.bad = (dictionary([t for t, y in rows[::2] if y == c]) for c in (1, 0))
        rest = rows[1::2]
        y = np.array([y for _, y in rest])
        self.curve = None
        if len(set(y.tolist())) == 2:
            measure = Sizes(self.good, self.bad)
            self.curve = Logistic(np.array([[measure(t)] for t, _ in rest]), y, class_weights(y, sizes))
        total = sum(sizes.values())
        self.prior = sizes.get(1, 0) / total if total else 0.5

    def scores(self, sizes: Sizes, texts: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.prior)
        return self.curve(np.array([sizes(t) for t in texts]).reshape(len(texts), 1))


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("quality", None)
        model = held.value
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            s = model.scores(sizes, [t or b"" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.7).

    Labels are learnt from a bounded sample of rows whose crc32(id) mod modulus isn't held; the score reads
    nothing but the whole text. Null texts count as empty, and empty texts are scored too. Without
    labels of both classes every score is the share of label 1, or 0.5 without any. A null id isn't
    held out. One row for each row of docs.
    """
    bounded_batches(docs.sparkSession)
    learn = remainder(id_col, modulus) != held
    model = Model(*labelled_sample(docs, labels, label, learn, id_col, text_col))
    kept = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col, modulus) == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return out.mapInArrow(_score(kept), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
