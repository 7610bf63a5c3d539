"""Bounded labelled samples and the small logistic fits that calibrate scores."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each class in a training sample, and the most characters that one of them teaches by: of a longer text PIECES pieces of equal
#: length, spread evenly from its start to its end. 2 x 3,000 x 16,384 characters at most reach the driver.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS, PIECES = 16_384, 8


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def excerpt(text: Column) -> Column:
    """The text, or pieces of a text of more than SAMPLE_CHARS characters."""
    size = SAMPLE_CHARS // PIECES
    start = lambda k: (F.lit(1) + F.floor((F.length(text) - size) * F.lit(k) / F.lit(max(PIECES - 1, 1)))).cast("int")
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat(*(F.substring(text, start(k), F.lit(size)) for k in range(PIECES))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str, text_col: str) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """(texts with labels, labelled ids of each class).

    Of each class, the SAMPLE_ROWS ids that come first by a hash, among ids that learn admits, that all
    their labels agree on and that have a text. Everything that reaches the driver is bounded by SAMPLE_ROWS and
    SAMPLE_CHARS. Texts come in the order of the hash. Ids of any type meet as text. Null and other labels than 0 and 1 teach nothing.
    """
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(id_col).cast("string").alias("_id"))
    known = known.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y")).where("y = _y").select("_id", "y", F.xxhash64("_id").alias("at"))
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    sizes = {0: 0, 1: 0} | {y: n for y, n in known.groupBy("y").count().collect()}
    spark = docs.sparkSession
    rows, picked, open_classes = [], [], [y for y in (0, 1) if sizes[y]]
    # ids that come first by the hash, few more than are wanted, so that no task ranks a whole class; all where too few have texts
    for wanted in (2 * SAMPLE_ROWS, math.inf):
        if not open_classes:
            break
        some = known.where(reduce(Column.__or__, ((F.col("y") == y) & (F.col("at") <= _quantile(wanted / sizes[y])) for y in open_classes)))
        place = F.row_number().over(Window.partitionBy("y").orderBy("at", "_id"))
        found = some.join(texts.select("_id"), "_id", "left_semi").withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).drop("place").collect()
        done = [y for y in open_classes if wanted >= sizes[y] or sum(r.y == y for r in found) == SAMPLE_ROWS]
        picked += [(r._id, r.y, r["at"]) for r in found if r.y in done]
        open_classes = [y for y in open_classes if y not in done]
    if picked:
        few = F.broadcast(spark.createDataFrame(picked, "_id string, y int, at long"))  # 2 x SAMPLE_ROWS rows at most
        found = texts.join(few, "_id").groupBy("_id").agg(F.min(excerpt(F.col("_text"))).alias("_text"), F.min("y").alias("y"), F.min("at").alias("at")).collect()
        rows = [(r._text.encode(), r.y) for r in sorted(found, key=lambda r: (r.at, r._id))]
    return rows, sizes


def _quantile(share: float) -> int:
    """The hash under which a share of evenly spread hashes lies."""
    return (1 << 63) - 1 if share >= 1 else math.floor(share * (1 << 64)) - (1 << 63)


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's classes the shares that all labelled ids have."""
    w = np.ones(len(y))
    for c in (0, 1):
        if (n := (y == c).sum()) and sizes.get(c):
            w[y == c] = sizes[c] / n
    return w / max(w.mean(), 1e-12)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Logistic:
    """Ridge logistic regression by Newton steps over a few columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._columns(x)
        self.w = np.zeros(z.shape[1])
        keep = np.full(len(self.w), ridge)
        keep[0] = 1e-6
        for _ in range(60):
            p = sigmoid(z @ self.w)
            curve = weight * p * (1 - p) + 1e-9
            step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(keep), z.T @ (weight * (y - p)) - keep * self.w)
            self.w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._columns(x) @ self.w)
