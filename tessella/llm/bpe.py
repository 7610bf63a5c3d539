"""Byte-level BPE by a rank queue under hierarchical bitmaps."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, owns_memory


#: Pre-tokens in each of a worker's two memos (some 50 MB each).
MEMO_ENTRIES = 300_000


class Bpe:
    """Encodes as the rank file says; ranks are the ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.words = [0] * ((max(self.tokens) >> 8) + 1)
        self.bits = [1 << b for b in range(max(256, len(self.words)))]
        self.packed = _Packed(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, merges until none has a rank.

        The queue is a bucket of positions for each rank under a bitmap of two levels: bit b of words[w] says that bucket
        256 * w + b isn't empty, and bit w of top that words[w] isn't zero, so two find-first-set steps lead to
        the next rank. A bucket of one position is that number, a larger one a heap. words is all zeros before and after.
        It is written out in line, because calls would cost more than the queue itself.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ranks, words, bits, n = self.ranks.get, self.words, self.bits, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # start of the part on the left
        due = [None] * n  # rank of the pair that starts here, None if it has none
        buckets: dict[int, int | list[int]] = {}
        top = 0
        for at in range(n - 1):
            rank = ranks(piece[at : at + 2])
            if rank is not None:
                due[at] = rank
                if rank in buckets:
                    bucket = buckets[rank]
                    if type(bucket) is int:
                        buckets[rank] = [bucket, at] if bucket <= at else [at, bucket]
                    else:
                        heapq.heappush(bucket, at)
                else:
                    buckets[rank] = at
                    words[rank >> 8] |= bits[rank & 255]
                    top |= bits[rank >> 8]
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << 8) + (word & -word).bit_length() - 1
            at = buckets[rank]
            if type(at) is int:
                del buckets[rank]
                words[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            else:
                bucket, at = at, heapq.heappop(at)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            if due[at] != rank:  # stale: one of its parts has grown or gone since
                continue
            middle = end[at]
            stop = end[at] = end[middle]
            due[middle] = None
            if stop < n:
                before[stop] = at
                due[at] = rank = ranks(piece[at : end[stop]])
                if rank is not None:
                    if rank in buckets:
                        bucket = buckets[rank]
                        if type(bucket) is int:
                            buckets[rank] = [bucket, at] if bucket <= at else [at, bucket]
                        else:
                            heapq.heappush(bucket, at)
                    else:
                        buckets[rank] = at
                        words[rank >> 8] |= bits[rank & 255]
                        top |= bits[rank >> 8]
            else:
                due[at] = None
            left = before[at]
            if left >= 0:
                due[left] = rank = ranks(piece[left:stop])
                if rank is not None:
                    if rank in buckets:
                        bucket = buckets[rank]
                        if type(bucket) is int:
                            buckets[rank] = [bucket, left] if bucket <= left else [left, bucket]
                        else:
                            heapq.heappush(bucket, left)
                    else:
                        buckets[rank] = left
                        words[rank >> 8] |= bits[rank & 255]
                        top |= bits[rank >> 8]
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Packed(dict):
    """Pre-token to its packed ids; a full memo becomes the old one, and what is used comes over."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = pack(self.bpe.merge(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@cache
def load(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("bpe", load.cache_clear)
        bpe = load(path, pattern)
        for batch in batches:
            ids = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
            back = [bpe.decode(x) for x in ids]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _digest(path: str, pattern: str):
    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _encode(path, pattern)(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sha(b.column(2).to_pylist()), sha(b.column(3).to_pylist())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _apply(docs: DataFrame, id_col: str, text_col: str, f, columns: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(f, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {columns}")


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian u32) and decoded (the bytes that the ids stand for).

    Every match of pattern in a whole text is encoded separately, without special tokens. Null and empty
    texts have no ids. One row for each row of docs; only the named columns are read. path must be
    readable on every executor, as the tokenizer package is.
    """
    return _apply(docs, id_col, text_col, _encode(path, pattern), "n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 of the ids and of the decoded bytes in their place."""
    return _apply(docs, id_col, text_col, _digest(path, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string")
