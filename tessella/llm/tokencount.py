"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character, longest first; dynamic
programming keeps the best score and the piece count of each end. Ties follow the unigram tokenizer: a
later candidate must be strictly better, candidates come by start, and a character without a piece of its own
costs the least score less ten.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, bounded_batches, owns_memory

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model file, read from its protocol buffer."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for field, value in _fields(data):
        if field == 1:
            d = dict(_fields(value))
            out.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
    return out


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = (4, at) if kind == 5 else (8, at) if kind == 1 else _varint(data, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


class Counter:
    """Pieces that the best path of a text has.

    No piece may hold a space mark after another character, so a text falls apart before each run of marks; with
    whole-numbered scores, sums are exact and the parts' best paths are the whole text's. A line feed that no
    piece holds separates as well. Otherwise the text is taken in one.
    """

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.machine = ahocorasick.Automaton()
        normal = [(p, s) for p, s, kind in vocabulary if kind in (NORMAL, USER_DEFINED) and p]
        for piece, score in normal:
            self.machine.add_word(piece, (len(piece), score))
        if normal:
            self.machine.make_automaton()
        self.unknown = min((s for _, s, _ in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known = sum(kind == BYTE for _, _, kind in vocabulary) == 256
        splits = self.bytes_known and all(s == int(s) for _, s in normal) and not any(SPACE in p.lstrip(SPACE) for p, _ in normal)
        lines = splits and not any("\n" in p for p, _ in normal)
        self.parts = re.compile("\n+|%s+[^%s\n]*|[^%s\n]+" % ((SPACE,) * 3) if lines else "%s+[^%s]*|[^%s]+" % ((SPACE,) * 3)) if splits else None
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a text: a space mark goes before it and takes each space's place. An empty text has none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.parts is None:
            return self.viterbi(text)
        total, memo = 0, self.memo
        for part in self.parts.findall(text):
            n = memo.get(part)
            if n is None:
                n = self.viterbi(part)
                if len(part) <= 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[part] = n
            total += n
        return total

    def viterbi(self, text: str) -> int:
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        alone = [False] * (n + 1)  # whether the last piece of the best path is an unknown character
        found = self.machine.iter(text) if len(self.machine) else iter(())
        match = next(found, None)
        for end in range(1, n + 1):
            best, pieces_, single = None, 0, False
            while match is not None and match[0] == end - 1:
                size, value = match[1]
                start = end - size
                if best is None or value + score[start] > best:
                    best, pieces_ = value + score[start], count[start] + 1
                single = single or size == 1
                match = next(found, None)
            if not single and (best is None or self.unknown + score[end - 1] > best):
                best = self.unknown + score[end - 1]
                # unknown characters are bytes, or else one unknown token for a run of them
                pieces_ = count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.bytes_known else not alone[end - 1])
                alone[end] = True
            score[end], count[end] = best, pieces_
        return count[n]


@cache
def load(path: str) -> Counter:
    return Counter(pieces(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of each whole text under the unigram vocabulary in path.

    Null and empty texts have no tokens. One row for each row of docs; only the named columns are read.
    path must be readable on every executor.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("tokencount", load.cache_clear)
        counter = load(path)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
