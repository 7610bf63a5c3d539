"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers of at most the capacity, so how many pieces have each length (a row for each length) says all that a packing needs. From that table the
driver makes a plan: large pieces are grouped in equal numbers and rounded up to the largest of their group, configurations of the few sizes that are left are
optimised, the actual lengths take their places, and what remains goes where it fits best. The plan names pieces by their rank among those of one length; every task finds its
pieces' places in it by binary search. Pieces never meet in one task, and the plan's size depends on the capacity alone.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, Workspace, bounded_batches, byte_characters, owns_memory

#: Room of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: What is tried: large pieces are over one part in so many of the capacity, and are rounded within so many groups. Fewer sizes fill a
#: sequence where only large pieces are optimised, so more groups can be told apart.
TRIALS = ((8, 64), (5, 128), (4, 128), (3, 512))
#: Steps of the optimisation for each size.
STEPS = 5
#: Columns of a plan.
LENGTH, FIRST, LAST, EACH, SEQUENCE, OFFSET = range(6)

#: Separators that Python's split takes for white space and the tokenizer doesn't; texts that hold one are split by pattern.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_CHUNK = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters that neither compose nor change their kind in lower case, and marks that may follow them.
_WORD, _MARKS = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]+"), string.punctuation.replace("'", "")
#: The longest chunks that are remembered, and how many of them, twice over.
_LONG, _KNOWN = 64, 2 * MEMO_ENTRIES


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Ids:
    """Chunk without white space to its packed ids. The tokenizer drops white space and no token spans it, so a text's ids are those of its chunks.

    Words of plain letters, and marks after them, are what the tokenizer's own pattern makes of a chunk: they go straight to its model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old, self.words = Tokenizer.from_file(path), {}, {}, {}
        self.model = self.tokenizer.model
        coded = byte_characters()
        self.coded = {b: c for c, b in coded.items()}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            raw = word if word.isascii() else "".join([self.coded[b] for b in word.encode()])
            ids = self.words[word] = packed([t.id for t in self.model.tokenize(raw)])
            if len(self.words) > _KNOWN:
                self.words = {}
        return ids

    def look_up(self, chunks: set[str]) -> dict[str, bytes]:
        out, odd = {}, []
        for x in chunks:
            ids = self.new.get(x)
            if ids is None:
                ids = self.old.get(x)
                if ids is None:
                    core = x.rstrip(_MARKS)
                    if not core or len(x) > _LONG or not _WORD.fullmatch(core):
                        odd.append(x)
                        continue
                    ids = self.word(core.lower())
                    if len(core) < len(x):
                        ids += self.word(x[len(core) :])
                self.new[x] = ids
            out[x] = ids
        for i in range(0, len(odd), 1024):
            part = odd[i : i + 1024]
            for x, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                out[x] = packed(e.ids)
                if len(x) <= _LONG:
                    self.new[x] = out[x]
        if len(self.new) > _KNOWN:
            self.old, self.new = self.new, {}
        return out


@cache
def load(path: str) -> _Ids:
    return _Ids(path)


def _pieces(path: str, capacity: int, end: int | None):
    tail = b"" if end is None else packed([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("packing", load.cache_clear)
        known, part = load(path), TaskContext.get().partitionId()
        nth = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            texts = [x.as_py() or "" for x in b.column(1)]
            texts = [_CHUNK.findall(x) if _SEPARATORS.search(x) else x.split() for x in texts]
            found = known.look_up({x for chunks in texts for x in chunks})
            for key, chunks in zip(b.column(0).to_pylist(), texts, strict=True):
                ids = b"".join([found[x] for x in chunks]) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((key, piece, at // 4, n, zlib.crc32(own), part, int(nth[n])))
                    nth[n] += 1
                if len(rows) >= 4096:
                    yield shown(rows, b.schema.field(0).type)
                    rows = []
            if rows:
                yield shown(rows, b.schema.field(0).type)

    names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
    kinds = (None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def shown(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k or key) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return run


# -- the plan ---------------------------------------------------------------------------------------


def _grouped(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """(size, number) of groups of equal cardinality over lengths in descending order, each rounded up to its largest length; equal sizes are one."""
    total = sum(n for _, n in lengths)
    each, before = -(-total // groups), 0
    out: list[tuple[int, int]] = []
    for length, n in lengths:
        while n:
            room = each - before % each
            take = min(n, room)
            if before % each == 0 and not (out and out[-1][0] == length):
                out.append((length, take))
            else:
                out[-1] = out[-1][0], out[-1][1] + take
            before, n = before + take, n - take
    return out


def _entered(inverse: np.ndarray, step: np.ndarray, out: int) -> np.ndarray:
    """The basis' inverse once a column, which is step in its terms, stands in place out."""
    row = inverse[out] / step[out]
    inverse = inverse - np.outer(step, row)
    inverse[out] = row
    return inverse


def _started(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(a first basis, its inverse): the largest size that is left with what fits beside it, until one of them is used up; so each column ends a size of its own."""
    k = len(sizes)
    basis, left = np.diag(capacity // sizes).astype(float), demand.copy()
    inverse = np.diag(1 / np.diag(basis))
    open_ = left > 0
    while open_.any():
        column, room = np.zeros(k), capacity
        for i in np.flatnonzero(open_):  # sizes fall
            n = min(room // sizes[i], int(left[i] + 1)) if room >= sizes[i] else 0
            column[i], room = n, room - n * sizes[i]
        times = np.where(column > 0, left / np.where(column > 0, column, 1), np.inf)
        out = int(times.argmin())
        left = np.maximum(left - times[out] * column, 0)
        left[out] = 0
        basis[:, out] = column
        inverse = _entered(inverse, inverse @ column, out)
        open_[out] = False
        open_ &= left > 1e-9
    return basis, inverse


def _priced(sizes: np.ndarray, value: np.ndarray, capacity: int, below: np.ndarray) -> tuple[float, np.ndarray]:
    """(worth, counts by size) of the best configuration; one size more a layer, for every room at once. below: the room that each size leaves in each room."""
    room = np.arange(capacity + 1)
    best, picks = np.append(np.zeros(capacity + 1), -np.inf), []
    for _ in range(int(capacity // sizes.min())):
        worth = np.take(best, below)
        worth += value
        pick = worth.argmax(axis=1)
        worth = worth[room, pick]
        better = worth > best[:-1] + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best[:-1] = np.where(better, worth, best[:-1])
    counts, at = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[at] >= 0:
            counts[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(best[capacity]), counts


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns of counts by size, how often each is used): a least number of sequences of a relaxed problem, by column generation.

    Every basis holds what is asked for, so the bound on steps costs quality, not correctness.
    """
    k = len(sizes)
    basis, inverse = _started(sizes, demand, capacity)
    used = np.maximum(inverse @ demand, 0)
    room = np.arange(capacity + 1)[:, None]
    below = np.where(room >= sizes, room - sizes, capacity + 1)  # where a size doesn't fit, a room worth nothing
    for _ in range(STEPS * k):
        worth, column = _priced(sizes, inverse.sum(axis=0), capacity, below)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ column
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, used / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        much = ratio[out]
        used = np.maximum(used - much * step, 0)
        used[out] = much
        basis[:, out] = column
        inverse = _entered(inverse, step, out)
    return basis.astype(np.int64), used


class _Fit:
    """Best fit by classes: runs of neighbouring sequences with the same room left, and pieces of one length at a time."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.rooms, self.next, self.rows = capacity, defaultdict(list), [], 0, []

    def opened(self, n: int) -> int:
        self.next += n
        return self.next - n

    def leave(self, start: int, count: int, room: int) -> None:
        if count and room:
            if not self.runs[room]:
                bisect.insort(self.rooms, room)
            self.runs[room].append((start, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """(start, count, room) of a run with the least room for length."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        start, count = self.runs[room].pop()
        if not self.runs[room]:
            self.rooms.pop(at)
        return start, count, room

    def place(self, length: int, first: int, last: int) -> None:
        """Pieces of one length, by their ranks from first to before last."""
        while first < last:
            found = self.take(length)
            if not found:
                need = -(-(last - first) // (self.capacity // length))
                found = self.opened(need), need, self.capacity
            start, count, room = found
            each = room // length
            full = min(count, (last - first) // each)
            if full:
                n = full * each
            else:
                full, n = 1, last - first
                each = n
            self.rows.append((length, first, first + n, each, start, self.capacity - room))
            self.leave(start + full, count - full, room)
            self.leave(start, full, room - each * length)
            first += n


def plan(histogram: dict[int, int], capacity: int = CAPACITY, trials: tuple[tuple[int, int], ...] = TRIALS) -> tuple[np.ndarray, int]:
    """(rows LENGTH, FIRST, LAST, EACH, SEQUENCE, OFFSET, number of sequences): where the pieces of each length go, by the trial with the fewest sequences.

    Pieces of a length with ranks from FIRST to before LAST lie EACH by EACH in sequences from SEQUENCE on, the first of them at OFFSET. Lengths are from 1 to the
    capacity. The rows are some tens for each length at most, however many pieces there are.
    """
    return min((_planned(histogram, capacity, small, groups) for small, groups in trials), key=lambda x: x[1])


def _planned(histogram: dict[int, int], capacity: int, small: int, groups: int) -> tuple[np.ndarray, int]:
    fit = _Fit(capacity)
    if n := histogram.get(capacity, 0):
        fit.rows.append((capacity, 0, n, 1, fit.opened(n), 0))
    large = sorted(((x, n) for x, n in histogram.items() if capacity // small < x < capacity and n), reverse=True)
    rest = {x: [(0, n)] for x, n in histogram.items() if 0 < x <= capacity // small and n}
    if large:
        grouped = _grouped(large, groups)
        sizes, demand = np.array([s for s, _ in grouped]), np.array([n for _, n in grouped], float)
        columns, used = _configurations(sizes, demand, capacity)
        # ranks over all large lengths, the largest first: where each length and each group begins
        begins = np.concatenate([[0], np.cumsum([n for _, n in large])])
        pointer = np.concatenate([[0], np.cumsum(demand)]).astype(np.int64)
        ends = pointer[1:].copy()
        pointer = pointer[:-1].copy()
        for j in range(len(sizes)):
            times = int(used[j] + 1e-9)
            slots = [i for i in range(len(sizes)) for _ in range(columns[i, j])]
            for i in set(slots):  # rounding may not give more than there is
                times = min(times, int(ends[i] - pointer[i]) // int(columns[i, j]))
            if times <= 0:
                continue
            start, ranges = fit.opened(times), []
            for i in slots:
                ranges.append(int(pointer[i]))
                pointer[i] += times
            # sequences whose slots hold the same lengths lie together
            cuts = {0, times}
            for a in ranges:
                lo, hi = bisect.bisect_right(begins, a), bisect.bisect_left(begins, a + times)
                cuts.update(int(x) - a for x in begins[lo:hi])
            cuts = sorted(cuts)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                at = 0
                for a in ranges:
                    x = bisect.bisect_right(begins, a + lo) - 1
                    length, first = large[x][0], a + lo - int(begins[x])
                    fit.rows.append((length, first, first + hi - lo, 1, start + lo, at))
                    at += length
                fit.leave(start + lo, hi - lo, capacity - at)
        for a, b in zip(pointer, ends, strict=True):
            while a < b:
                x = bisect.bisect_right(begins, a) - 1
                last = min(int(b), int(begins[x + 1]))
                rest.setdefault(large[x][0], []).append((int(a - begins[x]), int(last - begins[x])))
                a = last
    for length in sorted(rest, reverse=True):
        for first, last in rest[length]:
            fit.place(length, first, last)
    rows = np.array(sorted(fit.rows), np.int64).reshape(-1, 6)
    return rows, fit.next


def _placed(rows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        begin = {int(x): i for i, x in reversed(list(enumerate(table[:, LENGTH])))}
        end = {int(x): i + 1 for i, x in enumerate(table[:, LENGTH])}
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own, lo, hi = length == x, begin[int(x)], end[int(x)]
                row[own] = lo + np.searchsorted(table[lo:hi, FIRST], rank[own], side="right") - 1
            found = table[row]
            nth = rank - found[:, FIRST]
            sequence, offset = found[:, SEQUENCE] + nth // found[:, EACH], found[:, OFFSET] + nth % found[:, EACH] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document's tokens lies.

    A document is the ids of its whole text by the tokenizers file at path (special strings as the library finds them), then end, unless that is None. Only documents of more than
    capacity ids are cut. Null and empty texts are the end alone. Rows are packed one by one: repeated ids and rows are documents of their own. An
    empty table gives no rows. Other columns aren't read. The tokenizer must drop white space before it splits words.

    Tokens are counted once and only (id, length, digest) kept, in the shared folder; ranks come from counts by task and length.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "packing")
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long, part long, nth long"
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(path, capacity, end), schema)
    pieces = ws.keep(pieces, "pieces")
    parts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    table, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(parts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    out = f"doc_id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(spark.sparkContext.broadcast(table)), out)
