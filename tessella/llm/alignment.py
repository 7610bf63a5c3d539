"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how often two ids overlap in the whole corpus.

Overlapping tokens form a bipartite graph. Its connected components, found by union-find over arrays, are the minimal groups; their edges are the links. Texts are cut where neither tokenizer joins
what lies on both sides, so most pieces are known from before. Counts are made for units of many documents first; what a unit asks for is what it holds, so the
counts of whole documents come back over the distinct pairs of a unit.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, byte_characters, owns_memory

#: Characters and documents of a unit, and pairs in a row of its table.
UNIT_CHARS, UNIT_DOCS, PAIR_ROWS = 8 << 20, 4096, 4096
#: Pieces that a worker remembers, twice over, and the longest of them.
MEMO_PIECES, MEMO_LENGTH = 150_000, 48
#: Letters that stand for themselves in both tokenizers, and marks that may end a word.
_LETTER, _MARKS = "a-zA-ZÀ-ÖØ-öø-ÿ", string.punctuation.replace("'", "")
_SPACE = "▁"
#: Pieces that are one match of the first tokenizer's own pattern, a line feed before them aside.
_ONE = re.compile(rf"\n?(?:[{_LETTER}]+|[{re.escape(_MARKS)}]+)| [{_LETTER}]+")


class Pair:
    """Two tokenizers: ids and bytes of a piece of a text by each.

    The first is a byte-level BPE file of the tokenizers library, the second a sentencepiece model that adds a space. A piece of the second that doesn't begin with a
    space is encoded after a line feed, which joins with nothing, and that is taken away.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.model, coded = self.a.model, byte_characters()
        self.coded = {b: c for c, b in coded.items()}
        self.feed = [t.id for t in self.model.tokenize(self.coded[10])]
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(coded[c] for c in name) if all(c in coded for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # a space or line feed between two plain characters begins a piece, and so do marks after a letter before white space; where a piece of
        # the vocabulary could go on over a cut, nothing is cut there
        joined = {p[i + 1] for p in pieces for i in range(len(p) - 1) if re.match(f"[{_LETTER}]", p[i])}
        marks = "".join(c for c in _MARKS if c not in joined)
        space = any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces) or self.b.encode(" \n a", out_type=str)[:2] != [_SPACE * 2, "<0x0A>"]
        after = rf"|(?<=[{_LETTER}])(?=[{re.escape(marks)}]+(?:[ \n]|$))" if marks else ""
        self.cut = None if space else re.compile(rf"(?<=[!-~\w])(?=[ \n][!-~\w]){after}")

    def pieces(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def first(self, match: str) -> list[int]:
        """The first tokenizer's ids of one match of its pattern."""
        raw = match.replace(" ", self.coded[32]) if match.isascii() else "".join([self.coded[x] for x in match.encode()])
        return [t.id for t in self.model.tokenize(raw)]

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a: list = [None] * len(pieces)
        odd = []
        for i, p in enumerate(pieces):
            if _ONE.fullmatch(p):
                if p[0] == "\n":
                    a[i] = self.feed + self.first(p[1:])
                else:
                    a[i] = self.first(p)
            else:
                odd.append(i)
        for i, e in zip(odd, self.a.encode_batch([pieces[i] for i in odd], add_special_tokens=False), strict=True):
            a[i] = e.ids
        b = self.b.encode([p[1:] if p[0] == " " else f"\n{p}" for p in pieces], num_threads=1)
        return a, [x if p[0] == " " else x[2:] for p, x in zip(pieces, b, strict=True)]


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over edges (u, v) of n nodes, all edges at a time: roots are hooked to smaller roots and paths halved until no edge joins two. The smallest node of each node's component."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def linked(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of places of tokens whose byte ranges overlap, by their lengths in bytes; both sides cover the same bytes."""
    a_end, b_end = np.cumsum(a_lengths), np.cumsum(b_lengths)
    first = np.searchsorted(b_end, a_end - a_lengths, side="right")
    last = np.searchsorted(b_end - b_lengths, a_end, side="left")
    many = last - first
    u = np.repeat(np.arange(len(a_lengths)), many)
    return u, np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + first[u]


def aligned(pair: Pair, pieces: list[str]) -> list[tuple | None]:
    """For each piece (tokens of A, of B, groups, the groups as text, linked ids as a packed array), or None where a tokenizer gives other bytes."""
    a, b = pair.encode(pieces)
    out: list[tuple | None] = [None] * len(pieces)
    raw = [p.encode() for p in pieces]
    good = list(range(len(pieces)))
    for ids, tokens, lengths in ((a, pair.a_bytes, pair.a_lengths), (b, pair.b_bytes, pair.b_lengths)):
        sizes = np.add.reduceat(np.append(lengths[[x for y in ids for x in (*y, 0)]], 0), np.cumsum([0, *(len(y) + 1 for y in ids)])[:-1]) - lengths[0] if ids else []
        if np.array_equal(sizes, [len(x) for x in raw]) and b"".join([tokens[x] for y in ids for x in y]) == b"".join(raw):
            continue  # as long as they should be, and the same together: the same one by one
        good = [i for i in good if b"".join([tokens[x] for x in ids[i]]) == raw[i]]
    if not good:
        return out
    na, nb = np.array([len(a[i]) for i in good]), np.array([len(b[i]) for i in good])
    ia, ib = (np.array([x for i in good for x in t[i]], np.int64) for t in (a, b))
    u, v = linked(pair.a_lengths[ia], pair.b_lengths[ib])
    root = components(u, v + len(ia), len(ia) + len(ib))
    # pieces share no bytes, so groups and links lie in the order of pieces; a group's smallest node is its first token of A
    heads = root[: len(ia)] == np.arange(len(ia))
    groups, b_group = np.cumsum(heads) - 1, (np.cumsum(heads) - 1)[root[len(ia) :]]
    packed = (ia[u] << 32 | ib[v]).astype("<i8")
    a_at, b_at = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
    links = np.searchsorted(u, a_at)
    a_names, b_names = list(map(str, ia.tolist())), list(map(str, ib.tolist()))
    a_cut, b_cut = np.searchsorted(groups, np.arange(groups[-1] + 2)).tolist(), np.searchsorted(b_group, np.arange(groups[-1] + 2)).tolist()
    names = [",".join(a_names[a_cut[g] : a_cut[g + 1]]) + "|" + ",".join(b_names[b_cut[g] : b_cut[g + 1]]) for g in range(int(groups[-1]) + 1)]
    first = groups[a_at[:-1]].tolist() + [len(names)]
    for k, i in enumerate(good):
        out[i] = int(na[k]), int(nb[k]), first[k + 1] - first[k], ";".join(names[first[k] : first[k + 1]]), packed[links[k] : links[k + 1]].tobytes()
    return out


class _Known:
    """Pieces and how they align; a full memo becomes the old one, and what is used comes over."""

    def __init__(self, pair: Pair):
        self.pair, self.new, self.old = pair, {}, {}

    def look_up(self, pieces: set[str]) -> dict[str, tuple | None]:
        out, unknown = {}, []
        for p in pieces:
            if p in self.new:
                out[p] = self.new[p]
            elif p in self.old:
                out[p] = self.new[p] = self.old[p]
            else:
                unknown.append(p)
        for i in range(0, len(unknown), 8192):
            part = unknown[i : i + 8192]
            for p, x in zip(part, aligned(self.pair, part), strict=True):
                out[p] = x
                if len(p) <= MEMO_LENGTH:
                    self.new[p] = x
        if len(self.new) >= MEMO_PIECES:
            self.old, self.new = self.new, {}
        return out


@cache
def load(a_path: str, b_path: str) -> _Known:
    return _Known(Pair(a_path, b_path))


def _squeezed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places and counts, as bytes by significance so that they compress."""
    both = np.concatenate([np.diff(at, prepend=0), n]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(both.view("u1").reshape(-1, 4).T.tobytes())


def _spread(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    both = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


_UNITS = "unit long, first int, a array<int>, b array<int>, n array<long>, doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _units(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("alignment", load.cache_clear)
        known, unit, docs, chars = load(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = [x.as_py() or "" for x in batch.column(1)]
            cut = [known.pair.pieces(f" {x}") if x else [] for x in texts]
            found = known.look_up({p for c in cut for p in c})
            for key, text, pieces in zip(batch.column(0).to_pylist(), texts, cut, strict=True):
                parts = [found[p] for p in pieces]
                if not parts or None in parts:
                    docs.append((key, 0, 0, 0, 0, "", np.array([], "<i8"), np.array([], np.int64)))
                else:
                    pairs = np.frombuffer(b"".join([x[4] for x in parts]), "<i8")
                    sha = hashlib.sha256(";".join([x[3] for x in parts]).encode()).hexdigest()
                    docs.append((key, sum(x[0] for x in parts), sum(x[1] for x in parts), sum(x[2] for x in parts), len(pairs), sha, *np.unique(pairs, return_counts=True)))
                chars += len(text)
                if chars >= UNIT_CHARS or len(docs) >= UNIT_DOCS:
                    yield from _shown(unit, docs, kind)
                    unit, docs, chars = unit + 1, [], 0
        if docs:
            yield from _shown(unit, docs, kind)

    return run


def _shown(unit: int, docs: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    pairs, place = np.unique(np.concatenate([d[6] for d in docs]), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate([d[7] for d in docs]), minlength=len(pairs)).astype(np.int64)
    names = [x.split()[0] for x in _UNITS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    firsts = range(0, len(pairs), PAIR_ROWS)
    for i in range(0, len(firsts), 16):
        some = firsts[i : i + 16]
        cut = lambda x: [x[k : k + PAIR_ROWS] for k in some]  # noqa: E731, B023
        rows = [[unit] * len(some), list(some), cut((pairs >> 32).astype(np.int32)), cut((pairs & 0xFFFFFFFF).astype(np.int32)), cut(n), *([None] * len(some) for _ in range(7))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)
    ends = np.cumsum([len(d[6]) for d in docs])
    for i in range(0, len(docs), 512):
        some = docs[i : i + 512]
        links = [_squeezed(place[e - len(d[6]) : e], d[7]) if len(d[6]) else None for d, e in zip(some, ends[i : i + 512], strict=True)]
        head = [[unit] * len(some), *([None] * len(some) for _ in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*head, *zip(*(d[:6] for d in some), strict=True), links], kinds, strict=True)], names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a unit's pairs, in order, come before those of its documents."""
    now, counts, best = None, [], []
    for batch in batches:
        unit, at, count, top = (batch.column(i).to_pylist() for i in range(4))
        keep, sums = [], []
        for i, (x, place, links) in enumerate(zip(unit, at, batch.column(9).to_pylist(), strict=True)):
            if x != now:
                now, counts, best = x, [], []
            if place is not None:
                counts.append(count[i])
                best.append(top[i])
                continue
            keep.append(i)
            if links is None:
                sums.append((0, 0))
                continue
            if isinstance(counts, list):
                counts, best = np.array(counts, np.int64), np.array(best, bool)
            places, n = _spread(links)
            sums.append((int(n[best[places]].sum()), int((counts[places] * n).sum())))
        if keep:
            own = batch.take(pa.array(keep))
            n_best, total = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(4, 9)), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), own.column(10)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _pairs(units: DataFrame) -> DataFrame:
    rows = units.where("first is not null").select("unit", "first", F.posexplode(F.arrays_zip("a", "b", "n")).alias("i", "x"))
    return rows.select("unit", (F.col("first") + F.col("i")).alias("at"), "x.a", "x.b", "x.n")


def _written(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return Workspace(docs.sparkSession, "alignment").keep(rows.mapInArrow(_units(a_path, b_path), _UNITS.format(key=key)), "units")


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n: how many links hold these two ids linked, over all documents."""
    return _pairs(_written(docs, a_path, b_path, id_col, text_col)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs.

    A's tokens are those of a space and the text, B's those of the text, whose model adds the space; special strings are plain text. Null and empty texts, and texts that either
    tokenizer gives back as other bytes, have no tokens: zeros, and an empty digest. Repeated ids and rows count as documents of their own. An empty table gives
    no rows. Other columns aren't read.

    What is written for a document is its distinct pairs, as places in its unit's table, and their numbers; the corpus-wide counts are joined to the distinct pairs of units. A unit's
    documents and pairs meet in one task, in the order of a sort.
    """
    units = _written(docs, a_path, b_path, id_col, text_col)
    pairs = _pairs(units)
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    counts = counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    asked = pairs.select("unit", "at", "a", "b").join(counts, ["a", "b"]).select("unit", "at", "count", "best")
    own = units.where("first is null").select("unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256")
    both = asked.unionByName(own, allowMissingColumns=True)
    order = both.select("unit", "at", "count", "best", "doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256").repartition("unit").sortWithinPartitions("unit", F.asc_nulls_last("at"))
    key = docs.schema[id_col].dataType.simpleString()
    return order.mapInArrow(_counted, f"doc_id {key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
