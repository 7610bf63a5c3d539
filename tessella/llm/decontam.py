"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Workspace, bounded_batches, owns_memory

WINDOW = 13
#: Words of benchmark items in one automaton (about 130 MB in a worker). More items take more passes.
BLOCK_WORDS = 250_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(ALNUM).split()


class Automaton:
    """Word numbers of every window; each window leads to the items that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], list[int]] = {}
        for i, (_, item) in enumerate(items):
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in item)
            for at in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                own = owners.setdefault(ids[at : at + WINDOW], [])
                if not own or own[-1] != i:
                    own.append(i)
        for window, own in owners.items():
            self.machine.add_word(window, (len(window), own))
        if owners:
            self.machine.make_automaton()

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words [start, end) in order, and the names of the items found."""
        if not len(self.machine) or not text:
            return [], set()
        number = self.number.get
        found = [(end + 1 - n, end + 1, own) for end, (n, own) in self.machine.iter(tuple([number(w, 0) for w in text]))]
        return merged((a, b) for a, b, _ in found), {self.names[i] for _, _, own in found for i in own}


def merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[str, Automaton] = {}


def _scan(block, key: str, text_at: int, finish):
    """(row, runs, items) with what one block of items finds in the row's text; finish makes the last block's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("decontam", _built.clear)
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(block.value)
        auto = _built[key]
        for batch in batches:
            row = batch.column(0)
            texts = [(t or "").encode() for t in row.field(text_at).to_pylist()]
            total, runs, items = [], [], []
            for text, before, names in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = words(text)
                now, new = auto.scan(ws)
                if before:
                    now = merged([*now, *zip(before[::2], before[1::2], strict=True)])
                total.append(len(ws))
                runs.append([*chain.from_iterable(now)])
                items.append(sorted(new.union(names or ())))
            if finish is None:
                yield pa.RecordBatch.from_arrays([row, pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["row", "runs", "items"])
                continue
            hit = [sum(r[1::2]) - sum(r[::2]) for r in runs]
            bad = [h > 0 and 20 * h >= n for h, n in zip(hit, total, strict=True)]
            yield finish(row, texts, total, hit, runs, items, bad)

    return run


def _passes(docs: DataFrame, row: Column, text_at: int, benchmark: DataFrame, item_col: str, item_text: str, finish, schema) -> DataFrame:
    """docs through the automaton of each block of items, one automaton in a worker at a time."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "decontam")
    out = docs.select(row.alias("row"), F.lit(None).cast("array<int>").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    blocks = _blocks(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text).cast("binary")))
    block, k = next(blocks), 0
    while (after := next(blocks, None)) is not None:
        scan = _scan(spark.sparkContext.broadcast(block), f"{ws.root}-{k}", text_at, None)
        out = ws.keep(out.mapInArrow(scan, out.schema), f"pass-{k}")
        block, k = after, k + 1
    return out.mapInArrow(_scan(spark.sparkContext.broadcast(block), f"{ws.root}-{k}", text_at, finish), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", spans: bool = False) -> DataFrame:
    """docs' row ids with what benchmark items leave in their texts: doc_id, n_words, n_hit, n_items,
    items (sorted ids as strings), contaminated; spans adds the hit passages as original code point
    offsets [start, end, start, end, ...].

    A window is 13 consecutive words of an item, or a whole item of fewer; words inside any occurrence
    of a window are hit. A document with hits is contaminated from one hit word in twenty on. Null and empty
    texts have no words; null items and items without words have no window; an item id on several
    rows is one item, a null id counts as the empty string. One row for each row of docs. Only the named columns are read.
    """

    def finish(row, texts, total, hit, runs, items, bad):
        counts = [pa.array(c, pa.int64()) for c in (total, hit, [len(x) for x in items])]
        places = [_places(t, r) if spans and r else [] for t, r in zip(texts, runs, strict=True)]
        columns = [row.field(0), *counts, pa.array(items, pa.list_(pa.string())), pa.array(bad, pa.bool_()), pa.array(places, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", "spans"])

    row = F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, spans array<int>"
    out = _passes(docs, row, 1, benchmark, item_col, item_text, finish, schema)
    return out if spans else out.drop("spans")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, whole, that contamination() doesn't call contaminated; nothing is shuffled."""

    def finish(row, texts, total, hit, runs, items, bad):
        return pa.RecordBatch.from_arrays([row.filter(pa.array([not b for b in bad], pa.bool_()))], ["row"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    out = _passes(docs, row, docs.columns.index(text_col), benchmark, item_col, item_text, finish, docs.select(row.alias("row")).schema)
    return out.select("row.*")


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size, at least one block; the driver holds one at a time."""
    block, size, any_block = [], 0, False
    for name, text in items.toLocalIterator():
        item = words(bytes(text) if text else b"")
        block.append((name, item))
        size += len(item)
        if size >= BLOCK_WORDS:
            yield block
            block, size, any_block = [], 0, True
    if block or not any_block:
        yield block


def _places(text: bytes, runs: list[int]) -> list[int]:
    """Word runs as code point offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    return [*chain.from_iterable((at[a][0], at[b - 1][1]) for a, b in zip(runs[::2], runs[1::2], strict=True))]

