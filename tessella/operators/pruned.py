"""Every item's best neighbours, exactly, without summing every pair and without writing one.

Items with equal rows are one row: no list can hold more than the first few of them. Terms are put in classes, those first that settle most of a row's length for each posting. What
two rows can still gain from the classes that haven't been joined is at most the product of the lengths of their remainders, so a query joins classes only until that falls under its
k-th score, and of the pairs met only those whose sum can still reach it are completed. Rows lie in blocks of similar ones; the rows beside a query give it a k-th score to begin with.

Blocks of queries meet all blocks of rows in a Cartesian product without a shuffle: a task holds one block of queries with their lists so far, and the rows pass by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.vectorise import BROADCAST_TERMS
from tessella.sources.scratch import Scratch

#: Classes of terms, by the logarithm of how many postings they cost for what they settle.
CLASSES = 16
#: So many postings are met at a time, and the first round compares a query with so many of the rows beside it for each place of its list.
POSTINGS, SEEDS = 100_000, 16
#: Queries in a block: a share of all rows, within bounds. So many rows pass by at a time, and so many sums are held.
SHARE, FEWEST, MOST, ROWS, SUMS = 48, 256, 8192, 32_768, 500_000
#: Bytes of a batch on its way to a worker, set for the session; one pair of blocks may be more.
BATCH_BYTES = 4 << 20
#: Terms of one row in OPEN are looked up by place.
OPEN = 16
#: Heaviest terms by which rows are put in order.
HEAVY = 4
#: Scores are rounded to nine digits; a bound must fall short by more than that.
SLACK = 2e-9

_BLOCK = "matrix int, block long, ids binary, asked binary, copies binary, copy_ids binary, sizes binary, classes binary, keys binary, w binary"
_TYPES = {"ids": np.int64, "asked": np.bool_, "copies": np.int32, "copy_ids": np.int64, "sizes": np.int32, "classes": np.int8, "keys": np.int64, "w": np.float64}
_FOUND = "matrix int, row_id long, items array<struct<item_id:long,score:double,shared:long>>, summed long, completed long"


@dataclass
class Lists:
    """packed: (by, query_id, items), a list in one row, best first; rows: (by, query_id, rank, item_id, score, shared), the same place by place. sums: (by, query_id, summed, completed)
    of the distinct rows that were compared with others: pairs whose sums were judged, and those that were looked at in full."""

    packed: DataFrame
    sums: DataFrame
    by: tuple[str, ...] = ()

    @property
    def rows(self) -> DataFrame:
        return places(self.packed, self.by)

    def counts(self) -> dict[str, int]:
        found = self.sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("summed", "completed"))).first()
        return found.asDict()


def places(packed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packed lists as (by, query_id, rank, item_id, score, shared)."""
    rows = packed.select(*by, "query_id", F.posexplode("items").alias("_at", "x"))
    return rows.select(*by, "query_id", (F.col("_at") + 1).cast("long").alias("rank"), "x.item_id", "x.score", "x.shared")


def _rows(weights: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(matrix, item_id, cells, near, same): a row for each item, its cells with numbers in place of terms, its heaviest terms, and a digest that equal rows share."""
    terms = weights.groupBy("matrix", "field", "term").agg(F.count("*").alias("df"), F.avg(F.col("w") * F.col("w")).alias("_settled"))
    terms = scratch.keep(terms.select("matrix", "field", "term", "df", F.log(F.col("df") / F.col("_settled")).alias("cost"), F.monotonically_increasing_id().alias("key")), f"{tag}-terms")
    bounds = terms.groupBy("matrix").agg(F.min("cost").alias("_least"), F.max("cost").alias("_most"))  # a row for each matrix
    place = F.coalesce(F.try_divide(F.col("cost") - F.col("_least"), F.col("_most") - F.col("_least")), F.lit(0.0)) * CLASSES
    few = terms.count() <= BROADCAST_TERMS
    terms = terms.join(F.broadcast(bounds), "matrix").select("matrix", "field", "term", "df", "key", F.least(F.floor(place), F.lit(CLASSES - 1)).cast("int").alias("class"))
    cells = weights.join(F.broadcast(terms) if few else terms, ["matrix", "field", "term"]).groupBy("matrix", "item_id")
    cells = cells.agg(F.sort_array(F.collect_list(F.struct("class", "key", "w", "df"))).alias("cells"))  # an item's own terms
    heavy = F.sort_array(F.transform("cells", lambda c: F.struct((-F.rint(c["w"] * 1e6)).alias("w"), c["df"].alias("df"), c["key"].alias("key"))))
    # cells to twelve digits, in the order of classes and keys
    same = F.unhex(F.sha2(F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["key"], F.rint(c["w"] * 1e12).cast("long"))), ","), 256))
    plain = F.transform("cells", lambda c: F.struct(c["class"].alias("class"), c["key"].alias("key"), c["w"].alias("w")))
    rows = cells.select("matrix", "item_id", plain.alias("cells"), F.transform(F.slice(heavy, 1, HEAVY), lambda c: c["key"]).alias("near"), same.alias("same"))
    return scratch.keep(rows, f"{tag}-rows")


def _members(rows: DataFrame) -> DataFrame:
    """(matrix, row_id, item_id), row_id the smallest item with an equal row."""
    rows = rows.select("matrix", "item_id", "same")
    first = rows.groupBy("matrix", "same").agg(F.min("item_id").alias("row_id"))
    return rows.join(first, ["matrix", "same"]).select("matrix", "row_id", "item_id")


def _blocks(rows: DataFrame, members: DataFrame, asking: DataFrame | None, k: int, size: int, scratch: Scratch, tag: str) -> DataFrame:
    """Distinct rows in their order, size of them in a block. copies are the first k + 1 items that have a row."""
    nth = F.row_number().over(Window.partitionBy("matrix", "row_id").orderBy("item_id"))
    few = members.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).groupBy("matrix", "row_id").agg(F.sort_array(F.collect_list("item_id")).alias("copies"))
    rows = rows.join(few.withColumnRenamed("row_id", "item_id"), ["matrix", "item_id"])
    asked = F.lit(True)
    if asking is not None:
        rows = rows.join(asking.select("matrix", F.col("row_id").alias("item_id"), F.lit(True).alias("_asked")).distinct(), ["matrix", "item_id"], "left")
        asked = F.col("_asked").isNotNull()
    rows = rows.select("matrix", "item_id", asked.alias("asked"), "copies", "cells", "near").repartitionByRange("matrix", "near", "item_id").sortWithinPartitions("matrix", "near", "item_id")
    rows = scratch.keep(rows.drop("near").withColumn("at", F.monotonically_increasing_id()), f"{tag}-order")
    blocks = rows.groupBy("matrix", F.floor(F.col("at") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "item_id", "asked", "copies", "cells"))).alias("rows"))
    blocks = scratch.keep(blocks.mapInArrow(_packed, _BLOCK), f"{tag}-blocks", ("matrix",))  # each task reads its matrix alone
    for name in ("terms", "rows", "order"):
        scratch.drop(f"{tag}-{name}")
    return blocks


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's arrays as bytes, so that they pass between processes as they are."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            rows = batch.column("rows")[i].values
            copies, cells = rows.field("copies"), rows.field("cells")
            parts = {
                "ids": rows.field("item_id"), "asked": rows.field("asked"), "copies": copies.value_lengths(), "copy_ids": copies.flatten(), "sizes": cells.value_lengths(),
                "classes": cells.flatten().field("class"), "keys": cells.flatten().field("key"), "w": cells.flatten().field("w"),
            }
            packed = {c: x.to_numpy(zero_copy_only=False).astype(_TYPES[c]).tobytes() for c, x in parts.items()}
            out.append({"matrix": batch.column("matrix")[i].as_py(), "block": batch.column("block")[i].as_py()} | packed)
        schema = pa.schema([("matrix", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in _TYPES)])
        yield pa.RecordBatch.from_pylist(out, schema)


def _block(row: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], t) for c, t in _TYPES.items()}


def _joined(blocks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([b[c] for b in blocks]) for c in _TYPES}


def _places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, which): all places of ranges, and the range that each belongs to."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(which)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths), which


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


class _Rows:
    """Some rows by term: postings in the order of (term, row), and what is left of each row after each class."""

    def __init__(self, block: dict[str, np.ndarray]):
        self.ids, self.n = block["ids"], len(block["ids"])
        self.copies, self.copy_starts, self.copy_ids = block["copies"], _starts(block["copies"]), block["copy_ids"]
        row = np.repeat(np.arange(self.n), block["sizes"])
        self.keys, term = np.unique(block["keys"], return_inverse=True)
        code = term * self.n + row
        order = np.argsort(code)
        self.codes, self.row, self.w = code[order], row[order], block["w"][order]
        self.starts = _starts(np.bincount(term, minlength=len(self.keys)))
        self.left = _left(block, row)
        self.most = self.left.max(axis=0, initial=0.0)
        # terms of many rows also lie open, a place for each row: no more of them than postings in all, times OPEN
        often = np.flatnonzero(np.diff(self.starts) * OPEN >= self.n)
        self.column = np.full(len(self.keys), -1)
        self.column[often] = np.arange(len(often))
        self.open = np.zeros(len(often) * self.n)
        column = self.column[self.codes // max(self.n, 1)]
        self.open[column[column >= 0] * self.n + self.row[column >= 0]] = self.w[column >= 0]

    def term(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for what no row holds."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def weight(self, term: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row's weight of the term, 0 where it hasn't the term or no row has (-1)."""
        column, out = np.where(term >= 0, self.column[term], -1), np.zeros(len(term))
        often = column >= 0
        out[often] = self.open[column[often] * self.n + row[often]]
        rare = np.flatnonzero(~often & (term >= 0))
        code = term[rare] * self.n + row[rare]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        out[rare] = np.where(self.codes[at] == code, self.w[at], 0.0)
        return out


def _left(block: dict[str, np.ndarray], row: np.ndarray) -> np.ndarray:
    square = np.bincount(row * CLASSES + block["classes"], block["w"] ** 2, len(block["ids"]) * CLASSES).reshape(-1, CLASSES)
    after = np.cumsum(square[:, ::-1], axis=1)[:, ::-1] - square
    after[:, -1] = 0.0
    return np.sqrt(np.maximum(after, 0.0) + (after > 0) * 1e-15)


class _Queries:
    """A block of queries and their lists so far."""

    def __init__(self, block: dict[str, np.ndarray], k: int):
        self.block, self.k = block, k
        self.n, self.starts = len(block["ids"]), _starts(block["sizes"])
        self.row = np.repeat(np.arange(self.n), block["sizes"])
        self.left = _left(block, self.row)
        self.floor = np.full(self.n, -np.inf)
        self.summed, self.completed = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        own = np.rint(np.bincount(self.row, block["w"] ** 2, self.n) * 1e9) / 1e9
        # a list begins with the items that have the query's own row
        self.of, copies = np.repeat(np.arange(self.n), block["copies"]), block["copy_ids"]
        self.found = [self.of, copies, own[self.of], block["sizes"][self.of].astype(np.int64)]
        own_lists = self.found
        width = max(SEEDS * k, 2)
        for start in range(0, self.n, width):
            near = np.arange(start, min(start + width, self.n))
            self.meet(_Rows(self._part(near)), near)
        # only the score counts: the rows beside a query pass by once more
        self.floor, self.found = np.where(self.floor > -np.inf, self.floor - SLACK, -np.inf), own_lists
        self.summed[:], self.completed[:] = 0, 0

    def _part(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        b, first, last = self.block, rows[0], rows[-1] + 1
        copies = _starts(b["copies"])
        of = {"copy_ids": slice(copies[first], copies[last])} | {c: slice(self.starts[first], self.starts[last]) for c in ("classes", "keys", "w")}
        return {c: b[c][of.get(c, slice(first, last))] for c in _TYPES}

    def meet(self, rows: _Rows, which: np.ndarray | None = None) -> None:
        """Compares queries (those that ask, or which) with rows."""
        asked = np.flatnonzero(self.block["asked"]) if which is None else which
        need = np.argmax(self.left[asked] * rows.most < self.floor[asked, None] - SLACK, axis=1)
        none = ~(self.left[asked] * rows.most < self.floor[asked, None] - SLACK).any(axis=1)
        upto = np.full(self.n, -1)
        upto[asked] = np.where(none, CLASSES - 1, need)
        done = np.bincount(self.row[self.block["classes"] <= upto[self.row]], minlength=self.n)  # cells lie in the order of their classes
        cells = np.flatnonzero(self.block["classes"] <= upto[self.row])
        terms = rows.term(self.block["keys"])
        cells = cells[terms[cells] >= 0]
        term = terms[cells]
        lengths = rows.starts[term + 1] - rows.starts[term]
        if not len(cells):
            return
        met, step = np.cumsum(lengths), max(SUMS // max(rows.n, 1), 1)
        sums, at, new = np.zeros(min(step, self.n) * rows.n), 0, []
        while at < len(cells):
            first = self.row[cells[at]]
            # whole queries, one at least
            end = max(np.searchsorted(met, (met[at - 1] if at else 0) + POSTINGS, "right"), np.searchsorted(self.row[cells], first, "right"))
            if end < len(cells) and self.row[cells[end]] == self.row[cells[end - 1]]:
                end = np.searchsorted(self.row[cells], self.row[cells[end]], "left")
            end = min(max(end, np.searchsorted(self.row[cells], first, "right")), np.searchsorted(self.row[cells], first + step, "left"))
            new.append(self._batch(rows, terms, cells[at:end], lengths[at:end], first, upto, done, sums))
            at = end
        self._keep([np.concatenate(x) for x in zip(*new)])

    def _batch(self, rows: _Rows, terms: np.ndarray, cells: np.ndarray, lengths: np.ndarray, first: int, upto: np.ndarray, done: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
        place, cell = _places(rows.starts[terms[cells]], lengths)
        query = self.row[cells]
        pair = ((query - first) * rows.n)[cell] + rows.row[place]
        np.add.at(sums, pair, rows.w[place] * self.block["w"][cells][cell])
        short = self.floor[query] - SLACK - self.left[query, upto[query]] * rows.most[upto[query]]
        # a pair that was met has a sum over 0; queries lie in their order, so each has one bound
        held = sums[: (query[-1] + 1 - first) * rows.n].reshape(-1, rows.n)
        least = np.full(len(held), np.inf)
        least[query - first] = short
        able = np.flatnonzero((held > 0) & (held >= least[:, None]))
        total = sums[able]
        held[:] = 0.0
        q, r = able // rows.n + first, able % rows.n
        other = rows.ids[r] != self.block["ids"][q]
        q, r, total = q[other], r[other], total[other]
        self.summed += np.bincount(q, minlength=self.n)
        able = total + self.left[q, upto[q]] * rows.left[r, upto[q]] >= self._raised(q, total)[q] - SLACK
        q, r, total = q[able], r[able], total[able]
        self.completed += np.bincount(q, minlength=self.n)
        more, _, of = self._shared(rows, terms, q, r, done[q])
        score = np.rint((total + np.bincount(of, more, len(q))) * 1e9) / 1e9
        good = score >= self._raised(q, score)[q]
        q, r, score = q[good], r[good], score[good]
        _, n, _ = self._shared(rows, terms, q, r, np.zeros(len(q), int))
        copy, of = _places(rows.copy_starts[r], rows.copies[r])
        return [q[of], rows.copy_ids[copy], score[of], n[of]]

    def _raised(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Floors that stand once these pairs, in the order of their queries, have at least these scores: a row has one item or more, so k + 1 rows fill a list."""
        floor = self.floor.copy()
        ends = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) + 1 if len(q) else np.zeros(0, int)
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            if end - start > self.k:
                floor[q[start]] = max(floor[q[start]], np.partition(score[start:end], end - start - self.k - 1)[end - start - self.k - 1])
        return floor

    def _shared(self, rows: _Rows, terms: np.ndarray, q: np.ndarray, r: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(products of terms that pairs share, without the first cells of a query, how many each pair has, the pair of each)."""
        cell, of = _places(self.starts[q] + skip, self.block["sizes"][q] - skip)
        theirs = rows.weight(terms[cell], r[of])
        kept = theirs != 0
        return theirs[kept] * self.block["w"][cell[kept]], np.bincount(of[kept], minlength=len(q)), of[kept]

    def _keep(self, new: list[np.ndarray]) -> None:
        query, item, score, shared = (np.concatenate(x) for x in zip(self.found, new))
        order = np.lexsort((item, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place <= self.k], query[place <= self.k], place[place <= self.k]
        self.found = [query, item[order], score[order], shared[order]]
        last = place == self.k
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[order][last])

    def result(self, matrix: int) -> pa.RecordBatch:
        self._keep([x[:0] for x in self.found])
        asked = np.flatnonzero(self.block["asked"])
        kept = self.block["asked"][self.found[0]]
        query, item, score, shared = (x[kept] for x in self.found)
        items = pa.StructArray.from_arrays([pa.array(item), pa.array(score), pa.array(shared)], ["item_id", "score", "shared"])
        starts = _starts(np.bincount(query, minlength=self.n)[asked]).astype(np.int32)
        arrays = [pa.array(np.full(len(asked), matrix, np.int32)), pa.array(self.block["ids"][asked]), pa.ListArray.from_arrays(pa.array(starts), items), pa.array(self.summed[asked]), pa.array(self.completed[asked])]
        return pa.RecordBatch.from_arrays(arrays, ["matrix", "row_id", "items", "summed", "completed"])


def _met(k: int):
    """Of pairs of blocks, the rows passing by the queries: each query's first k + 1 items."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, waiting, last, matrix = {}, [], None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block, matrix = row["block"].as_py(), row["matrix"].as_py()
                if block != last:  # every query of this task has met the rows that wait
                    if sum(len(b["ids"]) for b in waiting) >= ROWS:
                        rows, waiting = _Rows(_joined(waiting)), []
                        for q in queries.values():
                            q.meet(rows)
                    waiting.append(_block({c: row[c].as_py() for c in _TYPES}))
                    last = block
                asking = row["q_block"].as_py()
                if asking not in queries:
                    queries[asking] = _Queries(_block({c: row[f"q_{c}"].as_py() for c in _TYPES}), k)
        if queries:
            rows = _Rows(_joined(waiting))
            for q in queries.values():
                q.meet(rows)
                yield q.result(matrix)

    return meet


def best(weights: DataFrame, k: int, queries: DataFrame | None = None, by: tuple[str, ...] = (), scratch: Scratch | None = None) -> Lists:
    """The first k of each query, as top_k over scores gives them: other items that share a term, best score first, ties to the smaller id.

    weights (by, item_id, field, term, w) has rows of length one; queries (query_id) restricts who asks. Tables go to scratch, which is the caller's to delete.
    """
    if k < 1:
        raise ValueError(f"a list needs room for one result, not {k}")
    spark = weights.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    scratch = scratch or Scratch(spark, "pruned")
    tag = f"pruned-{scratch.count()}"
    if by:
        names = scratch.keep(weights.select(*by).distinct().withColumn("matrix", F.row_number().over(Window.orderBy(*by))), f"{tag}-names")  # a row for each matrix
        weights = weights.join(F.broadcast(names), list(by))
        matrices = [r["matrix"] for r in names.collect()]
    else:
        names, matrices, weights = spark.range(1).select(F.lit(1).alias("matrix")), [1], weights.withColumn("matrix", F.lit(1))
    rows = _rows(weights.select("matrix", "item_id", "field", "term", "w"), scratch, tag)
    members = scratch.keep(_members(rows), f"{tag}-members")
    asking = members if queries is None else members.join(queries.select(F.col("query_id").alias("item_id")).distinct(), "item_id", "left_semi")
    distinct = rows.drop("same").join(members.where("row_id = item_id").select("matrix", "item_id"), ["matrix", "item_id"], "left_semi")
    size = min(max(members.where("row_id = item_id").count() // len(matrices or [1]) // SHARE, FEWEST), MOST)
    blocks = _blocks(distinct, members, None if queries is None else asking, k, size, scratch, tag)
    found = scratch.keep(_found(blocks, matrices, k), f"{tag}-found")
    lists = found.join(asking.withColumnRenamed("item_id", "query_id"), ["matrix", "row_id"]).join(F.broadcast(names), "matrix")
    others = F.slice(F.filter("items", lambda x: x["item_id"] != F.col("query_id")), 1, k)
    sums = found.where("summed > 0").join(F.broadcast(names), "matrix").select(*by, F.col("row_id").alias("query_id"), "summed", "completed")
    return Lists(lists.select(*by, "query_id", others.alias("items")), sums, by)


def _found(blocks: DataFrame, matrices: list[int], k: int) -> DataFrame:
    """(matrix, row_id, items, summed, completed): one Cartesian product for each matrix."""
    asked = blocks.select("matrix", *(F.col(c).alias(f"q_{c}") for c in ("block", *_TYPES)))
    counts = {r["matrix"]: r["n"] for r in blocks.groupBy("matrix").agg(F.count("*").alias("n")).collect()}  # a row for each matrix
    parts = []
    for m in matrices:
        passing = blocks.where(F.col("matrix") == m).coalesce(1).hint("shuffle_replicate_nl")  # read by each task, block by block
        held = asked.where(F.col("matrix") == m).drop("matrix").repartitionByRange(counts.get(m, 1), "q_block")
        parts.append(passing.crossJoin(held).mapInArrow(_met(k), _FOUND))
    return reduce(DataFrame.unionByName, parts, blocks.sparkSession.createDataFrame([], _FOUND))
