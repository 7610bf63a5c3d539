"""Nearest neighbours by inner product over additively quantised vectors.

Full-dimensional residual codebooks are fitted on a bounded sample: the first one, of up to CELLS words, deals the
vectors into cells, the others refine what it leaves. Every row is encoded by beam search and stored with the norm of what
its codes leave. Cells that lie together form shards of bounded size; a cell that is larger is split over several. A query goes
to the shards that hold its nearest cells, as many as the sample's true neighbours ask for. A task holds one
shard's rows and streams its queries past them: it scores rows by lookup tables, takes a first few for a bound, and reranks
exactly every row whose score may pass it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

BOOKS, WORDS, BEAM = 8, 256, 2
#: Words of the first codebook: the root of the number of rows, but CELLS at most.
CELLS = 4_096
#: Rows that the codebooks are fitted on, chosen by a hash of their id: SAMPLE_ROWS, or SAMPLE_PER_CELL for each
#: cell where that is more, but SAMPLE_VALUES components at most.
SAMPLE_ROWS, SAMPLE_PER_CELL, SAMPLE_VALUES = 8_192, 32, 8_388_608
ITERATIONS = 8
#: Share of the sample's true neighbours that the probed cells must hold.
REACH = 0.98
#: Sampled queries that this share is measured with.
TRIALS = 512
#: A row's true score passes the scored one by SLACK / sqrt(dimensions) times both norms in fewer than one case in
#: a hundred; in few dimensions the whole norms bound it.
SLACK = 2.56
#: What single precision may add to an error, in units of the scaled vectors.
ROUNDING = 1e-5
#: Scaled vectors with a component beyond this aren't quantised, but compared with every query.
HUGE = 1e6
#: Rows of a shard, and their components, at most. Where there is room for all cores, a shard has SMALL_ROWS at least: a task of its own
#: isn't worth fewer, and a bound over more rows is a better one.
SHARD_ROWS, SHARD_VALUES, LEAST_SHARDS, SMALL_ROWS = 65_536, 4_194_304, 12, 8_192


@dataclass
class Index:
    """What every task needs to know. All of it is bounded by CELLS, BOOKS, WORDS and the dimensions."""

    scale: float
    cells: np.ndarray
    books: np.ndarray
    probes: int = 1
    first: np.ndarray | None = None
    parts: np.ndarray | None = None
    size: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    @property
    def odd(self) -> int:
        """The cell of rows that aren't quantised."""
        return len(self.cells)

    def nearest_cells(self, queries: np.ndarray) -> np.ndarray:
        """(queries, probes) cells of the largest inner products with their words."""
        if self.probes >= len(self.cells):
            return np.broadcast_to(np.arange(len(self.cells)), (len(queries), len(self.cells)))
        score = queries.astype(np.float32) @ self.cells.T
        return np.argpartition(-score, self.probes - 1, axis=1)[:, : self.probes]


def _closest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out, size = np.empty(len(x), np.int64), (words * words).sum(axis=1)
    for k in range(0, len(x), 4_096):
        out[k : k + 4_096] = (size - 2 * x[k : k + 4_096] @ words.T).argmin(axis=1)
    return out


def _means(x: np.ndarray, n: int, r: np.random.Generator) -> np.ndarray:
    """n words by k-means from random rows; words that lose all rows stay where they were."""
    words = x[r.permutation(len(x))[:n]]
    words = np.vstack([words, np.zeros((n - len(words), x.shape[1]), np.float32)])
    for _ in range(ITERATIONS):
        at = _closest(x, words)
        order = np.argsort(at, kind="stable")
        found, start = np.unique(at[order], return_index=True)
        words = words.copy()
        words[found] = np.add.reduceat(x[order], start, axis=0) / np.diff([*start, len(x)])[:, None]
    return words


def fit(sample: np.ndarray, cells: int, k: int, seed: int = 5) -> Index:
    """Codebooks of a sample (rows, dimensions) in double precision, and how many cells its neighbours lie in."""
    largest = np.abs(sample).max(axis=1)
    scale = 2.0 ** np.clip(-np.floor(np.log2(np.median(largest))), -1_000, 1_000)
    x = (sample[largest <= HUGE / scale] * scale).astype(np.float32)
    r = np.random.default_rng(seed)
    words = _means(x, max(1, min(cells, len(x))), r)
    at = _closest(x, words)
    index = Index(scale, words, np.zeros((BOOKS, WORDS, x.shape[1]), np.float32))
    index.probes = _probes(x, at, words, k)
    few = r.permutation(len(x))[:SAMPLE_ROWS]
    rest = x[few] - words[at[few]]
    for m in range(BOOKS):
        index.books[m] = _means(rest, WORDS, r)
        rest = rest - index.books[m][_closest(rest, index.books[m])]
    return index


def _probes(x: np.ndarray, at: np.ndarray, words: np.ndarray, k: int) -> int:
    """How many cells hold REACH of the k nearest rows of sampled queries. Among all rows neighbours are nearer than in a
    sample, so fewer cells would do."""
    if len(x) <= k + 1 or len(words) == 1:
        return len(words)
    asked = x[:TRIALS]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ words.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(words))[None, :], axis=1)
    places = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
    return int(places[math.ceil(REACH * len(places)) - 1]) + 1


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, codes uint8 (rows, BOOKS), norms of the remainders) of scaled rows, the best of BEAM partial codes at every book."""
    n, dim = x.shape
    cell = _closest(x, index.cells)
    rest, codes = (x - index.cells[cell])[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for words in index.books:
        beams = rest.shape[1]
        cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, dim) @ words.T).reshape(n, beams, -1) + (words * words).sum(axis=1)
        flat = cost.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        beam, word, rows = best // len(words), best % len(words), np.arange(n)[:, None]
        rest = rest[rows, beam] - words[word]
        codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)
    cost = (rest * rest).sum(axis=2)
    best = cost.argmin(axis=1)
    return cell, codes[np.arange(n), best], np.sqrt(cost[np.arange(n), best])


def nearest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in order."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _resized(v: np.ndarray, dim: int) -> np.ndarray:
    return v[:dim] if len(v) >= dim else np.concatenate([v, np.zeros(dim - len(v))])


def _length(v: np.ndarray) -> float:
    """Euclidean length without overflow on the way."""
    top = np.abs(v).max(initial=0.0)
    return top * math.sqrt(((v / top) ** 2).sum()) if top > 0 else 0.0


class Shard:
    """The rows of one shard, ready for queries."""

    def __init__(self, index: Index, ids: np.ndarray, vectors: list[np.ndarray], cells: np.ndarray, codes: list[bytes], left: np.ndarray):
        self.index = index
        plain = np.flatnonzero(cells != index.odd)
        plain = plain[np.argsort(cells[plain], kind="stable")]
        self.ids = ids[plain]
        self.x = np.array([vectors[i] for i in plain], np.float64).reshape(len(plain), index.dim)
        self.near = (self.x * index.scale).astype(np.float32)
        self.cells, self.left = cells[plain].astype(np.intp), left[plain].astype(np.float64)
        self.codes = np.frombuffer(b"".join(codes[i] for i in plain), np.uint8).reshape(len(plain), BOOKS).astype(np.intp).T.copy()
        found, start = np.unique(self.cells, return_index=True)
        ends = [*start, len(plain)][1:]
        self.span = {int(c): (int(a), int(b)) for c, a, b in zip(found, start, ends, strict=False)}
        odd = np.flatnonzero(cells == index.odd)
        self.odd_ids, self.odd = ids[odd], [vectors[i] for i in odd]
        self.flat = index.books.reshape(-1, index.dim).T

    def search(self, owners: list[int], queries: list[np.ndarray], probed: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, exact scores) of the k nearest rows among its probed cells and the odd rows."""
        index = self.index
        for start in range(0, len(queries), 256):
            some = queries[start : start + 256]
            full = np.array([_resized(q, index.dim) for q in some])
            units = np.array([q / (_length(q) or 1.0) for q in full])
            single = units.astype(np.float32)
            tables = (single @ self.flat).reshape(len(some), len(index.books), -1)
            base = single @ index.cells.T
            for j, q in enumerate(some):
                own = owners[start + j]
                rows, true = self._plain(own, full[j], units[j], tables[j], base[j], probed[start + j], k)
                ids = self.ids[rows]
                if self.odd:
                    other = np.flatnonzero(self.odd_ids != own)
                    ids = np.concatenate([ids, self.odd_ids[other]])
                    true = np.concatenate([true, [(self.odd[i][: len(q)] * q[: len(self.odd[i])]).sum() for i in other]])
                best = nearest(true, ids, k)
                yield ids[best], true[best]

    def _plain(self, own: int, q: np.ndarray, unit: np.ndarray, tables: np.ndarray, base: np.ndarray, probed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the quantised rows that may be among the k nearest."""
        spans = [self.span[c] for c in probed.tolist() if c in self.span]
        n = sum(b - a for a, b in spans)
        if 2 * n > len(self.ids):  # most rows: all are scored where they lie, those of other cells as nothing
            rows, apart = None, np.full(len(base), -np.inf, np.float32)
            apart[probed[probed < len(base)]] = base[probed[probed < len(base)]]
            score, columns, left, ids = apart[self.cells], self.codes, self.left, self.ids
        else:
            rows = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.intp)
            score, columns, left, ids = base[self.cells[rows]], self.codes[:, rows], self.left[rows], self.ids[rows]
        few = max(64, 4 * k)
        if n > few:
            for m, column in enumerate(columns):
                score += tables[m].take(column)
            score[ids == own] = -np.inf
            first = np.argpartition(score, len(score) - few)[-few:]
            first = first[score[first] > -np.inf]
            near = ((self.x[first if rows is None else rows[first]] * self.index.scale) * unit).sum(axis=1)
            bound = np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else -np.inf
            slack = min(1.0, SLACK / math.sqrt(self.index.dim))
            good = (score >= bound - slack * left - ROUNDING) & (score > -np.inf)
            good[first] = True
            at = np.flatnonzero(good) if rows is None else rows[good]
            # in single precision first, which leaves few more than k for the exact scores
            at = at[self.near[at] @ unit.astype(np.float32) >= bound - ROUNDING * max(1.0, abs(bound))]
        else:
            good = (score > -np.inf) & (ids != own)
            at = np.flatnonzero(good) if rows is None else rows[good]
        return at, (self.x[at] * q).sum(axis=1)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Each list as an array of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


#: Rows and queries of shards in one table: kind 0 are rows, kind 1 queries, whose codes are the cells to look in.
_DEALT = "shard int, kind int, vec_id long, embedding {kind}, cell int, codes binary, left_norm double"


def _index(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2_048):
                batch = whole.slice(k, 2_048)
                vectors = _lists(batch.column(1))
                cells, left, codes = np.full(len(vectors), index.odd, np.int32), np.full(len(vectors), np.inf), [b""] * len(vectors)
                plain = [i for i, v in enumerate(vectors) if len(v) == index.dim and np.abs(v).max() <= HUGE / index.scale]
                if plain:
                    cell, code, rest = encode(np.array([vectors[i] * index.scale for i in plain]).astype(np.float32), index)
                    cells[plain], left[plain] = cell, rest
                    for i, c in zip(plain, code, strict=True):
                        codes[i] = c.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells), pa.array(codes, pa.binary()), pa.array(left)], ["vec_id", "embedding", "cell", "codes", "left_norm"])

    return run


def _deal(held, every: int):
    """Rows to their shard, and those that are queries to every shard that holds one of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        names = ["shard", "kind", "vec_id", "embedding", "cell", "codes", "left_norm"]
        for batch in batches:
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            shard = index.first[cells] + (mix(ids) % index.parts[cells].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), *(batch.column(i) for i in range(5))], names)
            asked = np.flatnonzero(ids % every == 0)
            if not len(asked):
                continue
            vectors = _lists(batch.column(1).take(pa.array(asked)))
            units = np.array([_resized(v / (_length(v) or 1.0), index.dim) for v in vectors])
            to, who, what = [], [], []
            for place, near in zip(asked.tolist(), index.nearest_cells(units), strict=True):
                looked: dict[int, list[int]] = {}
                for c in [*near.tolist(), index.odd]:
                    if index.size[c]:
                        for s in range(index.first[c], index.first[c] + index.parts[c]):
                            looked.setdefault(s, []).append(c)
                for s, found in looked.items():
                    to.append(s), who.append(place), what.append(np.array(found, np.int32).tobytes())
            for k in range(0, len(to), 2_048):
                n, take = len(to[k : k + 2_048]), pa.array(who[k : k + 2_048])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[k : k + 2_048], pa.int32()), pa.array([1] * n, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.nulls(n, pa.int32()), pa.array(what[k : k + 2_048], pa.binary()), pa.nulls(n, pa.float64())], names
                )

    return run


def mix(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _search(held, k: int):
    """Over one partition sorted by shard and kind: the rows of a shard are held, its queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, rows, shard = held.value, None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if numbers[a] != at:
                    at, rows, shard = numbers[a], [], None
                part = batch.slice(a, b - a)
                n = int((part.column(1).to_numpy() == 0).sum())
                if n:
                    rows.append(part.slice(0, n))
                if n == part.num_rows:
                    continue
                if shard is None:
                    shard, rows = _shard(index, rows), []
                asked = part.slice(n)
                owner, ids, scores = [], [], []
                owners, probed = asked.column(2).to_pylist(), [np.frombuffer(c, np.int32) for c in asked.column(5).to_pylist()]
                for own, (found, score) in zip(owners, shard.search(owners, _lists(asked.column(3)), probed, k), strict=True):
                    owner.append(np.full(len(found), own, np.int64)), ids.append(found), scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return run


def _shard(index: Index, rows: list[pa.RecordBatch]) -> Shard:
    if not rows:
        return Shard(index, np.zeros(0, np.int64), [], np.zeros(0, np.int32), [], np.zeros(0))
    table = pa.Table.from_batches(rows).combine_chunks()
    column = lambda name: table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)
    return Shard(index, column("vec_id").to_numpy(), _lists(column("embedding")), column("cell").to_numpy(), column("codes").to_pylist(), column("left_norm").to_numpy())


def neighbouring(words: np.ndarray) -> list[int]:
    """The words in an order that keeps near ones together: halves along the direction of most spread, and so on."""
    done, todo = [], [np.arange(len(words))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            done += at.tolist()
            continue
        x = words[at] - words[at].mean(axis=0)
        axis = x[np.abs(x).sum(axis=1).argmax()]
        for _ in range(8):
            axis = x.T @ (x @ axis)
            axis = axis / (np.linalg.norm(axis) or 1.0)
        order = at[np.argsort(x @ axis, kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


def _deal_out(index: Index, sizes: dict[int, int]) -> int:
    """Fills in each cell's first shard and how many it is split over; returns the number of shards."""
    n = sum(sizes.values())
    room = max(1, min(SHARD_ROWS, SHARD_VALUES // max(index.dim, 1), max(SMALL_ROWS, math.ceil(n / LEAST_SHARDS))))
    index.first, index.parts = np.zeros(index.odd + 1, np.int64), np.ones(index.odd + 1, np.int64)
    index.size = np.array([sizes.get(c, 0) for c in range(index.odd + 1)])
    shard, filled = 0, 0
    for c in [*neighbouring(index.cells), index.odd]:
        size = sizes.get(c, 0)
        if filled and filled + size > room:
            shard, filled = shard + 1, 0
        index.first[c], index.parts[c] = shard, max(1, math.ceil(size / room))
        if size > room:
            shard, filled = shard + int(index.parts[c]), 0
        else:
            filled += size
    return shard + 1


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k nearest other rows found, ties to the smaller id.

    Queries are the rows whose id is divisible by every. Nearness is the largest inner product; scores are exact, in double precision. A row
    with a null id, or a vector that is null, empty, zero, or has null or non-finite components, takes no part. Of two vectors
    of different lengths the shorter one counts as continued by zeros. Rows that share an id count once, with their
    least vector. Fewer candidates than k give them all, unless cells were left out; an empty table gives no rows.
    """
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    sound = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("embedding")).where(sound)
    n = rows.count()
    files = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS))
    # dealt by id once; the aggregate finds its rows together already
    rows = ws.keep(rows.repartition(files, "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "rows")
    sample = _sample(rows, n, cells := max(1, min(CELLS, math.isqrt(n))))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(sample, cells, k)

    held = spark.sparkContext.broadcast(index)
    coded = ws.keep(rows.mapInArrow(_index(held), f"vec_id long, embedding {kind}, cell int, codes binary, left_norm double"), "index")
    ws.drop("rows")
    shards = _deal_out(index, {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()})  # CELLS + 1 rows at most
    held = spark.sparkContext.broadcast(index)
    dealt = coded.mapInArrow(_deal(held, every), _DEALT.format(kind=kind))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    found = ws.keep(dealt.mapInArrow(_search(held, k), "query_id long, vec_id long, score double"), "found")
    ws.only("found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows from each shard at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """The bounded sample, in double precision: rows of the commonest length of those that come first by a hash."""
    want = max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    # so that no task sorts more than it must: a quarter more than wanted pass, then the first are taken
    few = rows.where(draw < math.ceil((1 << 30) * min(1.0, 1.25 * want / max(n, 1))))
    sizes = few.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return np.zeros((0, 1))
    dim = sizes["dim"]
    few = few.where(F.size("embedding") == dim).orderBy(draw, "vec_id").limit(max(1, min(want, SAMPLE_VALUES // dim)))
    column = few.select("embedding").toArrow().column(0).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
