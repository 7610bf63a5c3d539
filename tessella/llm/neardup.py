"""Near-duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. One scan of the texts gives each document the size and a 128-bit fingerprint of its shingle set, one
   byte of each MinHash and a 64-bit key for each band.
2. Equal sets become one class, stood for by its smallest id.
3. In each band, members of a bucket meet one member, the head, chosen by the band's key, so that a
   large group of copies gets as many edges as it has members and not their square.
4. A pair's signature bytes are compared batch by batch; a pair whose posterior probability of reaching
   the threshold falls under the chosen miss probability goes.
5. Each member first has its few most similar heads verified on full sets, then those other heads that lie
   in another component. Documents whose buckets still hold several components are then compared across
   components, all of them: candidates share a shingle early enough in rarity order, and are of like size, which loses no
   link; crowded shingles are dealt over several tasks. They go through the same pruning, and all survivors are verified. Pairs already connected need
   no verdict: it can't change any component. Later links join whole components, so each step only sees the few links that are new.

Inside, every row has a number of its own. Where ids are unique they are the numbers; else rows are numbered once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, Workspace, bounded_batches, mix64, owns_memory
from .components import connected_components

BANDS, ROWS = 40, 5
BATCHES = (32, 64, 128, 200)
MISS = 1e-6
#: Heads of a member that are verified before components are looked at.
FIRST_HEADS = 4
#: Bits of the filters that keep rows which can't matter out of a shuffle: 1 MB, at any input size.
FILTER_BITS = 1 << 23
#: Members of a shingle's bucket in one task; a larger bucket is dealt over several.
CROWD = 1_000

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1 << 20, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_hashes = WordHashes()


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text.

    Words are what white space (space, tab to carriage return) leaves after A-Z were lower-cased. Fewer
    than k words give one shingle, none give the empty set.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= _STEP
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - k + 1 + i]
    out += np.uint64(k)
    return np.unique(mix64(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHashes (uint32) of a shingle set that isn't empty."""
    low = shingles.astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (low[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One int64 key for each band, different from band to band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND.copy()
    for i in range(ROWS):
        key = mix64((key ^ rows[:, i]) * _STEP)
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, fp_hi long, fp_lo long, bytes binary, bands array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("neardup", _hashes.clear)
        for batch in batches:
            n, hi, lo, low, keys = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                if not len(s):
                    hi.append(None), lo.append(None), low.append(None), keys.append(None)
                    continue
                fp = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                sig = signature(s)
                hi.append(int(fp[0])), lo.append(int(fp[1]))
                low.append(sig.astype(np.uint8).tobytes())
                keys.append(band_keys(sig))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp_hi", "fp_lo", "bytes", "bands"],
            )

    return run


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(slots compared, fewest matches to go on) for each batch.

    With a uniform prior on the share p of equal slots, m of n matches leave Pr[p >= t] =
    Pr[Binomial(n + 1, t) <= m]. A byte of two different MinHashes is equal once in 256, which only
    raises p, so the threshold stays a lower bound.
    """
    out = []
    for n in BATCHES:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _compare(limits: list[tuple[int, int]]):
    """(a, b, left, right) -> (a, b, matches) of the pairs that no batch prunes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (2, 3))
            alive, matches, done = np.arange(n), np.zeros(n, np.int32), 0
            for slots, least in limits:
                matches[alive] += (left[alive, done:slots] == right[alive, done:slots]).sum(axis=1, dtype=np.int32)
                alive, done = alive[matches[alive] >= least], slots
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(matches[alive])], ["a", "b", "matches"])

    return run


def _flatten(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("neardup", _hashes.clear)
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            if sizes.any():
                ids = np.repeat(batch.column(0).to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["doc_id", "n", "shingle"])

    return run


def _verify(k: int, num: int, den: int):
    """(a, b, left, right) texts -> (a, b) with den * |intersection| >= num * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("neardup", _hashes.clear)
        last, kept = None, None
        for batch in batches:
            good = []
            for i, (right, left) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if right != last:
                    last, kept = right, shingle_set(right, k)
                s = shingle_set(left, k)
                both = len(np.intersect1d(s, kept, assume_unique=True))
                if both and den * both >= num * (len(s) + len(kept) - both):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return run


def _slot(c: str):
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def _marked(df: DataFrame, ids: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """df with _may: whether its doc_id may be one of ids; a filter of fixed size says so, without a shuffle of df."""
    marks = ids.select(_slot("doc_id").alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("_bits"))
    marks = ws.keep(marks, f"{name}-marks")
    rows = df.withColumn("_s", _slot("doc_id")).withColumn("_bucket", F.expr("bitmap_bucket_number(_s)")).withColumn("_bit", F.expr("bitmap_bit_position(_s)"))
    # at most FILTER_BITS / 8 bytes, whatever the input
    rows = rows.join(F.broadcast(marks), "_bucket", "left")
    may = F.expr("coalesce((cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(_bit % 8 as int)) & 1 = 1, false)")
    return rows.withColumn("_may", may).drop("_s", "_bucket", "_bit", "_bits")


def _without(df: DataFrame, ids: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The rows of df whose doc_id isn't one of ids; only those that may be are shuffled."""
    rows = _marked(df, ids, ws, name)
    clear = rows.where("not _may").drop("_may")
    return clear.unionByName(rows.where("_may").drop("_may").join(ids.select("doc_id"), "doc_id", "left_anti").select(*(f"`{c}`" for c in df.columns)))


class _Search:
    def __init__(self, texts: DataFrame, reps: DataFrame, ws: Workspace, k: int, num: int, den: int):
        self.texts, self.reps, self.ws, self.k, self.num, self.den = texts, reps, ws, k, num, den
        self.limits = least_matches(num / den)

    def pruned(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) -> (a, b, matches) after the sequential comparison."""
        sig = self.reps.select("doc_id", "bytes")
        left = sig.select(F.col("doc_id").alias("a"), F.col("bytes").alias("left"))
        right = sig.select(F.col("doc_id").alias("b"), F.col("bytes").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return self.ws.keep(both.mapInArrow(_compare(self.limits), "a long, b long, matches int"), name)

    def chosen(self, ids: DataFrame, name: str) -> DataFrame:
        """The texts of ids (doc_id), and few others."""
        return _marked(self.texts, ids, self.ws, name).where("_may").drop("_may")

    def across(self, labelled: DataFrame) -> DataFrame:
        """(a, b): pairs of these documents (doc_id, label) that may be linked and have different labels.

        With the shingles of each set in one order for all, rarest first, linked sets have a first common one early in
        both: from its places p and q on, 1 + min(n - p, m - q) shingles are all that can be common, and
        that must reach num / (num + den) of n + m. Shingles that one set alone has only push places on. Nothing is lost.
        """
        num, den = self.num, self.den
        texts = self.chosen(labelled.select("doc_id"), "across")
        flat = texts.mapInArrow(_flatten(self.k), "doc_id long, n long, shingle long").distinct()
        flat = self.ws.keep(flat.join(labelled, "doc_id"), "flat")
        known = flat.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        mine = Window.partitionBy("doc_id", "n")  # one document's shingles
        place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "shingle"))
        early = flat.join(known, "shingle").withColumn("place", place).where(f"{den} * (n - place + 1) >= {num} * n")
        # linked sets differ by a factor of den / num at most, so by one class of sizes
        size = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int") if num < den else F.col("n").cast("int")
        early = _mixed(self.ws.keep(early.select(F.col("shingle").alias("key"), "doc_id", "label", "n", "place"), "early")).withColumn("size", size)
        early = self.ws.keep(early, "mixed")
        near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)) if num < den else F.col("size")
        a = early.where("label <> main").select("key", F.col("doc_id").alias("a"), F.col("label").alias("la"), "main", F.col("n").alias("na"), F.col("place").alias("pa"), near.alias("size"))
        b = early.select("key", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("place").alias("pb"), "size")
        # a crowded bucket is dealt over several tasks, and what meets it goes to all of them
        crowds = early.groupBy("key", "size").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select("key", "size", F.ceil(F.col("_n") / CROWD).cast("int").alias("parts"))
        crowds = self.ws.keep(crowds, "crowds")
        a = a.join(crowds, ["key", "size"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        b = b.join(crowds, ["key", "size"], "left").withColumn("part", F.pmod(F.hash("b"), F.coalesce("parts", F.lit(1)))).drop("parts")
        both = a.join(b, ["key", "size", "part"]).where(f"la <> lb and (lb = main or la < lb) and {num + den} * (1 + least(na - pa, nb - pb)) >= {num} * (na + nb)")
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) -> the pairs that full sets confirm."""
        texts = self.chosen(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), name)
        member = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
        head = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
        both = pairs.select("a", "b").join(member, "a").join(head, "b").select("a", "b", "left", "right")
        return self.ws.keep(both.mapInArrow(_verify(self.k, self.num, self.den), "a long, b long").distinct(), name)


def _mixed(spread: DataFrame) -> DataFrame:
    """Rows of buckets with several labels, with main, the label that most of a bucket's members have."""
    sizes = spread.groupBy("key", "label").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("_n", "label")).alias("_m"), F.count("*").alias("_labels")).where("_labels > 1")
    return spread.drop("main").join(main.select("key", F.col("_m.label").alias("main")), "key")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs whose ends lie in different components, with their labels (la, lb)."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    return both.where("la <> lb")


def _joined(labels: DataFrame, links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """labels (node, label) once links between documents have joined components; only the components that they touch are worked on."""
    steps = _apart(links.select("a", "b"), labels).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    to = ws.keep(connected_components(steps, ws, name).select(F.col("node").alias("label"), F.col("label").alias("_to")), f"{name}-to")
    moved = labels.join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    single = to.select(F.col("label").alias("node"), F.col("_to").alias("label")).join(labels.select("node"), "node", "left_anti")
    return ws.keep(moved.unionByName(single), f"{name}-labels")


def _grouped(texts: DataFrame, ws: Workspace, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component) of texts (doc_id, text), whose ids are unique; component is the smallest id reachable."""
    signed = ws.keep(texts.mapInArrow(_sign(k), _SIGNED), "signed")
    full = signed.where("n_shingles > 0")
    classes = ws.keep(full.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("rep")), "classes")
    copies = full.select("doc_id", "fp_hi", "fp_lo").join(classes, ["fp_hi", "fp_lo"]).where("doc_id <> rep").select("doc_id")
    reps = ws.keep(_without(full.select("doc_id", "bytes", "bands"), ws.keep(copies, "copies"), ws, "copies"), "reps")

    members = reps.select("doc_id", F.explode("bands").alias("key"))
    # a head by the key's own order: flipping ids by the key's bits and back needs no further column
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("doc_id").bitwiseXOR(F.col("key"))).alias("least"))
    buckets = buckets.where("n > 1").select("key", F.col("least").bitwiseXOR(F.col("key")).alias("head"))
    crowded = ws.keep(members.join(buckets, "key"), "crowded")
    search = _Search(texts, reps, ws, k, num, den)

    star = crowded.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    star = search.pruned(star, "star")
    best = Window.partitionBy("a").orderBy(F.desc("matches"), F.xxhash64("b"), "b")  # a member has BANDS heads at most
    first = ws.keep(star.withColumn("rank", F.row_number().over(best)), "ranked")
    ws.drop("star")
    labels = connected_components(search.confirmed(first.where(f"rank <= {FIRST_HEADS}"), "first"), ws, "first-components")
    other = ws.keep(_apart(first.where(f"rank > {FIRST_HEADS}").select("a", "b"), labels).select("a", "b"), "other")
    labels = _joined(labels, search.confirmed(other, "second"), ws, "second-components")

    # what may still be linked across components
    label = labels.select(F.col("node").alias("doc_id"), "label")
    spread = crowded.select("key", "doc_id").join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    apart = _mixed(ws.keep(spread, "spread")).select("doc_id", "label").distinct()
    rest = search.across(ws.keep(apart, "apart"))
    labels = _joined(labels, search.confirmed(search.pruned(rest, "rest"), "more"), ws, "components")

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp_hi", "fp_lo", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "fp_hi", "fp_lo").join(named, ["fp_hi", "fp_lo"], "left")
    out = ws.keep(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")), "grouped")
    ws.only("grouped", "keyed")
    return out


def _plain_ids(ids: DataFrame) -> bool:
    """Whether ids (doc_id) are whole numbers, none null and none on two rows."""
    if ids.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return False
    return ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate components of whole texts.

    Two documents are linked if den * |intersection| >= num * |union| of their k-word shingle sets; links
    are confirmed on full sets. component_id is the smallest id reachable and kept says whether a
    document's id is that one. Rows come out as they went in, one each: an empty or null text has no shingles
    and is alone; rows that share an id are each placed by their own text; a row whose id is null is linked with
    nothing, its component_id is null and it is kept. Ids may be of any type that has an order. Other columns of docs, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "neardup")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if _plain_ids(texts.select("doc_id")):
        found = _grouped(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ws, k, num, den)
        found = found.select(F.col("doc_id").cast(texts.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", F.col("component").cast(texts.schema["doc_id"].dataType).alias("component_id"))
        return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    # numbered once and for all: a written table says the same to every task and after every loss
    keyed = ws.keep(texts.withColumn("row", F.monotonically_increasing_id()), "keyed")
    found = _grouped(keyed.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), ws, k, num, den)
    found = found.withColumnRenamed("doc_id", "row").join(keyed.select("row", "doc_id"), "row")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = found.join(least, "component").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    bare = keyed.where("doc_id is null").select(F.col("row").alias("doc_id"), "text").mapInArrow(_sign(k), _SIGNED)
    nothing = F.lit(None).cast(texts.schema["doc_id"].dataType)
    out = ws.keep(found.unionByName(bare.select(nothing.alias("doc_id"), "n_shingles", nothing.alias("component_id"), F.lit(True).alias("kept"))), "result")
    ws.only("result")
    return out


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of docs, whole, one for each near-duplicate component: the row with the smallest id, a null one last.

    Every row is a document of its own, whatever its id: rows that share an id, or have none, are judged by their own texts, and of
    equal rows one stays. Rows with empty and null texts all stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "neardup")
    if _plain_ids(docs.select(F.col(id_col).alias("doc_id"))):
        rows, id_of = docs, F.col(id_col).cast("long")
    else:
        name = next(f"_row{n}" for n in range(len(docs.columns) + 1) if f"_row{n}" not in docs.columns)
        rows, id_of = ws.keep(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), F.col(name)
    found = _grouped(rows.select(id_of.alias("doc_id"), F.col(text_col).cast("binary").alias("text")), ws, k, num, den)
    if rows is docs:
        gone = found.where("doc_id <> component").select("doc_id")
    else:
        placed = found.join(rows.select(id_of.alias("doc_id"), F.col(id_col).alias("_id")), "doc_id")
        first = placed.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "doc_id")).alias("_first"))
        gone = placed.join(first, "component").where("doc_id <> _first.doc_id").select("doc_id")
    left = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_docs"), id_of.alias("doc_id"))
    return _without(left, ws.keep(gone, "gone"), ws, "gone").select("_docs.*")
