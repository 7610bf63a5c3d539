"""Token blocks to weights: TF-IDF for each field, normalised rows, weighted blocks.

A matrix is a table (item_id, field, term, w) without zero cells. The blocks stay on their item's partition from
the tokens to the norms: one shuffle by item, and one join with the document frequencies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.config import BLOCK_MODES, FIELDS, REPRESENTATIONS, Config
from tessella.sources.scratch import Scratch

#: A vocabulary of up to so many terms (some 10 MB) is broadcast, so that cells needn't be dealt by term.
BROADCAST_TERMS = 100_000


def token_table(features: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(item_id, field, term): a row for each token of the fields."""
    blocks = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"tokens.{f}").alias("terms")) for f in fields))
    rows = features.select(F.col("id").alias("item_id"), F.explode(blocks).alias("b"))
    return rows.select("item_id", "b.field", F.explode("b.terms").alias("term"))


def term_counts(tokens: DataFrame) -> DataFrame:
    """(item_id, field, term, tf)."""
    return tokens.groupBy("item_id", "field", "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(field, term, df) over counts, which hold an item once for each term."""
    return counts.groupBy("field", "term").agg(F.count("*").alias("df"))


def vocabulary(counts: DataFrame, config: Config) -> DataFrame:
    """Document frequencies that reach their field's floor."""
    floor = F.lit(1)
    for name, f in config.fields.items():
        floor = F.when(F.col("field") == name, f.min_df).otherwise(floor)
    return document_frequencies(counts).where(F.col("df") >= floor)


def sublinear(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1, n of all items, those without terms included."""
    return F.log((1 + n).cast("double") / (1 + df)) + 1


def row_norm(w: str, *by: str) -> Column:
    """w over its row's Euclidean length. Rows of zeros have no cells, so the length isn't zero."""
    return F.col(w) / F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy(*by)))


def tfidf(features: DataFrame, config: Config, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(item_id, field, term, tf, df, idf, w), w not yet normalised."""
    # dealt by item once, as arrays: counts and norms stay where they are, and both branches read the same shuffle
    counts = term_counts(token_table(features.select("id", "tokens").repartition("id"), fields))
    n = features.agg(F.count("*")).scalar()
    known = vocabulary(counts, config).withColumn("idf", smooth_idf(n, F.col("df")))
    tf = sublinear(F.col("tf")) if config.sublinear_tf else F.col("tf").cast("double")
    return counts.join(known, ["field", "term"]).withColumn("w", tf * F.col("idf"))


def tfidf_block(features: DataFrame, config: Config, field: str) -> DataFrame:
    """One field's block with rows of length one; no terms give no rows."""
    return tfidf(features, config, (field,)).select("item_id", "field", "term", row_norm("w", "item_id").alias("w"))


def blockwise(features: DataFrame, config: Config, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each field's block normalised and weighted, then whole rows normalised. Blocks of weight zero have no cells."""
    weight = F.lit(1.0)
    for name in fields:
        weight = F.when(F.col("field") == name, float(config.fields[name].weight)).otherwise(weight)
    fields = tuple(f for f in fields if config.fields[f].weight)
    if not fields:
        return tfidf(features, config, ("overview",)).where("false").select("item_id", "field", "term", "w")
    blocks = tfidf(features, config, fields).withColumn("w", row_norm("w", "item_id", "field") * weight)
    return blocks.select("item_id", "field", "term", row_norm("w", "item_id").alias("w"))


def flat(features: DataFrame, config: Config, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """All fields as one document: one floor, the strictest of the fields, and one norm."""
    floor = max(config.fields[f].min_df for f in fields)
    strict = config
    for f in fields:
        strict = strict.with_field(f, min_df=floor)
    return tfidf(features, strict, fields).select("item_id", "field", "term", row_norm("w", "item_id").alias("w"))


def representation(features: DataFrame, config: Config, fields: str | tuple[str, ...] = "D") -> DataFrame:
    """Weights by the configuration's block mode; fields is a key of REPRESENTATIONS or a tuple."""
    fields = REPRESENTATIONS[fields] if isinstance(fields, str) else fields
    if config.block_mode == "per_block":
        return blockwise(features, config, fields)
    if config.block_mode == "flat":
        return flat(features, config, fields)
    raise ValueError(f"unknown block mode {config.block_mode!r}")


def geometry(weights: DataFrame, features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: items, dimensions, nonzeros, density_pct, mean_nonzeros, empty_items. An empty matrix has density 0. by names the
    columns that keep several matrices apart; each has a row."""
    n = features.agg(F.count("*")).scalar()
    cells = weights.groupBy(*by).agg(F.count("*").alias("nonzeros"), F.countDistinct("item_id").alias("_rows"))
    words = weights.select(*by, "field", "term").distinct().groupBy(*by).agg(F.count("*").alias("dimensions"))
    both = cells.join(words, list(by)) if by else cells.withColumn("dimensions", words.scalar())
    out = both.withColumn("items", n)
    size = F.col("items").cast("double") * F.col("dimensions").cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    cells = F.col("nonzeros").cast("double")
    return out.select(*by, "items", "dimensions", "nonzeros", F.round(ratio(cells * 100, size), 6).alias("density_pct"), F.round(ratio(cells, F.col("items").cast("double")), 6).alias("mean_nonzeros"), (F.col("items") - F.col("_rows")).alias("empty_items"))


def energy_share(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(field, share_pct): each field's part of the squared weights."""
    sums = weights.groupBy(*by, "field").agg(F.sum(F.col("w") * F.col("w")).alias("e"))
    return sums.select(*by, "field", F.round(F.col("e") * 100 / F.sum("e").over(Window.partitionBy(*by)), 2).alias("share_pct"))


def coverage_by_field(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(field, items): items with at least one cell."""
    return weights.select(*by, "field", "item_id").distinct().groupBy(*by, "field").agg(F.count("*").alias("items"))


def field_columns(rows: DataFrame, value: str, prefix: str, by: tuple[str, ...]) -> DataFrame:
    """Rows (by, field, value) as one row for each by, with a column for each field; what isn't there is 0."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("field") == f, F.col(value))), F.lit(0)).alias(f"{prefix}_{f}") for f in FIELDS))


@dataclass(frozen=True)
class Variant:
    """One matrix of many: which of several feature tables it reads, its settings and its fields."""

    config: Config
    fields: tuple[str, ...] = FIELDS
    source: int = 0


def variants(sources: list[DataFrame], wanted: list[Variant], scratch: Scratch | None = None) -> DataFrame:
    """(variant, item_id, field, term, w): the matrices of all variants, numbered from 0, each as representation() gives it.

    Tokens are counted once for each table of features that a variant reads, dealt by item as arrays; cells stay there. A small table says what each variant makes of each field: its weight,
    its floor, whether counts are damped and whether blocks have norms of their own. Rows are multiplied by it after the last shuffle, where an item's cells lie together already.
    With scratch, which is the caller's to delete, document frequencies are written there, and only where they are more than BROADCAST_TERMS are cells dealt by term.
    """
    rows = []
    for n, v in enumerate(wanted):
        if v.config.block_mode not in BLOCK_MODES:
            raise ValueError(f"unknown block mode {v.config.block_mode!r}")
        flat_ = v.config.block_mode == "flat"
        floor = max((v.config.fields[f].min_df for f in v.fields), default=1)
        for f in v.fields:
            own = v.config.fields[f]
            if flat_ or own.weight:
                rows.append((n, v.source, f, 1.0 if flat_ else float(own.weight), floor if flat_ else own.min_df, v.config.sublinear_tf, flat_))
    read, fields = sorted({v.source for v in wanted}), [f for f in FIELDS if any(r[2] == f for r in rows)]
    blocks = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"tokens.{f}").alias("terms")) for f in fields or FIELDS))
    items = reduce(DataFrame.unionByName, [sources[i].select(F.lit(i).alias("source"), F.col("id").alias("item_id"), blocks.alias("blocks")) for i in read]).repartition("item_id")
    tokens = items.select("source", "item_id", F.explode("blocks").alias("b")).select("source", "item_id", "b.field", F.explode("b.terms").alias("term"))
    counts = tokens.groupBy("source", "item_id", "field", "term").agg(F.count("*").alias("tf"))
    sizes = reduce(DataFrame.unionByName, [sources[i].agg(F.count("*").alias("items")).select(F.lit(i).alias("source"), "items") for i in read])
    known = counts.groupBy("source", "field", "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "source")  # a row for each source
    known = known.select("source", "field", "term", "df", smooth_idf(F.col("items"), F.col("df")).alias("idf"))
    few = False
    if scratch:
        known = scratch.keep(known, f"frequencies-{scratch.count()}")
        few = known.count() <= BROADCAST_TERMS
    cells = counts.join(F.broadcast(known), ["source", "field", "term"]) if few else counts.join(known, ["source", "field", "term"]).repartition("item_id")
    table = counts.sparkSession.createDataFrame(rows, "variant int, source int, field string, weight double, floor long, damped boolean, flat boolean")
    cells = cells.join(F.broadcast(table), ["source", "field"]).where("df >= floor")  # a row for each variant and field
    tf = F.when(F.col("damped"), sublinear(F.col("tf"))).otherwise(F.col("tf").cast("double"))
    cells = cells.withColumn("w", tf * F.col("idf"))
    cells = cells.withColumn("w", F.when(F.col("flat"), F.col("w")).otherwise(row_norm("w", "item_id", "variant", "field") * F.col("weight")))
    return cells.select("variant", "item_id", "field", "term", row_norm("w", "item_id", "variant").alias("w"))


def comparison(features: DataFrame, config: Config) -> DataFrame:
    """(representation, block_mode, geometry, share_<field>, items_<field>): every representation in both block modes."""
    by, names = ("variant",), [(r, mode) for mode in BLOCK_MODES for r in REPRESENTATIONS]
    weights = variants([features], [Variant(replace(config, block_mode=mode), REPRESENTATIONS[r]) for r, mode in names])
    shares, items = field_columns(energy_share(weights, by), "share_pct", "share", by), field_columns(coverage_by_field(weights, by), "items", "items", by)
    table = features.sparkSession.createDataFrame([(n, r, mode) for n, (r, mode) in enumerate(names)], "variant int, representation string, block_mode string")
    out = geometry(weights, features, by).join(shares, list(by)).join(items, list(by)).join(F.broadcast(table), list(by))  # a row for each variant
    return out.select("representation", "block_mode", *(c for c in out.columns if c not in ("variant", "representation", "block_mode")))


def weight_for_share(target: float, current: float) -> float:
    """The field weight at which its energy share, current at weight one, becomes target."""
    if target <= 0:
        return 0.0
    if target >= 1 or not 0 < current < 1:
        raise ValueError("target must be under 1 and current strictly between 0 and 1")
    return math.sqrt(target / (1 - target) * (1 - current) / current)


def solved_weights(shares: DataFrame, target: float) -> DataFrame:
    """(field, share_pct, weight) for each field's share; null where no weight leads to the target."""
    c = F.col("share_pct") / 100
    weight = F.when((c > 0) & (c < 1), F.sqrt(F.lit(target / (1 - target)) * (1 - c) / c))
    return shares.select("field", "share_pct", F.round(weight, 6).alias("weight"))
