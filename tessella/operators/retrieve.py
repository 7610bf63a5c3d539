"""Similar items: scores over shared terms, gates, ranks, and what was passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Why a candidate is passed over.
LOW, FEW = "below_min_score", "insufficient_shared_terms"


def scores(weights: DataFrame, queries: DataFrame | None = None, candidates: DataFrame | None = None, by: tuple[str, ...] = (), rows: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score, shared) for every other item that shares a term with a query.

    queries has a column query_id, without it every item asks; candidates, where given, a column item_id; by names columns of weights that keep matrices in
    one table apart; rows, where given, holds the same weights in an order in which items are quickly found. Scores are sums of products of normalised rows, rounded to nine
    digits: sums come together in any order, and ranks must not depend on it.
    """
    if queries is None and candidates is None:
        return _all_scores(weights, by)
    asked = weights if rows is None else rows
    if queries is not None:
        asked = asked.join(queries.select(F.col("query_id").alias("item_id")).distinct(), "item_id", "left_semi")
    asked = asked.select(*by, F.col("item_id").alias("query_id"), "field", "term", F.col("w").alias("qw"))
    items = weights if candidates is None else weights.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    both = items.join(asked, [*by, "field", "term"]).where("item_id <> query_id")
    return both.groupBy(*by, "query_id", "item_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("score"), F.count("*").alias("shared"))


def _all_scores(weights: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each pair is joined, shuffled and summed once, and turned round at the end."""
    a = weights.select(*by, "field", "term", F.col("item_id").alias("a"), F.col("w").alias("wa"))
    b = weights.select(*by, "field", "term", F.col("item_id").alias("b"), F.col("w").alias("wb"))
    half = a.join(b, [*by, "field", "term"]).where("a < b").groupBy(*by, "a", "b")
    half = half.agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("score"), F.count("*").alias("shared"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("query_id"), F.col("b").alias("item_id")), F.struct(F.col("b").alias("query_id"), F.col("a").alias("item_id"))))
    return half.select(*by, ways.alias("way"), "score", "shared").select(*by, "way.query_id", "way.item_id", "score", "shared")


def by_score() -> list[Column]:
    return [F.desc("score"), F.asc("item_id")]


def ranked(scored: DataFrame) -> DataFrame:
    """Every candidate with its rank from 1: best score first, ties to the smaller id."""
    return _ranked(scored).withColumn("rank", F.col("rank").cast("long"))


def _ranked(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "query_id").orderBy(*by_score())))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k of each query; a limit for each partition goes before the shuffle."""
    if k < 1:
        raise ValueError(f"a list needs room for one result, not {k}")
    # the cast comes after the filter, so that the plan can limit each group before it is dealt out
    return _ranked(scored, by).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def padded(lists: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Lists (query_id, rank, item_id, score, shared) of k results: short ones go on with other items at score 0, in the order of their ids.

    A list and its query leave out k + 1 items at most, so the first 2 k + 1 ids are enough for all.
    """
    few = items.select("item_id").distinct().orderBy("item_id").limit(2 * k + 1)
    place = few.withColumn("_at", F.row_number().over(Window.orderBy("item_id")))  # 2 k + 1 rows
    ids = place.groupBy().agg(F.array_sort(F.collect_list(F.struct("_at", "item_id"))).alias("a")).select(F.transform("a", lambda x: x["item_id"])).scalar()
    held = lists.groupBy("query_id").agg(F.collect_list("item_id").alias("_held"), F.count("*").alias("_n"))  # k each
    short = queries.select("query_id").distinct().join(held, "query_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < k).withColumn("_ids", ids)
    free = F.filter("_ids", lambda i: (i != F.col("query_id")) & ~F.coalesce(F.array_contains("_held", i), F.lit(False)))
    more = short.select("query_id", "_n", F.posexplode(F.slice(free, 1, k)).alias("_p", "item_id")).where(F.col("_n") + F.col("_p") < k)
    more = more.select("query_id", (F.col("_n") + F.col("_p") + 1).cast("long").alias("rank"), "item_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("shared"))
    return lists.select("query_id", "rank", "item_id", "score", "shared").unionByName(more)


def _reason(min_score: float, min_shared: int) -> Column:
    low = F.when(F.col("score") < min_score, LOW)
    return low.when(F.col("shared") < min_shared, FEW)


def recommend(scored: DataFrame, k: int, min_score: float = 0.0, min_shared: int = 1) -> DataFrame:
    """(query_id, rank, item_id, score, shared): the first k that pass both gates.

    The gates look at one row only, so filtering first leaves what a scan down the ranks would find.
    """
    if min_shared < 1:
        raise ValueError(f"at least one shared term must be asked for, not {min_shared}")
    return top_k(scored.where(_reason(min_score, min_shared).isNull()), k).select("query_id", "rank", "item_id", "score", "shared")


def skipped(scored: DataFrame, k: int, min_score: float = 0.0, min_shared: int = 1) -> DataFrame:
    """(query_id, place, item_id, reason): rejected candidates above the k-th accepted one, or all where fewer pass.

    The k-th accepted one is found by a limited ranking; only the rejected above it are ranked at all.
    """
    judged = scored.withColumn("reason", _reason(min_score, min_shared))
    last = top_k(judged.where("reason is null"), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_score"), F.col("item_id").alias("_item"))
    rejected = judged.where("reason is not null").join(last, "query_id", "left")
    above = rejected.where("_score is null or score > _score or score = _score and item_id < _item")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score()))
    return above.withColumn("place", place.cast("long")).select("query_id", "place", "item_id", "reason")


def evidence(accepted: DataFrame, rejected: DataFrame, queries: DataFrame, k: int, min_shared: int) -> DataFrame:
    """One row for each query: returned, candidates_examined, candidates_rejected, exhausted."""
    a = accepted.groupBy("query_id").agg(F.count("*").alias("returned"))
    return evidence_of(a, rejected.groupBy("query_id").agg(F.count("*").alias("candidates_rejected")), queries, k, min_shared)


def evidence_of(a: DataFrame, r: DataFrame, queries: DataFrame, k: int, min_shared: int) -> DataFrame:
    """evidence by counts (query_id, returned) and (query_id, candidates_rejected)."""
    out = queries.select("query_id").distinct().join(a, "query_id", "left").join(r, "query_id", "left").na.fill(0)
    return out.select(
        "query_id", F.lit(min_shared).cast("long").alias("min_shared_terms"), F.lit(k).cast("long").alias("requested_k"), "returned",
        (F.col("returned") + F.col("candidates_rejected")).alias("candidates_examined"), "candidates_rejected", (F.col("returned") < k).alias("exhausted"),
    )


def skip_tally(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def metadata(features: DataFrame, **more: Column) -> DataFrame:
    """What is shown of an item: genres as sorted names, numbers of tokens by field, and more columns where given."""
    names = F.array_sort(F.transform("tokens.genres", lambda g: F.replace(g, F.lit("_"), F.lit(" "))))
    sizes = {f"n_{f}": F.size(f"tokens.{f}").cast("long") for f in ("overview", "keywords", "genres", "cast", "director")}
    shown = features.select("id", "title", "original_title", F.col("release_year").cast("long").alias("release_year"), F.array_join(names, "|").alias("genres"), "popularity", "vote_average", "vote_count", "collection_name", *(c.alias(n) for n, c in (sizes | more).items()))
    return shown


def with_metadata(results: DataFrame, features: DataFrame) -> DataFrame:
    """Results with their items' metadata."""
    shown = metadata(features).select(F.col("id").alias("item_id"), "title", F.col("release_year").alias("year"), "genres", "popularity", "vote_average", "vote_count", "collection_name")
    return results.join(shown, "item_id")
