"""Agreement of ranked lists with structural labels, and what the lists look like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import listed
from tessella.operators.retrieve import top_k
from tessella.plans.config import CUTOFFS, THIN_TERMS
from tessella.sources.scratch import Scratch

#: Values are dealt to SPLIT * SPLIT parts, by quantiles as exact as one place in ACCURACY.
SPLIT, ACCURACY = 24, 100_000
#: Of sets of up to so many groups all subsets are counted.
SETS = 6


def ranked_lists(scored: DataFrame, ks: tuple[int, ...] = CUTOFFS, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, item_id, score, shared): each query's list down to the largest cutoff.

    by, here and below, names columns that keep the lists of several configurations in one table apart; results have a row for each.
    """
    return top_k(scored, max(ks), by).select(*by, "query_id", "rank", "item_id", "score", "shared")


def filtered_lists(lists: DataFrame, min_shared: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Lists without results on too little evidence, ranked anew. They were cut before, so the filter only takes away."""
    place = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("rank"))
    return lists.where(F.col("shared") >= min_shared).withColumn("rank", place.cast("long"))


def backfilled_lists(scored: DataFrame, min_shared: int | Column, ks: tuple[int, ...] = CUTOFFS, by: tuple[str, ...] = ()) -> DataFrame:
    """As filtered_lists, but filtered before the cut, so that later candidates move up."""
    return ranked_lists(scored.where(F.col("shared") >= min_shared), ks, by)


def gated_lists(packed: DataFrame, min_shared: int | Column) -> DataFrame:
    """As filtered_lists, of lists that lie in a row each; places close up by themselves, so nothing is dealt out."""
    return packed.withColumn("items", F.filter("items", lambda x: x["shared"] >= min_shared))


def packed_lists(lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, items): lists of a row for each place as a row for each query."""
    whole = lists.groupBy(*by, "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score", "shared"))).alias("items"))  # a list is short
    return whole.withColumn("items", F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"), x["shared"].alias("shared"))))


def label_scores(lists: DataFrame, pairs: DataFrame, ks: tuple[int, ...] = CUTOFFS, by: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """(kind, k, queries, recall, hit_rate, ndcg, mean_relevant) over the queries that a kind can judge, by pairs (kind, query_id, item_id).

    The ideal of NDCG counts the hits inside the list, so a list with hits on top scores 1 whatever it misses. With by, one column, names
    lists its values, as a configuration may find nothing.
    """
    relevant = pairs.groupBy("kind", "query_id").agg(F.count("*").alias("n_relevant"))
    return _judged(relevant, lists.join(pairs, ["query_id", "item_id"]).select(*by, "kind", "query_id", "rank"), ks, by, names)


def group_scores(lists: DataFrame, groups: DataFrame, queries: DataFrame, ks: tuple[int, ...] = CUTOFFS, by: tuple[str, ...] = (), names: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """As label_scores, by groups (kind, group_key, item_id) themselves: neither what one group makes relevant nor lists with their groups are written out."""
    scratch = scratch or Scratch(lists.sparkSession, "groups")
    kinds = F.array(*(F.lit(r["kind"]) for r in groups.select("kind").distinct().orderBy("kind").collect()), F.lit(None).cast("string"))  # a row for each kind
    number = F.array_position(kinds, F.col("kind"))
    relevant = relevant_counts(groups, scratch).join(queries.select("query_id").distinct(), "query_id", "left_semi")
    relevant = scratch.keep(relevant, f"relevant-{scratch.count()}")
    cells = groups.select("item_id", F.col("kind").alias("field"), F.col("group_key").alias("term"), number.alias("value"))
    counted = relevant.select(F.col("query_id").alias("item_id"), F.lit("").alias("field"), F.col("kind").alias("term"), (number + listed.KINDS * F.col("n_relevant")).alias("value"))
    sums = listed.over(lists, cells.unionByName(counted), (), by, listed.label_sums(ks), "kind int, k long, recall double, hits long, ndcg double", scratch, True)
    sums = sums.groupBy(*by, F.element_at(kinds, F.col("kind")).alias("kind"), "k").agg(*(F.sum(c).alias(c) for c in ("recall", "hits", "ndcg")))  # a few rows for each block
    every = relevant.groupBy("kind").agg(F.count("*").alias("queries"), F.avg("n_relevant").alias("mean_relevant")).withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))))
    if by:  # one column; a configuration may find nothing
        every = every.withColumn(by[0], F.explode(F.array(*map(F.lit, names))))
    mean = lambda c: F.round(F.coalesce(F.col(c) / F.col("queries"), F.lit(0.0)), 6)
    out = every.join(sums, [*by, "kind", "k"], "left")
    return out.select(*by, "kind", "k", "queries", mean("recall").alias("recall"), mean("hits").alias("hit_rate"), mean("ndcg").alias("ndcg"), F.round("mean_relevant", 6).alias("mean_relevant"))


def relevant_counts(groups: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(kind, query_id, n_relevant): how many other items share a group with an item, each counted once.

    Items in the same groups are one set. What is in any group of a set of up to SETS groups is said by the numbers of items in all groups of each of its subsets, added and taken
    away by turns, so that no pair is met. Where items of more groups ask or are asked for, pairs are counted in blocks without writing them.
    """
    scratch = scratch or Scratch(groups.sparkSession, "relevant")
    tag = f"relevant-{scratch.count()}"
    terms = scratch.keep(groups.select("kind", "group_key").distinct().withColumn("key", F.monotonically_increasing_id()), f"{tag}-terms")
    own = groups.join(terms, ["kind", "group_key"]).groupBy("kind", F.col("item_id").alias("query_id")).agg(F.array_sort(F.collect_set("key")).alias("keys"))  # an item's own groups
    own = scratch.keep(own, f"{tag}-items")
    few = own.where(F.size("keys") <= SETS)
    sets = few.groupBy("keys").agg(F.count("*").alias("n"))  # a key stands for one kind
    parts = F.expr("transform(sequence(1, shiftleft(1, size(keys)) - 1), m -> filter(keys, (k, i) -> (shiftright(m, i) & 1) = 1))")
    subsets = scratch.keep(sets.select("keys", "n", F.explode(parts).alias("part")), f"{tag}-subsets")
    sums = subsets.groupBy("part").agg(F.sum("n").alias("m"))
    sign = F.when(F.size("part") % 2 == 1, F.col("m")).otherwise(-F.col("m"))
    unions = scratch.keep(subsets.select("keys", "part").join(sums, "part").groupBy("keys").agg(F.sum(sign).alias("n")), f"{tag}-unions")
    counts = few.join(unions, "keys").select("kind", "query_id", "n")
    many = own.where(F.size("keys") > SETS).select("kind", "query_id")
    if not many.isEmpty():
        asked = groups.withColumnRenamed("item_id", "query_id")
        theirs = groups.join(many.withColumnRenamed("query_id", "item_id"), ["kind", "item_id"], "left_semi")
        beside = listed.union_sizes(asked.join(many, ["kind", "query_id"], "left_anti"), theirs, scratch)
        counts = reduce(DataFrame.unionByName, [counts, beside, listed.union_sizes(asked.join(many, ["kind", "query_id"], "left_semi"), groups, scratch)])
        counts = counts.groupBy("kind", "query_id").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("kind", "query_id", (F.col("n") - 1).alias("n_relevant"))


def _judged(relevant: DataFrame, hits: DataFrame, ks: tuple[int, ...], by: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    if by:
        relevant = relevant.withColumn(by[0], F.explode(F.array(*map(F.lit, names))))
    found = hits.groupBy(*by, "kind", "query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in ks), *(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}") for k in ks))
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    per = relevant.join(found, [*by, "kind", "query_id"], "left").na.fill(0)
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"f{k}").alias("f"), F.col(f"d{k}").alias("d")) for k in ks)))
    per = per.select(*by, "kind", "n_relevant", rows.alias("x")).select(*by, "kind", "n_relevant", "x.*")
    ndcg = F.when(F.col("f") > 0, F.col("d") / ideal(F.greatest("f", F.lit(1)))).otherwise(0.0)
    out = per.groupBy(*by, "kind", "k").agg(F.count("*").alias("queries"), F.avg(F.col("f") / F.col("n_relevant")).alias("recall"), F.avg((F.col("f") > 0).cast("double")).alias("hit_rate"), F.avg(ndcg).alias("ndcg"), F.avg("n_relevant").alias("mean_relevant"))
    return out.select(*by, "kind", "k", "queries", *(F.round(c, 6).alias(c) for c in ("recall", "hit_rate", "ndcg", "mean_relevant")))


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def coverage(lists: DataFrame, features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """coverage: distinct items in any list over all items."""
    n = features.agg(F.count("*")).scalar()
    return lists.groupBy(*by).agg(F.countDistinct("item_id").alias("n")).select(*by, _rate(F.col("n"), n).alias("coverage"))


def diversity(lists: DataFrame, weights: DataFrame, by: tuple[str, ...] = (), matrix: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """diversity: mean of 1 - similarity over all pairs inside lists, pooled over queries; pairs that share nothing count as 1.

    A list's pairs are summed together by its rows of weights, none of them is written; matrix names the column (of lists too) that
    keeps several matrices apart.
    """
    scratch = scratch or Scratch(lists.sparkSession, "diversity")
    cells = weights.select(*matrix, "item_id", "field", "term", F.col("w").alias("value"))
    sums = listed.over(lists, cells, matrix, by, listed.alikeness, "pairs long, alike double", scratch)
    out = sums.groupBy(*by).agg(F.try_divide(F.sum("pairs") - F.sum("alike"), F.sum("pairs").cast("double")).alias("d"))
    return out.select(*by, F.round(F.coalesce("d", F.lit(0.0)), 6).alias("diversity"))


def breadth(lists: DataFrame, features: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(distinct_genres, distinct_decades): means over all queries, those without results as 0, of the first k."""
    n = queries.select("query_id").distinct().agg(F.count("*")).scalar()
    shown = features.select(F.col("id").alias("item_id"), F.col("tokens.genres").alias("genres"), (F.floor(F.col("release_year") / 10) * 10).alias("decade"))
    top = lists.where(F.col("rank") <= k).join(shown, "item_id")
    decade = F.when(F.col("decade") > 0, F.col("decade"))
    # k rows a query: genres and decades of one list meet in one row
    per = top.groupBy(*by, "query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("genres")))).alias("g"), F.countDistinct(decade).alias("d"))
    out = per.groupBy(*by).agg(F.sum("g").alias("g"), F.sum("d").alias("d"))
    return out.select(*by, _rate(F.coalesce("g", F.lit(0)), n).alias("distinct_genres"), _rate(F.coalesce("d", F.lit(0)), n).alias("distinct_decades"))


def list_statistics(lists: DataFrame, queries: DataFrame, k: int, thin: int = THIN_TERMS, by: tuple[str, ...] = ()) -> DataFrame:
    """(mean_top1_score, thin_rate, mean_returned): best scores of queries with results, results of the first k on
    little evidence, and the mean length of a list over all queries."""
    n = queries.select("query_id").distinct().agg(F.count("*")).scalar()
    first = F.col("rank") <= k
    out = lists.groupBy(*by).agg(F.avg(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.count_if(first).alias("n"), F.count_if(first & (F.col("shared") <= thin)).alias("thin"), F.count("*").alias("all"))
    return out.select(*by, F.round(F.coalesce("top1", F.lit(0.0)), 6).alias("mean_top1_score"), _rate(F.col("thin"), F.col("n")).alias("thin_rate"), _rate(F.col("all"), n).alias("mean_returned"))


def splitters(counts: DataFrame, value: str) -> tuple[Column, Column]:
    """(bounds, bounds inside): quantiles of a column's distinct values, SPLIT - 1 of them and for each part between them as many again; one small row."""
    n = SPLIT * SPLIT
    # a sketch of bounded size in each task; equal places of the sketch are equal numbers of values, however they are spread
    found = counts.agg(F.approx_percentile(value, [i / n for i in range(1, n)], ACCURACY).alias("q"))
    tops = F.transform(F.sequence(F.lit(1), F.lit(SPLIT - 1)), lambda i: F.element_at("q", (i * SPLIT).cast("int")))
    inner = F.transform(F.sequence(F.lit(0), F.lit(SPLIT - 1)), lambda i: F.slice("q", (i * SPLIT + 1).cast("int"), SPLIT - 1))
    return found.select(tops).scalar(), found.select(inner).scalar()


def value_places(rows: DataFrame, value: str, by: tuple[str, ...] = (), n: str | None = None) -> DataFrame:
    """(value, n, before): for each distinct value how many rows hold it and how many hold smaller ones. n names a column that says how many rows a row stands for.

    Values are counted first, then dealt by splitters from a sketch of them, so that no task orders them all, whatever their spread; counts of the parts before a
    part are added to the places inside it.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("value")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    tops, inner = splitters(counts, "value")
    dealt = counts.withColumns({"_tops": tops, "_inner": inner}).withColumn("bucket", bucket_of(F.col("value"), F.col("_tops"), F.col("_inner"))).drop("_tops", "_inner")
    sums = dealt.groupBy(*by, "bucket").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # SPLIT * SPLIT rows at most
    sums = sums.select(*by, "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*by, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    if by:  # as many tables of so many rows as there are configurations
        return placed.join(sums, [*by, "bucket"]).select(*by, "value", "n", (F.col("inside") + F.col("offset")).alias("before"))
    return placed.join(F.broadcast(sums), "bucket").select("value", "n", (F.col("inside") + F.col("offset")).alias("before"))


def bucket_of(value: Column, tops: Column, inner: Column) -> Column:
    """The part that a value falls in; nulls come first."""
    under = lambda bounds: F.size(F.filter(bounds, lambda b: b <= value))
    top = under(tops)
    return F.coalesce(top * SPLIT + under(F.element_at(inner, top + 1)), F.lit(-1))


def popularity_percentiles(features: DataFrame) -> DataFrame:
    """(item_id, percentile): mean rank of an item's popularity, from 0 to 100; null counts as 0, ties share their mean."""
    rows = features.select(F.col("id").alias("item_id"), F.coalesce("popularity", F.lit(0.0)).alias("value"))
    n = features.agg(F.count("*")).scalar()
    rank = F.col("before") + (F.col("n") - 1) / F.lit(2.0)
    percentile = rank / F.greatest(n - 1, F.lit(1)) * 100.0
    return rows.join(value_places(rows, "value"), "value").select("item_id", percentile.alias("percentile"))


def spearman(pairs: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rho of mean ranks; under two rows, or a constant column, 0."""
    rank = lambda c: value_places(pairs, c, by).select(*by, F.col("value").alias(c), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(f"r_{c}"))
    both = pairs.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).join(rank(x), [*by, x]).join(rank(y), [*by, y])
    a, b = f"r_{x}", f"r_{y}"
    rho = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return both.groupBy(*by).agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))


def popularity_bias(lists: DataFrame, percentiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(mean_percentile, rho) of the popularity of what lists hold, and of rank against it, pooled over queries."""
    pairs = lists.join(percentiles, "item_id").select(*by, "rank", "percentile")
    mean = pairs.groupBy(*by).agg(F.round(F.coalesce(F.avg("percentile"), F.lit(0.0)), 6).alias("mean_percentile"))
    if by:
        return mean.join(spearman(pairs, "rank", "percentile", by), list(by))
    return mean.withColumn("rho", spearman(pairs, "rank", "percentile").scalar())


def profiles(lists: DataFrame, features: DataFrame, queries: DataFrame, percentiles: DataFrame, k: int, by: tuple[str, ...], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(breadth, popularity_bias) of the same lists, each counted in blocks of lists: no place is dealt out by its item or its query."""
    n = queries.select("query_id").distinct().agg(F.count("*")).scalar()
    decade = F.floor(F.col("release_year") / 10) * 10
    item, cell = F.col("id").alias("item_id"), lambda field, term, value: (F.lit(field).alias("field"), term.cast("string").alias("term"), value.alias("value"))
    cells = features.select(item, F.explode(F.array_distinct("tokens.genres")).alias("g")).select("item_id", *cell("genre", F.col("g"), F.lit(listed.GENRE)))
    cells = cells.unionByName(features.where(decade > 0).select(item, *cell("decade", decade, F.lit(listed.DECADE))))
    cells = cells.unionByName(percentiles.select("item_id", *cell("percentile", F.lit(""), F.col("percentile"))))
    found = listed.over(lists, cells, (), by, listed.profile(k), "rank long, percentile double, n long, genres long, decades long", scratch)
    found = scratch.keep(found.groupBy(*by, "rank", "percentile").agg(*(F.sum(c).alias(c) for c in ("n", "genres", "decades"))), f"profiles-{scratch.count()}")
    wide = found.groupBy(*by).agg(F.sum("genres").alias("g"), F.sum("decades").alias("d"))
    pairs = found.where("rank > 0")
    mean = pairs.groupBy(*by).agg(F.sum("n").alias("all"), F.round(F.sum(F.col("n") * F.col("percentile")) / F.sum("n"), 6).alias("mean_percentile"))
    # mean ranks have their middle at (all + 1) / 2
    rank = lambda c: value_places(pairs, c, by, "n").select(*by, F.col("value").alias(c), (F.col("before") + F.col("n") / F.lit(2.0)).alias(f"r_{c}"))
    both = pairs.withColumn("rank", F.col("rank").cast("double")).join(rank("rank"), [*by, "rank"]).join(rank("percentile"), [*by, "percentile"])
    both = both.join(F.broadcast(mean), list(by)) if by else both.crossJoin(F.broadcast(mean))  # a row for each configuration
    a, b = (F.col(f"r_{c}") - F.col("all") / 2.0 for c in ("rank", "percentile"))
    rho = F.try_divide(F.sum(F.col("n") * a * b), F.sqrt(F.sum(F.col("n") * a * a)) * F.sqrt(F.sum(F.col("n") * b * b)))
    bias = both.groupBy(*by, "mean_percentile").agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))
    return wide.select(*by, _rate(F.col("g"), n).alias("distinct_genres"), _rate(F.col("d"), n).alias("distinct_decades")), bias
