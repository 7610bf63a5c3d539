"""Structural labels: items that share a collection, a director, a top-billed name or a title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import normalise_name
from tessella.plans.config import GROUP_SIZE, LABEL_KINDS

#: Tasks that members of one group are dealt over when they meet those who ask.
SHARES = 32


class MissingCredits(ValueError):
    """Feature records don't hold whole names, so people can't be told apart."""


def memberships(records: DataFrame, cast_top_k: int, catalogue: DataFrame | None = None) -> DataFrame:
    """(kind, group_key, item_id) of raw records, each once; catalogue (item_id) restricts the items.

    Cast is cut by billing order before names are folded; credits without an order come last.
    """
    if "cast" not in records.columns or "crew" not in records.columns:
        raise MissingCredits("labels need raw records with credits")
    rows = records.where("id is not null").select("id", "title", "collection_name", "cast", "crew")
    if catalogue is not None:
        rows = rows.join(catalogue.select(F.col("item_id").alias("id")), "id", "left_semi")
    last = F.lit(1 << 30)
    order = lambda c: F.coalesce(F.when(c["flag"].isNotNull(), c["flag"].cast("int")), c["order"], last)
    billed = F.array_sort(F.transform("cast", lambda c, i: F.struct(order(c).alias("o"), i.alias("i"), c["name"].alias("name"))))
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    people = lambda kind, names: F.transform(names, lambda c: one(kind, c["name"]))
    named = F.concat(
        F.array(one("franchise", F.col("collection_name")), one("same_title", F.col("title"))),
        people("director", F.filter("crew", lambda c: c["job"] == "Director")), people("cast", F.slice(billed, 1, cast_top_k)),
    )
    out = rows.select(F.col("id").alias("item_id"), F.explode(named).alias("n")).where("n.name is not null")
    out = out.select(F.col("n.kind").alias("kind"), normalise_name(F.col("n.name")).alias("group_key"), "item_id")
    return out.where("group_key <> ''").distinct()


def label_groups(members: DataFrame) -> DataFrame:
    """Memberships of groups of two and more."""
    sizes = members.groupBy("kind", "group_key").agg(F.count("*").alias("n")).where(F.col("n") >= GROUP_SIZE)
    return members.join(sizes.drop("n"), ["kind", "group_key"], "left_semi")


def label_pairs(groups: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(kind, query_id, item_id): what is relevant to each item; people's groups are united, the item itself is left out.

    Members of a group are dealt over SHARES tasks, and those who ask go to each. Where two share several groups of a kind the first one gives the pair, so no pair is dealt out.
    """
    several = groups.groupBy("kind", "item_id").agg(F.collect_set("group_key").alias("keys")).where(F.size("keys") > 1)  # an item's own groups
    members = groups.join(several, ["kind", "item_id"], "left")
    a = members.select("kind", "group_key", F.col("item_id").alias("query_id"), F.col("keys").alias("_own"))
    if queries is not None:
        a = a.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    a = a.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    b = members.withColumn("_share", F.pmod(F.xxhash64("item_id"), F.lit(SHARES)).cast("int"))
    first = F.col("_own").isNull() | F.col("keys").isNull() | (F.col("group_key") == F.array_min(F.array_intersect("_own", "keys")))
    return a.join(b, ["kind", "group_key", "_share"]).where((F.col("query_id") != F.col("item_id")) & first).select("kind", "query_id", "item_id")


def label_summary(groups: DataFrame) -> DataFrame:
    """(kind, groups, items)."""
    return groups.groupBy("kind").agg(F.countDistinct("group_key").alias("groups"), F.countDistinct("item_id").alias("items"))


def unevaluable(groups: DataFrame, queries: DataFrame) -> DataFrame:
    """(kind, queries): queries to which a kind has nothing relevant, as they stand in none of its groups."""
    kinds = queries.select("query_id", F.explode(F.array(*(F.lit(k) for k in LABEL_KINDS))).alias("kind"))
    none = kinds.join(groups.select("kind", F.col("item_id").alias("query_id")).distinct(), ["kind", "query_id"], "left_anti")
    return none.groupBy("kind").agg(F.count("*").alias("queries"))
