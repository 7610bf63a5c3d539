"""Title search in tiers: exact, then prefixes, then parts; by a scan, or by an index of titles folded once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import casefold, casefolded, stripped

MATCHES = ("exact", "title_prefix", "original_title_prefix", "title_contains", "title_contains")


def search_titles(features: DataFrame, query: str, limit: int) -> DataFrame:
    """(place, id, title, match, total_matches): best tier first, then the title's key, then the id.

    Titles and query are folded and stripped; inner white space counts, and no character is a wildcard. The total is of all
    matches, before the limit.
    """
    rows = features.select("id", "title", title_key(F.col("title")).alias("_title"), title_key(F.col("original_title")).alias("_original"))
    t, o, q = F.col("_title"), F.col("_original"), F.lit(casefolded(query))
    tier = F.when((t == q) | (o == q), 0).when(F.startswith(t, q), 1).when(F.startswith(o, q), 2).when(F.contains(t, q), 3).when(F.contains(o, q), 4)
    hits = rows.withColumn("_tier", tier).where("_tier is not null")
    total = hits.agg(F.count("*")).scalar()
    place = F.row_number().over(Window.orderBy("_tier", "_title", "id"))  # over limit rows at most
    first = hits.orderBy("_tier", "_title", "id").limit(limit)
    return first.select(place.cast("long").alias("place"), "id", "title", _match(F.col("_tier")).alias("match"), total.alias("total_matches"))


def title_key(title: Column) -> Column:
    """A title as searches compare it."""
    return stripped(casefold(F.coalesce(title, F.lit(""))))


def _match(tier: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m) for m in MATCHES)), tier + 1)


#: Characters of a posting. Shorter queries are prefixes of postings.
GRAM = 3


@dataclass(frozen=True)
class TitleIndex:
    """Titles in the order of search results, and postings of their grams.

    titles (at, id, title): at ascends with the title's key and then the id. grams (gram, at, original, start, size): every place of a
    title's key, or of its original title's, with the GRAM characters from there on (U+0000 fills up the last ones) and the key's length.
    A query's places lie side by side, so postings alone say which tier a title is in; only what is shown is looked up.
    """

    titles: DataFrame
    grams: DataFrame

    @classmethod
    def write(cls, features: DataFrame, path: str) -> TitleIndex:
        """The index of features (id, title, original_title) under path. A title that many rows share is dealt on by id."""
        spark = features.sparkSession
        rows = features.select("id", "title", title_key(F.col("title")).alias("_title"), title_key(F.col("original_title")).alias("_original"))
        order = ("_title", "id", "title", "_original")
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{path}/titles")
        stored = spark.read.parquet(f"{path}/titles")
        sides = F.array(*(F.struct(F.lit(o).alias("original"), F.col(c).alias("key")) for o, c in ((False, "_title"), (True, "_original"))))
        keys = stored.select("at", F.explode(sides).alias("s")).where("s.key <> ''").select("at", "s.original", F.length("s.key").alias("size"), F.split("s.key", "").alias("_chars"))
        after = lambda i, n: F.coalesce(F.get("_chars", i + n), F.lit("\0"))
        gram = F.transform("_chars", lambda c, i: F.concat(c, *(after(i, n) for n in range(1, GRAM))))
        grams = keys.select("at", "original", "size", F.posexplode(gram).alias("start", "gram")).select("gram", "at", "original", "start", "size")
        grams.repartitionByRange("gram", "at").sortWithinPartitions("gram", "at", "original", "start").write.mode("overwrite").parquet(f"{path}/grams")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TitleIndex:
        return cls(spark.read.parquet(f"{path}/titles").select("at", "id", "title"), spark.read.parquet(f"{path}/grams"))

    def postings(self, query: str) -> DataFrame:
        """What a search reads: (at, original, size, begin, offset), the places where a match may begin by one of the query's grams."""
        q = casefolded(query)
        if len(q) < GRAM:
            return self.grams.where(F.startswith("gram", F.lit(q))).select("at", "original", "size", F.col("start").alias("begin"), F.lit(0).alias("offset"))
        wanted: dict[str, list[int]] = {}
        for i in _offsets(q):
            wanted.setdefault(q[i : i + GRAM], []).append(i)
        places = F.create_map(*(x for g, offsets in wanted.items() for x in (F.lit(g), F.array(*map(F.lit, offsets)))))
        rows = self.grams.where(F.col("gram").isin(*wanted)).select("at", "original", "size", "start", F.explode(places[F.col("gram")]).alias("offset"))
        return rows.select("at", "original", "size", (F.col("start") - F.col("offset")).alias("begin"), "offset")

    def search(self, query: str, limit: int) -> DataFrame:
        """The rows of search_titles. A query that folds to nothing is in every title, without a posting: those are ranked by their order alone.

        The first limit rows and the total come to the driver in one job; titles are then read by their places.
        """
        q = casefolded(query)
        n = len(q)
        if n:
            inside = self.postings(query).where(F.col("begin") + n <= F.col("size"))  # the filler is no part of a key
            # dealt by title once; both counts find their rows together then
            whole = inside.repartition("at").groupBy("at", "original", "size", "begin").agg(F.count("*").alias("grams")).where(F.col("grams") == len(_offsets(q)))
            at_start, title = F.col("begin") == 0, ~F.col("original")
            tier = F.when(at_start & (F.col("size") == n), 0).when(at_start & title, 1).when(at_start, 2).when(title, 3).otherwise(4)
            found = whole.groupBy("at").agg(F.min(tier).alias("tier"))
        else:
            keyed = self.grams.where("start = 0").groupBy("at").agg(F.count("*").alias("keys"))  # with both keys, neither is empty
            found = self.titles.join(keyed, "at", "left").select("at", F.when(F.col("keys") == 2, 1).otherwise(0).alias("tier"))
        first = found.orderBy("tier", "at").limit(limit).select("tier", "at")
        rows = first.unionByName(found.agg(F.lit(-1).alias("tier"), F.count("*").alias("at"))).collect()  # limit + 1 rows
        total = next(r["at"] for r in rows if r["tier"] < 0)
        shown = sorted((r["tier"], r["at"]) for r in rows if r["tier"] >= 0)
        spark = self.titles.sparkSession
        places = {at: F.struct(F.lit(p).cast("long").alias("place"), F.lit(tier).alias("tier")) for p, (tier, at) in enumerate(shown, 1)}
        rows = self.titles.where(F.col("at").isin(*places))
        if not places:
            return spark.createDataFrame([], f"place long, id {rows.schema['id'].dataType.simpleString()}, title string, match string, total_matches long")
        place = F.create_map(*(x for at, p in places.items() for x in (F.lit(at), p)))[F.col("at")]
        return rows.select(place.alias("p"), "id", "title").select("p.place", "id", "title", _match(F.col("p.tier")).alias("match"), F.lit(total).cast("long").alias("total_matches")).orderBy("place")


def _offsets(q: str) -> list[int]:
    """Places of a query whose grams hold each of its characters."""
    return sorted({*range(0, len(q) - GRAM + 1, GRAM), max(len(q) - GRAM, 0)})


#: Genres that name a kind of query. Fixed values.
GENRE_PURPOSES = {"documentary": ("documentary",), "animation_family": ("animation", "family")}


def select_queries(features: DataFrame, weights: DataFrame, groups: DataFrame, genres: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(purpose, id): items worth a look, each the one with the smallest id of its kind; a kind without items has no row.

    popular, obscure and sparse_features are the extremes of popularity and of the number of terms, items without terms included. no_overview,
    those of GENRE_PURPOSES (genres as tokens), same_title and franchise (three others in its collection) are the first that are so.
    """
    genres = GENRE_PURPOSES if genres is None else genres
    terms = weights.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n_terms"))
    labelled = groups.where("kind in ('franchise', 'same_title')").select("kind", "group_key", F.col("item_id").alias("id"))
    sizes = labelled.groupBy("kind", "group_key").agg(F.count("*").alias("size"))
    kin = labelled.join(sizes, ["kind", "group_key"]).groupBy("id").agg(F.max(F.when(F.col("kind") == "franchise", F.col("size"))).alias("family"), F.count_if((F.col("kind") == "same_title") & (F.col("size") > 1)).alias("namesakes"))
    rows = features.select("id", F.coalesce("popularity", F.lit(0.0)).alias("popularity"), F.col("tokens.genres").alias("genres"), F.size("tokens.overview").alias("n_overview"))
    rows = rows.join(terms, "id", "left").join(kin, "id", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    first = lambda condition: F.min(F.when(condition, F.col("id")))
    kinds = {
        "popular": F.min(F.struct((-F.col("popularity")).alias("x"), "id"))["id"], "obscure": F.min(F.struct("popularity", "id"))["id"], "sparse_features": F.min(F.struct("n_terms", "id"))["id"],
        "no_overview": first(F.col("n_overview") == 0), **{k: first(F.arrays_overlap("genres", F.array(*map(F.lit, names)))) for k, names in genres.items()},
        "same_title": first(F.col("namesakes") > 0), "franchise": first(F.col("family") >= 4),
    }
    one = rows.agg(*(c.alias(k) for k, c in kinds.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("purpose"), F.col(k).alias("id")) for k in kinds))).alias("p")).select("p.*").where("id is not null")
