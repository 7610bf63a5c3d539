"""Counts that describe raw records; nothing is repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.text import normalise_title
from tessella.operators.evaluate import value_places

#: What stands for a missing overview, and titles that are none. Fixed values, matched case-insensitively.
PLACEHOLDER = r"^no overview available\.?$|^no overview found\.?$|^n/?a$|^unknown$|^tbd$|^coming soon$|^lorem ipsum|^[^\p{L}\p{N}_]*$"
JUNK_TITLE = r"^(test|untitled|untitled[0-9]*|dummy|placeholder|sample|example|movie|film|asdf|qwerty|xxx+|\?+)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
NUMERIC_TITLE = r"^[0-9\s.\-]+$"
SHORT_OVERVIEW = 40


def stripped(c: Column) -> Column:
    return text.stripped(F.coalesce(c, F.lit("")))


def names(c: Column) -> Column:
    """Labels that aren't blank."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), stripped), lambda v: v != "")


def presence(records: DataFrame) -> DataFrame:
    """Records with a boolean for each thing that may be missing."""
    cast = F.coalesce("cast", F.array().cast("array<struct<order:int,flag:boolean,name:string>>"))
    crew = F.coalesce("crew", F.array().cast("array<struct<job:string,name:string>>"))
    overview, date = stripped(F.col("overview")), stripped(F.col("release_date"))
    prose = (overview != "") & ~F.lower(overview).rlike(PLACEHOLDER) & (F.length(overview) >= SHORT_OVERVIEW)
    return records.withColumns({
        "has_id": F.col("id").isNotNull(), "has_title": stripped(F.col("title")) != "", "has_date": date.rlike(DATE), "blank_date": date == "", "has_overview": overview != "", "has_prose": prose,
        "has_genres": F.size(names(F.col("genres"))) > 0, "has_keywords": F.size(names(F.col("keywords"))) > 0,
        "has_cast": F.size(names(F.transform(cast, lambda c: c["name"]))) > 0,
        "n_directors": F.size(names(F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: c["name"]))),
    })


def missing_counts(records: DataFrame) -> DataFrame:
    """(item, n, pct) for what records lack."""
    p = presence(records)
    lacks = {
        "title": ~F.col("has_title"), "overview_blank": ~F.col("has_overview"), "genres": ~F.col("has_genres"), "keywords": ~F.col("has_keywords"), "cast": ~F.col("has_cast"),
        "release_date_blank": F.col("blank_date"), "release_date_malformed": ~F.col("blank_date") & ~F.col("has_date"), "director": F.col("n_directors") == 0,
    }
    row = p.agg(F.count("*").alias("all"), *(F.count_if(c).alias(k) for k, c in lacks.items()))
    out = row.select("all", F.explode(F.array(*(F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k in lacks))).alias("x")).select("all", "x.*")
    return out.select("item", "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("all").cast("double")), F.lit(0.0)), 2).alias("pct"))


def id_integrity(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """rows, null_ids, duplicated_ids, redundant_rows."""
    by = rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    many = F.col("id").isNotNull() & (F.col("n") > 1)
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("null_ids"),
        F.count_if(many).alias("duplicated_ids"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("redundant_rows"),
    )


def duplicate_titles(records: DataFrame) -> DataFrame:
    """(grouping, groups, redundant): titles as they are, folded, and folded with the year."""
    rows = records.where(stripped(F.col("title")) != "").select("id", stripped(F.col("title")).alias("exact"), normalise_title(F.col("title")).alias("normalised"), stripped(F.col("release_date")).alias("date"))
    keys = F.array(
        F.struct(F.lit("exact").alias("grouping"), F.col("exact").alias("key"), F.lit("").alias("year")),
        F.struct(F.lit("normalised").alias("grouping"), F.col("normalised").alias("key"), F.lit("").alias("year")),
        F.struct(F.lit("normalised_year").alias("grouping"), F.col("normalised").alias("key"), F.when(F.col("date").rlike(DATE), F.substring("date", 1, 4)).alias("year")),
    )
    flat = rows.select("id", F.explode(keys).alias("k")).select("id", "k.*").where("year is not null").distinct()
    groups = flat.groupBy("grouping", "key", "year").agg(F.count("*").alias("n"))
    return groups.groupBy("grouping").agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("redundant"))


def text_quality(records: DataFrame) -> DataFrame:
    """placeholders, stubs, prose, junk_titles, numeric_titles."""
    o, t = stripped(F.col("overview")), stripped(F.col("title"))
    placeholder = (o != "") & F.lower(o).rlike(PLACEHOLDER)
    return records.agg(
        F.count_if(placeholder).alias("placeholders"), F.count_if((o != "") & ~placeholder & (F.length(o) < SHORT_OVERVIEW)).alias("stubs"),
        F.count_if((o != "") & ~placeholder & (F.length(o) >= SHORT_OVERVIEW)).alias("prose"), F.count_if(F.lower(t).rlike(JUNK_TITLE)).alias("junk_titles"), F.count_if(t.rlike(NUMERIC_TITLE)).alias("numeric_titles"),
    )


def usability(records: DataFrame) -> DataFrame:
    """full, core, minimal: records that have what each tier asks for."""
    p = presence(records)
    minimal = F.col("has_id") & F.col("has_title")
    core = minimal & F.col("has_date") & F.col("has_genres") & F.col("has_cast")
    full = core & F.col("has_prose") & F.col("has_keywords") & (F.col("n_directors") > 0)
    return p.agg(F.count_if(full).alias("full_tier"), F.count_if(core).alias("core_tier"), F.count_if(minimal).alias("minimal_tier"))


def _exclusive(n: Column, parts: int, i: int) -> tuple[Column, Column, Column]:
    """Places (from 0) of the two values around the i-th of parts quantiles, and the weight of the second."""
    at = F.lit(i) * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(at / parts), n - 1))
    return j - 1, j, (at - j * parts) / F.lit(float(parts))


def describe(rows: DataFrame, value: str) -> DataFrame:
    """n, min, p25, median, mean, p75, p95, max, to two digits. Quantiles are exclusive, at (n + 1)p: quarters from four
    values on, the 95th percentile from twenty on, else null."""
    known = rows.where(F.col(value).isNotNull())
    n = known.agg(F.count("*")).scalar()
    places = value_places(known, value).withColumn("all", n)
    at = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col("value")))
    a = F.col("all")
    picks = {"q1": _exclusive(a, 4, 1), "q3": _exclusive(a, 4, 3), "q95": _exclusive(a, 20, 19), "mid": (F.floor((a - 1) / 2), F.floor(a / 2), F.lit(0.5))}
    wanted = [x for k, (lo, hi, w) in picks.items() for x in (at(lo).alias(f"{k}_lo"), at(hi).alias(f"{k}_hi"), F.max(w).alias(f"{k}_w"))]
    row = places.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), *wanted)
    between = lambda k: F.col(f"{k}_lo") * (1 - F.col(f"{k}_w")) + F.col(f"{k}_hi") * F.col(f"{k}_w")
    two = lambda c: F.round(c, 2)
    return row.select(
        "n", two(F.col("min")).alias("min"), F.when(F.col("n") > 3, two(between("q1"))).alias("p25"), two(between("mid")).alias("median"), two(F.col("mean")).alias("mean"),
        F.when(F.col("n") > 3, two(between("q3"))).alias("p75"), F.when(F.col("n") > 19, two(between("q95"))).alias("p95"), two(F.col("max")).alias("max"),
    )


def distribution(records: DataFrame, kind: str, order: str = "id") -> DataFrame:
    """(value, n, first) of genres, keywords, years, languages or crew jobs; first is where a value first occurs, by a column and the place in its list."""
    listed = {"genre": lambda: names(F.col("genres")), "keyword": lambda: names(F.col("keywords")), "job": lambda: F.filter(F.transform("crew", lambda c: c["job"]), lambda j: j != "")}
    single = {"year": lambda: F.when(stripped(F.col("release_date")).rlike(DATE), F.substring(stripped(F.col("release_date")), 1, 4)), "language": lambda: F.col("original_language")}
    values = listed[kind]() if kind in listed else F.array(single[kind]())
    rows = records.select(F.col(order).alias("_order"), F.posexplode(values).alias("_pos", "value")).where("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("_order", "_pos")).alias("first"))


def most_common(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values; of equally frequent ones those that occur first."""
    return counts.orderBy(F.desc("n"), "first", "value").limit(n)


def structure(records: DataFrame) -> DataFrame:
    """One row: distinct_genres, distinct_keywords, single_keywords (those of one record's list only), adult, in_collection, several_directors."""
    p = presence(records)
    keywords = distribution(records, "keyword")
    distinct = lambda kind: distribution(records, kind).agg(F.count("*")).scalar()
    out = p.agg(F.count_if(F.coalesce("adult", F.lit(False))).alias("adult"), F.count_if(F.col("collection_name").isNotNull()).alias("in_collection"), F.count_if(F.col("n_directors") > 1).alias("several_directors"))
    return out.select(distinct("genre").alias("distinct_genres"), distinct("keyword").alias("distinct_keywords"), keywords.agg(F.count_if(F.col("n") == 1)).scalar().alias("single_keywords"), "adult", "in_collection", "several_directors")


def list_sizes(records: DataFrame) -> DataFrame:
    """(measure, and describe()'s columns) of the lengths of keyword, cast and genre lists that aren't empty, and of running times over 0."""
    cast = F.transform(F.coalesce("cast", F.array().cast("array<struct<order:int,flag:boolean,name:string>>")), lambda c: c["name"])
    sizes = {"keywords": F.size(names(F.col("keywords"))), "cast": F.size(names(cast)), "genres": F.size(names(F.col("genres"))), "runtime": F.col("runtime")}
    rows = [describe(records.select(F.when(c > 0, c.cast("double")).alias("v")), "v").select(F.lit(k).alias("measure"), "*") for k, c in sizes.items()]
    return reduce(DataFrame.unionByName, rows)


def cast_order(records: DataFrame) -> DataFrame:
    """credited, ordered, ascending: records with credits, with whole-numbered orders for all, and with those ascending."""
    has = F.size(F.coalesce("cast", F.array().cast("array<struct<order:int,flag:boolean,name:string>>"))) > 0
    whole = has & F.forall("cast", lambda c: c["order"].isNotNull())
    orders = F.transform("cast", lambda c: c["order"])
    return records.agg(F.count_if(has).alias("credited"), F.count_if(whole).alias("ordered"), F.count_if(whole & (orders == F.array_sort(orders))).alias("ascending"))
