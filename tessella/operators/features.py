"""Raw records to feature records: five token blocks and the document that they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import canonical_phrase, folded, nfc, phrase_token, squeezed, stripped, tokens, year_of
from tessella.plans.config import FIELDS, PREFIXES, STINGERS, Config


def _strings() -> Column:
    return F.array().cast("array<string>")


def overview_block(overview: Column, config: Config) -> Column:
    """Prose of enough characters; a stub gives nothing."""
    f = config.fields["overview"]
    found = tokens(folded(overview, config), config, f.min_token_length, f.drop_function_words)
    return F.when(F.length(stripped(overview)) >= config.min_overview_chars, found).otherwise(_strings())


def _labels(values: Column, config: Config) -> Column:
    """Labels joined, normalised together and split again, so that composition needs one call for each row.

    The mark between them may stand in a label of JSON too; there it is a space, as it separates words like one.
    """
    mark = "\x00"
    joined = F.array_join(F.transform(values, lambda v: F.translate(F.coalesce(v, F.lit("")), mark, " ")), mark)
    text = F.lower(joined)
    if config.unicode_form == "NFC":
        text = F.lower(nfc(joined))
    return F.when(F.size(values) > 0, F.split(text, mark)).otherwise(_strings())


def keyword_block(values: Column, config: Config) -> tuple[Column, Column]:
    """(tokens, removed labels): each label one token, without the stingers, which are sorted apart."""
    stingers = F.array(*(F.lit(s) for s in STINGERS))
    phrases = F.transform(_labels(values, config), canonical_phrase)
    is_stinger = lambda p: F.array_contains(stingers, F.replace(p, F.lit(" "), F.lit("")))
    kept = F.filter(phrases, lambda p: ~is_stinger(p))
    out = F.flatten(F.transform(kept, lambda p: phrase_token(p, config.fields["keywords"].min_token_length)))
    return F.array_distinct(out), F.array_sort(F.array_distinct(F.filter(phrases, is_stinger)))


def genre_block(values: Column, config: Config) -> Column:
    return F.array_distinct(F.flatten(F.transform(_labels(values, config), lambda v: phrase_token(squeezed(v), config.fields["genres"].min_token_length))))


def cast_block(cast: Column, config: Config) -> Column:
    """The first credits by billing (a whole-numbered order, or else the place), their names' tokens, each once."""
    f = config.fields["cast"]
    billed = F.array_sort(F.transform(cast, lambda c, i: F.struct(F.coalesce(F.when(c["flag"].isNull(), c["order"]), i).alias("o"), i.alias("i"), c["name"].alias("name"))))
    return _names(F.slice(billed, 1, f.top_k) if f.top_k is not None else billed, config, f.min_token_length)


def director_block(crew: Column, config: Config) -> Column:
    """Directors by name, the first few credits, their names' tokens, each once."""
    f = config.fields["director"]
    named = F.array_sort(F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"))))
    return _names(F.slice(named, 1, f.top_k) if f.top_k is not None else named, config, f.min_token_length)


def _names(entries: Column, config: Config, min_length: int) -> Column:
    names = _labels(F.transform(entries, lambda c: c["name"]), config)
    return F.array_distinct(F.flatten(F.transform(names, lambda n: tokens(squeezed(n), config, min_length))))


def feature_records(records: DataFrame, config: Config) -> DataFrame:
    """One row for each record with an id: its fields, its tokens by block, and the document that they form."""
    keywords, removed = keyword_block(F.col("keywords"), config)
    blocks = records.where("id is not null").withColumns({
        "_overview": overview_block(F.col("overview"), config), "_keywords": keywords, "_removed": removed, "_genres": genre_block(F.col("genres"), config),
        "_cast": cast_block(F.col("cast"), config), "_director": director_block(F.col("crew"), config),
    })
    prefixed = lambda f: F.transform(F.col(f"_{f}"), lambda t: F.concat(F.lit(f"{PREFIXES[f]}:"), t))
    document = F.concat(*(prefixed(f) for f in FIELDS))
    return blocks.select(
        "id", "title", "original_title", "release_date", year_of(F.col("release_date")).alias("release_year"), "original_language",
        F.when(F.col("runtime") > 0, F.col("runtime")).alias("runtime_minutes"), "collection_name", "popularity", "vote_average", "vote_count", F.coalesce("adult", F.lit(False)).alias("adult"),
        F.struct(*(F.coalesce(F.col(f"_{f}"), _strings()).alias(f) for f in FIELDS)).alias("tokens"),
        document.alias("document"), F.size(document).alias("document_size"), F.coalesce("_removed", _strings()).alias("stinger_keywords_removed"),
    )


def first_of_each_id(rows: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Rows with an id, of several with one id the first in order. A partial aggregate, so a hot id gathers nowhere."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.where("id is not null").groupBy("id").agg(first.alias("_first")).select("_first.*")


def load_report(rows: DataFrame) -> DataFrame:
    """One row: lines_total, records_parsed, malformed, invalid_id, duplicate_id, kept. Bad ids count before duplicates."""
    good = F.col("error").isNull()
    ids = rows.groupBy("id").agg(
        F.count("*").alias("lines"), F.count_if(good).alias("parsed"), F.count_if(~good).alias("malformed"), F.count_if(good & F.col("id").isNull()).alias("invalid")
    )
    valid = F.when(F.col("id").isNotNull(), F.col("parsed")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = ids.agg(total("lines").alias("lines_total"), total("parsed").alias("records_parsed"), total("malformed").alias("malformed"), total("invalid").alias("invalid_id"), total(F.greatest(valid - 1, F.lit(0))).alias("duplicate_id"))
    return out.withColumn("kept", F.expr("records_parsed - invalid_id - duplicate_id"))


def token_statistics(features: DataFrame) -> DataFrame:
    """(field, n_tokens, share_pct, empty_blocks, mean_tokens) for each block."""
    sizes = features.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(f"tokens.{f}").alias("n")) for f in FIELDS))).alias("b")).select("b.field", "b.n")
    by = sizes.groupBy("field").agg(F.sum("n").alias("n_tokens"), F.count_if(F.col("n") == 0).alias("empty_blocks"), F.count("*").alias("items"))
    every = Window.partitionBy()  # five rows
    share = F.coalesce(F.try_divide(F.col("n_tokens") * 100.0, F.sum("n_tokens").over(every).cast("double")), F.lit(0.0))
    return by.select("field", "n_tokens", F.round(share, 2).alias("share_pct"), "empty_blocks", F.round(F.try_divide(F.col("n_tokens").cast("double"), F.col("items").cast("double")), 4).alias("mean_tokens"))


#: Rows that a stratum gives at a time while a sample is topped up. A fixed value.
TOP_UP = 50


def stratum_shares(sizes: DataFrame, stratum: str, target: int) -> DataFrame:
    """(stratum, keep): how many rows each stratum of (stratum, size) gives to a sample of target rows.

    First each gives its quota, ceil(target / strata), or all that it has. What is missing comes in steps of TOP_UP from whichever stratum has most left at that
    time, ties to the smaller stratum; the last step is cut to what is missing. A stratum's steps have falling remainders, so the steps taken are
    the first ones of all in the order of their remainders, and only as many as the target could need are ordered at all.
    """
    strata = sizes.agg(F.count("*")).scalar()
    quota = sizes.withColumn("_taken", F.least("size", F.ceil(F.lit(float(target)) / strata)))
    need = F.lit(target) - F.coalesce(quota.agg(F.sum("_taken")).scalar(), F.lit(0))
    most = -(-target // TOP_UP)
    left = F.col("size") - F.col("_taken")
    steps = quota.where(left > 0).select(stratum, left.alias("_left"), F.explode(F.sequence(F.lit(0), F.least(F.ceil(left / TOP_UP), F.lit(most)) - 1)).alias("_step"))
    steps = steps.withColumn("_left", F.col("_left") - F.col("_step") * TOP_UP).orderBy(F.desc("_left"), stratum).limit(most)
    before = Window.orderBy(F.desc("_left"), stratum).rowsBetween(Window.unboundedPreceding, -1)  # target / TOP_UP rows
    steps = steps.withColumn("_n", F.least("_left", F.lit(TOP_UP))).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    more = steps.withColumn("_n", F.greatest(F.least("_n", need - F.col("_before")), F.lit(0))).groupBy(F.col(stratum).alias("_of")).agg(F.sum("_n").alias("_more"))
    return quota.join(more, F.col(stratum).eqNullSafe(F.col("_of")), "left").select(stratum, (F.col("_taken") + F.coalesce("_more", F.lit(0))).alias("keep"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, target: int, seed: int) -> DataFrame:
    """About target rows: from each stratum what stratum_shares() says, in the order of the MD5 of "key:seed".

    So a plan is the same on every run, every partitioning and every engine. Rows are unique by key; a null stratum is one of its own. Draws are counted by their first four digits, and only the rows
    up to the digits at which a stratum has given enough are ranked: its share, and one part in 65,536 of it.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = rows.dropDuplicates([key]).withColumn("_draw", draw).withColumn("_digits", F.substring("_draw", 1, 4))
    digits = rows.groupBy(stratum, "_digits").agg(F.count("*").alias("_n"))
    shares = stratum_shares(digits.groupBy(stratum).agg(F.sum("_n").alias("size")), stratum, target).withColumnRenamed(stratum, "_of")
    earlier = Window.partitionBy(stratum).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows
    digits = digits.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    open_ = digits.join(shares, F.col(stratum).eqNullSafe(F.col("_of"))).where("_earlier < keep").select("_of", F.col("_digits").alias("_at"), "_earlier", "keep")
    few = rows.join(open_, F.col(stratum).eqNullSafe(F.col("_of")) & (F.col("_digits") == F.col("_at")))
    # earlier digits hold _earlier rows, so a row's rank starts from there
    place = F.row_number().over(Window.partitionBy("_of", "_at").orderBy("_draw", key)) + F.col("_earlier")
    return few.withColumn("_place", place).where("_place <= keep").drop("_draw", "_digits", "_of", "_at", "_earlier", "keep", "_place")


def project_record(rows: DataFrame, cast_limit: int, jobs: tuple[str, ...] = ("Director", "Screenplay", "Story")) -> DataFrame:
    """Records with only the sub-fields in use: the first credits, and crew in a few jobs. A record without an id goes."""
    return rows.where("id is not null").withColumn("cast", F.slice("cast", 1, cast_limit)).withColumn("crew", F.filter("crew", lambda c: c["job"].isin(*jobs)))
