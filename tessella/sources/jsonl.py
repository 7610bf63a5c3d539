"""JSON Lines: raw scans that never fail, strict scans of what was written here, and the sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import gates
from tessella.functions.text import stripped

#: A raw record once its types are gated. Names of genres and keywords keep their order.
RECORD = (
    "id long, title string, original_title string, overview string, genres array<string>, keywords array<string>, "
    "cast array<struct<order:int,flag:boolean,name:string>>, crew array<struct<job:string,name:string>>, collection_name string, "
    "release_date string, runtime int, original_language string, popularity double, vote_average double, vote_count double, adult boolean"
)

#: A feature record, as written and read back.
FEATURES = (
    "id long, title string, original_title string, release_date string, release_year int, original_language string, runtime_minutes int, "
    "collection_name string, popularity double, vote_average double, vote_count double, adult boolean, "
    "tokens struct<overview:array<string>,keywords:array<string>,genres:array<string>,cast:array<string>,director:array<string>>, "
    "document array<string>, document_size int, stinger_keywords_removed array<string>"
)


def _splits(lines: DataFrame, size: Column) -> DataFrame:
    """(source, block, first, before): for each split of each file its first line's place and the sum of size over the splits before it."""
    blocks = lines.groupBy("source", "block").agg(F.sum(size).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    return blocks.select("source", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")]
    return spark.read.options(**options).text(path).select(*place, F.monotonically_increasing_id().alias("at"), "value")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, value): the lines of one or many text files, numbered from 1 within each.

    Numbers come from the place of each split in its file and a count for each split, so neither
    an RDD nor one task for all lines is needed.
    """
    lines = _lines(spark, path).drop("size")
    numbered = lines.join(_splits(lines, F.lit(1)), ["source", "block"])
    return numbered.select("source", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with record (variant) and error; blank lines are left out."""
    record = F.try_parse_json(F.col(value))
    rows = lines.where(F.length(F.regexp_replace(F.col(value), r"[\s\x1c-\x1f\x85\p{Z}]+", "")) > 0).withColumn("record", record)
    error = F.when(F.col("record").isNull(), F.lit("json_decode_error")).when(~gates.is_object(F.col("record")), F.lit("record_is_not_an_object"))
    return rows.withColumn("error", error)


def typed(rows: DataFrame) -> DataFrame:
    """Adds the gated fields of RECORD to parsed rows. Whole numbers beyond a field's range are null, like any wrong type."""
    v = F.col("record")
    get = lambda name: gates.part(v, name)
    names = lambda name: F.transform(gates.objects(get(name)), lambda o: gates.string(gates.part(o, "name")))
    text = F.coalesce(gates.string(get("overview")), F.try_variant_get(v, "$.overview", "string"))
    cast = F.transform(gates.objects(get("cast")), lambda o: F.struct(gates.integer(gates.part(o, "order")).try_cast("int").alias("order"), gates.boolean(gates.part(o, "order")).alias("flag"), gates.string(gates.part(o, "name")).alias("name")))
    crew = F.transform(gates.objects(get("crew")), lambda o: F.struct(gates.string(gates.part(o, "job")).alias("job"), gates.string(gates.part(o, "name")).alias("name")))
    collection = stripped(gates.string(gates.part(get("belongs_to_collection"), "name")))
    fields = {
        "id": gates.coerced_id(get("id")), "title": gates.string(get("title")), "original_title": gates.string(get("original_title")), "overview": text,
        "genres": names("genres"), "keywords": names("keywords"), "cast": cast, "crew": crew, "collection_name": F.nullif(collection, F.lit("")),
        "release_date": gates.string(get("release_date")), "runtime": gates.integer(get("runtime")).try_cast("int"), "original_language": gates.string(get("original_language")),
        "popularity": gates.number(get("popularity")), "vote_average": gates.number(get("vote_average")), "vote_count": gates.number(get("vote_count")),
        "adult": F.coalesce(gates.boolean(get("adult")), F.lit(False)),
    }
    return rows.withColumns(fields)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Feature records from JSON Lines; a line that isn't one fails the read."""
    return spark.read.schema(FEATURES).option("mode", "FAILFAST").json(path)


def write_corpus(features: DataFrame, path: str) -> None:
    """Feature records as Parquet, the main store."""
    features.write.mode("overwrite").parquet(path)


def export_jsonl(features: DataFrame, path: str, order: str = "id") -> None:
    """Feature records as JSON Lines, sorted by a key over range-partitioned files, nulls kept and keys sorted."""
    columns = sorted(features.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    features.repartitionByRange(order).sortWithinPartitions(order).select(text).write.mode("overwrite").text(path)


#: Bytes of a leaf of a digest's tree, and digests that one node above the leaves stands for.
LEAF_BYTES, FAN = 1 << 20, 4096


def content_digest(spark: SparkSession, path: str, leaf: int = LEAF_BYTES, fan: int = FAN) -> DataFrame:
    """(path, length, digest) of text files of any size: a tree of SHA-256.

    A file's bytes are cut in ranges of leaf bytes; each range's SHA-256 is a leaf. fan digests in a row, joined as bytes, are hashed to one above them, until one is left; a file of one range
    has that range's digest, an empty file SHA-256 of nothing. Where splits or lines end makes no difference. No task holds more than a leaf's lines, a split's lines in
    order (as a stream) or fan digests. Lines end with a line feed; a single line has to fit a row.
    """
    files = spark.read.format("binaryFile").load(path)
    lines = _lines(spark, path, lineSep="\n")
    lines = lines.withColumn("bytes", F.col("value").cast("binary")).drop("value")
    run = Window.partitionBy("source", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a split's lines, one after the other
    size = F.octet_length("bytes") + F.lit(1)
    begun = lines.withColumn("inside", F.coalesce(F.sum(size).over(run), F.lit(0))).join(_splits(lines, size).drop("first"), ["source", "block"])
    start = F.col("before") + F.col("inside")
    ended = F.when(start + F.octet_length("bytes") < F.col("size"), F.concat("bytes", F.lit(b"\n"))).otherwise(F.col("bytes"))
    begun = begun.select(F.struct("source", "size").alias("source"), start.alias("start"), ended.alias("bytes")).where(F.octet_length("bytes") > 0)
    stop = F.col("start") + F.octet_length("bytes") - 1
    ranges = begun.withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / leaf), F.floor(stop / leaf))))
    lo, hi = F.greatest(F.col("start"), F.col("range") * leaf), F.least(stop + 1, (F.col("range") + 1) * leaf)
    part = F.substring("bytes", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    # a leaf's pieces come together in the order of their places, at most leaf bytes
    node = ranges.select("source", "range", F.struct(lo.alias("lo"), part.alias("part")).alias("p")).groupBy("source", "range").agg(F.array_sort(F.collect_list("p")).alias("p"))
    node = node.select("source", "range", F.unhex(F.sha2(F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["part"])), 256)).alias("digest"))
    longest = files.agg(F.max("length")).first()[0] or 0  # of lengths alone: the contents aren't read
    n = -(-longest // leaf)
    while n > 1:
        pick = F.struct("range", "digest")
        up = node.select("source", F.floor(F.col("range") / fan).alias("above"), pick.alias("p")).groupBy("source", "above").agg(F.array_sort(F.collect_list("p")).alias("p"))
        joined = F.unhex(F.sha2(F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["digest"])), 256))
        node = up.select("source", F.col("above").alias("range"), F.when((F.size("p") == 1) & (F.col("above") == 0), F.col("p")[0]["digest"]).otherwise(joined).alias("digest"))
        n = -(-n // fan)
    found = node.select("source.source", "source.size", F.lower(F.hex("digest"))).toDF("path", "length", "digest")
    # scans leave empty files out; the driver has every name anyway, as it plans the scan
    key = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")  # local paths are written with one slash or three
    names = spark.createDataFrame([(x,) for x in files.inputFiles()], "path string").withColumn("key", key)
    both = names.join(found.select(key.alias("key"), "length", "digest"), "key", "left")
    return both.select("path", F.coalesce("length", F.lit(0).cast("long")).alias("length"), F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))


def manifest_digest(manifest: dict) -> str:
    """SHA-256 of a manifest as JSON with sorted keys; times aren't part of one."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


#: A file of feature records under this size is a wrong path or an error page.
LEAST_BYTES = 65_536


class UnusableCorpus(ValueError):
    """A corpus artefact that isn't one, with the reason."""


def validate_corpus(features: DataFrame, least_rows: int = 1) -> DataFrame:
    """One row: rows, complete (those with an id, a title and tokens), and whether the artefact is usable: all are, and they are enough."""
    whole = F.count_if(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("tokens").isNotNull()).alias("complete")
    out = features.agg(F.count("*").alias("rows"), whole)
    return out.withColumn("usable", (F.col("rows") >= least_rows) & (F.col("rows") == F.col("complete")))


def validate_files(spark: SparkSession, path: str, least_bytes: int = LEAST_BYTES) -> tuple[int, str]:
    """(records, digest) of JSON Lines on storage, or UnusableCorpus: too small, no records, a line that isn't an object, or one without
    id, title or tokens. Every line is looked at. The digest is that of the files' digests, in the order of their paths."""
    files = content_digest(spark, path).orderBy("path").select("length", "digest").collect()  # one row for each file
    if sum(f.length for f in files) < least_bytes:
        raise UnusableCorpus(f"{path} holds {sum(f.length for f in files)} bytes, under {least_bytes}: too little for a corpus")
    record = F.col("record")
    missing = F.concat_ws(", ", *(F.when(gates.part(record, f).isNull(), f) for f in ("id", "title", "tokens")))
    rows = parsed(spark.read.text(path)).withColumn("error", F.coalesce("error", F.when(missing != "", F.concat(F.lit("misses "), missing))))
    found = rows.agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.min("error").alias("why")).first()
    if not found.n:
        raise UnusableCorpus(f"{path} holds no records")
    if found.bad:
        raise UnusableCorpus(f"{path}: {found.bad} of {found.n} lines are no feature records ({found.why})")
    return found.n, hashlib.sha256("\n".join(f.digest for f in files).encode()).hexdigest()
