"""Two catalogues of raw records over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.config import Config
from tessella.sources.jsonl import RECORD

#: Settings of the two catalogues: part texts are short ASCII names.
DOC_CONFIG = Config()
PART_CONFIG = Config(unicode_form=None, min_overview_chars=0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    """df's columns as RECORD; what isn't given is null."""
    fields = T.StructType.fromDDL(RECORD).fields
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def documents_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the text is the overview, the language a genre, the source a director, labels are keywords, and exact copies a collection."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    first = F.split("text", "\n", 2)[0]
    tagged = F.array(F.concat(F.lit("quality "), F.col("quality")), F.concat(F.lit("toxic "), F.col("toxic")))
    return _record(
        docs, id=F.col("doc_id"), title=first, original_title=first, overview=F.col("text"), genres=F.array("lang"), keywords=F.filter(tagged, lambda k: k.isNotNull()),
        cast=F.array().cast("array<struct<order:int,flag:boolean,name:string>>"), crew=F.array(F.struct(F.lit("Director").alias("job"), F.col("source").alias("name"))),
        collection_name=F.sha2("text", 256), original_language=F.col("lang"), popularity=F.col("n_chars"), adult=F.lit(False),
    )


def parts_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: name and type are the overview, type a genre, size a keyword, suppliers by quantity the cast, the brand a director."""
    lines = table(spark, sf_dir, "lineitem")
    sold = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.min("l_shipdate").alias("first"))
    order = Window.partitionBy("l_partkey").orderBy(F.desc("quantity"), "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.replace("s_name", F.lit("Supplier#"), F.lit("s")).alias("name"))
    sold = sold.withColumn("order", F.row_number().over(order) - 1).join(suppliers, "l_suppkey")
    credits = sold.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.array_sort(F.collect_list(F.struct("order", F.lit(None).cast("boolean").alias("flag"), "name"))).alias("cast"), F.sum("quantity").alias("popularity"), F.sum("n").alias("votes"), F.min("first").alias("first")
    )
    parts = table(spark, sf_dir, "part").join(credits, "p_partkey", "left")
    return _record(
        parts, id=F.col("p_partkey"), title=F.col("p_name"), original_title=F.concat_ws(" ", "p_brand", "p_name"), overview=F.concat_ws(" ", "p_name", "p_type"), genres=F.array("p_type"),
        keywords=F.array(F.concat(F.lit("size "), F.col("p_size"))), cast=F.coalesce("cast", F.array().cast("array<struct<order:int,flag:boolean,name:string>>")),
        crew=F.array(F.struct(F.lit("Director").alias("job"), F.translate("p_brand", "#", "").alias("name"))), collection_name=F.concat_ws(" ", "p_brand", "p_type"),
        popularity=F.col("popularity"), vote_count=F.col("votes"), release_date=F.date_format("first", "yyyy-MM-dd"), adult=F.lit(False),
    )
