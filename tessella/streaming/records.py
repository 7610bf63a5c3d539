"""Feature records from files as they arrive. Every step looks at one line only, so a stream gives what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.features import feature_records
from tessella.plans.config import Config
from tessella.sources.jsonl import parsed, typed


def stream_features(spark: SparkSession, folder: str, config: Config, files_per_batch: int = 100) -> DataFrame:
    """Feature records of the JSON Lines files that come into a folder. Duplicates are for the reader of the sink: which of
    two files is first isn't known while both may still arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return feature_records(typed(parsed(lines).where(F.col("error").isNull())), config)


def write_features(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet table, takes all there is and ends."""
    return features.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
