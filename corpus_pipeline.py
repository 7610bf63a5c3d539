"""Documents in, token ids out: five stages, each written as Parquet before the next one reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A table with no rows, nulls, repeated rows or further columns passes as its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import digests
from tessella.llm.common import Workspace, read
from tessella.llm.decontam import without_contaminated
from tessella.llm.neardup import without_near_duplicates
from tessella.llm.pii import redact_personal_data
from tessella.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the row with its smallest id; rows are judged by their own texts."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced; n_chars follows the text."""
    out = redact_personal_data(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes that they decode to."""
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]
#: SQL can't express the trained stages; tests hold each stage against its operator's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what a stage leaves is deleted once the stage after it is written."""
    ws = Workspace(spark, "pipeline")
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        if last:
            ws.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
