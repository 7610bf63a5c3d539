"""Intermediate tables: written once, read by every step that follows, with a short lineage that outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that shuffled files go as soon as the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of its own under spark.checkpoint.dir. In local mode without that setting, a temporary folder of this machine."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tessella-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"
        self.used = 0

    def count(self) -> int:
        """A number that no earlier call gave, for names of tables."""
        self.used += 1
        return self.used

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """df as a written table, in a folder for each value of by. What was shuffled for it is deleted with the write, nothing else reads it."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*by).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """One table, once nothing reads it any more."""
        self._delete(f"{self.root}/{name}")

    def delete(self) -> None:
        """All tables, once nothing reads them any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
