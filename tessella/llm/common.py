"""Helpers that the corpus operators share: byte-level words, shared storage, bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a space. Bytes of 0x80 and more
#: (every byte of a non-ASCII character in UTF-8) stay.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Rows and bytes in an Arrow batch: texts may be long, so a batch must not hold many of them. A row that is larger comes alone.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: Entries of a worker's memo of words before it is emptied (some 20 MB).
MEMO_ENTRIES = 100_000


_owner, _release = "", None


def owns_memory(name: str, release) -> None:
    """Workers live on from one operator to the next: before another one starts, what the last one kept is let go."""
    global _owner, _release
    if name != _owner:
        if _release:
            _release()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _owner, _release = name, release


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, unless someone set less.

    Plans read these settings when they run, after the operator has returned, so they stay set for the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key, None)).lower().removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, computed once while it stays in the memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 over uint64, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Workspace:
    """Tables of one operator call, in the shared folder that spark.checkpoint.dir names.

    A written table cuts the lineage and outlives lost executors. Only in local mode, and only where
    the setting is missing, a folder of this machine takes its place.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tessella-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table of this workspace and return the table."""
        df.write.parquet(f"{self.root}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def only(self, *names: str) -> None:
        """Delete all tables but these."""
        for name in self.names:
            if name not in names:
                self.drop(name)
        self.names = [n for n in self.names if n in names]

    def drop(self, name: str) -> None:
        """Delete a table once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
