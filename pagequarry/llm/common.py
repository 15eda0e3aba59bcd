"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import new_dir

#: Rows handled at a time inside a task; bounds the Python objects alive at once.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own setting that drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage and survives lost executors.

    What was shuffled for the table is not needed once it is written, so it does not pile up on the disks.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; NULL ids fall into no bucket."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most ``rows`` rows; empty ones are skipped."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128-bit hashes of words: an ``(n, 2)`` array of unsigned 64-bit halves."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, words)), "<u8").reshape(-1, 2)


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, modulo 2**64."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    factor = np.uint64(base)
    with np.errstate(over="ignore"):
        for at in range(size):
            out *= factor
            out += hashes[at : at + count]
        # spread the high bits, so that ordering by the value is not ordering by the last word
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
