"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import delete, make_dir, scratch, scratch_scope, settled, shared_dir, written

__all__ = ["delete", "make_dir", "scratch", "scratch_scope", "settled", "shared_dir", "written"]

#: Bytes of a batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df with its lineage cut at files in the shared folder, at most `parts` of them, as it is small for more."""
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Has the session send at most BATCH_BYTES to a Python worker at once, unless it asks for less already; a
    longer row goes alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """df, dealt by `column` already, as scratch: a file a bucket, and where it was dealt to more partitions than there
    are buckets, no more files than their square. The table that Spark reads it by stands in the shared folder as other
    scratch does."""
    return bucketed_from(df.sparkSession, lambda: df, buckets, column)


def bucketed_from(spark: SparkSession, build: Callable[[], DataFrame], buckets: int, column: str) -> DataFrame:
    """What build() returns, as bucketed() keeps it; the scratch that build() makes itself is deleted."""
    name = f"quire_scratch_{uuid.uuid4().hex}"
    path = scratch(spark, "buckets", name)
    with scratch_scope(spark):
        build().coalesce(buckets).write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


def released() -> None:
    """Hands a Python worker's free memory back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function of batches, with the memory handed back that its task took."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def parts_for(rows: int, rows_per_part: int, least: int) -> int:
    """How many partitions keep each near rows_per_part rows, however many rows there are."""
    return max(least, math.ceil(rows / rows_per_part))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
