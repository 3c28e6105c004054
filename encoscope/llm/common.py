"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs neither repeat nor lose it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "4m"):
    """Arrow batches of so many bytes for the jobs that run inside: rows of long texts otherwise fill 64 MB ones."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffles_dropped(spark: SparkSession):
    """Jobs that run inside remove their shuffle files when they end, not when the driver collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Enough partitions for a bounded number of rows in each, and at least the session's number."""
    return max(shuffle_parts(spark), math.ceil(rows / rows_per_part))


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def row_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a binary ``column`` hold about ``limit`` bytes, one row at least."""
    values = batch.column(column)
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
        if i > start and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def merged_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until they hold ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
