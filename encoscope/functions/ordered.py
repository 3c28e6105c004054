"""Ordered operations without a single-task global window.

Rows are cut into blocks of consecutive order values. Each block is handled by its own window
partition, and only one summary row per block goes through the ordered pass over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.functions.lookups import lookup_join

BLOCK_BITS = 16


# A block of more than so many times the wanted rows is cut again.
OVERFULL = 4


def block_bits(df: DataFrame, order: str, rows: int = 1 << BLOCK_BITS) -> int:
    """Block width in bits that gives about ``rows`` rows per block, from the spread of the ids.

    Dense ids get 16 bits. One pass over the id column.
    """
    found = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    if not found["n"]:
        return BLOCK_BITS
    return _width(found["low"], found["high"], found["n"], rows)


def _width(low: int, high: int, n: int, rows: int) -> int:
    return min(62, max(1, math.ceil(math.log2(max(1.0, (high - low + 1) / n) * rows))))


def blocked(df: DataFrame, order: str, bits: int | None = None, rows: int = 1 << BLOCK_BITS) -> DataFrame:
    """Adds ``_block``, an array that sorts like ``order`` and is shared by about ``rows`` neighbours.

    Ids are cut evenly first. Blocks that are over-full, because ids crowd there, are cut again by
    their own spread until none is; only the ends and counts of such blocks are looked at.
    """
    if bits is not None:
        return df.withColumn("_block", F.array(F.shiftright(F.col(order).cast("long"), bits)))
    value = F.col(order).cast("long")
    out = df.withColumn("_block", F.array(F.shiftright(value, block_bits(df, order, rows))))
    while True:
        ends = out.groupBy("_block").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
        crowded = ends.where((F.col("_n") > OVERFULL * rows) & (F.col("_high") > F.col("_low")))
        found = crowded.collect()  # one row for each OVERFULL * rows rows at most
        if not found:
            return out
        cuts = [(r["_block"], r["_low"], _width(r["_low"], r["_high"], r["_n"], rows)) for r in found]
        if all(2**width > r["_high"] - r["_low"] for r, (_, _, width) in zip(found, cuts)):
            return out  # more rows than ids: repeated ids, which the numbering refuses
        table = df.sparkSession.createDataFrame(cuts, "_block array<bigint>, _low long, _bits int")
        out = lookup_join(out, table, "_block")
        part = F.coalesce(F.call_function("shiftright", value - F.col("_low"), F.col("_bits")), F.lit(0).cast("long"))
        out = out.withColumn("_block", F.concat("_block", F.array(part))).drop("_low", "_bits")


def _checked(order: str, within) -> Column:
    """The order value; one that comes twice is an error."""
    twice = F.lag(order).over(within) == F.col(order)
    return F.when(twice, F.raise_error(F.lit(f"{order} must be unique")).cast("long")).otherwise(F.col(order).cast("long"))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def dense_index(
    df: DataFrame, order: str, keys: Sequence[str] = (), out: str = "idx", bits: int | None = None
) -> DataFrame:
    """0-based position of each row by an integer column, within ``keys`` or overall.

    A value of ``order`` that comes twice within ``keys`` is an error.
    """
    rows = blocked(df, order, bits)
    starts = (
        rows.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    place = (F.col("_start") + F.row_number().over(within) - 1).cast("long")
    return (
        rows.join(starts, [*keys, "_block"])
        .withColumn(out, F.when(_checked(order, within).isNotNull(), place))
        .drop("_block", "_start")
    )


def running_count(
    df: DataFrame, flag: Column, order: str, keys: Sequence[str] = (), out: str = "n", bits: int | None = None
) -> DataFrame:
    """Number of rows so far (this one included) for which ``flag`` holds."""
    rows = blocked(df.withColumn("_flag", F.when(flag, 1).otherwise(0)), order, bits)
    carried = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_flag").alias("_n"))
        .withColumn("_carry", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
        .drop("_n")
    )
    within = (
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(carried, [*keys, "_block"])
        .withColumn(out, (F.col("_carry") + F.sum("_flag").over(within)).cast("long"))
        .drop("_flag", "_block", "_carry")
    )


def carry_forward(
    df: DataFrame, value: Column, order: str, keys: Sequence[str] = (), out: str = "value", bits: int | None = None
) -> DataFrame:
    """Last non-null ``value`` at or before each row."""
    rows = blocked(df.withColumn("_value", value), order, bits)
    carried = (
        rows.groupBy(*keys, "_block")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(_before(keys)))
        .drop("_last")
    )
    within = (
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(carried, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(within), F.col("_carry")))
        .drop("_value", "_block", "_carry")
    )
