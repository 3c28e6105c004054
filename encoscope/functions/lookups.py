"""Joins of a large frame with a lookup table, safe for hot keys and for lookup tables that grow."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LOOKUP_ROWS = 100_000
LITERAL_BYTES = 1 << 20
LOOKUP_BYTES = 64 << 20
BATCH_BYTES = 1 << 20


def bounded_rows(small: DataFrame, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES) -> DataFrame | None:
    """``small`` as an in-memory frame if its rows and bytes are within the bounds, else None."""
    rows = fetch_bounded(small, max_rows, max_bytes)
    return None if rows is None else small.sparkSession.createDataFrame(rows, small.schema)


def fetch_bounded(small: DataFrame, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES) -> pa.Table | None:
    """The rows of ``small`` if they are within the bounds, else None; its plan runs once.

    Each partition is packed by a task that stops at the bounds, and the driver takes one partition
    after the other until a bound is passed, so it never holds more than twice ``max_bytes``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, writer, rows, size = pa.BufferOutputStream(), None, 0, 0
        for batch in batches:
            step = max(1, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                if rows <= max_rows and size <= max_bytes:
                    part = batch.slice(at, step)
                    writer = writer or pa.ipc.new_stream(sink, part.schema)
                    writer.write_batch(part)
                    rows, size = rows + part.num_rows, size + part.nbytes
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])

    held, rows, size = [], 0, 0
    for row in small.mapInArrow(pack, "packed binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(row["packed"]).read_all())
        rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
        if rows > max_rows or size > max_bytes:
            return None
    return pa.concat_tables(held) if held else to_arrow_schema(small.schema).empty_table()


def frequent_keys(df: DataFrame, on: Sequence[str], parts: int) -> list[tuple]:
    """Keys that hold more than an even share of the rows, with the number of shares they hold.

    A row count, then one pass over the key columns that combines map-side. Fewer than ``parts`` keys
    can qualify.
    """
    share = max(1, math.ceil(df.count() / parts))
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in on])
    counts = df.where(known).groupBy(*on).agg(F.count("*").alias("_n"))
    rows = counts.where(F.col("_n") > share).collect()
    return [(*[r[k] for k in on], math.ceil(r["_n"] / share)) for r in rows]


def split_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str] | None = None
) -> DataFrame:
    """Shuffled equi-join that cuts each frequent key of ``big`` into pieces of an even share.

    Only lookup rows of frequent keys are copied, once per piece. Rows with a NULL key match nothing
    and are spread as well. ``spread_by`` names the columns whose hash picks the piece.
    """
    on = list(on)
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_keys(big, on, parts)
    keys = [big.schema[k] for k in on]
    pieces = big.sparkSession.createDataFrame(frequent, T.StructType([*keys, T.StructField("_pieces", T.IntegerType())]))
    hashed = spread_by or [f.name for f in big.schema if f.dataType.typeName() not in ("map", "udt")]
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    number = F.when(missing, F.lit(parts)).otherwise(F.coalesce("_pieces", F.lit(1)))
    cut = big.join(F.broadcast(pieces), on, "left")
    cut = cut.withColumn("_piece", F.pmod(F.xxhash64(*hashed), number).cast("int")).drop("_pieces")
    copies = small.join(F.broadcast(pieces), on, "left")
    copies = copies.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return cut.join(copies, [*on, "_piece"], how).drop("_piece")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = LOOKUP_ROWS,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``big`` with a lookup table on ``on`` (``inner``, ``left``, ``left_semi``, ``left_anti``).

    The lookup table is broadcast when its measured size is within the bounds. Beyond them the join
    shuffles with frequent keys cut into pieces, so a key that holds a third of ``big`` is spread.
    """
    on = [on] if isinstance(on, str) else list(on)
    local = bounded_rows(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    return split_join(big, small, on, how, spread_by)


def literal_map(small: DataFrame, key: str, value: str, max_rows: int = 10_000) -> Column | None:
    """A lookup table as a map literal for use inside array expressions; None beyond the bounds."""
    held = fetch_bounded(small.select(key, value), max_rows, LITERAL_BYTES)
    if held is None:
        return None
    rows = list(zip(*(c.to_pylist() for c in held.columns)))
    keys = F.array(*[F.lit(r[0]) for r in rows]).cast(f"array<{small.schema[key].dataType.simpleString()}>")
    values = F.array(*[F.lit(r[1]) for r in rows]).cast(
        f"array<{small.schema[value].dataType.simpleString()}>"
    )
    return F.map_from_arrays(keys, values)
