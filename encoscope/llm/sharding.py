"""Sharding along a Hilbert curve over row metadata, in DataFrame operations only.

Each metadata dimension is quantised to ``BITS`` bits by its own quantiles. The cell of a row has an
index on the Hilbert curve; rows are ordered by it, and the order is cut into runs of equal length. A
file of one run then covers a compact box of every dimension, so that its min/max statistics prune
scans on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.llm.common import parts_for, written

BITS = 4
# Rows of one cell are dealt into 2**SUB_BITS blocks by a hash, so a cell with a third of all rows is spread.
SUB_BITS = 10
ACCURACY = 1000


def hilbert_index(point: Sequence[int], bits: int) -> int:
    """Position of a grid point on the Hilbert curve.

    The axes are turned into the transposed index (Gray code after undoing each level's rotation),
    whose bits are then interleaved.
    """
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    index = 0
    for level in reversed(range(bits)):
        for i in range(n):
            index = index << 1 | ((x[i] ^ flip) >> level) & 1
    return index


def curve(dims: int, bits: int) -> list[int]:
    """Hilbert index of every cell; the cell number holds the first dimension in its highest bits."""
    side = (1 << bits) - 1
    return [hilbert_index([c >> bits * (dims - 1 - i) & side for i in range(dims)], bits) for c in range(1 << dims * bits)]


def ordinal(df: DataFrame, name: str) -> Column:
    """A column that sorts as its values do: strings by all their bytes, numbers as they are; null is lowest."""
    if df.schema[name].dataType.typeName() == "string":
        return F.col(name)
    value = F.col(name).cast("double")
    return F.when(F.isnan(value) | value.isNull(), F.lit(float("-inf"))).otherwise(value)


def string_cuts(df: DataFrame, name: str, steps: int) -> list[str]:
    """Values that cut the rows into ``steps`` nearly equal runs in the order of a string column.

    Rows are counted by value first; the distinct values are ranged over partitions, counted up inside each,
    and only the cuts leave the cluster.
    """
    spark = df.sparkSession
    counts = written(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")), "values")
    parts = parts_for(spark, counts.count(), 1 << 20)
    ranged = written(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    nulls = df.where(F.col(name).isNull()).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)) + nulls).withColumn("all", F.sum("size").over(Window.partitionBy()) + nulls)
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(F.broadcast(sizes), "part").withColumn("to", F.col("before") + F.sum("n").over(inside))
    step = lambda at: F.floor(at * steps / F.col("all"))
    return sorted(r["value"] for r in upto.where(step(F.col("to")) > step(F.col("to") - F.col("n"))).select("value").collect())


def hilbert_runs(
    df: DataFrame, dims: Sequence[str], shards: int, tie: Sequence[str], bits: int = BITS
) -> DataFrame:
    """Adds ``hilbert`` (curve index), ``shard`` and ``slot`` (position in the shard, from 0).

    Shards hold consecutive runs of the curve order and differ by one row at most. ``dims`` name number
    or string columns; ``tie`` names the columns that order rows of one cell. Nulls are lowest, NaN
    counts as null, repeated rows stay apart, and an empty table gives an empty one. Temporary columns
    start with ``_hc_``.

    Quantile cuts (``2**bits - 1`` numbers a dimension) and the row count of each cell (``2**(bits *
    dims)`` at most) are all that leaves the cluster's partitions.
    """
    spark, width = df.sparkSession, len(dims)
    if width * bits > 16:
        raise ValueError("the table of curve cells is limited to 2**16 entries")
    # a dimension with few values keeps them apart only if cuts are distinct, so equal cuts count once
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    words = [df.schema[d].dataType.typeName() == "string" for d in dims]
    numbers = df.select(F.lit(0).alias("d"), *[ordinal(df, d).alias(f"d{i}") for i, d in enumerate(dims) if not words[i]])
    found = numbers.agg(F.count("*").alias("n"), *[F.percentile_approx(f"d{i}", shares, ACCURACY).alias(f"d{i}") for i in range(width) if not words[i]]).first()
    cell: Column = F.lit(0)
    for i, d in enumerate(dims):
        cuts = string_cuts(df, d, 1 << bits) if words[i] else sorted(set(found[f"d{i}"] or []))
        value = ordinal(df, d)
        level = sum([F.when(value > cut, 1).otherwise(0) for cut in cuts], F.lit(0))
        cell = cell * (1 << bits) + level
    places = F.array(*[F.lit(p) for p in curve(width, bits)])
    hashed = F.xxhash64(*[F.col(t) for t in tie])
    rows = df.withColumn("hilbert", F.element_at(places, (cell + 1).cast("int")))
    rows = rows.withColumn("_hc_hash", hashed).withColumn("_hc_sub", F.shiftrightunsigned("_hc_hash", 64 - SUB_BITS))

    blocks = rows.groupBy("hilbert", "_hc_sub").agg(F.count("*").alias("_hc_n"))
    in_cell = Window.partitionBy("hilbert").orderBy("_hc_sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_hc_before", F.coalesce(F.sum("_hc_n").over(in_cell), F.lit(0)))
    cells = blocks.groupBy("hilbert").agg(F.sum("_hc_n").alias("n")).collect()  # at most 2**16 rows
    total, starts = 0, []
    for row in sorted(cells, key=lambda r: r["hilbert"]):
        starts.append((row["hilbert"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, "hilbert int, _hc_start long")
    blocks = blocks.join(F.broadcast(offsets), "hilbert").withColumn("_hc_before", F.col("_hc_before") + F.col("_hc_start"))
    in_block = Window.partitionBy("hilbert", "_hc_sub").orderBy("_hc_hash", *tie)
    placed = rows.join(blocks.drop("_hc_n", "_hc_start"), ["hilbert", "_hc_sub"])
    at = F.col("_hc_before") + F.row_number().over(in_block) - 1
    n = max(total, 1)
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_hc_at", at)
        .withColumn("shard", F.expr(f"cast((_hc_at * {shards}) div {n}L as int)"))
        .withColumn("slot", F.col("_hc_at") - first)
        .drop("_hc_at", "_hc_before", "_hc_sub", "_hc_hash")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, rows in curve order, so that files have narrow statistics."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of documents by source, language and size, under the law of equal row counts.

    Text bytes are read once for size and checksum and never shuffled. A null text has no bytes.
    """
    text = F.encode("text", "UTF-8")
    slim = documents.select(
        "doc_id",
        "lang",
        "source",
        (F.coalesce(F.length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
    )
    placed = hilbert_runs(written(slim, "sizes"), ["source", "lang", "size"], shards, ["doc_id", "text_crc32"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
