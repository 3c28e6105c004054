"""Seeded shuffles and exact-size splits without sorting the whole dataset in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of the shuffle key that name a bucket: 16**4 buckets.
BUCKET_DIGITS = 4
SPLITS = ("train", "dev", "test")


def shuffle_key(row_id: Column, seed: int) -> Column:
    """Pseudo-random but reproducible sort key of a row."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def _keyed(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    key = shuffle_key(F.col(row_id), seed)
    return df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))


def seeded_shuffle(df: DataFrame, row_id: str, seed: int, out: str = "position") -> DataFrame:
    """Position of each row in the seeded shuffle.

    Buckets of the uniform key are ranked separately; bucket sizes (at most 16**4 rows) give the offsets.
    """
    keyed = _keyed(df, row_id, seed)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("_bucket").orderBy("_key", row_id)
    return (
        keyed.join(F.broadcast(starts), "_bucket")
        .withColumn(out, (F.col("_start") + F.row_number().over(within) - 1).cast("long"))
        .drop("_key", "_bucket", "_start")
    )


def split_sizes(rows: int, proportions: Sequence[float]) -> list[int]:
    """Half-even rounded sizes; the last part takes the remainder."""
    if len(proportions) != len(SPLITS):
        raise ValueError("there must be three proportions (train, dev, test)")
    if not math.isclose(sum(proportions), 1.0, abs_tol=1e-9):
        raise ValueError(f"split proportions {list(proportions)} do not sum up to 1")
    sizes = [round(rows * p) for p in proportions[:-1]]
    first = min(sizes[0], rows)
    second = min(sizes[1], rows - first)
    return [first, second, rows - first - second]


def seeded_split(
    df: DataFrame, row_id: str, seed: int, proportions: Sequence[float] = (0.7, 0.1, 0.2), out: str = "split"
) -> DataFrame:
    """Exact-size train/dev/test split in seeded-shuffle order.

    Two passes over the id column find the key at each cut: a histogram of key buckets, then the
    exact rank inside the one or two buckets a cut falls into. The result compares each row's key
    with those cuts, so the rows themselves are never shuffled.
    """
    keyed = _keyed(df.select(row_id), row_id, seed)
    histogram = sorted(tuple(r) for r in keyed.groupBy("_bucket").count().collect())
    rows = sum(n for _, n in histogram)
    sizes = split_sizes(rows, proportions)
    cuts = [sizes[0], sizes[0] + sizes[1]]

    targets = []
    for cut in cuts:
        seen = 0
        for bucket, n in histogram:
            if seen <= cut < seen + n:
                targets.append((bucket, cut - seen + 1))
                break
            seen += n
        else:
            targets.append(None)
    wanted = {t for t in targets if t}
    found = {}
    if wanted:
        within = Window.partitionBy("_bucket").orderBy("_key", row_id)
        ranked = (
            keyed.where(F.col("_bucket").isin(*{b for b, _ in wanted}))
            .withColumn("_rank", F.row_number().over(within))
            .where(reduce(Column.__or__, [(F.col("_bucket") == b) & (F.col("_rank") == r) for b, r in wanted]))
        )
        found = {(r["_bucket"], r["_rank"]): (r["_key"], r[row_id]) for r in ranked.collect()}

    key = shuffle_key(F.col(row_id), seed)
    choice = F.lit(SPLITS[-1])
    for name, target in reversed(list(zip(SPLITS, targets))):
        if target is None:
            choice = F.lit(name)
            continue
        cut_key, cut_id = found[target]
        before = (key < cut_key) | ((key == cut_key) & (F.col(row_id) < F.lit(cut_id)))
        choice = F.when(before, name).otherwise(choice)
    return df.withColumn(out, choice)
