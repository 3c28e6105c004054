"""Scores of predictions: F1 averages, batch means, head accuracy and loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encoscope.functions.ordered import dense_index
from encoscope.functions.vectors import argmax0, cross_entropy


def align(gold: DataFrame, pred: DataFrame, on: Sequence[str], strict: bool = True) -> DataFrame:
    """Meet gold and predictions on row keys; rows found on one side only are an error.

    Non-strict, they stay with NULLs on the missing side. A key that comes twice on a side is an error
    in either case; it is noticed in the sort that the join makes anyway.
    """
    on = list(on)
    gold, pred = _unique(gold, on, "gold"), _unique(pred, on, "predictions")
    both = gold.withColumn("_in_gold", F.lit(True)).join(pred.withColumn("_in_pred", F.lit(True)), on, "full_outer")
    whole = F.col("_in_gold").isNotNull() & F.col("_in_pred").isNotNull()
    if strict:
        both = both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("gold and predictions differ in length")).cast("boolean")))
    return both.drop("_in_gold", "_in_pred")


def _unique(df: DataFrame, on: list[str], what: str) -> DataFrame:
    twice = F.raise_error(F.lit(f"a row key comes twice in {what}")).cast("boolean")
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*on)))
    return counted.where(F.when(F.col("_n") == 1, True).otherwise(twice)).drop("_n")


def label_pairs(df: DataFrame, gold: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Token pairs of two label arrays; arrays of unequal length are an error."""
    zipped = F.arrays_zip(F.col(gold).alias("gold"), F.col(pred).alias("pred"))
    message = F.lit("gold and predicted labels differ in length")
    checked = F.when(F.size(gold) == F.size(pred), zipped).otherwise(
        F.raise_error(message).cast(T.ArrayType(T.StructType([T.StructField("gold", _element(df, gold)), T.StructField("pred", _element(df, pred))])))
    )
    return df.select(*keys, F.explode_outer(checked).alias("_p")).where("_p IS NOT NULL").select(*keys, "_p.gold", "_p.pred")


def _element(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType.elementType


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """Pair counts; C x C rows at most, combined map-side so a frequent label costs nothing."""
    return df.groupBy(*keys, F.col(gold).cast("string").alias("gold"), F.col(pred).cast("string").alias("pred")).agg(
        F.count("*").alias("n")
    )


def f1_by_label(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predictions, hits and F1 per label of a confusion table."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    counts = (
        pairs.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return counts.withColumn("f1", 2 * F.col("hits") / (F.col("support") + F.col("predicted")))


def f1_report(pairs: DataFrame, keys: Sequence[str] = (), compat_header: bool = False) -> DataFrame:
    """Micro, macro and support-weighted F1 in percent.

    ``compat_header`` counts a header line as one more correctly labelled row of its own class.
    """
    if compat_header:
        header = F.lit("label")
        if keys:
            extra = pairs.select(*keys).distinct().withColumns({"gold": header, "pred": header, "n": F.lit(1).cast("long")})
        else:
            extra = pairs.sparkSession.createDataFrame([("label", "label", 1)], "gold string, pred string, n long")
        pairs = pairs.unionByName(extra)
    labels = f1_by_label(pairs, keys)
    return labels.groupBy(*keys).agg(
        (200 * F.sum("hits") / (F.sum("support") + F.sum("predicted"))).alias("micro_f1"),
        (100 * F.avg("f1")).alias("macro_f1"),
        (100 * F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("weighted_macro_f1"),
    )


def with_batches(df: DataFrame, order: str, batch_size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Number consecutive blocks of ``batch_size`` inputs."""
    indexed = dense_index(df, order, keys, out="_at")
    return indexed.withColumn("batch", F.floor(F.col("_at") / batch_size).cast("long")).drop("_at")


def head_metrics(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Add ``pred``, ``correct`` and ``loss`` (NULL for the ignored label -1) to logit rows."""
    scored = df.withColumn("pred", argmax0(F.col(logits)))
    return scored.withColumn("correct", (F.col("pred") == F.col(label)).cast("double")).withColumn(
        "loss", cross_entropy(F.col(logits), F.col(label))
    )


def batch_means(df: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = ("loss", "accuracy")) -> DataFrame:
    """Epoch statistics: the mean over batches of the mean inside each batch."""
    per_batch = df.groupBy(*keys, "batch").agg(*[F.avg(m).alias(m) for m in metrics])
    return per_batch.groupBy(*keys).agg(F.count("*").alias("batches"), *[F.avg(m).alias(m) for m in metrics])
