"""Scores of prediction files against gold files, matched by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.text import split_spaces
from encoscope.operators import chunks, evaluate
from encoscope.sources import conll, labelled


def f1_of_files(spark: SparkSession, gold: str, pred: str, compat_header: bool = False) -> DataFrame:
    """Micro, macro and weighted F1 of two labelled CSV files, token labels flattened."""
    left = labelled.read_numbered(spark, gold).select("idx", split_spaces(F.col("label")).alias("gold"))
    right = labelled.read_numbered(spark, pred).select("idx", split_spaces(F.col("label")).alias("pred"))
    pairs = evaluate.label_pairs(evaluate.align(left, right, ["idx"]), "gold", "pred")
    return evaluate.f1_report(evaluate.confusion(pairs), compat_header=compat_header)


def spans_of_files(spark: SparkSession, gold: str, pred: str) -> DataFrame:
    """Tag accuracy and chunk precision, recall and F1 of two token-per-line files."""
    left = conll.read_bio(spark, gold).select("idx", F.col("tags").alias("gold"))
    right = conll.read_bio(spark, pred).select("idx", F.col("tags").alias("pred"))
    return chunks.span_report(chunks.chunk_counts(evaluate.align(left, right, ["idx"])))


def evaluate_files(spark: SparkSession, gold: str, pred: str) -> DataFrame:
    """The report that fits the kind of file, told by its suffix."""
    if gold.endswith("csv") and pred.endswith("csv"):
        return f1_of_files(spark, gold, pred)
    if gold.endswith("conll") and pred.endswith("conll"):
        return spans_of_files(spark, gold, pred)
    raise ValueError("only two CSV files or two CoNLL files can be scored")
