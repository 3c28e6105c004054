"""LEEP text files: two header lines with the labels, then source probabilities and a gold label."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = r"^\[(.*)\]\s*(.*?)\s*$"


def _unquoted(label: Column) -> Column:
    return F.regexp_replace(label, r'^"(.*)"$', "$1")


def _header(line: str) -> list[str]:
    body = line.strip().lstrip("#").strip()
    try:
        return [str(label) for label in json.loads(body)]
    except json.JSONDecodeError:
        return [label.strip().strip('"') for label in body.strip("[]").split(", ")]


def read_leep(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """Rows ``(theta, gold)`` with the target labels and the source labels, in file order.

    Labels are compared as text without quotes. A gold label outside the target labels is an error, as
    is a line that is neither an instance nor a comment.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("trim(value) <> ''")
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    heads = numbered.where(F.col("value").rlike(r"^#\s*\[")).orderBy("file_path", "file_block_start", "at").limit(2).collect()
    if len(heads) != 2:
        raise ValueError("a LEEP file begins with two label lines")
    targets, sources = _header(heads[0]["value"]), _header(heads[1]["value"])
    shape = F.col("value").rlike(ROW)
    strange = F.raise_error(F.concat(F.lit("no instance and no label line: "), F.col("value"))).cast("boolean")
    body = lines.where(F.when(shape, True).when(F.startswith("value", F.lit("#")), False).otherwise(strange))
    rows = body.select(
        F.transform(F.split(F.regexp_extract("value", ROW, 1), r",\s*", -1), lambda x: x.cast("double")).alias("theta"),
        _unquoted(F.regexp_extract("value", ROW, 2)).alias("gold"),
    )
    message = F.concat(F.lit("gold label outside the target labels: "), F.col("gold"))
    known = F.when(F.col("gold").isin(*targets), F.col("gold")).otherwise(F.raise_error(message).cast("string"))
    return rows.withColumn("gold", known), targets, sources


def write_leep(
    df: DataFrame, path: str, targets: Sequence, sources: Sequence, theta: str = "theta", gold: str = "gold", mode: str = "errorifexists"
) -> None:
    """Header in the first part file, instances after it."""
    spark = df.sparkSession
    header = spark.createDataFrame(
        [(f"# {json.dumps(list(labels), ensure_ascii=False)}",) for labels in (targets, sources)], "value string"
    ).coalesce(1)
    values = F.array_join(F.col(theta).cast("array<double>").cast("array<string>"), ", ")
    rows = df.select(F.concat(F.lit("["), values, F.lit('] "'), F.col(gold).cast("string"), F.lit('"')).alias("value"))
    header.union(rows).write.mode(mode).text(path)
