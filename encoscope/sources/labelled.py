"""Labelled CSV files, label maps, metric records: readers and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.operators.labels import SENTIMENT_IDS, map_constants, select_text_label, with_label_level
from encoscope.sources.conll import number_records

_CSV_READ = {"header": "true", "quote": '"', "escape": '"'}
_CSV_WRITE = {
    "header": "true",
    "quoteAll": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """Quoted CSV with a header; every field a string, an empty field an empty string.

    With ``multi_line`` fields may hold line breaks, and a file is the unit of reading (a folder of
    part files is read in parallel). Without it single files are split over tasks as well.
    """
    reader = spark.read.options(**_CSV_READ).option("multiLine", multi_line)
    reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_labelled(
    spark: SparkSession, path: str, text: str = "text", label: str = "label", multi_line: bool = True
) -> DataFrame:
    """``(text, label)`` of a labelled CSV, by column name."""
    return select_text_label(read_csv(spark, path, multi_line=multi_line), text, label)


def read_numbered(
    spark: SparkSession, path: str, text: str = "text", label: str = "label", multi_line: bool = True
) -> DataFrame:
    """``(idx, text, label)`` with the position of each row, files in name order."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = read_csv(spark, path, multi_line=multi_line).select(*place, F.col(text).alias("text"), F.col(label).alias("label"))
    return number_records(rows).select("idx", "text", "label")


def read_splits(
    spark: SparkSession, train_path: str, test_path: str, text: str = "text", label: str = "label", multi_line: bool = True
) -> DataFrame:
    """Train and test CSV files as one frame with a ``split`` column."""
    parts = [
        read_labelled(spark, path, text, label, multi_line).withColumn("split", F.lit(name))
        for name, path in (("train", train_path), ("test", test_path))
    ]
    return parts[0].unionByName(parts[1])


def read_dataset(spark: SparkSession, name: str, split: str, text: str = "text", label: str = "label") -> DataFrame:
    """One split of a dataset saved as a catalog table, or as Parquet under a path."""
    if "/" in name:
        saved = spark.read.parquet(name)
    else:
        saved = spark.read.table(name)
    return select_text_label(saved.where(F.col("split") == split), text, label)


def read_with_level(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A labelled CSV with ``labels`` arrays at the level found in the file."""
    return with_label_level(read_labelled(spark, path, multi_line=multi_line))


def read_tweets(
    spark: SparkSession, path: str, text: str = "text", sentiment: str = "airline_sentiment", multi_line: bool = True
) -> DataFrame:
    """Tweets with a sentiment name, as ``(text, label)`` with integer labels; another name is an error."""
    rows = read_csv(spark, path, multi_line=multi_line)
    found = map_constants(F.col(sentiment), SENTIMENT_IDS)
    message = F.concat(F.lit("unknown sentiment "), F.coalesce(F.col(sentiment), F.lit("NULL")))
    label = F.when(found.isNull(), F.raise_error(message).cast("int")).otherwise(found)
    return rows.select(F.col(text).alias("text"), label.alias("label"))


def _flat(column: Column, kind: str) -> Column:
    return F.array_join(column.cast("array<string>"), " ") if kind.startswith("array") else column.cast("string")


def write_labelled(df: DataFrame, path: str, text: str = "text", label: str = "label", split: str | None = None, mode: str = "errorifexists") -> None:
    """Labelled CSV, all fields quoted; arrays are joined by spaces. ``split`` names folder partitions."""
    kinds = dict(df.dtypes)
    kept = [split] if split else []
    out = df.select(_flat(F.col(text), kinds[text]).alias("text"), _flat(F.col(label), kinds[label]).alias("label"), *kept)
    writer = out.write.mode(mode).options(**_CSV_WRITE)
    if split:
        writer = writer.partitionBy(split)
    writer.csv(path)


def write_predictions(df: DataFrame, folder: str, test_name: str, text: str = "text", prediction: str = "prediction") -> str:
    """Predictions as a labelled CSV named after the test set."""
    path = f"{folder.rstrip('/')}/{test_name}-pred.csv"
    write_labelled(df, path, text, prediction)
    return path


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``{label: id}`` JSON, on one line or indented, as ``(label, label_id)``."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,int>").alias("m"))
    return parsed.select(F.explode("m").alias("label", "label_id"))


def label_map_json(index: DataFrame, label: str = "label", label_id: str = "label_id") -> DataFrame:
    """One row with the label map as JSON, keys sorted. The input is a label inventory, not data."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col(label_id))))
    return index.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_label_map(index: DataFrame, path: str, label: str = "label", label_id: str = "label_id", mode: str = "errorifexists") -> None:
    label_map_json(index, label, label_id).coalesce(1).write.mode(mode).text(path)


def append_result(df: DataFrame, path: str) -> None:
    """Append result rows (dataset, encoder, pooling, metric, value) to the results table."""
    df.select("dataset", "encoder", "pooling", "metric", "value").write.mode("append").parquet(path)


def result_lines(df: DataFrame) -> DataFrame:
    """Results as lines ``encoder | dataset | LogME: score``."""
    line = F.concat_ws(" | ", "encoder", "dataset", F.concat(F.lit("LogME: "), F.col("value").cast("string")))
    return df.select(line.alias("value"))


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row metrics frame as JSON."""
    df.coalesce(1).write.mode(mode).json(path)


def append_run(df: DataFrame, path: str) -> None:
    """Record a finished run (encoder, pooling, head, seed, task) in the run registry."""
    df.select("task", "encoder", "pooling", "head", "seed").write.mode("append").parquet(path)
