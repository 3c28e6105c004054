"""Token-per-line files: one token and tag per line, a blank line after each sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encoscope.functions.lookups import lookup_join

# A sentence break is a blank line, possibly with blanks or carriage returns on it.
SENTENCE_BREAK = r"\r?\n[ \t\r]*\n"


def blank_line(spark: SparkSession, path: str, glob: str | None = None) -> str:
    """The line break that the first line of the files ends with, twice."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    first = reader.text(path).first()
    return "\r\n\r\n" if first is not None and first["value"].endswith("\r") else "\n\n"


def read_records(spark: SparkSession, path: str, glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """Blank-line separated records, in file order inside each file block: ``(file, block, record)``.

    The scan cuts files at ``line_sep`` (found from the first line if not given) and splits further at
    padded blank lines, so a file is read by many tasks.
    """
    reader = spark.read.option("lineSep", line_sep or blank_line(spark, path, glob))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    records = lines.select("file", "block", F.explode(F.split("value", SENTENCE_BREAK, -1)).alias("record"))
    trimmed = F.regexp_replace("record", r"^[\s]*\n|[\s]+$", "")
    return records.withColumn("record", trimmed).where(F.col("record") != "")


def number_records(records: DataFrame, out: str = "idx") -> DataFrame:
    """0-based position of each record in its file and in the corpus (files in name order).

    Records that are left out must be gone before. Those of one file block follow each other in one
    task, so they are numbered there; only the block sizes (one row per input split) are put in
    order. The large side is neither sorted nor shuffled.
    """
    records = records.withColumn("at", F.monotonically_increasing_id())
    blocks = records.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    orders = {"sent": Window.partitionBy("file").orderBy("block"), out: Window.orderBy("file", "block")}
    starts = blocks.withColumns(
        {
            f"_{name}": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            for name, order in orders.items()
        }
    )
    kept = [c for c in records.columns if c not in ("file", "block", "at")]
    joined = lookup_join(records, starts.drop("_n"), ["file", "block"], "inner", spread_by=["at"])
    places = [(F.col("at") - F.col("_first") + F.col(f"_{name}")).cast("long").alias(name) for name in orders]
    return joined.select("file", *places, *kept)


def file_starts(sizes: DataFrame) -> DataFrame:
    """Corpus position at which each file begins, from ``(file, size)``; one row per file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("file_start"))


def parse_bio(record: Column) -> Column:
    """``token<TAB>tag`` lines to ``array<struct<token, tag>>``."""
    lines = F.filter(F.split(record, r"\r?\n", -1), lambda x: F.trim(x) != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.get(F.split(F.trim(x), "\t", -1), F.lit(0)).alias("token"),
            F.get(F.split(F.trim(x), "\t", -1), F.lit(1)).alias("tag"),
        ),
    )


def read_bio(spark: SparkSession, path: str, glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """Sentences of token-per-line files: ``(file, sent, idx, tokens, tags)``; the last one is kept."""
    numbered = number_records(read_records(spark, path, glob, line_sep))
    words = numbered.withColumn("_w", parse_bio(F.col("record")))
    return words.select("file", "sent", "idx", F.col("_w.token").alias("tokens"), F.col("_w.tag").alias("tags"))


def render_bio(tokens: Column, tags: Column) -> Column:
    """Tokens and tags to lines; the shorter array decides the length."""
    n = F.least(F.size(tokens), F.size(tags))
    return F.array_join(
        F.zip_with(F.slice(tokens, 1, n), F.slice(tags, 1, n), lambda t, g: F.concat(t, F.lit("\t"), g)), "\n"
    )


def write_bio(df: DataFrame, path: str, tokens: str = "tokens", tags: str = "tags", mode: str = "errorifexists") -> None:
    """One record per sentence, blank line after each."""
    lines = df.select(render_bio(F.col(tokens), F.col(tags)).alias("value"))
    lines.write.mode(mode).option("lineSep", "\n\n").text(path)
