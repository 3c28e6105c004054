"""Word vector files: one word and its values per line, separated by single spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the count-and-width line at the top of a fastText file.
FASTTEXT_HEADER = r"^\d+ \d+\s*$"


def _read(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value").alias("value")
    )
    return lines.where("value <> ''").withColumn("at", F.monotonically_increasing_id())


def _parse(lines: DataFrame) -> DataFrame:
    parts = lines.select("file", "block", "at", F.split("value", " ", -1).alias("_p"))
    values = F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda x: x.try_cast("float"))
    words = parts.select(F.get("_p", F.lit(0)).alias("word"), values.alias("vec"), F.struct("file", "block", "at").alias("_place"))
    # of a word that comes twice the later line counts
    return words.groupBy("word").agg(F.max_by("vec", "_place").alias("vec"))


def read_glove(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vec)`` of a file without a header."""
    return _parse(_read(spark, path))


def read_fasttext(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vec)`` of a file whose first line gives its size."""
    lines = _read(spark, path)
    header = (F.col("block") == 0) & F.col("value").rlike(FASTTEXT_HEADER)
    return _parse(lines.where(~header))


READERS = {"fasttext": read_fasttext, "glove": read_glove}


def read_encoder(spark: SparkSession, spec: str) -> DataFrame:
    """Vectors of a ``kind:path`` specification."""
    kind, _, path = spec.partition(":")
    if kind not in READERS or not path:
        raise ValueError(f"unknown embedding specification {spec!r}")
    return READERS[kind](spark, path)


def uneven_vectors(vectors: DataFrame) -> DataFrame:
    """Words whose vector is not as long as most are, or holds values that are no numbers."""
    sizes = vectors.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return vectors.select("word", F.size("vec").alias("width"))
    odd = (F.size("vec") != sizes["width"]) | F.exists("vec", lambda x: x.isNull())
    return vectors.where(odd).select("word", F.size("vec").alias("width"))


def write_vectors(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors as text lines without a header."""
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.col("vec").cast("array<string>"), " "))
    vectors.select(line.alias("value")).write.mode(mode).text(path)
