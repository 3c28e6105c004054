"""Labelled datasets: label levels, flattening, inventories, label maps and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.functions.lookups import literal_map, lookup_join
from encoscope.functions.text import int_labels, split_spaces

TASKS = ("sequence_classification", "token_classification")

# Ids of the three sentiment names.
SENTIMENT_IDS = {"negative": 0, "neutral": 1, "positive": 2}

# Separator tokens by encoder family, and the encoders of the roberta family.
SEPARATORS = {"roberta": "</s>", "bert": "[SEP]"}
ROBERTA_ENCODERS = ("roberta-base", "cardiffnlp/twitter-roberta-base")


def select_text_label(df: DataFrame, text: str = "text", label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """The text and label columns by name; a missing name fails at analysis."""
    return df.select(*keep, F.col(text).alias("text"), F.col(label).alias("label"))


def for_task(df: DataFrame, task: str) -> DataFrame:
    """Sequence rows as they are; token rows split on spaces with integer labels per token."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; expected one of {TASKS}")
    if task == "sequence_classification":
        return df
    rest = [c for c in df.columns if c not in ("text", "label")]
    return df.select(*rest, split_spaces(F.col("text")).alias("tokens"), int_labels(F.col("label")).alias("labels"))


def label_level(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``token`` if any label holds a space, else ``sequence``."""
    spaced = F.coalesce(F.max(F.instr(F.col(label), " ") > 0), F.lit(False))
    return df.agg(F.when(spaced, "token").otherwise("sequence").alias("level"))


def with_label_level(df: DataFrame, label: str = "label", out: str = "labels") -> DataFrame:
    """Labels as arrays: split for the whole dataset once any label holds a space."""
    token_level = label_level(df, label).first()["level"] == "token"
    col = F.col(label).cast("string")
    return df.withColumn(out, split_spaces(col) if token_level else F.array(col))


def flatten_labels(df: DataFrame, keys: Sequence[str], tokens: str, labels: str) -> DataFrame:
    """One row per token: ``(keys, pos, token, label)``."""
    pairs = F.arrays_zip(F.col(tokens).alias("token"), F.col(labels).alias("label"))
    # the outer form keeps the optimizer from computing the arrays once more to drop empty rows early
    rows = df.select(*keys, F.posexplode_outer(pairs).alias("pos", "_p")).where("pos IS NOT NULL")
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "_p.token", "_p.label")


def label_types(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct()


def dataset_counts(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Inputs and labels of a dataset; its length is the number of labels."""
    return df.agg(F.count("*").alias("inputs"), F.coalesce(F.sum(F.size(labels)), F.lit(0)).cast("long").alias("labels"))


def label_index(labels: DataFrame, label: str = "label") -> DataFrame:
    """0-based index over the sorted distinct labels.

    The window sees the label inventory only (one row per class), after the distinct has combined
    map-side; its size is the output width of a classifier, not the size of the data.
    """
    order = Window.orderBy(label)
    return label_types(labels, label).withColumn("label_id", (F.row_number().over(order) - 1).cast("int"))


def label_ids(df: DataFrame, index: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Look label ids up; a label missing from ``index`` is an error."""
    joined = lookup_join(df, index.select(F.col(label), F.col("label_id").alias(out)), label)
    message = F.concat(F.lit("unknown label "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    return joined.withColumn(out, F.when(F.col(out).isNull(), F.raise_error(message).cast("int")).otherwise(F.col(out)))


def label_names(df: DataFrame, index: DataFrame, id_col: str, label: str = "label", out: str = "label") -> DataFrame:
    """Look label names up by id."""
    names = index.select(F.col("label_id").alias(id_col), F.col(label).alias(out))
    return lookup_join(df, names, id_col)


def map_label_arrays(
    df: DataFrame, arr: str, mapping: DataFrame, key: str, value: str, row_id: Sequence[str], out: str
) -> DataFrame:
    """Replace each element of a label array by its mapped value; a missing key is an error.

    A NULL array stays NULL, an empty one empty; a NULL element is an unknown label.

    A label map small enough to be a literal is applied inside the row. A larger one is joined with the
    elements of the distinct arrays, which then meet the rows by their whole array, so rows need no id
    of their own (``row_id`` only spreads them).
    """
    kind = mapping.schema[value].dataType

    def known(found: Column, name: Column) -> Column:
        message = F.concat(F.lit("unknown label "), F.coalesce(name.cast("string"), F.lit("NULL")))
        return F.when(found.isNotNull(), found).otherwise(F.raise_error(message).cast(kind))

    literal = literal_map(mapping, key, value)
    if literal is not None:
        return df.withColumn(out, F.transform(F.col(arr), lambda x: known(F.try_element_at(literal, x), x)))
    arrays = df.select(F.col(arr).alias("_arr")).distinct()
    long = arrays.where(F.size("_arr") > 0).select("_arr", F.posexplode("_arr").alias("_pos", key))
    joined = lookup_join(long, mapping.select(key, F.col(value).alias("_value")), key)
    checked = joined.select("_arr", "_pos", known(F.col("_value"), F.col(key)).alias("_v"))
    mapped = checked.groupBy("_arr").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda s: s["_v"]).alias(out)
    )
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    found = df.join(mapped.withColumnRenamed("_arr", arr), arr, "left")
    return found.withColumn(out, F.when(F.size(arr) == 0, empty).otherwise(F.col(out))).select(*df.columns, out)


def map_constants(value: Column, ids: dict[str, int]) -> Column:
    """A small constant label map, as an expression; NULL for unknown names."""
    pairs = [F.lit(part) for item in ids.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), value)


def length_mismatches(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two arrays differ in length."""
    return df.where(F.size(left) != F.size(right))


def unseen_labels(train: DataFrame, valid: DataFrame, label: str = "label") -> DataFrame:
    """Validation labels that do not occur in training (both sides are label inventories)."""
    return label_types(valid, label).join(label_types(train, label), label, "left_anti")


def label_union(train: DataFrame, valid: DataFrame, label: str = "label") -> DataFrame:
    return train.select(label).unionByName(valid.select(label)).distinct()


def joined_texts(df: DataFrame, separator: Column | str = " ", label: str = "label") -> DataFrame:
    """One text per row: the first column alone, or the first two around ``separator``.

    A label in second place marks single texts, in third place pairs.
    """
    sep = F.lit(separator) if isinstance(separator, str) else separator
    at = df.columns.index(label)
    first, second = F.col(df.columns[0]), F.col(df.columns[1])
    text = first if at == 1 else F.concat(first, sep, second)
    used = {df.columns[0], label} if at == 1 else {df.columns[0], df.columns[1], label}
    rest = [c for c in df.columns if c not in used]
    return df.select(text.alias("text"), label, *rest)


def encoder_separator(encoder: Column) -> Column:
    """Separator token of an encoder's family."""
    return F.when(encoder.isin(*ROBERTA_ENCODERS), SEPARATORS["roberta"]).otherwise(SEPARATORS["bert"])
