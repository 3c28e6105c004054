"""Feature tables of labelled datasets: what transferability scores and heads take as input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.functions.lookups import fetch_bounded
from encoscope.functions.vectors import pooling
from encoscope.operators import averages
from encoscope.operators.embed import UNKNOWN_WORD, VOCABULARY_ROWS, stack_vocabularies, static_vectors, token_rows
from encoscope.operators.labels import flatten_labels


def token_features(
    df: DataFrame, keys: Sequence[str], encoders: Mapping[str, DataFrame], tokens: str = "tokens", labels: str = "labels"
) -> DataFrame:
    """One row per token and encoder: ``(encoder, keys, pos, features, label)``."""
    rows = static_vectors(flatten_labels(df, keys, tokens, labels), stack_vocabularies(encoders))
    return rows.select(*keys, "pos", "label", F.inline("vec")).select(
        "encoder", *keys, "pos", F.col("vec").alias("features"), "label"
    )


def sequence_features(
    df: DataFrame,
    keys: Sequence[str],
    encoders: Mapping[str, DataFrame],
    poolings: Sequence[str],
    tokens: str = "tokens",
    label: str = "label",
) -> DataFrame:
    """One row per sequence, encoder and pooling: ``(encoder, pooling, keys, features, label)``.

    A vocabulary within the bounds of a broadcast is looked up where the sequences lie, and only tokens are
    shuffled; beyond them token vectors are joined and summed by shuffle.
    """
    stacked = stack_vocabularies(encoders)
    tables = _tables(stacked, list(encoders)) if averages.plain_keys(df, [*keys, label]) else None
    if tables is not None and all(pooling(how) for how in poolings):
        some = df.where(F.size(tokens) > 0).select(*keys, F.col(label).alias("label"), F.col(tokens).alias("_tokens"))
        rows = averages.sequence_means(some, [*keys, "label"], "_tokens", *tables, UNKNOWN_WORD, list(poolings))
        return rows.select("encoder", "pooling", *keys, "features", "label")
    rows = static_vectors(token_rows(df, [*keys, label], tokens), stacked)
    vectors = rows.select(*keys, label, "pos", F.inline("vec"))
    pooled = vectors.groupBy("encoder", *keys, label).agg(
        *[pooling(how)(F.col("vec"), F.col("pos"), None).alias(f"_{how}") for how in poolings]
    )
    forms = F.array(*[F.struct(F.lit(how).alias("pooling"), F.col(f"_{how}").alias("features")) for how in poolings])
    return pooled.select("encoder", *keys, F.col(label).alias("label"), F.inline(forms)).select(
        "encoder", "pooling", *keys, "features", "label"
    )


def _tables(stacked: DataFrame, names: list[str]) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """Words of a stacked vocabulary and a matrix for each encoder, if they are within the bounds."""
    held = fetch_bounded(stacked, VOCABULARY_ROWS)
    if held is None:
        return None
    vectors = held["vec"].combine_chunks().flatten().field("vec")
    tables = {name: averages.matrix(vectors.take(pa.array(range(k, len(vectors), len(names))))) for k, name in enumerate(names)}
    return None if any(t is None for t in tables.values()) else (held["word"].to_pylist(), tables)


def encode(
    df: DataFrame,
    keys: Sequence[str],
    encoders: Mapping[str, DataFrame],
    task: str,
    poolings: Sequence[str] = ("mean",),
) -> DataFrame:
    """Features of a dataset under a pool of static encoders, in long form.

    Token tasks give ``(encoder, pooling, keys, pos, features, label)`` with one row per token; sequence
    tasks one row per sequence and pooling. The texts are read once for all encoders and poolings,
    and one scoring job takes them all.
    """
    if task == "token_classification":
        rows = token_features(df, keys, encoders)
        return rows.select("encoder", F.lit("none").alias("pooling"), *[c for c in rows.columns if c != "encoder"])
    if task == "sequence_classification":
        return sequence_features(df, keys, encoders, poolings)
    raise ValueError(f"unknown task {task!r}")
