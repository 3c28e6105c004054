"""Embeddings as tables: static lookups, subword-to-word means, pooling, user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.functions.lookups import bounded_rows, fetch_bounded, lookup_join
from encoscope.functions.vectors import array_mean_pool, pooling, vector_mean
from encoscope.functions.workers import function_key, per_worker
from encoscope.operators import averages

# Fixed value: the vocabulary entry that stands for unknown words.
UNKNOWN_WORD = "UNK"
# Vocabularies above this many words are joined by shuffle.
VOCABULARY_ROWS = 50_000
# Position of the sequence vector that may be put in front of the words.
CLS_POSITION = -1


def token_rows(df: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    return df.select(*keys, F.posexplode_outer(tokens).alias("pos", "token")).where("pos IS NOT NULL")


def static_vectors(tokens: DataFrame, vocabulary: DataFrame, unknown: str = UNKNOWN_WORD) -> DataFrame:
    """Word vectors of token rows; words outside the vocabulary get the vector of ``unknown``.

    The vocabulary is broadcast only within its checked size, else joined with salted words, since
    a frequent word may hold a large share of all tokens.
    """
    vocabulary = bounded_rows(vocabulary, VOCABULARY_ROWS) or vocabulary
    fallback = vocabulary.where(F.col("word") == unknown).select("vec").first()
    if fallback is None:
        raise ValueError(f"the vocabulary has no entry {unknown!r}")
    filler = _literal(fallback["vec"]).cast(vocabulary.schema["vec"].dataType)
    words = vocabulary.select(F.col("word").alias("token"), F.col("vec"))
    joined = lookup_join(tokens, words, "token", "left", max_rows=VOCABULARY_ROWS)
    return joined.withColumn("known", F.col("vec").isNotNull()).withColumn("vec", F.coalesce("vec", filler))


def _literal(vec) -> Column:
    if len(vec) and not isinstance(vec[0], float):
        return F.array(*[F.struct(F.lit(e["encoder"]).alias("encoder"), _literal(e["vec"]).alias("vec")) for e in vec])
    return F.array(*[F.lit(float(x)) for x in vec])


def stack_vocabularies(encoders: Mapping[str, DataFrame]) -> DataFrame:
    """One vocabulary ``(word, vec)`` for a pool: ``vec`` lists encoder and vector for each encoder.

    Words an encoder does not know get the vector of its unknown word, so one lookup serves the pool.
    """
    parts = []
    for name, vocabulary in encoders.items():
        parts.append(vocabulary.select("word", F.lit(name).alias("encoder"), F.col("vec").cast("array<float>").alias("vec")))
    rows = reduce(DataFrame.unionByName, parts)
    unknown = {r["encoder"]: r["vec"] for r in rows.where(F.col("word") == UNKNOWN_WORD).collect()}
    absent = [name for name in encoders if name not in unknown]
    if absent:
        raise ValueError(f"no entry {UNKNOWN_WORD!r} in the vocabulary of {absent}")
    fillers = F.array(
        *[
            F.struct(F.lit(name).alias("encoder"), _literal(unknown[name]).cast("array<float>").alias("vec"))
            for name in encoders
        ]
    )
    # at most one entry per encoder
    words = rows.groupBy("word").agg(F.collect_list(F.struct("encoder", "vec")).alias("_known"))
    full = F.transform(
        fillers,
        lambda own: F.coalesce(F.get(F.filter("_known", lambda k: k["encoder"] == own["encoder"]), F.lit(0)), own),
    )
    return words.select("word", full.alias("vec"))


def pool(df: DataFrame, keys: Sequence[str], how: str, vec: str = "vec", pos: str = "pos", out: str = "features") -> DataFrame:
    """One vector per sequence from its token vectors; every existing row counts as attended."""
    return df.groupBy(*keys).agg(pooling(how)(F.col(vec), F.col(pos), None).alias(out))


def pooled_static(
    df: DataFrame, keys: Sequence[str], vocabulary: DataFrame, how: str = "mean", tokens: str = "tokens", out: str = "features"
) -> DataFrame:
    """Tokens to one pooled static vector per sequence. ``first`` looks only its one word up."""
    if how == "first":
        first = df.where(F.size(tokens) > 0).select(*keys, F.get(tokens, F.lit(0)).alias("token"))
        return static_vectors(first, vocabulary).select(*keys, F.col("vec").cast("array<double>").alias(out))
    return pool(static_vectors(token_rows(df, keys, tokens), vocabulary), keys, how, out=out)


def word_index(
    pieces: DataFrame, keys: Sequence[str], piece: str = "piece", start: Column | None = None, out: str = "word"
) -> DataFrame:
    """Number the word each piece belongs to: a new word begins where a piece starts at offset 0.

    Special pieces take no part. Sequences are bounded by the encoder's input length.
    """
    begins = F.col("off_start") == 0 if start is None else start
    so_far = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, 0)
    kept = pieces.where(~F.col("is_special"))
    return kept.withColumn(out, (F.sum(F.when(begins, 1).otherwise(0)).over(so_far) - 1).cast("int"))


def words_from_pieces(pieces: DataFrame, keys: Sequence[str], cls: bool = False) -> DataFrame:
    """Mean vector of the pieces of each word: ``(keys, pos, n_pieces, vec)``.

    The pieces of a word are few (all pieces of a sequence fit the encoder's input length), so they
    are gathered and averaged in one row. With ``cls`` the first special piece of a sequence is kept as position -1.
    """
    gathered = word_index(pieces, keys, out="pos").groupBy(*keys, "pos").agg(F.collect_list("vec").alias("_vecs"))
    words = gathered.select(
        *keys, "pos", F.size("_vecs").cast("long").alias("n_pieces"), array_mean_pool(F.col("_vecs")).alias("vec")
    )
    if not cls:
        return words
    firsts = (
        pieces.where(F.col("is_special"))
        .groupBy(*keys)
        .agg(F.min_by("vec", "piece").cast("array<double>").alias("vec"))
        .select(*keys, F.lit(CLS_POSITION).alias("pos"), F.lit(1).cast("long").alias("n_pieces"), "vec")
    )
    return words.unionByName(firsts)


def words_from_lookup(
    pieces: DataFrame, keys: Sequence[str], inventory: DataFrame, on: str = "text", cls: bool = False, piece: str = "piece"
) -> DataFrame:
    """Mean vector of the pieces of each word, looked up by ``on``: ``(keys, pos, n_pieces, vec)``.

    Words are numbered before the lookup, so the sort carries no vectors; behind a broadcast inventory
    none are shuffled or gathered in a hash table at all, as the rows of a word already lie together. Pieces that ``inventory`` (``on``, vec) does
    not hold are left out. With ``cls`` the first special piece of a sequence is kept as position -1.
    """
    so_far = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(~F.col("is_special") & (F.col("off_start") == 0), 1).otherwise(0)
    first = F.min(F.when(F.col("is_special"), F.col(piece))).over(Window.partitionBy(*keys))
    slim = pieces.select(*keys, piece, on, "off_start", "is_special")
    numbered = slim.withColumn("pos", (F.sum(begins).over(so_far) - 1).cast("int")).withColumn("_first", first)
    kept = numbered.where(~F.col("is_special") | (F.lit(cls) & (F.col(piece) == F.col("_first"))))
    placed = kept.select(*keys, F.when(F.col("is_special"), F.lit(CLS_POSITION)).otherwise(F.col("pos")).alias("pos"), on)
    held = fetch_bounded(inventory.select(on, "vec"), VOCABULARY_ROWS) if averages.plain_keys(pieces, keys) else None
    if held is not None and held.num_rows == pc.count_distinct(held[on], mode="all").as_py():
        table = averages.matrix(held["vec"])
        if table is not None:
            flagged = placed.withColumn("_special", F.col("pos") == CLS_POSITION)
            return averages.row_means(flagged, [*keys, "pos"], on, (held[on].to_pylist(), table), "_special", "n_pieces", "vec")
    known = lookup_join(placed, inventory, on, "inner", max_rows=VOCABULARY_ROWS)
    return known.groupBy(*keys, "pos").agg(F.count("*").alias("n_pieces"), vector_mean(F.col("vec")).alias("vec"))


def words_without_pieces(words: DataFrame, sequences: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Words that got no piece (cut off or empty): ``(keys, pos, token)``."""
    wanted = token_rows(sequences, keys, tokens)
    return wanted.join(words.select(*keys, "pos"), [*keys, "pos"], "left_anti")


def length_batches(lengths: Sequence[int], cells: int) -> list[np.ndarray]:
    """Places of items in batches of like length, whose count times their longest length stays within ``cells``.

    An item that is longer by itself is a batch of its own.
    """
    order = np.argsort(lengths, kind="stable")
    batches, start = [], 0
    for end in range(1, len(order) + 1):
        # in ascending order the next item is the longest of a batch that took it in
        if end == len(order) or (end + 1 - start) * max(1, lengths[order[end]]) > cells:
            batches.append(order[start:end])
            start = end
    return batches


def embed_texts(
    df: DataFrame,
    factory: Callable[[], Callable],
    text: str = "text",
    out: str = "features",
    keep: Sequence[str] | None = None,
    cells: int | None = None,
    length: Callable = len,
    profile=None,
) -> DataFrame:
    """Vectors from a user model: ``factory()`` is called once per Python worker and gives a function
    from a list of texts (or token lists) to a 2-D array. Texts go through in Arrow batches.

    With ``cells`` a batch is cut into calls of texts of like ``length``, each within so many padded cells;
    rows come out in their own order again. ``profile`` is a resource profile for the stage, for models that
    need a GPU or more memory. A null text reaches the model as None and has length zero.
    """
    name = function_key(factory)
    kept = [c for c in df.columns if c != text] if keep is None else list(keep)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = per_worker(("model", name), factory)
        for batch in batches:
            if not len(batch):
                continue
            texts = batch[text].tolist()
            result = batch[kept].copy()
            if cells is None:
                result[out] = [row for row in model(texts)]
            else:
                vectors: list = [None] * len(texts)
                for places in length_batches([0 if t is None else length(t) for t in texts], cells):
                    for place, row in zip(places, model([texts[p] for p in places])):
                        vectors[place] = row
                result[out] = vectors
            yield result

    return df.select(*kept, text).mapInPandas(run, schema, profile=profile)
