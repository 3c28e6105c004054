"""Chunk-level precision, recall and F1 of tagged sentences.

A sentence is one row with two tag arrays. Each task turns its Arrow batches into a few counts per
chunk type, so neither tokens nor sentences are shuffled; only the counts are summed. Boundaries of
all sentences of a batch are found together with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefix pairs (previous, current) at which a chunk ends or starts.
END_PAIRS = ("BB", "BO", "IB", "IO", "EE", "EI", "EO")
START_PAIRS = ("BB", "IB", "OB", "OI", "EE", "EI", "OE")
SINGLE_TOKEN_TAGS = ("[", "]")
OUTSIDE_TAGS = ("O", ".")

COUNTS = ("found", "predicted", "correct", "tokens", "tags_ok")


class _TagTable:
    """Numbers for prefixes and types seen in a task, and what they imply at a boundary."""

    def __init__(self, raw: bool, outside: str):
        self.raw, self.outside = raw, outside
        self.prefixes: dict[str, int] = {"O": 0}
        self.types: dict[str, int] = {"": 0}

    def _split(self, tag: str) -> tuple[str, str]:
        if self.raw:
            tag = "O" if tag == self.outside else f"B-{tag}"
        prefix, hyphen, kind = tag.partition("-")
        return prefix, "" if not hyphen or kind == "0" else kind

    def encode(self, tags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Prefix and type numbers of each tag; only distinct tags are looked at one by one."""
        coded = pc.dictionary_encode(tags)
        if coded.null_count:
            raise ValueError("a tag is missing")
        parts = [self._split(tag) for tag in coded.dictionary.to_pylist()]
        prefix = np.array([self.prefixes.setdefault(p, len(self.prefixes)) for p, _ in parts], dtype=np.int64)
        kind = np.array([self.types.setdefault(k, len(self.types)) for _, k in parts], dtype=np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if not len(parts):
            return codes.astype(np.int64), codes.astype(np.int64)
        return prefix[codes], kind[codes]

    def member(self, names: Sequence[str]) -> np.ndarray:
        return np.array([p in names for p in self.prefixes])

    def pairs(self, listed: Sequence[str]) -> np.ndarray:
        known = list(self.prefixes)
        return np.array([[f"{a}|{b}" in {f"{x[0]}|{x[1]}" for x in listed} for b in known] for a in known])


def _edges(prefix: np.ndarray, kind: np.ndarray, tags: _TagTable):
    """Previous type, and whether a chunk starts or ends, at every place."""
    before, was = np.concatenate([[0], prefix[:-1]]), np.concatenate([[0], kind[:-1]])
    changed = was != kind
    single, outside = tags.member(SINGLE_TOKEN_TAGS), tags.member(OUTSIDE_TAGS)
    starts = tags.pairs(START_PAIRS)[before, prefix] | (~outside[prefix] & changed) | single[prefix]
    ends = tags.pairs(END_PAIRS)[before, prefix] | (~outside[before] & changed) | single[before]
    return was, starts, ends


def _count_batch(gold: pa.Array, pred: pa.Array, group: np.ndarray, groups: int, tags: _TagTable):
    """Counts per group and type of one batch, as ``{name: array[groups, types]}``."""
    offsets = gold.offsets.to_numpy()
    lengths = np.diff(offsets)
    if not np.array_equal(lengths, np.diff(pred.offsets.to_numpy())):
        raise ValueError("gold and predicted tags differ in length")
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    # one outside place after each sentence keeps chunks from running on
    place = np.arange(len(sentence)) + sentence
    total = len(sentence) + len(lengths)
    sides = []
    for column in (gold, pred):
        prefix, kind = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
        prefix[place], kind[place] = tags.encode(column.flatten())
        sides.append((prefix, kind))
    (gp, gk), (pp, pk) = sides
    gold_was, gold_start, gold_end = _edges(gp, gk, tags)
    pred_was, pred_start, pred_end = _edges(pp, pk, tags)

    done = gold_end & pred_end & (gold_was == pred_was)
    opened = gold_start & pred_start & (gk == pk)
    event = opened | done | (gold_end != pred_end) | (gk != pk)
    # the newest event before each place, inside the same sentence
    at = np.arange(total)
    newest = np.maximum.accumulate(np.where(event, at, -1))
    newest = np.concatenate([[-1], newest[:-1]])
    first = np.repeat(offsets[:-1] - offsets[0] + np.arange(len(lengths)), lengths + 1)
    correct = done & (newest >= first) & opened[newest]

    owner = np.repeat(group, lengths + 1)
    types = len(tags.types)

    def by_type(mask: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask] * types + kind[mask], minlength=groups * types).reshape(groups, types)

    same = (gp[place] == pp[place]) & (gk[place] == pk[place])
    per_token = np.repeat(group, lengths)
    return (
        by_type(gold_start, gk),
        by_type(pred_start, pk),
        by_type(correct, gold_was),
        np.bincount(per_token, minlength=groups),
        np.bincount(per_token[same], minlength=groups),
    )


def chunk_counts(
    df: DataFrame,
    gold: str = "gold",
    pred: str = "pred",
    keys: Sequence[str] = (),
    raw: bool = False,
    outside: str = "O",
) -> DataFrame:
    """Counts per ``keys`` and chunk type; token counts stand in the row without a type.

    ``raw`` reads every tag but ``outside`` as a one-token chunk of that type.
    """
    keys = list(keys)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("type", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = _TagTable(raw, outside)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if keys:
                frame = batch.select(range(len(keys))).to_pandas()
                group = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
                firsts = np.unique(group, return_index=True)[1]
            else:
                group, firsts = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(1, dtype=np.int64)
            found, predicted, correct, tokens, ok = _count_batch(
                batch.column(len(keys)), batch.column(len(keys) + 1), group, len(firsts), tags
            )
            names = list(tags.types)
            g, t = np.nonzero(found + predicted + correct)
            own = np.arange(len(firsts))
            zeros = np.zeros(len(own), dtype=np.int64)
            rows = firsts[np.concatenate([own, g])]
            columns = [batch.column(k).take(pa.array(rows)) for k in range(len(keys))]
            columns.append(pa.array([None] * len(own) + [names[k] for k in t], pa.string()))
            for totals, per_type in ((zeros, found), (zeros, predicted), (zeros, correct), (tokens, None), (ok, None)):
                tail = per_type[g, t] if per_type is not None else np.zeros(len(g), dtype=np.int64)
                columns.append(pa.array(np.concatenate([totals, tail]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    partial = df.select(*keys, F.col(gold), F.col(pred)).mapInArrow(count, schema)
    return partial.groupBy(*keys, "type").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _rates(df: DataFrame) -> DataFrame:
    precision = F.when(F.col("predicted") > 0, 100 * F.col("correct") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("found") > 0, 100 * F.col("correct") / F.col("found")).otherwise(0.0)
    both = F.col("precision") + F.col("recall")
    return (
        df.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    )


def chunk_scores(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overall counts, tag accuracy, precision, recall and F1 in percent."""
    sums = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    accuracy = F.when(F.col("tokens") > 0, 100 * F.col("tags_ok") / F.col("tokens")).otherwise(0.0)
    return _rates(sums.withColumn("accuracy", accuracy).drop("tags_ok"))


def chunk_scores_by_type(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same counts and rates per chunk type, for every type that is found or predicted."""
    return _rates(counts.where("type IS NOT NULL").select(*keys, "type", "found", "predicted", "correct"))


def span_report(counts: DataFrame) -> DataFrame:
    """The four overall numbers at two decimals, under the names the scorer prints."""
    printed = {"accuracy": "accuracy:", "precision": "precision:", "recall": "recall:", "f1": "FB1:"}
    return chunk_scores(counts).select(*[F.round(c, 2).alias(name) for c, name in printed.items()])


def sentences(rows: DataFrame, keys: Sequence[str], pos: str = "pos", **columns: str) -> DataFrame:
    """Token rows to one row per sentence, each named column collected in token order."""
    ordered: Column = F.array_sort(F.collect_list(F.struct(pos, *[F.col(c) for c in columns.values()])))
    grouped = rows.groupBy(*keys).agg(ordered.alias("_rows"))
    return grouped.select(*keys, *[F.col("_rows")[c].alias(name) for name, c in columns.items()])
