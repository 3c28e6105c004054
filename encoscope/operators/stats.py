"""Additive sufficient statistics of a feature table: Gram matrix, class sums, totals.

One scan of the features feeds everything the transferability scores need. A task keeps one small
accumulator per group and emits it once, so the shuffle carries statistics, never features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encoscope.functions.vectors import vector_sum

# A task hands its accumulators on as soon as they hold this many bytes.
ACCUMULATOR_BYTES = 256 << 20
# Feature rows are widened to doubles in slices of this many bytes.
SLICE_BYTES = 32 << 20
# Rows of one emitted batch hold at most this many bytes.
BATCH_BYTES = 8 << 20


def sufficient_stats(
    df: DataFrame,
    features: str = "features",
    label: str | None = "label",
    targets: str | None = None,
    keys: Sequence[str] = ("encoder",),
    max_partials: int | None = None,
) -> DataFrame:
    """Statistics per ``keys``, in long form ``(keys, kind, i, n, vec)``.

    ``gram``: row ``i`` of the upper triangle of the Gram matrix, from column ``i`` on.
    ``class``: label ``i`` with its count and feature sum (negative labels join no class); with
    ``targets`` (``array<double>`` per row) target ``i`` with its sum of squares and weighted sum.
    ``target``: the plain sum of target ``i``, in ``n``.
    ``total``: row count and feature sum.

    A row without features, or without the label or targets asked for, is an error.

    Each task shuffles one partial matrix per group: D * D / 2 numbers for an input split, a few
    hundredths of it at usual widths. ``max_partials`` merges input splits where features are wider.
    """
    keys = list(keys)
    response = targets if targets is not None else label
    single = df.schema[features].dataType.simpleString() == "array<float>"
    wanted = [F.col(k) for k in keys]
    wanted.append(F.col(features).cast("array<float>" if single else "array<double>").alias("_f"))
    if targets is not None:
        wanted.append(F.col(targets).cast("array<double>").alias("_y"))
    elif response is not None:
        wanted.append(F.col(label).cast("long").alias("_y"))
    slim = df.select(*wanted)
    for name, what in (("_f", features), ("_y", targets or label)):
        if name in slim.columns:
            failed = F.raise_error(F.lit(f"NULL in {what}: leave such rows out before")).cast(slim.schema[name].dataType)
            slim = slim.withColumn(name, F.when(F.col(name).isNull(), failed).otherwise(F.col(name)))
    if max_partials is not None:
        slim = slim.coalesce(max_partials)

    out_schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("kind", T.StringType()),
            T.StructField("i", T.LongType()),
            T.StructField("n", T.DoubleType()),
            T.StructField("vec", T.ArrayType(T.DoubleType())),
        ]
    )
    key_count = len(keys)
    regression = targets is not None
    labelled = response is not None

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Accumulator] = {}
        key_types = None
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_types = [batch.schema.field(k).type for k in range(key_count)]
            vectors = batch.column(key_count)
            whole = _matrix(vectors) if _same_length(vectors) else None
            y = batch.column(key_count + 1) if labelled else None
            if regression:
                y = _matrix(y)
            elif labelled:
                y = y.to_numpy(zero_copy_only=False)
            for key, rows in _groups(batch, key_count):
                if whole is not None:
                    f = whole if rows is None else whole[rows]
                else:
                    # encoders of a pool may differ in width
                    f = _matrix(vectors if rows is None else vectors.take(pa.array(rows)))
                acc = held.get(key)
                if acc is None:
                    acc = held[key] = _Accumulator(f.shape[1], regression)
                    size += acc.gram.nbytes
                part = None if y is None else (y if rows is None else y[rows])
                size += acc.add(f, part, regression)
                if size > ACCUMULATOR_BYTES:
                    yield from _emit(held, key_types)
                    held, size = {}, 0
        if held:
            yield from _emit(held, key_types)

    partial = slim.mapInArrow(accumulate, out_schema)
    return partial.groupBy(*keys, "kind", "i").agg(
        F.sum("n").alias("n"), vector_sum(F.col("vec")).alias("vec")
    )


def _same_length(column: pa.Array) -> bool:
    lengths = np.diff(column.offsets.to_numpy())
    return bool((lengths == lengths[0]).all())


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows share one length, as a 2-D array."""
    flat = column.flatten()
    if flat.null_count or not _same_length(column):
        raise ValueError("feature vectors of one encoder must have one length and no nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(batch: pa.RecordBatch, key_count: int):
    if key_count == 0:
        yield (), None
        return
    frame = batch.select(range(key_count)).to_pandas()
    names = list(frame.columns)
    grouped = frame.groupby(names, sort=False, dropna=False).indices
    for key, rows in grouped.items():
        key = key if isinstance(key, tuple) else (key,)
        yield key, (None if len(rows) == batch.num_rows else rows)


class _Accumulator:
    """Running statistics of one group inside one task."""

    def __init__(self, width: int, regression: bool):
        self.gram = np.zeros((width, width))
        self.total = np.zeros(width)
        self.rows = 0
        self.classes: dict[int, list] = {}
        self.target_sums = 0.0 if regression else np.zeros(0)

    def add(self, f: np.ndarray, y, regression: bool) -> int:
        """Take feature rows in, a slice at a time so that copies stay small; returns grown bytes."""
        if f.shape[1] != len(self.total):
            raise ValueError("feature vectors of one encoder must have one length and no nulls")
        step = max(1, SLICE_BYTES // max(1, 8 * f.shape[1]))
        grown = 0
        for at in range(0, len(f), step):
            part = f[at : at + step].astype(np.float64)
            self.gram += part.T @ part
            self.total += part.sum(axis=0)
            self.rows += len(part)
            if y is not None:
                grown += self._add_targets(part, y[at : at + step], regression)
        return grown

    def _add_targets(self, f: np.ndarray, y: np.ndarray, regression: bool) -> int:
        if regression:
            sums, weights, ids = y.T @ f, (y * y).sum(axis=0), range(y.shape[1])
            self.target_sums = self.target_sums + y.sum(axis=0)
        else:
            ids, inverse = np.unique(y, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            starts = np.searchsorted(inverse[order], np.arange(len(ids)))
            sums = np.add.reduceat(f[order], starts, axis=0)
            weights = np.bincount(inverse, minlength=len(ids)).astype(float)
        grown = 0
        for c, weight, vec in zip(ids, weights, sums):
            if c < 0:
                continue
            if c in self.classes:
                self.classes[c][0] += weight
                self.classes[c][1] += vec
            else:
                self.classes[c] = [weight, vec.copy()]
                grown += vec.nbytes
        return grown

    def rows_out(self):
        yield "total", 0, float(self.rows), self.total
        for c, (weight, vec) in self.classes.items():
            yield "class", int(c), float(weight), vec
        for c, value in enumerate(self.target_sums):
            yield "target", c, float(value), np.zeros(1)
        for i in range(len(self.gram)):
            yield "gram", i, 0.0, self.gram[i, i:]


def _emit(held: dict, key_types: list) -> Iterator[pa.RecordBatch]:
    for key, acc in held.items():
        step = max(1, BATCH_BYTES // max(1, acc.total.nbytes))
        rows = list(acc.rows_out())
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            columns = [
                pa.array([_plain(value)] * len(part), type=kind) for value, kind in zip(key, key_types)
            ]
            lengths = np.array([len(r[3]) for r in part])
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            columns += [
                pa.array([r[0] for r in part], pa.string()),
                pa.array([r[1] for r in part], pa.int64()),
                pa.array([r[2] for r in part], pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[3] for r in part]))),
            ]
            names = [f"k{k}" for k in range(len(key))] + ["kind", "i", "n", "vec"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _plain(value):
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def gram_cells(stats: DataFrame, keys: Sequence[str] = ("encoder",)) -> DataFrame:
    """Upper-triangle cells ``(keys, i, j, g)`` of the Gram matrix."""
    return (
        stats.where("kind = 'gram'")
        .select(*keys, "i", F.posexplode("vec").alias("_off", "g"))
        .select(*keys, "i", (F.col("i") + F.col("_off")).alias("j"), "g")
    )


def covariance_cells(stats: DataFrame, keys: Sequence[str] = ("encoder",)) -> DataFrame:
    """Upper-triangle cells of the sample covariance, from the same statistics.

    One group is the D Gram rows and the total of one encoder.
    """
    keys = list(keys)
    cells = [T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("cov", T.DoubleType())]

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        total = frame[frame["kind"] == "total"].iloc[0]
        n, sums = float(total["n"]), np.asarray(total["vec"], dtype=float)
        grams = frame[frame["kind"] == "gram"]
        rows = grams["i"].to_numpy()
        i = np.repeat(rows, len(sums) - rows)
        j = np.concatenate([np.arange(r, len(sums)) for r in rows])
        g = np.concatenate([np.asarray(v, dtype=float) for v in grams["vec"]])
        out = pd.DataFrame({"i": i, "j": j, "cov": (g - sums[i] * sums[j] / n) / (n - 1)})
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "i", "j", "cov"]]

    wanted = stats.where("kind IN ('gram', 'total')")
    return wanted.groupBy(*keys).applyInPandas(centre, T.StructType([*[stats.schema[k] for k in keys], *cells]))


def class_sums(df: DataFrame, features: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and feature sum per class, JVM side only: ``(keys, label, n, vec)``."""
    return (
        df.where(F.col(label) >= 0)
        .groupBy(*keys, label)
        .agg(F.count("*").alias("n"), vector_sum(F.col(features)).alias("vec"))
    )
