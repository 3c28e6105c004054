"""Statistics of wide features: Gram matrices in tiles, and principal axes without squaring.

``gram_tiles`` never holds a D x D matrix: a task multiplies a chunk of its rows tile by tile and hands each
product on at once. ``axes`` reduces rows to triangular factors by a tree of QR decompositions, so small
singular values keep the digits that a Gram matrix loses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encoscope.functions.vectors import vector_sum

TILE = 1024
# Bytes of feature rows, as doubles, that a task multiplies at a time, and rows of an emitted batch.
CHUNK_BYTES = 128 << 20
# Factors that one task of the QR tree puts together.
FAN_IN = 8


def _chunks(batches: Iterator[pa.RecordBatch], key_count: int, chunk_bytes: int) -> Iterator[tuple[tuple, list[pa.DataType], np.ndarray]]:
    """Feature rows of one key at a time, in matrices of about ``chunk_bytes``."""
    held: dict[tuple, list[np.ndarray]] = {}
    size, types = 0, []
    for batch in batches:
        types = [batch.schema.field(k).type for k in range(key_count)]
        vectors = batch.column(key_count)
        if vectors.null_count or vectors.flatten().null_count:
            raise ValueError("NULL in features: leave such rows out before")
        frame = batch.select(range(key_count)).to_pandas()
        grouped = frame.groupby(list(frame.columns), sort=False, dropna=False).indices if key_count else {(): np.arange(batch.num_rows)}
        for key, rows in grouped.items():
            key = key if isinstance(key, tuple) else (key,)
            part = vectors.take(pa.array(rows))
            lengths = np.diff(part.offsets.to_numpy())
            if len(lengths) and (lengths != lengths[0]).any() or key in held and held[key][0].shape[1] != lengths[0]:
                raise ValueError("feature vectors of one encoder must have one length and no nulls")
            matrix = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            step = max(1, chunk_bytes // max(1, 8 * matrix.shape[1]))
            for at in range(0, len(matrix), step):
                held.setdefault(key, []).append(matrix[at : at + step].astype(np.float64))
                size += held[key][-1].nbytes
                if size >= chunk_bytes:
                    yield from ((k, types, np.concatenate(parts)) for k, parts in held.items())
                    held, size = {}, 0
    yield from ((k, types, np.concatenate(parts)) for k, parts in held.items())


def _plain(key: tuple) -> list:
    return [None if v is None or v != v else getattr(v, "item", lambda v=v: v)() for v in key]


def gram_tiles(
    df: DataFrame, features: str = "features", keys: Sequence[str] = ("encoder",), tile: int = TILE, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Rows of tiles of the Gram matrix: ``(keys, i, start, vec)`` holds row i from column ``start`` on.

    ``start`` is a multiple of ``tile``; tiles on and above the diagonal are given, whole. A task holds a chunk
    of rows and one product of ``tile`` x ``tile`` numbers. What it hands on is D * D / 2 numbers a chunk, at
    most twice the chunk itself for widths up to 4,096 and in proportion to the width beyond.
    """
    keys = list(keys)
    fields = [T.StructField("i", T.LongType()), T.StructField("start", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, types, rows in _chunks(batches, len(keys), chunk_bytes):
            width = rows.shape[1]
            for a in range(0, width, tile):
                left = np.ascontiguousarray(rows[:, a : a + tile].T)
                for b in range(a, width, tile):
                    product = left @ rows[:, b : b + tile]
                    offsets = np.arange(0, product.size + 1, product.shape[1]).astype(np.int32)
                    columns = [pa.array([v] * len(product), t) for v, t in zip(_plain(key), types)]
                    columns += [pa.array(np.arange(a, a + len(product))), pa.array(np.full(len(product), b))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(product.ravel()))], names)

    names = [*keys, "i", "start", "vec"]
    parts = df.select(*keys, F.col(features).alias("_f")).mapInArrow(run, T.StructType([*[df.schema[k] for k in keys], *fields]))
    return parts.groupBy(*keys, "i", "start").agg(vector_sum(F.col("vec")).alias("vec"))


def tile_cells(tiles: DataFrame, keys: Sequence[str] = ("encoder",)) -> DataFrame:
    """Upper-triangle cells ``(keys, i, j, g)`` of the Gram matrix."""
    cells = tiles.select(*keys, "i", "start", F.posexplode("vec").alias("_off", "g"))
    return cells.select(*keys, "i", (F.col("start") + F.col("_off")).alias("j"), "g").where("j >= i")


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def axes(df: DataFrame, components: int, features: str = "features", keys: Sequence[str] = ("encoder",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Centred principal axes ``(keys, n, mean, singular, basis)``, one row each; ``basis`` lists the axes.

    Every task reduces its rows, with a column of ones in front, to one triangular factor; ``FAN_IN`` factors
    at a time are put together until one is left. The ones make the first row of that factor the mean and
    the rest the factor of the centred rows, whose singular values and right directions are the axes. No
    more than ``FAN_IN`` factors of (D + 1) x (D + 1) numbers meet in a task. The basis fits ``logme.project``.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    factor = T.StructType([*key_fields, T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("r", T.BinaryType()), T.StructField("width", T.IntegerType())])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}
        types: list[pa.DataType] = []
        for key, types, rows in _chunks(batches, len(keys), chunk_bytes):
            stacked = np.concatenate([np.ones((len(rows), 1)), rows], axis=1)
            n, upper = held.get(key, (0, stacked[:0]))
            held[key] = [n + len(rows), _triangle(np.concatenate([upper, stacked]))]
        for key, (n, r) in held.items():
            columns = [pa.array([v], t) for v, t in zip(_plain(key), types)]
            rest = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary()), pa.array([r.shape[1]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *rest], names)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["width"].nunique() > 1:
            raise ValueError("feature vectors of one encoder must have one length and no nulls")
        frame = frame.sort_values("part")
        upper = _triangle(np.concatenate([np.frombuffer(r).reshape(-1, w) for r, w in zip(frame["r"], frame["width"])]))
        out = frame.iloc[:1].copy()
        out["part"], out["n"], out["r"] = out["part"] // FAN_IN, frame["n"].sum(), [upper.tobytes()]
        return out[names]

    names = [f.name for f in factor]
    factors = df.select(*keys, F.col(features).alias("_f")).mapInArrow(reduce_rows, factor)
    levels = max(1, math.ceil(math.log(max(2, df.rdd.getNumPartitions()), FAN_IN)))
    for _ in range(levels):
        factors = factors.groupBy(*keys, F.floor(F.col("part") / FAN_IN).alias("_group")).applyInPandas(merge, factor)

    doubles = T.ArrayType(T.DoubleType())
    found = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("mean", doubles), T.StructField("singular", doubles), T.StructField("basis", T.ArrayType(doubles))])

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        upper = np.frombuffer(row["r"]).reshape(-1, row["width"])
        if row["n"] < components:
            raise ValueError(f"not enough rows for {components} components ({row['n']})")
        _, singular, basis = np.linalg.svd(upper[1:, 1:], full_matrices=False)
        out = frame.iloc[:1][keys].copy()
        out["n"], out["mean"] = row["n"], [(upper[0, 1:] / upper[0, 0]).tolist()]
        out["singular"], out["basis"] = [singular[:components].tolist()], [basis[:components].tolist()]
        return out[[f.name for f in found]]

    return factors.groupBy(*keys).applyInPandas(split, found)
