"""Means of looked-up vectors over runs of rows, without vectors in a shuffle, a sort or a hash table.

Rows lie sorted by their keys, and hold words only. A task looks the words up in a broadcast matrix of
bounded size and keeps the sums of one run at a time, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Vectors are gathered in slices, and handed on in batches, of this many bytes.
SLICE_BYTES = 8 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray | None:
    """Vectors of one length without nulls as a 2-D array, else None."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
    if column.null_count or flat.null_count or not len(column) or (lengths != lengths[0]).any():
        return None
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def plain_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether neighbours can be compared by these columns."""
    return not any(isinstance(df.schema[k].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for k in keys)


class RunMeans:
    """Counts, means and first vectors of the words of each run of equal keys, from batches in order."""

    def __init__(self, index: dict[str, int], tables: list[np.ndarray], unknown: int, emit: Callable[..., Iterator[pa.RecordBatch]]):
        self.index, self.tables, self.unknown, self.emit = index, tables, unknown, emit
        self.open: tuple | None = None  # keys, count, sums and first word of the run that may go on

    def add(self, keys: pa.RecordBatch, words: pa.Array) -> Iterator[pa.RecordBatch]:
        """``words`` holds a word, or a list of words, for each row of ``keys``."""
        if not keys.num_rows:
            return
        rows = np.arange(keys.num_rows)
        if pa.types.is_list(words.type):
            rows = np.repeat(rows, np.diff(words.offsets.to_numpy()))
            words = words.flatten()
        coded = words.dictionary_encode()
        places = np.array([self.index.get(w, self.unknown) for w in coded.dictionary.to_pylist()] + [self.unknown], np.int64)
        at = places[coded.indices.fill_null(len(places) - 1).to_numpy(zero_copy_only=False)]
        rows, at = rows[at >= 0], at[at >= 0]
        if self.open is not None:
            keys = pa.Table.from_batches([self.open[0], keys]).combine_chunks().to_batches()[0]
            rows = rows + 1
        begins = np.zeros(keys.num_rows, bool)
        begins[0] = True
        for column in keys.columns:
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begins[1:] |= np.diff(codes) != 0
        starts = np.flatnonzero(begins)
        run = (np.cumsum(begins) - 1)[rows]
        count = np.bincount(run, minlength=len(starts))
        first = np.full(len(starts), -1)
        found, leads = np.unique(run, return_index=True)
        first[found] = at[leads]
        step = max(1, SLICE_BYTES // 8 // max(t.shape[1] for t in self.tables))
        sums = [np.zeros((len(starts), t.shape[1])) for t in self.tables]
        for a in range(0, len(at), step):
            here, begin = np.unique(run[a : a + step], return_index=True)
            for total, table in zip(sums, self.tables):
                total[here] += np.add.reduceat(table[at[a : a + step]].astype(np.float64), begin)
        if self.open is not None:
            _, n, totals, lead = self.open
            count[0] += n
            first[0] = lead if lead >= 0 else first[0]
            for total, more in zip(sums, totals):
                total[0] += more
        last = len(starts) - 1
        self.open = (keys.slice(starts[last], 1), count[last], [s[last] for s in sums], first[last])
        yield from self.out(keys.take(pa.array(starts[:last])), count[:last], [s[:last] for s in sums], first[:last])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            keys, n, totals, lead = self.open
            self.open = None
            yield from self.out(keys, np.array([n]), [s[None] for s in totals], np.array([lead]))

    def out(self, keys: pa.RecordBatch, count: np.ndarray, sums: list[np.ndarray], first: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(count)
        step = max(1, SLICE_BYTES // 8 // max(s.shape[1] for s in sums))
        for a in range(0, len(some), step):
            at = some[a : a + step]
            yield from self.emit(keys.take(pa.array(at)), count[at], [s[at] / count[at, None] for s in sums], first[at])


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.float64).ravel()))


def row_means(rows: DataFrame, keys: Sequence[str], word: str, vocabulary: tuple[list[str], np.ndarray], apart: str, counted: str, out: str) -> DataFrame:
    """``(keys, counted, out)``: number and mean of the vectors of each run of ``keys``, from rows of one word.

    Rows are sorted so that runs are whole on either side of the flag ``apart``; unknown words are left out.
    """
    keys = list(keys)
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(counted, T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = schema.names

    def emit(found, count, means, first):
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(count, pa.int64()), lists(means[0])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = held.value
        index = {w: k for k, w in enumerate(words) if w is not None}
        sides = [RunMeans(index, [table], -1, emit) for _ in range(2)]
        for batch in batches:
            flag = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False).astype(bool)
            for side, mask in zip(sides, (flag, ~flag)):
                part = batch.take(pa.array(np.flatnonzero(mask)))
                yield from side.add(part.select(range(len(keys))), part.column(len(keys)))
        for side in sides:
            yield from side.close()

    return rows.select(*keys, word, apart).mapInArrow(run, schema)


def sequence_means(
    rows: DataFrame, keys: Sequence[str], tokens: str, words: list[str], tables: dict[str, np.ndarray], unknown: str, poolings: Sequence[str]
) -> DataFrame:
    """``(encoder, pooling, keys, features)`` of sequences of tokens; rows of equal keys are one sequence."""
    keys, names = list(keys), list(tables)
    held = rows.sparkSession.sparkContext.broadcast((words, list(tables.values())))
    heads = [T.StructField(n, T.StringType()) for n in ("encoder", "pooling")]
    schema = T.StructType([*heads, *(rows.schema[k] for k in keys), T.StructField("features", T.ArrayType(T.DoubleType()))])
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrices = held.value
        index = {w: k for k, w in enumerate(known) if w is not None}

        def emit(found, count, means, first):
            for name, mean, table in zip(names, means, matrices):
                for how in poolings:
                    features = lists(mean if how == "mean" else table[first])
                    ends = [pa.array([x] * len(count), pa.string()) for x in (name, how)]
                    yield pa.RecordBatch.from_arrays([*ends, *found.columns, features], columns)

        means = RunMeans(index, matrices, index[unknown], emit)
        for batch in batches:
            yield from means.add(batch.select(range(len(keys))), batch.column(len(keys)))
        yield from means.close()

    placed = rows.select(*keys, tokens).repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, schema)
