"""Exact top-k inner products by blocks of rows, with bounds from the maxima of each block.

Vectors are turned into integers; a component is a term with its weight. Rows are cut into blocks of
consecutive ids. A block holds the rows (its forward index) and, for each term, the largest and the
smallest weight; their products with a query, summed, bound every score in the block. Each query takes
the blocks by descending bound and stops at the first whose bound is below its k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.llm.common import parts_for, written

BLOCK_ROWS = 256
# Blocks of a task that are ordered together, and queries of one pass over the blocks.
GROUP_BLOCKS = 64
QUERY_BYTES = 8 << 20

BLOCK = "ids binary, weights binary, dims int"


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component, for vectors without null or non-finite components."""
    x = F.col(embedding)
    sound = F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf")))), F.lit(False)
    )
    scaled: Column = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.where(sound & F.col(vec_id).isNotNull())
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("weights"))


def _matrix(lists: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def forward_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a block of consecutive ids; shorter vectors are filled with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def flush():
            dims = max(map(len, held))
            values = [np.array(ids, "<i8").tobytes()], [_matrix(held, dims).astype("<i8").tobytes()], [dims]
            return pa.RecordBatch.from_arrays([pa.array(values[0], pa.binary()), pa.array(values[1], pa.binary()), pa.array(values[2], pa.int32())], ["ids", "weights", "dims"])

        for batch in batches:
            for vec_id, weights in zip(batch.column("vec_id"), batch.column("weights")):
                ids.append(vec_id.as_py())
                held.append(weights.values.to_numpy(zero_copy_only=False))
                if len(ids) == block_rows:
                    yield flush()
                    ids, held = [], []
        if ids:
            yield flush()

    parts = parts_for(rows.sparkSession, rows.count(), 1 << 16)
    return rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(run, BLOCK)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers: through floating point where every partial sum is exact there."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("inner products do not fit 64 bits")
    return a @ b.T


class BestRows:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``rows`` (a line each) with the ids of one block."""
        floor = self.kth()[rows]
        own = ids[None, :] == self.query_ids[rows][:, None]
        if scores.shape[1] > self.k:
            others = np.where(own, np.iinfo(np.int64).min, scores)
            floor = np.maximum(floor, np.partition(others, -self.k, axis=1)[:, -self.k])
        line, column = np.nonzero((scores >= floor[:, None]) & ~own)
        if not len(line):
            return
        touched = np.unique(line)
        place = np.searchsorted(touched, line)
        old = rows[touched]
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        s = np.concatenate([self.scores[old].ravel(), scores[line, column]])
        v = np.concatenate([self.ids[old].ravel(), ids[column]])
        order = np.lexsort((v, -s.astype(np.float64) if abs(s).max() < 1 << 53 else _descending(s), q))
        first = np.searchsorted(q[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[old], self.ids[old] = s[best], v[best]


def _descending(s: np.ndarray) -> np.ndarray:
    return -(s + 1)  # -minimum does not fit


def search_group(best: BestRows, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Brings the blocks into ``best``; returns how many (query, block) scorings the bounds left."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    highest = np.stack([w.max(axis=0) for _, w in blocks])
    lowest = np.stack([w.min(axis=0) for _, w in blocks])
    bounds = _product(up, highest) + _product(down, lowest)
    order = np.argsort(-bounds, axis=1, kind="stable")
    live, scored = np.arange(len(queries)), 0
    for turn in range(len(blocks)):
        block = order[live, turn]
        # equal scores count by id, so only a bound below the k-th score ends a query
        keep = bounds[live, block] >= best.kth()[live]
        live, block = live[keep], block[keep]
        if not len(live):
            break
        scored += len(live)
        for b in np.unique(block):
            rows = live[block == b]
            ids, weights = blocks[b]
            best.add(rows, _product(queries[rows], weights), ids)
    return scored


def _partial(blocks: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Each task's k best rows for each of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(query_ids, k)
        group: list[tuple[np.ndarray, np.ndarray]] = []

        def search():
            dims = max(queries.shape[1], *(w.shape[1] for _, w in group))
            search_group(best, np.pad(queries, ((0, 0), (0, dims - queries.shape[1]))), [(i, np.pad(w, ((0, 0), (0, dims - w.shape[1])))) for i, w in group])
            group.clear()

        for batch in batches:
            for ids, weights, dims in zip(*(batch.column(c) for c in ("ids", "weights", "dims"))):
                ids = np.frombuffer(ids.as_py(), "<i8")
                group.append((ids, np.frombuffer(weights.as_py(), "<i8").reshape(len(ids), dims.as_py())))
                if len(group) == GROUP_BLOCKS:
                    search()
        if group:
            search()
        line, column = np.nonzero(best.ids != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[line]), pa.array(best.ids[line, column]), pa.array(best.scores[line, column])], ["query_id", "vec_id", "score"]
        )

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product for each query row.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id.
    Equal scores rank by smaller id. Vectors that are null or hold null or non-finite components take no
    part, nor do rows without an id; a shorter vector counts as filled with zeros, an empty one scores
    0. A repeated query row asks the same question and is answered once; a repeated candidate row may
    take several ranks. A score beyond 64 bits is an error. An empty table gives no rows.

    Queries grow with the table, so they are fetched ``QUERY_BYTES`` at a time and each such set makes a
    pass over the blocks, which are written once. Tasks give k rows a query; only these are shuffled.
    """
    spark = vectors.sparkSession
    blocks = written(forward_blocks(integer_vectors(vectors, vec_id, embedding, scale)), "blocks")
    asked = vectors.where(F.col(vec_id) % every == 0)
    asked = integer_vectors(asked, vec_id, embedding, scale).dropDuplicates(["vec_id"])
    passes, ids, held, size = [], [], [], 0

    def search():
        dims = max(1, *map(len, held)) if held else 1
        passes.append(written(_partial(blocks, np.array(ids, np.int64), _matrix(held, dims), k), "best"))
        ids.clear(), held.clear()

    for row in asked.toLocalIterator():
        ids.append(row["vec_id"])
        held.append(np.array(row["weights"], np.int64))
        size += 8 * len(held[-1])
        if size >= QUERY_BYTES:
            search()
            size = 0
    if ids:
        search()
    found = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
