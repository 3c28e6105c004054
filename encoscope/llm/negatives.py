"""Hard negatives by best-first search in cover trees over norm-augmented vectors.

A candidate x gets one more coordinate, sqrt(M^2 - |x|^2), so all candidates lie on a sphere of radius M and
the inner product with a query falls as the angle to it grows. Each level of a tree covers its rows by
balls around a few of them, whose centres are further apart than the covering radius. The angle from
a query to a centre and the ball's angular radius bound every inner product in the ball from both sides.
A search takes the ball with the highest bound first, skips balls outside a query's window of scores or
without rows of a wanted label, and verifies leaves by exact integer products.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.llm.common import parts_for, shuffle_parts, written

FANOUT = 16
LEAF_ROWS = 128
TREE_ROWS = 4096
QUERY_ROWS = 512
# Bytes of the rows whose trees one task holds, and of a block of queries that it searches at a time.
GROUP_BYTES = 32 << 20
QUERY_BYTES = 8 << 20
# Rows are spread to trees by centres among a bounded sample, which only decides where a row is kept.
SAMPLE_ROWS = 1024
CENTRES = 64

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
CELLS = ["owners", "ids", "labels", "weights", "low", "high"]
HELD = "kind int, number long, " + ", ".join(f"{c} binary" for c in CELLS)


def farthest_first(points: np.ndarray, most: int, stop: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (positions), the nearest one of each point, and its squared distance.

    Starts with the first point and adds the point farthest from all centres, until every point is within
    a squared distance of ``stop`` or there are ``most`` centres. Centres are apart by the final covering
    radius at least.
    """

    def squares_from(place: int) -> np.ndarray:
        apart = points - points[place]
        return np.einsum("ij,ij->i", apart, apart)

    centres, owner, gap = [0], np.zeros(len(points), np.int64), squares_from(0)
    while len(centres) < most:
        far = int(gap.argmax())
        if gap[far] <= stop:
            break
        new = squares_from(far)
        closer = new < gap
        owner[closer], gap[closer] = len(centres), new[closer]
        centres.append(far)
    return np.array(centres), owner, gap


def exact_products(queries: np.ndarray, rows: np.ndarray) -> Callable[[np.ndarray, slice], np.ndarray]:
    """A function from query numbers and a slice of rows to their integer products.

    The products go through floating point where every partial sum is exact there.
    """
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most >= 1 << 62:
        raise OverflowError("inner products do not fit 62 bits")
    if most >= 1 << 53:
        return lambda who, part: queries[who] @ rows[part].T
    a, b = queries.astype(np.float64), rows.astype(np.float64)
    return lambda who, part: (a[who] @ b[part].T).astype(np.int64)


class CoverTree:
    """A tree over integer rows. Nodes are numbered level by level; the children of a node are neighbours."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        n = len(ids)
        plain = weights.astype(np.float64)
        norms = np.einsum("ij,ij->i", plain, plain)
        self.norm = float(np.sqrt(norms.max(initial=0)))
        lifted = np.concatenate([plain, np.sqrt(np.maximum(self.norm**2 - norms, 0))[:, None]], axis=1)
        spans = [np.arange(n)]
        self.first, self.last = [0], [0]  # children of a node; equal for a leaf
        centre = [0]
        at = 0
        while at < len(spans):
            span = spans[at]
            inside = lifted[span]
            apart = inside - inside[:1]
            radius = float(np.einsum("ij,ij->i", apart, apart).max(initial=0))
            # a level ends at half the radius above, or earlier with all centres that a node may have
            if len(span) > LEAF_ROWS and radius > 0:
                chosen, owner, _ = farthest_first(inside, FANOUT, radius / 4)
                self.first[at], self.last[at] = len(spans), len(spans) + len(chosen)
                for k, c in enumerate(chosen):
                    members = span[owner == k]
                    members = np.concatenate([[span[c]], members[members != span[c]]])
                    spans.append(members)
                    centre.append(int(span[c]))
                    self.first.append(0), self.last.append(0)
            at += 1
        self.first, self.last = np.array(self.first), np.array(self.last)
        self.is_leaf = self.first == self.last
        order = [spans[k] for k in np.flatnonzero(self.is_leaf)]
        sizes = np.array([len(s) for s in order], np.int64)
        ends = np.cumsum(sizes)
        self.begin, self.end = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
        self.begin[self.is_leaf], self.end[self.is_leaf] = ends - sizes, ends
        place = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.labels, self.weights = ids[place], labels[place], weights[place]
        self.centres = lifted[np.array(centre)] if n else np.zeros((1, lifted.shape[1]))
        # what each node holds: its farthest row, least id, the labels' bits, and its label if there is one only
        self.radius, self.least = np.zeros(len(spans)), np.full(len(spans), MOST)
        self.bits, self.single, self.label = np.zeros(len(spans), np.uint64), np.zeros(len(spans), bool), np.zeros(len(spans), np.int64)
        for k, span in enumerate(spans):
            if not len(span):
                continue
            gap = lifted[span] - self.centres[k]
            self.radius[k] = np.sqrt(np.einsum("ij,ij->i", gap, gap).max())
            self.least[k] = ids[span].min()
            self.bits[k] = np.bitwise_or.reduce(label_bit(labels[span]))
            self.single[k], self.label[k] = bool((labels[span] == labels[span[0]]).all()), labels[span[0]]

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the integer products of queries (lines) with the rows below nodes (columns)."""
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        reach = lengths * self.norm
        dots = queries @ self.centres[nodes, : queries.shape[1]].T
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach[:, None] > 0, dots / reach[:, None], 0.0)
            chord = np.minimum(np.where(self.norm > 0, self.radius[nodes] / (2 * self.norm), 0.0), 1.0)
        angle = np.arccos(np.clip(cosine, -1, 1))
        ball = 2 * np.arcsin(chord)
        slack = 1e-7 * (1 + reach)[:, None]
        up = np.cos(np.maximum(angle - ball, 0)) * reach[:, None] + slack
        down = np.cos(np.minimum(angle + ball, np.pi)) * reach[:, None] - slack
        limit = float(1 << 62)
        return np.floor(np.clip(up, -limit, limit)).astype(np.int64), np.ceil(np.clip(down, -limit, limit)).astype(np.int64)


def label_bit(labels: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (labels % 64).astype(np.uint64)


@dataclass
class Queries:
    """Query rows: their own id, label and weights, and the window of scores they want."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Best:
    """The ``k`` best (score, id) of each query so far: higher scores first, then smaller ids."""

    n: int
    k: int
    scores: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self):
        self.scores = np.full((self.n, self.k), LEAST)
        self.ids = np.full((self.n, self.k), MOST)

    def may_enter(self, up: np.ndarray, least: int) -> np.ndarray:
        """Queries whose k-th row could give way to one with a score up to ``up`` and an id from ``least`` on."""
        kth = self.scores[:, -1]
        return (up > kth) | ((up == kth) & (least < self.ids[:, -1]))

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Rows with ``ids`` (columns) that ``fit`` the queries ``who`` (lines)."""
        floor = self.scores[who, -1]
        if scores.shape[1] > self.k:  # no more than the k best of these rows, and their equals, can enter
            found = np.where(fit, scores, LEAST)
            floor = np.maximum(floor, np.partition(found, -self.k, axis=1)[:, -self.k])
        line, column = np.nonzero(fit & (scores >= floor[:, None]))
        if not len(line):
            return
        touched = np.unique(line)
        old = who[touched]
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), np.searchsorted(touched, line)])
        s = np.concatenate([self.scores[old].ravel(), scores[line, column]])
        v = np.concatenate([self.ids[old].ravel(), ids[column]])
        order = np.lexsort((v, -(s + 1), q))
        first = np.searchsorted(q[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[old], self.ids[old] = s[best], v[best]


def search(tree: CoverTree, queries: Queries, best: Best, same: bool) -> int:
    """Brings the rows of a tree into ``best``; returns how many (query, row) products were made.

    The queries of a block share one queue, led by the highest bound that any of them has; at each ball only
    those go on whose own bound and window allow it. Rows of the query's own id are left out, and so are
    rows of another label (``same``) or of its own.
    """
    asked, bit = queries.weights.astype(np.float64), label_bit(queries.labels)
    product = exact_products(queries.weights, tree.weights)
    bounds: dict[int, np.ndarray] = {}
    heap: list[tuple[int, int]] = []

    def push(who: np.ndarray, nodes: np.ndarray) -> None:
        up, down = tree.bounds(asked[who], nodes)
        if same:
            wanted = (tree.bits[nodes][None, :] & bit[who][:, None]) != 0
        else:
            wanted = ~(tree.single[nodes][None, :] & (tree.label[nodes][None, :] == queries.labels[who][:, None]))
        wanted &= (up >= queries.low[who][:, None]) & (down <= queries.high[who][:, None])
        up = np.where(wanted, np.minimum(up, queries.high[who][:, None]), LEAST)
        for k in np.flatnonzero(wanted.any(axis=0)).tolist():
            node = int(nodes[k])
            bounds[node] = np.full(len(asked), LEAST)
            bounds[node][who] = up[:, k]
            heapq.heappush(heap, (-int(up[:, k].max()), node))

    push(np.arange(len(asked)), np.zeros(1, np.int64))
    made = 0
    while heap:
        _, node = heapq.heappop(heap)
        up = bounds.pop(node)
        who = np.flatnonzero((up > LEAST) & best.may_enter(up, int(tree.least[node])))
        if not len(who):
            continue
        if not tree.is_leaf[node]:
            push(who, np.arange(tree.first[node], tree.last[node]))
            continue
        rows = slice(tree.begin[node], tree.end[node])
        scores, ids = product(who, rows), tree.ids[rows]
        made += scores.size
        fit = (tree.labels[rows][None, :] == queries.labels[who][:, None]) == same
        fit &= ids[None, :] != queries.ids[who][:, None]
        fit &= (scores >= queries.low[who][:, None]) & (scores <= queries.high[who][:, None])
        best.add(who, scores, ids, fit)
    return made


def _matrix(lists: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def _padded(weights: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(weights, ((0, 0), (0, dims - weights.shape[1])))


def held_rows(rows: DataFrame, kind: int, size: int) -> DataFrame:
    """The rows of each partition in their order, ``size`` of them a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            plain = dict(zip(names, zip(*held)))
            plain["weights"] = _matrix(plain["weights"], max(1, *map(len, plain["weights"])))
            cells = [pa.array([np.asarray(plain[c], "<i8").tobytes()], pa.binary()) for c in CELLS]
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([number], pa.int64()), *cells], ["kind", "number", *CELLS])

        for batch in batches:
            names = batch.schema.names
            columns = [[w.values.to_numpy(zero_copy_only=False) for w in c] if n == "weights" else c.to_pylist() for n, c in zip(names, batch.columns)]
            for row in zip(*columns):
                held.append(row)
                if len(held) == size:
                    yield flush()
                    held, number = [], number + 1
        if held:
            yield flush()

    return rows.select("owners", F.col("vec_id").alias("ids"), F.col("label").alias("labels"), "weights", "low", "high").mapInArrow(run, HELD)


def searched(trees: DataFrame, queries: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """owner, vec_id, score: the ``k`` best rows of each tree group for each query.

    A task holds the trees of a group, and blocks of queries come by one after the other. Queries go to
    every group, rows to one; nothing passes through the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, built, dims = None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                kind, group = batch.column("kind")[i].as_py(), batch.column("grp")[i].as_py()
                owners, ids, labels, weights, low, high = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in CELLS)
                weights = weights.reshape(len(ids), -1)
                if group != at:
                    at, rows, built = group, [], []
                if not kind:
                    rows.append((ids, labels, weights))
                    continue
                if not built or weights.shape[1] > dims:
                    dims = max(weights.shape[1], *(w.shape[1] for *_, w in rows)) if rows else weights.shape[1]
                    built = [CoverTree(v, a, _padded(w, dims)) for v, a, w in rows]
                best = Best(len(ids), k)
                asked = Queries(ids, labels, _padded(weights, dims), low, high)
                for tree in built:
                    search(tree, asked, best, same)
                line, column = np.nonzero(best.ids != MOST)
                found = owners[line], best.ids[line, column], best.scores[line, column]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["owner", "vec_id", "score"])

    low, high = F.shiftright("number", 32), F.col("number").bitwiseAND((1 << 32) - 1)
    kept = trees.withColumn("grp", F.pmod(low + high, F.lit(groups)).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    spread = kept.unionByName(queries.withColumn("grp", everywhere))
    placed = spread.repartition(max(groups, 1), "grp").sortWithinPartitions("grp", "kind", "number")
    return placed.mapInArrow(run, "owner long, vec_id long, score long")


def best_found(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each owner, ranked from 1."""
    order = Window.partitionBy("owner").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integer_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str | Column, scale: int) -> DataFrame:
    """vec_id, label and floor(scale * x) of each component, for whole rows with finite components only."""
    x = F.col(embedding)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    weights: Column = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    named = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(F.coalesce(sound, F.lit(False)) & F.col(vec_id).isNotNull() & named.isNotNull())
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), named.cast("long").alias("label"), weights.alias("weights"))


def _near(rows: DataFrame, seeds: np.ndarray) -> DataFrame:
    """Adds the number of the centre nearest in angle to each row."""
    lengths = np.sqrt((seeds**2).sum(axis=1))
    unit = seeds / np.where(lengths > 0, lengths, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = unit.shape[1]
        for batch in batches:
            weights = _matrix([w.values.to_numpy(zero_copy_only=False)[:dims] for w in batch.column("weights")], dims)
            nearest = (weights @ unit.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], [*batch.schema.names, "near"])

    return rows.mapInArrow(run, "vec_id long, label long, weights array<long>, near int")


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | Column = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor, a row whose id
    is divisible by ``every``. An anchor's positives are its ``positives`` best other rows of its label; for
    each of them the ``negatives`` best rows of other labels are given whose score is between ``low`` and
    ``high`` percent of the positive's. Equal scores rank by smaller id. Rows with a null id, label or vector
    or with null or non-finite components take no part; a shorter vector counts as filled with zeros. An
    anchor row that comes several times asks once, by its least (label, vector); rows with an anchor's own
    id are never its candidates; other repeated rows each take a rank. A score beyond 62 bits is an error.
    Other columns are not read, and an empty table gives no rows.

    Rows go to trees by the nearest of some centres, then by a hash of their id, so a group of copies is
    dealt over many trees. A tree holds ``TREE_ROWS`` rows at most, a task trees of about ``GROUP_BYTES``.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, vec_id, embedding, label, scale)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "weights").limit(SAMPLE_ROWS).select("weights").collect()
    dims = max([1, *(len(r["weights"]) for r in sample)])
    picked = _matrix([np.array(r["weights"], np.int64) for r in sample], dims).astype(np.float64)
    seeds = picked[farthest_first(picked, CENTRES)[0]] if len(picked) else np.zeros((1, dims))
    dealt = written(_near(rows, seeds), "rows")

    total, group_rows = dealt.count(), max(LEAF_ROWS, GROUP_BYTES // (8 * dims))
    tree_rows, query_rows = min(TREE_ROWS, group_rows), max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * dims)))
    parts = parts_for(spark, total, group_rows)
    unasked = [F.lit(0).cast("long").alias(c) for c in ("owners", "low", "high")]
    placed = dealt.withColumn("_place", F.xxhash64("vec_id")).repartitionByRange(parts, "near", "_place").sortWithinPartitions("near", "_place", "vec_id")
    trees = written(held_rows(placed.select("*", *unasked), 0, tree_rows), "trees")
    groups = max(1, -(-total // group_rows), min(shuffle_parts(spark), -(-total // tree_rows)))

    anchors = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "weights")).alias("a"))
    anchors = written(anchors.select(F.col("vec_id").alias("owner"), "vec_id", "a.label", "a.weights"), "anchors")
    open_ends = [F.lit(s << 62).cast("long").alias(c) for s, c in ((-1, "low"), (1, "high"))]
    asked = anchors.select(F.col("owner").alias("owners"), "vec_id", "label", "weights", *open_ends)
    near = best_found(searched(trees, written(held_rows(asked, 1, query_rows), "asked"), groups, positives, True), positives)

    # the least and the largest integer score s with low * p <= 100 * s <= high * p
    p = F.col("positive_score")
    least = F.expr(f"-((-{low}L * positive_score - pmod(-{low}L * positive_score, 100L)) div 100L)")
    most = F.expr(f"({high}L * positive_score - pmod({high}L * positive_score, 100L)) div 100L")
    windows = near.select("owner", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = anchors.join(windows, "owner").withColumn("low", least).withColumn("high", most).where((F.col("low") <= F.col("high")) & p.isNotNull())
    windows = written(windows.withColumn("owners", F.monotonically_increasing_id()), "windows")
    far = best_found(searched(trees, written(held_rows(windows, 1, query_rows), "asked"), groups, negatives, False), negatives)
    named = windows.select(F.col("owners").alias("owner"), F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    found = far.select("owner", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, "owner").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same
), r AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.place <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""
