"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints within ``RADIUS`` bits agree on one of ``RADIUS + 1`` blocks of bits, so the table is dealt by
the value of each block. In a group, fingerprints are sorted by Gray rank, which keeps those that share
bits together. Upper nodes hold the bits that all fingerprints below share; a search goes down from the
root, adds up differences in the bits that are new at each node, and prunes a node, with everything
below, once they exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encoscope.llm.common import parts_for, row_slices, utf8, written
from encoscope.llm.components import connected

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
FANOUT = 8
# A group with more fingerprints is dealt again by the values of its remaining bits.
GROUP = 4096
LEVELS = 4
# (query, fingerprint) pairs that a search may hold at once.
FRONTIER = 1 << 21
SLICE = 1 << 16

# A-Z to lower case; all white space bytes to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text's shingles: a bit is set if it is in more than half of their hashes."""
    words = raw.translate(FOLD).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    size = min(n, SHINGLE)
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: n - size] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[k : k + SLICE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id, ``more`` and fp (as a signed long) of every document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "raw", 16 << 20):
                prints = np.array([fingerprint(raw.as_py()) for raw in batch.column("raw")], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept.names), pa.array(prints.view(np.int64))], [*kept.names, "fp"])

    kept = documents.select("doc_id", *more).schema
    given = documents.select("doc_id", *more, utf8(F.col("text")).alias("raw"))
    return given.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def split_mask(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """``mask`` with each of ``parts`` nearly equal blocks of its free bits added."""
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (group, Gray rank); a root for each group."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        every = np.uint64((1 << BITS) - 1)
        n = len(prints)
        self.prints = prints
        shared, pattern = np.full(n, every), prints
        low, high, owner = prints, prints, group
        first, last = np.arange(n), np.arange(n)
        self.levels = [(shared, pattern, first, last, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while True:
            edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            if edge.all():
                break
            starts = np.flatnonzero(edge)
            inside = np.arange(len(owner)) - starts[np.cumsum(edge) - 1]
            at = np.flatnonzero(inside % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            stop = np.append(at[1:], len(owner))
            first, last, owner = first[at], last[stop - 1], owner[at]
            shared = ~(low ^ high)
            self.levels.append((shared, low & shared, first, last, at, stop))
        self.root_of = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1 if n else np.zeros(0, np.int64)

    def pairs(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i in ``queries`` and i < j, of one group that differ in ``radius`` bits at most."""
        q, node = queries, self.root_of[queries]
        diff = np.zeros(len(q), np.uint8)  # a query is below its root, so it has what the root shares
        for depth in range(len(self.levels) - 1, 0, -1):
            above, _, _, _, at, stop = self.levels[depth]
            shared, pattern, _, last, _, _ = self.levels[depth - 1]
            n = stop[node] - at[node]
            child = np.repeat(at[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            fresh = shared[child] & ~np.repeat(above[node], n)
            q, diff = np.repeat(q, n), np.repeat(diff, n)
            diff = diff + np.bitwise_count((self.prints[q] ^ pattern[child]) & fresh)
            near = (diff <= radius) & (last[child] > q)
            q, node, diff = q[near], child[near], diff[near]
        later = node > q
        return q[later], node[later]


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after uniting the classes of each pair; a label is the least member of its class."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def linked_classes(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the sorted fingerprints the position of the least one linked to it within its group."""
    index = GrayIndex(prints, group)
    labels = np.arange(len(prints))
    sizes = np.bincount(index.root_of)[index.root_of] if len(prints) else labels
    work = np.cumsum(sizes)
    begin = 0
    while begin < len(prints):
        end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + FRONTIER, side="right")))
        many = np.arange(begin, end)
        labels = join_labels(labels, *index.pairs(many[sizes[begin:end] > 1], radius))
        begin = end
    return labels


def _search(dealt: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) that connect what is within the radius in each group: fewer than its fingerprints."""

    def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
        fp, mask, value = columns
        edge = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        group = np.concatenate([[0], np.cumsum(edge)])
        labels = linked_classes(fp.view(np.uint64), group)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(pair) for pair in zip(held, new)] if held else new
            _, mask, value = held
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
            if len(edges):  # the last group may go on in the next batch
                cut = int(edges[-1]) + 1
                yield settle([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield settle(held)

    order = ["mask", "value", gray_rank(F.col("fp"))]
    return dealt.select("fp", "mask", "value").repartition(parts, "mask", "value").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links between distinct fingerprints ``fp`` that connect all that differ in ``radius`` bits at most.

    A group above ``group`` fingerprints is dealt again by blocks of its free bits, which keeps every
    pair together once more. After ``LEVELS`` deals no more than 21 bits are free, which bounds any group
    to 2**21 fingerprints whatever the corpus.
    """
    spark = prints.sparkSession
    masks, rows, found = [0], prints.select("fp", F.lit(0).cast("long").alias("mask")), []
    for level in range(LEVELS):
        children = {_signed(m): [_signed(c) for c in split_mask(m, radius + 1)] for m in masks}
        table = F.create_map(*[x for m, cs in children.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
        rows = rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({c % (1 << BITS) for cs in children.values() for c in cs})
        hot = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > group)
        hot = written(hot.select("mask", "value"), "hot")
        if level == LEVELS - 1 or hot.isEmpty():
            found.append(rows)
            break
        found.append(rows.join(hot, ["mask", "value"], "left_anti"))
        rows = written(rows.join(hot, ["mask", "value"], "left_semi").select("fp", "mask"), "dealt")
    links = None
    parts = parts_for(spark, (radius + 1) * prints.count(), 1 << 19)
    for part in found:
        some = _search(part, parts)
        links = some if links is None else links.unionByName(some)
    return links


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked, directly or over others).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle; a text without words, also a null one, has fingerprint zero and links like
    any other. Repeated rows get a row each. A null doc_id takes no part in the smallest id. An empty
    table gives no rows. Copies meet in one fingerprint before any search, so only distinct fingerprints
    are compared; no pairs of a group leave their task, only links that connect it.
    """
    signed = written(fingerprints(documents), "fingerprints")
    prints = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected(near_links(prints.select("fp"), radius))
    classes = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return signed.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates; all columns kept.

    A row is told by its id and a 64-bit hash of its text, so rows of one id with different texts are
    judged each by its own text. The row with the smallest id stays, a null id being the largest, then
    the one with the smallest hash; of rows that agree in both, one stays. An empty table stays empty.
    """
    text = F.xxhash64("text").alias("_nd_text")
    signed = written(fingerprints(documents, text), "fingerprints")
    roots = connected(near_links(signed.select("fp").distinct(), radius))
    rows = signed.join(roots, signed["fp"] == roots["node"], "left").select("doc_id", "_nd_text", F.coalesce("root", "fp").alias("root"))
    rows = written(rows.groupBy("root", "doc_id", "_nd_text").agg(F.count("*").alias("n")), "classes")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_nd_text")).alias("_nd_first"))
    stays = F.col("doc_id").eqNullSafe(F.col("_nd_first.doc_id")) & (F.col("_nd_text") == F.col("_nd_first._nd_text"))
    judged = rows.join(first, "root").select(F.col("doc_id").alias("_nd_id"), "_nd_text", "n", stays.alias("stays"))
    others = judged.where("not stays").select("_nd_id", "_nd_text")
    # one plan at every size: rows and documents meet by a shuffle, also where few rows would fit a broadcast
    same = documents["doc_id"].eqNullSafe(others["_nd_id"]) & (F.xxhash64(documents["text"]) == others["_nd_text"])
    kept = documents.join(others.hint("merge"), same, "left_anti")
    if judged.where("stays and n > 1").isEmpty():
        return kept
    return kept.withColumn("_nd_text", text).dropDuplicates(["doc_id", "_nd_text"]).drop("_nd_text")
