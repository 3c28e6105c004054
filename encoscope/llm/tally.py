"""Totals over the corpus for the keys of blocks of documents, sent as packed runs.

Each block has a sorted list of distinct 64-bit keys, whose high bits are even (hashes, or ids spread by
``mixed``), with a number each. Keys are dealt into buckets by their high bits; the task of a bucket adds the
numbers of equal keys and gives every block the totals of its own keys in their order. A key comes once
from each block however often it occurs there, so no key is hot, and nothing passes through the driver.

There are ``BUCKETS`` buckets, and more once they would hold over ``BUCKET_KEYS`` keys each. A block makes a
row for each bucket that it has keys for; where buckets outnumber its keys, a row holds a single key.

Keys may also be rows of small numbers (``dealt_rows``). They are sent as a tree, a number once below what
stands in front of it, which takes a fraction of the bytes of a hash. What a step says to a block can be
filed beside the blocks (``gathered``): it is shuffled once, however many steps come after.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.functions.workers import per_worker
from encoscope.llm.common import shuffle_parts, written
from encoscope.session import scratch_path

BUCKETS = 64
BUCKET_KEYS = 1 << 21
PARTS = "block long, bucket long, keys binary, numbers binary"
ODD = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Numbers of 64 or 32 bits by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return per_worker("zstd", lambda: zstandard.ZstdCompressor(level=1)).compress(planes.tobytes())


def unpacked(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(per_worker("unzstd", zstandard.ZstdDecompressor).decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def mixed(values: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 in an order without regard to size; different numbers stay different."""
    return values.astype(np.uint64) * ODD


def bits_for(keys: int) -> int:
    """Bits of the bucket number for about ``keys`` keys in all."""
    return min(40, math.ceil(math.log2(max(BUCKETS, keys / BUCKET_KEYS))))


def dealt(block: int, keys: np.ndarray, numbers: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of ``PARTS`` for a block's sorted distinct keys (unsigned) and their numbers."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(keys))
    runs = [packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(starts, ends)]
    sums = [packed(np.ascontiguousarray(numbers[a:b], np.int64)) for a, b in zip(starts, ends)]
    columns = [pa.array(np.full(len(starts), block)), pa.array(bucket[starts]), pa.array(runs, pa.binary()), pa.array(sums, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "keys", "numbers"])


def coded(columns: list[np.ndarray]) -> bytes:
    """Sorted distinct rows of 32-bit numbers as a tree: a number once for all rows that begin alike up to it, as the step from its elder sibling."""
    fresh, sizes, streams = np.zeros(len(columns[0]), bool), [], []
    fresh[:1] = True
    for column in columns:
        new = fresh.copy()
        new[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(new)
        value = np.diff(column[at].astype(np.int64), prepend=0)
        first = fresh[at]
        value[first] = column[at][first]
        if streams:
            streams.append(np.diff(np.append(np.flatnonzero(first), len(at))) - 1)  # younger siblings
        streams.append(value)
        sizes.append(len(at))
        fresh = new
    planes = [v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in streams]
    raw = np.array(sizes, "<u4").tobytes() + b"".join(planes)
    return per_worker("zstd", lambda: zstandard.ZstdCompressor(level=1)).compress(raw)


def decoded(raw: bytes, width: int) -> list[np.ndarray]:
    """The columns of ``coded`` rows."""
    raw = per_worker("unzstd", zstandard.ZstdDecompressor).decompress(raw)
    sizes, at = np.frombuffer(raw, "<u4", width).tolist(), 4 * width

    def stream(n: int) -> np.ndarray:
        nonlocal at
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        at += 4 * n
        return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)

    columns = [np.cumsum(stream(sizes[0]))]
    for n in sizes[1:]:
        children = stream(len(columns[0])) + 1
        value = np.cumsum(stream(n))
        begin = np.cumsum(children) - children
        value -= np.repeat(np.where(begin > 0, value[begin - 1], 0), children)
        columns = [*(np.repeat(c, children) for c in columns), value]
    return columns


def dealt_rows(block: int, bucket: np.ndarray, columns: list[np.ndarray], numbers: np.ndarray) -> pa.RecordBatch:
    """Rows of ``PARTS`` for keys that are rows of numbers below 2**32, sorted by bucket and then by columns."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    runs = [coded([c[a:b] for c in columns]) for a, b in zip(starts, ends)]
    folded = np.ascontiguousarray(numbers, np.int64)
    folded = folded << 1 ^ folded >> 63  # the sign goes last, so that small numbers have empty high bytes
    sums = [packed(folded[a:b]) for a, b in zip(starts, ends)]
    values = [pa.array(np.full(len(starts), block)), pa.array(bucket[starts], pa.int64()), pa.array(runs, pa.binary()), pa.array(sums, pa.binary())]
    return pa.RecordBatch.from_arrays(values, ["block", "bucket", "keys", "numbers"])


def one_key(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row, equal for equal rows and in their order."""
    key = columns[0].astype(np.uint64)
    for number, column in enumerate(columns[1:]):
        if number:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key << np.uint64(32) | column.astype(np.uint64)
    return key


def totals(parts: DataFrame, tasks: int, largest: bool = False, width: int = 0, sign: bool = False, bits: int | None = None) -> DataFrame:
    """block, bucket, totals (packed), found: sums of equal keys, or the ``largest`` number of each.

    ``found`` counts the bucket's distinct keys with a total above zero, in one row of the bucket. Keys of
    a ``width`` are rows of so many numbers. With ``sign`` a total is 1 if it is above zero, else 0. With the
    ``bits`` of the buckets, ``places`` numbers the distinct keys of all buckets, small ones for large totals.
    """

    def add(group: pa.Table) -> pa.Table:
        numbers = [unpacked(n.as_py()) for n in group["numbers"]]
        cuts = np.cumsum([len(n) for n in numbers])[:-1]
        numbers = np.concatenate(numbers)
        if width:
            numbers = numbers >> 1 ^ -(numbers & 1)
            keys = one_key([np.concatenate(c) for c in zip(*(decoded(k.as_py(), width) for k in group["keys"]))])
        else:
            keys = np.concatenate([np.cumsum(unpacked(k.as_py(), np.uint64)) for k in group["keys"]])
        order = np.argsort(keys, kind="stable")
        edge = np.concatenate([[True], np.diff(keys[order]) != 0])
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(edge) - 1
        total = (np.maximum if largest else np.add).reduceat(numbers[order], np.flatnonzero(edge))
        found = np.zeros(len(cuts) + 1, np.int64)
        found[0] = (total > 0).sum()
        if sign:
            total = (total > 0).astype(np.int64)
        split = lambda values, kind: [packed(np.ascontiguousarray(part, kind)) for part in np.split(values[which], cuts)]
        table = {"block": group["block"], "bucket": group["bucket"], "totals": pa.array(split(total, np.int64), pa.binary()), "found": pa.array(found)}
        if bits is not None:
            place = np.empty(len(total), np.int64)
            place[np.argsort(-total, kind="stable")] = np.arange(len(total))
            place = (place << bits) + group["bucket"][0].as_py()
            if place.max() >> 32:
                raise OverflowError("over 2**32 different keys")
            table["places"] = pa.array(split(place, np.uint32), pa.binary())
        return pa.table(table)

    placed = parts.repartition(tasks, "bucket")
    return placed.groupBy("bucket").applyInArrow(add, "block long, bucket long, totals binary, found long" + ", places binary" * (bits is not None))


def bucket_tasks(parts: DataFrame, bits: int) -> int:
    return max(shuffle_parts(parts.sparkSession), 1 << max(0, bits - 3))


def tallied(parts: DataFrame, bits: int, name: str, largest: bool = False) -> DataFrame:
    """The totals, written to the shared folder."""
    return written(totals(parts, bucket_tasks(parts, bits), largest), name)


def filed(blocks: DataFrame, name: str, buckets: int) -> DataFrame:
    """``blocks`` written as a table in buckets by block, so that joins of answers to it leave it in place."""
    spark = blocks.sparkSession
    path, table = scratch_path(spark, name), f"blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(table)
    return spark.table(table)


def answered(blocks: DataFrame, steps: list[DataFrame], buckets: int) -> DataFrame:
    """``blocks`` (as filed) with ``answers``: for each step the packed totals of a block's keys in order."""
    if not steps:
        return blocks
    told = None
    for number, step in enumerate(steps):
        one = step.select("block", F.struct(F.lit(number).alias("step"), "bucket", "totals").alias("answer"))
        told = one if told is None else told.unionByName(one)
    told = told.repartition(buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list("answer")).alias("answers"))
    return blocks.join(told.hint("merge"), "block", "left")


def answers_of(batch: pa.RecordBatch, row: int, steps: int) -> Iterator[np.ndarray]:
    """The totals of each step for one block of a batch."""
    given = batch.column("answers")[row].values if steps else None
    runs: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(steps)]
    if given is not None:
        for step, raw in zip(given.field("step"), given.field("totals")):
            runs[step.as_py()].append(unpacked(raw.as_py()))
    return map(np.concatenate, runs)


def gathered(told: DataFrame, name: str, buckets: int) -> DataFrame:
    """block, told, found: the rows of ``totals`` by bucket, filed by block like the blocks.

    Joined to blocks in as many ``buckets``, neither side is shuffled again.
    """
    given = [c for c in ("totals", "places") if c in told.columns]
    runs = F.sort_array(F.collect_list(F.struct("bucket", *given)))
    return filed(told.repartition(buckets, "block").groupBy("block").agg(runs.alias("told"), F.sum("found").alias("found")), name, buckets)


def beside(blocks: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``blocks`` (as filed) with ``told_0`` and so on, what each gathered step says to a block."""
    for number, step in enumerate(steps):
        blocks = blocks.join(step.select("block", F.col("told").alias(f"told_{number}")).hint("merge"), "block", "left")
    return blocks


def told_of(batch: pa.RecordBatch, row: int, step: int, field: str = "totals", kind=np.int64) -> np.ndarray:
    """What a step says to one block of a batch, for the block's keys in their order."""
    given = batch.column(f"told_{step}")[row].values
    return np.concatenate([np.zeros(0, kind), *(unpacked(raw.as_py(), kind) for raw in (given.field(field) if given is not None else ()))])
