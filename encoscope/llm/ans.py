"""Token ids in files of range asymmetric numeral system (rANS) blocks.

One static table of symbol frequencies serves all files. Ids are written in ascending order of document
id in blocks of whole documents. A block interleaves ``LANES`` coder states: id i belongs to lane i mod
LANES, and one numpy step codes one id of each lane. Blocks are independent; within a block, the states
are kept at every ``EVERY`` steps, so a reader may start at any of these checkpoints.

A file set is a folder with two Parquet tables: ``table`` (symbol, freq; ``freq`` sums to 2**bits) and
``blocks``, one row a block with the columns of ``BLOCK``. ``words`` are little-endian 32-bit
renormalisation words in the order in which a decoder takes them. ``checkpoints`` hold, for each
checkpoint, one 64-bit word offset and the 64-bit state of each lane.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encoscope.functions.workers import per_worker
from encoscope.llm.common import parts_for, row_slices, written
from encoscope.llm.tokens import Encoder

LANES = 1024
EVERY = 128
BLOCK_TOKENS = 1 << 19
PART_TOKENS = 1 << 25
# Bytes of text whose distinct words are looked up together.
BATCH_BYTES = 8 << 20
LOW = 1 << 31  # states stay in [2**31, 2**63)

BLOCK = (
    "part int, block long, n_tokens long, doc_ids array<{id}>, doc_tokens array<long>, bits int, lanes int, every int, "
    "checkpoints binary, words binary, payload_crc32 long, ids_crc32 long"
)


class Table:
    """Frequencies of symbols that sum to 2**bits, with the start of each symbol's range."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        total = int(freq.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits:
            raise ValueError("frequencies must sum to a power of two")
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def scaled(counts: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Counts scaled to a sum of 2**bits; a symbol that occurs keeps one at least."""
    used = int((counts > 0).sum())
    bits = max(16, used.bit_length() + 2) if bits is None else bits
    if used > 1 << bits or bits > 24:
        raise ValueError("too many symbols for one table")
    if not used:  # no ids at all: any table will do
        return np.array([1 << bits], np.int64)
    size = 1 << bits
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size / counts.sum()).astype(np.int64), 0)
    extra = size - int(freq.sum())
    if extra > 0:
        freq[int(freq.argmax())] += extra
    while extra < 0:  # take back from the most frequent, at most half of each
        top = int(freq.argmax())
        took = min(-extra, int(freq[top]) // 2)
        freq[top] -= took
        extra += took
    return freq


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> tuple[bytes, bytes]:
    """Checkpoints and words of one block."""
    n = len(ids)
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    top, bits = np.uint64(63 - table.bits), np.uint64(table.bits)
    limit, half = freq << top, np.uint64(32)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    kept: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        over = x >= limit[a:b]
        words.append(x[over].astype("<u4"))
        x = np.where(over, x >> half, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + start[a:b]
        if step % every == 0:
            kept.append(state.copy())
    words.reverse()
    kept.reverse()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint64)
    points = b"".join(int(before[k * every]).to_bytes(8, "little") + s.astype("<u8").tobytes() for k, s in enumerate(kept))
    return points, np.concatenate(words).tobytes() if words else b""


def decode(points: bytes, words: bytes, n: int, table: Table, lanes: int, every: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids between two checkpoints of a block (all of it by default)."""
    steps = -(-n // lanes)
    end = steps if last is None else min(steps, last * every)
    if first * every >= end:
        return np.zeros(0, np.uint32)
    at = first * 8 * (lanes + 1)
    state = np.frombuffer(points, "<u8", lanes, at + 8).copy()
    place = int.from_bytes(points[at : at + 8], "little")
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    bits, mask, half, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32), np.uint64(LOW)
    out = []
    for step in range(first * every, end):
        x = state[: min(lanes, n - step * lanes)]
        slot = x & mask
        found = table.symbol[slot]
        x = table.freq[found] * (x >> bits) + slot - table.start[found]
        need = np.flatnonzero(x < low)
        x[need] = (x[need] << half) | stream[place : place + len(need)]
        place += len(need)
        state[: len(x)] = x
        out.append(found)
    return np.concatenate(out)


def token_rows(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (16 or 32 bits each, little-endian) with the end id; a null text is empty.

    The last row of a task holds no document but ``counts``: how often each id came, 64 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("encode", tokenizer), lambda: Encoder(tokenizer))
        end = np.array([end_id], dtype=encoder.dtype)
        counts = np.zeros(0, np.int64)

        def rows(doc_ids: pa.Array, ids: list, tally: bytes | None) -> pa.RecordBatch:
            widths = [int(encoder.dtype[2:])] * len(ids)
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array(widths, pa.int32()), pa.array([tally] * len(ids), pa.binary())], names)

        for whole in batches:
            for batch in row_slices(whole, "text", BATCH_BYTES):
                ids = [np.concatenate([i, end]) for i in encoder.encode_many(batch.column("text"))]
                one = np.bincount(np.concatenate(ids))
                counts = np.pad(counts, (0, max(0, len(one) - len(counts))))
                counts[: len(one)] += one
                yield rows(batch.column("doc_id"), [i.tobytes() for i in ids], None)
            kind = whole.schema.field("doc_id").type
        if len(counts):
            yield rows(pa.nulls(1, kind), [None], counts.astype("<i8").tobytes())

    names = ["doc_id", "ids", "width", "counts"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, width int, counts binary")


def symbol_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, from the counts of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("counts"):
                counts = np.frombuffer(raw.as_py(), "<i8")
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["symbol", "n"])

    found = tokens.select("counts").where("counts is not null").mapInArrow(run, "symbol long, n long")
    return found.groupBy("symbol").agg(F.sum("n").alias("n"))


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the file set of a table's documents.

    The table is tokenised once, into the shared folder; counts over all of it give the frequency table
    (bounded by the vocabulary). Then rows are range-partitioned and sorted by document id, null first,
    and coded one block at a time.
    """
    spark = documents.sparkSession
    tokens = written(token_rows(documents, tokenizer, end_id), "tokens")
    rows = symbol_counts(tokens).collect()
    counts = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["symbol"]] = r["n"]
    freq = scaled(counts)
    used = np.flatnonzero(freq).tolist()
    spark.createDataFrame([(s, int(freq[s])) for s in used], "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    kind = documents.schema["doc_id"].dataType.simpleString()
    lane_count, step_count = LANES, EVERY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0

        def flush():
            ids = np.concatenate(held)
            points, words = encode(ids, table, lane_count, step_count)
            whole = zlib.crc32(words, zlib.crc32(points))
            row = [part, block, len(ids), doc_ids, [len(h) for h in held], table.bits, lane_count, step_count, points, words, whole, zlib.crc32(ids.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            for doc_id, ids, width in zip(batch.column("doc_id"), batch.column("ids"), batch.column("width")):
                doc_ids.append(doc_id.as_py())
                held.append(np.frombuffer(ids.as_py(), f"<u{width.as_py()}").astype(np.uint32))
                size += len(held[-1])
                if size >= block_tokens:
                    yield flush()
                    doc_ids, held, size, block = [], [], 0, block + 1
        if held:
            yield flush()

    schema = BLOCK.format(id=kind)
    names = [f.name for f in T.StructType.fromDDL(schema)]
    parts = parts_for(spark, int(counts.sum()), PART_TOKENS)
    placed = tokens.where("counts is null").select("doc_id", "ids", "width").repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    placed.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a file set.

    Starts come from the block heads alone. A block that fails a checksum ends the job with an error.
    """
    freq_rows = spark.read.parquet(f"{path}/table").collect()  # bounded by the vocabulary
    freq = np.zeros(max((r["symbol"] for r in freq_rows), default=0) + 1, np.int64)
    for r in freq_rows:
        freq[r["symbol"]] = r["freq"]
    blocks = spark.read.parquet(f"{path}/blocks")
    heads = blocks.select("part", "block", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    starts = heads.withColumn("_in", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("_base") + F.col("_in")).alias("first"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if zlib.crc32(row["words"], zlib.crc32(row["checkpoints"])) != row["payload_crc32"]:
                    raise ValueError(f"block {row['part']}.{row['block']}: its payload is damaged")
                ids = decode(row["checkpoints"], row["words"], row["n_tokens"], table, row["lanes"], row["every"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}.{row['block']}: its ids are wrong")
                ends = np.cumsum(row["doc_tokens"])
                begins = ends - row["doc_tokens"]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                doc_ids = batch.column("doc_ids")[i].values
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([row[k]] * len(sums), t) for k, t in (("part", pa.int32()), ("block", pa.int64()))],
                        doc_ids,
                        *[pa.array(v, pa.int64()) for v in (begins, row["doc_tokens"], sums)],
                    ],
                    ["part", "block", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    read = blocks.mapInArrow(run, f"part int, block long, doc_id {kind}, begin long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
