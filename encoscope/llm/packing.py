"""Best-fit packing of token pieces into sequences, by rounds of local best fit and a merge tree.

Pieces are dealt into buckets by a hash; each bucket packs its pieces best-fit, longest first. Bins with
no room worth filling are final. All others go on as items of their fill to the next round, where as many
buckets as they need pack them in a new deal, until one bucket has packed the last of them or a round
saves next to nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.functions.workers import per_worker
from encoscope.llm.common import written
from encoscope.llm.tokens import Encoder

# Items that one task packs at a time.
BUCKET_ITEMS = 25_000
# A later round that makes less than this share fewer bins than it was given ends the packing.
LEAST_SAVING = 1e-3
# Tokens left in a bin that are not worth another round.
SLACK = 4

PIECE_NAMES = ["item", "doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
PIECE = "item long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` ids where longer.

    Only lengths and checksums leave the task. A null text is empty and has one piece, the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("encode", tokenizer), lambda: Encoder(tokenizer))
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, fields = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encoder.encode(text.as_py()).astype("<u4"), np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append(i)
                    fields.append((item, piece, start, len(part), zlib.crc32(part.tobytes())))
                    item += 1
            if not rows:
                continue
            numbers, pieces, starts, lengths, sums = (pa.array(c, t) for c, t in zip(zip(*fields), PIECE_TYPES, strict=True))
            doc_ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([numbers, doc_ids, pieces, starts, lengths, sums], PIECE_NAMES)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, PIECE.format(id=kind))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the fill of each bin: longest first, into the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    rooms: list[int] = []  # rooms that some open bin has, ascending
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b = len(fills)
            fills.append(0)
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                del rooms[at]
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        room = capacity - fills[b]
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins, offsets, fills


def _pack_round(items: DataFrame, buckets: int, level: int, capacity: int) -> DataFrame:
    """Adds bin, offset and open to items; bin ids are unique over rounds."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", kind="stable")
        bins, offsets, fills = best_fit(group["length"].to_numpy(), capacity)
        fill = np.array(fills, dtype=np.int64)
        is_open = capacity - fill > SLACK
        number = level << 58 | int(group["bucket"].iloc[0]) << 32
        return group.drop(columns="bucket").assign(
            bin=bins + number, offset=offsets, fill=fill[bins], open=is_open[bins]
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    given = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    return given.groupBy("bucket").applyInPandas(pack, f"{fields}, bin long, offset long, fill long, open boolean")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts hold the end id only; repeated rows are packed each; a full piece is a sequence
    of its own; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.

    A bucket packs about ``BUCKET_ITEMS`` items in memory, in every round: where pieces cannot share a
    sequence at all, as many buckets are needed as before, and the packing ends with the first round that
    saves less than ``LEAST_SAVING`` of its bins.
    """
    pieces = written(token_pieces(documents, tokenizer, capacity, end_id), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("bin", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    items, level, rounds = pieces.where(F.col("length") < capacity), 0, []
    given = items.count()
    while True:
        buckets = max(1, -(-given // BUCKET_ITEMS))
        done = written(_pack_round(items, buckets, level, capacity), "packed")
        rounds.append(done)
        made = done.where("offset = 0").agg(F.count("*").alias("bins"), F.count_if("open").alias("open")).first()
        if buckets == 1 or made["open"] < 2 or (level and given - made["bins"] < LEAST_SAVING * given):
            break
        items = done.where("open and offset = 0").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        given, level = made["open"], level + 1

    first, *later = rounds
    placed = first.drop("fill", "open")
    for done in later:
        up = done.select(F.col("item").alias("bin"), F.col("bin").alias("_up"), F.col("offset").alias("_by"))
        placed = placed.join(up, "bin", "left")
        placed = placed.withColumn("offset", F.col("offset") + F.coalesce("_by", F.lit(0)))
        placed = placed.withColumn("bin", F.coalesce("_up", "bin")).drop("_up", "_by")
    out = [full.select(placed.columns), placed]
    return reduce(DataFrame.unionByName, out).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
