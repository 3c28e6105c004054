"""Token counts by byte-pair merging, without ids.

The count of a word is its number of symbols minus the number of merges. Merges are found with a heap of
adjacent pairs by rank over a doubly linked list of symbols.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.functions.workers import per_worker
from encoscope.llm.tokens import ChunkCache, byte_letters

# Fixed value: how byte-level pre-tokenizers cut a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Merges that byte-pair encoding makes in ``symbols``: lowest rank first, leftmost of equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    symbols = list(symbols)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        # an entry is stale once either side has grown or gone
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return merges


class Counter:
    """Token counts for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        merges = (m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.pieces = regex.compile(PIECES)
        added = tuple(t["content"] for t in parts["added_tokens"])
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cache = ChunkCache(self._chunk, added, True)

    def _pieces(self, text: str) -> int:
        total = 0
        for piece in self.pieces.findall(text):
            symbols = list(piece.encode().decode("latin-1").translate(self.letters))
            total += len(symbols) - merge_count(symbols, self.ranks)
        return total

    def _chunk(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._pieces(text)
        # each of the tokenizer's own strings is one token, and cuts the text
        return len(self.added.findall(text)) + sum(map(self._pieces, self.added.split(text)))

    def count(self, text: str | None) -> int:
        return sum(self.cache.values(text or ""))


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document.

    A null or empty text has no tokens. Repeated rows are counted each; an empty table gives no rows.
    Rows stay in their scan tasks; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("count", tokenizer), lambda: Counter(tokenizer))
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    given = documents.select("doc_id", "text", size)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
