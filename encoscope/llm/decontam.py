"""Benchmark decontamination by SimHash of windows as long as each benchmark item.

Every window of a document that has as many words as an item gets a SimHash over its shingles, weighted
by how often they occur. A multi-index finds the items of that size within ``RADIUS`` bits: fingerprints
within the radius agree in one of ``BLOCKS`` blocks up to ``RADIUS // BLOCKS`` bits, so looking up each
block's value misses none. Candidates are then compared exactly by weighted Jaccard similarity of
shingles. Windows that hold no shingle of an item have similarity 0 with it and are not hashed for it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.functions.workers import per_worker

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 23
# Benchmark text that one pass over the documents takes to the tasks.
PASS_BYTES = 16 << 20
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
WINDOWS = 1 << 14


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    """Shingles with repeats; fewer words than a shingle are one shingle."""
    if not words:
        return []
    size = min(SHINGLE, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight over joint weight, where a shingle weighs as often as it occurs."""
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared) if shared else 0.0


def shingle_bits(shingles: list[tuple[str, ...]]) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    hashes = np.array([xxhash.xxh3_64_intdigest(" ".join(s)) for s in shingles], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of summed bits, as eight bytes each."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


class Vocabulary(dict):
    """Numbers of known words; any other word is 0."""

    def __missing__(self, word: str) -> int:
        return 0


@dataclass
class Size:
    """Items of one length in words: numbers, fingerprints, and for each block the items near each value."""

    items: np.ndarray
    prints: np.ndarray
    near: np.ndarray  # block, value, item

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, differing bits) within the radius."""
        found = np.zeros((len(prints), len(self.items)), bool)
        for block in range(BLOCKS):
            found |= self.near[block, prints[:, block]]
        window, item = np.nonzero(found)
        bits = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        close = bits <= RADIUS
        return window[close], self.items[item[close]], bits[close]


class ItemIndex:
    """A bounded set of benchmark items, ready to be looked for in texts."""

    def __init__(self, texts: list[str | None]):
        words = [words_of(t) for t in texts]
        self.sizes = [len(w) for w in words]
        self.weights = [Counter(shingles_of(w)) for w in words]
        self.vocabulary = Vocabulary()
        for w in words:
            for word in w:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        holders: dict[int, set[int]] = defaultdict(set)
        self.short = defaultdict(list)  # items of fewer words than a shingle, by their words
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if not w:
                continue
            by_size[len(w)].append(i)
            if len(w) < SHINGLE:
                self.short[tuple(w)].append(i)
            else:
                for code in self.codes(w)[0].tolist():
                    holders[code].add(i)
        self.known = np.array(sorted(holders), np.uint64)
        self.holders = [sorted(holders[c]) for c in self.known.tolist()]
        values = np.arange(256, dtype=np.uint8)
        self.by_size = {}
        for size, items in by_size.items():
            prints = np.concatenate([packed(shingle_bits(shingles_of(words[i])).sum(axis=0, keepdims=True)) for i in items])
            near = np.bitwise_count(values[None, :, None] ^ prints.T[:, None, :]) <= RADIUS // BLOCKS
            self.by_size[size] = Size(np.array(items), prints, near)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles whose words all occur in items, and where they start."""
        n = len(words)
        if n < SHINGLE:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.uint64, n)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(unknown[SHINGLE:] == unknown[:-SHINGLE])
        code = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            code = (code ^ ids[at + k]) * MIX
            code ^= code >> np.uint64(32)
        return code, at

    def _starts(self, words: list[str]) -> dict[int, np.ndarray]:
        """For each item that shares a shingle, the starts of item-sized windows that hold one."""
        code, at = self.codes(words)
        place = np.searchsorted(self.known, code)
        hit = np.zeros(len(code), bool)
        inside = place < len(self.known)
        hit[inside] = self.known[place[inside]] == code[inside]
        hits: dict[int, list[int]] = defaultdict(list)
        for p, a in zip(place[hit].tolist(), at[hit].tolist()):
            for item in self.holders[p]:
                hits[item].append(a)
        for size in {len(k) for k in self.short}:
            for a in range(len(words) - size + 1):
                for item in self.short.get(tuple(words[a : a + size]), ()):
                    hits[item].append(a)
        out = {}
        for item, found in hits.items():
            size, last = self.sizes[item], max(0, len(words) - self.sizes[item])
            mark = np.zeros(last + 2, np.int64)
            a = np.array(found)
            np.add.at(mark, np.clip(a - max(size - SHINGLE, 0), 0, last), 1)
            np.add.at(mark, np.clip(a, 0, last) + 1, -1)
            out[item] = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, differing bits, similarity) of the best window of each item found."""
        words = words_of(text)
        wanted = self._starts(words)
        if not wanted:
            return []
        best: dict[int, tuple] = {}
        for n in sorted({self.sizes[i] for i in wanted}):
            asked = {i for i in wanted if self.sizes[i] == n}
            starts = np.unique(np.concatenate([wanted[i] for i in asked]))
            if n < SHINGLE:
                self._short(words, n, starts, asked, best)
                continue
            gaps = np.flatnonzero(np.diff(starts) > n) + 1
            for run in np.split(starts, gaps):
                for k in range(0, len(run), WINDOWS):
                    self._search(words, n, run[k : k + WINDOWS], asked, best)
        return [(i, start, n, bits, -score) for i, (score, bits, start, n) in sorted(best.items())]

    def _search(self, words, n, starts, asked, best) -> None:
        """Windows of ``n`` words that lie near each other; what is held grows with their number alone."""
        size, first = min(SHINGLE, len(words)), int(starts[0])
        count = min(n, len(words)) - size + 1  # shingles of a window
        span = shingles_of(words[first : int(starts[-1]) + n])
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(shingle_bits(span), axis=0, dtype=np.int32)])
        part = starts - first
        prints = packed(sums[part + count] - sums[part])
        for window, item, bits in zip(*(c.tolist() for c in self.by_size[n].candidates(prints))):
            if item not in asked:
                continue
            at = int(part[window])
            score = similarity(Counter(span[at : at + count]), self.weights[item])
            start = int(starts[window])
            if score >= SIMILARITY and (item not in best or (-score, bits, start) < best[item][:3]):
                best[item] = (-score, bits, start, min(n, len(words)))

    def _short(self, words, n, starts, asked, best) -> None:
        """Items shorter than a shingle are one shingle: a window is the same or has nothing in common."""
        for start in starts.tolist():
            for item in self.short.get(tuple(words[start : start + n]), ()):
                if item in asked and item not in best:
                    best[item] = (-1.0, 0, start, n)


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[tuple[list, list]]:
    """Item ids and texts in sets of about ``pass_bytes``, one set at a time on the driver."""
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    sets = -(-total // pass_bytes)
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, sets)))
    for number in range(sets):
        rows = benchmark.where(dealt == number).select("item_id", "text").collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def _index(texts: list[str | None]):
    key = ("items", len(texts), zlib.crc32("\0".join(t or "" for t in texts).encode()))
    return per_worker(key, lambda: ItemIndex(texts))


def contaminated(documents: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, item_id, start_word, n_words, differing_bits, similarity: each item found in each document.

    Of an item's windows the most similar is given, then the nearest fingerprint, then the first. A
    document of fewer words than an item is one window. Items and documents without words, null texts
    and empty tables match nothing; items of fewer words than a shingle match as a whole. Repeated rows
    and repeated items are reported each. Only ``doc_id`` and ``text`` are read.

    Documents stay in their scan tasks. The benchmark goes to the tasks in sets of ``pass_bytes``; a
    larger one makes more passes over the documents.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((documents, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, start_word int, n_words int, differing_bits int, similarity double"

    def searched(ids: list, texts: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(texts)
            for batch in batches:
                found = [(i, *m) for i, text in enumerate(batch.column("text")) for m in index.matches(text.as_py())]
                rows, items, *values = zip(*found) if found else [()] * 6
                doc_ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                types = [pa.int32()] * 3 + [pa.float64()]
                columns = [doc_ids, pa.array([ids[i] for i in items], pa.int64() if item_kind == "bigint" else None)]
                columns += [pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "n_words", "differing_bits", "similarity"])

        return documents.select("doc_id", "text").mapInArrow(run, schema)

    parts = [searched(*part) for part in _passes(benchmark, pass_bytes)]
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def keep_clean(documents: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents in which no benchmark item is found, all columns kept. Nothing is shuffled."""
    for _, texts in _passes(benchmark, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            index = _index(texts)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t.as_py()) for t in batch.column("text")], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
