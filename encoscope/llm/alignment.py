"""Tokens of two tokenizers aligned by the bytes that they cover.

Both tokenizers cut the same bytes. All their tokens are sorted by start; a group ends where a start reaches
the largest end so far, that is where tokens of both end. Inside a group the tokens that overlap are paired,
and pairs that end together are the links. How often two ids are linked in the whole corpus is counted over
blocks of documents as packed totals (``tally``).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.functions.workers import per_worker
from encoscope.llm.common import merged_batches, row_slices, shuffle_parts
from encoscope.llm.counting import PIECES
from encoscope.llm.tally import ODD, PARTS, answered, answers_of, bits_for, dealt, filed, mixed, packed, tallied, unpacked
from encoscope.llm.tokens import UNEVEN, byte_letters

BLOCK_BYTES = 2 << 20
# Characters of texts that are cut into words at a time.
CHARACTERS = 1 << 18
# Characters of a text that are aligned at a time; longer texts are cut where both tokenizers always cut.
SEGMENT = 1 << 18
# Tokens that are sorted at a time, and words whose ids a worker remembers (twice as many at most).
TOKENS = 1 << 16
WORDS = 50_000
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "▁"  # fixed value: how sentencepiece writes a space
UNMIX = np.uint64(pow(int(ODD), -1, 1 << 64))

BLOCK = (
    "block long, doc_ids array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "kinds array<long>, places binary, often binary, pairs binary, numbers binary"
)
RESULT = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteTokens:
    """Tokens of a byte-level BPE file with the bytes of each id; strings of special tokens are plain text.

    Its merges are ranked by the ids that they make, so ``tiktoken`` gives the file's own ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        added = {t["content"] for t in parts["added_tokens"]}
        letters = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = parts["model"]["vocab"]
        merges = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in parts["model"]["merges"]]
        if merges != sorted(merges):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in added}
        self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece

    def ids(self, text: str) -> np.ndarray:
        """Ids of a blank and the text. Every byte has a token, so they always give its bytes back."""
        return np.array(self.encoding.encode_ordinary(" " + text), np.int64)


class PieceTokens:
    """Tokens of a sentencepiece model, which puts a blank in front, with the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        # a blank between two other characters starts a token if no piece goes on over one
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.words, self.older = {}, {}

    def split(self, text: str) -> list[str] | None:
        """The words of a text, if every blank in it is a certain cut."""
        return text.split(" ") if text and self.cuts and not text[:1].isspace() and not UNEVEN.search(text) else None

    def sound(self, text: str, ids: list[int]) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()

    def learn(self, words: set[str]) -> None:
        """Ids of the words that are not known yet, asked for at once; None where they do not give the bytes back."""
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        new = []
        for word in words:
            if word not in self.words:
                if word in self.older:
                    self.words[word] = self.older[word]
                else:
                    new.append(word)
        for word, ids in zip(new, self.model.encode(new, num_threads=1)):
            self.words[word] = array("i", ids).tobytes() if self.sound(word, ids) else None

    def ids(self, text: str, words: list[str] | None) -> np.ndarray | None:
        """Ids of a blank and the text, or None where they do not give its bytes back."""
        if words is None:
            ids = self.model.encode(text, num_threads=1)
            return np.array(ids, np.int64) if self.sound(text, ids) else None
        found = list(map(self.words.__getitem__, words))
        return None if None in found else np.frombuffer(b"".join(found), np.int32).astype(np.int64)


def segments(text: str, cuts: bool) -> list[str]:
    """A text cut at single blanks, which are left out, into parts of about ``SEGMENT`` characters."""
    parts, at = [], 0
    while cuts and len(text) - at > SEGMENT:
        found = CUT.search(text, at + SEGMENT - 1)
        if found is None:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    return [*parts, text[at:]] if at else [text]


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two runs of tokens over the same bytes, given the end of each token.

    Returns the tokens sorted by start (A's numbers, then B's behind them) with the group of each, and the
    numbers of the A and B tokens of every overlapping pair.
    """
    n = len(a_ends)
    end = np.concatenate([a_ends, b_ends])
    start = np.concatenate([[0], a_ends[:-1], [0], b_ends[:-1]]).astype(np.int64)[: len(end)] if len(end) else end
    kind = np.arange(len(end)) >= n
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order]) if len(end) else end
    fresh = np.concatenate([[True], start[order][1:] >= reach[:-1]]) if len(end) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    # within a group each A token meets the B tokens from the one that covers its start to the one that covers its end
    of = np.empty(len(end), np.int64)
    of[order] = group
    lowest = np.searchsorted(b_ends, start[:n], side="right")
    highest = np.searchsorted(start[n:], a_ends, side="left")
    many = np.maximum(highest - lowest, 0)
    a = np.repeat(np.arange(n), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lowest, many)
    same = of[a] == of[n + b] if len(a) else np.zeros(0, bool)
    return order, group, a[same], b[same]


class Aligner:
    """Both tokenizers of a worker, and what is built from their vocabularies once."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_size, self.b_size = (np.array(list(map(len, t.bytes)), np.int64) for t in (self.a, self.b))
        names = [[str(i).encode() for i in range(len(t.bytes))] for t in (self.a, self.b)]
        # an id as it stands before another of its side, before the other side, and before the next group
        self.text = [n + mark for side, marks in zip(names, ((b",", b"|"), (b",", b";"))) for mark in marks for n in side]
        self.shift = len(names[0]), len(names[1])

    def tokens(self, texts: list[str]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """For each text the ids of both sides of each segment; none where one side does not give the bytes back."""
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size < CHARACTERS and end < len(texts):
                continue
            parts = [[(part, self.b.split(part)) for part in segments(t, self.b.cuts)] if t else [] for t in texts[start:end]]
            self.b.learn({word for several in parts for _, words in several if words for word in words})
            for several in parts:
                b_ids = [self.b.ids(part, words) for part, words in several]
                yield [] if any(ids is None for ids in b_ids) else [(self.a.ids(part), ids) for (part, _), ids in zip(several, b_ids)]
            start, size = end, 0

    def align(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray | list]:
        """For each part its counts and its groups as text, and the linked ids with the part that they are in."""
        a_ids, b_ids = (np.concatenate([np.zeros(0, np.int64), *(p[side] for p in parts)]) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        order, group, a, b = coalesced(a_ends, b_ends)
        n_a, n_b = (np.array([len(p[side]) for p in parts], np.int64) for side in (0, 1))
        # tokens of a group: those of A, then those of B
        side = order >= len(a_ids)
        listed = np.argsort(group * 2 + side, kind="stable")
        group, side, which = group[listed], side[listed].astype(np.int64), order[listed]
        ids = np.concatenate([a_ids, b_ids])[which]
        last = np.append((np.diff(group) != 0) | (np.diff(side) != 0), True)[: len(ids)]
        codes = ids + np.where(side == 1, 2 * self.shift[0] + last * self.shift[1], last * self.shift[0])
        ends = np.cumsum(n_a + n_b)
        texts = [b"".join(map(self.text.__getitem__, codes[z - n : z].tolist())) for z, n in zip(ends.tolist(), (n_a + n_b).tolist())]
        part_of = np.repeat(np.arange(len(parts)), n_a)
        groups = np.bincount(np.repeat(np.arange(len(parts)), n_a + n_b)[np.concatenate([[True], np.diff(group) != 0])[: len(ids)]], minlength=len(parts))
        linked = a_ends[a] == b_ends[b]
        a, b = a[linked], b[linked]
        return {"n_a": n_a, "n_b": n_b, "n_groups": groups, "texts": texts, "part": part_of[a], "a": a_ids[a], "b": b_ids[b]}


def aligned_texts(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of documents: counts of each, and its linked id pairs as places in the block's sorted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        block = TaskContext.get().partitionId() << 32
        for whole in merged_batches(batches, BLOCK_BYTES):
            for batch in row_slices(whole, "text", BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([block, *_block(aligner, batch)], types(batch), strict=True)], names)
                block += 1

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        longs = pa.list_(pa.int64())
        return [pa.int64(), pa.list_(batch.schema.field("doc_id").type), longs, longs, longs, longs, pa.list_(pa.string()), longs, *[pa.binary()] * 4]

    names = [f.split(" ")[0] for f in BLOCK.split(", ")]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BLOCK.format(id=kind))


def _block(aligner: Aligner, batch: pa.RecordBatch) -> list:
    n = batch.num_rows
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups")}
    digests, pairs, owners = [hashlib.sha256() for _ in range(n)], [], []
    held, docs, size = [], [], 0

    def settle() -> None:
        found = aligner.align(held)
        who = np.array(docs, np.int64)
        for c, values in counts.items():
            np.add.at(values, who, found[c])
        for doc, text in zip(docs, found["texts"]):
            # segments are joined by the mark between groups, which the last of a document goes without
            digests[doc].update((b";" if started[doc] else b"") + text[:-1])
            started[doc] = True
        pairs.append(mixed(found["a"] << 32 | found["b"]))
        owners.append(who[found["part"]])
        held.clear(), docs.clear()

    started = [False] * n
    for doc, parts in enumerate(aligner.tokens(batch.column("text").to_pylist())):
        for part in parts:
            held.append(part)
            docs.append(doc)
            size += len(part[0]) + len(part[1])
            if size >= TOKENS:
                settle()
                size = 0
    if held:
        settle()
    keys, place, numbers = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]), return_inverse=True, return_counts=True)
    owner = np.concatenate([np.zeros(0, np.int64), *owners])
    n_links = np.bincount(owner, minlength=n)
    each, often = np.unique(owner * max(1, len(keys)) + place, return_counts=True)
    kinds = np.bincount(each // max(1, len(keys)), minlength=n)
    shas = [d.hexdigest() if begun else "" for d, begun in zip(digests, started)]
    plain = [batch.column("doc_id").to_pylist(), *(counts[c].tolist() for c in ("n_a", "n_b", "n_groups")), n_links.tolist(), shas, kinds.tolist()]
    small = packed((each % max(1, len(keys))).astype(np.uint32)), packed(often.astype(np.uint32))
    return [*plain, *small, packed(np.diff(keys, prepend=np.uint64(0))), packed(numbers.astype(np.int64))]


def align_documents(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A is a byte-level file of ``tokenizers`` and reads a blank and the text, B a model of ``sentencepiece``
    that adds the blank. A text that is null or empty, or whose bytes the tokens of one side do not give
    back, has no tokens: its counts are zero and its digest is an empty string. A link joins the A and the B
    token that end a group; the count of an id pair is the number of its links in all documents.
    ``n_best`` counts a document's links whose pair has the highest count of its B id, ties included;
    ``count_sum`` adds the counts of all its links. Repeated rows count each, rows without an id too; an
    empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    buckets = max(shuffle_parts(spark), documents.rdd.getNumPartitions())
    blocks = filed(aligned_texts(documents, a_path, b_path), "aligned", buckets)
    total = blocks.agg(F.sum(F.aggregate("kinds", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).first()["n"] or 0
    bits = bits_for(total)

    def pair_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, numbers in zip(*(batch.column(c) for c in ("block", "pairs", "numbers"))):
                yield dealt(block.as_py(), np.cumsum(unpacked(pairs.as_py(), np.uint64)), unpacked(numbers.as_py()), bits)

    def b_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.cumsum(unpacked(raw, np.uint64)) * UNMIX & np.uint64((1 << 32) - 1)
        return np.unique(mixed(ids), return_inverse=True)

    def best_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (counts,) = answers_of(batch, i, 1)
                keys, place = b_keys(batch.column("pairs")[i].as_py())
                most = np.zeros(len(keys), np.int64)
                np.maximum.at(most, place, counts)
                yield dealt(batch.column("block")[i].as_py(), keys, most, bits)

    counted = tallied(blocks.select("block", "pairs", "numbers").mapInArrow(pair_parts, PARTS), bits, "pairs")
    slim = answered(blocks.select("block", "pairs"), [counted], buckets)
    highest = tallied(slim.mapInArrow(best_parts, PARTS), bits, "highest", largest=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i] for c in batch.schema.names if c not in ("block", "answers")}
                counts, most = answers_of(batch, i, 2)
                _, place = b_keys(cell["pairs"].as_py())
                best = counts == most[place]
                kinds = np.array(cell["kinds"].as_py(), np.int64)
                who = np.repeat(np.arange(len(kinds)), kinds)
                at, often = (unpacked(cell[c].as_py(), np.uint32).astype(np.int64) for c in ("places", "often"))
                n_best, count_sum = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
                np.add.at(n_best, who, often * best[at])
                np.add.at(count_sum, who, often * counts[at])
                values = [cell[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*values, pa.array(n_best), pa.array(count_sum), cell["groups_sha256"].values], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    return answered(blocks, [counted, highest], buckets).mapInArrow(run, RESULT.format(id=kind))
