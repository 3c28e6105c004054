"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a context: a run of words that stands in front of a word. The root is the empty
context, with smoothed word frequencies. A longer context is tested if the one without its first word is a
state and it occurs ``least`` times; it becomes a state if its next-word distribution diverges from that of the shorter one: the mean log-likelihood of the training words after it, each left out of the counts
it is judged by, must rise by ``MIN_GAIN``. The distribution of a state is smoothed by that of the next
shorter one. A word is scored by the longest state that its text gives it.

Documents are read once and kept as blocks of word numbers. Counts and gains go over all blocks as packed
totals (``tally``), one level of the tree after the other, so the model is never held in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.llm.common import merged_batches, row_slices, shuffle_parts, shuffles_dropped, small_batches
from encoscope.llm.tally import PARTS, beside, bits_for, bucket_tasks, dealt, dealt_rows, filed, gathered, packed, told_of, totals, unpacked

ORDER = 2
MIN_COUNT, MIN_ROOT = 64, 64
MIN_GAIN = 0.01  # in log10 units a word
POWER = 0.8  # a state with n occurrences gives its shorter state the weight of n**POWER
GAIN_UNITS = 1e6
SHARE = 1 << 17  # occurrences of a context whose events go to one bucket
BLOCK_BYTES = 9 << 20
BLOCK_TOKENS = 3 << 19
END = b" "  # no word holds a blank

BLOCK = "block long, lead long, n_train long, rows array<long>, doc_ids array<{id}>, held array<boolean>, sizes array<long>, words binary, codes binary"
PIECE = "row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token, hashes of the words that the numbers mean, and tokens of each text, with its end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    sizes = before[ends[1:]] - before[ends[:-1]]
    coded = flat.filter(full).dictionary_encode()
    words = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()] + [xxhash.xxh64_intdigest(END)]
    tokens = np.full(sizes.sum() + len(sizes), len(words) - 1, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    tokens[np.arange(len(owner)) + owner] = coded.indices.to_numpy()
    return tokens, np.array(words, np.uint64), sizes + 1


def word_blocks(documents: DataFrame, order: int, part: int, of: int) -> DataFrame:
    """Blocks of whole documents, a long one over several; such a block begins with ``lead`` words seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = TaskContext.get().partitionId() << 32
        for whole in merged_batches(batches, BLOCK_BYTES):
            for batch in row_slices(whole, "text", BLOCK_BYTES):
                tokens, words, sizes = word_codes(batch.column("text"))
                ends = np.cumsum(sizes)
                inside = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
                held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
                for a in range(0, len(tokens), BLOCK_TOKENS):
                    b = min(len(tokens), a + BLOCK_TOKENS)
                    lead = min(order, int(inside[a]))
                    often = np.bincount(tokens[a - lead : b], minlength=len(words))
                    used = np.flatnonzero(often)
                    used = used[np.lexsort((words[used], -often[used]))]  # frequent words have small numbers, and like ones are sorted
                    place = np.zeros(len(words), np.uint32)
                    place[used] = np.arange(len(used))
                    named = words[used]
                    docs = np.arange(np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right") + 1)
                    held_sizes = np.minimum(ends[docs], b) - np.maximum(ends[docs] - sizes[docs], a)
                    learnt = int(held_sizes[~held[docs]].sum())
                    values = [block, lead, learnt, (row + docs).tolist(), batch.column("doc_id").take(pa.array(docs)).to_pylist(), held[docs].tolist(), held_sizes.tolist(), packed(np.diff(named, prepend=np.uint64(0))), packed(place[tokens[a - lead : b]])]
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)
                    block += 1
                row += batch.num_rows

    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["block", "lead", "n_train", "rows", "doc_ids", "held", "sizes", "words", "codes"]
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == part, F.lit(False))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold.alias("held")).mapInArrow(run, BLOCK.format(id=kind))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, which knows their order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_count(n_train: int) -> int:
    """Occurrences for callers who want fewer contexts in larger corpora: ``MIN_COUNT``, and a ``MIN_ROOT``-th of the root of all training words."""
    return max(MIN_COUNT, math.isqrt(n_train) // MIN_ROOT)


def arranged(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by bucket, then by key."""
    order = np.argsort(key)
    small = bucket.astype(np.uint16) if len(bucket) and bucket.max() >> 16 == 0 else bucket  # sorted by radix
    return order[np.argsort(small[order], kind="stable")]


class Words:
    """One block, taken down the levels of the tree by the totals of each step.

    A run is a sequence of words that ends at a place; the runs of a level are numbered in the block. To
    other blocks words are known by the numbers that the first step gives them.
    """

    def __init__(self, lead: int, held: np.ndarray, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray, bits: int, least: int):
        self.least, self.bits = max(1, least), bits
        self.lead, self.words, self.codes = lead, words, codes
        n = len(codes)
        first = np.concatenate([[0], np.cumsum(sizes) + lead]).astype(np.int32)  # pieces; the lead belongs to the first one
        self.before = np.arange(n, dtype=np.int32) - np.repeat(first[:-1], np.diff(first))  # words of the same document in front
        self.learn = ~np.repeat(held, np.diff(first))
        self.learn[:lead] = False
        self.level = 0

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.words, kind="stable")
        return self.words[order], np.bincount(self.codes[self.learn], minlength=len(self.words))[order]

    def know_words(self, total: np.ndarray, places: np.ndarray, n_train: int, n_types: int) -> None:
        order = np.argsort(self.words, kind="stable")
        self.counts, self.numbers = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.counts[order], self.numbers[order] = total, places
        self.root = (self.counts + 0.5) / (n_train + 0.5 * (n_types + 1))
        self.p = self.root[self.codes]
        self.state = np.ones(len(self.codes), bool)
        self.run, self.often = self.codes, self.counts  # the run that ends at each place, and occurrences of each run
        self.parts = [np.arange(len(order))]  # the words of each run

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find_events(self) -> None:
        """Contexts one word longer with the word after them, where the context may be a state.

        Events go to the bucket of their context, those of a frequent one to several by the word: a share holds
        about ``SHARE`` occurrences.
        """
        self.level += 1
        at = np.flatnonzero(self.state & (self.before >= self.level)).astype(np.int32)
        at = at[self.often[self.run[at - 1]] >= self.least]
        which, found = pd.factorize(self.run[at - 1].astype(np.int64) * len(self.words) + self.codes[at])
        which = which.astype(np.int32)
        run, word = (x.astype(np.int32) for x in np.divmod(found, len(self.words)))
        there = np.zeros(len(self.often), bool)
        there[run] = True
        runs, of = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[run]
        self.columns = [self.numbers[part[runs]] for part in self.parts]
        hashes = np.zeros(len(runs), np.uint64)
        for column in self.columns:
            hashes = mix(hashes + np.uint64(1), column.astype(np.uint64))
        rank = np.empty(len(runs), np.int64)
        rank[np.lexsort(self.columns[::-1])] = np.arange(len(runs))
        # what is known of each event: its context, the word, the block's own count, the chance without the context
        grams, chance = self.often[runs], np.empty(len(found))
        chance[which] = self.p[at]
        shares = np.left_shift(1, np.ceil(np.log2(np.maximum(1, grams / SHARE))).astype(np.int64)).astype(np.uint64)
        share = mix(np.zeros(1, np.uint64), self.numbers.astype(np.uint64))[word] & (shares - np.uint64(1))[of]
        bucket = self.bucket_of(mix(hashes[of], share))
        order = arranged(bucket, (rank << 32)[of] | self.numbers[word])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.at, self.which = at, place[which]
        self.bucket, self.of, self.word, self.chance = bucket[order], of[order], word[order], chance[order]
        self.own = np.bincount(self.which[self.learn[at]], minlength=len(order))
        # contexts in the order in which they are sent, and their occurrences
        home = self.bucket_of(hashes)
        order = arranged(home, rank)
        self.home, self.columns, self.runs, self.grams = home[order], [c[order] for c in self.columns], runs[order], grams[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.of = place[self.of]

    def event_rows(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        return self.bucket, [*(c[self.of] for c in self.columns), self.numbers[self.word]], self.own

    def know_events(self, total: np.ndarray) -> None:
        self.total = total

    def context_rows(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """What each context gains on its training words, in units above the least gain, by counts without the word itself."""
        at = self.own > 0
        of = self.of[at]
        weight = self.grams**POWER
        alone = (self.total[at] - 1 + weight[of] * self.chance[at]) / (self.grams - 1 + weight)[of]
        gain = np.rint(np.log10(alone / self.chance[at]) * GAIN_UNITS).astype(np.int64) - round(MIN_GAIN * GAIN_UNITS)
        sums = np.zeros(len(self.runs), np.int64)
        np.add.at(sums, of, gain * self.own[at])
        return self.home, self.columns, sums

    def know_contexts(self, gains: np.ndarray) -> None:
        """``gains`` are 1 where a context gains more than the least, as each of its occurrences has one word after it."""
        state = (gains > 0)[self.of]
        weight = self.grams**POWER
        chance = np.where(state, (self.total + weight[self.of] * self.chance) / (self.grams + weight)[self.of], self.chance)
        self.p[self.at] = chance[self.which]
        self.state = np.zeros(len(self.codes), bool)
        self.state[self.at] = state[self.which]
        self.run = np.full(len(self.codes), len(self.total), np.int32)  # elsewhere a run that never occurs
        self.run[self.at], self.often = self.which, np.append(self.total, 0)
        self.parts = [*(part[self.runs[self.of]] for part in self.parts), self.word]


def _blocks_of(batch: pa.RecordBatch, steps: int, bits: int, n_train: int, n_types: int, least: int) -> Iterator[tuple[int, Words]]:
    """Blocks that know the totals given so far; the next keys may be asked for then."""
    for i in range(batch.num_rows):
        cell = {c: batch.column(c)[i] for c in ("lead", "held", "sizes", "words", "codes")}
        held, sizes = np.array(cell["held"].as_py(), bool), np.array(cell["sizes"].as_py(), np.int64)
        words = Words(cell["lead"].as_py(), held, sizes, np.cumsum(unpacked(cell["words"].as_py(), np.uint64)), unpacked(cell["codes"].as_py(), np.uint32), bits, least)
        total = None
        for step in range(steps):
            total = told_of(batch, i, step)
            if step == 0:
                words.know_words(total, told_of(batch, i, step, "places", np.uint32), n_train, n_types)
            elif step % 2:
                words.find_events()
                words.know_events(total)
            else:
                words.know_contexts(total)
        yield i, words
        del words, total  # before the next block is built


def asked(given: DataFrame, steps: int, bits: int, n_train: int, n_types: int, least: int) -> DataFrame:
    """Each block's keys of the next step, dealt into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in _blocks_of(batch, steps, bits, n_train, n_types, least):
                block = batch.column("block")[i].as_py()
                if not steps:
                    yield dealt(block, *words.word_keys(), bits)
                elif steps % 2:
                    words.find_events()
                    yield dealt_rows(block, *words.event_rows())
                else:
                    yield dealt_rows(block, *words.context_rows())
                del words

    return given.mapInArrow(run, PARTS)


def score_documents(documents: DataFrame, order: int = ORDER, part: int = 1, of: int = 5, least: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, and one end; a null text is
    empty and has the end only. Documents whose id, as text, has a crc32 of ``part`` modulo ``of`` are held
    out of all counts; a row without an id is learnt from. Repeated rows count and are scored each. Without
    training documents all counts are zero. An empty table gives no rows. Other columns are not read.

    A context needs ``least`` occurrences, whatever the size of the corpus; without it ``least_count`` says
    how many. ``base_score`` sums the root's log10 probabilities, ``score`` those of the longest state of each word.
    Words are told apart by 64-bit hashes, contexts and events by the numbers of their words.
    """
    spark = documents.sparkSession
    buckets = max(shuffle_parts(spark), documents.rdd.getNumPartitions())
    with small_batches(spark):
        blocks = filed(word_blocks(documents, order, part, of), "words", buckets)
    size = blocks.agg(F.sum("n_train").alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("all")).first()
    n_train, n_tokens = size["n"] or 0, size["all"] or 0
    bits, n_types = bits_for(n_tokens), 0
    needed = least_count(n_train) if least is None else least
    steps: list[DataFrame] = []
    for step in range(2 * order + 1):
        parts = asked(beside(blocks, steps), step, bits, n_train, n_types, needed)
        # keys are hashes of words, then by turns contexts with a word, and contexts
        how = {"width": (step + 1) // 2 + step % 2, "sign": step % 2 == 0} if step else {"bits": bits}
        with shuffles_dropped(spark):
            steps.append(gathered(totals(parts, bucket_tasks(parts, bits), **how), "totals", buckets))
        if not step:
            n_types = steps[0].agg(F.sum("found").alias("n")).first()["n"] or 0
    taken = len(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in _blocks_of(batch, taken, bits, n_train, n_types, needed):
                sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
                begin = np.cumsum(sizes) - sizes
                known, base, score = (np.add.reduceat(v[words.lead :], begin) for v in ((words.counts > 0).astype(np.int64)[words.codes], np.log10(words.root)[words.codes], np.log10(words.p)))
                lists = [batch.column(c)[i].values for c in ("rows", "doc_ids", "held", "sizes")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(known), pa.array(base), pa.array(score)], names)
                del words

    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    pieces = beside(blocks, steps).mapInArrow(run, PIECE.format(id=kind))
    whole = pieces.groupBy("row").agg(*[F.first(c).alias(c) for c in names[1:3]], *[F.sum(c).alias(c) for c in names[3:]])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
