"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``WINDOW`` bytes; two suffixes that agree there are a repeated
window. Suffixes are distributed by most significant digits first, a group that holds one suffix leaves,
and groups that are still together at the full depth are exactly the repeated windows. Passes:

1. *Anchor digit.* The leading digit is read where the content says, not at the first byte: at the gram
   of least hash in the window. Equal windows have it at the same place, and neighbouring windows share
   it, so one row stands for a run of suffixes (about 80). Runs whose anchor gram is unique leave.
2. *Span digit.* Runs with one anchor whose whole spans agree hold equal suffixes all along.
3. *Byte digits.* What remains are the edges of repeats. Their suffixes are sorted by digits of ``DIGIT``
   bytes down to the full depth; groups of one leave after each digit, and the survivors are compared
   byte by byte. An anchor with very many different spans has its suffixes dealt over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encoscope.llm.common import row_slices, small_batches, written

WINDOW = 200
GRAM = 32
DIGIT = 50
# Low bits of an anchor's rank hold its place in a buffer.
SHIFT = 24
BUFFER = 1 << 18
# Longer texts are read in pieces of so many windows.
PIECE = 1 << 20
# Different spans of one anchor that a task compares in memory.
ANCHOR_SPANS = 50_000
GROUP_BYTES = 4 << 20
# Text of one batch that a task hands on.
SLICE_BYTES = 2 << 20
SEED = 11

LETTERS = np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = tuple(np.uint64(m | 1) for m in np.random.default_rng(SEED + 1).integers(1 << 40, 1 << 63, 16, dtype=np.uint64).tolist())


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each position, by doubling: log2(gram) passes over the array."""
    powers, width, total = LETTERS[data], 1, None
    done = 0
    for level in range(gram.bit_length()):
        if gram >> level & 1:
            part = powers[done:] if done else powers
            if total is None:
                total = part
            else:
                n = min(len(total), len(part))
                total = (total[:n] * MIX[level]) ^ (part[:n] + MIX[level + 1])
                total ^= total >> np.uint64(29)
            done += width
        if gram >> (level + 1):
            n = len(powers) - width
            nxt = powers[:max(n, 0)] * MIX[level]
            nxt += powers[width:]
            nxt ^= nxt >> np.uint64(31)
            powers, width = nxt, width * 2
    return total[: max(0, len(data) - gram + 1)] * MIX[15]


def runs_of(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows that share an anchor: first window, number of windows, anchor position.

    ``data`` holds documents one after the other, the last byte of each before ``ends``. The anchor of a
    window is the leftmost gram in it with the least hash, so equal windows have it at the same place.
    """
    hashes = gram_hashes(data, gram)
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (hashes,)
    low = np.uint64((1 << SHIFT) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: n], least[width - have : width - have + n])
    anchor = (least[:n] & low).astype(np.int64)
    valid = np.ones(n, bool)
    for end in ends[:-1]:
        valid[max(0, end - window + 1) : end] = False
    starts = np.flatnonzero(valid & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]]))
    stop = np.flatnonzero(valid & np.concatenate([(anchor[1:] != anchor[:-1]) | ~valid[1:], [True]]))
    return starts, stop - starts + 1, anchor[starts], hashes


def _segments(raw: bytes | None) -> Iterator[tuple[int, bytes]]:
    """A text's bytes in pieces that together have all its windows, once each."""
    if raw is None or len(raw) < WINDOW:
        return
    for start in range(0, len(raw) - WINDOW + 1, PIECE):
        yield start, raw[start : start + PIECE + WINDOW - 1]


def _run_rows(keys: list[tuple], segments: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Run rows of a buffer. Of equal spans in it the first stands for all; the rest are known repeats."""
    data = b"".join(raw for _, raw in segments)
    ends = np.cumsum([len(raw) for _, raw in segments])
    starts, counts, anchors, hashes = runs_of(np.frombuffer(data, np.uint8), ends)
    owner = np.searchsorted(ends, starts, side="right")
    base = ends - [len(raw) for _, raw in segments]
    first = starts - base[owner] + np.array([at for at, _ in segments], np.int64)[owner]
    stops = starts + counts + WINDOW - 1
    spans = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist())], np.uint64)
    anchor = hashes[anchors]
    kd = np.array([k for k, _ in keys], np.int64)[owner]
    kt = np.array([k for _, k in keys], np.int32)[owner]
    order = np.lexsort((spans, anchor))
    a, s = anchor[order], spans[order]
    same = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
    again, more = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order[1:]] = same  # an earlier run of the buffer has this span
    more[order[:-1]] = same
    state = np.where(again, 2, np.where(more, 1, 0))
    place = first << 16 | (anchors - starts) << 8 | (counts - 1)
    columns = [kd, kt, place, anchor.view(np.int64), spans.view(np.int64), state.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], RUN_NAMES)


RUN_NAMES = ["kd", "kt", "place", "anchor", "span", "state"]


def suffix_runs(keyed: DataFrame) -> DataFrame:
    """One row a run: document key, place (first window, anchor offset, windows - 1), anchor and span digits.

    ``state`` 1 marks a span seen twice in its buffer, 2 a further copy of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0
        for batch in batches:
            for kd, kt, raw in zip(*(batch.column(c) for c in ("kd", "kt", "raw"))):
                for segment in _segments(raw.as_py()):
                    keys.append((kd.as_py(), kt.as_py()))
                    held.append(segment)
                    size += len(segment[1])
                    if size >= BUFFER:
                        yield _run_rows(keys, held)
                        keys, held, size = [], [], 0
        if held:
            yield _run_rows(keys, held)

    return keyed.mapInArrow(run, "kd long, kt int, place long, anchor long, span long, state int")


def repeated_runs(runs: DataFrame, anchor_spans: int = ANCHOR_SPANS) -> DataFrame:
    """Runs that may hold repeated windows: kd, kt, place, anchor, known, compare, hot.

    ``known``: all windows of the run are repeated. ``compare``: its span is to be compared with other
    spans of its anchor; of equal spans only one is. ``hot``: the anchor has many spans.
    Rows are shuffled once, by anchor; further copies within a buffer are dealt by their document instead.
    """
    dealt = runs.withColumn("_salt", F.when(F.col("state") == 2, F.xxhash64("kd", "kt", "place")).otherwise(0))
    span = Window.partitionBy("anchor", "_salt", "span")
    listed = span.orderBy("kd", "kt", "place")
    anchor = Window.partitionBy("anchor", "_salt")
    spread = dealt.repartition("anchor", "_salt")
    spread = spread.withColumn("_n", F.count("*").over(span)).withColumn("_multi", F.max("state").over(span))
    spread = spread.withColumn("_row", F.row_number().over(listed))
    spread = spread.withColumn("_before", F.lag(F.struct("kd", "kt", "place")).over(listed))
    one = F.when(F.col("_row") == 1, 1).otherwise(0)
    spread = spread.withColumn("_spans", F.sum(one).over(anchor))
    known = (F.col("_n") > 1) | (F.col("_multi") > 0)
    compare = (F.col("_spans") > 1) & (F.col("_row") == 1)
    found = spread.select(
        "kd", "kt", "place", "anchor", known.alias("known"), compare.alias("compare"), (F.col("_spans") > anchor_spans).alias("hot"), "_before"
    )
    # a row repeated with its id has the same runs again
    again = F.col("_before").eqNullSafe(F.struct("kd", "kt", "place"))
    return found.where((F.col("known") | F.col("compare")) & ~again).drop("_before")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, not touching intervals that cover the same bytes."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order]) if len(order) else stops
    first = np.concatenate([[True], starts[1:] > stops[:-1]]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return starts[at], np.maximum.reduceat(stops, at) if len(at) else stops


def kept_bytes(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    edges = [0, *np.column_stack([starts, stops]).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _result(raw: bytes | None, starts: np.ndarray, stops: np.ndarray, want_text: bool) -> list:
    kept = kept_bytes(raw or b"", starts, stops)
    # a cut may leave part of a character, which no text can hold
    text = kept.decode("utf-8", "ignore") if want_text and raw is not None else None
    return [len(raw or b""), int((stops - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), text]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
CONTEXT = pa.struct([("anchor", pa.int64()), ("first", pa.int64()), ("offset", pa.int32()), ("known", pa.bool_()), ("hot", pa.bool_()), ("bytes", pa.binary())])


def _judged(joined: DataFrame, columns: Sequence[str], want_text: bool) -> DataFrame:
    """Results of documents whose runs are all known; of the others the text, what is known, and the spans to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "_rb_raw", SLICE_BYTES):
                results, texts, covered, contexts = [], [], [], []
                for raw, listed in zip(batch.column("_rb_raw"), batch.column("_rb_runs")):
                    raw, listed = raw.as_py(), listed.as_py() or []
                    place = np.array([r["place"] for r in listed], np.int64)
                    known = np.array([r["known"] for r in listed], bool)
                    first, n = place >> 16, (place & 255) + 1
                    starts, stops = merged(first[known], (first + n + WINDOW - 1)[known])
                    pending = not known.all()
                    results.append([None] * 5 if pending else _result(raw, starts, stops, want_text))
                    texts.append(raw if pending else None)
                    covered.append(np.column_stack([starts, stops]).astype("<i8").tobytes() if pending else None)
                    contexts.append(
                        [
                            (r["anchor"], int(f), int(p >> 8 & 255), r["known"], r["hot"], raw[f : f + c + WINDOW - 1])
                            for r, f, c, p in zip(listed, first, n, place)
                            if r["compare"]
                        ]
                    )
                given = [batch.column(c) for c in (*columns, "_rb_kd", "_rb_kt")]
                made = [pa.array([r[i] for r in results], t) for i, t in enumerate(RESULT_TYPES)]
                more = [pa.array(texts, pa.binary()), pa.array(covered, pa.binary()), pa.array(contexts, pa.list_(CONTEXT))]
                yield pa.RecordBatch.from_arrays([*given, *made, *more], names)

    kinds = [f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in (*columns, "_rb_kd", "_rb_kt")]
    schema = ", ".join(
        [*kinds, RESULT, "_rb_raw binary, _rb_covered binary, _rb_spans array<struct<anchor: long, first: long, offset: int, known: boolean, hot: boolean, bytes: binary>>"]
    )
    names = [*columns, "_rb_kd", "_rb_kt", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "_rb_raw", "_rb_covered", "_rb_spans"]
    return joined.mapInArrow(run, schema)


def repeated_windows(anchor: np.ndarray, offset: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of spans by byte digits: (span, start in it) of every window that occurs twice.

    Only suffixes of one anchor at one distance from it can agree, so these are the first groups.
    """
    data = np.frombuffer(b"".join(spans), np.uint8)
    lengths = np.array([len(s) for s in spans], np.int64)
    base = np.cumsum(lengths) - lengths
    n = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(spans)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = base[owner] + inside
    group = anchor[owner] * 1024 + (offset[owner] - inside + 512)
    digits = gram_hashes(data, DIGIT)
    alive = np.arange(len(owner))
    for depth in range(0, WINDOW, DIGIT):
        digit = digits[at[alive] + depth]
        order = np.lexsort((digit, group[alive]))
        g, d = group[alive][order], digit[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(order) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        together = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
        alive = alive[order[together]]
        group[alive] = number[together]
    if not len(alive):
        return owner[alive], inside[alive]
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    g = group[alive]
    lead = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    first = alive[np.repeat(lead, np.diff([*lead, len(alive)]))]
    equal = np.concatenate(
        [(windows[at[alive[k : k + 8192]]] == windows[at[first[k : k + 8192]]]).all(axis=1) for k in range(0, len(alive), 8192)]
    )
    if not equal.all():  # hashes of different digits collided: settle those groups by their bytes
        doubtful = np.isin(g, g[~equal])
        seen: dict[tuple, list[int]] = {}
        for k in alive[doubtful].tolist():
            seen.setdefault((int(group[k]), windows[at[k]].tobytes()), []).append(k)
        alive = np.concatenate([alive[~doubtful], np.array([k for ks in seen.values() if len(ks) > 1 for k in ks], np.int64)])
    return owner[alive], inside[alive]


def compared_spans(spans: DataFrame) -> DataFrame:
    """kd, kt, start, stop: bytes covered by repeated windows in spans that are not known yet. One shuffle by anchor."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        anchor = np.array([r[2] for r in rows], np.int64)
        anchor = np.unique(anchor, return_inverse=True)[1]
        owner, inside = repeated_windows(anchor, np.array([r[4] for r in rows], np.int64), [r[6] for r in rows])
        unknown = ~np.array([r[5] for r in rows], bool)[owner]
        owner, inside = owner[unknown], inside[unknown]
        order = np.lexsort((inside, owner))
        owner, inside = owner[order], inside[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] > inside[:-1] + 1)]) if len(owner) else np.zeros(0, bool)
        last = np.concatenate([new[1:], [True]]) if len(owner) else new
        who = owner[new]
        first = np.array([r[3] for r in rows], np.int64)[who]
        kd, kt = (np.array([r[i] for r in rows], t)[who] for i, t in ((0, np.int64), (1, np.int32)))
        columns = [kd, kt, first + inside[new], first + inside[last] + WINDOW]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kd", "kt", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= GROUP_BYTES and row[2] != rows[-1][2]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield settle(rows)

    given = spans.select("kd", "kt", "anchor", "first", "offset", "known", "bytes")
    return given.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "kd long, kt int, start long, stop long")


def dealt_suffixes(spans: DataFrame) -> DataFrame:
    """The same for anchors with very many spans: suffixes are dealt over the cluster by a 128-bit digest of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kd, kt, first, known, raw in zip(*(batch.column(c).to_pylist() for c in ("kd", "kt", "first", "known", "bytes"))):
                n = len(raw) - WINDOW + 1
                digests = [xxhash.xxh3_128_digest(raw[i : i + WINDOW]) for i in range(n)]
                columns = [pa.array([kd] * n), pa.array([kt] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([known] * n), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["kd", "kt", "start", "known", "digest"])

    suffixes = spans.mapInArrow(run, "kd long, kt int, start long, known boolean, digest binary")
    twice = suffixes.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    found = suffixes.where(~F.col("known")).join(twice, "digest", "left_semi")
    return found.select("kd", "kt", "start", (F.col("start") + WINDOW).alias("stop"))


def _finished(pending: DataFrame, columns: Sequence[str], want_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "_rb_raw", SLICE_BYTES):
                results = []
                for raw, covered, found in zip(*(batch.column(c) for c in ("_rb_raw", "_rb_covered", "_rb_found"))):
                    raw = raw.as_py()
                    edges = np.frombuffer(covered.as_py(), "<i8").reshape(-1, 2)
                    more = np.array([(f["start"], f["stop"]) for f in found.as_py() or []], np.int64).reshape(-1, 2)
                    edges = np.concatenate([edges, more])
                    results.append(_result(raw, *merged(edges[:, 0], edges[:, 1]), want_text))
                made = [pa.array([r[i] for r in results], t) for i, t in enumerate(RESULT_TYPES)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names)

    names = [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [f"`{c}` {pending.schema[c].dataType.simpleString()}" for c in columns]
    return pending.mapInArrow(run, ", ".join([*kinds, RESULT]))


def remove_repeats(
    documents: DataFrame, columns: Sequence[str] = ("doc_id",), want_text: bool = False, anchor_spans: int = ANCHOR_SPANS
) -> DataFrame:
    """``columns`` of every document with n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept.

    A byte is removed if a string of ``WINDOW`` bytes that covers it also starts anywhere else, in the
    same document too; all strings are judged on the input. ``kept`` is the text that remains, without
    parts of characters at cuts (null if the text was). A null text is empty. Texts shorter than a
    window stay whole. Rows repeated with their id are documents of their own, so they lose all windows.
    An empty table gives no rows. Columns that are not asked for are not read; temporary columns start
    with ``_rb_``.

    Texts are shuffled once to meet their run list, and those with edges to compare once more. Known
    repeats rest on a 64-bit anchor and a 64-bit span digest that must both agree.
    """
    raw = F.encode("text", "UTF-8")
    numeric = documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    own = F.col("doc_id").cast("long") if numeric else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    kd, kt = F.coalesce(own, F.xxhash64("text")), F.hash("text")
    runs = suffix_runs(documents.select(kd.alias("kd"), kt.alias("kt"), raw.alias("raw")))
    found = repeated_runs(runs, anchor_spans)
    listed = found.groupBy(F.col("kd").alias("_rb_kd"), F.col("kt").alias("_rb_kt")).agg(
        F.collect_list(F.struct("place", "anchor", "known", "compare", "hot")).alias("_rb_runs")
    )
    given = documents.select(*columns, kd.alias("_rb_kd"), kt.alias("_rb_kt"), raw.alias("_rb_raw"))
    with small_batches(documents.sparkSession):
        judged = written(_judged(given.join(listed, ["_rb_kd", "_rb_kt"], "left"), columns, want_text), "judged")

    spans = judged.select(F.col("_rb_kd").alias("kd"), F.col("_rb_kt").alias("kt"), F.explode("_rb_spans").alias("s")).select("kd", "kt", "s.*")
    # a row repeated with its id has its spans known, and once is enough for the others to compare with
    edges = compared_spans(spans.where(~F.col("hot"))).unionByName(dealt_suffixes(spans.where(F.col("hot"))))
    more = edges.groupBy(F.col("kd").alias("_rb_kd"), F.col("kt").alias("_rb_kt")).agg(F.collect_list(F.struct("start", "stop")).alias("_rb_found"))
    out = [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    done = judged.where(F.col("_rb_raw").isNull()).select(*out)
    pending = judged.where(F.col("_rb_raw").isNotNull()).select(*columns, "_rb_kd", "_rb_kt", "_rb_raw", "_rb_covered")
    with small_batches(documents.sparkSession):
        finished = written(_finished(pending.join(more, ["_rb_kd", "_rb_kt"], "left"), columns, want_text), "finished")
    result = done.unionByName(finished)
    return result if want_text else result.drop("kept")


def drop_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated windows taken out of ``text`` and ``n_chars``, if there, brought up to date.

    No row is dropped: a text that only held repeats is empty afterwards, a null text stays null.
    """
    others = [c for c in documents.columns if c not in ("text", "n_chars")]
    kept = remove_repeats(documents, others, want_text=True)
    size = F.length("kept").cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None
    made = {"text": F.col("kept").alias("text")} | ({} if size is None else {"n_chars": size.alias("n_chars")})
    return kept.select([made[c] if c in made else F.col(f"`{c}`") for c in documents.columns])
