"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of each text. Tasks
sum their part of the normal equations; the ridge weights are solved from the sums. Isotonic regression
over quantile bins of the training scores turns them into probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.llm.common import written

FEATURES = 256
RIDGE = 1e-3
SEED = 7
BINS = 256
THRESHOLD = 0.3

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:!?"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in STOPS)
WIDE = bytes(range(128, 256))
MARKED_END = re.compile(r"[^\w\s]{2,}(?=\s|\Z)")


def statistics(text: str) -> list[float]:
    """Numbers that describe a text without regard to its language; all are 0 for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, m = len(raw), len(words)
    if not m:
        return [float(np.log1p(n)), *[0.0] * 15]
    share = [(n - len(raw.translate(None, kind))) / n for kind in (UPPER, LOWER, DIGITS, STOPS, MARKS, WIDE)]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, m)
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        *share,
        float(lengths.mean()),
        float(lengths.std()),
        len(counts) / m,
        max(counts.values()) / m,
        pairs / max(1, m - 1),
        len(MARKED_END.findall(text)) / m,
        len(set(lines)) / len(lines),
        min(1.5, len(zlib.compress(raw, 1)) / n),
    ]


SIZE = len(statistics(""))


def statistics_table(documents: DataFrame) -> DataFrame:
    """doc_id and ``stats`` of each document; a null text counts as empty. Nothing else of a row is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "stats"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


def in_fold(doc_id) -> F.Column:
    """Whether a document is held out: the checksum of its id as text is divisible by five. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray  # statistics x features
    phase: np.ndarray
    weights: np.ndarray  # features and the constant
    knots: np.ndarray  # ridge scores, ascending
    levels: np.ndarray  # probability at each knot

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.waves + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(stats), self.knots, self.levels), 0, 1)


def isotonic(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit to ``values`` with weights ``counts``: pools adjacent violators."""
    blocks: list[list[float]] = []
    for value, count in zip(values, counts):
        blocks.append([float(value), float(count), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, c, n = blocks.pop()
            w, d, m = blocks[-1]
            blocks[-1] = [(v * c + w * d) / (c + d), c + d, n + m]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, SIZE)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fits on all rows of ``stats`` and ``label`` (0 or 1).

    The driver receives means, the normal equations (``features + 1`` squared numbers, summed over tasks
    in the cluster row by row) and ``BINS`` bin sums; none grows with the rows. Without rows every score
    is one half.
    """
    labelled = labelled.select("stats", F.col("label").cast("double").alias("label"))
    one = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(SIZE) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = labelled.agg(F.count("*").alias("n"), *one).first()
    rng = np.random.default_rng(seed)
    waves, phase = rng.normal(size=(SIZE, features)) / np.sqrt(SIZE), rng.uniform(0, 2 * np.pi, features)
    if not found["n"]:
        return Model(np.zeros(SIZE), np.ones(SIZE), waves, phase, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    mean = np.array([found[f"m{i}"] for i in range(SIZE)])
    scale = np.array([found[f"s{i}"] for i in range(SIZE)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, phase, np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.features(_stacked(batch))
            total += z.T @ np.column_stack([z, batch.column("label").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    parts = labelled.mapInArrow(normal, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "v"))
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
    both = np.zeros((features + 1, features + 2))
    for row in sums.select("i", F.col("row.v").alias("row")).collect():
        both[row["i"]] = row["row"]
    penalty = ridge * found["n"] * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])

    def ridge_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.ridge(_stacked(batch))), batch.column("label")], ["r", "label"])

    scores = labelled.mapInArrow(ridge_scores, "r double, label double")
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = sorted(set(scores.agg(F.percentile_approx("r", shares, 10_000)).first()[0]))
    bin_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("r")))
    bins = scores.groupBy(bin_of.alias("bin")).agg(F.avg("r").alias("r"), F.avg("label").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()
    rates = isotonic(np.array([b["p"] for b in bins]), np.array([b["n"] for b in bins]))
    model.knots, model.levels = np.array([b["r"] for b in bins]), rates
    return model


def fit_documents(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """The written statistics of all documents, and the model of those labelled outside the held-out fold.

    A null label counts as none; a document with several labels gives several rows to learn from.
    """
    stats = written(statistics_table(documents), "stats")
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    return stats, fit(stats.join(known, F.col("doc_id") == F.col("_id")).where(~in_fold("doc_id")))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Empty and null texts have the statistics of an empty text. Repeated rows are scored each. An empty
    table gives no rows; without any label each score is one half. Texts are read once; the statistics
    are written to the shared folder.
    """
    stats, model = fit_documents(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stacked(batch)), pa.float64())], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, all columns kept.

    The statistics are made a second time in the filter, so that no text is shuffled.
    """
    _, model = fit_documents(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py() or "") for t in batch.column("text")]).reshape(batch.num_rows, SIZE)
            yield batch.filter(pa.array(model.score(values) >= threshold))

    return documents.mapInArrow(run, documents.schema)
