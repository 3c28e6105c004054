"""Training of classifier heads with one pass over the rows per epoch and solver state that lives on.

The driver holds the weights and the memory of a limited-memory quasi-Newton solver, both as large as the
head. A pass gives every task the weights; a task multiplies Arrow batches into one gradient, loss and dev
result, and pieces of the gradients are summed over tasks on the cluster. Nothing else is shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.vectors import vector_sum

# Steps that the solver remembers, numbers of one shuffled piece of a gradient, rows multiplied at a time.
MEMORY = 8
PIECE = 8192
SLICE_BYTES = 16 << 20
# Fixed values of the step rule: sufficient decrease, and how far a step is cut at most.
DECREASE, SHORTEST = 1e-4, 0.1

SUMS = "kind string, piece int, vec array<double>"


@dataclass
class Net:
    """A feed-forward head: one weight matrix without a bias, or layers with biases and ReLU between them."""

    sizes: list[int]
    bias: bool
    theta: np.ndarray

    @staticmethod
    def fresh(name: str, width: int, classes: int, seed: int) -> Net:
        """``linear`` starts at zero; ``mlp`` has two hidden layers as wide as the features, drawn by ``seed``."""
        if name == "linear":
            return Net([width, classes], False, np.zeros(width * classes))
        if name != "mlp":
            raise ValueError(f"unknown classifier {name!r}; expected one of ['linear', 'mlp']")
        rng, sizes, parts = np.random.default_rng(seed), [width, width, width, classes], []
        for a, b in zip(sizes, sizes[1:]):
            parts += [rng.normal(scale=math.sqrt(2 / a), size=a * b), np.full(b, 0.01)]
        return Net(sizes, True, np.concatenate(parts))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            weights = self.theta[at : at + a * b].reshape(a, b)
            at += a * b
            out.append((weights, self.theta[at : at + b] if self.bias else None))
            at += b if self.bias else 0
        return out

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """The rows, what each hidden layer makes of them, and the logits."""
        out, layers = [x], self.layers()
        for k, (weights, bias) in enumerate(layers):
            z = out[-1] @ weights if bias is None else out[-1] @ weights + bias
            out.append(z if k == len(layers) - 1 else np.maximum(z, 0))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed cross-entropy of rows with class ids ``y``, and its gradient."""
        made, layers = self.outputs(x), self.layers()
        loss, slope = softmax_loss(made[-1], y)
        parts: list[np.ndarray] = []
        for k in reversed(range(len(layers))):
            weights, bias = layers[k]
            parts = [(made[k].T @ slope).ravel(), *([slope.sum(axis=0)] if bias is not None else []), *parts]
            if k:
                slope = (slope @ weights.T) * (made[k] > 0)
        return float(loss.sum()), np.concatenate(parts)


def softmax_loss(logits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each row, and its slope in the logits."""
    shifted = logits - logits.max(axis=1, keepdims=True)
    grown = np.exp(shifted)
    total = grown.sum(axis=1)
    rows = np.arange(len(y))
    slope = grown / total[:, None]
    slope[rows, y] -= 1
    return np.log(total) - shifted[rows, y], slope


@dataclass
class Solver:
    """L-BFGS that is told one evaluation at a time and names the next point to evaluate.

    A point that does not lower the loss enough is not taken; the next one lies on the same line, nearer.
    """

    point: np.ndarray
    loss: float = math.inf
    slope: np.ndarray | None = None
    step: np.ndarray | None = None
    length: float = 1.0
    moves: list[np.ndarray] = field(default_factory=list)
    changes: list[np.ndarray] = field(default_factory=list)

    def direction(self, scale: float) -> np.ndarray:
        q, shares = self.slope.copy(), []
        for s, y in zip(reversed(self.moves), reversed(self.changes)):
            share = (s @ q) / (s @ y)
            shares.append(share)
            q -= share * y
        if self.moves:
            s, y = self.moves[-1], self.changes[-1]
            scale = (s @ y) / (y @ y)
        q *= scale
        for (s, y), share in zip(zip(self.moves, self.changes), reversed(shares)):
            q += (share - (y @ q) / (s @ y)) * s
        return -q

    def tell(self, loss: float, slope: np.ndarray, scale: float) -> None:
        """What was found at ``proposal()``; ``scale`` is the length of the first step along the slope."""
        if self.step is not None:
            rate = self.length * float(self.slope @ self.step)
            if not loss <= self.loss + DECREASE * rate:
                # the parabola through both losses, kept between a tenth and a half
                bend = loss - self.loss - rate
                best = -rate / (2 * bend) if math.isfinite(bend) and bend > 0 else SHORTEST
                self.length *= min(0.5, max(SHORTEST, best))
                return
            move, change = self.length * self.step, slope - self.slope
            if move @ change > 1e-12 * (change @ change):
                self.moves, self.changes = [*self.moves, move][-MEMORY:], [*self.changes, change][-MEMORY:]
            self.point = self.point + move
        self.loss, self.slope = loss, slope
        self.step, self.length = self.direction(scale), 1.0
        if self.slope @ self.step >= 0:  # never uphill
            self.moves, self.changes = [], []
            self.step = self.direction(scale)

    def proposal(self) -> np.ndarray:
        return self.point if self.step is None else self.point + self.length * self.step


def one_pass(rows: DataFrame, net: Net) -> dict:
    """One read of ``rows`` (features, label_id, dev): summed gradient and losses at the weights of ``net``."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(net.theta)
    sizes, bias = net.sizes, net.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Net(sizes, bias, sent.value)
        slope = np.zeros(len(here.theta))
        train, dev = np.zeros(3), np.zeros(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("features").flatten()
            if flat.null_count or len(flat) != batch.num_rows * sizes[0]:
                raise ValueError("feature vectors must have one length and no nulls")
            x = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, held = batch.column("label_id").to_numpy(zero_copy_only=False), batch.column("dev").to_numpy(zero_copy_only=False)
            step = max(1, SLICE_BYTES // (8 * max(sizes)))
            for at in range(0, len(x), step):
                part, ids, is_dev = x[at : at + step].astype(np.float64), y[at : at + step], held[at : at + step]
                if not is_dev.all():
                    loss, found = here.gradient(part[~is_dev], ids[~is_dev])
                    slope += found
                    train += [(~is_dev).sum(), loss, (part[~is_dev] ** 2).sum()]
                if is_dev.any():
                    logits = here.outputs(part[is_dev])[-1]
                    loss, _ = softmax_loss(logits, ids[is_dev])
                    dev += [is_dev.sum(), loss.sum(), (logits.argmax(axis=1) == ids[is_dev]).sum()]
        pieces = [slope[k : k + PIECE] for k in range(0, len(slope), PIECE)] if train[0] else []
        kinds = ["train", "dev", *["slope"] * len(pieces)]
        numbers = [0, 0, *range(len(pieces))]
        vectors = [train, dev, *pieces]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(numbers, pa.int32()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], ["kind", "piece", "vec"]
        )

    try:
        parts = rows.select("features", "label_id", "dev").mapInArrow(run, SUMS)
        found = parts.groupBy("kind", "piece").agg(vector_sum(F.col("vec")).alias("vec")).collect()  # as large as the head
    finally:
        sent.unpersist()
    by_kind = {(r["kind"], r["piece"]): np.array(r["vec"]) for r in found}
    slopes = [by_kind[k] for k in sorted(by_kind) if k[0] == "slope"]
    train, dev = (by_kind.get((kind, 0), np.zeros(3)) for kind in ("train", "dev"))
    return {"train": train, "dev": dev, "slope": np.concatenate(slopes) if slopes else np.zeros(len(net.theta))}


def train_net(
    rows: DataFrame, net: Net, epochs: int = 50, patience: int = 3, path: str | None = None
) -> tuple[Net, list[tuple[int, float, float]]]:
    """The net with the least dev loss, and the log (epoch, dev loss, dev accuracy).

    ``rows`` hold features, label_id and dev. Epoch 0 looks at the net as it is given; every epoch after it
    is one pass at the solver's next point, which gives the gradient and the dev results at once. Equal
    losses keep the later net. Training stops ``patience`` epochs after the first lowest loss.

    With ``path`` the state is written after each epoch; a call with the same path goes on from there, and
    a finished training is returned as it was.
    """
    spark = rows.sparkSession
    state = load_state(spark, path) if path else None
    solver, log, best = state or (Solver(net.theta), [], net)
    while len(log) <= epochs:
        lowest = min(log[1:], key=lambda entry: (entry[1], entry[0]), default=None)
        if lowest is not None and log[-1][0] - lowest[0] >= patience:
            break
        here = Net(net.sizes, net.bias, solver.proposal())
        found = one_pass(rows, here)
        (n, loss, squares), (n_dev, dev_loss, hits) = found["train"], found["dev"]
        if not n or not n_dev:
            raise ValueError("training needs rows in both parts")
        # the mean squared length of the rows bounds the curvature of a linear head
        solver.tell(float(loss / n), found["slope"] / n, float(2 * n / max(squares, 1e-300)))
        log.append((len(log), float(dev_loss / n_dev), float(hits / n_dev)))
        if len(log) == 1 or log[-1][1] <= min(entry[1] for entry in log[1:]):
            best = here
        if path:
            save_state(spark, path, solver, log, best)
    return best, log[1:]


def save_state(spark: SparkSession, path: str, solver: Solver, log: list, best: Net) -> None:
    """The solver, log and best net as one row; states of earlier epochs stay beside it."""
    arrays = [solver.point, solver.slope, solver.step, best.theta, *solver.moves, *solver.changes]
    plain = json.dumps({"loss": solver.loss, "length": solver.length, "memory": len(solver.moves), "log": log, "sizes": best.sizes, "bias": best.bias})
    row = [(len(log) - 1, plain, [a.astype("<f8").tobytes() for a in arrays])]
    spark.createDataFrame(row, "epoch int, plain string, arrays array<binary>").coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[Solver, list, Net] | None:
    try:
        row = spark.read.parquet(path).orderBy(F.desc("epoch")).first()
    except AnalysisException:
        return None
    if row is None:
        return None
    plain = json.loads(row["plain"])
    point, slope, step, theta, *memory = (np.frombuffer(a, "<f8").copy() for a in row["arrays"])
    n = plain["memory"]
    solver = Solver(point, plain["loss"], slope, step, plain["length"], memory[:n], memory[n:])
    return solver, [tuple(entry) for entry in plain["log"]], Net(plain["sizes"], plain["bias"], theta)


def with_logits(df: DataFrame, net: Net, features: str = "features", out: str = "logits") -> DataFrame:
    """Adds the logits of each row; a row without features gets none."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("array<double>")
    def apply(values: pd.Series) -> pd.Series:
        made = pd.Series([None] * len(values), dtype=object)
        given = np.flatnonzero(values.notna().to_numpy())
        if len(given):
            logits = sent.value.outputs(np.stack(values.to_numpy()[given]).astype(np.float64))[-1]
            for place, row in zip(given, logits):
                made.iat[place] = row
        return made

    return df.withColumn(out, apply(F.col(features)))


def save_net(spark: SparkSession, net: Net, path: str) -> None:
    row = [(net.sizes, net.bias, net.theta.astype("<f8").tobytes())]
    spark.createDataFrame(row, "sizes array<int>, bias boolean, theta binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/net")


def load_net(spark: SparkSession, path: str) -> Net | None:
    """The net saved under a path, if there is one."""
    try:
        row = spark.read.parquet(f"{path}/net").first()
    except AnalysisException:
        return None
    return Net(list(row["sizes"]), row["bias"], np.frombuffer(row["theta"], "<f8").copy())
