"""LogME: log of maximum evidence, for a whole pool of encoders in one job.

``score_pool`` reads the features once (see ``stats``); per encoder only a D x D matrix and C class
vectors remain. The small per-encoder solve runs inside a grouped task, one group per encoder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encoscope.functions.lookups import fetch_bounded, lookup_join, split_join
from encoscope.functions.vectors import argmax0, dot
from encoscope.operators.stats import sufficient_stats

# Iteration cap, ridge and tolerances of the two published variants.
MAX_STEPS = 11
RIDGE = 1e-5
FIXED_POINT_TOLERANCE = 1e-3
EM_TOLERANCE = 1e-2

# Eigenvalues below this share of the largest one count as zero.
RANK_TOLERANCE = 1e-12
# Singular values at or below this are dropped when there are more rows than dimensions.
SINGULAR_CUT = 1e-10


def assemble_stats(frame: pd.DataFrame):
    """Statistics rows of one encoder to ``(n_rows, gram, weights, sums, total, shares)``.

    Per class or target, ``weights`` is its sum of squares and ``shares`` its plain sum; for classes
    both are the count.
    """
    total = frame[frame["kind"] == "total"].iloc[0]
    n_rows, total_vec = float(total["n"]), np.asarray(total["vec"], dtype=float)
    width = len(total_vec)
    gram = np.zeros((width, width))
    for i, vec in frame.loc[frame["kind"] == "gram", ["i", "vec"]].itertuples(index=False):
        gram[i, i:] = vec
        gram[i:, i] = vec
    classes = frame[frame["kind"] == "class"]
    count = int(classes["i"].max()) + 1 if len(classes) else 0
    weights, sums = np.zeros(count), np.zeros((count, width))
    for c, n, vec in classes[["i", "n", "vec"]].itertuples(index=False):
        weights[c], sums[c] = n, vec
    shares = weights.copy()
    for c, n in frame.loc[frame["kind"] == "target", ["i", "n"]].itertuples(index=False):
        shares[c] = n
    return n_rows, gram, weights, sums, total_vec, shares


def _spectrum(gram: np.ndarray):
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0.0, None), vectors[:, order]
    return np.where(values <= RANK_TOLERANCE * values[0], 0.0, values), vectors


@dataclass(frozen=True)
class Variant:
    """What sets the two published procedures apart."""

    tolerance: float
    # the ridge of the updates also enters the evidence
    ridge_in_evidence: bool
    # directions without weight are left out of the spectrum
    cut_spectrum: bool


VARIANTS = {
    "fixed_point": Variant(FIXED_POINT_TOLERANCE, ridge_in_evidence=False, cut_spectrum=True),
    "em": Variant(EM_TOLERANCE, ridge_in_evidence=True, cut_spectrum=False),
}


def _kept(sigma: np.ndarray, n_rows: float) -> int:
    """Directions that take part: no more than rows, else those with a singular value above the cut."""
    if n_rows <= len(sigma):
        return int(n_rows)
    return max(1, int((np.sqrt(sigma) > SINGULAR_CUT).sum()))


def spectrum(n_rows: float, gram: np.ndarray, variant: Variant) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and directions of a Gram matrix that take part."""
    sigma, vectors = _spectrum(gram)
    if variant.cut_spectrum:
        kept = _kept(sigma, n_rows)
        sigma, vectors = sigma[:kept], vectors[:, :kept]
    return sigma, vectors


def walk(n_rows: float, width: int, sigma: np.ndarray, weights: np.ndarray, p: np.ndarray, variant: Variant):
    """Alpha, beta, evidence, steps and rotated posterior mean of every class.

    In the eigenbasis of the Gram matrix a class is its vector ``p`` of projected sums. For a ratio
    t = alpha / beta the posterior mean is p / (sigma + t); alpha follows from its squared length,
    beta from the squared error it leaves, and both give the next ratio. All classes move together,
    each until its own ratio settles.
    """
    count = len(weights)
    p = np.where(sigma > 0, p, 0.0)
    explained = np.divide(p * p, sigma, out=np.zeros_like(p), where=sigma > 0)
    # rounding may push a perfect fit below zero
    unexplained = np.maximum(weights - explained.sum(axis=1), 0.0)

    alpha, beta = np.ones(count), np.ones(count)
    length, error = np.zeros(count), np.zeros(count)
    steps, rotated = np.zeros(count, dtype=np.int32), np.zeros_like(p)
    moving = np.arange(count)
    while len(moving) and steps.max(initial=0) < MAX_STEPS:
        ratio = (alpha[moving] / beta[moving])[:, None]
        mean = p[moving] / (sigma + ratio)
        freedom = (sigma / (sigma + ratio)).sum(axis=1)
        missed = unexplained[moving] + (explained[moving] * (ratio / (sigma + ratio)) ** 2).sum(axis=1)
        rotated[moving], length[moving], error[moving] = mean, np.einsum("ij,ij->i", mean, mean), missed
        alpha[moving] = freedom / (length[moving] + RIDGE)
        beta[moving] = (n_rows - freedom) / (missed + RIDGE)
        steps[moving] += 1
        change = np.abs(alpha[moving] / beta[moving] / ratio[:, 0] - 1)
        moving = moving[change > variant.tolerance]

    slack = RIDGE if variant.ridge_in_evidence else 0.0
    spread = np.log(alpha[:, None] + beta[:, None] * sigma).sum(axis=1)
    misfit = beta * (error + slack) + alpha * (length + slack)
    evidence = (width * np.log(alpha) + n_rows * (np.log(beta) - math.log(2 * math.pi)) - spread - misfit) / (2 * n_rows)
    return alpha, beta, evidence, steps, rotated


def solve(n_rows: float, gram: np.ndarray, weights: np.ndarray, sums: np.ndarray, variant: Variant):
    """Alpha, beta, evidence, steps and posterior mean of every class, all in one place."""
    sigma, vectors = spectrum(n_rows, gram, variant)
    *found, rotated = walk(n_rows, len(gram), sigma, weights, sums @ vectors, variant)
    return *found, rotated @ vectors.T


def pca_basis(n_rows, gram, total, components: int):
    """Scatter matrix around the mean and its leading directions."""
    if n_rows < components:
        raise ValueError(f"not enough rows for {components} components ({int(n_rows)})")
    mean = total / n_rows
    scatter = gram - n_rows * np.outer(mean, mean)
    _, vectors = np.linalg.eigh(scatter)
    return mean, scatter, vectors[:, ::-1][:, :components]


def project_stats(n_rows, gram, sums, total, shares, components: int):
    """Statistics of the features after centred PCA, without touching the features again."""
    mean, scatter, basis = pca_basis(n_rows, gram, total, components)
    return basis.T @ scatter @ basis, (sums - shares[:, None] * mean) @ basis


def pca_bases(stats: DataFrame, components: int, keys: Sequence[str] = ("encoder",)) -> DataFrame:
    """Mean and leading directions per encoder: ``(keys, mean, basis)``, one row each."""
    keys = list(keys)
    schema = T.StructType(
        [stats.schema[k] for k in keys]
        + [
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("basis", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )

    def solve_group(frame: pd.DataFrame) -> pd.DataFrame:
        n_rows, gram, _, _, total, _ = assemble_stats(frame)
        mean, _, basis = pca_basis(n_rows, gram, total, components)
        out = pd.DataFrame({k: [frame[k].iloc[0]] for k in keys})
        out["mean"], out["basis"] = [mean.tolist()], [basis.T.tolist()]
        return out

    return stats.groupBy(*keys).applyInPandas(solve_group, schema)


def project(df: DataFrame, bases: DataFrame, features: str = "features", keys: Sequence[str] = ("encoder",)) -> DataFrame:
    """Centred features along the leading directions of their encoder (one lookup row per encoder)."""
    joined = lookup_join(df, bases, list(keys), "left", max_rows=1_000)
    centred = F.zip_with(features, "mean", lambda x, u: x.cast("double") - u)
    placed = joined.withColumn("_centred", centred)
    return placed.withColumn(features, F.transform("basis", lambda b: dot(F.col("_centred"), b))).drop("_centred", "mean", "basis")


MODEL = [("class", T.IntegerType()), ("alpha", T.DoubleType()), ("beta", T.DoubleType()), ("evidence", T.DoubleType()), ("steps", T.IntegerType()), ("m", T.ArrayType(T.DoubleType()))]


def _floats(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, "<f8").tobytes()


@dataclass(frozen=True)
class Rotation:
    """What the classes of one encoder need of its Gram matrix: one eigensolve, packed as one value."""

    n_rows: float
    width: int
    sigma: np.ndarray
    mean: np.ndarray
    into: np.ndarray  # features to the eigenbasis
    back: np.ndarray  # eigenbasis to the space of the posterior mean

    def packed(self) -> bytes:
        head = np.array([self.n_rows, self.width, len(self.mean), len(self.sigma)])
        return b"".join(map(_floats, (head, self.sigma, self.mean, self.into, self.back)))

    @staticmethod
    def unpacked(raw: bytes) -> Rotation:
        flat = np.frombuffer(raw, "<f8")
        (n_rows, width, dims, kept), flat = flat[:4], flat[4:]
        width, dims, kept = int(width), int(dims), int(kept)
        sigma, mean, into, back = np.split(flat, np.cumsum([kept, dims, dims * kept]))
        return Rotation(float(n_rows), width, sigma, mean, into.reshape(dims, kept), back.reshape(kept, width))

    def classes(self, weights: np.ndarray, shares: np.ndarray, sums: np.ndarray, variant: Variant):
        *found, rotated = walk(self.n_rows, self.width, self.sigma, weights, (sums - shares[:, None] * self.mean) @ self.into, variant)
        return *found, rotated @ self.back


def rotation(n_rows: float, gram: np.ndarray, total: np.ndarray, variant: Variant, components: int = 0) -> Rotation:
    if not components:
        sigma, vectors = spectrum(n_rows, gram, variant)
        return Rotation(n_rows, len(gram), sigma, np.zeros(len(gram)), vectors, vectors.T)
    mean, scatter, basis = pca_basis(n_rows, gram, total, components)
    sigma, vectors = spectrum(n_rows, basis.T @ scatter @ basis, variant)
    return Rotation(n_rows, components, sigma, mean, basis @ vectors, vectors.T)


# Tasks over which the classes of one encoder are spread.
SLICES = 8


def fit_stats(
    stats: DataFrame,
    keys: Sequence[str] = ("encoder",),
    variant: str = "fixed_point",
    components: int = 0,
    dense: bool = True,
    slices: int = SLICES,
) -> DataFrame:
    """Per-class LogME model ``(keys, class, share, alpha, beta, evidence, steps, m)`` from statistics.

    Classes run from 0 to the largest label; those without rows count too and are all alike. ``dense``
    gives each of them a row; otherwise one row, under the least of their numbers, stands for all, and
    ``share`` says for how many classes a row stands. With ``components`` the features are first reduced by
    PCA.

    One task an encoder solves its D x D matrix. Classes are dealt into ``slices`` and streamed past that
    solution, so neither their number nor their labels bound a task.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; expected one of {sorted(VARIANTS)}")
    chosen, keys = VARIANTS[variant], list(keys)
    key_fields = [stats.schema[k] for k in keys]
    fields = [T.StructField(name, kind) for name, kind in MODEL]

    def turn(frame: pd.DataFrame) -> pd.DataFrame:
        n_rows, gram, _, _, total, _ = assemble_stats(frame)
        found = rotation(n_rows, gram, total, chosen, components)
        alpha, beta, evidence, steps, m = found.classes(np.zeros(1), np.zeros(1), np.zeros((1, len(total))), chosen)
        out = pd.DataFrame({k: [frame[k].iloc[0]] for k in keys})
        out["rotation"] = [found.packed()]
        out["alpha"], out["beta"], out["evidence"], out["steps"], out["m"] = alpha, beta, evidence, steps, list(m)
        return out

    def solve_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, share = None, None
        for batch in batches:
            plain = batch.select(["_first", "i", "n", "_target"]).to_pandas()
            starts = np.flatnonzero(plain["_first"].to_numpy())
            for a, b in zip(np.append(0, starts), np.append(starts, len(plain))):
                if a == b:
                    continue
                if plain["_first"].iat[a]:
                    turned, a = Rotation.unpacked(batch.column("rotation")[int(a)].as_py()), a + 1
                part = plain.iloc[a:b]
                shares = part["n"].to_numpy(float).copy()
                # the plain sum of a target comes right before its class row
                target = part["_target"].to_numpy(bool)
                shares[1:] = np.where(target[:-1], shares[:-1], shares[1:])
                if len(part) and share is not None and not target[0]:
                    shares[0] = share
                share = float(part["n"].iat[-1]) if len(part) and target[-1] else None
                rows = a + np.flatnonzero(~target)
                if not len(rows):
                    continue
                sums = np.stack(batch.column("vec").take(pa.array(rows)).to_numpy(zero_copy_only=False))
                alpha, beta, evidence, steps, m = turned.classes(part["n"].to_numpy(float)[~target], shares[~target], sums, chosen)
                numbers = pa.array(part["i"].to_numpy()[~target]).cast(pa.int32())
                columns = [batch.column(k).take(pa.array(rows)) for k in keys] + [numbers, *map(pa.array, (alpha, beta, evidence, steps))]
                offsets = np.arange(0, m.size + 1, max(1, m.shape[1]))[: len(m) + 1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], [*keys, *(name for name, _ in MODEL)])

    # a filter that also reads both sums stays above them, so all parts come from one read of the features
    # (a join on equal keys would add a filter that does not)
    def same(names: Sequence[str]) -> Column:
        return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names], F.lit(True))

    def of_kind(*kinds: str) -> Column:
        return F.when(F.col("n").isNull() | (F.size("vec") < 0), F.lit(False)).otherwise(F.col("kind").isin(*kinds))

    plane = T.StructType([*key_fields, T.StructField("rotation", T.BinaryType()), *fields[1:]])
    turned = stats.where(of_kind("gram", "total")).groupBy(*keys).applyInPandas(turn, plane)
    classes = stats.where(of_kind("class", "target"))
    deal = F.pmod(F.xxhash64("i"), F.lit(slices)).cast("int")
    nothing = {c: F.lit(None).cast(stats.schema[c].dataType) for c in ("i", "n", "vec")}
    heads = turned.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), *[v.alias(c) for c, v in nothing.items()], F.lit(False).alias("_target"), "rotation")
    given = classes.select(*keys, deal.alias("slice"), "i", "n", "vec", (F.col("kind") == "target").alias("_target"), F.lit(None).cast("binary").alias("rotation"))
    placed = heads.unionByName(given).withColumn("_first", F.col("rotation").isNotNull()).repartition(*keys, "slice")
    order = [*keys, "slice", F.desc("_first"), "i", F.desc("_target")]
    present = placed.sortWithinPartitions(*order).mapInArrow(solve_classes, T.StructType([*key_fields, *fields]))

    ids = stats.where(of_kind("class")).select(*keys, "i")
    if dense:
        every = ids.groupBy(*keys).agg(F.max("i").alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("i"))
        taken = ids.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"))
        absent = every.join(taken, same(keys) & (F.col("i") == F.col("_i")), "left_anti").withColumn("share", F.lit(1).cast("long"))
    else:
        # the least number not taken: the first place where the numbers in order run ahead of their count
        in_order = Window.partitionBy(*keys).orderBy("i")
        gaps = ids.withColumn("_at", F.row_number().over(in_order) - 1).groupBy(*keys).agg(
            F.min(F.when(F.col("i") > F.col("_at"), F.col("_at"))).alias("i"), (F.max("i") + 1 - F.count("*")).alias("share")
        )
        absent = gaps.where("share > 0").select(*keys, F.col("i").cast("long").alias("i"), "share")
    evidence = turned.drop("rotation").withColumnsRenamed({k: f"_{k}" for k in keys})
    alike = absent.join(evidence, same(keys))
    columns = [*keys, "class", "share", *(name for name, _ in MODEL[1:])]
    filled = alike.withColumn("class", F.col("i").cast("int")).select(*columns)
    return present.withColumn("share", F.lit(1).cast("long")).select(*columns).unionByName(filled)


def fit_pool(
    df: DataFrame,
    features: str = "features",
    label: str | None = "label",
    targets: str | None = None,
    keys: Sequence[str] = ("encoder",),
    variant: str = "fixed_point",
    components: int = 0,
    dense: bool = True,
) -> DataFrame:
    """LogME model of every encoder (or encoder x pooling x task) named by ``keys``."""
    stats = sufficient_stats(df, features, label, targets, keys)
    return fit_stats(stats, keys, variant, components, dense)


def score_models(models: DataFrame, keys: Sequence[str] = ("encoder",)) -> DataFrame:
    """LogME score: mean evidence over classes."""
    return models.groupBy(*keys).agg((F.sum(F.col("evidence") * F.col("share")) / F.sum("share")).alias("logme"))


def score_pool(df: DataFrame, keys: Sequence[str] = ("encoder",), **options) -> DataFrame:
    return score_models(fit_pool(df, keys=keys, dense=False, **options), keys)


def leaderboard(scores: DataFrame, score: str, name: str, within: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Rank scored names inside each task; ``top`` keeps the best ones."""
    order = Window.partitionBy(*within).orderBy(F.desc(score), F.asc(name))
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def predict(
    df: DataFrame,
    models: DataFrame,
    features: str = "features",
    keys: Sequence[str] = ("encoder",),
    regression: bool = False,
    max_cells: int = 5_000_000,
) -> DataFrame:
    """Add ``prediction``: the class with the largest posterior-mean logit, or all logits.

    A row without features, or of an encoder without a model, gets NULL. The fitted models (E x C x D
    numbers, fetched in one pass that stops at ``max_cells``) travel to the tasks; products run as one
    matrix multiplication per Arrow batch and encoder. Larger models meet the rows in a join.
    """
    keys = list(keys)
    fetched = fetch_bounded(models.select(*keys, "class", "m"), max_cells, 8 * max_cells)
    if fetched is None:
        return _predict_by_join(df, models, features, keys, regression)
    held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for key, part in fetched.to_pandas().groupby(keys, sort=False):
        part = part.sort_values("class")
        held[key if isinstance(key, tuple) else (key,)] = part["class"].to_numpy(), np.stack(part["m"].to_list())
    kind = "array<double>" if regression else "int"

    @F.pandas_udf(kind)
    def apply_model(values: pd.Series, key: pd.DataFrame) -> pd.Series:
        out = np.full(len(values), None, dtype=object)
        given = values.notna().to_numpy()
        for name, rows in key.groupby(list(key.columns), sort=False).indices.items():
            classes, matrix = held.get(name if isinstance(name, tuple) else (name,), (None, None))
            rows = rows[given[rows]]
            if matrix is None or not len(rows):
                continue
            logits = np.stack(values.to_numpy()[rows]).astype(float) @ matrix.T
            if regression:
                out[rows] = pd.Series(list(logits), dtype=object).to_numpy()
            else:
                out[rows] = classes[logits.argmax(axis=1)]
        return pd.Series(out) if regression else pd.Series(out).astype("Int32")

    return df.withColumn("prediction", apply_model(F.col(features), F.struct(*keys)))


def _predict_by_join(df, models, features, keys, regression):
    """Models too large to hold at once meet the feature rows in a join on the encoder."""
    grouped = models.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("class", "m"))).alias("_ms")
    )
    logits = F.transform("_ms", lambda s: dot(F.col(features), s["m"]))
    joined = split_join(df, grouped, keys, "left").withColumn("_logits", logits)
    picked = F.col("_logits") if regression else F.get("_ms", argmax0(F.col("_logits")))["class"]
    return joined.withColumn("prediction", picked).drop("_ms", "_logits")


def univariate_evidence(
    sigma: Column, weight: Column, product: Column, n_rows: Column, variant: str = "fixed_point"
) -> Column:
    """LogME evidence of one single feature, as a column.

    ``sigma`` is the feature's sum of squares, ``weight`` the target's sum of squares and
    ``product`` the sum of feature times target. The same walk as ``solve``, in one dimension.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; expected one of {sorted(VARIANTS)}")
    chosen = VARIANTS[variant]
    explained = F.when(sigma > 0, product * product / sigma).otherwise(0.0)

    def state(alpha: Column, beta: Column, length: Column, error: Column, settled: Column) -> Column:
        parts = {"alpha": alpha, "beta": beta, "length": length, "error": error, "settled": settled}
        return F.struct(*[value.alias(name) for name, value in parts.items()])

    def step(s: Column, _: Column) -> Column:
        ratio = s["alpha"] / s["beta"]
        mean = product / (sigma + ratio)
        freedom = sigma / (sigma + ratio)
        error = weight - explained + explained * F.pow(ratio / (sigma + ratio), 2)
        alpha, beta = freedom / (mean * mean + RIDGE), (n_rows - freedom) / (error + RIDGE)
        settled = F.abs(alpha / beta / ratio - 1) <= chosen.tolerance
        return F.when(s["settled"], s).otherwise(state(alpha, beta, mean * mean, error, settled))

    def evidence(s: Column) -> Column:
        slack = RIDGE if chosen.ridge_in_evidence else 0.0
        misfit = s["beta"] * (s["error"] + slack) + s["alpha"] * (s["length"] + slack)
        gain = F.log(s["alpha"]) + n_rows * (F.log(s["beta"]) - math.log(2 * math.pi))
        return (gain - F.log(s["alpha"] + s["beta"] * sigma) - misfit) / (2 * n_rows)

    start = state(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step, evidence)
