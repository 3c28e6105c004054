"""Column expressions over numeric arrays (pure JVM side)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(arr: Column) -> Column:
    """``array<numeric>`` to an ML vector of doubles."""
    return array_to_vector(arr.cast("array<double>"))


def vector_sum(arr: Column) -> Column:
    """Element-wise sum over rows; combines map-side, so a hot group costs one buffer per task."""
    return vector_to_array(Summarizer.sum(as_vector(arr)))


def vector_mean(arr: Column, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean over rows, with map-side combining."""
    if weight is None:
        return vector_to_array(Summarizer.mean(as_vector(arr)))
    return vector_to_array(Summarizer.mean(as_vector(arr), weight.cast("double")))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def argmax0(arr: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def softmax(logits: Column) -> Column:
    norm = log_sum_exp(logits)
    return F.transform(logits, lambda x: F.exp(x - norm))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-likelihood of ``label`` under softmax(logits); NULL for the ignored label -1."""
    picked = F.get(logits, label.cast("int"))
    return F.when(label != -1, log_sum_exp(logits) - picked)


def array_mean_pool(vectors: Column) -> Column:
    """Mean of an ``array<array<numeric>>`` held in one row."""
    width = F.size(F.get(vectors, F.lit(0)))
    total = F.aggregate(
        vectors,
        F.array_repeat(F.lit(0.0), width),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")),
    )
    return F.transform(total, lambda x: x / F.size(vectors))


def array_first_pool(vectors: Column) -> Column:
    """First vector of an ``array<array<numeric>>`` held in one row (the [CLS] position)."""
    return F.get(vectors, F.lit(0))


# Pooling over rows of one sequence, by name; each entry takes (vector, position, weight).
ROW_POOLINGS = {
    "mean": lambda vec, pos, weight: vector_mean(vec, weight),
    "first": lambda vec, pos, weight: F.min_by(vec, pos).cast("array<double>"),
}

# Pooling inside one row, by name.
ARRAY_POOLINGS = {"mean": array_mean_pool, "first": array_first_pool}


def pooling(name: str, registry: dict | None = None):
    """Look a pooling up by name; unknown names are an error."""
    registry = ROW_POOLINGS if registry is None else registry
    if name not in registry:
        raise ValueError(f"unknown pooling {name!r}; expected one of {sorted(registry)}")
    return registry[name]


def fold(vec: Column, parts: int) -> Column:
    """``parts`` sums (double): the k-th takes every ``parts``-th value of a vector, from the k-th on."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda k: F.aggregate(
            F.filter(vec, lambda _, i: F.pmod(i, F.lit(parts)) == k), F.lit(0.0), lambda total, x: total + x.cast("double")
        ),
    )
