"""Classifier heads on frozen features: training, scoring, persistence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.vectors import as_vector
from encoscope.operators.evaluate import head_metrics
from encoscope.operators.labels import label_ids, label_index, label_names, label_union
from encoscope.operators.training import Net, load_net, save_net, train_net, with_logits


def linear_head(width: int, classes: int, seed: int, epochs: int):
    """Softmax regression without a bias."""
    return LogisticRegression(
        family="multinomial", fitIntercept=False, standardization=False, maxIter=epochs, labelCol="label_id", featuresCol="vector"
    )


def mlp_head(width: int, classes: int, seed: int, epochs: int):
    """Two hidden layers as wide as the features."""
    return MultilayerPerceptronClassifier(
        layers=[width, width, width, classes], maxIter=epochs, seed=seed, labelCol="label_id", featuresCol="vector"
    )


HEADS: dict[str, tuple[Callable, type]] = {
    "linear": (linear_head, LogisticRegressionModel),
    "mlp": (mlp_head, MultilayerPerceptronClassificationModel),
}


def head(name: str) -> tuple[Callable, type]:
    if name not in HEADS:
        raise ValueError(f"unknown classifier {name!r}; expected one of {sorted(HEADS)}")
    return HEADS[name]


def class_index(train: DataFrame, valid: DataFrame, label: str = "label") -> DataFrame:
    """Index over the sorted union of the labels of both parts."""
    return label_index(label_union(train, valid, label), label)


def train_head(
    train: DataFrame,
    index: DataFrame,
    name: str = "linear",
    features: str = "features",
    label: str = "label",
    seed: int = 4012,
    epochs: int = 50,
) -> Model:
    """Fit a head on ``(features, label)`` rows; each solver step is one distributed pass."""
    width = len(train.select(features).first()[0])
    classes = index.count()
    rows = label_ids(train, index, label).select(as_vector(F.col(features)).alias("vector"), "label_id").persist()
    try:
        return head(name)[0](width, classes, seed, epochs).fit(rows)
    finally:
        rows.unpersist()


def train_epochs(
    train: DataFrame,
    dev: DataFrame,
    index: DataFrame,
    name: str = "mlp",
    features: str = "features",
    label: str = "label",
    seed: int = 4012,
    epochs: int = 50,
    patience: int = 3,
    path: str | None = None,
) -> tuple[Net, DataFrame]:
    """Train epoch by epoch, look at the dev loss after each, keep the best model, stop early.

    Returns the kept model and the log ``(epoch, loss, accuracy)``. An epoch is one pass over both parts,
    after one that looks at the fresh model; weights and solver state go from epoch to epoch. With ``path``
    they are written, and a call that was cut short goes on from there.
    """
    head(name)
    width, classes = len(train.select(features).first()[0]), index.count()
    parts = [df.select(F.col(features).alias("features"), label, F.lit(held).alias("dev")) for df, held in ((train, False), (dev, True))]
    rows = label_ids(parts[0].unionByName(parts[1]), index, label).select("features", "label_id", "dev").persist()
    try:
        best, log = train_net(rows, Net.fresh(name, width, classes, seed), epochs, patience, path)
    finally:
        rows.unpersist()
    return best, train.sparkSession.createDataFrame(log, "epoch int, loss double, accuracy double")


def score_rows(df: DataFrame, model: Model | Net, index: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Logits, predicted id and label name, correctness and loss for each row."""
    known = label_ids(df, index, label)
    if isinstance(model, Net):
        kept = with_logits(known, model, features)
    else:
        logits = model.transform(known.withColumn("vector", as_vector(F.col(features)))).withColumn("logits", vector_to_array("rawPrediction"))
        kept = logits.drop("rawPrediction", "probability", "prediction", "vector")
    scored = head_metrics(kept, "logits", "label_id")
    return label_names(scored, index, "pred", label, out="prediction")


def save_head(model: Model | Net, path: str) -> None:
    """Persist the head only; the encoder stays frozen and is not part of it."""
    if isinstance(model, Net):
        save_net(SparkSession.active(), model, path)
    else:
        model.write().overwrite().save(path)


def load_head(name: str, path: str) -> Model | Net:
    kind = head(name)[1]
    return load_net(SparkSession.active(), path) or kind.load(path)
