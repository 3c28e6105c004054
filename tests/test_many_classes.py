"""LogME over very many or far apart classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from encoscope.operators import logme, stats
from test_transfer import dense_logme, features, onehot


def test_far_apart_labels_need_no_rows_for_the_rest(spark):
    rng = np.random.default_rng(11)
    f, y = rng.normal(size=(50, 4)), rng.choice([0, 3, 1_000_000_000], 50)
    df = features(spark, [(a, int(b)) for a, b in zip(f.tolist(), y.tolist())])
    models = logme.fit_pool(df, dense=False).orderBy("class").collect()
    assert [(r["class"], r["share"]) for r in models] == [(0, 1), (1, 1_000_000_001 - 3), (3, 1), (1_000_000_000, 1)]
    few = {3: 2, 0: 0, 1_000_000_000: 3}
    want = {r["class"]: r["evidence"] for r in logme.fit_pool(features(spark, [(a, few[int(b)]) for a, b in zip(f.tolist(), y.tolist())])).collect()}
    for r, c in zip(models, (0, 1, 2, 3)):
        assert r["evidence"] == pytest.approx(want[c], abs=1e-12)
    score = (want[0] + want[2] + want[3] + want[1] * (1_000_000_001 - 3)) / 1_000_000_001
    assert logme.score_pool(df).first()["logme"] == pytest.approx(score, abs=1e-12)


def test_many_classes_and_slices(spark):
    rng = np.random.default_rng(12)
    f, y = rng.normal(size=(4000, 3)), rng.integers(0, 1500, 4000)
    df = features(spark, list(zip(f.tolist(), y.tolist())))
    found = stats.sufficient_stats(df)
    for slices in (1, 5):
        scores = logme.score_models(logme.fit_stats(found, dense=False, slices=slices))
        assert scores.first()["logme"] == pytest.approx(dense_logme(f, onehot(y)), abs=1e-9)


def test_wide_batches_of_targets_with_pca(spark):
    rng = np.random.default_rng(13)
    f, t = rng.normal(size=(60, 5)) + 1, rng.normal(size=(60, 30))
    df = spark.createDataFrame([("a", a.tolist(), b.tolist()) for a, b in zip(f, t)], "encoder string, features array<double>, targets array<double>")
    _, _, vh = np.linalg.svd(f - f.mean(axis=0), full_matrices=False)
    want = dense_logme((f - f.mean(axis=0)) @ vh[:3].T, list(t.T))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert logme.score_pool(df, label=None, targets="targets", components=3).first()["logme"] == pytest.approx(want, abs=1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_compact_models_predict_like_dense_ones(spark):
    rng = np.random.default_rng(14)
    f, y = rng.normal(size=(80, 3)), rng.choice([1, 4, 6], 80)
    df = features(spark, list(zip(f.tolist(), y.tolist())))
    dense, compact = logme.fit_pool(df), logme.fit_pool(df, dense=False)
    assert dense.count() == 7 and compact.count() == 4
    want = sorted((r["features"], r["prediction"]) for r in logme.predict(df, dense).collect())
    for cells in (0, 5_000_000):
        assert sorted((r["features"], r["prediction"]) for r in logme.predict(df, compact, max_cells=cells).collect()) == want


def test_features_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(label):
        seen.add(1)
        return label

    rng = np.random.default_rng(15)
    df = features(spark, list(zip(rng.normal(size=(40, 3)).tolist(), rng.integers(0, 3, 40).tolist())))
    logme.score_pool(df.withColumn("label", counted("label"))).collect()
    assert seen.value == 40
