"""Transferability scores against independent computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from encoscope.operators import embed, features as encoding, leep, logme, stats

SF = "/root/testdata"
SMALL = [([1, 0], 0), ([0, 1], 1), ([1, 1], 0), ([2, 1], 0), ([0, 2], 1), ([1, 3], 1)]


def features(spark, rows, encoder="a"):
    data = [(encoder, [float(v) for v in f], y) for f, y in rows]
    return spark.createDataFrame(data, "encoder string, features array<double>, label int")


def dense_logme(f, targets):
    """Maximum evidence of Bayesian linear regression with explicit D x D matrices."""
    n, d = f.shape
    eye, gram = np.eye(d), f.T @ f
    scores = []
    for y in targets:
        a = b = 1.0
        for _ in range(11):
            before = a / b
            precision = a * eye + b * gram
            m = b * np.linalg.solve(precision, f.T @ y)
            freedom = d - a * np.trace(np.linalg.inv(precision))
            a, b = freedom / (m @ m + 1e-5), (n - freedom) / (((y - f @ m) ** 2).sum() + 1e-5)
            if abs(a / b - before) / before <= 1e-3:
                break
        # with fewer rows than dimensions, only as many directions as rows enter the determinant
        logdet = np.linalg.slogdet(a * eye + b * gram)[1] - max(0, d - n) * math.log(a)
        loss = b * ((y - f @ m) ** 2).sum() + a * m @ m
        scores.append((d * math.log(a) + n * math.log(b / (2 * math.pi)) - logdet - loss) / (2 * n))
    return float(np.mean(scores))


def onehot(y, count=None):
    y = np.asarray(y)
    return [(y == c).astype(float) for c in range(count or y.max() + 1)]


def test_fixed_point_golden(spark):
    models = {r["class"]: r for r in logme.fit_pool(features(spark, SMALL)).collect()}
    assert np.mean([m["evidence"] for m in models.values()]) == pytest.approx(-0.78258628, abs=1e-8)
    assert models[0]["alpha"] == pytest.approx(5.03195091, abs=1e-7)
    assert models[0]["beta"] == pytest.approx(7.39560629, abs=1e-7)
    assert models[0]["steps"] == 6 and models[1]["steps"] == 5
    assert models[0]["m"] == pytest.approx([0.59403754, -0.09377435], abs=1e-7)
    assert models[1]["m"] == pytest.approx([-0.19852277, 0.42661196], abs=1e-7)


@pytest.mark.parametrize("sf, golden", [("sf0.001", -0.264075827), ("sf0.01", -0.264770520), ("sf0.1", -0.266846527)])
def test_embedding_golden(spark, sf, golden):
    rows = spark.read.parquet(f"{SF}/{sf}/embeddings.parquet").select(
        F.lit("all").alias("encoder"), F.col("embedding").alias("features"), "label"
    )
    assert logme.score_pool(rows).first()["logme"] == pytest.approx(golden, abs=1e-8)


def test_order_partitions_and_rotation_do_not_matter(spark):
    rng = np.random.default_rng(3)
    f, y = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    expected = dense_logme(f, onehot(y))
    turned = list(zip((f @ q).tolist(), y.tolist()))
    plain = list(zip(f.tolist(), y.tolist()))
    for rows, parts in ((plain, 1), (plain[::-1], 7), (turned, 3)):
        df = features(spark, [(a, int(b)) for a, b in rows]).repartition(parts)
        assert logme.score_pool(df).first()["logme"] == pytest.approx(expected, abs=1e-10)


def test_fewer_rows_than_dimensions_and_missing_classes(spark):
    rng = np.random.default_rng(5)
    f, y = rng.normal(size=(6, 9)), np.array([0, 3, 0, 3, 3, 0])
    df = features(spark, list(zip(f.tolist(), y.tolist())))
    assert logme.score_pool(df).first()["logme"] == pytest.approx(dense_logme(f, onehot(y, 4)), abs=1e-9)
    assert logme.fit_pool(df).count() == 4


def test_negative_labels_count_as_rows_only(spark):
    rng = np.random.default_rng(6)
    f, y = rng.normal(size=(30, 3)), rng.integers(-1, 2, 30)
    df = features(spark, list(zip(f.tolist(), y.tolist())))
    assert logme.score_pool(df).first()["logme"] == pytest.approx(dense_logme(f, onehot(y, 2)), abs=1e-9)


def test_regression_and_pca(spark):
    rng = np.random.default_rng(7)
    f, t = rng.normal(size=(40, 4)) + 2, rng.normal(size=(40, 2))
    rows = [("a", a.tolist(), b.tolist()) for a, b in zip(f, t)]
    df = spark.createDataFrame(rows, "encoder string, features array<double>, targets array<double>")
    score = logme.score_pool(df, label=None, targets="targets").first()["logme"]
    assert score == pytest.approx(dense_logme(f, list(t.T)), abs=1e-9)
    centred = f - f.mean(axis=0)
    _, _, vh = np.linalg.svd(centred, full_matrices=False)
    reduced = logme.score_pool(df, label=None, targets="targets", components=2).first()["logme"]
    assert reduced == pytest.approx(dense_logme(centred @ vh[:2].T, list(t.T)), abs=1e-9)


def test_pca_needs_rows(spark):
    with pytest.raises(Exception, match="not enough rows"):
        logme.score_pool(features(spark, SMALL[:1]), components=2).collect()


def test_accumulators_handed_on_early_give_the_same(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/sf0.001/embeddings.parquet").select(
        F.concat(F.lit("e"), F.pmod("vec_id", F.lit(3)).cast("string")).alias("encoder"), F.col("embedding").alias("features"), "label"
    )
    whole = {r["encoder"]: r["logme"] for r in logme.score_pool(rows).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    monkeypatch.setattr(stats, "ACCUMULATOR_BYTES", 1000)
    monkeypatch.setattr(stats, "SLICE_BYTES", 4000)
    try:
        pieces = {r["encoder"]: r["logme"] for r in logme.score_pool(rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert pieces == pytest.approx(whole, abs=1e-10)


def test_predict_paths_agree(spark):
    df = features(spark, SMALL)
    models = logme.fit_pool(df)
    fast = logme.predict(df, models).select("features", "prediction")
    joined = logme.predict(df, models, max_cells=0).select("features", "prediction")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, joined.collect()))
    logits = logme.predict(df, models, regression=True).first()["prediction"]
    assert len(logits) == 2


def test_uneven_features_fail(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0), ("a", [1.0], 1)], "encoder string, features array<double>, label int")
    with pytest.raises(Exception, match="one length"):
        logme.score_pool(df.coalesce(1)).collect()


THETA = [([0.7, 0.2, 0.1], "0"), ([0.6, 0.3, 0.1], "0"), ([0.1, 0.8, 0.1], "1"), ([0.2, 0.5, 0.3], "1")]


def test_leep_golden(spark):
    df = spark.createDataFrame(THETA, "theta array<double>, gold string")
    assert leep.leep(df).first()["leep"] == pytest.approx(-0.461708664, abs=1e-8)
    targets = leep.label_positions(spark, ["0", "1"], "y")
    assert leep.leep(df, form="by_target", targets=targets).first()["leep"] == pytest.approx(-0.610199858, abs=1e-8)
    with pytest.raises(ValueError, match="unknown form"):
        leep.leep(df, form="other")


def test_words_from_pieces(spark):
    rows = [
        (1, 0, True, 0, 0, [9.0, 9.0]),
        (1, 1, False, 0, 3, [1.0, 0.0]),
        (1, 2, False, 3, 5, [3.0, 2.0]),
        (1, 3, False, 0, 2, [5.0, 5.0]),
    ]
    pieces = spark.createDataFrame(rows, "sent int, piece int, is_special boolean, off_start int, off_end int, vec array<float>")
    got = {r["pos"]: (r["n_pieces"], r["vec"]) for r in embed.words_from_pieces(pieces, ["sent"], cls=True).collect()}
    assert got == {-1: (1, [9.0, 9.0]), 0: (2, [2.0, 1.0]), 1: (1, [5.0, 5.0])}
    sequences = spark.createDataFrame([(1, ["abcde", "fg", "cut"])], "sent int, tokens array<string>")
    lost = embed.words_without_pieces(embed.words_from_pieces(pieces, ["sent"]), sequences, ["sent"])
    assert [tuple(r) for r in lost.collect()] == [(1, 2, "cut")]


def test_static_vectors_by_both_joins(spark, monkeypatch):
    vocabulary = spark.createDataFrame([("UNK", [0.0, 0.0]), ("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    df = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["b"])], "id int, tokens array<string>")
    expected = {1: [4 / 3, 2.0], 2: [3.0, 4.0]}
    for rows in (50_000, 1):
        monkeypatch.setattr(embed, "VOCABULARY_ROWS", rows)
        pooled = embed.pooled_static(df, ["id"], vocabulary).collect()
        assert {r["id"]: r["features"] for r in pooled} == {k: pytest.approx(v) for k, v in expected.items()}
    first = {r["id"]: r["features"] for r in embed.pooled_static(df, ["id"], vocabulary, "first").collect()}
    assert first == {1: [1.0, 2.0], 2: [3.0, 4.0]}
    with pytest.raises(ValueError, match="unknown pooling"):
        embed.pooled_static(df, ["id"], vocabulary, "max")
    with pytest.raises(ValueError, match="no entry"):
        embed.static_vectors(embed.token_rows(df, ["id"]), vocabulary.where("word <> 'UNK'"))


def test_pool_of_encoders_with_different_widths(spark):
    rng = np.random.default_rng(9)
    wide, slim, y = rng.normal(size=(50, 6)), rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    rows = [x for k in range(50) for x in (("wide", wide[k].tolist(), int(y[k])), ("slim", slim[k].tolist(), int(y[k])))]
    df = spark.createDataFrame(rows, "encoder string, features array<double>, label int").coalesce(1)
    scores = {r["encoder"]: r["logme"] for r in logme.score_pool(df).collect()}
    assert scores["wide"] == pytest.approx(dense_logme(wide, onehot(y)), abs=1e-10)
    assert scores["slim"] == pytest.approx(dense_logme(slim, onehot(y)), abs=1e-10)


def test_encode_pools_and_fills_unknown_words(spark):
    a = spark.createDataFrame([("UNK", [0.0, 0.0]), ("x", [1.0, 2.0]), ("y", [3.0, 4.0])], "word string, vec array<double>")
    b = spark.createDataFrame([("UNK", [9.0]), ("y", [5.0])], "word string, vec array<double>")
    df = spark.createDataFrame([(1, ["x", "y", "z"], 0)], "id int, tokens array<string>, label int")
    rows = encoding.encode(df, ["id"], {"a": a, "b": b}, "sequence_classification", ["mean", "first"])
    got = {(r["encoder"], r["pooling"]): r["features"] for r in rows.collect()}
    assert got[("a", "mean")] == pytest.approx([4 / 3, 2.0]) and got[("a", "first")] == [1.0, 2.0]
    assert got[("b", "mean")] == pytest.approx([23 / 3]) and got[("b", "first")] == [9.0]
    tokens = df.withColumn("labels", F.array(F.lit(0), F.lit(1), F.lit(0)))
    long = encoding.encode(tokens, ["id"], {"a": a, "b": b}, "token_classification").orderBy("encoder", "pos").collect()
    assert [(r["encoder"], r["pos"], list(r["features"]), r["label"]) for r in long] == [
        ("a", 0, [1.0, 2.0], 0), ("a", 1, [3.0, 4.0], 1), ("a", 2, [0.0, 0.0], 0),
        ("b", 0, [9.0], 0), ("b", 1, [5.0], 1), ("b", 2, [9.0], 0),
    ]
    with pytest.raises(ValueError, match="unknown task"):
        encoding.encode(df, ["id"], {"a": a}, "other")
    with pytest.raises(ValueError, match="no entry"):
        encoding.encode(df, ["id"], {"a": a.where("word <> 'UNK'")}, "sequence_classification")
