"""Means over runs of rows: no vectors in hash tables, runs over several batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from encoscope.operators import averages, embed, features


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_over_batches_without_hash_tables(spark, tiny_batches, monkeypatch):
    monkeypatch.setattr(averages, "SLICE_BYTES", 64)
    rng = np.random.default_rng(6)
    rows = []
    for s in (None, 1, 2, 3):
        for k in range(20):
            special = k in (0, 7, 19)  # one stands inside a word
            text = None if k == 5 else "?" if k == 11 else f"p{rng.integers(5)}"
            rows.append((s, k, text, 0 if k in (1, 12, 15) else 3, special))
    pieces = spark.createDataFrame(rows, "sent int, piece int, text string, off_start int, is_special boolean")
    inventory = spark.createDataFrame([(f"p{k}", rng.normal(size=3).tolist()) for k in range(5)], "text string, vec array<double>")
    for cls in (False, True):
        got = embed.words_from_lookup(pieces, ["sent"], inventory, cls=cls)
        assert "ObjectHashAggregate" not in plan_of(got) and "SortAggregate" not in plan_of(got)
        with monkeypatch.context() as m:
            m.setattr(embed, "VOCABULARY_ROWS", 1)  # joined by shuffle
            want = embed.words_from_lookup(pieces, ["sent"], inventory, cls=cls)
            plain = {(r["sent"], r["pos"]): (r["n_pieces"], pytest.approx(r["vec"])) for r in want.collect()}
        assert {(r["sent"], r["pos"]): (r["n_pieces"], r["vec"]) for r in got.collect()} == plain
        assert got.count() == len(plain)


def test_sequences_over_batches_without_hash_tables(spark, tiny_batches, monkeypatch):
    monkeypatch.setattr(averages, "SLICE_BYTES", 64)
    a = spark.createDataFrame([("UNK", [0.5, 0.0]), ("x", [1.0, 2.0]), ("y", [3.0, 4.0])], "word string, vec array<double>")
    b = spark.createDataFrame([("UNK", [9.0]), ("y", [5.0])], "word string, vec array<double>")
    # id 4 comes in ten rows and is one sequence; a null token is an unknown word
    rows = [(1, ["x", "y", "z"], 0), (2, [], 1), (3, None, 1), (None, ["y", None], None), *[(4, ["x"] * k + ["x"], 2) for k in range(10)]]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, label int")
    got = features.encode(df, ["id"], {"a": a, "b": b}, "sequence_classification", ["mean", "first"])
    assert "ObjectHashAggregate" not in plan_of(got)
    key = lambda r: (r["encoder"], r["pooling"], r["id"], r["label"])
    found = {key(r): r["features"] for r in got.collect()}
    with monkeypatch.context() as m:
        m.setattr(features, "VOCABULARY_ROWS", 1)
        m.setattr(embed, "VOCABULARY_ROWS", 1)
        want = features.encode(df, ["id"], {"a": a, "b": b}, "sequence_classification", ["mean", "first"])
        plain = {key(r): pytest.approx(r["features"]) for r in want.collect()}
    assert found == plain and len(found) == 12 and got.count() == 12
    assert got.select(F.col("features")).schema == want.select("features").schema
