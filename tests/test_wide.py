"""Tiled Gram matrices, QR axes and looked-up words against plain versions."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encoscope.operators import embed, logme, wide


def frame(spark, rows, parts=3):
    return spark.createDataFrame([("a", r.tolist()) for r in rows], "encoder string, features array<double>").repartition(parts)


@pytest.mark.parametrize(("tile", "chunk"), [(3, 200), (7, 1 << 20), (64, 1 << 20)])
def test_tiles_make_the_gram_matrix(spark, tile, chunk):
    rng = np.random.default_rng(1)
    f, g = rng.normal(size=(50, 10)), rng.normal(size=(20, 4))
    df = frame(spark, f).unionByName(frame(spark, g).withColumn("encoder", F.lit(None).cast("string")))
    got = wide.tile_cells(wide.gram_tiles(df, tile=tile, chunk_bytes=chunk)).collect()
    for name, m in (("a", f.T @ f), (None, g.T @ g)):
        cells = {(r["i"], r["j"]): r["g"] for r in got if r["encoder"] == name}
        assert cells == {(i, j): pytest.approx(m[i, j]) for i in range(len(m)) for j in range(i, len(m))}
    assert wide.tile_cells(wide.gram_tiles(df.limit(0))).collect() == []


def test_a_task_holds_chunks_and_one_tile(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(1500, 4096)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, 500 * 4096 + 1, 4096).astype(np.int32), pa.array(part.ravel()))], ["f"]) for part in np.split(rows, 3)]
    tracemalloc.start()
    seen = 0
    for _, _, chunk in wide._chunks(iter(batches), 0, 16 << 20):
        for a in range(0, 4096, 1024):
            seen += (chunk[:, a : a + 1024].T @ chunk[:, a : a + 1024]).size
    assert seen and tracemalloc.get_traced_memory()[1] < 100 << 20  # the whole matrix would take 128 MB
    tracemalloc.stop()


@pytest.mark.parametrize("parts", [1, 20])
def test_small_singular_values_keep_their_digits(spark, parts):
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(np.concatenate([np.ones((200, 1)), rng.normal(size=(200, 8))], axis=1))
    v, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    values = 10.0 ** -np.arange(8)
    f = (u[:, 1:] * values) @ v.T + rng.normal(size=8)
    got = wide.axes(frame(spark, f, parts), 8).first()
    want = np.linalg.svd(f - f.mean(axis=0), compute_uv=False)
    assert got["n"] == 200 and got["mean"] == pytest.approx(f.mean(axis=0).tolist())
    assert got["singular"] == pytest.approx(values.tolist(), rel=1e-6) and values.tolist() == pytest.approx(want.tolist(), rel=1e-6)
    assert np.abs(np.array(got["basis"]) @ v) == pytest.approx(np.eye(8), abs=1e-6)
    # the squared matrix has lost the last ones
    squared = np.linalg.eigvalsh(f.T @ f - 200 * np.outer(f.mean(axis=0), f.mean(axis=0)))[::-1]
    assert abs(np.sqrt(max(squared[-1], 0)) - values[-1]) > 1e-6 * values[-1]


def test_axes_project_like_the_gram_route(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(40, 5)) + 1)
    found = wide.axes(df, 2)
    by_qr = logme.project(df, found.select("encoder", "mean", "basis")).select("features").collect()
    centred = np.array([r["features"] for r in df.collect()])
    centred = centred - centred.mean(axis=0)
    sizes = (np.array([r["features"] for r in by_qr]) ** 2).sum(axis=0)
    assert np.sqrt(sizes) == pytest.approx(np.linalg.svd(centred, compute_uv=False)[:2])
    with pytest.raises(Exception, match="not enough rows"):
        wide.axes(df.limit(1), 2).collect()


def test_uneven_or_missing_features_fail(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0])], "encoder string, features array<double>")
    with pytest.raises(Exception, match="one length"):
        wide.gram_tiles(df.coalesce(1)).collect()
    with pytest.raises(Exception, match="one length"):
        wide.axes(df.repartition(2), 1).collect()
    with pytest.raises(Exception, match="NULL in features"):
        wide.axes(df.withColumn("features", F.lit(None).cast("array<double>")), 1).collect()


def test_words_from_lookup_equal_those_from_pieces(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(6):
        rows.append((s, 0, "[CLS]", 0, True))
        for k in range(1, 9):
            rows.append((s, k, f"p{rng.integers(5)}", int(rng.integers(0, 3) if k > 1 else 0), False))
        rows.append((s, 9, "[SEP]", 0, True))
    pieces = spark.createDataFrame(rows, "sent int, piece int, text string, off_start int, is_special boolean")
    names = ["[CLS]", "[SEP]", *(f"p{k}" for k in range(5))]
    inventory = spark.createDataFrame([(n, rng.normal(size=3).tolist()) for n in names], "text string, vec array<double>")
    joined = pieces.join(inventory, "text")
    for cls in (False, True):
        want = {(r["sent"], r["pos"]): (r["n_pieces"], pytest.approx(r["vec"])) for r in embed.words_from_pieces(joined, ["sent"], cls).collect()}
        got = embed.words_from_lookup(pieces, ["sent"], inventory, cls=cls)
        assert {(r["sent"], r["pos"]): (r["n_pieces"], r["vec"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("hashpartitioning") <= 1
