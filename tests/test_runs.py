"""Runs beside each other, cancelled and tried again."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from encoscope.operators import embed, runs


def grid(spark, seeds):
    return runs.grid(spark.createDataFrame([("x",)], "task string"), ["e1"], ["mean"], ["linear"], seeds)


def test_runs_overlap_within_their_bound(spark, tmp_path):
    lock, now, most = threading.Lock(), [0], [0]
    groups = set()

    def execute(row):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        groups.add(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") in ("runs-0", "runs-1")
        time.sleep(0.3)
        value = spark.range(row["seed"]).count()
        with lock:
            now[0] -= 1
        return value

    done = runs.run_all(grid(spark, [1, 2, 3, 4, 5]), execute, f"{tmp_path}/registry", at_once=2, pool="runs")
    assert sorted((r["seed"], r["value"], r["error"]) for r in done.collect()) == [(n, float(n), None) for n in (1, 2, 3, 4, 5)]
    assert most[0] == 2 and len(groups) == 5
    assert runs.pending(grid(spark, [1, 2, 3, 4, 5, 6]), spark.read.parquet(f"{tmp_path}/registry")).first()["seed"] == 6


def test_a_failed_run_is_tried_again(spark):
    tries = []

    def execute(row):
        tries.append(row["seed"])
        if tries.count(row["seed"]) < 2 or row["seed"] == 2:
            raise RuntimeError("no")
        return 1.0

    done = runs.run_all(grid(spark, [1, 2]), execute, at_once=2, retries=1)
    assert {(r["seed"], r["value"], r["error"]) for r in done.collect()} == {(1, 1.0, None), (2, None, "RuntimeError: no")}
    assert sorted(tries) == [1, 1, 2, 2]


def test_a_late_run_is_cancelled(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")

    def execute(row):
        if row["seed"] == 1:
            return spark.range(2).select(slow("id").alias("x")).agg(F.sum("x")).first()[0]
        return spark.range(5).count()

    began = time.time()
    done = {r["seed"]: (r["value"], r["error"]) for r in runs.run_all(grid(spark, [1, 2]), execute, at_once=2, limit=3).collect()}
    assert done[2] == (5.0, None) and done[1] == (None, "TimeoutError: took more than 3 seconds")
    assert time.time() - began < 20


def test_length_batches_cover_all_within_the_cells():
    lengths = [5, 0, 100, 7, 7, 6, 0, 30]
    batches = embed.length_batches(lengths, 21)
    assert sorted(p for b in batches for p in b) == list(range(8))
    assert all(len(b) * max(1, *(lengths[p] for p in b)) <= 21 or len(b) == 1 for b in batches)
    assert embed.length_batches([], 5) == []


@pytest.mark.parametrize("cells", [None, 1, 4000])
def test_length_batches_give_the_same_vectors(spark, cells):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    ).coalesce(2)

    def factory():
        def model(texts):
            longest = max(len(t or "") for t in texts)
            return [[float(len(t or "")), float(longest * len(texts)), float(len(texts))] for t in texts]

        return model

    got = embed.embed_texts(docs, factory, cells=cells).select("doc_id", "features").collect()
    want = {r["doc_id"]: float(len(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["features"][0] for r in got} == want
    if cells == 4000:
        padded = sum(r["features"][1] / r["features"][2] for r in got)
        assert all(r["features"][1] <= 4000 or r["features"][2] == 1 for r in got)
        # whole Arrow batches pad every text to the longest of them
        whole = sum(r["features"][1] / r["features"][2] for r in embed.embed_texts(docs, factory).select("features").collect())
        assert sum(want.values()) <= padded < 0.1 * whole
