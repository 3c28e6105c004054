"""Experiment runs: grids, what is still to do, early stopping, seed averages."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from queue import Queue
from threading import Event, Timer

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The seeds of the published runs, and pooling with the embedding kind it goes with.
SEEDS = (4012, 5060, 8823, 8857, 9908)
POOLING_KINDS = {"first": "transformer+cls", "mean": "transformer"}

RUN_KEYS = ("task", "encoder", "pooling", "head", "seed")


def grid(
    tasks: DataFrame,
    encoders: Sequence[str],
    poolings: Iterable[str] = tuple(POOLING_KINDS),
    heads: Sequence[str] = ("mlp",),
    seeds: Sequence[int] = SEEDS,
) -> DataFrame:
    """Every combination of the given values, for each row of ``tasks`` (column ``task``)."""
    choices = F.array(*[F.struct(F.lit(POOLING_KINDS[p]).alias("kind"), F.lit(p).alias("pooling")) for p in poolings])
    out = tasks.withColumn("_choice", F.explode(choices))
    out = out.withColumn("_name", F.explode(F.array(*[F.lit(e) for e in encoders])))
    out = out.withColumn("head", F.explode(F.array(*[F.lit(h) for h in heads])))
    out = out.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    spec = F.concat(F.col("_choice.kind"), F.lit(":"), F.col("_name"))
    return out.select("task", spec.alias("encoder"), F.col("_choice.pooling").alias("pooling"), "head", "seed")


def pending(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs of the grid that the registry does not hold yet."""
    return runs.join(finished.select(*RUN_KEYS).distinct(), list(RUN_KEYS), "left_anti")


def early_stop(log: DataFrame, patience: int, keys: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Where training stops and which epoch is kept.

    An epoch is saved when its loss is not above the lowest so far (ties save again). Training stops
    at the first epoch that lies ``patience`` epochs after the first lowest one. A run has one row
    per epoch, so its window is as long as the epoch limit.
    """
    keys = list(keys)
    so_far = Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    lowest = F.min(F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))).over(so_far)
    marked = log.withColumn("_low", lowest)
    marked = marked.withColumn("_stop", F.col(epoch) - F.col("_low.epoch") >= patience)
    whole = Window.partitionBy(*keys)
    marked = marked.withColumn(
        "_last", F.coalesce(F.min(F.when(F.col("_stop"), F.col(epoch))).over(whole), F.max(epoch).over(whole))
    ).where(F.col(epoch) <= F.col("_last"))
    saved = F.col(loss) <= F.col("_low.loss")
    return marked.groupBy(*keys).agg(
        F.max("_last").alias("stop_epoch"),
        F.max(F.when(saved, F.col(epoch))).alias("kept_epoch"),
        F.min(F.struct(F.col(loss), F.col(epoch)))[epoch].alias("best_epoch"),
        F.min(loss).alias("best_loss"),
        F.count_if(saved).alias("n_saves"),
        F.max("_stop").alias("stopped_early"),
    )


def over_seeds(results: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and spread of a metric over the seeds of one configuration."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev")
    )


RUN_RESULT = "task string, encoder string, pooling string, head string, seed int, value double, error string"


def run_all(
    runs: DataFrame,
    execute,
    registry: str | None = None,
    at_once: int = 1,
    retries: int = 0,
    limit: float | None = None,
    pool: str | None = None,
) -> DataFrame:
    """Carry pending runs out, ``at_once`` of them beside each other; each is a distributed job of its own.

    ``execute(row)`` returns a metric value. Gives one row a run: ``value``, or the ``error`` of a run
    that failed ``retries`` times more, which does not stop the others. Each success is appended to the
    ``registry`` folder as it ends, so a driver that is lost repeats the runs in flight at most. Runs are
    fetched one partition at a time, and no more than twice ``at_once`` wait.

    The jobs of a run share a job group, and with ``pool`` a scheduler pool of that name and its number, so
    that a fair scheduler shares the cluster among them. A run that takes more than ``limit`` seconds has its
    jobs cancelled; that counts as a failure.
    """
    spark: SparkSession = runs.sparkSession
    context = spark.sparkContext
    slots: Queue = Queue()
    for slot in range(at_once):
        slots.put(slot)

    def attempt(row, group: str, slot: int) -> float:
        context.setJobGroup(group, f"run {group}", interruptOnCancel=True)
        if pool is not None:
            context.setLocalProperty("spark.scheduler.pool", f"{pool}-{slot}")
        late = Event()

        def cancel() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = Timer(limit, cancel) if limit is not None else None
        try:
            if timer:
                timer.start()
            value = float(execute(row))
        except Exception as err:
            raise TimeoutError(f"took more than {limit} seconds") if late.is_set() else err
        finally:
            if timer:
                timer.cancel()
        if late.is_set():
            raise TimeoutError(f"took more than {limit} seconds")
        return value

    def carry(row) -> tuple:
        key, slot = [row[k] for k in RUN_KEYS], slots.get()
        try:
            for turn in range(retries + 1):
                try:
                    return (*key, attempt(row, f"{uuid.uuid4().hex}-{turn}", slot), None)
                except Exception as err:  # noqa: BLE001  the failure is part of the result
                    failed = f"{type(err).__name__}: {err}"
            return (*key, None, failed)
        finally:
            slots.put(slot)

    def settle(finished) -> None:
        for future in finished:
            done.append(future.result())
            if done[-1][-1] is None and registry is not None:
                row = spark.createDataFrame(done[-1:], RUN_RESULT).select(*RUN_KEYS)
                row.coalesce(1).write.mode("append").parquet(registry)

    done: list[tuple] = []
    waiting: set = set()
    with ThreadPoolExecutor(at_once) as threads:
        for row in runs.orderBy(*RUN_KEYS).toLocalIterator():
            # a thread starts with the local properties of the caller
            waiting.add(threads.submit(inheritable_thread_target(spark)(carry), row))
            if len(waiting) >= 2 * at_once:
                finished, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                settle(finished)
        while waiting:
            finished, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            settle(finished)
    return spark.createDataFrame(done, RUN_RESULT)
