"""Registered queries: each operator run over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from encoscope.functions.partitions import spread


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its equivalent SQL, if SQL can say it."""

    def add(fn):
        REGISTRY[name] = Registered(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores before per-row text work."""
    return spread(table(spark, sf_dir, name))


def load_all() -> dict[str, Registered]:
    from encoscope.plans import (  # noqa: F401
        data,
        embedding,
        evaluation,
        files,
        formats,
        onehot,
        studies,
        tasks,
        transfer,
        treebanks,
    )

    return REGISTRY
