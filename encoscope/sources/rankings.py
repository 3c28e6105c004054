"""Ranking study files: gold and transferability scores as JSON, human rankings as CSV."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = "map<string, map<string, struct<model: array<string>, f1: array<double>, logme: array<double>>>>"

# Fixed value: columns before the first task block of a survey.
LEAD_COLUMNS = 2
# Blocks of a survey that leave a task at once.
BLOCK_ROWS = 1 << 16


def read_target_rankings(spark: SparkSession, path: str) -> DataFrame:
    """``(setup, task_idx, task, model, f1, logme)`` from nested JSON, tasks in file order."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", SCORES).alias("m"))
    setups = parsed.select(F.explode("m").alias("setup", "_tasks"))
    tasks = setups.select("setup", F.posexplode("_tasks").alias("task_idx", "task", "_s"))
    return tasks.select("setup", "task_idx", "task", F.inline(F.arrays_zip("_s.model", "_s.f1", "_s.logme")))


def read_survey(spark: SparkSession, path: str, models: int) -> DataFrame:
    """``(participant, task_idx, ranking)``: a block of ``models`` names per task, best first.

    A last block of fewer columns is kept as it is; ``duplicate_choices`` reports it. Blocks are rows from
    the start and never columns, so a study may have any number of tasks. A file is parsed by one task, as
    quoted cells may hold line breaks.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        participant = TaskContext.get().partitionId() << 33
        for batch in batches:
            for text in batch.column(0):
                records = csv.reader(io.StringIO(text.as_py().removeprefix("\ufeff"), newline=""))
                width = len(next(filter(None, records), []))  # the header
                for cells in filter(None, records):
                    participant += 1
                    ranked = [c or None for c in cells[LEAD_COLUMNS:width]]
                    ranked += [None] * (width - LEAD_COLUMNS - len(ranked))
                    blocks = [ranked[at : at + models] for at in range(0, len(ranked), models)]
                    for at in range(0, len(blocks), BLOCK_ROWS):
                        part = blocks[at : at + BLOCK_ROWS]
                        columns = [[participant] * len(part), range(at, at + len(part)), part]
                        types = [pa.int64(), pa.int32(), pa.list_(pa.string())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["participant", "task_idx", "ranking"])

    return spark.read.text(path, wholetext=True).select("value").mapInArrow(parse, "participant long, task_idx int, ranking array<string>")


def write_survey(blocks: DataFrame, path: str, models: int, participant: str = "participant", task: str = "task") -> None:
    """``(participant, task, ranking)`` as a survey of one header and one line per participant.

    Every line has a block of ``models`` cells for each task that comes, in the order of the names; blocks
    not given and places left empty are blank. Lines are built from arrays, whose length is free.
    """
    tasks = blocks.select(task).distinct()
    given = blocks.select(F.col(participant).alias("_who"), F.col(task).alias("_task"), "ranking")
    own = F.col(participant).eqNullSafe(F.col("_who")) & F.col(task).eqNullSafe(F.col("_task"))
    whole = blocks.select(participant).distinct().crossJoin(tasks).join(given, own, "left")
    places = F.sequence(F.lit(0), F.lit(models - 1))
    cells = F.transform(places, lambda k: F.coalesce(_csv_cell(F.get("ranking", k)), F.lit("")))
    block = F.struct(F.col(task).cast("string").alias("task"), F.array_join(cells, ",").alias("cells"))
    lines = whole.groupBy(participant).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    who = F.coalesce(_csv_cell(F.col(participant).cast("string")), F.lit(""))
    line = F.concat_ws(",", F.lit("now"), who, F.array_join(F.col("blocks.cells"), ","))
    numbered = F.sequence(F.col("id"), F.lit(tasks.count() - 1))
    names = F.transform(numbered, lambda t: F.array_join(F.transform(places, lambda k: F.concat_ws("-", F.concat(F.lit("t"), t), k)), ","))
    header = blocks.sparkSession.range(1).select(F.concat_ws(",", F.lit("time"), F.lit("who"), F.array_join(names, ",")).alias("value"), F.lit(0).alias("_at"))
    rows = header.unionByName(lines.select(line.alias("value"), F.lit(1).alias("_at")))
    rows.repartition(1).sortWithinPartitions("_at").select("value").write.text(path)


def _csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def target_models(targets: DataFrame) -> int:
    """Size of the encoder pool."""
    return targets.select("model").distinct().count()
