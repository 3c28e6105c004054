"""Chat formatting: keep conversations that no longer one continues, then render them.

Logs often hold a conversation again after each turn. Every turn carries a rolling hash of all turns
so far; a conversation whose last hash is the hash of a proper prefix elsewhere is a snapshot.
Everything is DataFrame work; no conversation is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encoscope.llm.common import written

BLOCK = 1024
PART_TURNS = 256


def _digests(order: str) -> list[Column]:
    """Two independent 64-bit hashes of a turn and its place; nulls differ from empty strings."""
    said = [F.col(order), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(F.lit(seed), *said) for seed in (1, 2)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns with ``place`` (from 1) in each conversation and rolling hashes ``h1``, ``h2`` through it.

    The order is by turn, role, text, nulls first. A row repeated exactly is one turn logged twice and
    counts once. Rows without ``conv_id`` belong to no conversation and are left out. A conversation is
    cut into blocks of ``BLOCK`` turn numbers, so one with a third of all rows is spread over tasks;
    only one row a block goes through the ordered pass. Texts are shuffled once, by block; what is found
    out about blocks comes to them.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    # turns without a number come first
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)).cast("long"))
    turns = turns.withColumn("_block", block).repartition("conv_id", "_block")
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct("turn", "role", "text")
    turns = turns.withColumn("_again", F.lag(row).over(inside).eqNullSafe(row)).where(~F.col("_again")).drop("_again")

    counts = turns.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = turns.join(counts, ["conv_id", "_block"])
    placed = placed.withColumn("place", F.col("_start") + F.row_number().over(inside)).drop("_start")
    d1, d2 = _digests("place")
    placed = placed.withColumn("_d1", d1).withColumn("_d2", d2)

    sums = placed.groupBy("conv_id", "_block").agg(F.bit_xor("_d1").alias("_s1"), F.bit_xor("_d2").alias("_s2"), F.max("place").alias("_last"))
    for s in ("_s1", "_s2"):
        sums = sums.withColumn(s, F.coalesce(F.bit_xor(s).over(before), F.lit(0)))
    rolled = placed.join(sums, ["conv_id", "_block"])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    for h, d, s in (("h1", "_d1", "_s1"), ("h2", "_d2", "_s2")):
        rolled = rolled.withColumn(h, F.bit_xor(d).over(so_far).bitwiseXOR(F.col(s)))
    return rolled.select("conv_id", "turn", "role", "text", "place", "h1", "h2")


def maximal_ids(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of conversations that are no prefix of a longer one.

    Of equal conversations the one with the smallest id stays. The prefixes of all conversations are
    counted map-side, so a first turn that a third of them share is one row for each task.
    """
    key = ["place", "h1", "h2"]
    ends = turns.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("_end"))
    whole = ends.groupBy("_end").agg(F.min("conv_id").alias("conv_id"))
    whole = whole.select("conv_id", *[F.col(f"_end.{k}").alias(k) for k in key])
    # a prefix is proper if more conversations go through it than end with it
    passed = turns.groupBy(*key).agg(F.count("*").alias("_through"))
    ended = ends.groupBy("_end").agg(F.count("*").alias("_ended")).select(*[F.col(f"_end.{k}").alias(k) for k in key], "_ended")
    proper = passed.join(ended, key, "left").where(F.col("_through") > F.coalesce("_ended", F.lit(0))).select(*key)
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``<|role|>`` line, text and ``<|end|>`` line for each turn, joined in order.

    A conversation of more than ``part_turns`` turns is given in parts (``part`` from 0) of that many
    turns; concatenated they are the whole. A null role reads ``unknown``; a null text is empty.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    parts = turns.withColumn("part", F.expr(f"cast((place - 1) div {part_turns} as int)")).withColumn("_line", line)
    gathered = parts.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "_line"))).alias("_lines"))
    return gathered.select(
        "conv_id", "part", F.size("_lines").cast("long").alias("part_turns"), F.concat_ws("", F.col("_lines._line")).alias("rendered")
    )


def chat_format(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns (whole), part_turns, rendered.

    An empty table gives no rows. Other columns of the input are ignored.
    """
    turns = written(numbered_turns(conversations), "turns")
    kept = maximal_ids(turns)
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select(
        "conv_id", "part", "n_turns", "part_turns", "rendered"
    )


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t
), p AS (
  SELECT conv_id, place, list([role, text]) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM n
), e AS (
  SELECT conv_id, max(place) AS n_turns, arg_max(so_far, place) AS whole FROM p GROUP BY conv_id
), w AS (
  SELECT whole, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns FROM e GROUP BY whole
), proper AS (
  SELECT DISTINCT p.so_far FROM p JOIN e USING (conv_id) WHERE p.place < e.n_turns
), kept AS (
  SELECT conv_id, n_turns FROM w WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.so_far = w.whole)
)
SELECT conv_id, CAST((place - 1) // {PART_TURNS} AS INTEGER) AS part, any_value(n_turns) AS n_turns, count(*) AS part_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM n JOIN kept USING (conv_id) GROUP BY conv_id, (place - 1) // {PART_TURNS}
"""
