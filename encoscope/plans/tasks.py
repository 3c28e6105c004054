"""Whole scoring runs: labelled text to features of an encoder pool to transferability scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.text import whitespace_tokens
from encoscope.functions.vectors import fold
from encoscope.operators import features, labels, logme
from encoscope.plans import query, texts
from encoscope.plans.data import SQL_TAG_MAP, SQL_TAGS, fold_sql, tag_map, tagged_sentences
from encoscope.plans.embedding import SQL_TOKEN_VECTORS, SQL_VOCABULARY, vocabulary
from encoscope.plans.transfer import PLANE_CELLS, PLANE_FIXED_POINT

ROLE_IDS = {"user": 0, "assistant": 1, "system": 2}


def plane_encoders(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two encoders of two dimensions from all of each word vector: the sums of every second value, and
    of the squares of every second value."""
    words = vocabulary(spark, sf_dir)
    squares = F.transform("vec", lambda x: x.cast("double") * x.cast("double"))
    return {
        "plain": words.select("word", fold(F.col("vec"), 2).alias("vec")),
        "square": words.select("word", fold(squares, 2).alias("vec")),
    }


def role_dataset(spark, sf_dir):
    rows = texts(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id",
        "turn",
        whitespace_tokens(F.col("text")).alias("tokens"),
        labels.map_constants(F.col("role"), ROLE_IDS).alias("label"),
    )


def tag_dataset(spark, sf_dir):
    rows = tagged_sentences(spark, sf_dir)
    return labels.map_label_arrays(rows, "gold", tag_map(spark), "label", "label_id", ["conv_id", "turn"], "labels")


SQL_WIDE = f"""
wide AS (
  SELECT *, {fold_sql(2, 0, 'vec')}::FLOAT::DOUBLE AS h1, {fold_sql(2, 1, 'vec')}::FLOAT::DOUBLE AS h2,
         {fold_sql(2, 0, 'vec', 'x::DOUBLE * x::DOUBLE')}::FLOAT::DOUBLE AS t1, {fold_sql(2, 1, 'vec', 'x::DOUBLE * x::DOUBLE')}::FLOAT::DOUBLE AS t2
  FROM vectors
)"""

SQL_ROLE_ROWS = """
roles AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END AS label FROM conversations),
labelled AS (SELECT w.*, r.label FROM wide w JOIN roles r ON r.conv_id = w.conv_id AND r.turn = w.turn),
rows2 AS (
  SELECT 'plain|mean' AS e, any_value(label) AS label, avg(h1) AS f1, avg(h2) AS f2 FROM labelled GROUP BY conv_id, turn
  UNION ALL SELECT 'square|mean', any_value(label), avg(t1), avg(t2) FROM labelled GROUP BY conv_id, turn
  UNION ALL SELECT 'plain|first', label, h1, h2 FROM labelled WHERE pos = 0
  UNION ALL SELECT 'square|first', label, t1, t2 FROM labelled WHERE pos = 0
)"""

SQL_SCORES = """
SELECT split_part(e, '|', 1) AS encoder, split_part(e, '|', 2) AS pooling, round(avg(evidence), 6) AS logme FROM model GROUP BY 1, 2"""


@query(
    "logme_sequence_task",
    f"WITH RECURSIVE {SQL_TOKEN_VECTORS}, {SQL_WIDE}, {SQL_ROLE_ROWS}, {PLANE_CELLS}, {PLANE_FIXED_POINT} {SQL_SCORES}",
)
def logme_sequence_task(spark, sf_dir):
    """Scores of two encoders under both poolings for telling the speaker's role."""
    rows = features.encode(
        role_dataset(spark, sf_dir), ["conv_id", "turn"], plane_encoders(spark, sf_dir), "sequence_classification", ["mean", "first"]
    )
    scores = logme.score_pool(rows, ["encoder", "pooling"])
    return scores.select("encoder", "pooling", F.round("logme", 6).alias("logme"))


SQL_TAG_ROWS = f"""{SQL_TAGS}, {SQL_VOCABULARY}, {SQL_TAG_MAP},
vectors AS (
  SELECT label_id AS label, coalesce(v.vec, u.vec) AS vec
  FROM tags t JOIN tag_map m ON m.label = t.gold LEFT JOIN vocab v ON v.word = t.token, (SELECT vec FROM vocab WHERE word = 'UNK') AS u
), {SQL_WIDE},
rows2 AS (SELECT 'plain|none' AS e, label, h1 AS f1, h2 AS f2 FROM wide UNION ALL SELECT 'square|none', label, t1, t2 FROM wide)"""


@query(
    "logme_token_task",
    f"WITH RECURSIVE {SQL_TAG_ROWS}, {PLANE_CELLS}, {PLANE_FIXED_POINT} {SQL_SCORES}",
)
def logme_token_task(spark, sf_dir):
    """Scores of two encoders for a tagging task, one row per token."""
    rows = features.encode(tag_dataset(spark, sf_dir), ["conv_id", "turn"], plane_encoders(spark, sf_dir), "token_classification")
    scores = logme.score_pool(rows, ["encoder", "pooling"])
    return scores.select("encoder", "pooling", F.round("logme", 6).alias("logme"))


@query("logme_task_leaderboard")
def logme_task_leaderboard(spark, sf_dir):
    """Full word vectors against vectors of half the width, both poolings, ranked."""
    words = vocabulary(spark, sf_dir)
    encoders = {"full": words, "half": words.select("word", fold(F.col("vec"), 32).alias("vec"))}
    rows = features.encode(role_dataset(spark, sf_dir), ["conv_id", "turn"], encoders, "sequence_classification", ["mean", "first"])
    scores = logme.score_pool(rows, ["encoder", "pooling"])
    ranked = logme.leaderboard(scores, "logme", "encoder", ["pooling"])
    return ranked.select("pooling", "encoder", F.round("logme", 6).alias("logme"), "rank")
