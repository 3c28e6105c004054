"""Evaluation queries: F1 reports, chunk scores, batch means and head metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from encoscope.functions.text import tag_prefix, tag_type
from encoscope.functions.vectors import fold, softmax
from encoscope.operators import chunks, evaluate
from encoscope.plans import query, table
from encoscope.plans.data import SQL_TAGS, tagged_sentences


def quality_pairs(spark, sf_dir):
    """Gold quality labels with predictions that are wrong for every fifth document."""
    rows = table(spark, sf_dir, "labels")
    gold = rows.select("doc_id", F.col("quality").alias("gold"))
    wrong = (F.pmod("doc_id", F.lit(5)) == 0).cast("int")
    pred = rows.select("doc_id", F.pmod(F.col("quality") + wrong, F.lit(2)).alias("pred"))
    return evaluate.align(gold, pred, ["doc_id"])


SQL_QUALITY = """
pairs AS (SELECT quality::VARCHAR AS gold, ((quality + (doc_id % 5 = 0)::INT) % 2)::VARCHAR AS pred FROM labels)"""

SQL_F1 = """
sides AS (
  SELECT gold AS label, 1 AS support, 0 AS predicted, (gold = pred)::INT AS hits FROM pairs
  UNION ALL SELECT pred, 0, 1, 0 FROM pairs
),
scores AS (
  SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits,
         2 * sum(hits)::DOUBLE / (sum(support) + sum(predicted)) AS f1 FROM sides GROUP BY 1
)"""

SQL_REPORT = """
SELECT round(200 * sum(hits)::DOUBLE / (sum(support) + sum(predicted)), 6) AS micro_f1, round(100 * avg(f1), 6) AS macro_f1,
       round(100 * sum(support * f1) / sum(support), 6) AS weighted_macro_f1 FROM scores"""


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


F1_NAMES = ("micro_f1", "macro_f1", "weighted_macro_f1")


@query("f1_report", f"WITH {SQL_QUALITY}, {SQL_F1} {SQL_REPORT}")
def f1_report(spark, sf_dir):
    return _rounded(evaluate.f1_report(evaluate.confusion(quality_pairs(spark, sf_dir))), *F1_NAMES)


@query(
    "f1_report_with_header",
    f"WITH {SQL_QUALITY.replace('FROM labels)', '''FROM labels UNION ALL SELECT 'label', 'label')''')}, {SQL_F1} {SQL_REPORT}",
)
def f1_report_with_header(spark, sf_dir):
    pairs = evaluate.confusion(quality_pairs(spark, sf_dir))
    return _rounded(evaluate.f1_report(pairs, compat_header=True), *F1_NAMES)


SQL_TOKEN_PAIRS = f"{SQL_TAGS}, pairs AS (SELECT gold, pred FROM tags)"


@query(
    "f1_by_label",
    f"WITH {SQL_TOKEN_PAIRS}, {SQL_F1} SELECT label, support::BIGINT AS support, predicted::BIGINT AS predicted, hits::BIGINT AS hits, round(f1, 6) AS f1 FROM scores",
)
def f1_by_label(spark, sf_dir):
    pairs = evaluate.label_pairs(tagged_sentences(spark, sf_dir), "gold", "pred")
    return _rounded(evaluate.f1_by_label(evaluate.confusion(pairs)), "f1")


@query("token_f1", f"WITH {SQL_TOKEN_PAIRS}, {SQL_F1} {SQL_REPORT}")
def token_f1(spark, sf_dir):
    """Token-level F1 of gold and predicted sentences that arrive as two tables."""
    rows = tagged_sentences(spark, sf_dir)
    both = evaluate.align(rows.select("conv_id", "turn", "gold"), rows.select("conv_id", "turn", "pred"), ["conv_id", "turn"])
    pairs = evaluate.label_pairs(both, "gold", "pred")
    return _rounded(evaluate.f1_report(evaluate.confusion(pairs)), *F1_NAMES)


@query(
    "merge_gold_pred",
    f"""WITH {SQL_TAGS}
SELECT conv_id, turn, string_agg(token || chr(9) || gold || chr(9) || pred, chr(10) ORDER BY pos) AS merged FROM tags GROUP BY 1, 2""",
)
def merge_gold_pred(spark, sf_dir):
    """Gold and predicted lines of each sentence side by side."""
    rows = tagged_sentences(spark, sf_dir).where(F.size("tokens") > 0)
    both = evaluate.align(
        rows.select("conv_id", "turn", "tokens", "gold"), rows.select("conv_id", "turn", "pred"), ["conv_id", "turn"]
    )
    line = F.transform(F.arrays_zip("tokens", "gold", "pred"), lambda z: F.concat_ws("\t", z["tokens"], z["gold"], z["pred"]))
    return both.select("conv_id", "turn", F.array_join(line, "\n").alias("merged"))


SQL_CHUNKS = f"""{SQL_TAGS},
padded AS (
  SELECT conv_id, turn, pos, gold, pred, 1 AS n FROM tags
  UNION ALL SELECT conv_id, turn, max(pos) + 1, 'O', 'O', 0 FROM tags GROUP BY 1, 2
),
parts AS (
  SELECT conv_id, turn, pos, n, split_part(gold, '-', 1) AS cg, split_part(pred, '-', 1) AS cp,
         CASE WHEN contains(gold, '-') THEN substr(gold, instr(gold, '-') + 1) ELSE '' END AS tg,
         CASE WHEN contains(pred, '-') THEN substr(pred, instr(pred, '-') + 1) ELSE '' END AS tp
  FROM padded
),
lagged AS (
  SELECT *, lag(cg, 1, 'O') OVER w AS pg, lag(cp, 1, 'O') OVER w AS pp, lag(tg, 1, '') OVER w AS ptg, lag(tp, 1, '') OVER w AS ptp
  FROM parts WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)
),
edges AS (
  SELECT *,
    pg || cg IN ('BB', 'IB', 'OB', 'OI') OR (cg <> 'O' AND ptg <> tg) AS sg,
    pp || cp IN ('BB', 'IB', 'OB', 'OI') OR (cp <> 'O' AND ptp <> tp) AS sp,
    pg || cg IN ('BB', 'BO', 'IB', 'IO') OR (pg <> 'O' AND ptg <> tg) AS eg,
    pp || cp IN ('BB', 'BO', 'IB', 'IO') OR (pp <> 'O' AND ptp <> tp) AS ep
  FROM lagged
),
events AS (
  SELECT *, eg AND ep AND ptg = ptp AS done,
    CASE WHEN sg AND sp AND tg = tp THEN 1 WHEN (eg AND ep AND ptg = ptp) OR eg <> ep OR tg <> tp THEN 0 END AS event
  FROM edges
),
states AS (
  SELECT *, done AND coalesce(last_value(event IGNORE NULLS) OVER (
    PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS correct
  FROM events
)"""

SQL_RATES = """
SELECT {keys} found, predicted, correct, {accuracy} round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f1
FROM (SELECT *, CASE WHEN predicted > 0 THEN 100.0::DOUBLE * correct / predicted ELSE 0 END AS p,
                CASE WHEN found > 0 THEN 100.0::DOUBLE * correct / found ELSE 0 END AS r FROM sums) AS rates"""


@query(
    "chunk_scores",
    f"""WITH {SQL_CHUNKS},
sums AS (SELECT sum(n)::BIGINT AS tokens, sum(n * (cg = cp AND tg = tp)::INT) AS ok, sum(sg::INT)::BIGINT AS found,
                sum(sp::INT)::BIGINT AS predicted, sum(correct::INT)::BIGINT AS correct FROM states)
{SQL_RATES.format(keys='tokens,', accuracy='round(100.0::DOUBLE * ok / tokens, 6) AS accuracy,')}""",
)
def chunk_scores(spark, sf_dir):
    counts = chunks.chunk_counts(tagged_sentences(spark, sf_dir))
    return _rounded(chunks.chunk_scores(counts), "accuracy", "precision", "recall", "f1")


@query(
    "chunk_scores_by_type",
    f"""WITH {SQL_CHUNKS},
rows3 AS (
  SELECT tg AS type, 1 AS g, 0 AS p, 0 AS c FROM states WHERE sg
  UNION ALL SELECT tp, 0, 1, 0 FROM states WHERE sp
  UNION ALL SELECT ptg, 0, 0, 1 FROM states WHERE correct
),
sums AS (SELECT type, sum(g)::BIGINT AS found, sum(p)::BIGINT AS predicted, sum(c)::BIGINT AS correct FROM rows3 GROUP BY 1)
{SQL_RATES.format(keys='type,', accuracy='')}""",
)
def chunk_scores_by_type(spark, sf_dir):
    counts = chunks.chunk_counts(tagged_sentences(spark, sf_dir))
    return _rounded(chunks.chunk_scores_by_type(counts), "precision", "recall", "f1")


@query(
    "batch_assignment",
    "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch FROM labels",
)
def batch_assignment(spark, sf_dir):
    return evaluate.with_batches(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 32)


def logit_rows(spark, sf_dir):
    """Ten logits per vector, each from every tenth dimension; label 9 stands for an ignored position."""
    rows = table(spark, sf_dir, "embeddings")
    logits = F.transform(fold(F.col("embedding"), 10), lambda x: x * 8)
    label = F.when(F.col("label") == 9, -1).otherwise(F.col("label"))
    return evaluate.head_metrics(rows.select("vec_id", logits.alias("logits"), label.alias("label")))


SQL_LOGITS = """
cells AS (
  SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS label, (i - 1) % 10 AS k, sum(embedding[i]::DOUBLE) * 8 AS z
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY 1, 2, 3
),
head AS (
  SELECT vec_id, any_value(label) AS label, (arg_min(k, (-z, k)))::INT AS pred, ln(sum(exp(z))) AS lse,
         max(CASE WHEN k = label THEN z END) AS picked, max(z) AS top FROM cells GROUP BY 1
),
metrics AS (
  SELECT vec_id, label, pred, (pred = label)::INT::DOUBLE AS correct, CASE WHEN label <> -1 THEN lse - picked END AS loss,
         exp(top - lse) AS confidence FROM head
)"""


@query(
    "head_metrics",
    f"WITH {SQL_LOGITS} SELECT vec_id, label, pred, correct, round(loss, 6) AS loss, round(confidence, 6) AS confidence FROM metrics",
)
def head_metrics(spark, sf_dir):
    confidence = F.round(F.array_max(softmax(F.col("logits"))), 6)
    return logit_rows(spark, sf_dir).select(
        "vec_id", "label", "pred", "correct", F.round("loss", 6).alias("loss"), confidence.alias("confidence")
    )


@query(
    "batch_mean_metrics",
    f"""WITH {SQL_LOGITS},
batched AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM metrics),
per_batch AS (SELECT batch, avg(loss) AS loss, avg(correct) AS accuracy FROM batched GROUP BY 1)
SELECT count(*)::BIGINT AS batches, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy FROM per_batch""",
)
def batch_mean_metrics(spark, sf_dir):
    scored = logit_rows(spark, sf_dir).select("vec_id", "loss", F.col("correct").alias("accuracy"))
    means = evaluate.batch_means(evaluate.with_batches(scored, "vec_id", 32))
    return _rounded(means, "loss", "accuracy")


@query(
    "tag_split",
    f"""WITH {SQL_TAGS}
SELECT split_part(gold, '-', 1) AS prefix, CASE WHEN contains(gold, '-') THEN substr(gold, instr(gold, '-') + 1) ELSE '' END AS type,
       count(*)::BIGINT AS n FROM tags GROUP BY 1, 2""",
)
def tag_split(spark, sf_dir):
    """Prefixes and types of all tags."""
    tags = tagged_sentences(spark, sf_dir).select(F.explode_outer("gold").alias("tag")).where("tag IS NOT NULL")
    return tags.groupBy(tag_prefix(F.col("tag")).alias("prefix"), tag_type(F.col("tag")).alias("type")).agg(F.count("*").alias("n"))
