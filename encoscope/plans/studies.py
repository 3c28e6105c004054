"""Ranking studies and experiment runs: weighted tau, summaries, wins, early stopping, heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.operators import heads, logme, ranking, runs, splits
from encoscope.operators.evaluate import batch_means
from encoscope.plans import query, table
from encoscope.plans.data import ENCODERS
from encoscope.session import scratch_path

# The seven line numbers of an order stand for the seven encoders of a pool.
POOL_SIZE = 7
# Added before rounding: means of amounts in cents may lie halfway between two rounded values.
TIE = 1e-9
# The same for taus kept at nine digits, whose means over a few participants are multiples of 1e-10 or so.
TAU_TIE = 3e-11


def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and transferability scores: return flag = setup, supplier = task, line number = model."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(
        F.col("l_returnflag").alias("setup"), F.col("l_suppkey").alias("task"), F.col("l_linenumber").alias("model")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("f1"), F.sum("l_quantity").alias("logme"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ship year is a participant who ranks the models of a task by ordered quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.year("l_shipdate").alias("participant"), F.col("l_suppkey").alias("task"), F.col("l_linenumber").alias("model")
    ).agg(F.sum("l_quantity").alias("q"))
    return ranking.position_scores(rows, ["participant", "task"], F.col("q"), "model").select(
        "participant", "task", "model", "score"
    )


SQL_STUDY = """
target AS (
  SELECT l_returnflag AS setup, l_suppkey AS task, l_linenumber AS model, round(sum(l_extendedprice), 2) AS f1, sum(l_quantity) AS logme
  FROM lineitem GROUP BY 1, 2, 3
),
votes AS (SELECT year(l_shipdate)::INT AS participant, l_suppkey AS task, l_linenumber AS model, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
survey AS (
  SELECT participant, task, model, count(*) OVER (PARTITION BY participant, task)
         - row_number() OVER (PARTITION BY participant, task ORDER BY q DESC, model) AS score FROM votes
)"""


def sql_tau(name: str, source: str, keys: str) -> str:
    """Pairwise form of the weighted tau over ``source(keys, model, x, y)``."""
    join = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    picked = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x DESC, y DESC) AS r1,
         row_number() OVER (PARTITION BY {keys} ORDER BY y DESC, x DESC) AS r2, count(*) OVER (PARTITION BY {keys}) AS n_models
  FROM {source}
),
{name}_sums AS (
  SELECT {picked}, any_value(a.n_models) AS n_models,
    sum(sign(a.x - b.x) * sign(a.y - b.y) * (1.0::DOUBLE / a.r1 + 1.0::DOUBLE / b.r1)) AS n1,
    sum(sign(a.x - b.x) * sign(a.y - b.y) * (1.0::DOUBLE / a.r2 + 1.0::DOUBLE / b.r2)) AS n2,
    sum(abs(sign(a.x - b.x)) * (1.0::DOUBLE / a.r1 + 1.0::DOUBLE / b.r1)) AS x1,
    sum(abs(sign(a.x - b.x)) * (1.0::DOUBLE / a.r2 + 1.0::DOUBLE / b.r2)) AS x2,
    sum(abs(sign(a.y - b.y)) * (1.0::DOUBLE / a.r1 + 1.0::DOUBLE / b.r1)) AS y1,
    sum(abs(sign(a.y - b.y)) * (1.0::DOUBLE / a.r2 + 1.0::DOUBLE / b.r2)) AS y2
  FROM {name}_ranked a JOIN {name}_ranked b ON {join} AND a.model < b.model GROUP BY ALL
),
{name} AS (
  SELECT {keys}, n_models, (n1 / nullif(sqrt(x1 * y1), 0) + n2 / nullif(sqrt(x2 * y2), 0)) / 2 AS tau FROM {name}_sums
)"""


SQL_HUMAN = f"""{SQL_STUDY},
human_rows AS (SELECT setup, t.task, participant, t.model, f1 AS x, score AS y FROM target t JOIN survey s ON s.task = t.task AND s.model = t.model),
{sql_tau('human', 'human_rows', 'setup, task, participant')}"""

SQL_LOGME = f"""
logme_rows AS (SELECT setup, task, model, f1 AS x, logme AS y FROM target),
{sql_tau('logme_tau', 'logme_rows', 'setup, task')}"""


@query(
    "target_leaderboard",
    f"""WITH {SQL_STUDY}
SELECT setup, task, model, f1, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY setup, task ORDER BY f1 DESC, model) AS rank FROM target) AS r WHERE rank <= 3""",
)
def target_leaderboard(spark, sf_dir):
    """Three best encoders of each task."""
    board = logme.leaderboard(target_scores(spark, sf_dir), "f1", "model", ["setup", "task"], top=3)
    return board.select("setup", "task", "model", "f1", "rank")


@query("survey_scores", f"WITH {SQL_STUDY} SELECT participant, task, model, score::BIGINT AS score FROM survey")
def survey_scores(spark, sf_dir):
    return survey(spark, sf_dir)


@query(
    "survey_duplicates",
    f"""WITH {SQL_STUDY},
picks AS (SELECT participant, task, model, CASE WHEN model = (task + participant) % 7 + 1 THEN 1 ELSE model END AS pick FROM survey)
SELECT participant, task, count(DISTINCT pick)::BIGINT AS n_distinct FROM picks GROUP BY 1, 2 HAVING count(DISTINCT pick) <> 7""",
)
def survey_duplicates(spark, sf_dir):
    """Survey blocks with a model named twice (one entry of each block is overwritten by model 1)."""
    hit = F.col("model") == F.pmod(F.col("task") + F.col("participant"), F.lit(7)) + 1
    picks = survey(spark, sf_dir).withColumn("model", F.when(hit, F.lit(1)).otherwise(F.col("model")))
    blocks = picks.groupBy("participant", "task").agg(F.array_sort(F.collect_list("model")).alias("ranking"))
    return ranking.duplicate_choices(blocks, POOL_SIZE).select(
        "participant", "task", F.size(F.array_distinct("ranking")).cast("long").alias("n_distinct")
    )


@query("weighted_tau", f"WITH {SQL_HUMAN} SELECT setup, task, participant, n_models::BIGINT AS n_models, round(tau, 6) + 0.0 AS tau FROM human")
def weighted_tau(spark, sf_dir):
    taus = ranking.human_taus(target_scores(spark, sf_dir), survey(spark, sf_dir))
    return taus.select("setup", "task", "participant", "n_models", F.round("tau", 6).alias("tau"))


@query(
    "weighted_tau_ties",
    f"""WITH big AS (
  SELECT p_brand AS task, p_size AS model, round(sum(l_extendedprice) / 10000, 0) AS x, count(*) AS y
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
{sql_tau('tau_table', 'big', 'task')}
SELECT task, n_models::BIGINT AS n_models, round(tau, 6) + 0.0 AS tau FROM tau_table""",
)
def weighted_tau_ties(spark, sf_dir):
    """Longer rankings with many ties: brand = task, part size = model."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice").join(parts, "l_partkey")
    scores = rows.groupBy(F.col("p_brand").alias("task"), F.col("p_size").alias("model")).agg(
        F.round(F.sum("l_extendedprice") / 10000, 0).alias("x"), F.count("*").alias("y")
    )
    return ranking.weighted_tau(scores, ["task"], "x", "y").select("task", "n_models", F.round("tau", 6).alias("tau"))


@query(
    "tau_summary",
    f"""WITH {SQL_HUMAN}, exact AS (SELECT setup, task, round(tau, 9) + 0.0 AS tau FROM human)
SELECT CASE WHEN grouping(setup) = 1 THEN 'overall' WHEN grouping(task) = 1 THEN 'setup' ELSE 'task' END AS level, setup, task,
       round(atanh(avg(tanh(tau))), 6) + 0.0 AS mean, round(avg(tau) + 3e-11, 6) + 0.0 AS plain_mean,
       round(min(tau) + 3e-11, 6) + 0.0 AS lowest, round(max(tau) + 3e-11, 6) + 0.0 AS highest, count_if(tau <= 0)::BIGINT AS n_nonpositive, count_if(tau > 0.5)::BIGINT AS n_above_half,
       count_if(tau > 0)::BIGINT AS n_positive
FROM exact GROUP BY GROUPING SETS ((setup, task), (setup), ())""",
)
def tau_summary(spark, sf_dir):
    taus = ranking.human_taus(target_scores(spark, sf_dir), survey(spark, sf_dir))
    # sums that cancel to 0 or 0.5 come out a rounding error off, and the sign counts look at those
    summary = ranking.tau_summary(taus.withColumn("tau", F.round("tau", 9)))
    rounded = {n: F.round(F.col(n) + TAU_TIE, 6) for n in ("plain_mean", "lowest", "highest")}
    rounded["mean"] = F.round("mean", 6)
    return summary.withColumns(rounded).select(
        "level", "setup", "task", *rounded, "n_nonpositive", "n_above_half", "n_positive"
    )


@query(
    "majority_tau",
    f"""WITH {SQL_STUDY},
summed AS (SELECT task, model, sum(score) AS score FROM survey GROUP BY 1, 2),
major_rows AS (SELECT setup, t.task, t.model, f1 AS x, score::DOUBLE AS y FROM target t JOIN summed s ON s.task = t.task AND s.model = t.model),
{sql_tau('majority', 'major_rows', 'setup, task')}
SELECT setup, task, round(tau, 6) + 0.0 AS tau FROM majority""",
)
def majority_tau(spark, sf_dir):
    taus = ranking.majority_taus(target_scores(spark, sf_dir), survey(spark, sf_dir))
    return taus.select("setup", "task", F.round("tau", 6).alias("tau"))


@query(
    "win_rate",
    f"""WITH {SQL_HUMAN}, {SQL_LOGME}
SELECT count(*)::BIGINT AS comparisons, count_if(round(h.tau, 9) > round(l.tau, 9))::BIGINT AS human_wins,
       count_if(round(h.tau, 9) < round(l.tau, 9))::BIGINT AS logme_wins,
       round(100.0::DOUBLE * count_if(round(h.tau, 9) > round(l.tau, 9)) / count(*), 6) AS human_win_pct
FROM human h JOIN logme_tau l ON l.setup = h.setup AND l.task = h.task""",
)
def win_rate(spark, sf_dir):
    target = target_scores(spark, sf_dir)
    nine = F.round("tau", 9).alias("tau")
    humans = ranking.human_taus(target, survey(spark, sf_dir)).select("setup", "task", nine)
    scores = ranking.logme_taus(target).select("setup", "task", nine)
    return ranking.win_rate(humans, scores).withColumn("human_win_pct", F.round("human_win_pct", 6))


def loss_log(spark, sf_dir):
    """Event type = run, day = epoch, mean value = dev loss."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value") + TIE, 6).alias("loss")
    )


@query(
    "epoch_metrics",
    """WITH batched AS (
  SELECT event_type AS run, day(ts)::INT AS epoch, hour(ts)::INT AS batch, avg(value) AS loss FROM events GROUP BY 1, 2, 3)
SELECT run, epoch, count(*)::BIGINT AS batches, round(avg(loss) + 1e-9, 6) AS loss FROM batched GROUP BY 1, 2""",
)
def epoch_metrics(spark, sf_dir):
    """Mean of hourly batch means, per run and epoch."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"), F.hour("ts").alias("batch"), F.col("value").alias("loss")
    )
    return batch_means(events, ["run", "epoch"], ["loss"]).withColumn("loss", F.round(F.col("loss") + TIE, 6))


@query(
    "early_stop",
    """WITH RECURSIVE log AS (SELECT event_type AS run, day(ts)::INT AS epoch, round(avg(value) + 1e-9, 6) AS loss FROM events GROUP BY 1, 2),
walk AS (
  SELECT run, epoch, loss AS low, epoch AS low_epoch, epoch AS kept, 1 AS saves, false AS stop
  FROM log l WHERE epoch = (SELECT min(epoch) FROM log m WHERE m.run = l.run)
  UNION ALL
  SELECT w.run, l.epoch, least(w.low, l.loss), CASE WHEN l.loss < w.low THEN l.epoch ELSE w.low_epoch END,
         CASE WHEN l.loss <= w.low THEN l.epoch ELSE w.kept END, w.saves + (l.loss <= w.low)::INT,
         l.epoch - CASE WHEN l.loss < w.low THEN l.epoch ELSE w.low_epoch END >= 3
  FROM walk w JOIN log l ON l.run = w.run AND l.epoch = w.epoch + 1 WHERE NOT w.stop
),
final AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS newest FROM walk)
SELECT run, epoch AS stop_epoch, kept AS kept_epoch, low_epoch AS best_epoch, low AS best_loss, saves::BIGINT AS n_saves, stop AS stopped_early
FROM final WHERE newest = 1""",
)
def early_stop(spark, sf_dir):
    return runs.early_stop(loss_log(spark, sf_dir), 3)


SQL_GRID = f"""
grid AS (
  SELECT task, kind || ':' || name AS encoder, pooling, 'mlp' AS head, seed
  FROM (SELECT DISTINCT source AS task FROM documents) AS t, (VALUES {", ".join(f"('{e}')" for e in ENCODERS)}) AS n(name),
       (VALUES ('transformer+cls', 'first'), ('transformer', 'mean')) AS p(kind, pooling),
       (VALUES {", ".join(f"({s})" for s in runs.SEEDS)}) AS s(seed)
)"""


def run_grid(spark, sf_dir):
    tasks = table(spark, sf_dir, "documents").select(F.col("source").alias("task")).distinct()
    return runs.grid(tasks, ENCODERS)


@query("experiment_grid", f"WITH {SQL_GRID} SELECT task, encoder, pooling, head, seed::INT AS seed FROM grid")
def experiment_grid(spark, sf_dir):
    return run_grid(spark, sf_dir)


@query(
    "pending_runs",
    f"""WITH {SQL_GRID},
finished AS (SELECT source AS task, list_extract([{", ".join(str(s) for s in runs.SEEDS)}], (doc_id % 5 + 1)::INT) AS seed, length(text) % 2 AS odd FROM documents)
SELECT task, encoder, pooling, head, seed::INT AS seed FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM finished f WHERE f.task = g.task AND f.seed = g.seed AND f.odd = (g.pooling = 'mean')::INT AND g.encoder LIKE '%roberta%')""",
)
def pending_runs(spark, sf_dir):
    """Grid without the runs that a registry (made from the documents) holds."""
    docs = table(spark, sf_dir, "documents")
    seeds = F.array(*[F.lit(s) for s in runs.SEEDS])
    done = docs.select(
        F.col("source").alias("task"),
        F.get(seeds, F.pmod("doc_id", F.lit(5)).cast("int")).alias("seed"),
        F.when(F.length("text") % 2 == 1, "mean").otherwise("first").alias("pooling"),
        F.lit("mlp").alias("head"),
    ).distinct()
    names = F.array(*[F.lit(e) for e in ENCODERS if "roberta" in e])
    kind = F.when(F.col("pooling") == "mean", runs.POOLING_KINDS["mean"]).otherwise(runs.POOLING_KINDS["first"])
    registry = done.withColumn("_name", F.explode(names)).withColumn("encoder", F.concat(kind, F.lit(":"), "_name"))
    return runs.pending(run_grid(spark, sf_dir), registry)


@query(
    "seed_summary",
    """WITH log AS (SELECT event_type AS run, user_id % 5 AS seed, avg(value) AS value FROM events GROUP BY 1, 2)
SELECT run, count(*)::BIGINT AS n_seeds, round(avg(value) + 1e-9, 6) AS mean, round(stddev_samp(value), 6) AS stddev FROM log GROUP BY 1""",
)
def seed_summary(spark, sf_dir):
    per_seed = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run"), F.pmod("user_id", F.lit(5)).alias("seed")
    ).agg(F.avg("value").alias("value"))
    return runs.over_seeds(per_seed, ["run"]).withColumns({"mean": F.round(F.col("mean") + TIE, 6), "stddev": F.round("stddev", 6)})


@query(
    "grid_runs",
    """WITH cells AS (SELECT event_type AS task, (user_id % 5)::INT AS seed, avg(value) AS value FROM events GROUP BY 1, 2)
SELECT task, seed, CASE WHEN seed < 4 THEN round(value, 6) END AS value, CASE WHEN seed = 4 THEN 'ValueError: no seed 4' END AS error,
       seed = 4 AS pending FROM cells""",
)
def grid_runs(spark, sf_dir):
    """A grid carried out four runs at a time, a job each; failed runs are rows and stay pending."""
    events = table(spark, sf_dir, "events")
    tasks = events.select(F.col("event_type").alias("task")).distinct()
    grid = runs.grid(tasks, ["static"], ["mean"], ["linear"], range(5))

    def execute(row):
        if row["seed"] == 4:
            raise ValueError("no seed 4")
        part = events.where((F.col("event_type") == row["task"]) & (F.pmod("user_id", F.lit(5)) == row["seed"]))
        return part.agg(F.avg("value")).first()[0]

    registry = scratch_path(spark, "runs")
    done = runs.run_all(grid, execute, registry, at_once=4, retries=1)
    left = runs.pending(grid, spark.read.parquet(registry)).select("task", "seed", F.lit(True).alias("pending"))
    joined = done.join(left, ["task", "seed"], "left")
    return joined.select("task", "seed", F.round("value", 6).alias("value"), "error", F.coalesce("pending", F.lit(False)).alias("pending"))


def head_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("features"), F.concat(F.lit("class-"), F.col("label").cast("string")).alias("label")
    )
    parts = splits.seeded_split(rows, "vec_id", 4012)
    return parts.where("split = 'train'"), parts.where("split = 'dev'")


def _head_accuracy(spark, sf_dir, name, epochs):
    train, dev = head_parts(spark, sf_dir)
    index = heads.class_index(train, dev)
    model = heads.train_head(train, index, name, epochs=epochs)
    scored = heads.score_rows(train, model, index).unionByName(heads.score_rows(dev, model, index))
    return scored.groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg("correct"), 4).alias("accuracy"), F.round(F.avg("loss"), 4).alias("loss")
    )


@query("linear_head_accuracy")
def linear_head_accuracy(spark, sf_dir):
    return _head_accuracy(spark, sf_dir, "linear", 20)


@query("mlp_head_accuracy")
def mlp_head_accuracy(spark, sf_dir):
    return _head_accuracy(spark, sf_dir, "mlp", 20)


@query("head_predictions")
def head_predictions(spark, sf_dir):
    """Predicted label names of the dev part."""
    train, dev = head_parts(spark, sf_dir)
    index = heads.class_index(train, dev)
    model = heads.train_head(train, index, "linear", epochs=20)
    return heads.score_rows(dev, model, index).select("vec_id", "label", "prediction", "correct")
