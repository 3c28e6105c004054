"""Full-width scores and trained heads on one-hot features, where SQL knows the answer.

The Gram matrix of one-hot rows is diagonal, so its spectrum is the bucket counts at any width. A linear
head without a bias has the class shares of each bucket as its optimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.operators import heads, logme
from encoscope.plans import query, table
from encoscope.session import scratch_path

WIDTHS = (16, 24)


def one_hot(place, width: int):
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (k == place).cast("double"))


def bucket_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoders that tell the rest of a row's id by their width."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    parts = [
        rows.select(F.lit(f"hot-{w}").alias("encoder"), "vec_id", "label", one_hot(F.col("vec_id") % w, w).alias("features")) for w in WIDTHS
    ]
    return parts[0].unionByName(parts[1])


SQL_BUCKETS = f"""
rows_ AS (SELECT w, vec_id % w AS bucket, label, label::DOUBLE AS y FROM embeddings, unnest([{", ".join(map(str, WIDTHS))}]) AS r(w)),
sizes AS (SELECT w, bucket, count(*)::DOUBLE AS s FROM rows_ GROUP BY 1, 2),
spectrum AS (SELECT w, list(s ORDER BY bucket) AS sig, sum(s) AS n_rows FROM sizes GROUP BY 1),"""

SQL_CLASS_CELLS = """
grid AS (SELECT w, bucket, c FROM sizes, unnest(range(0, (SELECT max(label) + 1 FROM embeddings))) AS r(c)),
counts AS (SELECT w, bucket, label, count(*)::DOUBLE AS n FROM rows_ GROUP BY 1, 2, 3),
cells AS (
  SELECT g.w, g.c, sum(coalesce(n, 0)) AS weight, list(coalesce(n, 0.0::DOUBLE) ORDER BY g.bucket) AS p
  FROM grid g LEFT JOIN counts k ON k.w = g.w AND k.bucket = g.bucket AND k.label = g.c GROUP BY 1, 2
),"""

SQL_TARGET_CELLS = """
targets AS (SELECT w, bucket, 0 AS c, y FROM rows_ UNION ALL SELECT w, bucket, 1, abs(y - 4.5) FROM rows_),
per_bucket AS (SELECT w, c, bucket, sum(y) AS b, sum(y * y) AS q FROM targets GROUP BY 1, 2, 3),
cells AS (SELECT w, c, sum(q) AS weight, list(b ORDER BY bucket) AS p FROM per_bucket GROUP BY 1, 2),"""


def sql_walk(tolerance: str, slack: str) -> str:
    """The walk of alpha and beta over a whole spectrum, and the mean evidence."""
    over = lambda e: f"list_sum(list_transform(list_zip(sig, p), lambda z: {e}))"
    return f"""
loop AS (
  SELECT w, c, n_rows, weight, sig, p, 0 AS k, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS r2, false AS done
  FROM cells JOIN spectrum USING (w)
  UNION ALL
  SELECT w, c, n_rows, weight, sig, p, k + 1, a2, b2, m2, r2, abs(a2 / b2 / t - 1) <= {tolerance}
  FROM (
    SELECT *, g / (m2 + 1e-5) AS a2, (n_rows - g) / (r2 + 1e-5) AS b2
    FROM (
      SELECT w, c, n_rows, weight, sig, p, k, t, {over("z[1] / (z[1] + t)")} AS g, {over("z[2] * z[2] / ((z[1] + t) * (z[1] + t))")} AS m2,
             weight - {over("z[2] * z[2] / z[1]")} + {over("z[2] * z[2] / z[1] * (t / (z[1] + t)) * (t / (z[1] + t))")} AS r2
      FROM (SELECT *, alpha / beta AS t FROM loop WHERE k < 11 AND NOT done) AS ratio_step
    ) AS inner_step
  ) AS outer_step
),
newest AS (SELECT *, row_number() OVER (PARTITION BY w, c ORDER BY k DESC) AS newest FROM loop),
scores AS (
  SELECT w, avg((w / 2.0::DOUBLE * ln(alpha) + n_rows / 2 * ln(beta) - 0.5 * {over("ln(alpha + beta * z[1])")}
           - beta / 2 * (r2 + {slack}) - alpha / 2 * (m2 + {slack}) - n_rows / 2 * ln(2 * pi())) / n_rows) AS logme
  FROM newest WHERE newest = 1 GROUP BY 1
)"""


FIXED, EM = sql_walk("1e-3", "0"), sql_walk("1e-2", "1e-5")
SQL_LOGME = "SELECT 'hot-' || w AS encoder, round(logme, 6) AS logme FROM scores"


@query(
    "logme_onehot_leaderboard",
    f"""WITH RECURSIVE {SQL_BUCKETS} {SQL_CLASS_CELLS} {FIXED}
SELECT 'hot-' || w AS encoder, round(logme, 6) AS logme, (row_number() OVER (ORDER BY logme DESC))::INT AS rank FROM scores""",
)
def logme_onehot_leaderboard(spark, sf_dir):
    """Ranked pool of encoders of sixteen and twenty-four dimensions."""
    board = logme.leaderboard(logme.score_pool(bucket_encoders(spark, sf_dir)), "logme", "encoder")
    return board.select("encoder", F.round("logme", 6).alias("logme"), "rank")


@query("logme_onehot_em", f"WITH RECURSIVE {SQL_BUCKETS} {SQL_CLASS_CELLS} {EM} {SQL_LOGME}")
def logme_onehot_em(spark, sf_dir):
    scores = logme.score_pool(bucket_encoders(spark, sf_dir), variant="em")
    return scores.select("encoder", F.round("logme", 6).alias("logme"))


@query("logme_onehot_regression", f"WITH RECURSIVE {SQL_BUCKETS} {SQL_TARGET_CELLS} {FIXED} {SQL_LOGME}")
def logme_onehot_regression(spark, sf_dir):
    """Two regression targets at once."""
    targets = F.array(F.col("label").cast("double"), F.abs(F.col("label") - F.lit(4.5)))
    scores = logme.score_pool(bucket_encoders(spark, sf_dir).withColumn("targets", targets), label=None, targets="targets")
    return scores.select("encoder", F.round("logme", 6).alias("logme"))


SPREAD = 40_000_000

# Every class without rows walks alike, so one cell stands for all of them and counts as often as they are.
SQL_SPARSE_CELLS = f"""
counts AS (SELECT w, bucket, label * {SPREAD} AS c, count(*)::DOUBLE AS n FROM rows_ GROUP BY 1, 2, 3),
present AS (SELECT DISTINCT w, c FROM counts),
grid AS (SELECT s.w, s.bucket, p.c FROM sizes s JOIN present p USING (w) UNION ALL SELECT w, bucket, -1 FROM sizes),
cells AS (
  SELECT g.w, g.c, sum(coalesce(n, 0)) AS weight, list(coalesce(n, 0.0::DOUBLE) ORDER BY g.bucket) AS p
  FROM grid g LEFT JOIN counts k ON k.w = g.w AND k.bucket = g.bucket AND k.c = g.c GROUP BY 1, 2
),
shares AS (SELECT w, c, 1.0::DOUBLE AS share FROM present UNION ALL SELECT w, -1, (max(c) + 1 - count(*))::DOUBLE FROM present GROUP BY 1),"""


def sql_shared_walk(walk: str) -> str:
    """The walk with the mean over classes weighed by their shares."""
    return walk.replace("SELECT w, avg((", "SELECT w, sum(share * (").replace("/ n_rows) AS logme\n  FROM newest WHERE newest = 1", "/ n_rows) / sum(share) AS logme\n  FROM newest JOIN shares USING (w, c) WHERE newest = 1")


@query("logme_sparse_leaderboard", f"WITH RECURSIVE {SQL_BUCKETS} {SQL_SPARSE_CELLS} {sql_shared_walk(FIXED)} {SQL_LOGME}")
def logme_sparse_leaderboard(spark, sf_dir):
    """Scores with labels so far apart that nearly all of some hundred million classes have no rows."""
    rows = bucket_encoders(spark, sf_dir).withColumn("label", (F.col("label") * SPREAD).cast("int"))
    return logme.score_pool(rows).select("encoder", F.round("logme", 6).alias("logme"))


BUCKETS = 3


def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one of three one-hot vectors and their language."""
    bucket = F.col("doc_id") % BUCKETS
    return table(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket"), one_hot(bucket, BUCKETS).alias("features"), F.col("lang").alias("label"))


SQL_SHARES = f"""
shares AS (
  SELECT doc_id % {BUCKETS} AS bucket, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id % {BUCKETS}) AS total
  FROM documents GROUP BY 1, 2
),
best AS (SELECT bucket, arg_max(lang, n) AS prediction, max(n) AS hits, any_value(total) AS total FROM shares GROUP BY 1)"""

SQL_HEAD = f"""WITH {SQL_SHARES}
SELECT (SELECT sum(total) FROM best)::BIGINT AS n, round((SELECT sum(hits) / sum(total)::DOUBLE FROM best), 6) AS accuracy,
       round((SELECT -sum(n * ln(n / total::DOUBLE)) / sum(n) FROM shares), 3) AS loss"""


def _summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("loss"), 3).alias("loss"))


@query("linear_head_onehot", SQL_HEAD)
def linear_head_onehot(spark, sf_dir):
    """Accuracy and loss of a trained linear head."""
    rows = bucket_rows(spark, sf_dir)
    index = heads.class_index(rows, rows)
    return _summary(heads.score_rows(rows, heads.train_head(rows, index, "linear", epochs=100), index))


@query("linear_epochs_onehot", SQL_HEAD)
def linear_epochs_onehot(spark, sf_dir):
    """The same head found epoch by epoch, kept where its loss is least."""
    rows = bucket_rows(spark, sf_dir)
    index = heads.class_index(rows, rows)
    model, _ = heads.train_epochs(rows, rows, index, "linear", epochs=12)
    return _summary(heads.score_rows(rows, model, index))


@query(
    "mlp_epochs_onehot",
    f"""WITH {SQL_SHARES}
SELECT (SELECT sum(total) FROM best)::BIGINT AS n, round((SELECT sum(hits) / sum(total)::DOUBLE FROM best), 6) AS accuracy,
       round((SELECT -sum(n * ln(n / total::DOUBLE)) / sum(n) FROM shares), 2) AS loss""",
)
def mlp_epochs_onehot(spark, sf_dir):
    """Two hidden layers trained epoch by epoch on one-hot vectors that are spread over more dimensions."""
    wide = F.flatten(F.array_repeat(F.col("features"), 4))
    rows = bucket_rows(spark, sf_dir).withColumn("features", wide)
    index = heads.class_index(rows, rows)
    model, _ = heads.train_epochs(rows, rows, index, "mlp", epochs=40, patience=10)
    return _summary(heads.score_rows(rows, model, index)).withColumn("loss", F.round("loss", 2))


@query(
    "resumed_epochs_onehot",
    f"WITH {SQL_SHARES} SELECT lang AS label, prediction, count(*) AS n FROM documents JOIN best ON bucket = doc_id % {BUCKETS} GROUP BY 1, 2",
)
def resumed_epochs_onehot(spark, sf_dir):
    """A training stopped after five epochs that goes on from its written state; the saved net predicts."""
    rows = bucket_rows(spark, sf_dir)
    index = heads.class_index(rows, rows)
    path = scratch_path(spark, "training")
    heads.train_epochs(rows, rows, index, "linear", epochs=5, path=f"{path}/state")
    model, _ = heads.train_epochs(rows, rows, index, "linear", epochs=12, path=f"{path}/state")
    heads.save_head(model, path)
    scored = heads.score_rows(rows, heads.load_head("linear", path), index)
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))


SQL_PREDICTIONS = f"WITH {SQL_SHARES} SELECT doc_id, lang AS label, prediction FROM documents JOIN best ON bucket = doc_id % {BUCKETS}"


def _saved_predictions(spark, sf_dir, name):
    rows = bucket_rows(spark, sf_dir)
    index = heads.class_index(rows, rows)
    path = scratch_path(spark, name)
    heads.save_head(heads.train_head(rows, index, name, epochs=100), path)
    return heads.score_rows(rows, heads.load_head(name, path), index).select("doc_id", "label", "prediction")


@query("saved_linear_head", SQL_PREDICTIONS)
def saved_linear_head(spark, sf_dir):
    """Labels that a saved and loaded linear head predicts."""
    return _saved_predictions(spark, sf_dir, "linear")


@query("saved_mlp_head", SQL_PREDICTIONS)
def saved_mlp_head(spark, sf_dir):
    """Labels that a saved and loaded MLP predicts."""
    return _saved_predictions(spark, sf_dir, "mlp")
