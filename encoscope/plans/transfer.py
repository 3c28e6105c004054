"""Transferability queries: Gram statistics, LogME variants, PCA, LEEP."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encoscope.functions.vectors import as_vector
from encoscope.operators import logme, stats, wide
from encoscope.plans import query, table


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("features"), "label"
    )


def encoder_slices(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """Each run of ``width`` dimensions stands for one encoder of a pool."""
    rows = embedding_rows(spark, sf_dir)
    count = F.floor(F.size("features") / width).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    return rows.select(
        "vec_id", "label", "features", F.explode(starts).alias("_e")
    ).select(
        F.concat(F.lit("enc-"), F.lpad(F.col("_e").cast("string"), 2, "0")).alias("encoder"),
        "vec_id",
        "label",
        F.slice("features", F.col("_e") * width + 1, width).alias("features"),
    )


LONG_FORM = """
long AS (
  SELECT vec_id, label, i - 1 AS dim, embedding[i]::DOUBLE AS f
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)
)"""


@query(
    "gram_matrix",
    f"""WITH {LONG_FORM}
SELECT a.dim::BIGINT AS i, b.dim::BIGINT AS j, round(sum(a.f * b.f), 6) + 0.0 AS g
FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2""",
)
def gram_matrix(spark, sf_dir):
    summed = stats.sufficient_stats(embedding_rows(spark, sf_dir), label=None, keys=())
    return stats.gram_cells(summed, ()).select("i", "j", F.round("g", 6).alias("g"))


@query(
    "gram_tiles",
    f"""WITH {LONG_FORM}
SELECT a.dim::BIGINT AS i, b.dim::BIGINT AS j, round(sum(a.f * b.f), 6) + 0.0 AS g
FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2""",
)
def gram_tiles(spark, sf_dir):
    """The Gram matrix put together from tiles of 24 columns, the last one narrower."""
    tiles = wide.gram_tiles(embedding_rows(spark, sf_dir), keys=(), tile=24)
    return wide.tile_cells(tiles, ()).select("i", "j", F.round("g", 6).alias("g"))


@query(
    "class_sums",
    f"""WITH {LONG_FORM}
SELECT label, dim::BIGINT AS dim, count(*)::BIGINT AS n, round(sum(f), 6) + 0.0 AS s FROM long GROUP BY 1, 2""",
)
def class_sums(spark, sf_dir):
    sums = stats.class_sums(embedding_rows(spark, sf_dir), "features", "label")
    return sums.select("label", F.posexplode("vec").alias("dim", "s"), "n").select(
        "label", F.col("dim").cast("long").alias("dim"), "n", F.round("s", 6).alias("s")
    )


@query(
    "pca_covariance",
    f"""WITH {LONG_FORM}
SELECT a.dim::BIGINT AS i, b.dim::BIGINT AS j, round(covar_samp(a.f, b.f), 8) + 0.0 AS cov
FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2""",
)
def pca_covariance(spark, sf_dir):
    summed = stats.sufficient_stats(embedding_rows(spark, sf_dir), label=None, keys=())
    return stats.covariance_cells(summed, ()).select("i", "j", F.round("cov", 8).alias("cov"))


def univariate_inputs(spark, sf_dir) -> DataFrame:
    """Per dimension and class: feature sum and count, with the dimension's sum of squares."""
    rows = embedding_rows(spark, sf_dir)
    per_class = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(as_vector(F.col("features")))).alias("s"),
        vector_to_array(Summarizer.normL2(as_vector(F.col("features")))).alias("l2"),
    )
    cells = per_class.select("label", "n", F.posexplode(F.arrays_zip("s", "l2")).alias("dim", "cell"))
    # one row per dimension with its few classes; every class 0..max counts, also those without rows
    dims = cells.groupBy(F.col("dim").cast("long").alias("dim")).agg(
        F.sum(F.col("cell.l2") * F.col("cell.l2")).alias("sigma"),
        F.sum("n").cast("double").alias("n_rows"),
        F.max("label").alias("top"),
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("n", F.col("cell.s").alias("b"))))).alias("classes"),
    )
    found = F.try_element_at("classes", F.col("label"))
    return dims.withColumn("label", F.explode(F.sequence(F.lit(0), F.col("top")))).select(
        "dim",
        "label",
        "sigma",
        "n_rows",
        F.coalesce(found["n"].cast("double"), F.lit(0.0)).alias("weight"),
        F.coalesce(found["b"], F.lit(0.0)).alias("product"),
    )


def _univariate(spark, sf_dir, variant):
    cells = univariate_inputs(spark, sf_dir).withColumn(
        "evidence",
        logme.univariate_evidence(
            F.col("sigma"), F.col("weight"), F.col("product"), F.col("n_rows"), variant
        ),
    )
    return cells.groupBy("dim").agg(F.round(F.avg("evidence"), 6).alias("score"))


UNIVARIATE_INPUT = f"""{LONG_FORM},
sizes AS (SELECT dim, sum(f * f) AS sigma, count(*)::DOUBLE AS n_rows, max(label) AS top FROM long GROUP BY 1),
grid AS (SELECT dim, sigma, n_rows, c FROM sizes, unnest(range(0, top + 1)) AS r(c)),
sums AS (SELECT dim, label, count(*)::DOUBLE AS n, sum(f) AS b FROM long GROUP BY 1, 2),
cells AS (
  SELECT g.dim, g.c, g.sigma, g.n_rows, coalesce(s.n, 0) AS weight, coalesce(s.b, 0) AS product
  FROM grid g LEFT JOIN sums s ON s.dim = g.dim AND s.label = g.c
)"""

FIXED_POINT_LOOP = """
loop AS (
  SELECT dim, c, sigma, n_rows, weight, CASE WHEN sigma > 0 THEN product * product / sigma ELSE 0 END AS x2,
         0 AS k, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS r2, false AS done
  FROM cells
  UNION ALL
  SELECT dim, c, sigma, n_rows, weight, x2, k + 1, a2, b2, m2, r2, abs(a2 / b2 - t) / t <= 1e-3
  FROM (
    SELECT *, (sigma / (sigma + t)) / (m2 + 1e-5) AS a2, (n_rows - sigma / (sigma + t)) / (r2 + 1e-5) AS b2
    FROM (
      SELECT dim, c, sigma, n_rows, weight, x2, k, alpha / beta AS t,
             sigma * x2 / ((alpha / beta + sigma) * (alpha / beta + sigma)) AS m2,
             x2 / ((1 + sigma / (alpha / beta)) * (1 + sigma / (alpha / beta))) + (weight - x2) AS r2
      FROM loop WHERE k < 11 AND NOT done
    ) AS inner_step
  ) AS outer_step
),
last AS (SELECT *, row_number() OVER (PARTITION BY dim, c ORDER BY k DESC) AS newest FROM loop)
SELECT dim::BIGINT AS dim, round(avg((0.5 * ln(alpha) + n_rows / 2 * ln(beta) - 0.5 * ln(alpha + beta * sigma)
  - beta / 2 * r2 - alpha / 2 * m2 - n_rows / 2 * ln(2 * pi())) / n_rows), 6) AS score
FROM last WHERE newest = 1 GROUP BY 1"""

EM_LOOP = """
loop AS (
  SELECT dim, c, sigma, n_rows, weight, product, 0 AS k, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta,
         1.0::DOUBLE AS lam, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS r2, false AS done
  FROM cells
  UNION ALL
  SELECT dim, c, sigma, n_rows, weight, product, k + 1, a2, b2, a2 / b2, m2, r2, abs(a2 / b2 - lam) / lam < 0.01
  FROM (
    SELECT *, (sigma / (sigma + lam)) / (m2 + 1e-5) AS a2, (n_rows - sigma / (sigma + lam)) / (r2 + 1e-5) AS b2
    FROM (
      SELECT dim, c, sigma, n_rows, weight, product, k, lam, m * m AS m2,
             weight - 2 * m * product + m * m * sigma AS r2
      FROM (SELECT *, product * beta / (alpha + beta * sigma) AS m FROM loop WHERE k < 11 AND NOT done) AS mean_step
    ) AS inner_step
  ) AS outer_step
),
last AS (SELECT *, row_number() OVER (PARTITION BY dim, c ORDER BY k DESC) AS newest FROM loop)
SELECT dim::BIGINT AS dim, round(avg((0.5 * ln(alpha) + n_rows / 2 * ln(beta) - 0.5 * ln(alpha + beta * sigma)
  - beta / 2 * (r2 + 1e-5) - alpha / 2 * (m2 + 1e-5) - n_rows / 2 * ln(2 * pi())) / n_rows), 6) AS score
FROM last WHERE newest = 1 GROUP BY 1"""


@query("logme_univariate", f"WITH RECURSIVE {UNIVARIATE_INPUT}, {FIXED_POINT_LOOP}")
def logme_univariate(spark, sf_dir):
    return _univariate(spark, sf_dir, "fixed_point")


@query("logme_em_univariate", f"WITH RECURSIVE {UNIVARIATE_INPUT}, {EM_LOOP}")
def logme_em_univariate(spark, sf_dir):
    return _univariate(spark, sf_dir, "em")


# Regression targets of one row: its label, and its label's distance from the middle.
REGRESSION_INPUT = f"""{LONG_FORM},
targets AS (
  SELECT vec_id, dim, f, 0 AS c, label::DOUBLE AS y FROM long
  UNION ALL SELECT vec_id, dim, f, 1 AS c, abs(label - 4.5)::DOUBLE AS y FROM long
),
cells AS (
  SELECT dim, c, sum(f * f) AS sigma, count(*)::DOUBLE AS n_rows, sum(y * y) AS weight, sum(f * y) AS product
  FROM targets GROUP BY 1, 2
)"""


@query("logme_regression_univariate", f"WITH RECURSIVE {REGRESSION_INPUT}, {FIXED_POINT_LOOP}")
def logme_regression_univariate(spark, sf_dir):
    """Each dimension as a one-dimensional encoder through the general regression path."""
    pool = encoder_slices(spark, sf_dir, 1).withColumn(
        "targets", F.array(F.col("label").cast("double"), F.abs(F.col("label") - F.lit(4.5)))
    )
    scores = logme.score_pool(pool, label=None, targets="targets")
    return scores.select(
        F.substring_index("encoder", "-", -1).cast("long").alias("dim"), F.round("logme", 6).alias("score")
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboard of a pool of four encoders of sixteen dimensions."""
    scores = logme.score_pool(encoder_slices(spark, sf_dir, 16))
    return logme.leaderboard(scores, "logme", "encoder").select(
        "encoder", F.round("logme", 6).alias("logme"), "rank"
    )


@query("logme_pool_leaderboard")
def logme_pool_leaderboard(spark, sf_dir):
    return flagship(spark, sf_dir)


# Two-dimensional encoders have a closed-form eigensystem, so SQL can follow the whole matrix path.
PLANE_ROWS = """
rows2 AS (
  SELECT vec_id, label, e, embedding[2 * e + 1]::DOUBLE AS f1, embedding[2 * e + 2]::DOUBLE AS f2
  FROM embeddings, unnest(range(0, len(embedding) // 2)) AS r(e)
)"""

PLANE_CELLS = """
grams AS (
  SELECT e, sum(f1 * f1) AS a, sum(f1 * f2) AS b, sum(f2 * f2) AS d, count(*)::DOUBLE AS n_rows, max(label) AS top
  FROM rows2 GROUP BY 1
),
angles AS (
  SELECT *, 0.5 * atan2(2 * b, a - d) AS th, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS rad, (a + d) / 2 AS mid
  FROM grams
),
grid AS (SELECT e, n_rows, mid + rad AS s1, mid - rad AS s2, cos(th) AS co, sin(th) AS si, c
         FROM angles, unnest(range(0, top + 1)) AS r(c)),
sums AS (SELECT e, label, count(*)::DOUBLE AS n, sum(f1) AS b1, sum(f2) AS b2 FROM rows2 GROUP BY 1, 2),
cells AS (
  SELECT g.e, g.c, g.n_rows, g.s1, g.s2, g.co, g.si, coalesce(s.n, 0) AS weight,
         coalesce(co * b1 + si * b2, 0) AS p1, coalesce(co * b2 - si * b1, 0) AS p2
  FROM grid g LEFT JOIN sums s ON s.e = g.e AND s.label = g.c
)"""

PLANE_INPUT = f"{PLANE_ROWS}, {PLANE_CELLS}"

PLANE_FIXED_POINT = """
loop AS (
  SELECT e, c, n_rows, s1, s2, co, si, p1, p2, weight, p1 * p1 / s1 AS x1, p2 * p2 / s2 AS x2, 0 AS k,
         1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta, 1.0::DOUBLE AS t, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS r2, false AS done
  FROM cells
  UNION ALL
  SELECT e, c, n_rows, s1, s2, co, si, p1, p2, weight, x1, x2, k + 1, a2, b2, t, m2, r2, abs(a2 / b2 - t) / t <= 1e-3
  FROM (
    SELECT *, g / (m2 + 1e-5) AS a2, (n_rows - g) / (r2 + 1e-5) AS b2
    FROM (
      SELECT e, c, n_rows, s1, s2, co, si, p1, p2, weight, x1, x2, k, t, s1 / (s1 + t) + s2 / (s2 + t) AS g,
             s1 * x1 / ((t + s1) * (t + s1)) + s2 * x2 / ((t + s2) * (t + s2)) AS m2,
             x1 / ((1 + s1 / t) * (1 + s1 / t)) + x2 / ((1 + s2 / t) * (1 + s2 / t)) + (weight - x1 - x2) AS r2
      FROM (SELECT * EXCLUDE (t), alpha / beta AS t FROM loop WHERE k < 11 AND NOT done) AS ratio_step
    ) AS inner_step
  ) AS outer_step
),
newest AS (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY k DESC) AS newest FROM loop),
model AS (
  SELECT e, c, k AS steps, alpha, beta,
         (ln(alpha) + n_rows / 2 * ln(beta) - 0.5 * ln(alpha + beta * s1) - 0.5 * ln(alpha + beta * s2)
          - beta / 2 * r2 - alpha / 2 * m2 - n_rows / 2 * ln(2 * pi())) / n_rows AS evidence,
         co * p1 / (t + s1) - si * p2 / (t + s2) AS m_first, si * p1 / (t + s1) + co * p2 / (t + s2) AS m_second
  FROM newest WHERE newest = 1
)"""

PLANE_EM = """
loop AS (
  SELECT e, c, n_rows, s1, s2, p1, p2, weight, 0 AS k, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta,
         1.0::DOUBLE AS lam, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS r2, false AS done
  FROM cells
  UNION ALL
  SELECT e, c, n_rows, s1, s2, p1, p2, weight, k + 1, a2, b2, a2 / b2, m2, r2, abs(a2 / b2 - lam) / lam < 0.01
  FROM (
    SELECT *, g / (m2 + 1e-5) AS a2, (n_rows - g) / (r2 + 1e-5) AS b2
    FROM (
      SELECT e, c, n_rows, s1, s2, p1, p2, weight, k, lam, s1 / (s1 + lam) + s2 / (s2 + lam) AS g, q1 * q1 + q2 * q2 AS m2,
             weight - 2 * (q1 * p1 + q2 * p2) + q1 * q1 * s1 + q2 * q2 * s2 AS r2
      FROM (SELECT *, p1 * beta / (alpha + beta * s1) AS q1, p2 * beta / (alpha + beta * s2) AS q2
            FROM loop WHERE k < 11 AND NOT done) AS mean_step
    ) AS inner_step
  ) AS outer_step
),
newest AS (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY k DESC) AS newest FROM loop),
model AS (
  SELECT e, c, (ln(alpha) + n_rows / 2 * ln(beta) - 0.5 * ln(alpha + beta * s1) - 0.5 * ln(alpha + beta * s2)
          - beta / 2 * (r2 + 1e-5) - alpha / 2 * (m2 + 1e-5) - n_rows / 2 * ln(2 * pi())) / n_rows AS evidence
  FROM newest WHERE newest = 1
)"""

PLANE_SCORES = """
SELECT 'enc-' || lpad(e::VARCHAR, 2, '0') AS encoder, round(avg(evidence), 6) AS logme FROM model GROUP BY 1"""


@query(
    "logme_pool_models",
    f"""WITH RECURSIVE {PLANE_INPUT}, {PLANE_FIXED_POINT}
SELECT 'enc-' || lpad(e::VARCHAR, 2, '0') AS encoder, c::INT AS class, steps::INT AS steps, round(alpha, 4) AS alpha,
       round(beta, 4) AS beta, round(evidence, 6) AS evidence, round(m_first, 6) + 0.0 AS m_first,
       round(m_second, 6) + 0.0 AS m_second FROM model""",
)
def logme_pool_models(spark, sf_dir):
    """Fitted class models of 32 two-dimensional encoders."""
    models = logme.fit_pool(encoder_slices(spark, sf_dir, 2))
    return models.select(
        "encoder",
        "class",
        "steps",
        F.round("alpha", 4).alias("alpha"),
        F.round("beta", 4).alias("beta"),
        F.round("evidence", 6).alias("evidence"),
        F.round(F.get("m", F.lit(0)), 6).alias("m_first"),
        F.round(F.get("m", F.lit(1)), 6).alias("m_second"),
    )


@query("logme_pool_scores", f"WITH RECURSIVE {PLANE_INPUT}, {PLANE_FIXED_POINT} {PLANE_SCORES}")
def logme_pool_scores(spark, sf_dir):
    scores = logme.score_pool(encoder_slices(spark, sf_dir, 2))
    return scores.select("encoder", F.round("logme", 6).alias("logme"))


@query("logme_em_pool_scores", f"WITH RECURSIVE {PLANE_INPUT}, {PLANE_EM} {PLANE_SCORES}")
def logme_em_pool_scores(spark, sf_dir):
    scores = logme.score_pool(encoder_slices(spark, sf_dir, 2), variant="em")
    return scores.select("encoder", F.round("logme", 6).alias("logme"))


@query(
    "logme_predict",
    f"""WITH RECURSIVE {PLANE_INPUT}, {PLANE_FIXED_POINT},
logits AS (SELECT r.e, r.vec_id, r.label, m.c, f1 * m_first + f2 * m_second AS z FROM rows2 r JOIN model m ON m.e = r.e),
picked AS (SELECT e, vec_id, label, c, row_number() OVER (PARTITION BY e, vec_id ORDER BY z DESC, c) AS place FROM logits)
SELECT 'enc-' || lpad(e::VARCHAR, 2, '0') AS encoder, vec_id, label, c::INT AS prediction FROM picked WHERE place = 1""",
)
def logme_predict(spark, sf_dir):
    pool = encoder_slices(spark, sf_dir, 2)
    return logme.predict(pool, logme.fit_pool(pool)).select("encoder", "vec_id", "label", "prediction")


@query("pca_logme")
def pca_logme(spark, sf_dir):
    """LogME after PCA to eight components, for the pool of sixteen-dimensional encoders."""
    scores = logme.score_pool(encoder_slices(spark, sf_dir, 16), components=8)
    return scores.select("encoder", F.round("logme", 6).alias("logme"))


@query(
    "pca_logme_plane",
    f"""WITH RECURSIVE {PLANE_ROWS},
moments AS (
  SELECT e, avg(f1) AS u1, avg(f2) AS u2, covar_pop(f1, f1) AS a, covar_pop(f1, f2) AS b, covar_pop(f2, f2) AS d FROM rows2 GROUP BY 1
),
turned AS (
  SELECT r.e AS dim, label, (f1 - u1) * cos(0.5 * atan2(2 * b, a - d)) + (f2 - u2) * sin(0.5 * atan2(2 * b, a - d)) AS f
  FROM rows2 r JOIN moments m ON m.e = r.e
),
sizes AS (SELECT dim, sum(f * f) AS sigma, count(*)::DOUBLE AS n_rows, max(label) AS top FROM turned GROUP BY 1),
grid AS (SELECT dim, sigma, n_rows, c FROM sizes, unnest(range(0, top + 1)) AS r(c)),
sums AS (SELECT dim, label, count(*)::DOUBLE AS n, sum(f) AS b FROM turned GROUP BY 1, 2),
cells AS (
  SELECT g.dim, g.c, g.sigma, g.n_rows, coalesce(s.n, 0) AS weight, coalesce(s.b, 0) AS product
  FROM grid g LEFT JOIN sums s ON s.dim = g.dim AND s.label = g.c
), {FIXED_POINT_LOOP}""",
)
def pca_logme_plane(spark, sf_dir):
    """Two-dimensional encoders reduced to their first component, then scored."""
    scores = logme.score_pool(encoder_slices(spark, sf_dir, 2), components=1)
    return scores.select(
        F.substring_index("encoder", "-", -1).cast("long").alias("dim"), F.round("logme", 6).alias("score")
    )


@query(
    "pca_project",
    f"""WITH {PLANE_ROWS},
moments AS (
  SELECT e, avg(f1) AS u1, avg(f2) AS u2, covar_pop(f1, f1) AS a, covar_pop(f1, f2) AS b, covar_pop(f2, f2) AS d FROM rows2 GROUP BY 1
)
SELECT 'enc-' || lpad(r.e::VARCHAR, 2, '0') AS encoder, vec_id,
       round(abs((f1 - u1) * cos(0.5 * atan2(2 * b, a - d)) + (f2 - u2) * sin(0.5 * atan2(2 * b, a - d))), 6) + 0.0 AS size
FROM rows2 r JOIN moments m ON m.e = r.e""",
)
def pca_project(spark, sf_dir):
    """Length of each vector along its encoder's first component (the sign of a component is free)."""
    pool = encoder_slices(spark, sf_dir, 2)
    bases = logme.pca_bases(stats.sufficient_stats(pool, label=None), 1)
    rows = logme.project(pool, bases)
    return rows.select("encoder", "vec_id", F.round(F.abs(F.get("features", F.lit(0))), 6).alias("size"))


@query(
    "principal_axes",
    f"""WITH {PLANE_ROWS},
moments AS (
  SELECT e, count(*) AS n, avg(f1) AS u1, avg(f2) AS u2, covar_pop(f1, f1) AS a, covar_pop(f1, f2) AS b, covar_pop(f2, f2) AS d FROM rows2 GROUP BY 1
)
SELECT 'enc-' || lpad(e::VARCHAR, 2, '0') AS encoder, n, round(u1, 6) + 0.0 AS mean_1, round(u2, 6) + 0.0 AS mean_2,
       round(sqrt(n * ((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b))), 6) AS first, round(sqrt(n * ((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b))), 6) AS second,
       round(abs(cos(0.5 * atan2(2 * b, a - d))), 6) AS size_1 FROM moments""",
)
def principal_axes(spark, sf_dir):
    """Means, singular values and first axis of two-dimensional encoders, by a tree of QR factors."""
    found = wide.axes(encoder_slices(spark, sf_dir, 2), 2)
    place = lambda name, k: F.round(F.get(name, F.lit(k)), 6)
    return found.select(
        "encoder",
        "n",
        (place("mean", 0) + 0.0).alias("mean_1"),
        (place("mean", 1) + 0.0).alias("mean_2"),
        place("singular", 0).alias("first"),
        place("singular", 1).alias("second"),
        F.round(F.abs(F.get(F.get("basis", F.lit(0)), F.lit(0))), 6).alias("size_1"),
    )
