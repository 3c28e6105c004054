"""LEEP: log expected empirical prediction of a source model on a target task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encoscope.functions.lookups import lookup_join
from encoscope.functions.vectors import dot, vector_sum

FORMS = ("paper", "by_target")


def label_positions(spark: SparkSession, labels: Sequence[str], name: str) -> DataFrame:
    """0-based positions of a label list, in list order."""
    return spark.createDataFrame([(str(label), k) for k, label in enumerate(labels)], f"{name} string, position int")


def joint(df: DataFrame, theta: str = "theta", gold: str = "gold") -> DataFrame:
    """Joint distribution ``(y, z, p)``: class-wise sums of theta over the number of rows.

    Sums combine map-side, so what is shuffled is one vector per task and target class.
    """
    sums = df.groupBy(F.col(gold).alias("y")).agg(F.count("*").alias("_n"), vector_sum(F.col(theta)).alias("_s"))
    rows = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per target class is left here
    whole = sums.withColumn("_rows", F.sum("_n").over(rows))
    return whole.select("y", "_rows", F.posexplode("_s").alias("z", "_v")).select(
        "y", "z", (F.col("_v") / F.col("_rows")).alias("p")
    )


def conditional(joint_table: DataFrame) -> DataFrame:
    """Conditional distribution of target given source: ``(y, z, p)``."""
    over_z = Window.partitionBy("z")
    total = F.sum("p").over(over_z)
    return joint_table.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(0.0))


def expected_predictions(df: DataFrame, theta: str, gold: str, form: str, targets: DataFrame | None) -> DataFrame:
    table = joint(df, theta, gold)
    if form == "paper":
        by_y = conditional(table).groupBy("y").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("z", "p"))), lambda s: s["p"]).alias("_weights")
        )
        joined = lookup_join(df.withColumn("y", F.col(gold)), by_y, "y", max_rows=5_000)
        return joined.withColumn("eep", dot(F.col(theta), F.col("_weights"))).drop("_weights", "y")
    if form != "by_target":
        raise ValueError(f"unknown form {form!r}; expected one of {FORMS}")
    if targets is None:
        raise ValueError("the by_target form needs the target label positions")
    by_z = table.groupBy("z").agg(F.sum("p").alias("_mean"))
    by_y = table.groupBy("y").agg(F.sum("p").alias("_marginal")).join(targets.withColumnRenamed(targets.columns[0], "y"), "y")
    factor = F.when(F.col("_marginal") > 0, F.col("_mean") / F.col("_marginal")).otherwise(0.0)
    factors = by_y.join(by_z, by_y["position"] == by_z["z"], "left").select("y", "position", factor.alias("_factor"))
    joined = lookup_join(df.withColumn("y", F.col(gold)), factors, "y", max_rows=100_000)
    picked = F.get(theta, F.col("position"))
    return joined.withColumn("eep", F.coalesce(picked * F.col("_factor"), F.lit(0.0))).drop("y", "position", "_factor")


def leep(df: DataFrame, theta: str = "theta", gold: str = "gold", form: str = "paper", targets: DataFrame | None = None) -> DataFrame:
    """One row with the score; rows whose expected prediction is 0 add nothing but stay counted.

    ``paper`` follows the definition. ``by_target`` keys the source marginal by the target class at
    the same list position.
    """
    scored = expected_predictions(df, theta, gold, form, targets)
    return scored.agg(F.avg(F.when(F.col("eep") > 0, F.log("eep")).otherwise(0.0)).alias("leep"))
