"""Rankings of encoders: survey scores, weighted Kendall tau, summaries and wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_scores(df: DataFrame, keys: Sequence[str], score: Column, name: str, out: str = "score") -> DataFrame:
    """Reversed position in each ranking: the best of M gets M - 1, the last 0."""
    order = Window.partitionBy(*keys).orderBy(score.desc(), F.asc(name))
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(out, (size - F.row_number().over(order)).cast("long"))


def survey_scores(blocks: DataFrame, models: int) -> DataFrame:
    """``(participant, task_idx, ranking array)`` to ``(participant, task_idx, model, score)``.

    A model named twice counts at its first place; places left empty name none.
    """
    rows = blocks.select("participant", "task_idx", F.posexplode("ranking").alias("_pos", "model")).where("model IS NOT NULL")
    return rows.groupBy("participant", "task_idx", "model").agg(
        (F.lit(models) - F.min("_pos") - 1).cast("long").alias("score")
    )


def duplicate_choices(blocks: DataFrame, models: int) -> DataFrame:
    """Survey blocks in which some model was chosen more than once, or that do not name them all."""
    return blocks.where(F.size(F.array_distinct("ranking")) != models)


def weighted_tau(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "tau") -> DataFrame:
    """Weighted Kendall tau of ``x`` and ``y`` inside each group, ties included.

    Weights add the inverse ranks of both members of a pair; the two ways of ranking (by x then y, by
    y then x) are averaged. The pair sum is rewritten as one signed count per row, so no pairs are
    formed: a row appears once per bit of its y rank, and the rows below it in both orders are
    counted by a running sum inside nodes of equal rank prefix. M rows cost M log M. A group is one
    ranking, one row per model of a pool, so callers aggregate to that first.
    """
    keys = list(keys)
    rows = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .repartition(*keys)
    )
    rows = rows.withColumn("_m", F.count("*").over(Window.partitionBy(*keys)))

    def upto(share: Column) -> Column:
        """Rows at or below, from their share of the group."""
        return F.round(share * F.col("_m")).cast("long")

    # Ranks, tie sizes and weights all come from two orders of the group and their prefixes.
    group = Window.partitionBy(*keys)
    for a, b, w in (("_x", "_y", "_w1"), ("_y", "_x", "_w2")):
        full, lead = group.orderBy(a, b), group.orderBy(a)
        rows = rows.withColumns(
            {f"{a}p": F.rank().over(full) - 1, w: F.row_number().over(full), f"{a}q": upto(F.cume_dist().over(full))}
        )
        rows = rows.withColumns({f"{a}r": F.rank().over(lead) - 1, f"{a}s": upto(F.cume_dist().over(lead))})
        rows = rows.withColumns({f"{a}s": F.col(f"{a}s") - F.col(f"{a}r"), f"{b}_in{a}": F.col(f"{a}p") - F.col(f"{a}r")})
    rows = rows.withColumn("_both", F.col("_xq") - F.col("_xp"))
    # ranks count from the top, and rows equal in both scores may swap places
    ranked = rows.withColumns({w: 1.0 / (F.col("_m") - F.col(w) + 1) for w in ("_w1", "_w2")})
    above = F.col("_m") - F.col("_yr") - F.col("_ys")
    base = (
        F.col("_both") + 2 * F.col("_x_in_y") + 2 * F.col("_y_in_x") + above - F.col("_yr") - 2 * F.col("_xr") - F.col("_xs")
    )
    bits = F.sequence(F.lit(0), F.length(F.bin(F.col("_m") - 1)) - 1)
    levels = ranked.withColumn("_base", base).withColumn("_b", F.explode(bits))
    levels = levels.withColumn("_bit", F.expr("shiftright(_yr, _b) & 1")).withColumn("_node", F.expr("shiftright(_yr, _b + 1)"))
    below = Window.partitionBy(*keys, "_b", "_node").orderBy("_xr").rangeBetween(Window.unboundedPreceding, -1)
    counted = levels.withColumn(
        "_low", F.col("_bit") * F.coalesce(F.sum(1 - F.col("_bit")).over(below), F.lit(0))
    )
    once = F.when(F.col("_b") == 0, 1).otherwise(0)
    signed = once * F.col("_base") + 4 * F.col("_low")
    sums = counted.groupBy(*keys).agg(
        F.max("_m").alias("n_models"),
        *[F.sum(F.col(w) * signed).alias(f"_n{w}") for w in ("_w1", "_w2")],
        *[
            F.sum(F.col(w) * once * (F.col("_m") - F.col(side))).alias(f"_d{w}{side}")
            for w in ("_w1", "_w2")
            for side in ("_xs", "_ys")
        ],
    )

    def tau(w: str) -> Column:
        scale = F.sqrt(F.col(f"_d{w}_xs") * F.col(f"_d{w}_ys"))
        return F.try_divide(F.col(f"_n{w}"), scale)

    return sums.select(*keys, "n_models", ((tau("_w1") + tau("_w2")) / 2).alias(out))


TAU_MEANS = {
    # inverse of the usual averaging, kept as the published summary has it
    "mean": lambda t: F.atanh(F.avg(F.tanh(t))),
    "fisher_mean": lambda t: F.tanh(F.avg(F.atanh(t))),
    "plain_mean": lambda t: F.avg(t),
}


def tau_statistics(tau: str = "tau") -> list[Column]:
    """Aggregates of one summary line: means, range and sign counts."""
    t = F.col(tau)
    return [
        *[fn(t).alias(name) for name, fn in TAU_MEANS.items()],
        F.min(t).alias("lowest"),
        F.max(t).alias("highest"),
        F.count_if(t <= 0).alias("n_nonpositive"),
        F.count_if(t > 0.5).alias("n_above_half"),
        F.count_if(t > 0).alias("n_positive"),
    ]


def tau_summary(taus: DataFrame, tau: str = "tau") -> DataFrame:
    """Summary lines per (setup, task), per setup and overall, in one aggregation."""
    sets = [[F.col("setup"), F.col("task")], [F.col("setup")], []]
    level = F.when(F.grouping_id() == 0, "task").when(F.grouping_id() == 1, "setup").otherwise("overall")
    return taus.groupingSets(sets, F.col("setup"), F.col("task")).agg(level.alias("level"), *tau_statistics(tau))


def named_tasks(survey: DataFrame, target: DataFrame) -> DataFrame:
    """Survey scores with the task name that each ``task_idx`` has in the target file."""
    if "task" in survey.columns:
        return survey
    return survey.join(target.select("task_idx", "task").distinct(), "task_idx")


def human_taus(target: DataFrame, survey: DataFrame, gold: str = "f1") -> DataFrame:
    """Tau of each participant with the gold scores: ``(setup, task, participant, n_models, tau, n_missing)``.

    ``n_missing`` counts models of the task that the participant does not rank.
    """
    joined = target.select("setup", "task", "model", gold).join(named_tasks(survey, target), ["task", "model"])
    return _with_missing(weighted_tau(joined, ["setup", "task", "participant"], gold, "score"), target, gold)


def majority_taus(target: DataFrame, survey: DataFrame, gold: str = "f1") -> DataFrame:
    """Tau of the summed human scores with the gold scores: ``(setup, task, n_models, tau, n_missing)``."""
    summed = named_tasks(survey, target).groupBy("task", "model").agg(F.sum("score").alias("score"))
    joined = target.select("setup", "task", "model", gold).join(summed, ["task", "model"])
    return _with_missing(weighted_tau(joined, ["setup", "task"], gold, "score"), target, gold)


def _with_missing(taus: DataFrame, target: DataFrame, gold: str) -> DataFrame:
    """Adds how many models of a task the ranking behind each tau lacks."""
    pool = target.where(F.col(gold).isNotNull()).groupBy("setup", "task").agg(F.count("*").alias("_pool"))
    return taus.join(pool, ["setup", "task"]).withColumn("n_missing", F.col("_pool") - F.col("n_models")).drop("_pool")


def logme_taus(target: DataFrame, gold: str = "f1", logme: str = "logme") -> DataFrame:
    return weighted_tau(target, ["setup", "task"], gold, logme)


def win_rate(humans: DataFrame, logme: DataFrame) -> DataFrame:
    """How often a participant's tau is above LogME's on the same task, and the other way round."""
    both = humans.join(logme.select("setup", "task", F.col("tau").alias("logme_tau")), ["setup", "task"])
    wins = F.count_if(F.col("tau") > F.col("logme_tau"))
    losses = F.count_if(F.col("tau") < F.col("logme_tau"))
    return both.agg(
        F.count("*").alias("comparisons"),
        wins.alias("human_wins"),
        losses.alias("logme_wins"),
        F.try_divide(100.0 * wins, F.count("*")).alias("human_win_pct"),
    )
