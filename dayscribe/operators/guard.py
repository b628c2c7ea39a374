"""Run guard: the first step at which a run's last ticks say that it should stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PATIENCE, TRAIN_GAIN, HELDOUT_DROP, LENGTH_FLOOR, TRUNC_CEILING = 3, 0.05, 0.10, 0.5, 0.5
RULES = ("diverged", "collapsed", "truncated")


def reason(train_gain: Column, heldout_gain: Column, length_ratio: Column, truncated: Column, least_gain=TRAIN_GAIN, drop=HELDOUT_DROP, floor=LENGTH_FLOOR, ceiling=TRUNC_CEILING) -> Column:
    """The first rule that fires: training rises while held-out falls, texts shrink, or texts are cut off."""
    d = lambda x: F.lit(float(x))
    return (
        F.when((train_gain >= d(least_gain)) & (heldout_gain <= d(-drop)), RULES[0])
        .when(length_ratio < d(floor), RULES[1])
        .when(truncated > d(ceiling), RULES[2])
    )


def ticks(rollouts: DataFrame) -> DataFrame:
    """A tick a run and step from (run, step, train_reward, total, n_tokens, ref_tokens, truncated): means over rollouts."""
    return rollouts.groupBy("run", "step").agg(
        F.avg("train_reward").alias("train_reward"), F.avg("total").alias("spotcheck_total"), F.avg("n_tokens").alias("tokens"),
        F.max("ref_tokens").alias("ref_tokens"), F.avg(F.col("truncated").cast("double")).alias("truncated_rate"), F.count(F.lit(1)).alias("rollouts"),
    )


def verdicts(history: DataFrame, patience: int = PATIENCE, **limits) -> DataFrame:
    """history with reason at each step: null within the first patience - 1 of a run, and where no rule fires.

    Ticks without a reference length are left out of the length rule; without any it doesn't fire."""
    last = Window.partitionBy("run").orderBy("step").rowsBetween(-(patience - 1), 0)
    gain = lambda c: F.last(c).over(last) - F.first(c).over(last)
    ratio = F.when(F.col("ref_tokens") > 0, F.col("tokens") / F.col("ref_tokens"))
    fired = reason(gain("train_reward"), gain("spotcheck_total"), F.avg(ratio).over(last), F.avg("truncated_rate").over(last), **limits)
    return history.withColumn("reason", F.when(F.count(F.lit(1)).over(last) >= patience, fired))


def first_abort(history: DataFrame, patience: int = PATIENCE, **limits) -> DataFrame:
    """(run, step, reason) of the first step at which a run's guard fires; runs that go through give no row."""
    fired = verdicts(history, patience, **limits).filter("reason is not null")
    return fired.groupBy("run").agg(F.min(F.struct("step", "reason")).alias("x")).select("run", "x.step", "x.reason")
