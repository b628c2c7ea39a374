"""Aggregates over scores and rollouts, and the tables they are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bar
from .corpus import cumulated


def calibration(scores: DataFrame, by: str = "split", value: str = "total", floor: float = 0.85) -> DataFrame:
    """n, mean, min and number below the floor for each value of by."""
    below = F.count_if(F.col(value) < F.lit(float(floor)))
    return scores.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), below.alias("below_floor"))


def worst(scores: DataFrame, value: str = "total", floor: float = 0.85) -> DataFrame:
    """Rows below the floor, lowest first."""
    return scores.filter(F.col(value) < F.lit(float(floor))).orderBy(value)


def mutation_report(deltas: DataFrame) -> DataFrame:
    """Mean, lowest and highest change and the number of violations for each mutation."""
    return deltas.groupBy("mutation", "tier").agg(
        F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.count_if("violates").alias("violations")
    )


def rank_quantile(scores: DataFrame, value: str = "total", share: float = 0.99) -> DataFrame:
    """One row: the value at place floor(share * (n - 1)) of the sorted values; none of no values, nulls left out.

    Equal values are counted before they are put in order, so neither they nor all others meet in one task."""
    counts = scores.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c")).first()[0] or 0
    at = int(share * (n - 1)) if n else 0
    before = cumulated(counts, "v", F.col("c"))
    return before.filter((F.col("_before") <= at) & (F.col("_before") + F.col("c") > at)).select(F.col("v").alias("quantile"))


def ceiling_check(scores: DataFrame, value: str = "total", ceiling: float = 0.55) -> DataFrame:
    """p99, highest and number over the ceiling: a row, with nulls and 0 of no values."""
    over = F.count_if(F.col(value) > F.lit(float(ceiling))).alias("over")
    rows = scores.agg(F.max(value).alias("highest"), over).unionByName(rank_quantile(scores, value).select(F.col("quantile").alias("p99")), allowMissingColumns=True)
    return rows.agg(F.max("p99").alias("p99"), F.max("highest").alias("highest"), F.max("over").alias("over"))


def rollout_groups(rollouts: DataFrame, keys=("idx", "date"), total: str = "total", truncated: str = "truncated") -> DataFrame:
    """n, mean, sample deviation (0 for one rollout), min, max and truncated ones of each group."""
    return rollouts.groupBy(*keys).agg(
        F.count(total).alias("n"), F.avg(total).alias("mean"), F.coalesce(F.stddev_samp(total), F.lit(0.0)).alias("std"), F.min(total).alias("least"),
        F.max(total).alias("most"), F.count_if(truncated).alias("truncated"),
    )


def rollout_summary(groups: DataFrame) -> DataFrame:
    """Over all groups: mean deviation, mean total, share truncated, groups without spread."""
    n = F.sum("n")
    return groups.agg(
        F.avg("std").alias("mean_std"), (F.sum(F.col("mean") * F.col("n")) / n).alias("mean_total"), (F.sum("truncated") / n).alias("truncation"),
        F.count_if(F.col("std") < 1e-6).alias("flat"), F.count(F.lit(1)).alias("groups"),
    )


def first_n_mean(scores: DataFrame, order: str, n: int, value: str = "total") -> DataFrame:
    return scores.orderBy(order).limit(n).agg(F.avg(value).alias("mean"))


def ladder(samples: DataFrame, by: str = "model", value: str = "total") -> DataFrame:
    """A row a model: mean, samples, truncated ones and zero totals."""
    return samples.groupBy(by).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("truncated"), F.count_if(F.col(value) == 0.0).alias("zeros")
    )


def step_means(scored: DataFrame, step: str = "step") -> DataFrame:
    """Means of a batch's components and its share of truncated completions."""
    parts = ("format", "coverage", "grounding", "penalties", "total")
    return scored.groupBy(step).agg(*[F.avg(c).alias(c) for c in parts], F.avg(F.col("truncated").cast("double")).alias("truncated_rate"))


def training_reward(total: Column, n_tokens: Column, cap: int) -> Column:
    """The total, halved if the completion fills the cap."""
    return F.when(n_tokens >= cap, total * 0.5).otherwise(total)


def ladder_markdown(rows: DataFrame, by: str = "model") -> DataFrame:
    """One row: a markdown table of a ladder, best first. A ladder has a row a model, so it fits a row."""
    line = F.format_string("| %s | `%s` | %.4f | %d | %d |", F.col(by), bar(F.col("mean")), F.col("mean"), F.col("n"), F.col("truncated"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("k"), F.col(by), line.alias("line")))), lambda x: x["line"])
    head = F.array(F.lit(f"| {by} | | mean | n | truncated |"), F.lit("|---|---|---|---|---|"))
    return rows.agg(F.array_join(F.concat(head, listed), "\n").alias("markdown"))
