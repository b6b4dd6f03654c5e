"""Benchmark statistics and scoring of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import chosen
from graphloom.operators.ordered import order_statistics


def by_index(rows: DataFrame, group: str, value: str, percents: dict[str, float]) -> DataFrame:
    """Values at index floor(p * (n - 1)) of each group's sorted non-null values."""
    return order_statistics(rows, [group], value, {name: (p, 1) for name, p in percents.items()}).drop("n")


def benchmark_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, min, max, mean, sample deviation, runs a second (of values in milliseconds; 0 if they add up to 0), p50, p95 and p99 of each group."""
    total = F.sum(value)
    speed = F.when(total > 0, F.count(F.lit(1)) / (total / 1000)).otherwise(0.0)
    base = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), speed.alias("per_second"))
    return base.join(by_index(rows, group, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), group)


def consistency(cv: Column) -> Column:
    return F.when(cv < 0.10, 95).when(cv < 0.25, 80).when(cv < 0.50, 60).otherwise(30)


def latency_score(actual: Column, target: Column, most: Column) -> Column:
    """100 up to the target, then linearly down to 0 at the most."""
    return F.when(actual <= target, 100.0).when(actual >= most, 0.0).otherwise(100.0 * (most - actual) / (most - target))


def trends(runs: DataFrame, group: str, order: str, value: str, previous: int) -> DataFrame:
    """Each run's value, the mean of the ``previous`` before it and the change in per cent; an alert below -5.

    Against a mean of 0 the change is infinite with the value's sign, and NaN if the value is 0 too.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(-previous, -1)
    base = runs.withColumn("base", F.avg(value).over(before))
    more = 100.0 * (F.col(value) - F.col("base"))
    endless = F.when(F.isnan(more) | (more == 0), F.lit(float("nan"))).when(more > 0, F.lit(float("inf"))).when(more < 0, F.lit(float("-inf")))
    change = F.when(F.col("base") == 0, endless).otherwise(F.try_divide(more, F.col("base")))
    return base.withColumn("change", change).withColumn("alert", F.coalesce(change < -5, F.lit(False)))


def matched(returned: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: hits, precision and recall of the returned keys."""
    r, e = returned.select(keys).distinct().withColumn("r", F.lit(1)), expected.select(keys).distinct().withColumn("e", F.lit(1))
    both = r.join(e, keys, "full").agg(F.count_if(F.col("r").isNotNull() & F.col("e").isNotNull()).alias("hits"), F.count("r").alias("nr"), F.count("e").alias("ne"))
    return both.select("hits", (F.col("hits") / F.greatest("nr", F.lit(1))).alias("precision"), (F.col("hits") / F.greatest("ne", F.lit(1))).alias("recall"))


def warmup(runs: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, first, warm, penalty, cold): first value over the median (by index) of the later ones; cold from over 3 on.

    ``order`` tells a group's runs apart.
    """
    first = runs.groupBy(group).agg(F.min(F.struct(order, value)).alias("x")).select(group, F.col(f"x.{order}").alias("from_"), F.col(f"x.{value}").alias("first"))
    later = runs.join(first, group).where(F.col(order) > F.col("from_"))
    warm = by_index(later, group, value, {"warm": 0.5})
    penalty = F.when(F.col("warm") > 0, F.col("first") / F.col("warm"))
    return first.join(warm, group).select(group, "first", "warm", penalty.alias("penalty"), F.coalesce(penalty > 3, F.lit(False)).alias("cold"))


#: Weights of the five dimensions of a run's health: correctness, latency, scalability, consistency, robustness. Fixed values.
HEALTH = (0.35, 0.2, 0.15, 0.15, 0.15)


def health(scores: list[Column]) -> Column:
    """The weighted mean of the five dimensions' scores, over those that are known; null if none is."""
    return weighted(scores, list(HEALTH))


def robustness(errors: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * (1 - errors / total)).otherwise(F.lit(0.0))


def weighted(scores: list[Column], weights: list[float]) -> Column:
    """Weighted mean of the scores that are not null; null if all are."""
    zero = F.lit(0.0)
    total = sum((F.when(s.isNull(), zero).otherwise(w) for s, w in zip(scores, weights, strict=True)), zero)
    return F.when(total > 0, sum((F.coalesce(s * w, zero) for s, w in zip(scores, weights, strict=True)), zero) / total)


def improvement_targets(scores: DataFrame, weights: dict[str, float], top: int) -> DataFrame:
    """(name, score, gain): the dimensions (name, score of 100) whose weight * (100 - score) is greatest."""
    gain = chosen(F.col("name"), weights, 0.0) * (100 - F.col("score"))
    return scores.select("name", "score", gain.alias("gain")).orderBy(F.desc("gain"), "name").limit(top)
