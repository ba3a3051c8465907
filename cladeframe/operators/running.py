"""Window-shaped operators: selection probabilities, interval statistics, best so far, site windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_selection(df: DataFrame, group: str, order: list[str], weight: str) -> DataFrame:
    """Running share of the weights within each group, the last being 1."""
    w = Window.partitionBy(group)
    run = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(weight).over(run) / F.sum(weight).over(w))


def interval_window(df: DataFrame, key: str, interval: str, values: list[str], n: int) -> DataFrame:
    """Sums of the last n intervals for each key."""
    w = Window.partitionBy(key).orderBy(interval).rowsBetween(-(n - 1), 0)
    return df.select("*", *[F.sum(v).over(w).alias(f"{v}_last") for v in values])


def adaptive_probabilities(df: DataFrame, key: str, interval: str, gain: str, attempts: str, *, prior: float, floor: float) -> DataFrame:
    """For each interval the probabilities of the keys: mean gain per attempt plus a prior, normalised; what
    falls below the floor is raised to it before a second normalisation."""
    w = Window.partitionBy(interval)
    d = df.withColumn("_raw", F.when(F.col(attempts) > 0, F.col(gain) / F.col(attempts)).otherwise(0.0) + prior)
    d = d.withColumn("_p", F.greatest(F.col("_raw") / F.sum("_raw").over(w), F.lit(floor)))
    return d.withColumn("prob", F.col("_p") / F.sum("_p").over(w)).drop("_raw", "_p")


def site_windows(sites: DataFrame, site: str, length: int, stride: int) -> DataFrame:
    """Each site in all windows [k stride, k stride + length) that it falls in; stride 0 means tumbling."""
    step = stride or length
    last = F.floor(F.col(site) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(site) - length) / step) + 1)
    return sites.select("*", F.explode_outer(F.sequence(first.cast("long"), last.cast("long"))).alias("window_id"))


def best_so_far(df: DataFrame, group: str, order: list[str], score: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(score).over(w))
