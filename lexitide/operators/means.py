"""Means by group with t-intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import stats


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, count, mean, std): moments of the finite values of ``value``; std is null for a single one."""
    x = stats.finite(F.col(value).cast("double"))
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    return kept.groupBy(*keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def mean_intervals(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """``moments`` with t-bounds of the mean; NaN for fewer than two values or none that differ."""
    m = moments(df, keys, value)
    half = stats.t_quantile((F.col("count") - 1).cast("double"), F.lit(confidence)) * F.col("std") / F.sqrt("count")
    none = (F.col("count") < 2) | F.col("std").isNull() | (F.col("std") == 0)
    nan = F.lit(float("nan"))
    return m.withColumns({"ci_lower": F.when(none, nan).otherwise(F.col("mean") - half), "ci_upper": F.when(none, nan).otherwise(F.col("mean") + half)})
