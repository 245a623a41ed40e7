"""Series and comparisons behind reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import stats


def on_spine(spine: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of ``spine`` with the values of the first row of ``series`` of the same keys, null where there is none."""
    single = series.groupBy(*keys).agg(F.min(F.struct(*values)).alias("v")).select(*keys, "v.*")
    return spine.join(single, list(keys), "left")


def roll_up(df: DataFrame, keys: Sequence[str], mean: str = "mean", count: str = "count", se: str = "se", warning: str = "warning", confidence: float = 0.95, z: float | None = 1.96) -> DataFrame:
    """(keys, count, mean, se, ci_lower, ci_upper): means of groups weighed by their counts, with propagated errors.

    Rows with the warning extreme_estimate count nothing, yet a group of only such rows stays, with count 0 and nulls.
    """
    z = z or stats.z_value(confidence)
    ok = ~F.col(warning).eqNullSafe(F.lit("extreme_estimate"))
    w = F.when(ok, F.col(count).cast("double"))
    summed = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(ok, F.col(count))), F.lit(0)).cast("long").alias("count"), F.sum(w * F.col(mean)).alias("wm"), F.sum(w * w * F.col(se) * F.col(se)).alias("ws"), F.sum(w).alias("w")
    )
    m, s = F.col("wm") / F.col("w"), F.sqrt("ws") / F.col("w")
    return summed.select(*keys, "count", m.alias("mean"), s.alias("se"), stats.clip(m - z * s).alias("ci_lower"), stats.clip(m + z * s).alias("ci_upper"))


def centred_mean(df: DataFrame, order: str, value: str, name: str, width: int = 3) -> DataFrame:
    """``df`` with the mean of the ``width`` rows around each, null where one of them is missing or null.

    The order is global: for series of periods, whose number is bounded by the calendar, not for raw rows.
    """
    half = width // 2
    w = Window.orderBy(order).rowsBetween(-half, half)
    x = stats.finite(F.col(value).cast("double"))
    return df.withColumn(name, F.when(F.count(x).over(w) == width, F.avg(x).over(w)))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value``, equal values sharing their mean rank; null for null. For series of periods."""
    w, same = Window.orderBy(F.col(value).asc_nulls_last()), Window.partitionBy(value)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho, p_value): rank correlation over rows with both values; the p-value is that of a t variable."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(both, x, "_rx"), y, "_ry")
    rho = ranked.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return rho.withColumn("p_value", stats.t_p_value(t, (F.col("n") - 2).cast("double")))


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, r2) of the least-squares line."""
    return df.agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def line_grid(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """(k, x, y): the line at ``points`` equal steps from the least to the greatest x."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)
    steps = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return steps.select("k", at.alias("x"), (F.col("a") + F.col("b") * at).alias("y"))


def bootstrap_band(df: DataFrame, key: str, x: str, y: str, replicates: int = 200, points: int = 20, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """(k, x, lower, upper): a bootstrap band around the least-squares line.

    Each row enters each replicate a Poisson number of times, drawn from a hash of its key, so replicates need no
    gathering and the result does not depend on the partitions.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    u = F.pmod(F.xxhash64("key", "r", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    n, total, term, times = F.lit(0), 0.0, 0.36787944117144233, 0
    for k in range(8):
        total += term
        n = n + F.when(u >= total, 1).otherwise(0)
        times, term = k + 1, term / (k + 1)
    drawn = both.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("n", n)
    w = F.col("n").cast("double")
    sums = drawn.groupBy("r").agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("sx"), F.sum(w * F.col("y")).alias("sy"), F.sum(w * F.col("x") * F.col("x")).alias("sxx"), F.sum(w * F.col("x") * F.col("y")).alias("sxy"))
    slope = (F.col("w") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("w") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    lines = sums.select(slope.alias("b"), ((F.col("sy") - slope * F.col("sx")) / F.col("w")).alias("a"))
    lo, hi = both.agg(F.min("x")).scalar(), both.agg(F.max("x")).scalar()
    grid = lines.select("a", "b", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1))
    values = grid.select("k", "x", (F.col("a") + F.col("b") * F.col("x")).alias("v"))
    q = (1 - confidence) / 2
    return values.groupBy("k", "x").agg(F.percentile("v", F.lit(q)).alias("lower"), F.percentile("v", F.lit(1 - q)).alias("upper"))


def merge_series(first: DataFrame, second: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two series; columns that both have get suffixes."""
    both = [c for c in first.columns if c in second.columns and c not in keys]
    name = lambda df, s: df.select(*[F.col(c).alias(c + s if c in both else c) for c in df.columns])
    return name(first, suffixes[0]).join(name(second, suffixes[1]), list(keys))


def row_totals(df: DataFrame, columns: Sequence[str], name: str = "total") -> DataFrame:
    """``df`` with the sum of several columns, null counting nothing."""
    total: Column = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return df.withColumn(name, total)


def sample_by_period(df: DataFrame, period: str, key: str, n: int = 30, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each period, those of the least hash of ``key``; the same rows whatever the partitions.

    Ranked by a window that keeps at most ``n`` rows of a period in each task before the shuffle.
    """
    w = Window.partitionBy(period).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key))
    return df.where(F.col(period).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
