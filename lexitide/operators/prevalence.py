"""Share of texts that hold a marker, by group, with Wilson bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import stats, text


def settle_flags(df: DataFrame, flags: Sequence[str], missing: str = "true") -> DataFrame:
    """``df`` with missing booleans as ``true`` (what an untyped reader makes of blanks), ``false``, or left null."""
    if missing == "null":
        return df
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(missing == "true")) for f in flags})


def each_member(df: DataFrame, column: str, delimiter: str = "|", keep_blank: bool = False) -> DataFrame:
    """A row for each member of a delimited column, under the same name; a row counts once in each of its members."""
    return df.withColumn(column, F.explode(text.members(F.col(column), delimiter, keep_blank)))


def shares(df: DataFrame, keys: Sequence[str], flag: str, confidence: float = 0.95) -> DataFrame:
    """(keys, count, mean, ci_lower, ci_upper): the share of rows with ``flag`` in each group.

    Rows with a null key belong to no group; null flags are not counted. Counts are combined before the one shuffle,
    so neither a large nor a skewed group is moved.
    """
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    counted = kept.groupBy(*keys).agg(F.count(flag).alias("count"), F.avg(F.col(flag).cast("double")).alias("mean"))
    lower, upper = stats.wilson(F.col("mean"), F.col("count"), confidence)
    return counted.withColumns({"ci_lower": lower, "ci_upper": upper})


def share_sets(df: DataFrame, sets: Sequence[Sequence[str]], flag: str, confidence: float = 0.95) -> DataFrame:
    """The same for several sets of keys from one pre-aggregate of the finest grain, whose exchange all sets share;
    keys outside a row's set are null and ``keys`` names its set. Rows with a null key are left out of its sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    finest = df.groupBy(*keys).agg(F.count(flag).alias("n"), F.sum(F.col(flag).cast("long")).alias("hits"))
    by_set = [
        finest.where(" and ".join(f"`{k}` is not null" for k in s)).select(F.lit("+".join(s)).alias("keys"), *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys], "n", "hits") for s in sets
    ]
    rows = by_set[0]
    for other in by_set[1:]:
        rows = rows.unionByName(other)
    summed = rows.groupBy("keys", *keys).agg(F.sum("n").alias("count"), (F.sum("hits") / F.sum("n")).alias("mean"))
    lower, upper = stats.wilson(F.col("mean"), F.col("count"), confidence)
    return summed.withColumns({"ci_lower": lower, "ci_upper": upper})
