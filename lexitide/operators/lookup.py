"""Lookups, votes and joins by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str | Sequence[str], order: str, last: bool = True) -> DataFrame:
    """One row for each key: the last (or the first) by ``order``; rows with a null key are dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    pick = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.col(order))
    return kept.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick.alias("row")).select("row.*")


def look_up(df: DataFrame, key: Column, table: DataFrame, table_key: str, values: Mapping[str, str], order: str, last: bool = True, null_safe: bool = False) -> DataFrame:
    """``df`` with columns of ``table``, named by ``values`` (result name: column), null where nothing matches.

    ``table`` is first brought to one row a key, so the join adds no rows. The planner broadcasts it if its measured size
    allows. ``null_safe`` lets null keys match each other.
    """
    single = table if null_safe else one_per_key(table, table_key, order, last)
    single = single.select(F.col(table_key).alias("_key"), *[F.col(c).alias(n) for n, c in values.items()])
    keyed = df.withColumn("_own", key)
    match = F.col("_own").eqNullSafe(F.col("_key")) if null_safe else F.col("_own") == F.col("_key")
    return keyed.join(single, match, "left").drop("_own", "_key")


def map_values(column: Column, known: Mapping[str, str], default: Column | None = None) -> Column:
    """``column`` by a small fixed mapping; what it lacks becomes ``default``, or null."""
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    mapped = F.try_element_at(pairs, column)
    return mapped if default is None else F.coalesce(mapped, default)


def by_alias(df: DataFrame, column: str, aliases: DataFrame, alias: str, canonical: str, name: str) -> DataFrame:
    """``df`` with ``name``: the canonical form of ``column`` by a table of aliases, or the value itself where it has none.

    Of several canonical forms of one alias the least counts; null stays null."""
    single = aliases.where(F.col(alias).isNotNull()).groupBy(F.col(alias).alias("_alias")).agg(F.min(canonical).alias("_canonical"))
    joined = df.join(single, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(name, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def first_domain(df: DataFrame, categories: str, table: DataFrame, category: str, domain: str, unknown: str = "Unknown") -> DataFrame:
    """``df`` with ``domain`` of the first category of an array column; ``unknown`` for none, an empty or a null array."""
    known = table.select(F.col(category).alias("_c"), F.col(domain).alias("domain"))
    keyed = df.withColumn("_first", F.get(F.col(categories), F.lit(0)))
    joined = keyed.join(known, F.col("_first") == F.col("_c"), "left").drop("_first", "_c")
    return joined.withColumn("domain", F.coalesce("domain", F.lit(unknown)))


def majority_domain(df: DataFrame, key: str, categories: str, table: DataFrame, category: str, domain: str, unknown: str = "Unknown") -> DataFrame:
    """(key, domain): the domain of most categories of each row; of equally frequent ones the first in the row."""
    known = table.select(F.col(category).alias("_c"), F.col(domain).alias("domain"))
    votes = df.select(key, F.posexplode(categories).alias("pos", "_c")).join(known, "_c").groupBy(key, "domain").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = votes.groupBy(key).agg(F.max_by("domain", F.struct("n", -F.col("first"))).alias("domain"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("domain", F.lit(unknown)).alias("domain"))


def vote(df: DataFrame, key: str, run: str, labels: Sequence[str], reason: str) -> DataFrame:
    """The commonest combination of ``labels`` of each key, ties to the earliest run, with the commonest reason among
    the rows that gave it. Null labels are a value of their own."""
    ballots = df.groupBy(key, *labels).agg(F.count("*").alias("n"), F.min(run).alias("first"))
    won = ballots.groupBy(key).agg(F.max_by(F.struct(*labels), F.struct("n", -F.col("first"))).alias("won"))
    same = df.join(won, key)
    for c in labels:
        same = same.where(F.col(c).eqNullSafe(F.col(f"won.{c}")))
    reasons = same.groupBy(key, "won", reason).agg(F.count("*").alias("n"), F.min(run).alias("first"))
    return reasons.groupBy(key, "won").agg(F.max_by(reason, F.struct("n", -F.col("first"))).alias(reason)).select(key, *[F.col(f"won.{c}").alias(c) for c in labels], reason)


def match_rate(df: DataFrame, matched: Column) -> DataFrame:
    """(total, matched, percent) over all rows; percent is null for an empty table."""
    hit = F.coalesce(F.sum(F.when(matched, 1).otherwise(0)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("total"), hit.alias("matched"), (100.0 * hit / F.nullif(F.count("*"), F.lit(0))).alias("percent"))


def membership(df: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """``df`` with ``is_member``: whether the key is among ``members``; false for a null or blank key."""
    known = members.select(F.col(member).alias("_m")).where("trim(_m) <> ''").distinct().withColumn("_hit", F.lit(True))
    return df.join(known, F.col(key) == F.col("_m"), "left").withColumn("is_member", F.coalesce("_hit", F.lit(False))).drop("_m", "_hit")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``values`` of ``column`` for each non-null value of ``row``, 0 where there are none."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).agg(*counts)


def frequencies(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(name, count) of the non-null values."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count"))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group by ``order``, null keys being a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unmatched_sample(df: DataFrame, matched: Column, show: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct non-null values of ``show``, in their order, of rows that are not ``matched``: what a report of
    matches shows for a look by eye."""
    return df.where(~F.coalesce(matched, F.lit(False)) & F.col(show).isNotNull()).select(show).distinct().orderBy(show).limit(n)


def most_frequent(counts: DataFrame, value: str, count: str = "count", n: int | None = None) -> DataFrame:
    """Counts in falling order, equal ones by value; the first ``n`` of them alone if given."""
    ordered = counts.orderBy(F.desc(count), value)
    return ordered if n is None else ordered.limit(n)
