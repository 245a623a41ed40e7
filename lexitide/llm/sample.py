"""Bounded samples of texts from which models are trained: the same ones whatever the files, their order and the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the range of hash values among which the least ones are found.
PARTS = 4096


def text_sample(df: DataFrame, key: str, text: str, most: int, longest: int, group: str | None = None, groups: Sequence[str] = (), where: Column | None = None) -> list[tuple[str, str]]:
    """(group, text): of each of ``groups`` (or of all rows) the ``most`` rows whose key and text have the least hash values, in
    their order; rows that agree in both count once.

    Only texts of up to ``longest`` characters are drawn, and those whole, so that what reaches the driver is bounded. A first pass
    counts rows by parts of the range of hash values, a second one reads the parts that are needed.
    """
    label = F.col(group) if group else F.lit("")
    rows = df.select(label.alias("g"), F.col(text).alias("t"), F.shiftrightunsigned(F.xxhash64(key, text), 1).alias("h")).where((F.length("t") > 0) & (F.length("t") <= longest))
    if group:
        rows = rows.where(F.col("g").isin(list(groups)))
    if where is not None:
        rows = rows.where(where)
    part = F.shiftright("h", 64 - PARTS.bit_length())
    counts = rows.groupBy("g", part.alias("p")).agg(F.approx_count_distinct("h").alias("n")).collect()  # at most PARTS rows a group
    needed: dict[str, int] = {}
    for g in {r.g for r in counts}:
        held = 0
        for r in sorted((r for r in counts if r.g == g), key=lambda r: r.p):
            held, needed[g] = held + r.n, r.p
            if held >= 1.2 * most:  # the counts are estimates
                break
    if not needed:
        return []
    wanted = F.lit(False)
    for g, p in sorted(needed.items()):
        wanted = wanted | ((F.col("g") == g) & (part <= p))
    distinct = rows.where(wanted).groupBy("g", "h").agg(F.min("t").alias("t"))
    w = Window.partitionBy("g").orderBy("h")
    drawn = distinct.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("g", "k", "t").collect()
    return [(r.g, r.t) for r in sorted(drawn, key=lambda r: (r.g, r.k))]
