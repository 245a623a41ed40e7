"""Dates and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms in which dates are read; a month alone is its first day.
FORMS = ("yyyy-MM-dd", "yyyy-MM")


def read_date(text: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """The date that ``text`` gives in one of ``forms``, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms])


def half_year(date: Column) -> Column:
    return F.when(F.month(date) <= 6, "H1").otherwise("H2")


def with_periods(df: DataFrame, date: str = "date") -> DataFrame:
    """``df`` with year, month and half_year of ``date``, without rows whose date is null."""
    d = F.col(date)
    return df.where(d.isNotNull()).withColumns({"year": F.year(d), "month": F.month(d), "half_year": half_year(d)})


def quarter_label(date: Column) -> Column:
    return F.concat_ws("-Q", F.year(date), F.quarter(date))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def day_text(date: Column) -> Column:
    """The date as text, empty for null."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def months_between(df: DataFrame, first: Column, last: Column, name: str = "month_start") -> DataFrame:
    """A row for each month from ``first`` to ``last``, both columns or literals of the one-row ``df``."""
    return df.select(F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))).alias(name))


def until_half(year: Column, half: Column, last_year: int = 2025, last_half: str = "H1") -> Column:
    """Whether a half-year is not after the last one."""
    return (year < last_year) | ((year == last_year) & (half <= last_half))
