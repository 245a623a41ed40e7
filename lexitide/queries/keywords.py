"""Share of abstracts with a marker word."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import dates, stats, text
from lexitide.operators import prevalence, report
from lexitide.plans import papers
from lexitide.sources.tables import table

_PATTERN = text.word_pattern(text.MARKER_WORDS, plain=True)
Z = repr(stats.z_value())

#: Papers with dates, in SQL.
DATED = """
dated as (
  select row_no, paper_id, abstract, date, cast(year(date) as int) as year, cast(month(date) as int) as month,
         case when month(date) <= 6 then 'H1' else 'H2' end as half_year, coalesce(has_policy, true) as has_policy,
         coalesce(is_oa, true) as is_oa, policy_category, coalesce(country_list, '') as country_list, coalesce(domain_list, '') as domain_list, journal_name
  from (select *, cast(try_strptime(pub_date, ['%Y-%m-%d', '%Y-%m']) as date) as date from paper) where date is not null)
"""
MARKED = DATED + f""",
marked as (select *, regexp_matches(lower(abstract), '{_PATTERN}') as has_keyword from dated where regexp_matches(abstract, '[^\\s\\p{{Z}}]'))
"""


def members_sql(source: str, keys: tuple[str, ...], keep_blank: bool) -> str:
    """A derived table with the list columns among ``keys`` unnested."""
    for k in keys:
        if k in ("domain_list", "country_list"):
            where = "" if keep_blank else f" where trim({k}) <> ''"
            source = f"(select * from (select * replace (unnest(string_split({k}, '|')) as {k}) from {source}){where})"
    return source


def wilson_sql(p: str, n: str) -> str:
    middle, scale = f"({p} + {Z}*{Z}/(2*{n}))", f"(1 + {Z}*{Z}/{n})"
    half = f"{Z} * sqrt(({p}*(1-{p}) + {Z}*{Z}/(4*{n}))/{n}) / {scale}"
    return f"round(greatest(0, {middle}/{scale} - {half}), 8) as ci_lower, round(least(1, {middle}/{scale} + {half}), 8) as ci_upper"


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """``df`` with its doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def keyword_scenario(spark: SparkSession, folder: str, keys: tuple[str, ...]) -> DataFrame:
    return rounded(prevalence.shares(papers.in_members(papers.marked(spark, folder), keys, keep_blank=False), keys, "has_keyword"))


def scenario_sql(keys: tuple[str, ...]) -> str:
    cols, none = ", ".join(keys), " and ".join(f"{k} is not null" for k in keys)
    return f"""with {MARKED},
    grouped as (select {cols}, count(*) as count, avg(cast(has_keyword as int)) as mean from {members_sql('marked', keys, False)} where {none} group by {cols})
    select {cols}, count, round(mean, 8) as mean, {wilson_sql('mean', 'count')} from grouped"""


SETS = [("year", "half_year"), ("year", "half_year", "has_policy"), ("year", "half_year", "is_oa"), ("year", "month"), ("policy_category",)]


def keyword_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Several scenarios in one pass over the papers."""
    return rounded(prevalence.share_sets(papers.marked(spark, folder), SETS, "has_keyword"))


def _sets_sql() -> str:
    keys = list(dict.fromkeys(k for s in SETS for k in s))
    one = lambda s: f"""select '{"+".join(s)}' as keys, {", ".join(k if k in s else f"cast(null as {dict(year='int', month='int', has_policy='boolean', is_oa='boolean').get(k, 'varchar')}) as {k}" for k in keys)},
      count(*) as count, avg(cast(has_keyword as int)) as mean from marked where {" and ".join(f"{k} is not null" for k in s)} group by {", ".join(s)}"""  # noqa: E731
    return f"with {MARKED}, grouped as ({' union all '.join(one(s) for s in SETS)}) select keys, {', '.join(keys)}, count, round(mean, 8) as mean, {wilson_sql('mean', 'count')} from grouped"


def inflated_wilson(spark: SparkSession, folder: str) -> DataFrame:
    """Half-year shares with bounds widened for the model's error."""
    shares = prevalence.shares(papers.marked(spark, folder), ("year", "half_year"), "has_keyword")
    lower, upper = stats.wilson(F.col("mean"), F.col("count"), model_error=0.01)
    return rounded(shares.withColumns({"ci_lower": lower, "ci_upper": upper}))


def series_spine(spark: SparkSession, folder: str) -> DataFrame:
    """The half-years from 2021 to the first of 2025, and the share in each with and without a policy."""
    both = papers.SCENARIOS["half_year_policy"]
    series = prevalence.shares(papers.marked(spark, folder), both, "has_keyword")
    years = spark.range(2021, 2026).select(F.col("id").cast("int").alias("year"), F.explode(F.array(F.lit("H1"), F.lit("H2"))).alias("half_year"))
    spine = years.where(dates.until_half(F.col("year"), F.col("half_year"))).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("has_policy"))
    return rounded(report.on_spine(spine, series, both, ("mean", "ci_lower", "ci_upper")))


def month_spine(spark: SparkSession, folder: str) -> DataFrame:
    """Every month between the first and the last paper, with its number of papers."""
    dated = papers.dated(spark, folder)
    months = dates.months_between(dated.agg(F.min("date").alias("a"), F.max("date").alias("b")), F.col("a"), F.col("b"))
    counts = dated.groupBy(F.trunc("date", "MM").cast("date").alias("month_start")).agg(F.count("*").alias("n"))
    return months.join(counts, "month_start", "left").select("month_start", F.coalesce("n", F.lit(0)).alias("n"))


def clean_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts as they are sent to a service: stripped, cut, null if blank; dates within the study alone."""
    rows = papers.dated(spark, folder).where(F.col("date").between("2021-01-01", "2025-06-30"))
    return rows.select("row_no", text.clean_text(F.col("abstract")).alias("abstract"), dates.day_text(F.col("date")).alias("day"))


def monthly_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Up to thirty papers of each month."""
    rows = papers.dated(spark, folder).where(text.non_blank(F.col("abstract"))).withColumn("period", F.date_format("date", "yyyy-MM"))
    return report.sample_by_period(rows.select("row_no", "period"), "period", "row_no")


def quarter_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Disclosures with a paper id by quarter."""
    d = table(spark, folder, "disclosure_df").withColumn("date", dates.read_date(F.col("pub_date"))).where("date is not null")
    return d.groupBy(dates.quarter_label(F.col("date")).alias("quarter")).agg(F.count("paper_id").alias("n"))


NAMES = {f"keyword_{k}": v for k, v in papers.SCENARIOS.items() if k not in ("half_year_policy_category", "half_year_oa_policy")}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(keyword_scenario, keys=k) for n, k in NAMES.items()}
QUERIES |= {f.__name__: f for f in (keyword_sets, inflated_wilson, series_spine, month_spine, clean_truncate, monthly_sample, quarter_counts)}
_HALF = f"with {MARKED}, grouped as (select year, half_year, count(*) as count, avg(cast(has_keyword as int)) as mean from marked group by all)"
_INFLATED = f"sqrt(power({Z} * sqrt((mean*(1-mean) + {Z}*{Z}/(4*count))/count) / (1 + {Z}*{Z}/count), 2) + power({Z} * greatest(0.001, 0.01 / sqrt(count/1000.0)), 2))"
SQL = {n: scenario_sql(k) for n, k in NAMES.items()} | {
    "keyword_sets": _sets_sql(),
    "inflated_wilson": f"""{_HALF} select year, half_year, count, round(mean, 8) as mean,
      round(greatest(0, (mean + {Z}*{Z}/(2*count))/(1 + {Z}*{Z}/count) - {_INFLATED}), 8) as ci_lower, round(least(1, (mean + {Z}*{Z}/(2*count))/(1 + {Z}*{Z}/count) + {_INFLATED}), 8) as ci_upper from grouped""",
    "series_spine": f"""with {MARKED}, grouped as (select year, half_year, has_policy, count(*) as count, avg(cast(has_keyword as int)) as mean from marked group by all),
      bounded as (select year, half_year, has_policy, round(mean, 8) as mean, {wilson_sql('mean', 'count')} from grouped),
      spine as (select cast(y as int) as year, h as half_year, p as has_policy from range(2021, 2026) r(y), (values ('H1'), ('H2')) v(h), (values (true), (false)) w(p) where not (y = 2025 and h = 'H2'))
      select year, half_year, has_policy, mean, ci_lower, ci_upper from spine left join bounded using (year, half_year, has_policy)""",
    "month_spine": f"""with {DATED}, m as (select cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), interval 1 month)) as date) as month_start from dated),
      c as (select cast(date_trunc('month', date) as date) as month_start, count(*) as n from dated group by 1) select month_start, coalesce(n, 0) as n from m left join c using (month_start)""",
    "clean_truncate": f"""with {DATED} select row_no, substring(nullif(regexp_replace(abstract, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), ''), 1, 200) as abstract, strftime(date, '%Y-%m-%d') as day
      from dated where date between date '2021-01-01' and date '2025-06-30'""",
    "monthly_sample": f"""with {DATED}, p as (select row_no, strftime(date, '%Y-%m') as period from dated where regexp_matches(abstract, '[^\\s\\p{{Z}}]'))
      select row_no, period from p qualify row_number() over (partition by period order by md5(row_no || '|42'), row_no) <= 30""",
    "quarter_counts": """select cast(year(date) as varchar) || '-Q' || cast(quarter(date) as varchar) as quarter, count(paper_id) as n
      from (select paper_id, cast(try_strptime(pub_date, ['%Y-%m-%d', '%Y-%m']) as date) as date from disclosure_df) where date is not null group by 1""",
}
