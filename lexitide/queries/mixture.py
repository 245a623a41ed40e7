"""Share of the second component in groups of abstracts, by maximum likelihood."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.operators import mixture, report
from lexitide.plans import papers
from lexitide.queries.keywords import _PATTERN, DATED, Z, members_sql, rounded

#: Codes of the countries that the published comparison counts as English-speaking.
ENGLISH = """
AU BM CA FK GI GG GY IE IM JE NZ SG ZA GB US VI AG AI BS BB VG KY DM GD VC JM MS KN LC TT TC
""".split()
#: Sets of keys that are estimated together, in one pass over the papers.
SETS = [papers.SCENARIOS[k] for k in ("half_year", "half_year_policy", "half_year_policy_category", "half_year_oa", "half_year_country", "half_year_domain", "policy_country", "policy_domain", "month", "half_year_oa_policy")]


def mle_scenario(spark: SparkSession, folder: str, keys: tuple[str, ...], method: str = "fisher_logit", exact: bool = False) -> DataFrame:
    docs = papers.in_members(papers.weighed(spark, folder), keys, keep_blank=True)
    return rounded(mixture.estimates(docs, keys, method, exact=exact), 6)


def mle_sets(spark: SparkSession, folder: str) -> DataFrame:
    """All published sets of groups in one pass: each paper's probabilities are computed once."""
    member = lambda df, s: papers.in_members(df, s, keep_blank=True)
    return rounded(mixture.estimate_sets(papers.weighed(spark, folder), SETS, member), 6)


def mle_ci_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and median width of the three intervals over half-years, and how often they have one."""
    rows = mixture.compare_methods(papers.weighed(spark, folder), ("year", "half_year"))
    summed = rows.groupBy("ci_method").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("ci_width").alias("mean_width"), F.median("ci_width").alias("median_width"))
    return rounded(summed, 6)


def english_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Half-year shares of English-speaking and other countries, from the shares of the countries."""
    keys = ("year", "half_year", "country_list")
    docs = papers.in_members(papers.weighed(spark, folder), keys, keep_blank=True)
    by_country = mixture.estimates(docs, keys).withColumn("english", F.trim("country_list").isin(ENGLISH))
    return rounded(report.roll_up(by_country, ("year", "half_year", "english")), 6)


def lexicon_distributions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(papers.lexicon(spark, folder))


def log_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(papers.weighed(spark, folder).select("row_no", "lp_human", "lp_ai"), 6)


def word_bags(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.bag_of_words(papers.dated(spark, folder), "row_no", "abstract")


_TOKENS = r"[\p{L}][\p{L}\p{M}''-]*"
_WEIGHED = (
    DATED
    + f""",
tok as (select regexp_matches(lower(abstract), '{_PATTERN}') as s, unnest(regexp_extract_all(abstract, '{_TOKENS}')) as word from paper where abstract is not null),
cnt as (select word, count(*) filter (not s) as h, count(*) filter (s) as a from tok group by word having count(*) >= 50),
lex as (select word, h / sum(h) over () as p_human, a / sum(a) over () as p_ai from cnt),
docwords as (select row_no, unnest(regexp_extract_all(abstract, '{_TOKENS}')) as word from dated),
sums as (select row_no, sum(ln(p_human + 1e-10)) as h, sum(ln(p_ai + 1e-10)) as a from docwords join lex using (word) group by row_no),
weighed as (select dated.*, coalesce(h, ln(1e-10)) as lp_human, coalesce(a, ln(1e-10)) as lp_ai from dated left join sums using (row_no))
"""
)


def estimates_sql(keys: tuple[str, ...], method: str = "fisher_logit", least: int = 10, body: str = "", exact: bool = False) -> str:
    """The estimates by bisection in a recursive query."""
    cols = ", ".join(keys)
    same = " and ".join(f"d.{k} = i.{k}" for k in keys)
    none = " and ".join(f"{k} is not null" for k in keys)
    slope = "case when delta > 0 then (1 - exp(-delta)) / ((1 - (lo+hi)/2) * exp(-delta) + (lo+hi)/2) else (exp(delta) - 1) / ((1 - (lo+hi)/2) + (lo+hi)/2 * exp(delta)) end"
    gap = "abs(lp_ai - lp_human)"
    close = f"case when delta > 2 then 2*lp_ai when delta < -2 then 2*lp_human when exp(-{gap}) > 1e-10 then 2*greatest(lp_ai, lp_human) + 2*ln(abs(1 - exp(-{gap}))) else 2*greatest(lp_ai, lp_human) end"
    t1, t2 = "(ln(1 - alpha + 1e-15) + lp_human)", "(ln(alpha + 1e-15) + lp_ai)"
    part = f"({close}) - 2*(greatest({t1}, {t2}) + ln(1 + exp(-abs({t1} - {t2}))))"
    mix = "((1 - alpha)*exp(lp_human) + alpha*exp(lp_ai))"
    contribution = f"case when lp_human > -500 and lp_ai > -500 then case when {mix} > 1e-100 then power((exp(lp_ai) - exp(lp_human)) / {mix}, 2) else 0 end when {gap} < 1e-10 then 0 when {part} > -100 then exp({part}) else 0 end"
    if exact:
        contribution = f"power({slope.replace('(lo+hi)/2', 'alpha')}, 2)"
    sigmoid = lambda x: f"1 / (1 + exp(-({x})))"
    w = f"{Z} / sqrt(fi)"
    if method == "profile":
        like = lambda x: f"greatest(ln(1 - ({x}) + 1e-10), ln(({x}) + 1e-10) + delta) + ln(1 + exp(-abs(ln(1 - ({x}) + 1e-10) - ln(({x}) + 1e-10) - delta)))"
        crit = repr(stats.chi2_value())
        side = lambda name, lo, hi, falling: f""",
        {name}0 as (select {cols}, best, cast({lo} as double) as lo, cast({hi} as double) as hi, 0 as k from top),
        {name} as (select * from {name}0 union all
          select {", ".join("i." + k for k in keys)}, i.best, case when (2*(i.best - sum({like('(lo+hi)/2')})) > {crit}) = {falling} then (lo+hi)/2 else lo end, case when (2*(i.best - sum({like('(lo+hi)/2')})) > {crit}) = {falling} then hi else (lo+hi)/2 end, k + 1
          from {name} i join docs d on {same} where k < 50 group by {", ".join("i." + k for k in keys)}, i.best, lo, hi, k)"""  # noqa: E731
        extra = f""", top as (select {", ".join("i." + k for k in keys)}, i.alpha, sum({like('i.alpha')}) as best, sum({like('1e-6')}) as l0, sum({like('1 - 1e-6')}) as l1 from found i join docs d on {same} group by all)"""
        extra += side("low", "1e-6", "greatest(alpha, 1e-6)", "true") + side("up", "least(alpha, 1 - 1e-6)", "1 - 1e-6", "false")
        joined = f"""info join top using ({cols}, alpha) join (select {cols}, (lo+hi)/2 as pl from low where k = 50) using ({cols}) join (select {cols}, (lo+hi)/2 as pu from up where k = 50) using ({cols})"""
        logit = lambda s: f"case when alpha > 0.001 and alpha < 0.999 then {sigmoid(f'ln(alpha/(1-alpha)) {s} {w}/(alpha*(1-alpha))')} else greatest(0, least(1, alpha {s} {w})) end"
        lower = f"case when n >= 50 then case when alpha > 1e-6 and 2*(best - l0) > {crit} then pl else 1e-6 end else {logit('-')} end"
        upper = f"case when n >= 50 then case when alpha < 1 - 1e-6 and 2*(best - l1) > {crit} then pu else 1 - 1e-6 end else {logit('+')} end"
        name = "case when n >= 50 then 'profile_likelihood' else 'fisher_logit' end"
    else:
        extra, joined, name = "", "info", f"'{method}'"
        if method == "fisher_logit":
            bound = lambda s: f"case when alpha > 0.001 and alpha < 0.999 then {sigmoid(f'ln(alpha/(1-alpha)) {s} {w}/(alpha*(1-alpha))')} else greatest(0, least(1, alpha {s} {w})) end"
        else:
            bound = lambda s: f"greatest(0, least(1, alpha {s} {w}))"
        lower, upper = f"case when fi <= 1e-10 then 0 else {bound('-')} end", f"case when fi <= 1e-10 then 1 else {bound('+')} end"
    return f"""with recursive {_WEIGHED},
    docs as (select {cols}, lp_human, lp_ai, lp_ai - lp_human as delta, count(*) over (partition by {cols}) as n from {members_sql('weighed', keys, True)} where {none} qualify n >= {least}),
    it as (select distinct {cols}, 0.0::double as lo, 1.0::double as hi, 0 as k from docs union all
      select {", ".join("i." + k for k in keys)}, case when sum({slope}) > 0 then (lo+hi)/2 else lo end, case when sum({slope}) > 0 then hi else (lo+hi)/2 end, k + 1
      from it i join docs d on {same} where k < 50 group by {", ".join("i." + k for k in keys)}, lo, hi, k),
    found as (select {cols}, (lo+hi)/2 as alpha from it where k = 50){extra},
    info as (select {", ".join("i." + k for k in keys)}, alpha, count(*) as n, sum({contribution}) as fi from found i join docs d on {same} group by all),
    result as (select {cols}, n as count, alpha as mean, {lower} as ci_lower, {upper} as ci_upper, fi as fisher_info, case when fi > 1e-10 then 1/sqrt(fi) end as se, {name} as ci_method,
      case when fi < 1e-6 then 'very_low_fisher_info' when alpha < 0.01 or alpha > 0.99 then 'extreme_estimate' else 'none' end as warning from {joined})
    {body or f"select {cols}, count, round(mean, 6) as mean, round(ci_lower, 6) as ci_lower, round(ci_upper, 6) as ci_upper, round(ci_upper - ci_lower, 6) as ci_width, round(fisher_info, 6) as fisher_info, round(se, 6) as se, ci_method, warning from result"}"""


NAMES = {f"mle_{k}": v for k, v in papers.SCENARIOS.items()}
_ENGLISH = ", ".join(f"'{c}'" for c in ENGLISH)
_ROLL = f"""select year, half_year, english, cast(coalesce(sum(c), 0) as bigint) as count, round(sum(c*mean)/sum(c), 6) as mean, round(sqrt(sum(c*c*se*se))/sum(c), 6) as se,
  round(greatest(0, least(1, sum(c*mean)/sum(c) - 1.96*sqrt(sum(c*c*se*se))/sum(c))), 6) as ci_lower, round(greatest(0, least(1, sum(c*mean)/sum(c) + 1.96*sqrt(sum(c*c*se*se))/sum(c))), 6) as ci_upper
  from (select *, trim(country_list) in ({_ENGLISH}) as english, case when warning <> 'extreme_estimate' then cast(count as double) end as c from result) group by year, half_year, english"""
_KINDS = {"year": "int", "month": "int", "has_policy": "boolean", "is_oa": "boolean"}


def sets_sql() -> str:
    """The estimates of each set, one below the other."""
    keys = list(dict.fromkeys(k for s in SETS for k in s))
    one = lambda s: f"""select '{"+".join(s)}' as keys, {", ".join(k if k in s else f"cast(null as {_KINDS.get(k, 'varchar')}) as {k}" for k in keys)},
      count, mean, ci_lower, ci_upper, ci_width, fisher_info, se, ci_method, warning from ({estimates_sql(s)})"""  # noqa: E731
    return " union all ".join(one(s) for s in SETS)


def comparison_sql() -> str:
    """The widths of the three intervals from three estimates."""
    widths = lambda m: f"select '{m}' as ci_method, w from ({estimates_sql(('year', 'half_year'), m, 50, 'select ci_upper - ci_lower as w from result')})"
    rows = " union all ".join(widths(m) for m in ("fisher_logit", "fisher_wald", "profile"))
    return f"""select ci_method, count(*) as n, round(avg(cast(w > 0 as double)), 6) as success_rate, round(avg(w), 6) as mean_width, round(median(w), 6) as median_width from ({rows}) group by ci_method"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(mle_scenario, keys=k) for n, k in NAMES.items()}
QUERIES |= {
    "mle_fisher_wald": partial(mle_scenario, keys=("year", "half_year"), method="fisher_wald"),
    "mle_profile_ci": partial(mle_scenario, keys=("year", "half_year"), method="profile"),
    "mle_exact_information": partial(mle_scenario, keys=("year", "half_year"), exact=True),
}
QUERIES |= {f.__name__: f for f in (mle_sets, mle_ci_comparison, english_rollup, lexicon_distributions, log_probabilities, word_bags)}
SQL = {n: estimates_sql(k) for n, k in NAMES.items()} | {
    "mle_fisher_wald": estimates_sql(("year", "half_year"), "fisher_wald"),
    "mle_profile_ci": estimates_sql(("year", "half_year"), "profile"),
    "mle_exact_information": estimates_sql(("year", "half_year"), exact=True),
    "mle_sets": sets_sql(),
    "mle_ci_comparison": comparison_sql(),
    "english_rollup": estimates_sql(("year", "half_year", "country_list"), body=_ROLL),
    "lexicon_distributions": f"with {_WEIGHED} select word, round(p_human, 8) as p_human, round(p_ai, 8) as p_ai from lex",
    "log_probabilities": f"with {_WEIGHED} select row_no, round(lp_human, 6) as lp_human, round(lp_ai, 6) as lp_ai from weighed",
    "word_bags": f"with {DATED} select row_no, word, count(*) as n from (select row_no, unnest(regexp_extract_all(abstract, '{_TOKENS}')) as word from dated) group by all",
}
