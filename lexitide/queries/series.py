"""Full texts, detector answers, comparison of methods over time, policy texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import dates, text
from lexitide.operators import lookup, means, mixture, prevalence, report
from lexitide.plans import papers
from lexitide.plans.lineage import cut
from lexitide.queries.keywords import MARKED, rounded, wilson_sql
from lexitide.queries.mixture import estimates_sql
from lexitide.sources import services
from lexitide.sources.tables import table
from lexitide.streaming.shares import windowed_shares


def _full_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Full texts with their number of marker words and the flags of their paper's first delivery."""
    d = table(spark, folder, "documents").where("doc_kind = 'fulltext'").select("doc_id", "paper_id", "text", F.col("crawled_at").cast("date").alias("date"))
    counted = dates.with_periods(d).withColumn("ai_word_freq", text.count_words(F.col("text")))
    return lookup.look_up(counted, F.col("paper_id"), table(spark, folder, "paper"), "paper_id", {"has_policy": "has_policy", "is_oa": "is_oa"}, "row_no", last=False)


def fulltext_half_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(means.moments(_full_texts(spark, folder), ("year", "half_year"), "ai_word_freq"))


def fulltext_policy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(means.moments(_full_texts(spark, folder), ("year", "half_year", "has_policy"), "ai_word_freq"))


def fulltext_oa(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(means.moments(_full_texts(spark, folder), ("year", "half_year", "is_oa"), "ai_word_freq"))


def fulltext_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The half-year means with their t-intervals."""
    return rounded(means.mean_intervals(_full_texts(spark, folder), ("year", "half_year"), "ai_word_freq"))


def event_detector_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean of the rate in the events' JSON."""
    e = table(spark, folder, "events").select(F.to_date("ts").alias("day"), (text.json_number(F.col("props"), "$.k") / 100).alias("rate"))
    return rounded(means.moments(e, ("day",), "rate"))


def _detections(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a stand-in detector's answer, some of them errors, bad JSON or null."""
    n = F.col("row_no")
    good = F.concat(F.lit('{"data":{"fakePercentage":'), (n * 37 % 101).cast("string"), F.lit("}}"))
    answer = F.when(n % 17 == 0, '{"error":"timeout"}').when(n % 19 == 0, "no json").when(n % 23 == 0, F.lit(None)).when(n % 29 == 0, '{"data":{"fakePercentage":null}}').otherwise(good)
    return papers.marked(spark, folder).withColumn("rate", text.json_number(answer, "$.data.fakePercentage") / 100)


def detector_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(means.moments(_detections(spark, folder), ("year", "month"), "rate"))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly shares, detector means and text lengths side by side."""
    rows = _detections(spark, folder)
    shares = prevalence.shares(rows, ("year", "month"), "has_keyword")
    rates = means.moments(rows, ("year", "month"), "rate")
    both = report.merge_series(shares, rates, ("year", "month"), ("_keyword", "_detector"))
    return both.where((F.col("year") >= 2021) & ~((F.col("year") == 2025) & (F.col("month") > 6))).withColumn("date", dates.month_start(F.col("year"), F.col("month")))


def method_merge(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_merged(spark, folder).select("date", "year", "month", "count_keyword", "mean_keyword", "count_detector", "mean_detector"))


def _smoothed(spark: SparkSession, folder: str) -> DataFrame:
    return report.centred_mean(report.centred_mean(_merged(spark, folder), "date", "mean_keyword", "keyword"), "date", "mean_detector", "detector")


def detector_smooth(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_smoothed(spark, folder).select("date", "keyword", "detector"))


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(report.spearman(_smoothed(spark, folder), "keyword", "detector").select("n", "rho"))


def spearman_p(spark: SparkSession, folder: str) -> DataFrame:
    return report.spearman(_smoothed(spark, folder), "keyword", "detector")


def ols_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(report.line(_merged(spark, folder), "mean_keyword", "mean_detector"))


def ols_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(report.line_grid(_merged(spark, folder), "mean_keyword", "mean_detector"))


def bootstrap_band(spark: SparkSession, folder: str) -> DataFrame:
    return report.bootstrap_band(_merged(spark, folder), "date", "mean_keyword", "mean_detector")


def _three(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly shares by marker words, by the mixture and by the detector where all three have one; the detector's are
    smoothed, and months without a smooth value are left out."""
    rows = _detections(spark, folder)
    shares = prevalence.shares(rows, ("year", "month"), "has_keyword")
    mixed = mixture.estimates(papers.weighed(spark, folder), ("year", "month"))
    rates = means.moments(rows, ("year", "month"), "rate").select("year", "month", F.col("mean").alias("mean_detection"))
    both = report.merge_series(shares, mixed, ("year", "month"), ("_keyword", "_mle")).join(rates, ["year", "month"])
    kept = both.where((F.col("year") >= 2021) & ~((F.col("year") == 2025) & (F.col("month") > 6)))
    kept = kept.where("mean_keyword is not null and mean_mle is not null and mean_detection is not null").withColumn("date", dates.month_start(F.col("year"), F.col("month")))
    smooth = report.centred_mean(kept.select("date", "count_keyword", "mean_keyword", "count_mle", "mean_mle", "mean_detection"), "date", "mean_detection", "smooth_detection")
    return cut(smooth.where("smooth_detection is not null"))  # read by several comparisons


def method_series(spark: SparkSession, folder: str) -> DataFrame:
    """The three methods' monthly shares side by side, in the order of the months."""
    return rounded(_three(spark, folder), 6).orderBy("date")


def method_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of the mixture's shares with those by marker words and with the smoothed detector's."""
    rows = _three(spark, folder).select("date", *[F.round(c, 6).alias(c) for c in ("mean_mle", "mean_keyword", "smooth_detection")])
    pairs = [report.spearman(rows, "mean_mle", y).select(F.lit(y).alias("method"), "n", "rho") for y in ("mean_keyword", "smooth_detection")]
    return rounded(pairs[0].unionByName(pairs[1]))


def method_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The least-squares lines of both other methods over the mixture's shares."""
    rows = _three(spark, folder)
    lines = [report.line(rows, "mean_mle", y).select(F.lit(y).alias("method"), "*") for y in ("mean_keyword", "smooth_detection")]
    return rounded(lines[0].unionByName(lines[1]), 5)


def detector_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's rate by the stand-in detector."""
    d = table(spark, folder, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))
    asked = services.enrich(d, "text", services.stand_in_detector, "answer")
    return rounded(asked.select("doc_id", (text.json_number(F.col("answer"), "$.data.fakePercentage") / 100).alias("rate")))


def llm_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Policy texts with the labels of the stand-in classifier, decoded and repaired."""
    d = table(spark, folder, "documents").where("doc_kind = 'policy'").select("doc_id", "text")
    asked = services.enrich(d.where(text.non_blank(F.col("text"))), "text", services.stand_in_classifier, "answer", tries=3, valid=services.is_json_object)
    decoded = services.repair_labels(services.decode_answers(asked, "answer"), "category", "disclosure_location")
    return decoded.select("doc_id", "category", "disclosure_location", "failed")


def _ballots(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs' labels of each journal, which differ by rule."""
    j = table(spark, folder, "journal_info").select("journal_id", "policy_category", "disclosure_location")
    runs = j.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("run"))
    other = (F.col("journal_id") * 7 + F.col("run")) % 5 == 0
    return runs.select("journal_id", "run", F.when(other, "Open Use").otherwise(F.col("policy_category")).alias("category"), "disclosure_location", F.concat(F.lit("because "), F.col("journal_id") % 3 + F.col("run") % 2).alias("reason"))


def label_repair(spark: SparkSession, folder: str) -> DataFrame:
    return services.repair_labels(_ballots(spark, folder), "category", "disclosure_location").select("journal_id", "run", "category", "disclosure_location")


def policy_vote(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.vote(services.repair_labels(_ballots(spark, folder), "category", "disclosure_location"), "journal_id", "run", ["category", "disclosure_location"], "reason")


def arrival_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of marked abstracts in windows of thirty days of arrival: the streaming operator over the whole table."""
    rows = table(spark, folder, "paper").where(text.non_blank(F.col("abstract"))).select("ingested_at", text.has_word(F.col("abstract")).alias("has_keyword"))
    return rounded(windowed_shares(rows, "ingested_at", "has_keyword").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


_FULL = f"""words as (select doc_id, paper_id, cast(crawled_at as date) as date, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}]+(?:-[\\p{{L}}]+)*') as ws from documents where doc_kind = 'fulltext' and crawled_at is not null),
first as (select paper_id, arg_min(coalesce(cast(has_policy as varchar), '~'), row_no) as hp, arg_min(coalesce(cast(is_oa as varchar), '~'), row_no) as oa from paper where paper_id is not null group by 1),
full_texts as (select doc_id, cast(year(date) as int) as year, case when month(date) <= 6 then 'H1' else 'H2' end as half_year, try_cast(hp as boolean) as has_policy, try_cast(oa as boolean) as is_oa,
  len(list_filter(ws, lambda w: w in ({", ".join(f"'{w}'" for w in text.MARKER_WORDS)}))) as x from words left join first using (paper_id))"""
_moments = lambda source, keys, x: f"select {keys}, count({x}) as count, round(avg({x}), 8) as mean, round(stddev_samp({x}), 8) as std from {source} where {' and '.join(f'{k.strip()} is not null' for k in keys.split(','))} group by {keys}"
_DETECT = f"""with {MARKED}, det as (select *, case when row_no % 17 = 0 or row_no % 19 = 0 or row_no % 23 = 0 or row_no % 29 = 0 then null else (row_no * 37 % 101) / 100.0::double end as rate from marked),
k as (select year, month, count(*) as count_keyword, avg(cast(has_keyword as int)) as mean_keyword, count(rate) as count_detector, avg(rate) as mean_detector from det group by all),
m as (select make_date(year, month, 1) as date, * from k where year >= 2021 and not (year = 2025 and month > 6)),
s as (select date, case when count(mean_keyword) over w = 3 then avg(mean_keyword) over w end as keyword, case when count(mean_detector) over w = 3 then avg(mean_detector) over w end as detector from m window w as (order by date rows between 1 preceding and 1 following))"""
_BALLOT = """b as (select journal_id, run, case when (journal_id * 7 + run) % 5 = 0 then 'Open' else coalesce(policy_category, 'Not Mentioned') end as category, disclosure_location as l, 'because ' || (journal_id % 3 + run % 2) as reason
  from journal_info, (values (0), (1), (2)) r(run)), ballots as (select journal_id, run, category, case when category = 'Disclosure Required' then l else '' end as disclosure_location, reason from b)"""
_STRIPPED = "nullif(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"


def three_sql(body: str) -> str:
    """The three monthly series in SQL as s; the estimates of the mixture are ``result``."""
    series = f"""select make_date(year, month, 1) as date, count_keyword, mean_keyword, r.count as count_mle, r.mean as mean_mle, mean_detection
      from result r join ({_DETECT} select year, month, count_keyword, mean_keyword, mean_detector as mean_detection from k) d using (year, month)
      where year >= 2021 and not (year = 2025 and month > 6) and mean_keyword is not null and r.mean is not null and mean_detection is not null"""
    smooth = f"""select *, case when count(*) over w = 3 then avg(mean_detection) over w end as smooth_detection from ({series}) window w as (order by date rows between 1 preceding and 1 following)"""
    return estimates_sql(("year", "month"), body=body.format(s=f"(select * from ({smooth}) where smooth_detection is not null)"))


_RANKED = """select '{y}' as method, count(*) as n, round(corr(a, b), 8) as rho from (
  select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as a, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as b
  from (select round(mean_mle, 6) as x, round({y}, 6) as y from {{s}}))"""
_LINE = "select '{y}' as method, regr_count({y}, mean_mle) as n, round(regr_slope({y}, mean_mle), 5) as slope, round(regr_intercept({y}, mean_mle), 5) as intercept, round(regr_r2({y}, mean_mle), 5) as r2 from {{s}}"
_BOTH = ("mean_keyword", "smooth_detection")

QUERIES = {
    f.__name__: f
    for f in (
        fulltext_half_year, fulltext_policy, fulltext_oa, fulltext_intervals, event_detector_daily, detector_monthly, method_merge, detector_smooth, spearman, spearman_p, ols_line, ols_grid, bootstrap_band, method_series, method_correlations, method_lines, detector_enrich, llm_classify,
        label_repair, policy_vote, arrival_windows,
    )
}
SQL = {
    "fulltext_half_year": f"with {_FULL} {_moments('full_texts', 'year, half_year', 'x')}",
    "fulltext_policy": f"with {_FULL} {_moments('full_texts', 'year, half_year, has_policy', 'x')}",
    "fulltext_oa": f"with {_FULL} {_moments('full_texts', 'year, half_year, is_oa', 'x')}",
    "event_detector_daily": f"with e as (select cast(ts as date) as day, try_cast(json_extract_string(props, '$.k') as double) / 100 as rate from events) {_moments('e', 'day', 'rate')}",
    "detector_monthly": f"{_DETECT} {_moments('det', 'year, month', 'rate')}",
    "method_merge": f"{_DETECT} select date, year, month, count_keyword, round(mean_keyword, 8) as mean_keyword, count_detector, round(mean_detector, 8) as mean_detector from m",
    "detector_smooth": f"{_DETECT} select date, round(keyword, 8) as keyword, round(detector, 8) as detector from s",
    "spearman": f"""{_DETECT}, r as (select rank() over (order by keyword) + (count(*) over (partition by keyword) - 1) / 2.0 as a, rank() over (order by detector) + (count(*) over (partition by detector) - 1) / 2.0 as b from s where keyword is not null and detector is not null)
      select count(*) as n, round(corr(a, b), 8) as rho from r""",
    "ols_line": f"{_DETECT} select regr_count(mean_detector, mean_keyword) as n, round(regr_slope(mean_detector, mean_keyword), 8) as slope, round(regr_intercept(mean_detector, mean_keyword), 8) as intercept, round(regr_r2(mean_detector, mean_keyword), 8) as r2 from m",
    "ols_grid": f"""{_DETECT}, f as (select min(mean_keyword) as lo, max(mean_keyword) as hi, regr_slope(mean_detector, mean_keyword) as b, regr_intercept(mean_detector, mean_keyword) as a from m where mean_detector is not null)
      select cast(k as int) as k, round(lo + (hi - lo) * k / 99, 8) as x, round(a + b * (lo + (hi - lo) * k / 99), 8) as y from f, range(100) r(k)""",
    "method_series": three_sql("select date, count_keyword, round(mean_keyword, 6) as mean_keyword, count_mle, round(mean_mle, 6) as mean_mle, round(mean_detection, 6) as mean_detection, round(smooth_detection, 6) as smooth_detection from {s} order by date"),
    "method_correlations": three_sql(" union all ".join(_RANKED.format(y=y) for y in _BOTH)),
    "method_lines": three_sql(" union all ".join(_LINE.format(y=y) for y in _BOTH)),
    "detector_enrich": f"""with c as (select doc_id, substring({_STRIPPED.format(c='text')}, 1, 50000) as t from documents)
      select doc_id, round(cast('0x' || substring(md5(t), 1, 4) as int) % 101 / 100.0::double, 8) as rate from c""",
    "llm_classify": """with p as (select doc_id, lower(text) as t from documents where doc_kind = 'policy' and regexp_matches(text, '[^\\s\\p{Z}]')),
      c as (select doc_id, t, case when contains(t, 'must not') or contains(t, 'shall not') then 'Strict Prohibition' when contains(t, 'must') then 'Disclosure Required' else 'Not Mentioned' end as category from p)
      select doc_id, category, case when category <> 'Disclosure Required' then '' when contains(t, 'methods') then 'Methods' else 'Not Specified' end as disclosure_location, false as failed from c""",
    "arrival_windows": f"""with {MARKED}, a as (select cast(floor(epoch(ingested_at) / 2592000) as bigint) as w, regexp_matches(lower(abstract), '{text.word_pattern(text.MARKER_WORDS, plain=True)}') as hit from paper where regexp_matches(abstract, '[^\\s\\p{{Z}}]') and ingested_at is not null),
      g as (select w, count(*) as count, avg(cast(hit as int)) as mean from a group by w)
      select timestamp '1970-01-01' + to_days(cast(30 * w as int)) as window_start, count, round(mean, 8) as mean, {wilson_sql('mean', 'count')} from g""",
    "label_repair": f"with {_BALLOT} select journal_id, run, category, disclosure_location from ballots",
    "policy_vote": f"""with {_BALLOT}, c as (select journal_id, category, disclosure_location, count(*) as n, min(run) as first from ballots group by all),
      w as (select * from c qualify row_number() over (partition by journal_id order by n desc, first) = 1),
      r as (select b.journal_id, b.category, b.disclosure_location, b.reason, count(*) as n, min(run) as first from ballots b join w on b.journal_id = w.journal_id and b.category = w.category and b.disclosure_location is not distinct from w.disclosure_location group by all)
      select journal_id, category, disclosure_location, reason from r qualify row_number() over (partition by journal_id order by n desc, first) = 1""",
}
