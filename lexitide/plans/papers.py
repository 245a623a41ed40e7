"""The prepared frames that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import dates, text
from lexitide.operators import mixture, prevalence
from lexitide.plans.lineage import cut, stored
from lexitide.sources.tables import table

FLAGS = ("has_policy", "is_oa")
#: Grouping keys of each scenario.
SCENARIOS = {
    "half_year": ("year", "half_year"),
    "half_year_policy": ("year", "half_year", "has_policy"),
    "half_year_policy_category": ("year", "half_year", "policy_category"),
    "half_year_oa": ("year", "half_year", "is_oa"),
    "half_year_oa_policy": ("year", "half_year", "is_oa", "has_policy"),
    "half_year_domain": ("year", "half_year", "domain_list"),
    "half_year_country": ("year", "half_year", "country_list"),
    "policy_domain": ("year", "half_year", "has_policy", "domain_list"),
    "policy_country": ("year", "half_year", "has_policy", "country_list"),
    "oa_domain": ("year", "half_year", "is_oa", "domain_list"),
    "oa_country": ("year", "half_year", "is_oa", "country_list"),
    "month": ("year", "month"),
}


def dated(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a readable date, their periods, and settled flags."""
    paper = table(spark, folder, "paper").select("row_no", "paper_id", "abstract", "pub_date", "has_policy", "is_oa", "policy_category", "country_list", "domain_list", "journal_name")
    return prevalence.settle_flags(dates.with_periods(paper.withColumn("date", dates.read_date(F.col("pub_date")))), FLAGS)


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """Dated papers with a non-blank abstract and whether a marker word occurs in it."""
    return dated(spark, folder).where(text.non_blank(F.col("abstract"))).withColumn("has_keyword", text.has_word(F.col("abstract")))


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Word distributions of abstracts without and with a marker word; their number is bounded by the vocabulary."""
    paper = table(spark, folder, "paper").where("abstract is not null").select("abstract")
    return cut(mixture.distributions(paper, "abstract", text.has_word(F.col("abstract")), least=50))


def stored_lexicon(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The word distributions kept at ``path``; they are computed and written there the first time."""
    return stored(spark, path, lambda: lexicon(spark, folder)).select("word", F.col("p_human").cast("double"), F.col("p_ai").cast("double"))


def weighed(spark: SparkSession, folder: str, words: DataFrame | None = None) -> DataFrame:
    """Dated papers, blank abstracts too, with their two log probabilities by the lexicon ``words``, by default their own."""
    return mixture.log_probabilities(dated(spark, folder), "row_no", "abstract", lexicon(spark, folder) if words is None else words)


def in_members(df: DataFrame, keys: tuple[str, ...], keep_blank: bool) -> DataFrame:
    """``df`` with a row for each member of the list columns among ``keys``."""
    for k in keys:
        if k in ("domain_list", "country_list"):
            df = prevalence.each_member(df, k, keep_blank=keep_blank)
    return df
