"""Journals: domains, publishers, open access, policies; disclosures and their purposes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text
from lexitide.operators import lookup, report, rules
from lexitide.queries.keywords import rounded
from lexitide.sources.tables import table

POLICIES = ["Disclosure Required", "Not Mentioned", "Open", "Strict Prohibition"]


def domain_first_category(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "journal_info")
    found = lookup.first_domain(j, "category", table(spark, folder, "category_domain"), "category", "domain_name")
    return found.groupBy("domain").agg(F.count("*").alias("journals"))


def domain_majority(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "journal_info")
    return lookup.majority_domain(j, "journal_id", "category", table(spark, folder, "category_domain"), "category", "domain_name")


def domain_policy_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Journals by domain and policy in long form."""
    domains = domain_majority(spark, folder)
    j = table(spark, folder, "journal_info").select("journal_id", F.coalesce("policy_category", F.lit("Unknown")).alias("policy_category"))
    return j.join(domains, "journal_id").groupBy("domain", "policy_category").agg(F.count("*").alias("journal_count"))


def category_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.frequencies(table(spark, folder, "journal_info").select(F.explode("category").alias("c")), F.trim("c"), "category")


def category_comma_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the flat list, split at every comma, inside names too."""
    parts = table(spark, folder, "journal_csv").select(F.explode(F.split("category", ",")).alias("c"))
    return lookup.frequencies(parts.where("trim(c) <> ''"), F.trim("c"), "category")


def publisher_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    """Journals by publisher and policy; publishers by the spelling of the statistics where case alone differs."""
    j = table(spark, folder, "journal_info")
    aliases = table(spark, folder, "publisher_stats").withColumn("k", text.normal_name(F.col("normalized_publisher")))
    named = lookup.look_up(j, text.normal_name(F.col("publisher")), aliases, "k", {"canon": "normalized_publisher"}, "stat_id", last=False)
    named = named.withColumn("name", F.coalesce("canon", "publisher"))
    return report.row_totals(lookup.crosstab(named, "name", "policy_category", POLICIES), POLICIES)


def oa_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Open-access journals by three definitions: a share above 0, a share above 0 with bad ones counting 0, and an
    ISSN in the directory (here that of journals of which at least half is open)."""
    j = table(spark, folder, "journal_info")
    share = text.percent(F.col("citable_oa"))
    directory = j.where(share >= 50).select("issn")
    known = lookup.membership(j.withColumns({"a": F.coalesce(share > 0, F.lit(False)), "b": text.percent(F.col("citable_oa"), bad=0) > 0}), "issn", directory, "issn")
    sums = known.agg(F.count("*").alias("total"), *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in (("positive", F.col("a")), ("parsed", F.col("b")), ("directory", F.col("is_member")))])
    rows = sums.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(n).alias("oa")) for n in ("positive", "parsed", "directory")])).alias("r"))
    return rounded(rows.select("r.definition", "r.oa", (F.col("total") - F.col("r.oa")).alias("non_oa"), "total", (100.0 * F.col("r.oa") / F.col("total")).alias("percent")))


def oa_bucket_stats(spark: SparkSession, folder: str) -> DataFrame:
    share = text.percent(F.col("citable_oa"))
    group = F.when(share.isNull(), "Unknown").when(share >= 50, "High OA (>=50%)").otherwise("Low OA (<50%)")
    return table(spark, folder, "journal_info").groupBy(group.alias("oa_group"), F.coalesce("policy_category", F.lit("Unknown")).alias("policy_category")).agg(F.count("*").alias("journal_count"))


def policy_status_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Journals of each domain with and without a policy; a missing category counts as a policy."""
    counts = domain_policy_counts(spark, folder)
    status = F.when(F.col("policy_category") == "Not Mentioned", "No Policy").otherwise("Has Policy")
    sums = counts.groupBy("domain", status.alias("status")).agg(F.sum("journal_count").alias("n"))
    wide = sums.groupBy("domain").pivot("status", ["Has Policy", "No Policy"]).agg(F.first("n")).na.fill(0)
    return report.row_totals(wide.toDF("domain", "has_policy", "no_policy"), ["has_policy", "no_policy"])


def name_lookup_match_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of the flat list have a journal record of their name."""
    flat, j = table(spark, folder, "journal_csv"), table(spark, folder, "journal_info").withColumn("k", text.normal_name(F.col("journal_name")))
    found = lookup.look_up(flat, text.normal_name(F.col("journal_name")), j, "k", {"journal_id": "journal_id"}, "journal_id")
    return rounded(lookup.match_rate(found, F.col("journal_id").isNotNull()))


def name_lookup_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of the flat list with the policy of the last journal record of its name."""
    flat, j = table(spark, folder, "journal_csv"), table(spark, folder, "journal_info").withColumn("k", text.normal_name(F.col("journal_name")))
    found = lookup.look_up(flat, text.normal_name(F.col("journal_name")), j, "k", {"journal_id": "journal_id", "policy_category": "policy_category"}, "journal_id")
    return found.select("line_no", "journal_id", "policy_category")


def percent_parses(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "journal_info")
    p = text.percent(F.col("citable_oa"))
    return j.select("journal_id", text.percent(F.col("citable_oa"), bad=0).alias("or_zero"), F.coalesce(p > 0, F.lit(False)).alias("positive"), p.alias("or_null"))


def journal_name_std(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "journal_info").select("journal_name").distinct()
    return names.select("journal_name", text.standard_name(F.col("journal_name")).alias("journal_name_std"))


def id_normalise_right_join(spark: SparkSession, folder: str) -> DataFrame:
    """All disclosures, with the date of the first delivery of their paper where there is one."""
    p = lookup.one_per_key(table(spark, folder, "paper").select("row_no", "paper_id", "pub_date"), "paper_id", "row_no", last=False)
    d = table(spark, folder, "disclosure_df").select("disclosure_id", text.file_name_id(F.col("paper_id")).alias("doc_id"))
    joined = p.withColumn("k", text.file_name_id(F.col("paper_id"))).join(d, F.col("k") == F.col("doc_id"), "right")
    return joined.select("disclosure_id", "doc_id", "row_no", "pub_date")


def disclosure_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Disclosures whose journal has a record, by the standard form of its name."""
    j = table(spark, folder, "journal_info").withColumn("k", text.standard_name(F.col("journal_name")))
    d = table(spark, folder, "disclosure_df")
    found = lookup.look_up(d, text.standard_name(F.col("journal_name")), j, "k", {"found_location": "disclosure_location", "found_id": "journal_id"}, "journal_id")
    return found.select("disclosure_id", "found_id", "found_location")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "usage_canon").select(F.col("usage_label").alias("text"), F.col("usage_group").alias("category"))


def usage_strict_category(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "disclosure_df").select("disclosure_id", "usage_purpose")
    return rules.categorise(d, "usage_purpose", rules.STRICT, _known(spark, folder), excluded=["other", "tbc"]).where("category is not null").select("disclosure_id", "category")


def usage_filtered_category(spark: SparkSession, folder: str) -> DataFrame:
    """The same without the published exclusions."""
    d = table(spark, folder, "disclosure_df").select("disclosure_id", "usage_purpose")
    return rules.categorise(d, "usage_purpose", rules.STRICT, _known(spark, folder), excluded=rules.EXCLUDED).where("category is not null").select("disclosure_id", "category")


def publisher_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty publishers of most journals; spellings that agree but for signs and case stand for the first of the statistics
    (the table of aliases)."""
    spelled = table(spark, folder, "journal_info").where(text.non_blank(F.col("publisher"))).select("publisher")
    key = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", "")
    known = table(spark, folder, "publisher_stats").select(F.col("normalized_publisher").alias("canonical"), key("normalized_publisher").alias("k")).where("k <> ''")
    aliases = spelled.distinct().select("publisher", key("publisher").alias("k")).join(known, "k").select(F.col("publisher").alias("alias"), "canonical")
    named = lookup.by_alias(spelled, "publisher", aliases, "alias", "canonical", "name")
    return lookup.most_frequent(lookup.frequencies(named, F.col("name"), "name"), "name", n=20)


def name_lookup_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten names of the flat list that have no journal record."""
    flat, j = table(spark, folder, "journal_csv"), table(spark, folder, "journal_info").withColumn("k", text.standard_name(F.col("journal_name"), ascii_only=True))
    found = lookup.look_up(flat, text.standard_name(F.col("journal_name"), ascii_only=True), j, "k", {"journal_id": "journal_id"}, "journal_id")
    return lookup.unmatched_sample(found, F.col("journal_id").isNotNull(), "journal_name")


def first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each paper."""
    rows = table(spark, folder, "paper").where("paper_id is not null").select("paper_id", "row_no", "pub_date")
    return lookup.first_row(rows, ["paper_id"], ["row_no"])


def usage_category(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "disclosure_df").select("disclosure_id", "usage_purpose")
    return rules.categorise(d, "usage_purpose", rules.LENIENT, _known(spark, folder), default=rules.OTHER).select("disclosure_id", "category")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "disclosure_df").select("disclosure_id", "journal_name", text.split_in_turn(F.col("journal_usage"), [";"]).alias("items"))


def usage_list_category(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.categorise_items(_items(spark, folder), "disclosure_id", "items", rules.LISTED, _known(spark, folder))
    return found.select("disclosure_id", F.concat_ws("|", "categories").alias("categories"))


def usage_items(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "disclosure_df")
    return d.select("disclosure_id", F.concat_ws("|", text.split_in_turn(F.col("usage_purpose"), [",", " and ", "&", ";"])).alias("items"))


def usage_journal_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rules.distinct_users(_items(spark, folder), "journal_name", "items", rules.LISTED, _known(spark, folder)))


def tool_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Disclosures by tool, spellings of a tool's name merged."""
    tool = F.lower(F.regexp_replace("ai_tool", r"\s+(v?\d+)$|\s", ""))
    return lookup.frequencies(table(spark, folder, "disclosure_df"), tool, "tool")


_J = "regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^$', '')"


def standard_name_sql(column: str) -> str:
    x = _J.format(c=column)
    for old, new in text.SHORT_FORMS:
        x = f"replace({x}, '{old}', '{new}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def rules_sql(value: str, table_rules: rules.Rules, default: str) -> str:
    whens = " ".join(f"when {' or '.join(f'''contains(lower({value}), '{p}')''' for p in parts)} then '{name}'" for name, parts in table_rules)
    return f"case {whens} else {default} end"


_STRIP = "regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_PURPOSE = _STRIP.format(c="usage_purpose")
_SHARE = "try_cast(trim(replace(citable_oa, '%', '')) as double)"
_MAJORITY = """votes as (select journal_id, domain_name, count(*) as n, min(pos) as first from (select journal_id, unnest(category) as category, generate_subscripts(category, 1) as pos from journal_info) join category_domain using (category) group by all),
best as (select journal_id, domain_name from votes qualify row_number() over (partition by journal_id order by n desc, first) = 1),
domains as (select journal_id, coalesce(domain_name, 'Unknown') as domain, coalesce(policy_category, 'Unknown') as policy_category from journal_info left join best using (journal_id))"""
_LISTED = f"""items as (select disclosure_id, journal_name, {_STRIP.format(c='i')} as item from (select disclosure_id, journal_name, unnest(string_split(journal_usage, ';')) as i from disclosure_df)),
placed as (select disclosure_id, journal_name, coalesce(usage_group, {rules_sql('item', rules.LISTED, f"'{rules.OTHER}'")}) as category from items left join usage_canon on item = usage_label where item <> '' and lower(item) <> 'unspecified')"""



def _turns() -> str:
    """A list of the pieces of a purpose, split by one separator after another."""
    items = f"list_filter([{_STRIP.format(c="coalesce(usage_purpose, '')")}], lambda i: i <> '')"
    for sep in (",", " and ", "&", ";"):
        items = f"list_filter(list_transform(flatten(list_transform({items}, lambda i: string_split(i, '{sep}'))), lambda i: {_STRIP.format(c='i')}), lambda i: i <> '')"
    return items


QUERIES = {
    f.__name__: f
    for f in (
        domain_first_category, domain_majority, domain_policy_counts, category_frequency, category_comma_frequency, publisher_crosstab, oa_definitions, oa_bucket_stats, policy_status_pivot, name_lookup_match_rate, name_lookup_last_wins,
        percent_parses, journal_name_std, id_normalise_right_join, disclosure_matches, usage_strict_category, usage_filtered_category, publisher_ranking, name_lookup_unmatched, first_deliveries, usage_category, usage_list_category, usage_items, usage_journal_counts, tool_counts,
    )
}
SQL = {
    "domain_first_category": "select coalesce(domain_name, 'Unknown') as domain, count(*) as journals from journal_info j left join category_domain d on j.category[1] = d.category group by 1",
    "domain_majority": f"with {_MAJORITY} select journal_id, domain from domains",
    "domain_policy_counts": f"with {_MAJORITY} select domain, policy_category, count(*) as journal_count from domains group by all",
    "category_frequency": "select trim(c) as category, count(*) as count from (select unnest(category) as c from journal_info) where c is not null group by 1",
    "category_comma_frequency": "select trim(c) as category, count(*) as count from (select unnest(string_split(category, ',')) as c from journal_csv) where trim(c) <> '' group by 1",
    "publisher_crosstab": """with a as (select upper(trim(coalesce(normalized_publisher, ''))) as k, arg_min(normalized_publisher, stat_id) as canon from publisher_stats group by 1),
      n as (select coalesce(canon, publisher) as name, policy_category as p from journal_info left join a on upper(trim(coalesce(publisher, ''))) = k)
      select name, count(*) filter (p = 'Disclosure Required') as "Disclosure Required", count(*) filter (p = 'Not Mentioned') as "Not Mentioned", count(*) filter (p = 'Open') as "Open", count(*) filter (p = 'Strict Prohibition') as "Strict Prohibition",
      count(*) filter (p in ('Disclosure Required', 'Not Mentioned', 'Open', 'Strict Prohibition')) as total from n where name is not null and p is not null group by name""",
    "oa_definitions": f"""with j as (select {_SHARE} as s, issn from journal_info), d as (select distinct issn from j where s >= 50 and trim(issn) <> ''),
      c as (select 'positive' as definition, count(*) filter (s > 0) as oa, count(*) as total from j union all select 'parsed', count(*) filter (coalesce(s, 0) > 0), count(*) from j
      union all select 'directory', count(*) filter (d.issn is not null), count(*) from j left join d using (issn))
      select definition, oa, total - oa as non_oa, total, round(100.0::double * oa / total, 8) as percent from c""",
    "oa_bucket_stats": f"""select case when s is null then 'Unknown' when s >= 50 then 'High OA (>=50%)' else 'Low OA (<50%)' end as oa_group, coalesce(policy_category, 'Unknown') as policy_category, count(*) as journal_count
      from (select *, {_SHARE} as s from journal_info) group by all""",
    "policy_status_pivot": f"with {_MAJORITY} select domain, count(*) filter (policy_category <> 'Not Mentioned') as has_policy, count(*) filter (policy_category = 'Not Mentioned') as no_policy, count(*) as total from domains group by domain",
    "name_lookup_match_rate": """with m as (select upper(trim(coalesce(journal_name, ''))) in (select upper(trim(coalesce(journal_name, ''))) from journal_info) as hit from journal_csv)
      select count(*) as total, count(*) filter (hit) as matched, round(100.0::double * count(*) filter (hit) / count(*), 8) as percent from m""",
    "name_lookup_last_wins": """with j as (select upper(trim(coalesce(journal_name, ''))) as k, max(journal_id) as journal_id, arg_max(coalesce(policy_category, '~'), journal_id) as p from journal_info group by 1)
      select line_no, journal_id, nullif(p, '~') as policy_category from journal_csv left join j on upper(trim(coalesce(journal_name, ''))) = k""",
    "percent_parses": f"select journal_id, coalesce({_SHARE}, 0) as or_zero, coalesce({_SHARE} > 0, false) as positive, {_SHARE} as or_null from journal_info",
    "journal_name_std": f"select distinct journal_name, {standard_name_sql('journal_name')} as journal_name_std from journal_info",
    "id_normalise_right_join": """with p as (select paper_id, min(row_no) as row_no, arg_min(coalesce(pub_date, '~'), row_no) as d from paper where paper_id is not null group by 1),
      n as (select replace(replace(replace(paper_id, '@', ''), '://', '___'), '/', '_') as k, row_no, nullif(d, '~') as pub_date from p),
      d as (select disclosure_id, replace(replace(replace(paper_id, '@', ''), '://', '___'), '/', '_') as doc_id from disclosure_df)
      select disclosure_id, doc_id, row_no, pub_date from d left join n on k = doc_id""",
    "disclosure_matches": f"""with j as (select {standard_name_sql('journal_name')} as k, max(journal_id) as found_id, nullif(arg_max(coalesce(disclosure_location, '~'), journal_id), '~') as found_location from journal_info group by 1)
      select disclosure_id, found_id, found_location from disclosure_df left join j on {standard_name_sql('journal_name')} = k""",
    "usage_strict_category": f"""select disclosure_id, category from (select disclosure_id, coalesce(usage_group, {rules_sql('v', rules.STRICT, 'null')}) as category
      from (select disclosure_id, {_PURPOSE} as v from disclosure_df) left join usage_canon on v = usage_label where v <> '' and lower(v) <> 'unspecified' and v not in ('other', 'tbc')) where category is not null""",
    "usage_filtered_category": f"""select disclosure_id, category from (select disclosure_id, coalesce(usage_group, {rules_sql('v', rules.STRICT, 'null')}) as category
      from (select disclosure_id, {_PURPOSE} as v from disclosure_df) left join usage_canon on v = usage_label where v <> '' and lower(v) <> 'unspecified' and v not in ({", ".join(f"'{x}'" for x in rules.EXCLUDED)})) where category is not null""",
    "publisher_ranking": """with j as (select publisher, regexp_replace(upper(publisher), '[^\\p{L}\\p{N}]+', '', 'g') as k from journal_info where regexp_matches(publisher, '[^\\s\\p{Z}]')),
      s as (select min(normalized_publisher) as canonical, regexp_replace(upper(normalized_publisher), '[^\\p{L}\\p{N}]+', '', 'g') as k from publisher_stats group by 2)
      select coalesce(canonical, publisher) as name, count(*) as count from j left join s on j.k = s.k and s.k <> '' group by 1 order by count desc, name limit 20""",
    "name_lookup_unmatched": f"""select distinct journal_name from journal_csv where journal_name is not null and {standard_name_sql('journal_name')} not in (select {standard_name_sql('journal_name')} from journal_info) order by journal_name limit 10""",
    "first_deliveries": "select paper_id, row_no, pub_date from paper where paper_id is not null qualify row_number() over (partition by paper_id order by row_no) = 1",
    "usage_category": f"""select disclosure_id, case when coalesce(v, '') = '' or lower(v) = 'unspecified' then '{rules.OTHER}' else coalesce(usage_group, {rules_sql('v', rules.LENIENT, f"'{rules.OTHER}'")}) end as category
      from (select disclosure_id, {_PURPOSE} as v from disclosure_df) left join usage_canon on v = usage_label""",
    "usage_list_category": f"""with {_LISTED}, c as (select disclosure_id, string_agg(category, '|' order by category) as categories from (select distinct disclosure_id, category from placed) group by 1)
      select disclosure_id, coalesce(categories, '') as categories from disclosure_df left join c using (disclosure_id)""",
    "usage_items": f"""select disclosure_id, array_to_string(list_filter({_turns()}, lambda i: lower(i) <> 'unspecified'), '|') as items from disclosure_df""",
    "usage_journal_counts": f"""with {_LISTED}, n as (select * from placed where journal_name is not null)
      select category, count(distinct journal_name) as users, round(100.0::double * count(distinct journal_name) / (select count(distinct journal_name) from n), 8) as percent from n group by category""",
    "tool_counts": "select lower(regexp_replace(ai_tool, '\\s+(v?\\d+)$|\\s', '', 'g')) as tool, count(*) as count from disclosure_df where ai_tool is not null group by 1",
}
