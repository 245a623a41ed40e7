"""Queries pN_... of the problems in this package, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import canon, copies, language, leaks, markup, mojibake, names, termfreq, tokenize
from lexitide.llm.sql import SQL as SQL
from lexitide.sources.tables import table

#: Terms of the suffixes from whose prefixes single terms are counted.
SUFFIX = 2
#: A text with more than white space.
NON_BLANK = r"[^\s\p{Z}]"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    paper = table(spark, folder, "paper")
    n_records = paper.where("abstract is not null").count()
    marked = termfreq.mark_terms(termfreq.term_frequencies(paper, "abstract", SUFFIX, longest=1), n_records)
    return marked.where("mark <> 'useful'").select("term", "mark")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    paper = table(spark, folder, "paper")
    n_records = paper.where("abstract is not null").count()
    return termfreq.mark_terms(termfreq.term_frequencies(paper, "abstract", SUFFIX, longest=1), n_records)


def p1_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Every word sequence of up to three terms with its numbers of occurrences and records."""
    return termfreq.term_frequencies(table(spark, folder, "paper"), "abstract", max_len=3)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling of a publisher with the name of its group."""
    spelled = table(spark, folder, "journal_info").select("publisher").unionAll(table(spark, folder, "publisher_stats").select("normalized_publisher"))
    return names.link_names(spelled, "publisher")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of one publisher, the form in which the problem asks for them."""
    groups = p2_groups(spark, folder)
    a, b = groups.toDF("name_a", "cluster"), groups.toDF("name_b", "cluster")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")


def _usages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "disclosure_df")
    purpose = d.where(F.col("usage_purpose").rlike(NON_BLANK)).select("disclosure_id", F.lit("usage_purpose").alias("field_name"), F.lit(1).alias("pos"), "usage_purpose")
    parts = d.select("disclosure_id", F.lit("journal_usage").alias("field_name"), F.posexplode(F.split("journal_usage", ";")).alias("pos", "val"))
    listed = parts.where(F.col("val").rlike(NON_BLANK)).select("disclosure_id", "field_name", (F.col("pos") + 1).alias("pos"), "val")
    return purpose.toDF("disclosure_id", "field_name", "pos", "val").unionByName(listed)


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    return canon.map_to_list(_usages(spark, folder), "val", table(spark, folder, "usage_canon"), "ref_id", "usage_label", same=canon.SAME, filler=canon.FILLER)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_values(spark, folder).select("disclosure_id", "field_name", "pos", "ref_id")


def p3_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with their number."""
    return p3_values(spark, folder).where("ref_id = 0").groupBy(F.trim("val").alias("val")).agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = markup.label_texts(table(spark, folder, "paper"), "row_no", "abstract", with_text=False)
    return marked.select("row_no", F.explode("kinds").alias("markup_kind"))


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every abstract as clean text that keeps headings, lists, code and formulas."""
    return markup.label_texts(table(spark, folder, "paper"), "row_no", "abstract")


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    paper = table(spark, folder, "paper").where(F.col("abstract").rlike(NON_BLANK))
    return language.detect(paper, "row_no", "abstract", "abstract_lang").drop("label", "segs")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    paper = table(spark, folder, "paper").where(F.col("abstract").rlike(NON_BLANK))
    label = F.lower(F.trim("label"))
    case = (F.col("segs") > 1) | label.isNull() | (label == "") | (label == "und") | (label != F.col("seg_lang"))
    return language.detect(paper, "row_no", "abstract", "abstract_lang").where(case).select("row_no", "seg_no", "seg_lang")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    paper = table(spark, folder, "paper").where(F.col("abstract").rlike(NON_BLANK))
    return copies.copy_pairs(paper, "row_no", ["paper_id", "abstract"]).select(F.col("rep").alias("row_no_a"), F.col("id").alias("row_no_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    paper = table(spark, folder, "paper").where(F.col("abstract").rlike(NON_BLANK))
    return copies.collapse_copies(paper, "row_no", ["paper_id", "abstract"]).select(F.col("rep").alias("row_no"), "copies")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "item_text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_spans(spark, folder).select("doc_id", "item_id").distinct()


def p9_removals(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.removal_spans(p9_spans(spark, folder))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents with their restored text and whether nothing stays lost."""
    documents = table(spark, folder, "documents")
    repaired = mojibake.restore(documents, "doc_id", "text", mojibake.learn(documents, "text"))
    return repaired.where("garbled").select("doc_id", "restored", "whole")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_restored(spark, folder).select("doc_id")


QUERIES = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
