"""Problem 7: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexitide.operators.packed import split_packed
from lexitide.sources.tables import table

#: Bound of the list of known values that travels with the tasks.
KNOWN_MAX = 100_000


def known_values(spark: SparkSession, folder: str) -> list[str]:
    """All categories and domains, a list of fixed length whose bound is checked."""
    t = table(spark, folder, "category_domain")
    rows = t.selectExpr("explode(array(category, domain_name)) v").where("v is not null").distinct().limit(KNOWN_MAX + 1).collect()
    if len(rows) > KNOWN_MAX:
        raise ValueError(f"more than {KNOWN_MAX} known values")
    return [r.v for r in rows]


def p7_values(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    known = known_values(spark, folder)
    paper = split_packed(table(spark, folder, "paper"), "row_no", {"paper.country_list": "country_list", "paper.domain_list": "domain_list"}, known, least)
    journal = split_packed(table(spark, folder, "journal_csv"), "line_no", {"journal_csv.category": "category"}, known, least)
    return paper.unionByName(journal)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_values(spark, folder, least=2)


QUERIES = {"p7_found": p7_found, "p7_values": p7_values}
SQL: dict[str, str] = {}
