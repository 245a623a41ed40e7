"""Labels by ordered rules: exclusions, an exact mapping, then the first rule of which the text holds a part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions.text import strip

Rules = Sequence[tuple[str, Sequence[str]]]

#: Categories and the parts of a text that give them, in order of precedence, for purposes that must be clear.
STRICT = [
    ("Language & Grammar Support", ["grammar", "spelling", "language editing", "english", "linguistic", "grammatical", "language improvement", "language check", "proofreading"]),
    ("Writing & Editing Support", ["editing", "readability", "clarity", "writing assistance", "revision", "manuscript editing", "text editing", "language revision"]),
    ("Style & Formatting", ["formatting", "style", "phrasing", "tone", "graphical", "title"]),
    ("Content Creation & Generation", ["generation", "creation", "writing content", "content creation", "abstract writing", "manuscript writing", "text generation", "co-author"]),
    ("Reference & Citation Support", ["citation", "reference", "bibliography"]),
    ("Translation Services", ["translation", "translate"]),
    ("Error Analysis & Others", ["assist", "help", "support", "aid", "code", "programming", "debug"]),
]
#: The same for purposes that all get a category.
LENIENT = [
    ("Language & Grammar Support", ["grammar", "spelling", "language editing", "english", "linguistic", "grammatical", "language improvement", "language check"]),
    ("Writing & Editing Support", ["proofreading", "editing", "readability", "clarity", "writing", "revision", "manuscript", "text editing", "language revision"]),
    ("Style & Formatting", ["formatting", "style", "phrasing", "tone", "graphical", "title"]),
    ("Content Creation & Generation", ["generation", "creation", "writing", "content", "abstract", "manuscript", "text generation", "co-author"]),
    ("Reference & Citation Support", ["citation", "reference", "bibliography"]),
    ("Translation Services", ["translation", "translate"]),
]
#: The same for the items of a list.
LISTED = [
    ("Language & Grammar Support", ["grammar", "spelling", "language"]),
    ("Writing & Editing Support", ["writing", "editing", "quality", "clarity", "readability"]),
    ("Style & Formatting", ["style", "tone", "format", "punctuation"]),
    ("Content Creation & Generation", ["content", "generation", "creation", "drafting", "manuscript"]),
    ("Reference & Citation Support", ["reference", "citation"]),
    ("Translation Services", ["translation", "translate"]),
    ("Text Processing & Refinement", ["text", "revision", "refining", "polishing", "paraphras", "summar"]),
]
OTHER = "Error Analysis & Others"
#: Texts that are no purpose of an author but what a study is about, or nothing.
EXCLUDED = """
evaluate the capabilities of AI systems
case study to discuss opportunities and challenges in medical education
processing and integrating complex data
Demonstration video
capturing nuanced biases in peer review
Providing a quote
data analysis
tagging and retrieval capabilities for efficient and thorough analysis
Enhancing social role and humaneness in interactions
creating more natural conversations by logging input-response history
querying about amblyopia and comparing answers
analyzing political statements
Identifying healthcare needs
response to the Home Blood Pressure Monitoring (HBPM) knowledge checklist
supporting the oncological workflow by helping confirm the absence or presence of lesions
Quantifying confidence shifts
tackle the side effects of PLEs from the learner and learning perspective
personalised learning
integrating AI-driven components into curricula
development of conversational technologies
answering medical questions
assessing quality by comparing seminal ideas of assignments
Unspecified
""".strip().split("\n")


def first_rule(text: Column, rules: Rules, default: str | None = None) -> Column:
    """Label of the first rule of which the lower-cased ``text`` holds a part; ``default`` if none, and for null."""
    low, label = F.lower(text), None
    for name, parts in rules:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(F.lit(default).cast("string"))


def categorise(df: DataFrame, text: str, rules: Rules, known: DataFrame | None = None, excluded: Sequence[str] = (), default: str | None = None, name: str = "category") -> DataFrame:
    """``df`` with the category of ``text``.

    Blank, null, "unspecified" and ``excluded`` texts get ``default``. ``known`` (text, category) maps whole texts and
    goes before the rules; it must have one row a text.
    """
    value = strip(F.col(text))
    none = F.coalesce((value == "") | (F.lower(value) == "unspecified") | value.isin(list(excluded)), F.lit(True))
    label = first_rule(value, rules, default)
    if known is not None:
        df = df.join(known.select(F.col("text").alias("_t"), F.col("category").alias("_c")), value == F.col("_t"), "left")
        label = F.coalesce("_c", label)
    out = df.withColumn(name, F.when(none, F.lit(default).cast("string")).otherwise(label))
    return out.drop("_t", "_c") if known is not None else out


def categorise_items(df: DataFrame, key: str, items: str, rules: Rules, known: DataFrame, default: str = OTHER, name: str = "categories") -> DataFrame:
    """(key, name): the sorted distinct categories of the items of an array column, empty for none."""
    each = df.select(key, F.explode(items).alias("_item"))
    placed = categorise(each, "_item", rules, known, default=default)
    found = placed.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias(name))
    return df.select(key).join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def distinct_users(df: DataFrame, user: str, items: str, rules: Rules, known: DataFrame, default: str = OTHER) -> DataFrame:
    """(category, users, percent): how many distinct users have an item of each category, and their share of all users
    that have any item."""
    each = categorise(df.select(user, F.explode(items).alias("_item")), "_item", rules, known, default=default).where(F.col(user).isNotNull())
    total = each.agg(F.count_distinct(user)).scalar()
    counts = each.groupBy("category").agg(F.count_distinct(user).alias("users"))
    return counts.select("category", "users", (100.0 * F.col("users") / total).alias("percent"))
