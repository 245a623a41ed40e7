"""Text expressions. All are null for a null text unless said otherwise."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words that mark a text, in the order of their weights.
MARKER_WORDS = """
delve innovative meticulous pivotal underscore bolster commendable intricate realm revolutionize shed transformative
advancement emphasize endeavor enhance groundbreaking harness interplay invaluable multifaceted noteworthy nuanced
offer renowned seamless strategically streamline unravel valuable comprehensive vital profound adept align avenue
broader burgeon capability compelling comprehend contribute demonstrate distinctive elevate elucidate employ encompass
endure exceptional explore facilitate foster foundational garner grapple groundwork illuminate imperative inadequately
influence inherent integration interconnectedness intricacy juxtapose leverage notable nuance pave pioneer poised pose
predominantly recognize refine remarkable showcase surpass typically ultimately unlock unparalleled unveil uphold
utilize insight significant unwavering crucial highlight importance deeper perspective essential cutting-edge tapestry
impressively prowess holistic embark notably seamlessly excellently scholarly meticulously tangible methodical
fascinating intriguing
""".split()

#: White space at the ends, of any kind.
ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def read_words(path: str) -> list[str]:
    """The words of a JSON object {word: weight}; the weights are not used."""
    with open(path, encoding="utf-8-sig") as f:
        return list(json.load(f))


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, ENDS, "")


def non_blank(text: Column) -> Column:
    """Whether ``text`` has more than white space; false for null."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}]"), F.lit(False))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def _branches(words: list[str]) -> str:
    """Pattern of exactly these words in which common beginnings are tried once."""
    ends = "" in words
    by_first: dict[str, list[str]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    parts = [_quoted(c) + _branches(rest) for c, rest in sorted(by_first.items())]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
    return body + "?" if ends else body


def word_pattern(words: Iterable[str], plain: bool = False) -> str:
    """Pattern of any of ``words`` as a whole word, in a form that all common engines read alike; ``plain`` lists them."""
    body = "|".join(map(_quoted, words)) if plain else _branches(sorted(set(words)))
    return r"(^|[^\p{L}\p{N}_])(" + body + r")($|[^\p{L}\p{N}_])"


def has_word(text: Column, words: Iterable[str] = MARKER_WORDS) -> Column:
    """Whether ``text`` holds any of ``words`` as a whole word, whatever its case; false for null."""
    return F.coalesce(F.lower(text).rlike(word_pattern(words)), F.lit(False))


def count_words(text: Column, words: Iterable[str] = MARKER_WORDS) -> Column:
    """How many words of ``text`` are among ``words``, 0 for null. A word is letters joined by single hyphens."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}]+(?:-[\p{L}]+)*"), F.lit(0))
    return F.size(F.filter(found, lambda w: w.isin(list(words))))


def clean_text(text: Column, most: int = 50_000) -> Column:
    """Stripped and cut at ``most`` characters; null for a blank text."""
    stripped = strip(text)
    return F.substring(F.when(stripped != "", stripped), 1, most)


def percent(text: Column, bad: float | None = None) -> Column:
    """Number before a percent sign; ``bad`` for what is no number, for a blank and for null."""
    x = F.trim(F.regexp_replace(text, "%", "")).try_cast("double")
    return x if bad is None else F.coalesce(x, F.lit(float(bad)))


def normal_name(name: Column) -> Column:
    """Trimmed and in capitals, empty for null."""
    return F.upper(F.trim(F.coalesce(name, F.lit(""))))


def file_name_id(address: Column) -> Column:
    """An address in the form in which it is used as a file name."""
    return F.replace(F.replace(F.replace(address, F.lit("@"), F.lit("")), F.lit("://"), F.lit("___")), F.lit("/"), F.lit("_"))


#: Parts of journal names and their short forms, applied one after another.
SHORT_FORMS = [
    ("journal of", "j"), ("international journal", "int j"), ("proceedings of", "proc"), ("transactions on", "trans"), ("communications", "comm"), ("conference", "conf"), ("society", "soc"), ("association", "assoc"), ("research", "res"), ("science", "sci"),
    ("technology", "tech"), ("medicine", "med"), ("medical", "med"), ("engineering", "eng"), ("computer", "comp"), ("international", "int"), ("american", "am"), ("european", "eur"), ("national", "nat"),
]


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t))


def standard_name(name: Column, ascii_only: bool = False) -> Column:
    """A journal's name in a form by which spellings of it agree; empty for null.

    ``ascii_only`` leaves out the decomposition of accented letters, which is the one step that leaves the JVM.
    """
    name = F.coalesce(name, F.lit(""))
    name = F.lower(name if ascii_only else _decomposed(name))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    name = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SHORT_FORMS, name)
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def split_in_turn(text: Column, separators: Iterable[str] = (";", ",", " and ", "&"), dropped: Iterable[str] = ("unspecified",)) -> Column:
    """Pieces of ``text``, split by each separator in turn and trimmed between, without empty and ``dropped`` ones.

    Because pieces are trimmed between the turns, a separator that begins or ends with a blank is not found next to an
    earlier one. Null and blank texts give an empty array.
    """
    items = F.array(strip(F.coalesce(text, F.lit(""))))
    cut = lambda quoted: lambda x: F.split(x, quoted)
    for s in separators:
        items = F.flatten(F.transform(items, cut(_quoted(s))))
        items = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.filter(items, lambda x: ~F.lower(x).isin(list(dropped)) & (x != ""))


def members(text: Column, delimiter: str = "|", keep_blank: bool = False) -> Column:
    """Members of a delimited list as they stand; null counts as empty. Blank members stay only on demand."""
    parts = F.split(F.coalesce(text, F.lit("")), _quoted(delimiter))
    return parts if keep_blank else F.filter(parts, lambda x: F.trim(x) != "")


def json_number(text: Column, path: str) -> Column:
    """Number at a path of a JSON text; null for bad JSON, a missing path and what is no number."""
    return F.get_json_object(text, path).try_cast("double")
