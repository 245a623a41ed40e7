"""Enrichment by external services: clients are injected, so any service or a stand-in will do."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import text as t
from lexitide.operators.lookup import map_values

Client = Callable[[str], str]


def with_retries(client: Client, tries: int = 3, wait: float = 1.5, sleep: Callable[[float], None] = time.sleep, valid: Callable[[str], bool] | None = None) -> Client:
    """``client`` called up to ``tries`` times with pauses, until its answer is ``valid``; the last error comes out as a JSON text
    {"error": ...}, the last answer that is not valid as it stands."""

    def call(text: str) -> str:
        for k in range(tries):
            try:
                last = client(text)
                if valid is None or valid(last):
                    return last
            except Exception as x:
                last = json.dumps({"error": str(x)})
            if k + 1 < tries:
                sleep(wait)
        return last

    return call


def is_json_object(answer: str) -> bool:
    """Whether an answer is a JSON object."""
    try:
        return isinstance(json.loads(answer), dict)
    except (TypeError, ValueError):
        return False


def enrich(df: DataFrame, text: str, client: Client, result: str, pause: float = 0.0, tries: int = 1, wait: float = 1.5, valid: Callable[[str], bool] | None = None) -> DataFrame:
    """``df`` with the client's answer for each non-null text, asked by the tasks; ``pause`` seconds lie between calls of
    one task. Null texts are not sent and get null; a text is sent up to ``tries`` times, ``wait`` seconds apart, until the
    answer is ``valid``; an error of the client becomes a JSON text {"error": ...}."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{result}` string"
    ask = with_retries(client, tries, wait, valid=valid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for x in pdf[text]:
                answers.append(None if x is None else ask(x))
                if pause and x is not None:
                    time.sleep(pause)
            yield pdf.assign(**{result: answers})

    return df.mapInPandas(run, schema)


def stand_in_detector(text: str) -> str:
    """A detector that needs no network: its rate follows from the text's digest alone."""
    return json.dumps({"data": {"fakePercentage": int(hashlib.md5(text.encode()).hexdigest()[:4], 16) % 101}})


def stand_in_classifier(text: str) -> str:
    """A classifier of policy texts that needs no network: it looks for words and ignores meaning."""
    low = text.lower()
    category = "Prohibited" if "must not" in low or "shall not" in low else "Require Disclosure" if "must" in low else "none"
    return json.dumps({"category": category, "disclosure_location": " Methods " if "methods" in low else "Not Specified", "reason": text[:40]})


#: The labels, and spellings of them in a model's answers; any other text is the last label.
LABELS = ["Strict Prohibition", "Open", "Disclosure Required", "Not Mentioned"]
LABEL_SPELLINGS = {
    "Prohibitive": "Strict Prohibition",
    "Prohibited": "Strict Prohibition",
    "Prohibit": "Strict Prohibition",
    "Open Permission": "Open",
    "Open Use": "Open",
    "Disclosure-Required": "Disclosure Required",
    "Require Disclosure": "Disclosure Required",
    "Undefined": "Not Mentioned",
}


def decode_answers(df: DataFrame, answer: str, fields: tuple[str, ...] = ("category", "disclosure_location", "reason")) -> DataFrame:
    """``df`` with the stripped fields of JSON answers, empty where an answer lacks one, and ``failed``: whether the
    text is null or no JSON object; then the fields are null."""
    parsed = F.from_json(F.col(answer), ", ".join(f"{f} string" for f in (*fields, "_bad")), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_p", parsed).withColumn("failed", F.col("_p").isNull() | F.col("_p._bad").isNotNull())
    return out.withColumns({f: F.when(~F.col("failed"), t.strip(F.coalesce(F.col(f"_p.{f}"), F.lit("")))) for f in fields}).drop("_p")


def repair_labels(df: DataFrame, label: str, location: str) -> DataFrame:
    """``df`` with the standard spelling of ``label``; ``location`` is kept for required disclosures alone."""
    fixed = map_values(t.strip(F.col(label)), dict(zip(LABELS, LABELS, strict=True)) | LABEL_SPELLINGS, F.lit(LABELS[-1]))
    return df.withColumn(label, fixed).withColumn(location, F.when(F.col(label) == "Disclosure Required", F.col(location)).otherwise(F.lit("")))
