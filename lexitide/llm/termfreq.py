"""Counts of every term and word sequence: suffix-sorted n-gram counting.

Each record is read as a sequence of terms. Every position yields the suffix that begins there, truncated
to ``max_len`` terms. Equal suffixes are counted in the task that read them, partial counts are routed by
their first term, sorted in reverse lexicographic order, and one pass with a stack closes every prefix when
the sort order has left it. One row of a suffix thus serves all its prefixes.

Record counts need no sets of record ids: if the k-term prefix of a suffix occurred earlier in the same
record, so did all its shorter ones. The length ``seen`` of the longest such prefix therefore tells which
prefixes of this suffix meet the record for the first time, and counts by ``seen`` merge by addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term: a longest run of letters.
TERM = r"\p{L}+"
#: Terms whose suffixes a task counts at once.
CHUNK = 2_000_000


class _Numbers(dict):
    """Numbers of terms from 1, given at first sight."""

    def __missing__(self, term: str) -> int:
        self[term] = n = len(self) + 1
        return n


def _suffixes(records: list[list[str]], max_len: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(suffix, seen, n): the distinct truncated suffixes of records of terms by the length ``seen`` of their longest prefix that
    occurred before in the same record, and their number."""
    terms = [t for r in records for t in r]
    sizes = np.array([len(r) for r in records], np.int64)
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms))
    record = np.repeat(np.arange(len(records), dtype=np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(terms))  # terms from here to the record's end
    gram, seen = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for k in range(min(max_len, int(sizes.max(initial=0)))):
        within = left > k
        following = np.zeros(len(terms), np.int64)
        following[: len(terms) - k] = ids[k:]
        _, gram = np.unique(gram * (len(numbers) + 1) + np.where(within, following, 0), return_inverse=True)
        first = np.zeros(len(terms), bool)
        first[np.unique(record * (int(gram.max()) + 1) + gram, return_index=True)[1]] = True
        seen += within & ~first
    _, at, n = np.unique(gram * (max_len + 1) + seen, return_index=True, return_counts=True)
    ends = at + np.minimum(left[at], max_len)
    return [" ".join(terms[a:e]) for a, e in zip(at.tolist(), ends.tolist(), strict=True)], seen[at], n


def _count(batches: Iterator[pa.RecordBatch], max_len: int) -> Iterator[pa.RecordBatch]:
    words = regex.compile(TERM)
    held: list[list[str]] = []
    size = 0

    def partial() -> pa.RecordBatch:
        suffix, seen, n = _suffixes(held, max_len)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(suffix, pa.string()), pa.array(seen, pa.int32()), pa.array(n, pa.int64())], ["suffix", "seen", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(words.findall(text.lower()))
            size += len(held[-1])
            if size >= CHUNK:
                yield partial()
                size = 0
    yield partial()


def _close(batches: Iterator[pa.RecordBatch], max_len: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of up to ``longest`` terms of the suffixes, which arrive in reverse lexicographic order."""
    stack: list[tuple[str, list[int]]] = []  # a term and its prefix's occurrences by `seen`
    out: tuple[list, list, list] = ([], [], [])

    def pop() -> None:
        by_seen = stack[-1][1]
        if len(stack) <= longest:
            out[0].append(" ".join(t for t, _ in stack))
            out[1].append(sum(by_seen))
            out[2].append(sum(by_seen[: len(stack)]))
        stack.pop()
        if stack:
            for k, n in enumerate(by_seen):
                stack[-1][1][k] += n

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["term", "occurrences", "records"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for suffix, seen, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = suffix.split(" ")
            shared = 0
            while shared < min(len(stack), len(terms)) and stack[shared][0] == terms[shared]:
                shared += 1
            while len(stack) > shared:
                pop()
            stack.extend((t, [0] * (max_len + 1)) for t in terms[shared:])
            stack[-1][1][seen] += n
        yield flush()
    while stack:
        pop()
    yield flush()


def term_frequencies(df: DataFrame, text: str, max_len: int = 1, salts: int = 16, longest: int | None = None) -> DataFrame:
    """(term, occurrences, records) of each sequence of up to ``longest`` terms in the column ``text``, by default ``max_len``.

    A term is a longest run of letters of the lower-cased text; a sequence has its terms joined by a blank and
    may span what lies between them. Suffixes are truncated to ``max_len`` terms, and shorter sequences are their
    prefixes. Null texts are no records and texts without letters add no term; an empty table gives an empty result. Only
    ``text`` is read, so other columns may have any name. The suffixes of one first term are spread over ``salts`` tasks by
    their second term and the prefixes that these share are added up, so a frequent first term makes no large task.
    """
    longest = longest or max_len
    partial = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(lambda b: _count(b, max_len), "suffix string, seen int, n long")
    head = F.substring_index("suffix", " ", 1)
    routed = partial.repartition(head, F.pmod(F.xxhash64(F.substring_index("suffix", " ", 2)), F.lit(salts)))
    closed = routed.sortWithinPartitions(F.desc("suffix")).mapInArrow(lambda b: _close(b, max_len, longest), "term string, occurrences long, records long")
    return closed.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_records: int, rare_max: int = 2, common_share: float = 0.2) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in at most ``rare_max`` records, ``common`` in more than
    ``common_share`` of ``n_records``, else ``useful``. A term that is both (a tiny table) is rare."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare_max, "rare").when(F.col("records") > common_share * n_records, "common").otherwise("useful"))
