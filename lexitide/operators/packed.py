"""Fields that pack several values: dictionary-guided segmentation.

A multi-pattern automaton finds the known whole values in a field; dynamic programming then covers the field
with known values, quoted values and plain pieces at the least cost. Delimiters inside a known or quoted value
are thereby protected, whatever delimiter the rest of the field uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may part two values.
DELIMITER = r"\s*(?:[|;,/\n\t]|(?<=\s)and(?=\s))\s*"
#: What every text holds in which ``DELIMITER`` occurs.
HINT = r"[|;,/\n\t]|and"
#: Costs of covering a piece by a known value, by a quoted one, and by plain text up to a delimiter.
KNOWN, QUOTED, PLAIN = 0.0, 0.5, 1.0


class Automaton:
    """Finds all occurrences of a set of patterns in one pass (Aho and Corasick, 1975)."""

    def __init__(self, patterns: Iterable[str]):
        self.go: list[dict[str, int]] = [{}]
        self.out: list[list[int]] = [[]]
        for p in sorted({p for p in patterns if p}):
            at = 0
            for c in p:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.out.append([])
                at = self.go[at][c]
            self.out[at].append(len(p))
        self.fail, queue = [0] * len(self.go), list(self.go[0].values())
        for at in queue:
            for c, to in self.go[at].items():
                f = self.fail[at]
                while f and c not in self.go[f]:
                    f = self.fail[f]
                self.fail[to] = self.go[f].get(c, 0)
                self.out[to] = self.out[to] + self.out[self.fail[to]]
                queue.append(to)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for i, c in enumerate(text):
            while at and c not in self.go[at]:
                at = self.fail[at]
            at = self.go[at].get(c, 0)
            for n in self.out[at]:
                yield i + 1 - n, i + 1


class Segmenter:
    """Splits packed fields by a dictionary of known values; case is disregarded in the match."""

    def __init__(self, known: Iterable[str], delimiter: str = DELIMITER):
        self.automaton = Automaton(v.strip().lower() for v in known if v and v.strip())
        self.delimiter = re.compile(delimiter)
        self.quoted = re.compile(r'"((?:[^"]|"")*)"')

    def split(self, text: str | None) -> list[str]:
        """Non-empty values of ``text`` in order, trimmed and unquoted; none for a null or blank text."""
        if text is None or not text.strip():
            return []
        text = text.strip()
        low = text.lower() if len(text.lower()) == len(text) else text
        after = {m.start(): m.end() for m in self.delimiter.finditer(text)}
        after[len(text)] = len(text)
        stops = sorted(after)
        known: dict[int, list[int]] = {}
        for a, b in self.automaton.spans(low):
            if b in after:
                known.setdefault(a, []).append(b)
            elif text[b : b + 1] == '"' and text[a - 1 : a] == '"' and b + 1 in after:
                known.setdefault(a - 1, []).append(b + 1)
        best: dict[int, tuple[float, int, int, str]] = {}  # end of a cover that begins here: cost, pieces, next start, value
        best[len(text)] = (0.0, 0, len(text), "")

        def solve(start: int) -> None:
            options = []
            for stop in known.get(start, ()):
                options.append((KNOWN, stop, text[start:stop]))
            m = self.quoted.match(text, start)
            if m and m.end() in after:
                options.append((QUOTED, m.end(), m.group(1).replace('""', '"')))
            if start in after and start < len(text):
                options.append((0.0, start, ""))
            else:
                stop = next(s for s in stops if s > start)
                options.append((PLAIN, stop, text[start:stop]))
            best[start] = min((cost + best[after[stop]][0], (value != "") + best[after[stop]][1], after[stop], value) for cost, stop, value in options)

        starts, todo = {0}, [0]
        while todo:  # starts that a cover can reach
            start = todo.pop()
            reach = list(known.get(start, ()))
            m = self.quoted.match(text, start)
            if m and m.end() in after:
                reach.append(m.end())
            reach.append(start if start in after and start < len(text) else next((s for s in stops if s > start), len(text)))
            for stop in reach:
                if after[stop] not in starts:
                    starts.add(after[stop])
                    todo.append(after[stop])
        for start in sorted(starts, reverse=True):
            if start < len(text):
                solve(start)
        values, at = [], 0
        while at < len(text):
            _, _, at, value = best[at]
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] == '"':
                value = value[1:-1].replace('""', '"').strip()
            if value:
                values.append(value)
        return values


def split_packed(df: DataFrame, key: str, fields: dict[str, str], known: Iterable[str], least: int = 1, delimiter: str = DELIMITER) -> DataFrame:
    """(field_name, row_key, pos, val): one row for each value of the packed columns of ``df``.

    ``fields`` maps result names to columns; ``known`` are whole values that may hold delimiters of their own, a
    list small enough to travel with the tasks. Positions count from 1 over non-empty values and repeats are kept.
    Null, empty and blank fields and fields with fewer than ``least`` values give no row.
    """
    names, segmenter = list(fields), Segmenter(known, delimiter)
    packed = df.select(F.col(key).cast("long").alias("k"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields.values())])
    if least > 1 and delimiter == DELIMITER:  # what such a field must hold, in the JVM's syntax
        packed = packed.where(" or ".join(f"f{i} rlike '{HINT}'" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lru_cache(100_000)(segmenter.split)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, name in enumerate(names):
                for k, text in zip(keys, batch.column(i + 1).to_pylist(), strict=True):
                    values = split(text)
                    if values and len(values) >= least:
                        out[0].extend([name] * len(values))
                        out[1].extend([k] * len(values))
                        out[2].extend(range(1, len(values) + 1))
                        out[3].extend(values)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["field_name", "row_key", "pos", "val"])

    return packed.mapInArrow(run, "field_name string, row_key long, pos int, val string")
