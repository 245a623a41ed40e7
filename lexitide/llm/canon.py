"""Mapping of freely entered values to a list of reference entries.

A symmetric-delete dictionary (all strings that arise from the beginning of a reference string by up to d deletions, pointing
back to it) is broadcast; a value's own deletions then find every reference string within edit distance d without a scan of
the list. Candidates are ranked by a weighted Damerau-Levenshtein distance and by how often the entry is used as
written. Values that are no misspelling of a whole entry are matched by words, each word through a second dictionary of
the same kind; an index of the entries' words gives the entries that can be covered enough, ranked by the share of
the entry's word weights that the value covers. The rest is reported as a miss.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.edits import slips

#: Words that frame a value or belong to no entry's sense.
FILLER = frozenset("a an and are as at be by doing for from how i in into is it my of on only or our partly some that the their them they to use used using was we were with help helped making manuscript".split())
#: Words that mean the same in such lists; all stand for the first of their line.
SAME = [
    ["trim", "cut", "reduce"],
    ["smooth", "flow", "fluent"],
    ["harmonise", "uniform", "unify", "consistent", "standardise"],
    ["terminology", "term"],
    ["write", "written", "wrote"],
    ["select", "choose", "chose", "choice", "pick"],
    ["alt", "alternative"],
    ["repair", "fix", "mend"],
    ["build", "built", "formulate"],
    ["plan", "planned"],
    ["debug", "bug"],
    ["reply", "response", "answer"],
    ["reviewer", "referee"],
    ["deck", "presentation"],
    ["glossary", "wordlist"],
    ["graphical", "graphic"],
    ["proof", "proofread"],
    ["lay", "plain"],
    ["image", "picture"],
]
#: Share of an entry's weight that is enough alone, and shares of a value's words that must belong to the entry where less
#: of it, or a fifth less still, is covered.
BOUNDS = (0.6, 0.3, 0.5)
ENDINGS = ("isations", "isation", "ications", "ication", "ations", "ation", "enings", "ening", "ings", "ing", "ions", "ion", "ened", "iers", "ier", "ies", "ied", "ers", "er", "ens", "en", "ed", "es", "s", "e", "y")


def plain(value: str) -> str:
    """Lower-cased words of ``value`` without accents and signs, joined by a blank."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return " ".join(re.findall(r"[^\W_]+", folded.replace("'", "")))


@lru_cache(100_000)
def stem(word: str) -> str:
    """``word`` without a common ending, a doubled last letter, and British spelling."""
    word = word.replace("colour", "color").replace("iz", "is") if len(word) > 4 else word
    for end in ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word.removesuffix(end)
            break
    if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "sl":
        word = word[:-1]
    return word


def distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance: swaps and doubled letters, the commonest slips, cost less; so do vowels
    for each other; a wrong first letter costs more."""
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            change = 0.0 if same else 1.2 if i == j == 1 else 0.8 if a[i - 1] in "aeiou" and b[j - 1] in "aeiou" else 1.0
            drop = 0.7 if i > 1 and a[i - 1] == a[i - 2] else 1.0
            add = 0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0
            least = min(rows[i - 1][j - 1] + change, rows[i - 1][j] + drop, row[j - 1] + add)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                least = min(least, rows[i - 2][j - 2] + 0.7)
            row.append(least)
        rows.append(row)
    return rows[-1][-1]


def deletions(word: str, most: int) -> set[str]:
    out = {word}
    for n in range(1, min(most, len(word)) + 1):
        for gone in combinations(range(len(word)), n):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


#: Characters of a string whose deletions are kept: strings within d edits have beginnings with a common deletion of d.
BEGINNING = 12


class DeleteIndex:
    """Strings by the deletions of their beginnings, as sorted arrays of hash values: equal ones are compared in full."""

    def __init__(self, words: list[str], most: int):
        self.most, self.words = most, list(dict.fromkeys(words))
        pairs = [(zlib.crc32(d.encode("utf-8", "surrogatepass")), k) for k, w in enumerate(self.words) for d in deletions(w[:BEGINNING], most)]
        hashes, owners = (np.array([p[x] for p in pairs], t) for x, t in ((0, np.uint32), (1, np.int32)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def near(self, word: str, most: int) -> list[tuple[float, str]]:
        """(weighted distance, string) of the strings within ``most`` edits, nearest first. Edits alone bound the search; the
        weights rank, and reject what is made of the dearest edits only."""
        own = np.array([zlib.crc32(d.encode("utf-8", "surrogatepass")) for d in deletions(word[:BEGINNING], min(most, self.most))], np.uint32)
        lo, hi = np.searchsorted(self.hashes, own, "left").tolist(), np.searchsorted(self.hashes, own, "right").tolist()
        found = {self.words[k] for a, b in zip(lo, hi, strict=True) if b > a for k in self.owners[a:b].tolist()}
        return sorted((x, w) for w in found if slips(word, w, most) <= most and (x := distance(word, w)) <= 1.2 * most)


def _alike(stems: dict[str, str], word: str) -> str:
    s = stem(word)
    return stems.get(s, stems.get(word, s))


class Mapper:
    """The reference list in the form in which it is broadcast."""

    def __init__(self, entries: list[tuple[int, str]], frequency: dict[str, int], most: int = 2, cover: float = 0.45, same: list[list[str]] = SAME, filler: frozenset[str] = FILLER, bounds: tuple[float, float, float] = BOUNDS):
        self.cover, self.frequency, self.filler, self.bounds = cover, frequency, filler, bounds
        self.groups = {stem(w): stem(line[0]) for line in same for w in line} | {w: stem(line[0]) for line in same for w in line}
        self.exact: dict[str, int] = {}
        for ref, label in sorted(entries):
            self.exact.setdefault(plain(label), ref)
        self.whole = DeleteIndex([w for w in self.exact if len(w) > 4], most)
        self.words = {ref: [k for k in dict.fromkeys(self.key(w) for w in text.split() if w not in self.filler)] for text, ref in self.exact.items()}
        spread = Counter(k for ks in self.words.values() for k in ks)
        self.weight = {k: math.log(1 + len(self.words) / n) for k, n in spread.items()}
        self.spelled = {w: self.key(w) for text in self.exact for w in text.split() if w not in self.filler and len(w) >= 5}
        self.inflected = {k + end: k for k in self.weight for end in ("", "s", "ing", "ed", "er", "ning", "ened") if len(k + end) >= 5}
        self.inflected |= {w: self.key(w) for line in same for w in line if len(w) >= 5 and self.key(w) in self.weight}
        self.by_spelling = DeleteIndex([*self.spelled, *self.inflected], 1)
        self.by_word = DeleteIndex([k for k in self.weight if len(k) >= 4], 1)
        self.uses = {ref: frequency.get(text, 0) for text, ref in self.exact.items()}
        self.ordered = sorted(k for k in self.weight if len(k) >= 5)
        self.longest = max(map(len, self.weight), default=0)
        self.mass = {ref: sum(self.weight[k] for k in keys) for ref, keys in self.words.items()}
        # An entry is listed under its weightiest keys alone: one whose other keys only are matched is not covered enough.
        least, self.listed = min(bounds[0], cover, 0.8 * cover), defaultdict(list)
        for ref, keys in self.words.items():
            rest = self.mass[ref]
            for k in sorted(keys, key=lambda k: (-self.weight[k], k)):
                if rest < least * self.mass[ref] * (1 - 1e-9):
                    break
                self.listed[k].append(ref)
                rest -= self.weight[k]

    def key(self, word: str) -> str:
        return _alike(self.groups, word)

    def match(self, word: str) -> dict[str, float]:
        """Keys of the entries' words that ``word`` may stand for, with a degree of agreement."""
        k = self.key(word)
        if k in self.weight:
            return {k: 1.0}
        out = {}
        if len(word) >= 4:  # a slip in a short word is weak evidence
            for x, known in [*self.by_word.near(k, 1), *self.by_word.near(word, 1)]:
                out[known] = max(out.get(known, 0.0), 0.75 if len(known) < 7 else 1 - 0.05 * x)
        for x, w in self.by_spelling.near(word, 1) if len(word) >= 5 else ():
            known, degree = (self.spelled[w], 1 - 0.08 * x) if w in self.spelled else (self.inflected[w], 0.75)
            out[known] = max(out.get(known, 0.0), degree)
        if not out:
            out = {part: 0.95 for i in range(len(word) - 4) for j in range(i + 5, min(len(word), i + self.longest) + 1) if (part := word[i:j]) in self.weight}
            if len(k) >= 5:
                at = bisect_left(self.ordered, k)
                while at < len(self.ordered) and self.ordered[at].startswith(k):
                    out[self.ordered[at]] = 0.95
                    at += 1
        return out

    def __call__(self, value: str) -> int:
        """Reference number of the entry meant by ``value``; 0 if none."""
        text = plain(value)
        if text in self.exact:
            return self.exact[text]
        if len(text) > 4 and (near := self.whole.near(text, 2)):
            return self.exact[min(near, key=lambda x: (x[0], -self.frequency.get(x[1], 0), x[1]))[1]]
        return self.by_words(plain(re.sub(r"\([^()]*\)", " ", value))) or self.by_words(text)

    def by_words(self, text: str) -> int:
        words = [w for w in text.split() if w not in self.filler]
        matches = [m for w in words if (m := self.match(w))]
        best, (alone, some, half) = (0.0, 0.0, 0, 0), self.bounds
        degree: dict[str, float] = {}
        for m in matches:
            for k, g in m.items():
                degree[k] = max(degree.get(k, 0.0), g)
        for ref in {ref for k in degree for ref in self.listed.get(k, ())}:
            keys = self.words[ref]
            covered = sum(self.weight[k] * degree.get(k, 0.0) for k in keys) / self.mass[ref]
            used = sum(any(k in m for k in keys) for m in matches) / max(1, len(words))
            if covered >= alone or covered >= self.cover and used >= some or covered >= 0.8 * self.cover and used >= half:
                best = max(best, (round(covered, 6), round(used, 6), self.uses[ref], -ref))
        return -best[3]


def map_to_list(values: DataFrame, value: str, reference: DataFrame, ref_id: str, label: str, entries_max: int = 100_000, same: list[list[str]] = SAME, filler: frozenset[str] = FILLER, cover: float = 0.45, bounds: tuple[float, float, float] = BOUNDS) -> DataFrame:
    """``values`` with ``ref_id``: the reference entry that the column ``value`` means, 0 for a miss.

    Values that are neither an entry nor within two slips of one are mapped by their words: ``same`` are groups of words that
    mean the same in this list, ``filler`` words that mean nothing in it, ``cover`` and ``bounds`` the shares of
    words that must agree. All should be set for the list at hand; the defaults suit purposes of writing aids.
    Null and blank values are misses. The reference list must be small (at most ``entries_max`` entries, checked)
    as its dictionary is broadcast; of entries spelled alike the smallest number counts. Values themselves are never
    gathered: each task maps its rows and remembers the values that it has seen.
    """
    spark = values.sparkSession
    entries = reference.select(F.col(ref_id).cast("int"), F.col(label)).where(F.col(label).isNotNull()).limit(entries_max + 1).collect()
    if len(entries) > entries_max:
        raise ValueError(f"more than {entries_max} entries")
    known = sorted({r[1] for r in entries})
    uses = values.where(F.col(value).isin(known)).groupBy(F.col(value).alias("v")).count().collect() if known else []  # at most one row an entry
    shared = spark.sparkContext.broadcast(Mapper([tuple(r) for r in entries], {plain(r[0]): r[1] for r in uses}, cover=cover, same=same, filler=filler, bounds=bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = lru_cache(100_000)(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(value)).to_pylist()
            refs = pa.array([mapped(v) if v and v.strip() else 0 for v in column], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, refs], [*batch.schema.names, "ref_id"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)
    return values.mapInArrow(run, f"{fields}, ref_id int")
