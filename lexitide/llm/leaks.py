"""Held-out passages in a corpus: search through an FM-index of each shard.

A task cuts its documents into shards of a bounded number of words and builds an FM-index of each: suffix
array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. Phrases of the
test items are sought by backward search, all of a shard at once: pairs of words with any word between them, of which one at
least is left wherever exchanged words stand alone. Each occurrence is located by walking to the next sampled position; the
diagonals that agree enough are extended into the longest passages in which exchanged words stand alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a text: case, punctuation and spacing aside.
WORDS = re.compile(r"[^\W_]+")
#: Words of a shard; longer documents are cut into overlapping shards.
SHARD = 1 << 20
#: Distance of sampled positions in the text.
SAMPLED = 16


class WaveletMatrix:
    """Ranks over a sequence of small integers (Claude, Navarro and Ordóñez, 2015), many at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            b = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(values) - b.sum()))
            values = np.concatenate([values[b == 0], values[b == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` before ``i``."""
        lo = np.zeros_like(i)
        for level in range(self.bits):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            r, s = self.ones[level][i], self.ones[level][lo]
            i, lo = np.where(one, self.zeros[level] + r, i - r), np.where(one, self.zeros[level] + s, lo - s)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for level in range(self.bits):
            r = self.ones[level][i]
            one = (self.ones[level][i + 1] - r).astype(bool)
            c, i = (c << 1) | one, np.where(one, self.zeros[level] + r, i - r)
        return c


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; a suffix that ends sorts before its extensions."""
    n = len(values)
    rank, k = values.astype(np.int64) + 1, 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        pair = rank * (int(rank.max()) + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(np.diff(pair[order]) != 0)])
        if new[order[-1]] == n or k >= n:
            return order
        rank, k = new, 2 * k


class FMIndex:
    """Backward search and location over integers below ``(1 << bits) - 1`` that end with a zero; zero is not sought."""

    def __init__(self, values: np.ndarray, bits: int):
        order = suffix_array(values)
        none = (1 << bits) - 1  # before the first word
        self.n, self.tree = len(values), WaveletMatrix(np.where(order > 0, values[order - 1], none), bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << bits))])[:-1]
        self.sampled = order % SAMPLED == 0
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows of equally long phrases, one to a row."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
        return lo, hi

    def find_spaced(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, row): each row at which the first word of a pair, any word but the end of a text, and the second word begin."""
        last = np.unique(pairs[:, 1])
        lo, hi = self.find(last[:, None])
        rows = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        second = np.repeat(last, hi - lo)
        c = self.tree.access(rows)
        kept = (c != 0) & (c < (1 << self.tree.bits) - 1)
        c, rows, second = c[kept], rows[kept], second[kept]
        rows = self.first[c] + self.tree.rank(c, rows)
        c = self.tree.access(rows)
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[order], (c << 32) | second), len(keys) - 1)
        hit = keys[order][at] == (c << 32) | second
        c, rows = c[hit], rows[hit]
        return order[at[hit]], self.first[c] + self.tree.rank(c, rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            found[open_[done]] = self.positions[self.before[at[done]]] + steps[open_[done]]
            open_, at = open_[~done], at[~done]
            c = self.tree.access(at)
            rows[open_] = self.first[c] + self.tree.rank(c, at) + (c == 0)  # the last zero's row has no successor
            steps[open_] += 1
        return found


@dataclass
class Items:
    """Distinct texts of test items in the form in which they are sought."""

    ids: list[list[int]]  # all items of a text
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    phrases: dict[int, np.ndarray]  # by length, one to a row; those of length 0 are pairs with any word between them
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each phrase where its (text, place) begin


def prepare(items: list[tuple[int, str]]) -> Items:
    """Items with their pairs of words with one between. A text of one or two words is a phrase of its own."""
    vocabulary: dict[str, int] = {}
    ids: dict[tuple, list[int]] = defaultdict(list)
    for i, t in items:
        words = tuple(vocabulary.setdefault(w, len(vocabulary) + 2) for w in WORDS.findall((t or "").lower()))
        if words:
            ids[words].append(i)
    seeds: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for k, ws in enumerate(ids):
        if len(ws) < 3:
            seeds[len(ws)][ws].append((k, 0))
        for j in range(len(ws) - 2):
            seeds[0][ws[j], ws[j + 2]].append((k, j))
    places = {}
    for size, found in seeds.items():
        flat = np.array([p for ps in found.values() for p in ps], np.int64).reshape(-1, 2)
        places[size] = np.concatenate([[0], np.cumsum([len(ps) for ps in found.values()])]), flat[:, 0], flat[:, 1]
    phrases = {size: np.array(list(found), np.int64).reshape(-1, size or 2) for size, found in seeds.items()}
    return Items([sorted(set(i)) for i in ids.values()], [np.array(ws) for ws in ids], vocabulary, phrases, places)


def passages(doc: np.ndarray, item: np.ndarray, at: int, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) in ``doc`` of the passages of ``item`` along the diagonal on which the item's first word is at ``at``.

    A passage lies in one document, begins and ends with words that agree, and of two neighbouring words in it one at
    least agrees. It has ``least`` words or more, or is the whole item.
    """
    lo, hi = max(0, -at), min(len(item), len(doc) - at)
    same = np.flatnonzero(doc[at + lo : at + hi] == item[lo:hi]) + lo
    if not len(same):
        return
    ends = np.concatenate([[0], np.cumsum(doc[at + lo : at + hi] == 0)])  # ends of documents
    parts = np.flatnonzero((np.diff(same) > 2) | (ends[same[1:] - lo] > ends[same[:-1] - lo])) + 1
    for part in np.split(same, parts):
        a, e = int(part[0]), int(part[-1]) + 1
        if e - a >= min(least, len(item)):
            yield at + a, at + e


def _longest_run(same: np.ndarray) -> int:
    ends = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    return int((ends[1::2] - ends[::2]).max(initial=0))


def _explained(shard: np.ndarray, words: list[np.ndarray], found: list[tuple[int, int, int, int]], least: int, stock: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, end) of those of overlapping passages (first, end, text, diagonal) that no other text explains better.

    Another text explains a passage better if it agrees with more of its words; or with as many, and the passage has
    exchanged words in every stretch of ``least`` and the other's own passage agrees in more words. A passage with whose
    words more than ``stock`` texts agree alike is a stock phrase.
    """
    first, end = found[0][0], max(e for _, e, _, _ in found)
    agree = np.zeros((len(found), end - first + 1), np.int32)
    for r, (_, _, k, d) in enumerate(found):
        lo, hi = max(first, d), min(end, d + len(words[k]))
        agree[r, lo - first + 1 : hi - first + 1] = shard[lo:hi] == words[k][lo - d : hi - d]
    sums = agree.cumsum(axis=1)
    a, e, text = (np.array([f[x] for f in found]) for x in (0, 1, 2))
    own = sums[np.arange(len(found)), e - first] - sums[np.arange(len(found)), a - first]
    for c in range(len(found)):
        score = sums[:, e[c] - first] - sums[:, a[c] - first]
        other, level = text != text[c], score == own[c]
        if (score[other] > own[c]).any() or len(set(text[other & level].tolist())) >= stock:
            continue
        if (other & level & (own > own[c])).any() and _longest_run(agree[c, a[c] - first + 1 : e[c] - first + 1]) < min(least, len(words[text[c]])):
            continue
        yield int(text[c]), int(a[c]), int(e[c])


def _diagonals(index: FMIndex, items: Items) -> np.ndarray:
    """(text, place of its first word) of all diagonals on which a phrase occurs, one to a row."""
    found = [np.zeros((0, 2), np.int64)]
    for size, phrases in items.phrases.items():
        if size:
            lo, hi = index.find(phrases)
            hit = np.flatnonzero(hi > lo)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo[hit].tolist(), hi[hit].tolist(), strict=True)] or [np.zeros(0, np.int64)])
            phrase = np.repeat(hit, hi[hit] - lo[hit])
        else:
            phrase, rows = index.find_spaced(phrases)
        at = index.locate(rows)
        starts, text, place = items.places[size]
        n = starts[phrase + 1] - starts[phrase]
        each = np.repeat(starts[phrase] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        found.append(np.unique(np.stack([text[each], np.repeat(at, n) - place[each]], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _agreeing(shard: np.ndarray, items: Items, diagonals: np.ndarray, least: int, cells: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Those diagonals on which some stretch of ``least`` words, or the whole of a shorter text, has no two neighbours that differ."""
    padded = np.concatenate([shard, np.zeros(1, np.int64)])
    for k, words in enumerate(items.words):
        at = diagonals[diagonals[:, 0] == k, 1]
        size = min(least, len(words)) - 1  # pairs of neighbours
        for i in range(0, len(at), max(1, cells // len(words))):
            some = at[i : i + max(1, cells // len(words))]
            places = some[:, None] + np.arange(len(words))
            same = padded[np.where((places >= 0) & (places < len(shard)), places, len(shard))] == words
            apart = ~same[:, 1:] & ~same[:, :-1]
            sums = np.concatenate([np.zeros((len(some), 1), np.int32), apart.cumsum(1, dtype=np.int32)], 1)
            for d in some[(sums[:, size:] - sums[:, : sums.shape[1] - size]).min(1) == 0].tolist():
                yield k, d


def _search(shard: np.ndarray, items: Items, bits: int, least: int, stock: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, end) of the passages of a shard."""
    diagonals = _diagonals(FMIndex(shard, bits), items)
    found = sorted((*span, k, d) for k, d in _agreeing(shard, items, diagonals, least) for span in passages(shard, items.words[k], d, least))
    group: list[tuple[int, int, int, int]] = []
    reach = 0
    for f in found:
        if group and f[0] >= reach:
            yield from _explained(shard, items.words, group, least, stock)
            group = []
        reach = max(reach, f[1]) if group else f[1]
        group.append(f)
    if group:
        yield from _explained(shard, items.words, group, least, stock)


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, stock: int = 3, few: int = 3, items_max: int = 100_000) -> DataFrame:
    """(doc_id, item_id, first, last): passages of items in documents, as word numbers from 0.

    A passage is the whole item or at least ``least`` successive words of it, case, punctuation and spacing aside, in
    which single words, even every second one, may have been exchanged. It is no case where another item agrees with more of its words, or
    more than ``stock`` distinct texts with as many. ``few`` has no effect any more; rare words decide nothing. Items are a held-out set of bounded size (at most ``items_max``) and
    travel with the tasks. Null and empty texts and items match nothing; repeated documents and items each match.
    """
    held = items.select(F.col(item_id).cast("int").alias("i"), F.col(item_text).alias("t")).limit(items_max + 1).collect()
    if len(held) > items_max:
        raise ValueError(f"more than {items_max} items")
    ready = prepare([(r.i, r.t) for r in held])
    shared = docs.sparkSession.sparkContext.broadcast(ready)
    longest = max(map(len, ready.words), default=least)
    # A part keeps the passages that begin in it with the room of a passage on either side for those that overlap them.
    size = max(SHARD, 6 * longest)
    step = size - 3 * longest
    bits = max(1, (len(ready.vocabulary) + 2).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = known.vocabulary.get

        def search(parts: list[tuple[int, int, np.ndarray, bool]]) -> pa.RecordBatch:
            sizes = [len(w) + 1 for _, _, w, _ in parts]
            shard = np.zeros(sum(sizes), np.int64)
            starts = np.cumsum([0, *sizes[:-1]])
            for s, (_, _, w, _) in zip(starts, parts, strict=True):
                shard[s : s + len(w)] = w
            out = set()
            for k, first, end in _search(shard, known, bits, least, stock):
                d = int(np.searchsorted(starts, first, "right")) - 1
                doc, offset, _, last = parts[d]
                first, end = first - int(starts[d]), end - int(starts[d])
                if (offset == 0 or first >= longest) and (last or first < step + longest):
                    out |= {(doc, i, offset + first, offset + end - 1) for i in known.ids[k]}
            columns = list(zip(*sorted(out), strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "first", "last"])

        parts, held = [], 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.array([number(w, 1) for w in WORDS.findall(t.lower())], np.int64)
                for offset in range(0, max(1, len(words) - size + step), step):
                    part = words[offset : offset + size]
                    if held + len(part) > SHARD and parts:
                        yield search(parts)
                        parts, held = [], 0
                    parts.append((doc, offset, part, offset + size >= len(words)))
                    held += len(part) + 1
        if parts:
            yield search(parts)

    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("t <> ''")
    return texts.mapInArrow(run, "doc_id long, item_id int, first long, last long")


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, first, last, items): overlapping and adjacent passages of a document joined for removal, with the
    ids of the items that leaked there."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.distinct().withColumn("new", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int"))
    numbered = begun.withColumn("n", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return merged.drop("n")
