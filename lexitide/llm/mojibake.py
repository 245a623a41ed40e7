"""Garbled characters from decoding with a wrong encoding: transformations learned from near-twins.

Words with non-ASCII characters are joined, together with their neighbours, with other words that are equal once all
non-ASCII characters are stripped: near-twins of each other, of which the commonest spelling is taken as clean. The ASCII
characters are anchors by which the rest is aligned, giving pairs of a garbled and a clean run. Each pair votes for the
transformations (encode with one encoding, decode with another) that explain it; the smallest set of these that
explains the pairs is learned and then inverted in all records. Inverting a multi-byte transformation is checked by the
byte pattern; for single-byte ones, whose garbled characters are themselves correct elsewhere, counts of each
character between its neighbours over the whole corpus decide.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.plans.lineage import cut

#: Encodings in which text was written, and those with which it may have been read.
WRITTEN = ("utf-8", "cp1252", "cp850", "mac_roman")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "iso8859-5", "iso8859-15", "koi8-r", "cp1253", "cp1254", "cp866")
#: Scripts whose letters stand alone in texts of other scripts; letters of the rest need a neighbour of their own script.
ALONE = ("LATIN", "GREEK", "CYRILLIC")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
FOREIGN = re.compile("[^\x00-\x7f]+")
LETTER = re.compile(r"[^\x00-\x7f\s]+")
#: ASCII letters that a word with its neighbours must hold, by which near-twins are told from words that only lack letters.
ANCHORS = 2
#: Spellings of one key that are compared in one task; more are parted.
LISTED = 10_000


@cache
def _read_table(name: str) -> str:
    """Character of each byte; bytes without one give the control character of their number."""
    return "".join(codecs.decode(bytes([b]), name, "ignore") or chr(b) for b in range(256))


@cache
def _bytes_of(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_read_table(name))))}


@cache
def _written(name: str) -> dict[str, int]:
    return _bytes_of(name)


def garble(text: str, written: str, read: str) -> str | None:
    """``text`` written in one encoding and read in another; None if it can't be written."""
    if written == "utf-8":
        raw: list[int] = list(text.encode("utf-8", "surrogatepass"))
    else:
        table = _written(written)
        if any(c not in table for c in text):
            return None
        raw = [table[c] for c in text]
    return "".join(_read_table(read)[b] for b in raw)


def explanations(garbled: str, clean: str) -> list[str]:
    """Transformations that turn ``clean`` into ``garbled``; twofold ones are marked by ``*2``."""
    out = []
    for w in WRITTEN:
        for r in READ:
            if w == r or w != "utf-8" and len(garbled) != len(clean):
                continue
            once = garble(clean, w, r)
            if once == garbled:
                out.append(f"{w}>{r}")
            elif w == "utf-8" and once is not None and len(once) < len(garbled) and garble(once, w, r) == garbled:
                out.append(f"{w}>{r}")
    return out


@cache
def _script(c: str) -> str:
    """Script of a letter or mark by its name, Latin for all below Greek; empty for other characters."""
    if unicodedata.category(c)[0] not in "LM":
        return ""
    return "LATIN" if c < "\u0370" else unicodedata.name(c, "").split(" ")[0]


def foreign_words(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the words of ``text`` with a non-ASCII character, in time proportional to its length."""
    end = 0
    for m in LETTER.finditer(text):
        if m.start() < end:
            continue
        start, end = m.start(), m.end()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        yield start, end


def strip(text: str) -> str:
    return re.sub(r"[^\x00-\x7f]+", "", text)


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Pairs of differing runs between the ASCII characters that both share."""
    split = re.compile(r"([\x00-\x7f])")
    a, b = split.split(garbled), split.split(clean)
    return [(x, y) for x, y in zip(a[::2], b[::2], strict=True) if x != y and x and y] if len(a) == len(b) else []


def _kind(c: str) -> str:
    """Class of a neighbour."""
    if "a" <= c.lower() <= "z" and c.isascii():
        return c.lower()
    return "0" if c.isdigit() else "~" if c and not c.isascii() else " "


def _contexts(text: str) -> Iterator[tuple[str, str]]:
    """Non-ASCII characters with the classes of their neighbours."""
    for m in re.finditer(r"[^\x00-\x7f]", text):
        i = m.start()
        yield m.group(), _kind(text[i - 1 : i]) + _kind(text[i + 1 : i + 2])


class Repair:
    """Learned transformations in the form in which they are sent to the tasks."""

    def __init__(self, learned: list[str], seen: dict[tuple[str, str], int]):
        self.multi, self.single, self.seen = [], [], seen
        self.intact: set[str] = set()  # runs in which no transformation shows
        for t in learned:
            w, r = t.split(">")
            if w == "utf-8":
                table = _read_table(r)
                of = lambda lo, hi, table=table: "[" + "".join(re.escape(table[b]) for b in range(lo, hi + 1)) + "]"
                cont = of(0x80, 0xBF)
                pattern = re.compile(f"{of(0xF0, 0xF4)}{cont}{{3}}|{of(0xE1, 0xEF)}{cont}{{2}}|{of(0xC2, 0xDF)}{cont}")
                self.multi.append((pattern, _bytes_of(r)))
            else:
                back = {g: c for c in _written(w) if ord(c) > 0xA0 and (g := garble(c, w, r)) and g != c and ord(g) > 0x7F}
                self.single.append(back)
        suspects = "".join(sorted({c for back in self.single for c in back}))
        self.suspect = re.compile("[" + re.escape(suspects) + "]") if suspects else None

    @staticmethod
    def _decode(run: str, lone: Callable[[str], bool], pattern: re.Pattern, table: dict[str, int]) -> tuple[int, str]:
        """How many characters of a run of non-ASCII characters belong to sequences of bytes, and the run with these read.

        A sequence that begins with a letter of another script than Latin counts only if the run has nothing else, as words of
        that script have such sequences by chance; if it is two characters and the whole run, ``lone`` of the script decides. A
        letter of a script that does not stand alone needs another one of it next to it.
        """
        pieces: list[tuple[str, str]] = []  # as it stands, and as read
        at, foreign = 0, ""
        for m in pattern.finditer(run):
            try:
                c = bytes(table[x] for x in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                continue
            pieces += [(x, x) for x in run[at : m.start()]]
            pieces.append((m.group(), c))
            foreign = foreign or (x if (x := _script(m.group()[0])) != "LATIN" else "")
            at = m.end()
        pieces += [(x, x) for x in run[at:]]
        if foreign and (any(a == b for a, b in pieces) or len(run) == 2 and not lone(foreign)):
            return 0, run
        scripts = ["", *(_script(b) for _, b in pieces), ""]
        read = [b if len(a) > 2 or s in ("", *ALONE) or s in (scripts[k], scripts[k + 2]) else a for k, ((a, b), s) in enumerate(zip(pieces, scripts[1:-1], strict=True))]
        return sum(len(a) for (a, _), b in zip(pieces, read, strict=True) if a != b), "".join(read)

    def _undo(self, run: str, lone: Callable[[str], bool]) -> str:
        """A run with multi-byte transformations undone, each time the one that explains most of it, until none explains any;
        as every time makes the run shorter, this ends."""
        if run in self.intact:
            return run
        if not any(pattern.search(run) for pattern, _ in self.multi):
            if len(run) < 8 and len(self.intact) < 100_000:
                self.intact.add(run)
            return run
        while True:
            count, read = max((self._decode(run, lone, *t) for t in self.multi), key=lambda x: x[0], default=(0, run))
            if not count:
                return run
            run = read

    def __call__(self, text: str) -> tuple[bool, str, bool]:
        """Whether ``text`` is garbled, its restored form, and whether nothing stays lost.

        After the multi-byte transformations, single-byte ones are undone in the text as a whole or in single words of it.
        """
        native: set[str] | None = None

        def undo(m: re.Match) -> str:
            def lone(script: str) -> bool:
                """Whether a run of one sequence is beside a Latin letter, or no other run of the text is a word of its script."""
                nonlocal native
                if text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha():
                    return True
                if native is None:
                    left = (c for r in FOREIGN.findall(text) if len(r) != 2 and not any(self._decode(r, lambda s: True, *t)[0] == len(r) for t in self.multi) for c in r)
                    native = {_script(c) for c in left}
                return script not in native

            return self._undo(m.group(), lone)

        now = FOREIGN.sub(undo, text) if self.multi else text
        whole = now
        if self.suspect and self.suspect.search(now) and (whole := self._single(now)) == now:
            parts, at = [], 0
            for a, b in foreign_words(now):
                if self.suspect.search(now, a, b):
                    x = max(0, a - 1)
                    parts += [now[at:a], self._single(now[x : b + 1])[a - x : b - x]]
                    at = b
            whole = "".join([*parts, now[at:]])
        return whole != text or LOST.search(text) is not None, whole, LOST.search(whole) is None

    def _single(self, text: str) -> str:
        best = (0.0, text)
        around = list(_contexts(text)) if self.single else []
        for back in self.single:
            gain, strong = 0.0, False
            for c, near in around:
                if c in back:
                    g = np.log((self.seen.get((back[c], near), 0) + 0.5) / (self.seen.get((c, near), 0) + 0.5))
                    gain += max(-3.0, min(g, 6.0))
                    strong |= g > 3
            if strong and gain > max(best[0], 2.5):
                best = (gain, "".join(back.get(c, c) for c in text))
        return best[1]


def learn(texts: DataFrame, text: str, support: int = 3, contexts_max: int = 2_000_000) -> Repair:
    """The transformations that near-twins in the column ``text`` show.

    A transformation needs ``support`` distinct pairs of runs that no other learned one explains. What reaches the
    driver is bounded: votes by the set of explaining transformations, and counts of the single characters of the
    learned code pages (at most 256 each) by their two neighbours' classes (at most 29 each).
    """
    source = texts.select(F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(0).to_pylist():
                for a, b in foreign_words(t):
                    before, after = t[max(0, a - 24) : a].split()[-1:], t[b : b + 24].split()[:1]
                    key = "|".join(re.sub(r"\d+", "0", strip(x)) for x in (*(before or [""]), t[a:b], *(after or [""])))
                    if sum(map(str.isalpha, key)) >= ANCHORS:
                        n[key, re.sub(r"\d+", "0", t[a:b])] += 1
            k, w = zip(*n, strict=True) if n else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(w, pa.string()), pa.array(list(n.values()), pa.int64())], ["key", "word", "n"])

    spelled = cut(source.mapInArrow(words, "key string, word string, n long").groupBy("key", "word").agg(F.sum("n").alias("n")))
    clean = spelled.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("clean"), F.ceil(F.count("*") / LISTED).cast("int").alias("parts"), F.count("*").alias("k")).where("k > 1").drop("k")
    clean = cut(clean)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for g, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for p in align(g, c)]
            g, c = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(c, pa.string())], ["g", "c"])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["|".join(sorted(explanations(g, c))) for g, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["why"])

    # A key of many spellings is parted, so that none makes a large task.
    large = clean.where("parts > 1").select("key", F.col("parts").alias("of"))
    parted = spelled.join(large, "key", "left").select("key", "word", F.pmod(F.xxhash64("word"), F.coalesce("of", F.lit(1))).cast("int").alias("part"))
    meets = clean.select("key", "clean", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    runs = parted.join(meets, ["key", "part"]).where("word <> clean").select("word", "clean").mapInArrow(votes, "g string, c string").distinct()
    counted = runs.mapInArrow(explain, "why string").where("why <> ''").groupBy("why").count().collect()
    open_, learned = {r.why: r["count"] for r in counted}, []
    while open_:
        tally: Counter = Counter()
        for why, n in open_.items():
            for t in why.split("|"):
                tally[t] += n
        t, n = max(tally.items(), key=lambda x: (x[1], -READ.index(x[0].split(">")[1]), x[0]))
        if n < support:
            break
        learned.append(t)
        open_ = {why: n for why, n in open_.items() if t not in why.split("|")}
    found = Repair(learned, {})
    wanted = sorted({c for back in found.single for pair in back.items() for c in pair})
    if wanted:
        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = set(wanted)
            for batch in batches:
                n = Counter((c, k) for t in batch.column(0).to_pylist() for c, k in _contexts(t) if c in keep)
                c, k = zip(*n, strict=True) if n else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(k, pa.string()), pa.array(list(n.values()), pa.int64())], ["c", "k", "n"])

        seen = source.mapInArrow(near, "c string, k string, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).limit(contexts_max + 1).collect()
        if len(seen) > contexts_max:
            raise ValueError(f"more than {contexts_max} characters in context")
        found = Repair(learned, {(r.c, r.k): r.n for r in seen})
    return found


def restore(texts: DataFrame, key: str, text: str, repair: Repair) -> DataFrame:
    """(key, garbled, restored, whole) of each row: whether its text is garbled, the text with the learned
    transformations undone, and whether no character stays lost. Null and empty texts are not garbled."""
    shared = texts.sparkSession.sparkContext.broadcast(repair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = shared.value
        for batch in batches:
            rows = [(False, t, True) if t is None or t.isascii() else fix(t) for t in batch.column(1).to_pylist()]
            g, t, w = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g, pa.bool_()), pa.array(t, pa.string()), pa.array(w, pa.bool_())], ["k", "garbled", "restored", "whole"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, garbled boolean, restored string, whole boolean").withColumnRenamed("k", key)
