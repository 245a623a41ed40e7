"""Variant spellings of names: sparse top-n cosine joins of character n-grams and average-linkage clustering.

Names are reduced to forms (case, signs, legal suffixes and word order aside). Forms become vectors of character
n-grams, weighed by their rarity and, as endings are what people abbreviate, by their nearness to the word's beginning. A
prefix-filtered inverted index, a join on the few rarest n-grams that any pair above the threshold must share, finds all
pairs above a cosine threshold, of which the n nearest of each name, or all of them, are kept. The cosine decides; a
comparison of the words may then refine the result by taking links out (bodies of another place, subject, kind or
qualifier differ in one whole word). The links are grouped by average linkage on their cosines in rounds: clusters that
are each other's nearest merge, which gives the same tree as merging pair by pair, and no group is gathered in a task.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.edits import slips as _slips
from lexitide.plans.lineage import cut


@dataclass(frozen=True)
class Wording:
    """Words of a kind of name that make no difference, or that tell which part of a name counts."""

    #: Legal forms, dropped from the end.
    legal: frozenset[str] = frozenset("ltd limited inc incorporated llc plc corp corporation co company gmbh ag kg bv nv sa srl spa ev verlag publishing publ publisher pub".split())
    #: Words without weight.
    small: frozenset[str] = frozenset("the of for and de der des la le el und et in an a".split())
    #: Beginnings of words that tell what kind of body a name is.
    kinds: tuple[str, ...] = ("universit", "institut", "societ", "associat", "academ", "college", "foundation", "press", "school", "hospital", "center", "centre", "council")
    #: Words between an imprint and its owner.
    imprint: tuple[str, ...] = ("imprint", "division", "part", "unit", "brand", "member", "subsidiary")
    #: Long words of ``small`` and ``legal`` that are known with a slip too.
    small_slips: tuple[str, ...] = ("of", "for", "the", "and")
    legal_slips: tuple[str, ...] = ("publishing", "verlag", "limited")


#: Wording of publishers' names.
PUBLISHERS = Wording()
#: No wording at all: the rules are switched off.
NO_WORDING = Wording(frozenset(), frozenset(), (), (), (), ())


def _words(text: str, wording: Wording) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    folded = re.sub(r"\b([a-z])\.\s?([a-z])\.", r"\1\2", folded)
    words = re.findall(r"[^\W_]+", folded.replace("'", ""))
    return [w for w in words if w not in wording.small and not (len(w) <= 4 and any(_slips(w, x, 1) <= 1 for x in wording.small_slips))]


def _core(words: list[str], wording: Wording) -> list[str]:
    kept = list(words)
    while len(kept) > 1 and (kept[-1] in wording.legal or len(kept[-1]) > 5 and any(_slips(kept[-1], w, 1) <= 1 for w in wording.legal_slips)):
        kept.pop()
    return kept


def forms(name: str, wording: Wording = PUBLISHERS) -> list[str]:
    """Forms of a name, each its words sorted behind its first word; the first form is the name as a whole.

    A name that says of which publisher it is an imprint has the owner's form alone; where a bracket or a dash may
    part imprint and owner, both readings are given."""
    text, readings = " ".join(name.split()), []
    words = lambda t: _words(t, wording)
    core = lambda t: _core(words(t), wording)
    owned = wording.imprint and re.match(rf"^(.*?)[,;(\s-]+(?:an?\s+)?(?:{'|'.join(wording.imprint)})\s+of\s+(.+?)\)?$", text, re.I)
    if owned:
        text = owned.group(2)
    if m := re.match(r"^(.*?)\s*\(([^()]*)\)\s*$", text):
        before, inside = m.groups()
        initials = [w[0] for w in words(before)]
        short = re.sub(r"[^a-z]", "", inside.casefold())
        if len(inside.split()) == 1 and inside.isupper() and (len(inside) <= 5 or Counter(short) <= Counter(initials)):
            text = before
        else:
            text = inside
    elif m := re.match(r"^(.+?)\s+[-–—/]\s+(.+)$", text):
        before, after = m.groups()
        kind = [any(w.startswith(k[: max(4, len(w))]) or k.startswith(w) and len(w) >= 4 for k in wording.kinds) for w in words(before)]
        if not any(kind) and not (core(after) and all(any(w.startswith(k) for k in wording.kinds) for w in core(after))):
            readings.append(after)
        text = " ".join(core(after) + core(before))
    elif text.count(",") == 1:
        before, after = text.split(",")
        if not set(words(after)) <= wording.legal:
            text = " ".join(core(after) + core(before))
    out = []
    for t in (text, *readings):
        if kept := core(t):
            out.append(" ".join([kept[0], *sorted(kept[1:])]))
    return list(dict.fromkeys(out))


def _inside(short: str, long: str) -> bool:
    """Whether the letters of ``short`` occur in ``long`` in their order, its last one near the end or a consonant."""
    rest = iter(long)
    return all(c in rest for c in short) and short[-1] not in "aeiou"


def _word_cost(a: str, b: str) -> float | None:
    """0 for equal words and abbreviations, else the number of slips; None for other words."""
    if a == b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and long.startswith(short) and (len(short) >= 3 or long[0] == "p") and len(long) - len(short) >= 1:
        return 0.0 if len(long) - len(short) > 2 or long.endswith(("s", "es")) else 1.0
    if 3 <= len(short) <= 5 and len(long) - len(short) >= 2 and short[0] == long[0] and _inside(short, long):
        return 0.0
    if len(short) < 4:
        return None
    most = 2 if len(short) >= 8 else 1
    n = _slips(a, b, most)
    if n <= most:
        return float(n)
    if len(short) >= 4 and len(long) > len(short) + 2 and _slips(short, long[: len(short)], 1) <= 1:
        return 1.0  # a misspelt abbreviation
    return None


def agreement(a: str, b: str, slips: float = 2.0) -> float:
    """How well two forms name the same body by their words, from 0 to 1; 0 if a word is left over.

    A single word stands for a longer name that begins with it."""
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 1 and len(y) > 1:
        cost = min((c for w in y[:1] if (c := _word_cost(x[0], w)) is not None), default=None)
        return 0.0 if cost is None or len(x[0]) < 4 else max(0.0, 0.9 - 0.2 * cost)
    if len(x) != len(y):
        return 0.0
    total, free = 0.0, list(y)
    for w in sorted(x, key=len, reverse=True):
        options = [(c, v) for v in free if (c := _word_cost(w, v)) is not None]
        if not options:
            return 0.0
        c, v = min(options)
        total += c
        free.remove(v)
    return 0.0 if total > slips else 1.0 - 0.15 * total


#: Weight of each n-gram of a word relative to the one before it.
DECAY = 0.9
#: Entries of an n-gram's list that are joined in one task; longer lists are split.
LISTED = 2_000


def _grams(form: str, n: int) -> dict[str, float]:
    """Character n-grams of the words with their weights, which fall from each word's beginning to its end; they mark a
    word's beginning only, so an abbreviation shares all of its own."""
    out: dict[str, float] = {}
    for w in form.split():
        for i in range(max(1, len(w) + 2 - n)):
            g = f" {w}"[i : i + n]
            out[g] = out.get(g, 0.0) + DECAY**i
    return out


def _candidates(vectors: DataFrame, threshold: float, listed: int) -> DataFrame:
    """(a, b) with a < b: pairs that share one of the n-grams that come, rarest first, before the rest of either vector has
    a norm below the threshold. The list of an n-gram in more than ``listed`` such prefixes is parted; each two parts
    meet in a task of their own, so that no list is joined with itself in one task."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = sum(x["w"] ** 2 for x in v)
                rest = whole
                for x in v:
                    if rest < threshold**2 * whole * (1 - 1e-9):
                        break
                    out[0].append(f)
                    out[1].append(x["gram"])
                    rest -= x["w"] ** 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["f", "gram"])

    heads = cut(vectors.mapInArrow(prefixes, "f string, gram string"))
    lengths = heads.groupBy("gram").agg(F.ceil(F.count("*") / listed).cast("int").alias("parts")).where("parts > 1")
    parted = heads.join(lengths, "gram", "left").select("f", "gram", F.coalesce("parts", F.lit(1)).alias("parts"))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    meets = parted.select("f", "gram", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    meets = meets.select("f", "gram", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    both = meets.withColumnsRenamed({"f": "a", "own": "oa"}).join(meets.withColumnsRenamed({"f": "b", "own": "ob"}), ["gram", "p", "q"])
    return both.where("a < b and (p = q or oa <> ob)").select("a", "b").distinct()


def similar_pairs(items: DataFrame, form: str, n: int = 3, threshold: float = 0.4, power: float = 2.0, top: int | None = None, check: Callable[[str, str], float] | None = None, listed: int = LISTED) -> DataFrame:
    """(a, b, cosine[, agreed]) with a < b: pairs of distinct forms whose n-gram vectors have a cosine of ``threshold`` or more.

    An n-gram weighs its place in the word times the logarithm of its rarity to the ``power``. The join is exact. With
    ``top``, a pair is kept if it is among the ``top`` nearest of either form, equal ones by name; None, the default,
    keeps all. ``check`` refines the pairs that are left: only those where it is above 0, its value being ``agreed``, stay.
    Null and empty forms have no partner.
    """
    distinct = items.select(F.col(form).alias("f")).where("f <> ''").distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, g, c) for f in batch.column(0).to_pylist() for g, c in _grams(f, n).items()]
            f, g, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(g, pa.string()), pa.array(c, pa.float64())], ["f", "gram", "tf"])

    grams = cut(distinct.mapInArrow(explode, "f string, gram string, tf double"))
    total = grams.select("f").distinct().count()
    spread = grams.groupBy("gram").agg(F.count("*").alias("df"))
    weighed = grams.join(spread, "gram").withColumn("w", F.col("tf") * F.pow(F.log(F.lit(1.0 + total) / F.col("df")), power))
    vectors = cut(weighed.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "w"))).alias("v")))
    pairs = _candidates(vectors, threshold, listed)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, e: t + e.w * e.w))
    flat = vectors.select("f", F.transform("v", lambda e: F.xxhash64(e.gram)).alias("ids"), norm.alias("norm"), F.transform("v", lambda e: e.w).alias("ws"))
    side = lambda x: flat.select(F.col("f").alias(x), *[F.col(c).alias(c + x) for c in ("ids", "ws", "norm")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "idsa", "wsa", "norma", "idsb", "wsb", "normb")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of the weights that both vectors have, found by sorting those of all pairs of a batch at once."""
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            numbers = [np.repeat(np.arange(len(batch)), c.value_lengths().to_numpy(zero_copy_only=False)) for c in (columns[2], columns[5])]
            ids, ws = (np.concatenate([columns[i].flatten().to_numpy(), columns[i + 3].flatten().to_numpy()]) for i in (2, 3))
            pair = np.concatenate(numbers)
            order = np.lexsort((ids, pair))
            ids, ws, pair = ids[order], ws[order], pair[order]
            same = np.flatnonzero((ids[1:] == ids[:-1]) & (pair[1:] == pair[:-1]))
            dots = np.bincount(pair[same], ws[same] * ws[same + 1], len(batch))
            found = dots / np.maximum(columns[4].to_numpy() * columns[7].to_numpy(), 1e-300)
            kept = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(found)], ["a", "b", "cosine"]).filter(kept)

    near = both.mapInArrow(cosines, "a string, b string, cosine double")
    if top is not None:
        near = cut(near)
        ends = near.select(F.col("a").alias("x"), "*").unionByName(near.select(F.col("b").alias("x"), "*"))
        w = Window.partitionBy("x").orderBy(F.desc("cosine"), "a", "b")
        near = ends.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("a", "b", "cosine").distinct()
    if check is None:
        return near

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = [check(a, b) for a, b in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)]
            kept = pa.array([x > 0 for x in g], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g, pa.float64())], ["a", "b", "cosine", "agreed"]).filter(kept)

    return near.mapInArrow(checked, "a string, b string, cosine double, agreed double")


def components(links: DataFrame) -> DataFrame:
    """(item, component): the connected components of the links (a, b), by the least name in reach, in rounds.

    Each round passes the least name over the links and then follows the names found so far, so that few rounds are
    needed; no component is gathered.
    """
    arcs = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(arcs.groupBy("a").agg(F.least("a", F.min("b")).alias("l")))
    while True:
        passed = arcs.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        jumped = label.join(passed, "a").join(label.select(F.col("a").alias("l"), F.col("l").alias("j")), "l", "left")
        new = cut(jumped.select("a", F.least("l", "m", "j").alias("l"), (F.least("l", "m", "j") < F.col("l")).alias("moved")))
        label = new.select("a", "l")
        if new.where("moved").isEmpty():
            return label.toDF("item", "component")


#: Similarities are added up as whole numbers of this size for 1, so that sums do not depend on their order.
UNIT = 1_000_000_000


def _tree(links: list[tuple[str, str, int]], least: int) -> dict[str, str]:
    """Cluster of each item of a small component, by merging the nearest pair again and again."""
    near: dict[str, dict[str, int]] = {}
    for a, b, s in links:
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    size, parts = dict.fromkeys(near, 1), {a: [a] for a in near}
    heap = [(-s, a, b, 1, 1) for a, b, s in links if s >= least]
    heapq.heapify(heap)
    while heap:
        _, a, b, na, nb = heapq.heappop(heap)
        if size.get(a) != na or size.get(b) != nb:
            continue
        parts[a] += parts.pop(b)
        size[a] += size.pop(b)
        for c, s in near.pop(b).items():
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0) + s
                del near[c][b]
        del near[a][b]
        for c, s in near[a].items():
            mean = s / (size[a] * size[c])
            if mean >= least:
                heapq.heappush(heap, (-mean, *sorted((a, c)), *(size[x] for x in sorted((a, c)))))
    return {x: a for a, xs in parts.items() for x in xs}


def average_linkage(items: DataFrame, item: str, links: DataFrame, least: float, at_hand: int = 2_000) -> DataFrame:
    """(item, cluster): clusters of ``items`` by average linkage over ``links`` (a, b, s); pairs without a link count 0.

    A merge needs a mean similarity of ``least`` or more; ties go to the smaller names. Connected components of at
    most ``at_hand`` links are clustered in a task each. Larger ones are clustered in rounds: each merges all pairs
    of clusters that are each other's nearest, which average linkage allows in any order, so that no large
    component is gathered. Items without links are clusters of their own.
    """
    links = cut(links.groupBy("a", "b").agg(F.round(F.max("s") * UNIT).cast("long").alias("s")))
    least = round(least * UNIT)
    placed = links.join(components(links), F.col("a") == F.col("item")).drop("item")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    sized = cut(placed.join(sizes, "component"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _tree(list(zip(pdf["a"], pdf["b"], pdf["s"], strict=True)), least)
        return pd.DataFrame({"old": list(found), "new": list(found.values())})

    to = sized.where(F.col("size") <= at_hand).groupBy("component").applyInPandas(run, "old string, new string")
    large = sized.where(F.col("size") > at_hand).select("a", "b", "s")
    if not large.isEmpty():
        to = to.unionByName(_in_rounds(large, least))
    member = items.select(F.col(item).alias("item")).distinct()
    return member.join(to, F.col("item") == F.col("old"), "left").select("item", F.coalesce("new", "item").alias("cluster"))


def _in_rounds(links: DataFrame, least: int) -> DataFrame:
    """(old, new): the cluster of each item that some merge moved."""
    one = F.lit(1).cast("long")
    edges = cut(links.select("a", "b", "s", one.alias("na"), one.alias("nb")))
    merges = []
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("a").alias("x"), F.col("b").alias("y"), "na", "nb"), F.struct(F.col("b").alias("c"), F.col("a").alias("x"), F.col("b").alias("y"), "na", "nb")))
        scored = edges.withColumn("far", -(F.col("s").cast("double") / (F.col("na") * F.col("nb")).cast("double"))).where(F.col("far") <= -least).select("far", ends.alias("e"))
        # Of equally near ones the pair of the least names counts, by one order for both its ends.
        nearest = scored.groupBy("e.c").agg(F.min(F.struct("far", "e.x", "e.y", "e.na", "e.nb")).alias("p"))
        merged = nearest.groupBy("p.x", "p.y").agg(F.count("*").alias("k"), F.first(F.col("p.na") + F.col("p.nb")).alias("n"))
        merged = cut(merged.where("k = 2").select(F.col("y").alias("old"), F.col("x").alias("new"), "n"))
        if merged.isEmpty():
            break
        merges.append(merged.select("old", "new"))
        moves = merged.select("old", "new", "n").unionByName(merged.select(F.col("new").alias("old"), "new", "n"))
        moved = edges.join(moves.toDF("a", "ra", "ma"), "a", "left").join(moves.toDF("b", "rb", "mb"), "b", "left")
        moved = moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "s", F.coalesce("ma", "na").alias("na"), F.coalesce("mb", "nb").alias("nb")).where("a <> b")
        swap = F.col("a") > F.col("b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        edges = cut(moved.groupBy("a", "b").agg(F.sum("s").alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb")))
    if not merges:
        return links.where("false").select(F.col("a").alias("old"), F.col("b").alias("new"))
    to = merges[0]  # each name merges into another one at most once; chains are shortened by following them twice as far
    for m in merges[1:]:
        to = to.unionByName(m)
    for _ in range(len(merges).bit_length()):
        to = cut(to.join(to.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left").select("old", F.coalesce("next", "new").alias("new")))
    return to


def link_names(names: DataFrame, name: str, threshold: float = 0.25, least: float = 0.1, top: int | None = None, check: Callable[[str, str], float] | None = agreement, wording: Wording = PUBLISHERS, n: int = 4, power: float = 2.0) -> DataFrame:
    """(name, cluster): the group of variants of each distinct non-blank value of ``name``.

    Null and blank names are left out; repeated ones count once. Names whose forms are equal are variants; others
    are linked by ``similar_pairs`` on n-grams of ``n`` characters and grouped by ``average_linkage`` on their cosines.
    ``check`` takes out links between names that differ in a whole word; None leaves all decisions to the cosine. ``top``
    keeps the nearest links of each name alone; None keeps all. ``wording`` holds the words of this kind of name.
    """
    distinct = names.select(F.col(name).alias("name")).where(F.col("name").rlike(r"[^\s\p{Z}]")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, fs[0], f) for x in batch.column(0).to_pylist() for fs in [forms(x, wording) or [x]] for f in fs]
            x, f, g = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (x, f, g)], ["name", "form", "reading"])

    known = cut(distinct.mapInArrow(run, "name string, form string, reading string"))
    links = cut(similar_pairs(known, "reading", n, threshold, power, top, check).select("a", "b", F.col("cosine").alias("s")))
    # A name with a second reading goes by that where it is another name's first form or linked to one, else by its first.
    readings, first = known.select("form", "reading").distinct(), known.select("form").distinct()
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = ends.join(first, F.col("b") == F.col("form"), "left_semi").select(F.col("a").alias("reading")).unionByName(first.toDF("reading")).distinct()
    owners = readings.where("form <> reading").join(met, "reading", "left_semi").groupBy("form").agg(F.min("reading").alias("owner"))
    placed = cut(known.select("name", "form").distinct().join(owners, "form", "left").select("name", F.coalesce("owner", "form").alias("node")))
    nodes = placed.select("node").distinct()
    linked = links.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    grouped = average_linkage(nodes, "node", linked, least)
    return placed.join(grouped, F.col("node") == F.col("item")).select("name", "cluster")
