"""Encoding of texts with a public byte-level BPE vocabulary through a transducer lexicon.

Frequent words are compiled, with their ids, into a minimal acyclic automaton whose states are shared by all
words with the same remaining suffixes. Each edge carries the number of words that sort before the ones behind
it, so the sum along a path is the word's number, which points to its ids: the automaton is a transducer, and
sharing stays minimal whatever the ids are. Its arrays lie in the cluster's shared folder and are memory-mapped by
the workers. Words outside the lexicon are merged by the vocabulary's ranks, so the lexicon's choice affects
the speed alone, never an id.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.plans.lineage import shared_folder

#: Fixed value: the pattern by which the vocabulary's texts are parted into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabulary file: one token, in base 64, and its rank to a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts from which the lexicon's words are chosen, how many characters of each, and the words' greatest number.
SAMPLED_TEXTS, SAMPLED_LENGTH, LEXICON_WORDS = 4_000, 4_000, 40_000
#: Words whose ids a worker keeps at hand.
KEPT = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of the least rank is joined until no pair is a token."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 200:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        least, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if least == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for words of any length."""
    import heapq

    n = len(word)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j != -1 and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j == -1 or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] != -1:
            before[after[i]] = i
        offer(i)
        if before[i] != -1:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def compile_lexicon(ids_of: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of the words, built from the sorted words (Daciuk et al., 2000)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states of the last word: final, closed edges
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], register[key]))

    words = sorted(ids_of)
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    count = np.zeros(len(states), np.int64)  # words from each state; targets precede their sources
    start, label, target, skip = [0], [], [], []
    for s, (final, edges) in enumerate(states):
        below = int(final)
        for c, to in edges:
            label.append(c)
            target.append(to)
            skip.append(below)
            below += int(count[to])
        count[s] = below
        start.append(len(label))
    lengths = [len(ids_of[w]) for w in words]
    return {
        "start": np.array(start, np.int32),
        "label": np.array(label, np.uint8),
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array([f for f, _ in states], np.bool_),
        "offset": np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64),
        "ids": np.array([i for w in words for i in ids_of[w]], np.int32),
    }


class Lexicon:
    """Reads the transducer; the arrays may be memory maps."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.root = len(arrays["final"]) - 1

    def ids(self, word: bytes) -> list[int] | None:
        a, state, number = self.a, self.root, 0
        for c in word:
            lo, hi = int(a["start"][state]), int(a["start"][state + 1])
            at = lo + int(np.searchsorted(a["label"][lo:hi], c))
            if at == hi or a["label"][at] != c:
                return None
            number += int(a["skip"][at])
            state = int(a["target"][at])
        if not a["final"][state]:
            return None
        return a["ids"][a["offset"][number] : a["offset"][number + 1]].tolist()


def publish(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str | Broadcast:
    """A folder that all workers can map; where the shared folder is no file system path, a broadcast. The
    lexicon's size is bounded by its greatest number of words."""
    root = shared_folder(spark)
    if not root.startswith(("file:", "/")):
        return spark.sparkContext.broadcast(arrays)
    name = hashlib.sha256(b"".join(k.encode() + v.tobytes() for k, v in sorted(arrays.items()))).hexdigest()[:24]
    folder = "/" + root.removeprefix("file:").lstrip("/") + f"/lexicon-{name}"
    os.makedirs(folder, exist_ok=True)
    for k, v in arrays.items():
        np.save(f"{folder}/.{k}.{os.getpid()}.npy", v)
        os.replace(f"{folder}/.{k}.{os.getpid()}.npy", f"{folder}/{k}.npy")
    return folder


def _open(place: str | Broadcast) -> Lexicon:
    if isinstance(place, str):
        return Lexicon({n.removesuffix(".npy"): np.load(f"{place}/{n}", mmap_mode="r") for n in os.listdir(place) if n[0] != "."})
    return Lexicon(place.value)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, sampled: int = SAMPLED_TEXTS, words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    Empty and null texts get an empty list; white space is a text like any other, and every row comes out, repeated
    keys too. Special tokens' strings in a text are ordinary text. The lexicon is compiled from the most frequent
    ``words`` of ``sampled`` texts; this bounds its size and changes no id. ``vocabulary`` must be readable where
    the session runs; its ranks, bounded by the vocabulary's size, are broadcast.
    """
    spark, ranks = df.sparkSession, read_ranks(vocabulary)
    pattern = regex.compile(WORD)
    some = df.select(F.substring(F.col(text), 1, SAMPLED_LENGTH).alias("t")).where("t is not null").limit(sampled).collect()
    counts = Counter(w for row in some for w in pattern.findall(row.t))
    place = publish(spark, compile_lexicon({w.encode(): merge(w.encode(), ranks) for w, _ in counts.most_common(words)}))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lexicon, kept = regex.compile(WORD).findall, _open(place), {}
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                for word in find(t) if t else ():
                    ids = kept.get(word)
                    if ids is None:
                        raw = word.encode()
                        ids = lexicon.ids(raw)
                        if ids is None:
                            ids = merge(raw, shared.value)
                        if len(kept) >= KEPT:
                            kept.clear()
                        if len(word) < 64:
                            kept[word] = ids
                    flat.extend(ids)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
