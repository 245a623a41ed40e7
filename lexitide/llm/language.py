"""Languages of documents and of the segments of mixed ones: naive Bayes over hashed character n-grams.

Each sentence is a sparse vector of hashed character trigrams, scored against a broadcast matrix of log
probabilities for a whole batch of documents at once. A best path over the sentences, in which a change of language has
a price, joins them into segments, so a name or a foreign title makes none.
"""

from __future__ import annotations

import html
import re
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.sample import text_sample

LANGUAGES = ("en", "de", "fr", "es", "pt", "it")
#: Hash values of trigrams.
BUCKETS = 1 << 15
#: Labelled texts of each language from which the model is trained, at most.
TRAINED = 3_000
#: Characters of a text from which the model may be trained, at most; longer ones are labelled like all others.
LONGEST = 20_000
#: Price of a change of language within a document, in units of log probability.
CHANGE = 12.0
#: Characters scored at once, which bounds a task's memory.
AT_ONCE = 1_000_000

BLOCK_TAG = re.compile(r"</?(?:p|br|div|ul|ol|li|h\d|tr|table|jats:\w+)\b[^<>]*>", re.I)
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\\[A-Za-z]+")
SENTENCE = re.compile(r"[.!?;][\"”»)\]}]*\s+|\n+|\s/\s")


def sentences(text: str) -> list[str]:
    """Sentences of a text without tags and closing signs; none for a blank one."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = MARKUP.sub("", BLOCK_TAG.sub("\n", text))
    elif "\\" in text:
        text = MARKUP.sub("", text)
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def _letters() -> np.ndarray:
    """Code of each character of the lower plane: itself for letters, a blank for the rest."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], np.uint32)


_LETTERS = _letters()


def _grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all parts, one after another, and where those of each part begin. Each part has one at least."""
    joined = (" " + "  ".join(parts) + "  ").lower() if parts else "   "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p.lower()) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]) if len(parts) else np.zeros(0, np.int64)
    codes = _LETTERS[np.minimum(codes, 0x2FFF)]
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[starts] = True
    keep[starts + 1] = True
    kept_before = np.cumsum(keep, dtype=np.int32) - keep
    codes = np.concatenate([codes[keep], np.full(2, 32, np.uint32)])
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(17)).astype(np.intp), kept_before[starts]


class Model:
    """Log probabilities of the hash values for each language, relative to their mean over the languages."""

    def __init__(self, counts: np.ndarray, languages: Sequence[str] = LANGUAGES):
        self.languages = tuple(languages)
        p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        logs = np.log(p)
        self.logs = (logs - logs.mean(0)).astype(np.float32)

    def scores(self, parts: list[str]) -> np.ndarray:
        """Sum of log probabilities of each part (rows) in each language."""
        return self.sums(*_grams(parts))

    def sums(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(row[grams], starts) for row in self.logs], axis=1)


def train(labelled: list[tuple[str, str]], rounds: int = 3, languages: Sequence[str] = LANGUAGES) -> Model:
    """A model from (label, text) rows of which some labels are wrong: after the first round each sentence counts for
    the language that the model itself gives it. A language without a labelled row can't be told, of which a warning tells."""
    if missing := set(languages) - {label for label, _ in labelled}:
        warnings.warn(f"no labelled text in {', '.join(sorted(missing))}", stacklevel=2)
    parts = [(languages.index(label), s) for label, text in labelled for s in sentences(text)]
    grams, starts = _grams([s for _, s in parts])
    sizes = np.diff(np.append(starts, len(grams)))
    labels = np.array([k for k, _ in parts], np.int64)
    model = None
    for _ in range(rounds):
        cells = np.repeat(labels, sizes) * BUCKETS + grams
        model = Model(np.bincount(cells, minlength=len(languages) * BUCKETS).reshape(len(languages), BUCKETS).astype(np.float64), languages)
        labels = model.sums(grams, starts).argmax(1) if len(parts) else labels
    return model or Model(np.zeros((len(languages), BUCKETS)), languages)


def path(scores: np.ndarray, change: float) -> np.ndarray:
    """Best language of each sentence if each change costs ``change``."""
    best, back = scores[0].astype(np.float64), []
    for row in scores[1:]:
        stay, jump = best, best.max() - change
        back.append(np.where(stay >= jump, np.arange(len(best)), best.argmax()))
        best = np.maximum(stay, jump) + row
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return np.array(at[::-1])


def _confidence(totals: np.ndarray) -> np.ndarray:
    """Share of the best language of each row if evidence is weighed by its square root, as n-grams depend on each other."""
    most = totals.max(1, keepdims=True)
    return 1.0 / np.exp((totals - most) / np.maximum(1.0, np.sqrt(np.abs(most)))).sum(1)


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
    """(language, confidence, sentences) of the segments of each text; none for a null or blank one."""
    split = [sentences(t) if t else [] for t in texts]
    out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= AT_ONCE):
            size += len(texts[j] or "")
            j += 1
        full = [k for k in range(i, j) if split[k]]
        if full:
            scores = model.scores([s for k in full for s in split[k]])
            first = scores.argmax(1)
            starts = np.concatenate([[0], np.cumsum([len(split[k]) for k in full])])
            whole = np.add.reduceat(scores, starts[:-1], axis=0)
            sure, same = _confidence(whole), np.minimum.reduceat(first, starts[:-1]) == np.maximum.reduceat(first, starts[:-1])
            for d, k in enumerate(full):
                a, b = int(starts[d]), int(starts[d + 1])
                if same[d]:
                    out[k] = [(model.languages[first[a]], float(sure[d]), b - a)]
                    continue
                langs = path(scores[a:b], CHANGE)
                cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), b - a]
                out[k] = [(model.languages[langs[x]], float(_confidence(scores[a + x : a + y].sum(0, keepdims=True))[0]), y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
        i = j
    return out


def detect(df: DataFrame, key: str, text: str, label: str, trained: int = TRAINED, longest: int = LONGEST, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """(key, label, segs, seg_no, seg_lang, confidence, n_sentences): the segments of each non-blank text.

    The model is trained on a bounded sample of labelled rows of ``df`` itself: up to ``trained`` rows of each of ``languages``
    with texts of up to ``longest`` characters, whole, drawn by their hash values. ``segs`` is the number of
    segments of the text. Null, empty and blank texts have no row; a text without letters gets the language of the least
    evidence with a confidence of about one sixth.
    """
    model = df.sparkSession.sparkContext.broadcast(train(text_sample(df, key, text, trained, longest, label, languages), languages=languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments(model.value, batch.column(2).to_pylist())
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [(len(f), n, *s) for f in found for n, s in enumerate(f, 1)]
            columns = list(zip(*flat, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["k", "label", "segs", "seg_no", "seg_lang", "confidence", "n_sentences"])

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(text).alias("t")).where("t is not null")
    schema = f"k {kind}, label string, segs int, seg_no int, seg_lang string, confidence double, n_sentences int"
    return texts.mapInArrow(run, schema).withColumnRenamed("k", key)
