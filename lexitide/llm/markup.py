"""Markup residue in texts: a recurrent labeller of leaves and the clean text made from its labels.

A text is cut into leaves: spans that may be markup, and the prose between them. Each leaf is read with the tags open
around it (its tag path), the hashed words in it and its surroundings. A bidirectional LSTM in numpy labels every leaf with
the context of the whole document, since many signs are markup in one document and prose in another. It is trained on
made-up documents: plain sentences of the corpus, into which a grammar of the four kinds of markup, and of prose
that looks like it, has been written.
"""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.sample import text_sample

#: Labels of leaves: kind of markup and role.
LABELS = [
    ("", "text"),
    ("html", "tag"), ("html", "entity"),
    ("markdown", "heading"), ("markdown", "emphasis"), ("markdown", "item"), ("markdown", "quote"), ("markdown", "code"), ("markdown", "link"), ("markdown", "table"),
    ("wiki", "heading"), ("wiki", "emphasis"), ("wiki", "item"), ("wiki", "link"), ("wiki", "template"), ("wiki", "table"),
    ("latex", "command"), ("latex", "formula"), ("latex", "environment"),
]
LABEL = {kr: i for i, kr in enumerate(LABELS)}
KINDS = ("html", "markdown", "wiki", "latex")

#: Spans that may be markup, by form; what they are is for the labeller to say.
LINE_FORMS = {
    "heading": r"={2,6}[^=\n]+={2,6}[ \t]*$",
    "wtable": r"\{\|.*$|\|\}.*$|\|-.*$|! .*$",
    "row": r"[ \t]*\|.*\|[ \t]*$",
    "hash": r"#{1,6}[ \t]",
    "under": r"(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*$",
    "bullet": r"[ \t]*[-+*•][ \t]+",
    "colon": r"(?!\*{1,2}\S[^*\n]*\*)[*#:;]{1,4}(?=[ \t]?\w)",
    "number": r"[ \t]*\d{1,2}[.)][ \t]+",
    "angle_quote": r">[ \t]?",
}
SPAN_FORMS = {
    "fence": r"```[^`]*```",
    "tick": r"`[^`\n]+`",
    "comment": r"<!--(?:[^<-]|-(?!->)|<(?!!--))*+-->",
    "angle": r"<[^<>\n]{1,300}>",
    "entity": r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,24});",
    "dollars": r"\$\$[^$]{1,400}\$\$",
    "dollar": r"\$(?=[^\s$])[^$\n]{0,200}?(?<=[^\s$])\$(?!\d)",
    "env": r"\\(?:begin|end)\s?\{[A-Za-z]+\*?\}",
    "paren": r"\\\((?s:.{1,400}?)\\\)|\\\[(?s:.{1,400}?)\\\]",
    "command": r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\})*",
    "escape": r"\\[%&_#${}\\]",
    "template": r"\{\{[^{}]*\}\}",
    "brace": r"\{\\[a-z]+ [^{}]*\}",
    "wlink": r"\[\[[^\[\]]*\]\]",
    "mdlink": r"!?\[[^\[\]\n]*\]\([^()\n]*\)",
    "weblink": r"\[https?://[^\s\]]+(?: [^\]\n]*)?\]",
    "bracket": r"\[[^\[\]\n]{1,60}\]",
    "quotes": r"'{5}|'{3}|'{2}",
    "equals": r"(?<!\S)={2,6} [^=\n]{1,80} ={2,6}(?!\S)",
    "stars": r"\*\*(?=\S)[^*\n]{1,300}?(?<=\S)\*\*",
    "star": r"\*[^*\n]{1,200}\*",
    "unders": r"__(?=\S)[^_\n]{1,300}?(?<=\S)__",
    "underscore": r"_[^_\n<>`*\[\]$\\]{1,200}_",
    "tildes": r"~~[^~\n]+~~|(?<=\w)~(?=\\)",
}
FORMS = LINE_FORMS | SPAN_FORMS
_either = lambda forms: "|".join(f"(?P<{k}>{v})" for k, v in forms.items())
LEXER = re.compile(rf"^(?:{_either(LINE_FORMS)})|(?=[<&$\\`\[{{*_~='!])(?:{_either(SPAN_FORMS)})", re.M)
#: Forms of spans of any length, tags over several lines among them. Each stops at the next opening or closing sign, so that
#: a text is scanned in linear time.
WIDE_FORMS = {
    "angle": r"</?[A-Za-z][\w:.-]*(?=\s*/?>|\s[^<>]*=)(?:\s+[\w:.@-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'=<>`]+))?)*+\s*/?>",
    "dollars": r"\$\$[^$]+\$\$",
    "dollar": r"\$(?=[^\s$])[^$\n]*?(?<=[^\s$])\$(?!\d)",
    "paren": r"\\\((?:[^\\]|\\[^(])+?\\\)|\\\[(?:[^\\]|\\[^\[])+?\\\]",
    "equals": r"(?<!\S)={2,6} [^=\n]+ ={2,6}(?!\S)",
    "stars": r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*",
    "star": r"\*[^*\n]+\*",
    "unders": r"__(?=\S)[^_\n]+?(?<=\S)__",
    "underscore": r"_[^_\n<>`*\[\]$\\]+_",
}
WIDE_LEXER = re.compile(rf"^(?:{_either(LINE_FORMS)})|(?=[<&$\\`\[{{*_~='!])(?:{_either({k: f'{v}|{WIDE_FORMS[k]}' if k in WIDE_FORMS else v for k, v in SPAN_FORMS.items()})})", re.M)
#: What a text holds that has a span beyond the lengths of ``SPAN_FORMS``.
MAYBE_WIDE = re.compile(r"<[^<>\n]*\n[^<>]*>|<[^<>]{301,}>|\$[^$]{201,}\$|\\[(\[](?s:.{401})|\*[^*\n]{201,}\*|_[^_\n]{201,}_|= [^=\n]{81,} =")
FORM = {k: i + 1 for i, k in enumerate(FORMS)}
#: Signs without which a text has one leaf only; Java's and Python's syntax for it agree.
SIGNS = r"[<&$\\`\[{*_#|~>=']|(^|\n)[ \t]*([-+•:;]|\d{1,2}[.)])"
VOID = frozenset("br hr img wbr input meta link col".split())
WORD_BUCKETS, PATH_BUCKETS, WORD_SIZE, PATH_SIZE, STATE = 4096, 256, 12, 6, 20
INNER = re.compile(r"[^\W\d_]+")
FLAGS = 16
WIDTH = WORD_SIZE + PATH_SIZE + len(FORMS) + 1 + FLAGS


@dataclass
class Leaf:
    start: int
    end: int
    form: str
    path: tuple[str, ...]


def leaves(text: str, lexer: re.Pattern = LEXER) -> list[Leaf]:
    """The leaves of a text in order, with the last four of the tags open around each; they cover the text."""
    out, at, path, within = [], 0, [], Counter()

    def close(name: str) -> None:
        while within[name]:
            within[last := path.pop()] -= 1
            if last == name:
                return

    for m in lexer.finditer(text):
        if m.start() > at:
            out.append(Leaf(at, m.start(), "", tuple(path[-4:])))
        form = m.lastgroup
        out.append(Leaf(m.start(), m.end(), form, tuple(path[-4:])))
        at = m.end()
        if form == "angle" and (t := re.match(r"<(/?)([A-Za-z][\w:.-]*)", m.group())):
            name = t.group(2).lower()
            if t.group(1):
                close(name)
            elif name not in VOID and not m.group().endswith("/>"):
                path.append(name)
                within[name] += 1
        elif form == "env":
            name = m.group().rsplit("{", 1)[1][:-1]
            if m.group().startswith("\\begin"):
                path.append("\\" + name)
                within["\\" + name] += 1
            else:
                close("\\" + name)
    if at < len(text):
        out.append(Leaf(at, len(text), "", tuple(path[-4:])))
    return out


def is_wide(text: str, leaf: Leaf) -> bool:
    """Whether a leaf is beyond the lengths of ``SPAN_FORMS``."""
    return leaf.form in WIDE_FORMS and not re.fullmatch(SPAN_FORMS[leaf.form], text[leaf.start : leaf.end])


def _abridged(s: str, form: str) -> str:
    """A wide span in a length that the labeller has learned: a tag without values, and both ends of others."""
    if form == "angle":
        return " ".join(re.sub(r"\"[^\"]*\"|'[^']*'", '""', s).split())
    return s[:20].rsplit(" ", 1)[0] + " " + s[-20:].split(" ", 1)[-1]


def with_wide(text: str, found: list[Leaf], labels: np.ndarray, wide: list[tuple[Leaf, int]]) -> tuple[list[Leaf], np.ndarray]:
    """Leaves and labels with ``wide`` spans of markup put in: a formula or tag in place of the leaves it covers, only the
    signs at both ends of an emphasis, as there may be other markup within."""
    put: list[tuple[int, int, Leaf, int]] = []
    for leaf, k in wide:
        if LABELS[k][1] == "emphasis":
            n = 2 if leaf.form in ("stars", "unders") else 1
            put += [(leaf.start, leaf.start + n, leaf, k), (leaf.end - n, leaf.end, leaf, k)]
        else:
            put.append((leaf.start, leaf.end, leaf, k))
    out = [(Leaf(a, b, leaf.form, leaf.path), k) for a, b, leaf, k in put]
    i = 0
    for leaf, k in zip(found, labels.tolist(), strict=True):
        while i < len(put) and put[i][1] <= leaf.start:
            i += 1
        at, j = leaf.start, i
        while j < len(put) and put[j][0] < leaf.end:
            if put[j][0] > at:
                out.append((Leaf(at, put[j][0], "", leaf.path), 0))
            at, j = put[j][1], j + 1
        if at == leaf.start:
            out.append((leaf, k))
        elif at < leaf.end:
            out.append((Leaf(at, leaf.end, "", leaf.path), 0))
    out.sort(key=lambda x: x[0].start)
    return [leaf for leaf, _ in out], np.array([k for _, k in out], np.int64)


_buckets: dict[str, int] = {}


def _bucket(word: str, n: int = WORD_BUCKETS) -> int:
    b = _buckets.get(word)
    if b is None:
        b = 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (n - 1)
        if len(_buckets) < 100_000:
            _buckets[word] = b
    return b


def _features(text: str, found: list[Leaf]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    words, paths, rest = [], [], np.zeros((len(found), len(FORMS) + 1 + FLAGS), np.float32)
    for i, leaf in enumerate(found):
        s = text[leaf.start : leaf.end]
        if leaf.form in WIDE_FORMS and (len(s) > 60 or "\n" in s) and is_wide(text, leaf):
            s = _abridged(s, leaf.form)
        words.append([_bucket(w) for w in INNER.findall(s.lower())] or [0])
        paths.append([1 + zlib.crc32(p.encode()) % (PATH_BUCKETS - 1) for p in leaf.path[-4:]] or [0])
        rest[i, FORM.get(leaf.form, 0)] = 1
        if leaf.form:
            before, after = text[leaf.start - 1 : leaf.start], text[leaf.end : leaf.end + 1]
            inner = s.strip("<>$*_`'[]{}|=~")
            rest[i, len(FORMS) + 1 :] = (
                before in ("", "\n"), after in ("", "\n"), before.isalnum(), after.isalnum(), after.isspace(),
                any(c.isdigit() for c in inner), " " in inner, inner[:1].isspace(), inner[-1:].isspace(), "\\" in s or "^" in s or "{" in s,
                inner[:1].isalpha(), inner[:1] == "/", len(inner) < 4, len(inner) > 40, "|" in inner, "=" in s or ":" in s,
            )
    return words, paths, rest


class Labeller:
    """A bidirectional LSTM over leaves, with embeddings of words and tag paths."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"words": 0.1 * init(WORD_BUCKETS, WORD_SIZE) * np.sqrt(WORD_BUCKETS), "paths": 0.1 * init(PATH_BUCKETS, PATH_SIZE) * np.sqrt(PATH_BUCKETS)}
        for d in "fb":
            self.p |= {f"x{d}": init(WIDTH, 4 * STATE), f"h{d}": init(STATE, 4 * STATE), f"c{d}": np.zeros(4 * STATE, np.float32)}
        self.p |= {"out": init(2 * STATE + WIDTH, len(LABELS)), "bias": np.zeros(len(LABELS), np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _inputs(self, docs: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple]:
        lengths = np.array([len(d[0]) for d in docs])
        steps = int(lengths.max())
        parts = []
        for k, size in ((0, "words"), (1, "paths")):
            bags = [b for d in docs for b in d[k]]
            counts = np.array([len(b) for b in bags])
            flat = np.fromiter((x for b in bags for x in b), np.intp, int(counts.sum()))
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            table = self.p[size].T
            parts.append((np.stack([np.add.reduceat(row[flat], starts) for row in table], 1) / counts[:, None], flat, counts))
        x = np.concatenate([parts[0][0], parts[1][0], np.concatenate([d[2] for d in docs])], 1).astype(np.float32)
        doc = np.repeat(np.arange(len(docs)), lengths)
        step = np.concatenate([np.arange(n) for n in lengths])
        full = np.zeros((steps, len(docs), WIDTH), np.float32)
        full[step, doc] = x
        mask = np.zeros((steps, len(docs), 1), np.float32)
        mask[step, doc] = 1
        return full, mask, (step, doc, parts)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        h = c = np.zeros((n, STATE), np.float32)
        zx = x.reshape(-1, WIDTH) @ self.p[f"x{d}"] + self.p[f"c{d}"]
        zx = zx.reshape(steps, n, 4 * STATE)
        out, tape = np.zeros((steps, n, STATE), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = zx[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * STATE], -30, 30)))
            i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            g = np.tanh(z[:, 3 * STATE :])
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc))
            h, c = mask[t] * (o * tc) + (1 - mask[t]) * h, mask[t] * new + (1 - mask[t]) * c
            out[t] = h
        return out, tape

    def logits(self, docs: list[tuple], keep: bool = False) -> tuple[np.ndarray, tuple]:
        x, mask, where = self._inputs(docs)
        hf, tf = self._run(x, mask, "f", keep)
        hb, tb = self._run(x, mask, "b", keep)
        step, doc, _ = where
        top = np.concatenate([hf[step, doc], hb[step, doc], x[step, doc]], 1)
        return top @ self.p["out"] + self.p["bias"], (x, mask, where, tf, tb, top)

    def gradients(self, docs: list[tuple], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        scores, (x, mask, (step, doc, parts), tf, tb, top) = self.logits(docs, keep=True)
        scores -= scores.max(1, keepdims=True)
        prob = np.exp(scores)
        prob /= prob.sum(1, keepdims=True)
        loss = float(-np.log(prob[np.arange(len(labels)), labels] + 1e-9).mean())
        ds = prob
        ds[np.arange(len(labels)), labels] -= 1
        ds /= len(labels)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = top.T @ ds, ds.sum(0)
        dtop = ds @ self.p["out"].T
        dx = np.zeros_like(x)
        dx[step, doc] = dtop[:, 2 * STATE :]
        for d, tape, cols in (("f", tf, slice(0, STATE)), ("b", tb, slice(STATE, 2 * STATE))):
            dout = np.zeros((*x.shape[:2], STATE), np.float32)
            dout[step, doc] = dtop[:, cols]
            dh = dc = np.zeros((x.shape[1], STATE), np.float32)
            for t, h, c, i, f, o, gg, tc in reversed(tape):
                m = mask[t]
                dh = dh + dout[t]
                dh_new = m * dh
                do = dh_new * tc
                dnew = m * dc + dh_new * o * (1 - tc * tc)
                dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - gg * gg)], 1)
                g[f"x{d}"] += x[t].T @ dz
                g[f"h{d}"] += h.T @ dz
                g[f"c{d}"] += dz.sum(0)
                dx[t] += dz @ self.p[f"x{d}"].T
                dh = (1 - m) * dh + dz @ self.p[f"h{d}"].T
                dc = (1 - m) * dc + dnew * f
        own = dx[step, doc]
        for k, size, cols in ((0, "words", slice(0, WORD_SIZE)), (1, "paths", slice(WORD_SIZE, WORD_SIZE + PATH_SIZE))):
            _, flat, counts = parts[k]
            np.add.at(g[size], flat, np.repeat(own[:, cols] / counts[:, None], counts, axis=0))
        return loss, g

    def fit(self, examples: list[tuple[tuple, np.ndarray]], epochs: int, seed: int = 11, rate: float = 0.01, batch: int = 64) -> float:
        rng, m, v, n, loss = random.Random(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0, 0.0
        total = epochs * -(-len(examples) // batch)
        for _ in range(epochs):
            order = sorted(rng.sample(range(len(examples)), len(examples)), key=lambda i: len(examples[i][1]) + 4 * rng.random())
            slices = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(slices)
            for some in slices:
                loss, g = self.gradients([examples[i][0] for i in some], np.concatenate([examples[i][1] for i in some]))
                n += 1
                step = rate * (1 - n / (total + 1)) + 1e-4
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= step * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
        return loss

    def label(self, texts: list[str], batch: int = 256) -> list[tuple[list[Leaf], np.ndarray]]:
        """Leaves and labels of each text. Texts without a span that may be markup are one leaf of prose.

        Spans of any length are labelled in a second reading; where such a span is prose, what is in it stays as read first.
        """
        out = self._label(texts, [leaves(t) for t in texts], batch)
        found = {k: leaves(t, WIDE_LEXER) for k, t in enumerate(texts) if MAYBE_WIDE.search(t)}
        found = {k: f for k, f in found.items() if any(is_wide(texts[k], x) for x in f)}
        for k, (f, labels) in zip(found, self._label([texts[k] for k in found], list(found.values()), batch), strict=True):
            wide = [(x, n) for x, n in zip(f, labels.tolist(), strict=True) if n and is_wide(texts[k], x)]
            if wide:
                out[k] = with_wide(texts[k], *out[k], wide)
        return out

    def _label(self, texts: list[str], found: list[list[Leaf]], batch: int) -> list[tuple[list[Leaf], np.ndarray]]:
        out = [(f, np.zeros(len(f), np.int64)) for f in found]
        todo = sorted((k for k, f in enumerate(found) if any(x.form for x in f)), key=lambda k: len(found[k]))
        at = 0
        while at < len(todo):
            size = max(1, min(batch, 40_000 // max(1, len(found[todo[min(at + batch, len(todo)) - 1]]))))
            some = todo[at : at + size]
            scores, _ = self.logits([_features(texts[k], found[k]) for k in some])
            best, i = scores.argmax(1), 0
            for k in some:
                n = len(found[k])
                out[k] = (found[k], np.where([bool(x.form) for x in found[k]], best[i : i + n], 0))
                i += n
            at += size
        return out


# Made-up documents.

_TAGS = "i b em strong sub sup span u small cite font tt".split()
_BLOCKS = "p div li ul ol table tr pre code a h1 h2 h3 td blockquote jats:p jats:title jats:sec section title abstract".split()
_ENTITIES = "&nbsp; &amp; &lt; &gt; &eacute; &#160; &#8211; &quot; &mdash; &#x2013; &alpha; &uuml; &deg;".split()
_HEADS = "Background Methods Results Aim Purpose Overview Conclusion Abstract Objective Summary Introduction Einleitung Ziele Contexte Objetivos Metodi".split()
_FORMULAS = [r"O(n^{2})", r"x_{i} \leq 3", r"\alpha = 0.05", r"n^{2}", r"4^{\circ}", r"\beta_1 + \beta_2", r"p < 0.05", r"k^{-1/2}", r"\hat{y}", "a+b", "N", "x", r"\frac{a}{b}", r"\mu \pm \sigma", "R^2", "E=mc^2"]


def _piece(r: random.Random, words: list[str]) -> list[tuple[str, int]]:
    """A made-up span of markup, or of prose like it, as strings with labels."""
    few = " ".join(r.sample(words, min(len(words), r.randint(1, 4)))) or "x"
    w, L = r.choice(words or ["x"]), lambda k, role: LABEL[k, role]
    num = lambda: str(r.choice([r.randint(1, 99), round(r.random(), 2), r.randint(100, 9999)]))
    kind = r.choice(["html"] * 5 + ["markdown"] * 4 + ["wiki"] * 4 + ["latex"] * 5 + ["prose"] * 9)
    if kind == "html":
        how = r.randrange(6)
        tag = r.choice(_TAGS if how < 3 else _BLOCKS)
        if r.random() < 0.2:
            tag = tag.upper()
        extra = r.choice(["", "", "", f' class="{w}"', f' id="a{r.randint(1, 99)}"', ' style="x: y"'])
        if how == 5 and r.random() < 0.6:
            e = (r.choice(_ENTITIES), L("html", "entity"))
            return [x for v in r.sample(words, min(len(words), r.randint(1, 6))) for x in ((v, 0), e)] + [(w, 0)]
        if how == 5:
            return [(w + r.choice(["", " "]), 0), (r.choice(_ENTITIES), L("html", "entity")), (r.choice(["", " "]) + few, 0)]
        if how == 4:
            return [(r.choice(["<br/>", "<br>", "<BR />", "<hr>", "<p>", "</p>", "</div>", "<!-- x -->", f'<a href="https://{w}.example/{num()}">', "</a>", '<img src="a.png"/>']), L("html", "tag"))]
        return [(f"<{tag}{extra}>", L("html", "tag")), (few, 0), (f"</{tag}>", L("html", "tag"))]
    if kind == "markdown":
        how = r.randrange(9)
        if how == 0:
            return [("\n" * r.randint(1, 2) + "", 0), ("#" * r.randint(1, 4) + " ", L("markdown", "heading")), (r.choice(_HEADS) + "\n\n", 0)]
        if how == 1:
            return [(r.choice([f"**{few}**", f"__{few}__", f"**{w}.**", f"*{few}*", f"_{few}_", f"~~{w}~~"]), L("markdown", "emphasis"))]
        if how in (2, 3):
            sign = r.choice(["- ", "- ", "* ", "+ ", "1. "])
            return [x for k in range(r.randint(1, 4)) for x in (("\n", 0), (f"{k + 1}. " if sign == "1. " else sign, L("markdown", "item")), (" ".join(r.sample(words, min(len(words), 5))) + ".", 0))]
        if how == 4:
            return [("\n", 0), ("> ", L("markdown", "quote")), (few + "\n", 0)]
        if how == 5:
            return [(r.choice([f"`{w}_{w[:2]}(x, {num()})`", f"`{w}`", f"`{few}`", f"```\n{w} = {num()}\n```"]), L("markdown", "code"))]
        if how == 6:
            return [(r.choice(["", "!"]) + f"[{few}](https://{w}.example/{num()})", L("markdown", "link"))]
        if how == 7:
            rows = [f"| {w} | {num()} |", "|-----|---|", f"| {num()} | {w} |"]
            return [("\n\n", 0), *[x for row in rows for x in ((row, L("markdown", "table")), ("\n", 0))]]
        return [("\n", 0), ("---", L("markdown", "heading")), ("\n", 0)]
    if kind == "wiki":
        how = r.randrange(7)
        if how == 0:
            n = "=" * r.randint(2, 4)
            return [("\n", 0), (f"{n} {r.choice(_HEADS)} {n}", L("wiki", "heading")), ("\n", 0)]
        if how in (1, 2):
            q = r.choice(["''", "'''", "'''''"])
            return [(q, L("wiki", "emphasis")), (few, 0), (q, L("wiki", "emphasis"))]
        if how == 3:
            return [(r.choice([f"[[{few}]]", f"[[{few}|{w}]]", f"[[Category:{w}]]", f"[https://{w}.example {few}]"]), L("wiki", "link"))]
        if how == 4:
            return [("{{" + r.choice([f"cite {w}|title={few}|year={num()}", w, f"{w}|{num()}", f"{few}|a=b"]) + "}}", L("wiki", "template"))]
        if how == 5:
            return [("\n", 0), ('{| class="wikitable"', L("wiki", "table")), ("\n", 0), ("|-", L("wiki", "table")), ("\n", 0), ("|}", L("wiki", "table")), ("\n", 0)]
        return [x for _ in range(r.randint(2, 3)) for x in (("\n", 0), (r.choice(["**", "##", "::", ";", "*:"]), L("wiki", "item")), (few, 0))]
    if kind == "latex":
        how = r.randrange(8)
        formula = r.choice(_FORMULAS)
        if how in (0, 1):
            return [(r.choice([f"${formula}$", f"$${formula}$$", f"\\({formula}\\)", f"\\[{formula}\\]"]), L("latex", "formula"))]
        if how in (2, 3):
            c = r.choice(["textit", "emph", "textbf", "texttt", "underline", "mathrm"])
            return [(f"\\{c}{{{few}}}", L("latex", "command"))]
        if how == 4:
            before = r.choice(["See", "Fig."])
            c = r.choice(["cite", "citep", "citet", "ref", "label", "footnote", "url"])
            tilde = r.random() < 0.5
            return [(before + ("" if tilde else " "), 0), *([("~", L("latex", "command"))] if tilde else []), (f"\\{c}{{{w}{num()}}}", L("latex", "command"))]
        if how == 5:
            return [("\\" + r.choice(["section", "subsection", "section*", "paragraph", "title"]) + f"{{{r.choice(_HEADS)}}}", L("latex", "command")), (" ", 0)]
        if how == 6:
            e = r.choice(["itemize", "enumerate", "equation", "abstract", "quote", "align*"])
            body = [x for _ in range(2) for x in (("\\item", L("latex", "command")), (" " + few + " ", 0))] if e in ("itemize", "enumerate") else [(f" y = a + {num()} x ", 0)]
            return [(f"\\begin{{{e}}}", L("latex", "environment")), (" ", 0), *body, (f"\\end{{{e}}}", L("latex", "environment"))]
        return [(r.choice(["{\\it " + few + "}", "{\\bf " + few + "}", "\\%", "\\&", "\\ldots", "\\alpha", "\\noindent", "\\_"]), L("latex", "command"))]
    return [(r.choice([
        f"values <{num()} and >{num()} were kept", f"p < {num()} and q > {num()}", f"(n < {num()}; m > {num()})", f"a {num()}*{num()} {w} and a {num()}*{num()} {w}",
        f"{w}_a and {w}_b, {w}_c", f"{w.upper()}_{num()} or {w}_{num()}", f"from ${num()} to ${num()} per {w}", f"${num()}, ${num()} and $", f"{w} was {num()} [sic] here", f"({w}) [{num()}]", f"[{w}] and [{num()}, {num()}]",
        f"R&D and Q&A; {w}", f"the {w}'s and '{few}'", f"C# and #{num()}", f"* {num()} of {w}*", f"{num()} * {num()} * {num()}", f"{w}* and {few}*", f"({num()}-{num()})", f"a {w} - {few} - {w}", f"{w}\n- that is, {few} -", f"x = {num()}, y == {num()}",
        f"{w} | {few}", f"~{num()} {w}", f"<{num()} {w}>", f"{w} > {num()} < {w}", f"\n{num()}. {few}", f"see {num()}) {w}", f"{w}^{num()}", "{" + f"{num()}, {num()}" + "}", f"\n({w}) {few}", f"_{num()}_ of {num()}", f"__{w}", f"{w}&{w}",
    ]), 0)]


def made_up(sentences: list[str], n: int, seed: int = 5) -> list[tuple[str, np.ndarray, list[Leaf]]]:
    """Documents with the labels of their leaves."""
    r, out = random.Random(seed), []
    words = [w for s in sentences for w in INNER.findall(s)] or ["word"]
    while len(out) < n:
        pieces: list[tuple[str, int]] = []
        style = r.random()
        for _ in range(r.randint(1, 5)):
            s = r.choice(sentences or ["A plain sentence."])
            if r.random() < 0.15:
                s = s.upper() if r.random() < 0.5 else s.title()
            own = INNER.findall(s)[:40] or r.sample(words, 1)
            if r.random() < (0.75 if style < 0.7 else 0.25):
                cut = r.choice([0, len(s), s.find(" ", len(s) // 2) + 1])
                pieces += [(s[:cut], 0), *_piece(r, own), (r.choice([" ", " ", "", "\n"]) + s[cut:], 0)]
            else:
                pieces.append((s, 0))
            pieces.append((r.choice([" ", " ", " ", "\n\n", "  "]), 0))
        text, starts, labels = "", [], []
        for s, k in pieces:
            starts.append(len(text))
            labels.append(k)
            text += s
        found = leaves(text)
        of = np.searchsorted(starts, [x.start + (len(text[x.start : x.end]) - len(text[x.start : x.end].lstrip())) * bool(x.form) for x in found], "right") - 1
        out.append((text, np.array([labels[i] if x.form else 0 for i, x in zip(of, found, strict=True)]), found))
    return out


#: The last labellers by the digests of what they were trained from, so that a session trains each once.
_trained: dict[str, Labeller] = {}


def train(sentences: list[str], documents: int = 4_000, epochs: int = 6) -> Labeller:
    """A labeller trained on made-up documents from plain sentences; the same sentences give the same labeller."""
    digest = hashlib.sha256("\n".join([*sentences, f"{documents} {epochs}"]).encode("utf-8", "surrogatepass")).hexdigest()
    if digest not in _trained:
        while len(_trained) >= 4:
            del _trained[next(iter(_trained))]
        _trained[digest] = _train(sentences, documents, epochs)
    return _trained[digest]


def _train(sentences: list[str], documents: int, epochs: int) -> Labeller:
    examples = [(_features(t, f), k) for t, k, f in made_up(sentences, documents) if any(x.form for x in f)]
    model = Labeller()
    model.fit(examples, epochs)
    return model


# From labels to results.

HEADING_TAGS = re.compile(r"h[1-6]|title|jats:title|caption", re.I)


def clean(text: str, found: list[Leaf], labels: np.ndarray) -> str:
    """``text`` without markup; headings begin with ``# ``, list items with ``- ``, quotations with ``> ``, code
    stands between back-ticks, formulas between dollar signs, table rows between bars."""
    out: list[str] = []
    for leaf, k in zip(found, labels.tolist(), strict=True):
        s, (kind, role) = text[leaf.start : leaf.end], LABELS[k]
        if not kind:
            out.append(s)
        elif kind == "html":
            if role == "entity":
                out.append(html.unescape(s))
                continue
            m = re.match(r"<(/?)\s*([A-Za-z][\w:.-]*)", s)
            name, end = (m.group(2).lower(), bool(m.group(1))) if m else ("", True)
            if HEADING_TAGS.fullmatch(name):
                out.append("\n\n" if end else "\n\n# ")
            elif name == "li":
                out.append("" if end else "\n- ")
            elif name in ("code", "tt", "pre"):
                out.append("`")
            elif name in ("td", "th"):
                out.append("" if end else " | ")
            elif name == "tr":
                out.append(" |\n" if end else "")
            elif name in ("p", "div", "br", "ul", "ol", "jats:p", "jats:sec", "section", "blockquote", "table"):
                out.append("\n")
        elif role == "heading":
            inner = s.strip("=#*-_ \t\n")
            out.append(f"\n# {inner}" if inner or s.startswith("#") else "\n")
            if inner:
                out.append("\n")
        elif role == "emphasis":
            out.append(s.strip("*_~'"))
        elif role == "item":
            out.append("- ")
        elif role == "quote":
            out.append("> ")
        elif role == "code":
            out.append("`" + s.strip("`").strip("\n") + "`")
        elif role == "link":
            inner = re.match(r"!?\[+(?:https?://\S+ ?)?([^\]]*?)\]", s)
            label = (inner.group(1) if inner else s).split("|")[-1]
            out.append("" if label.startswith("Category:") else label)
        elif role == "table":
            out.append("" if re.fullmatch(r"[\s|:+-]*|\{\|.*|\|\}.*|\|-.*", s) else s.strip())
        elif role == "formula":
            out.append("$" + re.sub(r"^(\$\$?|\\[(\[])|(\$\$?|\\[)\]])$", "", s) + "$")
        elif role == "command":
            if m := re.match(r"\\(?:(?:sub)*section|paragraph|chapter|title)\*?\{(.*)\}$", s, re.S):
                out.append(f"\n# {m.group(1)}\n")
            elif s.startswith("\\item"):
                out.append("\n-")
            elif re.match(r"\\(?:cite\w*|ref|label|eqref|pageref|noindent|bibliography\w*)\b", s) or s == "~":
                out.append(" " if s == "~" else "")
            elif m := re.match(r"\\texttt\{(.*)\}$", s, re.S):
                out.append(f"`{m.group(1)}`")
            elif m := re.match(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{(.*)\}$|\{\\[a-z]+ (.*)\}$", s, re.S):
                out.append(m.group(1) or m.group(2) or "")
            elif re.fullmatch(r"\\[%&_#${}]", s):
                out.append(s[1])
        elif role == "environment" and re.search(r"equation|align|math", s):
            out.append("$")
    joined = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<=\S)[ \t]{2,}", " ", joined)).strip()


#: Texts from which the labeller's documents are made, at most, and the characters of each, at most; longer texts are labelled
#: like all others.
TRAINED, LONGEST = 3_000, 20_000


def plain_sentences(df: DataFrame, key: str, text: str, most: int = TRAINED, longest: int = LONGEST) -> list[str]:
    """Sentences of up to ``most`` whole texts without any sign of markup, of up to ``longest`` characters each: the
    bounded sample for training, drawn by hash values."""
    rows = text_sample(df, key, text, most, longest, where=~F.col("t").rlike(SIGNS))
    return [s for _, t in rows for s in re.findall(r"[^.!?\n]+[.!?]", t)]


def label_texts(df: DataFrame, key: str, text: str, with_text: bool = True, trained: int = TRAINED, longest: int = LONGEST) -> DataFrame:
    """(key, kinds[, cleaned]): the kinds of markup in each row's text and the text made clean.

    The labeller is trained by ``plain_sentences`` of up to ``trained`` texts of up to ``longest`` characters. Texts in which
    no sign could be markup stay as they are, without a look at their leaves. Null, empty and blank texts have no markup; a
    null stays null.
    """
    model = df.sparkSession.sparkContext.broadcast(train(plain_sentences(df, key, text, trained, longest)))
    fields = ["k", "kinds", *(["cleaned"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = model.value.label(texts)
            kinds = [sorted({LABELS[x][0] for x in np.unique(k).tolist()} - {""}) for _, k in found]
            columns = [batch.column(0), pa.array(kinds, pa.list_(pa.string()))]
            if with_text:
                columns.append(pa.array([clean(t, f, k) if k.any() else t for t, (f, k) in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, fields)

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    marked = source.where(F.col("t").rlike(SIGNS)).mapInArrow(run, f"k {kind}, kinds array<string>" + ", cleaned string" * with_text)
    if with_text:
        rest = source.where(~F.coalesce(F.col("t").rlike(SIGNS), F.lit(False)))
        marked = marked.unionByName(rest.select("k", F.array().cast("array<string>").alias("kinds"), F.col("t").alias("cleaned")))
    return marked.withColumnRenamed("k", key)
