"""Share of a mixture's second component in groups of documents, by maximum likelihood.

A document's two log probabilities are computed once, as columns. The log likelihood of the share is concave, so its score
falls steadily and bisection finds the maximum to full precision. Documents with equal log probabilities are counted
together first. Groups with a bounded number of distinct documents are solved in one task each; larger ones are solved by
passes in which every group narrows its bracket by sums that combine before the shuffle, so that none is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.plans.lineage import cut

#: Words of a document that may be in the lexicon.
TOKEN = r"[\p{L}][\p{L}\p{M}'-]*"
STEPS = 50
#: Words of a lexicon that is sent to every task, at most (about 50 bytes each).
AT_HAND_WORDS = 500_000
#: Parts over which a word of a larger lexicon is spread.
SALTS = 16
Extractor = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    """Words of ``text`` as they stand, an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _each_token(text: Column, extract: Extractor = tokens) -> Column:
    """A row for each token, null for none: unlike a plain explode, this makes no filter that would match twice."""
    return F.explode_outer(extract(text)).alias("word")


def bag_of_words(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, word, n): how often each word occurs in each document."""
    return df.select(doc, _each_token(F.col(text))).where("word is not null").groupBy(doc, "word").agg(F.count("*").alias("n"))


def distributions(df: DataFrame, text: str, second: Column, least: int = 50) -> DataFrame:
    """(word, p_human, p_ai): relative frequencies of words in documents without and with ``second``.

    Only words that occur at least ``least`` times are kept, which bounds the lexicon by the corpus' vocabulary.
    """
    flagged = df.select(tokens(F.col(text)).alias("words"), second.alias("s")).where("s is not null")
    words = flagged.select(F.explode_outer("words").alias("word"), "s").where("word is not null")
    counts = words.groupBy("word").agg(F.count(F.when(~F.col("s"), 1)).alias("h"), F.count(F.when(F.col("s"), 1)).alias("a"))
    kept = cut(counts.where(F.col("h") + F.col("a") >= least))
    total = kept.agg(F.sum("h").cast("double").alias("h"), F.sum("a").cast("double").alias("a")).first()  # one row
    share = lambda c: F.col(c) / F.lit(total[c])
    return kept.select("word", share("h").alias("p_human"), share("a").alias("p_ai"))


def log_probabilities(df: DataFrame, doc: str, text: str, lexicon: DataFrame, extract: Extractor = tokens, at_hand: int = AT_HAND_WORDS) -> DataFrame:
    """``df`` with lp_human and lp_ai: sums over the document's lexicon words of the log of their probability.

    A document without a lexicon word has ln(1e-10) for both. ``extract`` makes an array of words of the text; a tagger that
    finds adjectives may take its place. A lexicon of up to ``at_hand`` words is sent to the tasks, which sum up the
    documents that they read; a larger one is joined by word, each word spread over several tasks, as some are in every document.
    """
    logs = lexicon.select("word", F.log(F.col("p_human") + stats.GUARD).alias("h"), F.log(F.col("p_ai") + stats.GUARD).alias("a"))
    words = df.select(F.col(doc).alias("_doc"), _each_token(F.col(text), extract))
    if lexicon.count() <= at_hand:
        found = words.join(F.broadcast(logs), "word")
    else:
        counted = words.where("word is not null").groupBy("_doc", "word").agg(F.count("*").alias("n"))
        salted = counted.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int"))
        spread = logs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = salted.join(spread, ["word", "_salt"]).withColumns({c: F.col(c) * F.col("n") for c in ("h", "a")})
    sums = found.groupBy("_doc").agg(F.sum("h").alias("lp_human"), F.sum("a").alias("lp_ai"))
    nothing = F.lit(float(np.log(stats.GUARD)))
    return df.join(sums, F.col(doc) == F.col("_doc"), "left").drop("_doc").withColumns({c: F.coalesce(c, nothing) for c in ("lp_human", "lp_ai")})


def _score(delta: np.ndarray, n: np.ndarray, alpha: float) -> float:
    """Slope of the log likelihood at ``alpha``; written so that no exponential overflows."""
    e = np.exp(-np.abs(delta))
    up = delta > 0
    return float((n * np.where(up, (1 - e) / ((1 - alpha) * e + alpha), (e - 1) / ((1 - alpha) + alpha * e))).sum())


def _likelihood(delta: np.ndarray, n: np.ndarray, alpha: float) -> float:
    """Log likelihood less that of the first component."""
    t1, t2 = np.log(1 - alpha + stats.GUARD), np.log(alpha + stats.GUARD) + delta
    return float((n * (np.maximum(t1, t2) + np.log1p(np.exp(-np.abs(t1 - t2))))).sum())


#: The thresholds of the published calculation of the information.
FLOOR, TINY, RATIO, EQUAL, VANISHED, LEAST_MIX, NEAR_ZERO = -500.0, 1e-100, 2.0, 1e-10, -100.0, 1e-15, 1e-10


def information(h: np.ndarray, a: np.ndarray, n: np.ndarray, alpha: float, exact: bool) -> float:
    """Observed Fisher information at ``alpha``.

    The exact form is the sum of ((r - 1) / (1 - alpha + alpha r))^2. The other one keeps the thresholds of a
    calculation with plain probabilities: documents whose mixture is below 1e-100 count nothing unless one log
    probability is -500 or less, in which case the difference is approximated by the larger one beyond a factor e^2.
    """
    d = a - h
    e = np.exp(-np.abs(d))
    ratio = np.where(d > 0, (1 - e) / ((1 - alpha) * e + alpha + 1e-300), (e - 1) / ((1 - alpha) + alpha * e + 1e-300))
    if exact:
        return float((n * ratio**2).sum())
    plain = (h > FLOOR) & (a > FLOOR)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        mix = (1 - alpha) * np.exp(h) + alpha * np.exp(a)
        direct = np.where(mix > TINY, ((np.exp(a) - np.exp(h)) / np.where(mix > 0, mix, 1.0)) ** 2, 0.0)
        t1, t2 = np.log(1 - alpha + LEAST_MIX) + h, np.log(alpha + LEAST_MIX) + a
        log_mix = np.maximum(t1, t2) + np.log1p(np.exp(-np.abs(t1 - t2)))
        top = np.maximum(a, h)
        close = 2 * top + 2 * np.log(np.abs(1 - e))
        log_square = np.where(d > RATIO, 2 * a, np.where(d < -RATIO, 2 * h, np.where(e > NEAR_ZERO, close, 2 * top)))
        part = log_square - 2 * log_mix
        apart = np.where((np.abs(d) < EQUAL) | ~(part > VANISHED), 0.0, np.exp(np.minimum(part, 700)))
    return float((n * np.where(plain, direct, apart)).sum())


def _bisect(falls: Callable, lo: float, hi: float) -> float:
    """Where a falling function crosses zero between ``lo`` and ``hi``."""
    for _ in range(STEPS):
        middle = (lo + hi) / 2
        if falls(middle) > 0:
            lo = middle
        else:
            hi = middle
    return (lo + hi) / 2


def _solve(pdf: pd.DataFrame, confidence: float, exact: bool, profile: bool) -> tuple[float, float, float | None, float | None]:
    """Share, information, and profile bounds of one group; no bounds without ``profile``."""
    h, a, n = (pdf[c].to_numpy(float) for c in ("lp_human", "lp_ai", "n"))
    d = a - h
    alpha = _bisect(lambda x: _score(d, n, x), 0.0, 1.0)
    if not profile:
        return alpha, information(h, a, n, alpha, exact), None, None
    best, critical = _likelihood(d, n, alpha), stats.chi2_value(confidence)
    away = lambda x: 2 * (best - _likelihood(d, n, x)) - critical
    low, high = 1e-6, 1 - 1e-6
    lower = _bisect(away, low, alpha) if alpha > low and away(low) > 0 else low
    upper = _bisect(lambda x: -away(x), alpha, high) if alpha < high and away(high) > 0 else high
    return alpha, information(h, a, n, alpha, exact), max(0.0, lower), min(1.0, upper)


def _by_passes(pairs: DataFrame, keys: Sequence[str], confidence: float, exact: bool, profile: bool, ways: int = 64) -> DataFrame:
    """The same for groups of any size: each pass cuts every group's brackets to a ``ways``-th. Without ``profile``, the
    profile bounds are null."""
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def sums(state: DataFrame, of: Callable, at: Callable) -> DataFrame:
        """(keys, k, s): sums of ``of`` at several points of each group, added up in the tasks first."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key, own in pdf.groupby(list(keys), dropna=False, sort=False):
                    d, n, first = (own.lp_ai - own.lp_human).to_numpy(float), own.n.to_numpy(float), own.iloc[0]
                    s = [of(d, n, float(x)) for x in at(first)]
                    yield pd.DataFrame([[*key, k, v] for k, v in enumerate(s)], columns=[*keys, "k", "s"])

        return pairs.join(state, keys).mapInPandas(run, f"{kinds}, k int, s double").groupBy(*keys, "k").agg(F.sum("s").alias("s"))

    def narrow(state: DataFrame, of: Callable, above: Callable, passes: int = 9) -> DataFrame:
        """Brackets (lo, hi) in which ``above`` turns from true to false."""
        for _ in range(passes):
            points = sums(state, of, lambda r: [r.lo + (r.hi - r.lo) * k / ways for k in range(1, ways)])
            steps = points.join(state, keys).groupBy(*state.columns).agg(F.sum(F.when(above(F.col("s")), 1).otherwise(0)).alias("steps"))
            width = (F.col("hi") - F.col("lo")) / ways
            rest = [c for c in state.columns if c not in ("lo", "hi")]
            state = cut(steps.select(*rest, (F.col("lo") + width * F.col("steps")).alias("lo"), (F.col("lo") + width * (F.col("steps") + 1)).alias("hi")))
        return state

    groups = pairs.select(*keys).distinct()
    found = narrow(groups.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)}), _score, lambda s: s > 0)
    found = found.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("alpha"))
    found = cut(found)
    bounds = found.withColumns({"profile_lower": F.lit(None).cast("double"), "profile_upper": F.lit(None).cast("double")})
    if profile:
        bounds = _profile(keys, found, narrow, sums, confidence)

    def informed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, own in pdf.groupby(list(keys), dropna=False, sort=False):
                h, a, n = (own[c].to_numpy(float) for c in ("lp_human", "lp_ai", "n"))
                yield pd.DataFrame([[*key, information(h, a, n, float(own.alpha.iloc[0]), exact)]], columns=[*keys, "part"])

    informations = pairs.join(found, keys).mapInPandas(informed, f"{kinds}, part double").groupBy(*keys).agg(F.sum("part").alias("fisher_info"))
    return bounds.join(informations, keys).select(*keys, "alpha", "fisher_info", "profile_lower", "profile_upper")


def _profile(keys: Sequence[str], found: DataFrame, narrow: Callable, sums: Callable, confidence: float) -> DataFrame:
    """``found`` with the profile bounds of each group."""
    points = sums(found, _likelihood, lambda r: [r.alpha, 1e-6, 1 - 1e-6])
    three = points.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("s"))).alias(c) for k, c in enumerate(("best", "l0", "l1"))])
    best = cut(found.join(three, keys))
    critical = stats.chi2_value(confidence)
    far = lambda s: 2 * (F.col("best") - s) > critical
    down = narrow(best.withColumns({"lo": F.lit(1e-6), "hi": F.greatest("alpha", F.lit(1e-6))}), _likelihood, far)
    up = narrow(best.withColumns({"lo": F.least("alpha", F.lit(1 - 1e-6)), "hi": F.lit(1 - 1e-6)}), _likelihood, lambda s: ~far(s))
    middle = (F.col("lo") + F.col("hi")) / 2
    bounds = down.select(*keys, "alpha", F.when((F.col("alpha") > 1e-6) & far(F.col("l0")), middle).otherwise(1e-6).alias("profile_lower"))
    return bounds.join(up.select(*keys, F.when((F.col("alpha") < 1 - 1e-6) & far(F.col("l1")), middle).otherwise(1 - 1e-6).alias("profile_upper")), keys)


def solve(df: DataFrame, keys: Sequence[str], least: int = 10, confidence: float = 0.95, exact: bool = False, profile: bool = True, at_hand: int = 200_000, some: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, count, alpha, fisher_info, profile_lower, profile_upper) of each group of documents with lp_human and lp_ai, from one
    reading of ``df``; the bounds are null without ``profile``.

    Rows with a null key are left out unless ``some`` names the keys that must not be null. Groups of fewer than ``least``
    documents are left out; groups of more than ``at_hand`` distinct documents are solved in passes, with the same result.
    ``weight`` is a column with the number of documents that a row stands for, by default one.
    """
    required = keys if some is None else some
    kept = df.where(" and ".join(f"`{k}` is not null" for k in required)) if required else df
    pairs = cut(kept.groupBy(*keys, "lp_human", "lp_ai").agg((F.sum(weight) if weight else F.count("*")).alias("n")))
    sizes = cut(pairs.groupBy(*keys).agg(F.sum("n").alias("count"), F.count("*").alias("distinct")).where(F.col("count") >= least))
    group = F.to_json(F.struct(*keys))  # stands for a group's keys, some of which may be null
    grouped, known = pairs.withColumn("_g", group), sizes.withColumn("_g", group)
    schema = "_g string, alpha double, fisher_info double, profile_lower double, profile_upper double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *_solve(pdf, confidence, exact, profile)]], columns=["_g", "alpha", "fisher_info", "profile_lower", "profile_upper"])

    small = grouped.join(known.where(F.col("distinct") <= at_hand).select("_g"), "_g", "left_semi").select("_g", "lp_human", "lp_ai", "n")
    solved = small.groupBy("_g").applyInPandas(run, schema)
    large = known.where(F.col("distinct") > at_hand).select("_g")
    if not large.isEmpty():
        apart = cut(grouped.join(large, "_g", "left_semi").select("_g", "lp_human", "lp_ai", "n"))
        solved = solved.unionByName(_by_passes(apart, ["_g"], confidence, exact, profile))
    return cut(known.drop("distinct").join(solved, "_g").drop("_g"))


#: The published names of the methods by which bounds were found.
METHODS = {"fisher_logit": "fisher_logit", "fisher_wald": "fisher_wald", "profile": "profile_likelihood"}
FALLBACK = "fisher_logit_fallback"


def with_bounds(found: DataFrame, keys: Sequence[str], method: str, confidence: float = 0.95) -> DataFrame:
    """The rows of ``solve`` as estimates by one method; see ``estimates``."""
    alpha, info = F.col("alpha"), F.col("fisher_info")
    bounds = {"fisher_logit": stats.logit_interval(alpha, info, confidence), "fisher_wald": stats.wald_interval(alpha, info, confidence)}
    base = bounds.get(method, bounds["fisher_logit"])
    asked = (F.col("count") >= 50) & F.lit(method == "profile")
    given = asked & stats.finite(F.col("profile_lower")).isNotNull() & stats.finite(F.col("profile_upper")).isNotNull()
    lower = F.when(given, F.col("profile_lower")).otherwise(base[0])
    upper = F.when(given, F.col("profile_upper")).otherwise(base[1])
    name = F.when(given, METHODS["profile"]).when(asked, FALLBACK).otherwise(METHODS[method if method in bounds else "fisher_logit"])
    warning = F.when(info < 1e-6, "very_low_fisher_info").when((alpha < 0.01) | (alpha > 0.99), "extreme_estimate").otherwise("none")
    return found.select(
        *keys, "count", alpha.alias("mean"), lower.alias("ci_lower"), upper.alias("ci_upper"), (upper - lower).alias("ci_width"), "fisher_info",
        F.when(info > 1e-10, 1 / F.sqrt(info)).alias("se"), name.alias("ci_method"), warning.alias("warning"),
    )


def estimates(df: DataFrame, keys: Sequence[str], method: str = "fisher_logit", least: int = 10, confidence: float = 0.95, exact: bool = False, at_hand: int = 200_000) -> DataFrame:
    """(keys, count, mean, ci_lower, ci_upper, ci_width, fisher_info, se, ci_method, warning) of each group of
    documents with lp_human and lp_ai; ``mean`` is the share of the second component.

    ``method`` is fisher_logit, fisher_wald or profile (which needs 50 documents, else fisher_logit, and falls back on it where it
    has no bounds). Groups of fewer than ``least`` documents and those with a null key are left out. ``se`` is null without
    information. ``warning`` is very_low_fisher_info, extreme_estimate (within a hundredth of 0 or 1) or none. Groups of more
    than ``at_hand`` distinct documents are solved in passes.
    """
    return with_bounds(solve(df, keys, least, confidence, exact, method == "profile", at_hand), keys, method, confidence)


def estimate_sets(df: DataFrame, sets: Sequence[Sequence[str]], member: Callable[[DataFrame, Sequence[str]], DataFrame], method: str = "fisher_logit", least: int = 10, confidence: float = 0.95) -> DataFrame:
    """The same for several sets of keys from one reading of ``df`` and one solve; ``keys`` names a row's set, and keys outside
    of it are null. ``member`` gives the rows of a set, such as one for each member of a list. Rows with a null key are left out
    of the sets that have it."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    base = cut(df.groupBy(*keys, "lp_human", "lp_ai").agg(F.count("*").alias("_n")))
    rows = None
    for s in sets:
        own = member(base, s).where(" and ".join(f"`{k}` is not null" for k in s))
        own = own.select(F.lit("+".join(s)).alias("keys"), *[(F.col(k) if k in s else F.lit(None).cast(own.schema[k].dataType)).alias(k) for k in keys], "lp_human", "lp_ai", "_n")
        rows = own if rows is None else rows.unionByName(own)
    found = solve(rows, ["keys", *keys], least, confidence, profile=method == "profile", some=["keys"], weight="_n")
    return with_bounds(found, ["keys", *keys], method, confidence)


def compare_methods(df: DataFrame, keys: Sequence[str], least: int = 50) -> DataFrame:
    """(keys, ci_method, ci_width, success) of the three interval methods for each group, a row for each, from one solve."""
    found, rows = solve(df, keys, least), None
    for method in ("fisher_logit", "fisher_wald", "profile"):
        own = with_bounds(found, keys, method).select(*keys, F.lit(method).alias("ci_method"), "ci_width", (F.col("ci_width") > 0).alias("success"))
        rows = own if rows is None else rows.unionByName(own)
    return rows
