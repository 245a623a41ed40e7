"""The operators against brute force, round trips, and made-up cases."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexitide.llm import canon, copies, language, leaks, markup, mojibake, names, sample, termfreq, tokenize

# 1. Terms


@pytest.mark.parametrize("max_len", [1, 3])
def test_terms_against_brute_force(spark, max_len):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "b", "Ça", "x1y", "-"]) for _ in range(r.randrange(12))) for _ in range(60)] + [None, "", "...", "a " * 3000]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, term int").repartition(3)
    n, recs = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\W\d_]+", (t or "").lower())
        for k in range(1, max_len + 1):
            for j in range(len(ws) - k + 1):
                g = " ".join(ws[j : j + k])
                n[g] += 1
                recs[g].add(i)
    got = {r.term: (r.occurrences, r.records) for r in termfreq.term_frequencies(df, "text", max_len, salts=3).collect()}
    assert got == {g: (n[g], len(recs[g])) for g in n}
    assert termfreq.term_frequencies(df.limit(0), "text", max_len).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 21)], "term string, occurrences long, records long")
    assert {r.term: r.mark for r in termfreq.mark_terms(df, 100).collect()} == {"a": "rare", "b": "useful", "c": "common"}


# 2. Names

SAME = [
    ["Verdane Technical Journals", "VERDNE TECHNICAL JOURNALS", "Verdane", "Verdane B.V.", "  Verdane  Technical Journals Ltd.", "Oxbow Engineering (Verdane Technical Journals)", "Oxbow Engineering, an imprint of Verdane"],
    ["Institute of Agronomy, Tocezoris", "INST AGRON, TOCEZORIS", "Institute of Agronomy, Tocezoris (IAT)", "Institute of Agronomy, Tocezoris Ltd", "Institute oof Agronomy, Tocezoris"],
    ["Institute of Acoustics, Tocezoris"], ["Institute of Agronomy, Old Tocezoris"], ["Northern Zezapikos University Press"],
    ["Zezapikos University Press", "Press - Zezapikos University", "ZEZAPIKOS UNIV PR", "Zezapikos-University Press"],
    ["Kestrel & Loam", "Kestrel and Loam", "BARROW HOUSE - KESTREL LOAM", "Barrow House (Kestrel & Loam)"],
]


@pytest.mark.parametrize("at_hand", [2_000, 0])
def test_names(spark, at_hand, monkeypatch):
    own = names.average_linkage
    monkeypatch.setattr(names, "average_linkage", lambda *a: own(*a, at_hand=at_hand))
    rows = [(n, 0) for g in SAME for n in g] * 2 + [(None, 1), (" ", 1)]
    found = defaultdict(set)
    for r in names.link_names(spark.createDataFrame(rows, "name string, cluster int"), "name").collect():
        found[r.cluster].add(r.name)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, SAME))


def test_sparse_join_against_all_pairs(spark):
    forms = sorted({f for g in SAME for n in g for f in names.forms(n)})
    got = {(r.a, r.b): r.cosine for r in names.similar_pairs(spark.createDataFrame([(f,) for f in forms], "form string"), "form", threshold=0.3).collect()}
    df = Counter(g for f in forms for g in names._grams(f, 3))
    vec = {f: {g: c * np.log((1.0 + len(forms)) / df[g]) ** 2 for g, c in names._grams(f, 3).items()} for f in forms}
    norm = {f: np.sqrt(sum(w * w for w in v.values())) for f, v in vec.items()}
    want = {}
    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            c = sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) / (norm[a] * norm[b])
            if c >= 0.3:
                want[a, b] = c
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _by_hand(items, links, least):
    """Average linkage by a look at all pairs of clusters before each merge."""
    s = {frozenset(k): v for k, v in links.items()}
    groups = [[x] for x in sorted(items)]
    while True:
        best = None
        for i, x in enumerate(groups):
            for y in groups[i + 1 :]:
                total = sum(round(s.get(frozenset((a, b)), 0.0) * names.UNIT) for a in x for b in y)
                mean = total / (len(x) * len(y))
                if total and mean >= round(least * names.UNIT) and (best is None or (-mean, x[0], y[0]) < best[0]):
                    best = ((-mean, x[0], y[0]), x, y)
        if best is None:
            return sorted(map(sorted, groups))
        groups = sorted([g for g in groups if g not in best[1:]] + [sorted(best[1] + best[2])])


@pytest.mark.parametrize("seed", range(2))
def test_linkage_with_ties_in_one_task_and_in_rounds(spark, seed):
    r = random.Random(seed)
    items = [f"n{i:02d}" for i in range(24)]
    links = {(a, b): r.choice([0.2, 0.4, 0.4, 0.6, 0.8]) for i, a in enumerate(items) for b in items[i + 1 :] if r.random() < 0.15}
    df = spark.createDataFrame([(x,) for x in items], "x string")
    pairs = spark.createDataFrame([(*k, v) for k, v in links.items()], "a string, b string, s double")
    for at_hand in (1_000, 0):
        found = defaultdict(list)
        for row in names.average_linkage(df, "x", pairs, 0.2, at_hand=at_hand).collect():
            found[row.cluster].append(row["item"])
        assert sorted(map(sorted, found.values())) == _by_hand(items, links, 0.2)


def test_parted_lists_and_nearest_links(spark):
    forms = [f"{w} {k} press" for w in ("amber", "ambler", "timber", "limber") for k in ("north", "norther", "south")]
    df = spark.createDataFrame([(f,) for f in forms], "f string")
    pairs = lambda **k: {(r.a, r.b): r.cosine for r in names.similar_pairs(df, "f", 4, 0.35, 1.0, **k).collect()}
    full = pairs()
    assert len(full) > 20 and pairs(listed=2) == pytest.approx(full)
    near = defaultdict(list)
    for (a, b), c in full.items():
        near[a].append((-c, a, b))
        near[b].append((-c, a, b))
    assert set(pairs(top=2)) == {x[1:] for v in near.values() for x in sorted(v)[:2]}


# 3. Lists


def test_mapping(spark):
    ref = spark.createDataFrame([(1, "Sentence smoothing"), (2, "Abstract shortening"), (3, "Section outline planning"), (4, "Reply to reviewers drafting"), (5, "Abstract shortening")], "n int, label string")
    cases = {"Sentence smoothing": 1, "sentence-smoothing.": 1, "Sentence smooting": 1, "smoother sentences": 1, "shortening: abstract": 2, "used for abstract shortening (first draft)": 2, "outline for each section": 3, "drafting replies to reviewers": 4, "menu planning": 0, "n/a": 0, "": 0, "robot arm": 0}
    df = spark.createDataFrame([(k, 7) for k in cases] * 2 + [(None, 1)], "val string, label int")
    got = canon.map_to_list(df, "val", ref, "n", "label").collect()
    assert len(got) == 2 * len(cases) + 1
    assert {r.val: r.ref_id for r in got} == cases | {None: 0}
    assert canon.map_to_list(df, "val", ref.limit(0), "n", "label").where("ref_id <> 0").count() == 0


def test_mapping_with_own_words(spark):
    ref = spark.createDataFrame([(1, "Crimson lorry"), (2, "Azure bicycle")], "n int, label string")
    df = spark.createDataFrame([("the truck, ruby",), ("velo blah azure",)], "val string")
    refs = lambda **own: [r.ref_id for r in canon.map_to_list(df, "val", ref, "n", "label", **own).orderBy("val").collect()]
    assert refs() == [0, 2]
    assert refs(same=[["lorry", "truck"], ["crimson", "ruby"]]) == [1, 2]
    assert refs(bounds=(1.1, 1.1, 1.1)) == [0, 0]


@given(st.text("abc", max_size=8), st.lists(st.text("abc", min_size=1, max_size=8), max_size=8))
@settings(max_examples=200, deadline=None)
def test_symmetric_deletes_find_all_within_the_bound(word, known):
    near = {w for _, w in canon.DeleteIndex(known, 2).near(word, 2)}
    assert near == {w for w in known if names._slips(word, w, 2) <= 2 and canon.distance(word, w) <= 2.4}


@given(st.text("abcd", max_size=30), st.lists(st.text("abcd", min_size=1, max_size=30), max_size=6), st.integers(0, 29), st.sampled_from("abcd"))
@settings(max_examples=200, deadline=None)
def test_deletions_of_beginnings_find_long_strings(word, known, at, c):
    known = [*known, word[:at] + c + word[at:], word[:at] + word[at + 1 :] or "a"]
    near = {w for _, w in canon.DeleteIndex(known, 2).near(word, 2)}
    assert near == {w for w in known if names._slips(word, w, 2) <= 2 and canon.distance(word, w) <= 2.4}


def _scan(m, text):
    """The entry that words cover best, by a look at every entry and every known word."""
    words = [w for w in text.split() if w not in m.filler]
    matches = []
    for w in words:
        found = m.match(w)
        if w not in m.weight and m.key(w) not in m.weight and set(found.values()) <= {0.95}:
            k = m.key(w)
            assert found == {x: 0.95 for x in m.weight if len(x) >= 5 and x in w or len(k) >= 5 and len(x) >= 5 and x.startswith(k)}
        if found:
            matches.append(found)
    best, (alone, some, half) = (0.0, 0.0, 0, 0), m.bounds
    for ref, keys in m.words.items():
        mass = sum(m.weight[k] for k in keys)
        covered = sum(m.weight[k] * max((x[k] for x in matches if k in x), default=0.0) for k in keys) / mass if mass else 0.0
        used = sum(any(k in x for k in keys) for x in matches) / max(1, len(words))
        if covered >= alone or covered >= m.cover and used >= some or covered >= 0.8 * m.cover and used >= half:
            best = max(best, (round(covered, 6), round(used, 6), m.uses[ref], -ref))
    return -best[3]


def test_index_of_words_against_a_scan():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(60)]
    m = canon.Mapper([(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 5)))) for i in range(1, 120)], {})
    hits = 0
    for _ in range(400):
        text = " ".join(w + r.choice(["", "", "s", "ing", "xx"]) for w in r.choices([*vocabulary, "other", "words"], k=r.randint(1, 5)))
        assert m.by_words(text) == _scan(m, text)
        hits += m.by_words(text) > 0
    assert hits > 50 and m.by_words("q" * 100_000) == 0


# 4. Markup


@pytest.fixture(scope="module")
def labeller():
    r = random.Random(2)
    words = "the of survey trial soil water result model showed growth patients between region change and with under over small large signal".split()
    return markup.train([" ".join(r.choice(words) for _ in range(r.randint(6, 14))).capitalize() + "." for _ in range(600)], documents=1500, epochs=5)


CASES = {
    "The <i>trial</i> ran.": ({"html"}, "The trial ran."),
    "Results &amp; more.<br/>Next.": ({"html"}, "Results & more.\nNext."),
    "# Aim\n\nThe trial ran.": ({"markdown"}, "# Aim\n\nThe trial ran."),
    "== Aim ==\nThe '''trial''' ran.": ({"wiki"}, "# Aim\n\nThe trial ran."),
    "We set $\\alpha = 0.05$ and \\textit{then} ran.": ({"latex"}, "We set $\\alpha = 0.05$ and then ran."),
    "Values <0.70 and >61.1 were kept; R&D cost $12 and $40.": (set(), None),
    "Group_A and group_B differed [sic] in a 3*2 design.": (set(), None),
    "": (set(), None),
}


def test_markup(labeller):
    for (text, (kinds, cleaned)), (found, labels) in zip(CASES.items(), labeller.label(list(CASES)), strict=True):
        assert {markup.LABELS[k][0] for k in labels} - {""} == kinds, text
        assert cleaned is None or markup.clean(text, found, labels) == cleaned


def test_markup_of_any_length(labeller):
    long = "the results of the survey show that soil water was over the trial in small groups and " * 6
    formula = "\\alpha = 0.05 + " * 40 + "x"
    cases = {
        f'The <img src="a.png" alt="{long}"/> trial ran.': ("html", "The trial ran."),
        'The <img src="a.png"\n  class="x"/> trial ran.': ("html", "The trial ran."),
        f"We set ${formula}$ then.": ("latex", f"We set ${formula}$ then."),
        f"We set \\({formula}\\) then.": ("latex", f"We set ${formula}$ then."),
        f"We set $$ {formula} $$ then.": ("latex", f"We set $ {formula} $ then."),
        f"A group <b and {long}then > c was kept.": (None, None),
        f"A 3*4 plot, {long}5*6 plots.": (None, None),
    }
    for (text, (kind, cleaned)), (found, labels) in zip(cases.items(), labeller.label(list(cases)), strict=True):
        assert {markup.LABELS[k][0] for k in labels} - {""} == ({kind} if kind else set()), text
        assert "".join(text[x.start : x.end] for x in found) == text
        assert cleaned is None or markup.clean(text, found, labels) == cleaned


def test_wide_spans_leave_what_is_within():
    text = "a **" + "x " * 200 + "<i>y</i> z** b"
    found = markup.leaves(text)
    wide = [(x, markup.LABEL["markdown", "emphasis"]) for x in markup.leaves(text, markup.WIDE_LEXER) if markup.is_wide(text, x)]
    labels = np.array([markup.LABEL["html", "tag"] * (x.form == "angle") for x in found])
    both, merged = markup.with_wide(text, found, labels, wide)
    assert "".join(text[x.start : x.end] for x in both) == text
    assert markup.clean(text, both, merged) == "a " + "x " * 200 + "y z b"


def test_tag_paths_of_any_depth():
    assert markup.leaves("".join(f"<t{i}>" for i in range(40)) + "x")[-1].path[-1] == "t39"
    assert markup.leaves("<a><b><c>x</b></z>y")[-1].path == ("a",)


def test_markup_table(spark, monkeypatch, labeller):
    monkeypatch.setattr(markup, "train", lambda sentences: labeller)
    rows = [(1, "The <b>trial</b> ran."), (2, None), (3, ""), (4, "plain words"), (5, " \n"), (1, "The <b>trial</b> ran."), (6, "a " * 20_000 + "<p>end</p>")]
    df = spark.createDataFrame(rows, "k long, kinds string").withColumnRenamed("k", "cleaned").repartition(2)
    got = markup.label_texts(df, "cleaned", "kinds").toDF("id", "kinds", "text").collect()
    assert len(got) == len(rows)
    by = {r.id: (list(r.kinds), r.text) for r in got}
    assert by[1] == (["html"], "The trial ran.") and by[2] == ([], None) and by[3] == ([], "") and by[4] == ([], "plain words") and by[6][0] == ["html"]
    assert markup.label_texts(df.limit(0), "cleaned", "kinds").count() == 0


def test_markup_held_out(labeller):
    held = markup.made_up(["A plain sentence on soil and water."], 300, seed=77)
    right = total = 0
    for (_, k, _), (_, got) in zip(held, labeller.label([t for t, _, _ in held]), strict=True):
        right, total = right + (k == got).sum(), total + len(k)
    assert right / total > 0.95


@given(st.text("ab <>*_#`[](){}\\$&;'=|~-\n1.", max_size=80))
@settings(max_examples=200, deadline=None)
def test_leaves_cover_the_text(text):
    assert "".join(text[x.start : x.end] for x in markup.leaves(text)) == text


def test_unclosed_comments_and_labellers_trained_once(monkeypatch):
    began = time.time()
    markup.leaves("<!-- x " * 50_000)
    assert time.time() - began < 5
    assert [x.form for x in markup.leaves("a <!-- b - c -- d > <i> --> e")] == ["", "comment", ""]
    calls = []
    monkeypatch.setattr(markup, "_train", lambda *a: calls.append(a) or object())
    assert markup.train(["One."]) is markup.train(["One."]) and markup.train(["Two."]) is not markup.train(["One."]) and len(calls) == 2


def test_gradients():
    m = markup.Labeller(seed=1)
    docs = [markup._features(t, markup.leaves(t)) for t in ("a <i>b</i> c", "x $y$")]
    labels = np.array([0, 1, 0, 1, 0, 0, 17])
    _, g = m.gradients(docs, labels)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    for name, at in (("xf", (3, 5)), ("hb", (2, 7)), ("out", (1, 1)), ("cf", (4,))):
        old, losses = m.p[name][at], []
        for step in (1e-3, -1e-3):
            m.p[name][at] = old + step
            losses.append(m.gradients(docs, labels)[0])
        m.p[name][at] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[name][at], abs=2e-3)


# 5. Languages

TEXT = {
    "en": "The results show that the method is better than the others. We found no difference between the two groups.",
    "de": "Die Ergebnisse zeigen, dass die Methode besser ist als die anderen. Wir fanden keinen Unterschied zwischen den Gruppen.",
    "fr": "Les résultats montrent que la méthode est meilleure que les autres. Nous n'avons trouvé aucune différence entre les groupes.",
    "es": "Los resultados muestran que el método es mejor que los otros. No encontramos ninguna diferencia entre los dos grupos.",
    "pt": "Os resultados mostram que o método é melhor do que os outros. Não encontramos nenhuma diferença entre os dois grupos.",
    "it": "I risultati mostrano che il metodo è migliore degli altri. Non abbiamo trovato alcuna differenza tra i due gruppi.",
}


def test_languages(spark):
    rows = [(i, t, lang) for i in range(3) for lang, t in TEXT.items()]
    rows += [(10, TEXT["en"] + " " + TEXT["de"] + "\n" + TEXT["en"], "en"), (11, TEXT["it"].upper(), None), (12, None, "en"), (13, " \n", "en"), (14, "", "de"), (15, (TEXT["fr"] + " ") * 200, None), (16, "123", None)]
    df = spark.createDataFrame(rows, "id int, t string, lang string")
    got = defaultdict(list)
    for r in language.detect(df, "id", "t", "lang").orderBy("id", "seg_no").collect():
        got[r.id].append((r.seg_lang, r.seg_no, r.segs))
        assert 0 < r.confidence <= 1
    assert got[10] == [("en", 1, 3), ("de", 2, 3), ("en", 3, 3)] and got[11] == [("it", 1, 1)] and got[15] == [("fr", 1, 1)]
    assert not {12, 13, 14} & set(got) and len(got[16]) == 1


def test_sample_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(sample, "PARTS", 8)
    rows = [(f"text {i % 400}", "en" if i % 3 else "de", i % 1200) for i in range(3000)] + [("hot", "en", i) for i in range(3000)] + [(None, "en", 1), ("", "de", 1), ("x" * 200, "de", 1), ("other", "xx", 1)]
    df = spark.createDataFrame(rows, "t string, g string, h int")
    drawn = [sample.text_sample(d, "h", "t", 50, 100, "g", ["en", "de"]) for d in (df, df.orderBy(F.rand(1)).repartition(7), df.coalesce(1))]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 100
    assert 20 < sum(t == "hot" for _, t in drawn[0]) < 48  # four of five distinct rows of its group
    order = df.where("g = 'de' and length(t) between 1 and 100").distinct().orderBy(F.shiftrightunsigned(F.xxhash64("h", "t"), 1)).limit(50).collect()
    assert [t for g, t in drawn[0] if g == "de"] == [r.t for r in order]
    assert sample.text_sample(df, "h", "t", 5, 100) != [] and sample.text_sample(df.limit(0), "h", "t", 5, 100) == []


def test_languages_without_labels_and_own_lists(spark):
    df = spark.createDataFrame([(i, TEXT[g], g) for i, g in enumerate(("en", "de"))], "id int, t string, lang string")
    with pytest.warns(UserWarning, match="es, fr, it, pt"):
        language.detect(df, "id", "t", "lang")
    got = {r.id: r.seg_lang for r in language.detect(df, "id", "t", "lang", trained=5, longest=500, languages=("de", "en")).collect()}
    assert got == {0: "en", 1: "de"}


# 6. Copies


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_against_brute_force(spark, parts):
    r = random.Random(parts)
    base = ["Ab c", "A-B C!", "abd", "GRÖSSE", "größe", "x" * 3000, "", None]
    rows = [(i, r.choice(base), "id" if r.random() < 0.5 else "I.D") for i in range(400)] + [(1000 + i, "hot", "k") for i in range(300)]
    df = spark.createDataFrame(rows, "key long, rep string, id string").repartition(parts).toDF("n", "rep", "id")
    groups = defaultdict(list)
    for n, a, b in rows:
        groups[tuple(re.sub(r"[^\w]|_", "", (x or "").casefold()) for x in (a, b))].append(n)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    pairs = copies.copy_pairs(df, "n", ["rep", "id"]).collect()
    sizes = copies.collapse_copies(df, "n", ["rep", "id"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, pairs)) == sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert sorted(map(tuple, sizes)) == sorted((min(g), len(g)) for g in groups.values())


@pytest.mark.parametrize("hashes", [1, 3])
def test_copies_of_keys_with_one_hash(spark, monkeypatch, hashes):
    monkeypatch.setattr(copies, "_hash", lambda key: F.pmod(F.length(key), F.lit(hashes)).cast("long"))
    r = random.Random(hashes)
    rows = [(i, "k" * r.randrange(1, 9), r.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "n long, x string, y string")
    groups = defaultdict(list)
    for n, *k in rows:
        groups[tuple(k)].append(n)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    pairs = copies.copy_pairs(df, "n", ["x", "y"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, pairs)) == sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


def test_field_order_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "B", "a")], "n long, x string, y string")
    assert copies.copy_pairs(df, "n", ["x", "y"]).count() == 0
    assert copies.copy_pairs(df, "n", ["x", "y"], unordered=True).count() == 1
    assert copies.copy_pairs(df.limit(0), "n", ["x", "y"]).count() == 0


# 8. Tokens


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenize.WORD, mergeable_ranks=tokenize.read_ranks(tokenize.VOCABULARY), special_tokens={})


def test_tokens(spark, encoding):
    texts = ["Hello world's  end", "", None, "  ", "\n\t x", "naïve 数据 🙂🙂", "<|endoftext|>", "a" * 3000, "zq" * 300, "Hello", "Hello", "é ​ x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, ids string").repartition(3).toDF("doc_id", "t")
    got = {r.doc_id: r.ids for r in tokenize.encode_texts(df, "doc_id", "t", words=5).collect()}
    assert got == {i: encoding.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokenize.encode_texts(df.limit(0), "doc_id", "t").count() == 0


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 99), min_size=1, max_size=4), max_size=30), st.binary(min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_transducer_is_a_dictionary(known, other):
    lexicon = tokenize.Lexicon(tokenize.compile_lexicon(known))
    assert all(lexicon.ids(w) == ids for w, ids in known.items())
    assert lexicon.ids(other) == known.get(other)


# 9. Leaks


@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_index_against_search(values, phrase):
    text = np.array([*values, 0], np.int64)
    index = leaks.FMIndex(text, 3)
    lo, hi = index.find(np.array([phrase], np.int64))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert got == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)].tolist() == phrase]


def test_leaks(spark, monkeypatch):
    item = "A copy chief in Lonujojal archives the Caluguoid image plate before the embargo ends, and the bugomioid team keeps 17 copies under seal"
    other = "A copy chief in Tocezoris archives the Wamians image plate before the embargo ends, and the kifuoid team keeps 17 copies under seal"
    w = item.split()
    prose = "plain words about soil and water " * 40
    docs = {
        1: prose + item.upper().replace(",", " ;") + " " + prose, 2: prose + " ".join(w[3:17]), 3: " ".join(w[3:10]) + prose, 4: prose, 5: None, 6: "", 7: " ".join("thing" if i % 6 == 5 else x for i, x in enumerate(w)),
        8: prose * 30 + item, 9: "before the embargo ends and the team keeps 17 copies under seal and more", 10: item,
    }
    monkeypatch.setattr(leaks, "SHARD", 700)
    d = spark.createDataFrame([(i, t, 0) for i, t in docs.items()] + [(10, item, 0)], "doc_id long, text string, item_id int").repartition(2).toDF("doc", "text", "x")
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "")], "i int, t string")
    spans = leaks.leaked_spans(d, "doc", "text", items, "i", "t", stock=1, few=1)
    found = {(r.doc_id, r.item_id) for r in spans.collect()}
    assert found == {(i, 1) for i in (1, 2, 7, 8, 10)}
    merged = {r.doc_id: (r.first, r.last, r["items"]) for r in leaks.removal_spans(spans).collect()}
    assert merged[10] == (0, len(w) - 1, [1])
    assert leaks.leaked_spans(d, "doc", "text", items.limit(0), "i", "t").count() == 0


def test_leaks_without_agreeing_rare_words(spark):
    item = "A copy chief in Lonujojal archives the Caluguoid image plate before the embargo ends, and the bugomioid team keeps 17 copies under seal"
    other = "A copy chief in Tocezoris archives the Wamians image plate before the embargo ends, and the kifuoid team keeps 17 copies under seal"
    common = [" ".join(random.Random(k).sample("abcdefghijklmnop", 16)) for k in range(5)]  # each word in all items, in other places
    rows = [(1, item), (2, other), *((10 + i, c) for i, c in enumerate(common)), *((20 + i, "one text under many ids " + "x y z " * 4) for i in range(5)), (30, "Wombat"), (31, "grey wombats sleep by day"), (32, "")]
    docs = {
        1: "so before the embargo ends and the THING team keeps 17 copies under seal so",  # the only rare word exchanged
        2: "so " + common[2] + " so",
        3: "One text under many ids, x y z x y z x y z x y z.",
        4: "the wombat",
        5: "grey wombats rest by day",
        6: item,
        7: "before the embargo ends and the team keeps 17 copies under seal",
    }
    d, items = spark.createDataFrame(list(docs.items()), "d long, t string"), spark.createDataFrame(rows, "i int, t string")
    found = defaultdict(set)
    for r in leaks.leaked_spans(d, "d", "t", items, "i", "t").collect():
        found[r.doc_id].add(r.item_id)
    assert found[1] == {1, 2} and found[2] == {12} and found[3] == {20, 21, 22, 23, 24} and found[4] == {30} and found[5] == {31} and found[6] == {1}
    assert 7 not in found


def test_leaks_at_cuts_of_long_documents(spark, monkeypatch):
    r = random.Random(4)
    item = " ".join(f"w{i}" for i in range(24))
    texts = [" ".join(["fill"] * r.randrange(300) + [item] + ["fill"] * r.randrange(300) + [item]) for _ in range(40)]
    monkeypatch.setattr(leaks, "SHARD", 150)
    d, items = spark.createDataFrame(list(enumerate(texts)), "d long, t string"), spark.createDataFrame([(1, item)], "i int, t string")
    got = sorted((x.doc_id, x.first, x.last) for x in leaks.leaked_spans(d, "d", "t", items, "i", "t").collect())
    assert got == sorted((i, j, j + 23) for i, t in enumerate(texts) for j, w in enumerate(t.split()) if w == "w0")


def test_every_second_word_exchanged(spark):
    words = [f"w{i}" for i in range(26)]
    docs = {}
    for distance in range(2, 8):
        for shift in range(distance):
            docs[100 * distance + shift] = " ".join("other" if i % distance == shift else w for i, w in enumerate(words))
    docs |= {1: " ".join(words[:7]), 2: " ".join(words[7:15]), 3: " ".join("other" if i % 3 < 2 else w for i, w in enumerate(words))}
    d, items = spark.createDataFrame(list(docs.items()), "d long, t string").coalesce(1), spark.createDataFrame([(1, " ".join(words))], "i int, t string")
    assert {r.doc_id for r in leaks.leaked_spans(d, "d", "t", items, "i", "t").collect()} == {k for k in docs if k > 3}


@given(st.lists(st.integers(0, 5), max_size=50), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=9), min_size=1, max_size=3))
@settings(max_examples=200, deadline=None)
def test_passages_against_all_alignments(values, texts):
    shard = np.array([*values, 0], np.int64)
    items = leaks.prepare([(k, " ".join(map(str, t))) for k, t in enumerate(texts)])
    number = items.vocabulary
    shard = np.array([number.get(str(v), 1) if v else 0 for v in shard], np.int64)
    bits = max(1, (len(number) + 2).bit_length())
    got = {(k, d) for k, d in leaks._diagonals(leaks.FMIndex(shard, bits), items).tolist() if any(leaks.passages(shard, items.words[k], d, 4))}
    want = {(k, d) for k, w in enumerate(items.words) for d in range(-len(w), len(shard)) if any(leaks.passages(shard, w, d, 4)) and len(w) > 2}
    assert {x for x in got if len(items.words[x[0]]) > 2} == want
    agreeing = set(leaks._agreeing(shard, items, np.array([[k, d] for k, w in enumerate(items.words) for d in range(-len(w), len(shard))]), 4))
    assert all((k, d) in agreeing for k, w in enumerate(items.words) for d in range(-len(w), len(shard)) if any(leaks.passages(shard, w, d, 4)))


# 10. Garbled text


def test_garbled(spark):
    clean = ["Die Auswertung stützt sich auf die Größe der Stichprobe – für Lehrkräfte.", "Todavía se sabe poco sobre la región de España.", "The naïve estimator didn’t fail “here” at 21 °C ± 2.", "ÅNGSTRÖM UNITS. INTRODUÇÃO E DISCUSSÃO", "数据 Δ ≈ 0.5"] * 40
    rows = [(i, t) for i, t in enumerate(clean)]
    bad = {}
    for k, (w, r) in enumerate([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251")]):
        for j, t in enumerate(clean[:3]):
            bad[1000 + 10 * k + j] = (mojibake.garble(t, w, r), t)
    for j, t in enumerate(clean[:2]):
        bad[2000 + j] = (mojibake.garble(t.replace("–", ","), "cp1252", "cp850"), t.replace("–", ","))
        bad[3000 + j] = (mojibake.garble(mojibake.garble(t, "utf-8", "cp1252"), "utf-8", "cp1252"), t)
    rows += [(i, b) for i, (b, _) in bad.items()] + [(9000, "lost ca� here"), (9001, None), (9002, ""), (9003, "plain")]
    df = spark.createDataFrame(rows, "k long, t string").toDF("garbled", "t").withColumnRenamed("garbled", "id")
    got = {r.id: r for r in mojibake.restore(df, "id", "t", mojibake.learn(df, "t")).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.garbled} == set(bad) | {9000}
    assert all(got[i].restored == t and got[i].whole for i, (_, t) in bad.items()) and not got[9000].whole
    assert mojibake.learn(df.limit(0), "t").multi == []


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251", "mac_roman"])
def test_scripts_and_repeated_garbling(read):
    repair = mojibake.Repair(["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1251", "utf-8>mac_roman"], {})
    for text in ("العربية لغة جميلة", "שלום עולם טוב", "Größe und Straße", "Привет мир в доме", "数据 分析", "αβγ α = 0.5", "naïve – “x” 21 °C", "a 👩\u200d🔬 b"):
        assert repair(text) == (False, text, True)
        garbled = text
        for _ in range(4):
            garbled = mojibake.garble(garbled, "utf-8", read)
            assert repair(garbled) == (True, text, True)


def test_correct_words_of_other_scripts_stay():
    repair = mojibake.Repair(["utf-8>cp1252", "utf-8>cp1251", "utf-8>cp1253"], {})
    for text in ("Він сказав, що Яів Ді", "Ελλάδα Ãngstrom", "È Ù Ô", "ÃO E ÃES"):
        assert repair(text) == (False, text, True)


def test_both_kinds_in_one_text():
    repair = mojibake.Repair(["utf-8>cp1252", "cp1252>cp850"], {("ü", "fr"): 50, ("ß", "ae"): 40, ("ö", "rß"): 10})
    assert repair("f³r und StraÃŸe") == (True, "für und Straße", True)
    assert repair("x² und für") == (False, "x² und für", True)


def test_long_lines_without_blanks():
    text = "a" * 1_000_000 + "é" + "b" * 1_000_000
    began = time.time()
    assert list(mojibake.foreign_words(text)) == [(0, len(text))]
    assert mojibake.Repair(["utf-8>cp1252"], {})(text)[1] == text
    assert time.time() - began < 1


@given(st.text("ab é\u00a0\u3000中\n", max_size=30))
@settings(max_examples=200, deadline=None)
def test_foreign_words_against_a_split(text):
    assert [text[a:b] for a, b in mojibake.foreign_words(text)] == [w for w in text.split() if not w.isascii()]


def test_words_without_anchors_are_no_twins(spark):
    texts = ["数据 分析 方法"] * 5 + ["данные и метод"] * 5 + [mojibake.garble(t, "utf-8", "cp1252") for t in ("数据 分析 方法", "данные и метод")]
    repair = mojibake.learn(spark.createDataFrame([(t,) for t in texts], "t string"), "t", support=1)
    assert repair.multi == repair.single == []


def test_parted_keys_and_limits(spark, monkeypatch):
    clean = ["für die Größe", "ein naïve Test", "die Straße hier"] * 3
    texts = clean + [mojibake.garble(t, "utf-8", "cp1252") for t in clean[:3]] + ["für³ die", "x fürr die"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    monkeypatch.setattr(mojibake, "LISTED", 1)
    assert len(mojibake.learn(df, "t").multi) == 1
    pairs = [("über", "³ber"), ("Tür", "T³r"), ("grün", "gr³n"), ("Gefühl", "Gef³hl")]
    single = spark.createDataFrame([(f"das {w} ist",) for a, b in pairs for w in (a, a, b)], "t string")
    assert len(mojibake.learn(single, "t", support=1).single) == 1
    with pytest.raises(ValueError, match="in context"):
        mojibake.learn(single, "t", support=1, contexts_max=1)


def test_sql_has_queries():
    from lexitide.llm import queries, sql

    assert set(sql.SQL) <= set(queries.QUERIES)
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p8_ids", "p9_found", "p10_found"} <= set(queries.QUERIES)
