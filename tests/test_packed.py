from hypothesis import given, settings
from hypothesis import strategies as st

from lexitide.operators.packed import Automaton, Segmenter, split_packed

KNOWN = ["OPTICS, FIBRE", 'STUDIES OF "GREY" LITERATURE', "WOUND CARE", "HOUSING, PLANNING & TENURE", "Arts, Letters & Heritage", "Multiple"]


def test_values_keep_their_own_delimiters():
    s = Segmenter(KNOWN)
    assert s.split("OPTICS, FIBRE, WOUND CARE") == ["OPTICS, FIBRE", "WOUND CARE"]
    assert s.split('"OPTICS, FIBRE"; "WOUND CARE"') == ["OPTICS, FIBRE", "WOUND CARE"]
    assert s.split('"NURSING, X", "STUDIES OF ""GREY"" LITERATURE"') == ["NURSING, X", 'STUDIES OF "GREY" LITERATURE']
    assert s.split('STUDIES OF "GREY" LITERATURE, OPTICS, FIBRE') == ['STUDIES OF "GREY" LITERATURE', "OPTICS, FIBRE"]
    assert s.split("Multiple||Multiple | ;Arts, Letters & Heritage|") == ["Multiple", "Multiple", "Arts, Letters & Heritage"]
    assert s.split("EG, IR, US and AU") == ["EG", "IR", "US", "AU"]
    assert s.split("A\nB / C\tD") == ["A", "B", "C", "D"]
    assert s.split(None) == s.split("") == s.split(" \n") == s.split("|;") == []
    assert s.split("WOUND CARES") == ["WOUND CARES"]
    assert len(s.split("US|" * 5000)) == 5000


@given(st.lists(st.sampled_from(KNOWN + ["US", "GB"]), min_size=1, max_size=6), st.sampled_from(["|", "; ", ", ", " / ", "\n"]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_joined_values_come_back(values, delimiter, quoted):
    text = delimiter.join('"' + v.replace('"', '""') + '"' if quoted else v for v in values)
    assert Segmenter(KNOWN).split(text) == values


@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=5), st.text("ab", max_size=30))
@settings(max_examples=150, deadline=None)
def test_automaton_against_search(patterns, text):
    want = sorted({(i, i + len(p)) for p in patterns for i in range(len(text)) if text.startswith(p, i)})
    assert sorted(set(Automaton(patterns).spans(text))) == want


def test_table(spark):
    df = spark.createDataFrame([(1, "US|GB", None), (2, "US", "a; b; a"), (3, None, ""), (3, "DE, FR", " ")], "id long, field_name string, pos string")
    got = split_packed(df, "id", {"x": "field_name", "y": "pos"}, KNOWN, least=2)
    assert sorted(map(tuple, got.collect())) == [("x", 1, 1, "US"), ("x", 1, 2, "GB"), ("x", 3, 1, "DE"), ("x", 3, 2, "FR"), ("y", 2, 1, "a"), ("y", 2, 2, "b"), ("y", 2, 3, "a")]
    assert split_packed(df.limit(0), "id", {"x": "field_name"}, []).count() == 0


def test_own_delimiters(spark):
    df = spark.createDataFrame([(1, "a#b#c"), (2, "a,b"), (3, "x#y, z")], "id long, t string")
    got = split_packed(df, "id", {"x": "t"}, [], least=2, delimiter="#")
    assert sorted((r.row_key, r.val) for r in got.collect()) == [(1, "a"), (1, "b"), (1, "c"), (3, "x"), (3, "y, z")]
    spaced = spark.createDataFrame([(1, "US\u00a0and\u00a0GB")], "id long, t string")
    assert [r.val for r in split_packed(spaced, "id", {"x": "t"}, [], least=2).collect()] == ["US", "GB"]
