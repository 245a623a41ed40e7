import json
import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexitide.functions import dates, stats, text
from lexitide.operators import lookup, means, mixture, prevalence, report, rules
from lexitide.plans import lineage
from lexitide.queries import keywords
from lexitide.queries.mixture import ENGLISH
from lexitide.sources import files, services
from lexitide.streaming.shares import newest_version, windowed_shares


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_quantiles():
    assert stats.z_value() == pytest.approx(1.959963984540054, abs=1e-12)
    assert stats.chi2_value() == pytest.approx(3.841458820694124, abs=1e-11)
    for df, want in ((1, 12.706204736), (2, 4.302652730), (5, 2.570581836), (30, 2.042272456), (1000, 1.962339081)):
        assert stats.t_value(df) == pytest.approx(want, abs=1e-8)
    assert stats.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)


def test_wilson(spark):
    df = spark.createDataFrame([(0.0, 10), (1.0, 10), (0.5, 0), (0.3, 1000)], "p double, n long")
    lo, hi = stats.wilson(F.col("p"), F.col("n"))
    wide_lo, wide_hi = stats.wilson(F.col("p"), F.col("n"), model_error=0.01)
    for r in df.select("*", lo.alias("lo"), hi.alias("hi"), wide_lo.alias("wlo"), wide_hi.alias("whi")).collect():
        assert 0 <= r.wlo <= r.lo <= r.p + 1e-12 and r.p - 1e-12 <= r.hi <= r.whi <= 1 or r.n == 0 and (r.lo, r.hi) == (0, 1)


@pytest.mark.parametrize(
    ("value", "want"),
    [("We delve.", True), ("delves", False), ("DELVE", True), ("a cutting-edge", True), ("cuttingXedge", False), ("édelve", False), ("_delve", False), ("(crucial)", True), ("", False), (None, False), ("realms and realm", True)],
)
def test_marker_words(spark, value, want):
    assert one(spark, text.has_word(F.col("x")), value) is want
    plain = F.coalesce(F.lower("x").rlike(text.word_pattern(text.MARKER_WORDS, plain=True)), F.lit(False))
    assert one(spark, plain, value) is want


def test_every_marker_word_is_found(spark):
    df = spark.createDataFrame([(f"so {w}, it",) for w in text.MARKER_WORDS] + [(f"so {w}x",) for w in text.MARKER_WORDS if w + "x" not in text.MARKER_WORDS], "x string")
    assert df.where(text.has_word(F.col("x"))).count() == len(text.MARKER_WORDS) == 110


def test_text(spark):
    assert one(spark, text.clean_text(F.col("x"), 5), "  abcdefg ") == "abcde"
    assert one(spark, text.clean_text(F.col("x")), "   ") is None
    assert one(spark, text.percent(F.col("x")), " 12.5 %") == 12.5
    assert one(spark, text.percent(F.col("x")), "n/a") is None
    assert one(spark, text.percent(F.col("x"), bad=0), None) == 0
    assert one(spark, text.file_name_id(F.col("x")), "@https://a.org/W1") == "https___a.org_W1"
    assert one(spark, text.standard_name(F.col("x")), "International Journal of Café-Science & Medicine") == "int j cafe sci med"
    assert one(spark, text.split_in_turn(F.col("x"), [";", ",", " and ", "&"]), "a, and b; c and d & unspecified") == ["a", "and b", "c", "d"]
    assert one(spark, text.split_in_turn(F.col("x")), None) == []
    assert one(spark, text.members(F.col("x")), "US||GB|") == ["US", "GB"]
    assert one(spark, text.members(F.col("x"), keep_blank=True), None) == [""]
    assert one(spark, text.json_number(F.col("x"), "$.data.p"), '{"data":{"p":12}}') == 12
    for bad in ("no", '{"data":null}', '{"data":{"p":"x"}}', None, ""):
        assert one(spark, text.json_number(F.col("x"), "$.data.p"), bad) is None


def test_standard_name_keeps_accented_letters_apart_from_marks(spark):
    assert one(spark, text.standard_name(F.col("x")), "Café x") == "cafe x"
    assert one(spark, text.standard_name(F.col("x")), "Proceedings of the American Society") == "proc the am soc"
    assert one(spark, text.standard_name(F.col("x")), None) == ""


def test_dates(spark):
    for value, want in (("2024-02-29", date(2024, 2, 29)), ("2024-05", date(2024, 5, 1)), ("2023-02-29", None), ("in press", None), ("", None), (None, None)):
        assert one(spark, dates.read_date(F.col("x")), value) == want
    assert one(spark, dates.half_year(F.to_date("x")), "2024-06-30") == "H1"
    assert one(spark, dates.half_year(F.to_date("x")), "2024-07-01") == "H2"
    assert one(spark, dates.quarter_label(F.to_date("x")), "2024-07-01") == "2024-Q3"


def test_shares_drop_null_keys_and_count_members(spark):
    df = spark.createDataFrame([(1, "a|b", True), (1, "a||", False), (None, "a", True), (2, None, True), (2, "c", None)], "y int, m string, f boolean")
    got = {tuple(r)[:3]: round(r.mean, 3) if r.mean is not None else None for r in prevalence.shares(prevalence.each_member(df, "m"), ["y", "m"], "f").collect()}
    assert got == {(1, "a", 2): 0.5, (1, "b", 1): 1.0, (2, "c", 0): None}
    assert prevalence.each_member(df, "m", keep_blank=True).where("m = ''").count() == 3
    assert [r.f for r in prevalence.settle_flags(df, ["f"]).collect()] == [True, False, True, True, True]
    assert prevalence.shares(df.limit(0), ["y"], "f").count() == 0


def brute(h, a, keep=1e-10):
    grid = np.linspace(0, 1, 20001)
    like = [np.logaddexp(np.log(1 - x + keep) + h, np.log(x + keep) + a).sum() for x in grid]
    return grid[int(np.argmax(like))]


def test_mixture_finds_the_maximum(spark):
    r = np.random.default_rng(3)
    frame = pd.DataFrame({"g": np.repeat(["a", "b"], 150), "lp_human": r.normal(-60, 3, 300)})
    frame["lp_ai"] = frame.lp_human + np.where(r.random(300) < np.where(frame.g == "a", 0.2, 0.6), r.normal(2, 1, 300), r.normal(-2, 1, 300))
    df = spark.createDataFrame(frame)
    for method in ("fisher_logit", "profile"):
        rows = {x.g: x for x in mixture.estimates(df, ["g"], method, exact=True).collect()}
        for g, own in frame.groupby("g"):
            assert rows[g]["mean"] == pytest.approx(brute(own.lp_human.to_numpy(), own.lp_ai.to_numpy()), abs=1e-4)
            assert rows[g].ci_lower < rows[g]["mean"] < rows[g].ci_upper and rows[g]["count"] == 150
            assert abs(rows[g]["mean"] - (0.2 if g == "a" else 0.6)) < 4 * rows[g].se


def test_mixture_at_hand_and_by_passes_agree(spark):
    r = np.random.default_rng(4)
    frame = pd.DataFrame({"g": ["x"] * 80 + ["few"] * 5, "lp_human": r.normal(-600, 100, 85)})
    frame["lp_ai"] = frame.lp_human + r.normal(0, 3, 85)
    df = spark.createDataFrame(frame)
    a, b = (mixture.estimates(df, ["g"], "profile", at_hand=k).collect() for k in (10_000, 0))
    assert len(a) == len(b) == 1  # the group of five is left out
    for c in ("mean", "ci_lower", "ci_upper", "fisher_info"):
        assert a[0][c] == pytest.approx(b[0][c], rel=1e-9)


def test_log_probabilities(spark):
    lexicon = spark.createDataFrame([("good", 0.2, 0.1), ("new", 0.0, 0.5)], "word string, p_human double, p_ai double")
    df = spark.createDataFrame([(1, "good new good"), (2, None), (3, "Good"), (4, "")], "id int, t string")
    got = {r.id: (r.lp_human, r.lp_ai) for r in mixture.log_probabilities(df, "id", "t", lexicon).collect()}
    assert got[1] == pytest.approx((2 * math.log(0.2 + 1e-10) + math.log(1e-10), 2 * math.log(0.1 + 1e-10) + math.log(0.5 + 1e-10)))
    assert got[2] == got[3] == got[4] == pytest.approx((math.log(1e-10),) * 2)


def test_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0), ("c", 5.0), ("c", 5.0)], "k string, x double")
    got = {r.k: r for r in means.mean_intervals(df, ["k"], "x").collect()}
    assert (got["a"]["count"], got["a"]["mean"]) == (2, 2.0)
    assert got["a"].ci_upper == pytest.approx(2 + 12.706204736 * math.sqrt(2) / math.sqrt(2))
    assert math.isnan(got["b"].ci_lower) and math.isnan(got["c"].ci_upper)


def test_lookups(spark):
    table = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "none")], "k string, n int, v string")
    df = spark.createDataFrame([("k",), ("z",), (None,)], "x string")
    assert [r.v for r in lookup.look_up(df, F.col("x"), table, "k", {"v": "v"}, "n").orderBy(F.col("x").asc_nulls_last()).collect()] == ["new", None, None]
    assert lookup.look_up(df, F.col("x"), table, "k", {"v": "v"}, "n", last=False).where("v = 'old'").count() == 1
    assert lookup.look_up(df, F.col("x"), table.where("k is null"), "k", {"v": "v"}, "n", null_safe=True).where("v = 'none'").count() == 1
    cats = spark.createDataFrame([("A", "one"), ("B", "two")], "c string, d string")
    rows = spark.createDataFrame([(1, ["B", "A"]), (2, ["A", "B", "B"]), (3, []), (4, None), (5, ["?"])], "id int, cs array<string>")
    assert {r.id: r.domain for r in lookup.majority_domain(rows, "id", "cs", cats, "c", "d").collect()} == {1: "two", 2: "two", 3: "Unknown", 4: "Unknown", 5: "Unknown"}
    assert {r.id: r.domain for r in lookup.first_domain(rows, "cs", cats, "c", "d").collect()} == {1: "two", 2: "one", 3: "Unknown", 4: "Unknown", 5: "Unknown"}


def test_vote(spark):
    rows = [(1, 0, "A", None, "r0"), (1, 1, "B", "x", "r1"), (1, 2, "B", "x", "r2"), (2, 0, "A", None, "r"), (2, 1, "B", None, "s"), (2, 2, "C", None, "t")]
    df = spark.createDataFrame(rows, "id int, run int, c string, l string, why string")
    assert {tuple(r) for r in lookup.vote(df, "id", "run", ["c", "l"], "why").collect()} == {(1, "B", "x", "r1"), (2, "A", None, "r")}


def test_rules(spark):
    df = spark.createDataFrame([(1, "proofreading"), (2, "Text editing"), (3, None), (4, "unspecified"), (5, "zzz"), (6, "special"), (7, "gone")], "id int, t string")
    known = spark.createDataFrame([("special", "K")], "text string, category string")
    strict = {r.id: r.category for r in rules.categorise(df, "t", rules.STRICT, known, excluded=["gone"]).collect()}
    assert strict == {1: "Language & Grammar Support", 2: "Writing & Editing Support", 3: None, 4: None, 5: None, 6: "K", 7: None}
    lenient = {r.id: r.category for r in rules.categorise(df, "t", rules.LENIENT, known, default=rules.OTHER).collect()}
    assert lenient[1] == "Writing & Editing Support" and lenient[3] == lenient[5] == rules.OTHER


def test_report(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (5, 4.0), (6, 7.0)], "t int, v double")
    assert [r.m for r in report.centred_mean(s, "t", "v", "m").orderBy("t").collect()] == [None, None, None, None, 5.0, None]
    assert [r.k for r in report.average_ranks(s, "v", "k").orderBy("t").collect()] == [1.0, 2.0, None, 3.5, 3.5, 5.0]
    r = report.spearman(s, "t", "v").first()
    assert (r.n, round(r.rho, 6)) == (5, 0.974679) and 0 < r.p_value < 0.01
    g = report.line_grid(s, "t", "v", 3).orderBy("k").collect()
    assert [x.x for x in g] == [1.0, 3.5, 6.0]
    groups = spark.createDataFrame([("a", 100, 0.5, 0.1, "none"), ("a", 300, 0.1, 0.1, None), ("a", 9, 0.9, 0.1, "extreme_estimate"), ("b", 5, 0.001, 1.0, "extreme_estimate")], "k string, count long, mean double, se double, warning string")
    got = {x.k: x for x in report.roll_up(groups, ["k"]).collect()}
    assert got["a"]["mean"] == pytest.approx(0.2) and got["a"].se == pytest.approx(math.sqrt(100**2 + 300**2) * 0.1 / 400) and (got["b"]["count"], got["b"]["mean"]) == (0, None)
    band = report.bootstrap_band(s, "t", "t", "v", replicates=60, points=4).orderBy("k").collect()
    assert len(band) == 4 and all(x.lower <= x.upper for x in band)
    many = spark.range(500).select((F.col("id") % 2).alias("p"), "id")
    first, second = (sorted(x.id for x in report.sample_by_period(many.repartition(n), "p", "id", 7).collect()) for n in (1, 5))
    assert first == second and len(first) == 14


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', "2024-05"), (2, None, "bad")], "id int, t string, d string")
    files.write_csv(df, str(tmp_path / "c"), single=True, index="t", bom=True)
    back = files.read_csv(spark, str(tmp_path / "c"), "id int, t string, d string, extra double", dates=("d",))
    assert sorted(map(tuple, back.collect())) == [(1, 'a "b", c\nd', date(2024, 5, 1), None), (2, None, None, None)]
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1, "b": ["x"]}, {"a": 2}]))
    assert files.read_records(spark, str(tmp_path / "r.json"), "a int, b array<string>").count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"k": "v", "l": "w"}))
    assert {tuple(r) for r in files.read_mapping(spark, str(tmp_path / "m.json")).collect()} == {("k", "v"), ("l", "w")}
    (tmp_path / "l.txt").write_text("one\n\n  two \n  \nthree")
    assert [tuple(r) for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()] == [(1, "one"), (2, "two"), (3, "three")]
    for _ in range(2):
        files.append_new(df.select("id"), str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_services(spark):
    calls = []

    def shaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError("down")
        return "ok"

    assert services.with_retries(shaky, sleep=lambda s: None)("x") == "ok" and len(calls) == 3
    assert json.loads(services.with_retries(lambda t: 1 / 0, tries=1)("x"))["error"]
    df = spark.createDataFrame([(1, "we must say"), (2, None)], "id int, t string")
    got = {r.id: r.a for r in services.enrich(df, "t", services.stand_in_classifier, "a").collect()}
    assert json.loads(got[1])["category"] == "Require Disclosure" and got[2] is None
    answers = spark.createDataFrame([(1, '{"category":" Prohibit ","reason":"r"}'), (2, "no json"), (3, None), (4, '{"category":"Require Disclosure","disclosure_location":"Methods"}')], "id int, a string")
    rows = {r.id: r for r in services.repair_labels(services.decode_answers(answers, "a"), "category", "disclosure_location").collect()}
    assert (rows[1].category, rows[1].disclosure_location, rows[1].failed) == ("Strict Prohibition", "", False)
    assert rows[2].failed and rows[3].failed and (rows[4].category, rows[4].disclosure_location) == ("Disclosure Required", "Methods")


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", True), ("2024-01-02 00:00:00", "b", False), ("2024-03-01 00:00:00", "c", True), ("2024-03-01 00:00:00", "c", True)]
    df = spark.createDataFrame(rows, "ts string, k string, f boolean").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_shares(newest_version(stream, "k", "ts"), "ts", "f", late=None).writeStream.outputMode("append").format("memory").queryName("shares").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert windowed_shares(df, "ts", "f").agg(F.sum("count")).first()[0] == 4


def test_clean_truncate_cuts_at_the_limit_of_the_service(spark, tmp_path):
    kinds = "row_no long, paper_id string, abstract string, pub_date string, has_policy boolean, is_oa boolean, policy_category string, country_list string, domain_list string, journal_name string"
    texts = [" " + "ab " * 400, "x" * 50_000, "y" * 50_007, "  ", None]
    rows = [(i, "p", t, "2022-03-04", True, True, "c", "", "", "j") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "paper.parquet"))
    got = {r.row_no: r.abstract for r in keywords.clean_truncate(spark, str(tmp_path)).collect()}
    assert got == {0: ("ab " * 400).strip(), 1: "x" * 50_000, 2: "y" * 50_000, 3: None, 4: None}


#: Published rows: count, share, and the bounds that the study gives for them.
SHARES = [(742442, 0.5362250519232479, 0.5350905253981202, 0.537359203587241), (595002, 0.5494233632828125, 0.5481588162514552, 0.5506872721429061)]
#: The same of the mixture, with information and standard error.
MIXED = [
    (0.17531974039430978, 564.7143528655934, 0.04208095497334602, 0.10727969512037326, 0.2733017609367899),
    (0.0504848308213688, 3843293.910793215, 0.0005100916344104317, 0.04949439100388793, 0.05149401673351158),
    (0.37022780898019986, 20.192170613227795, 0.22254021148390263, 0.0830249337069833, 0.7924011311823187),
    (0.1654233249081384, 559.2444772045774, 0.04228624756407057, 0.09808031293362297, 0.26539866900603953),
]


def test_published_intervals(spark):
    lo, hi = stats.wilson(F.col("p"), F.col("n"))
    for r, (_, _, low, high) in zip(spark.createDataFrame([(p, n) for n, p, _, _ in SHARES], "p double, n long").select(lo.alias("lo"), hi.alias("hi")).collect(), SHARES, strict=True):
        assert (r.lo, r.hi) == pytest.approx((low, high), rel=1e-12)
    lo, hi = stats.logit_interval(F.col("a"), F.col("i"))
    for r, (_, _, se, low, high) in zip(spark.createDataFrame([(a, i) for a, i, *_ in MIXED], "a double, i double").select(lo.alias("lo"), hi.alias("hi"), (1 / F.sqrt("i")).alias("se")).collect(), MIXED, strict=True):
        assert (r.lo, r.hi, r.se) == pytest.approx((low, high, se), rel=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_mixture_sides_agree_with_ties_and_null_keys(spark, seed):
    r = np.random.default_rng(seed)
    frame = pd.DataFrame({"g": r.choice(["a", "b"], 120), "h": r.choice([1, 2], 120), "lp_human": r.choice([-40.0, -41.5, -600.0], 120)})
    frame["lp_ai"] = frame.lp_human + r.choice([-2.0, 0.0, 1.0, 3.0], 120)
    df = spark.createDataFrame(frame).withColumn("h", F.when(F.col("h") == 1, 1))
    one, many = ({(x.g, x.h): x for x in mixture.solve(df, ["g", "h"], some=["g"], at_hand=k).collect()} for k in (1_000, 0))
    assert set(one) == set(many) == {("a", 1), ("a", None), ("b", 1), ("b", None)}
    for k, x in one.items():
        assert x["count"] == many[k]["count"]
        for c in ("alpha", "fisher_info", "profile_lower", "profile_upper"):
            assert x[c] == pytest.approx(many[k][c], rel=1e-7, abs=1e-9)


def test_sets_of_groups_equal_single_ones(spark):
    r = np.random.default_rng(5)
    frame = pd.DataFrame({"y": r.choice([2021, 2022], 200), "m": r.choice(["a", "a|b", "", "b"], 200), "lp_human": r.choice([-40.0, -41.0], 200)})
    frame["lp_ai"] = frame.lp_human + r.choice([-2.0, 1.0, 3.0], 200)
    df = spark.createDataFrame(frame)
    member = lambda d, s: prevalence.each_member(d, "m", keep_blank=True) if "m" in s else d
    got = {(x.y, x.m): x for x in mixture.estimate_sets(df, [("y",), ("y", "m"), ("m",)], member).collect()}
    for keys in (("y",), ("y", "m"), ("m",)):
        for x in mixture.estimates(member(df, keys), keys).collect():
            own = got.pop((x.y if "y" in keys else None, x.m if "m" in keys else None))
            assert own["keys"] == "+".join(keys) and own["count"] == x["count"] and own["mean"] == pytest.approx(x["mean"], abs=1e-12)
    assert not got


def test_bounds_fall_back_where_the_profile_has_none(spark):
    rows = [("a", 60, 0.3, 100.0, 0.2, 0.4), ("b", 60, 0.3, 100.0, None, None), ("c", 40, 0.3, 100.0, 0.2, 0.4)]
    df = spark.createDataFrame(rows, "g string, count long, alpha double, fisher_info double, profile_lower double, profile_upper double")
    got = {x.g: x for x in mixture.with_bounds(df, ["g"], "profile").collect()}
    assert [got[g].ci_method for g in "abc"] == ["profile_likelihood", "fisher_logit_fallback", "fisher_logit"]
    assert got["a"].ci_lower == 0.2 and got["b"].ci_lower == got["c"].ci_lower != 0.2


def test_large_lexicons_give_the_same(spark):
    lexicon = spark.createDataFrame([("good", 0.2, 0.1), ("new", 0.0, 0.5)], "word string, p_human double, p_ai double")
    df = spark.createDataFrame([(1, "good new good"), (2, None), (3, "Good"), (4, "")] + [(i, "new") for i in range(5, 60)], "id int, t string")
    small, large = ({r.id: (r.lp_human, r.lp_ai) for r in mixture.log_probabilities(df, "id", "t", lexicon, at_hand=k).collect()} for k in (10, 0))
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)
    lower = mixture.log_probabilities(df, "id", "t", lexicon, extract=lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), " ")).where("id = 3").first()
    assert lower.lp_human == pytest.approx(math.log(0.2 + 1e-10))


def test_lookups_by_alias_and_reports(spark):
    df = spark.createDataFrame([("A.",), ("B",), (None,), ("A.",), ("C",)], "x string")
    aliases = spark.createDataFrame([("A.", "Alpha"), ("A.", "Aleph"), (None, "None")], "a string, c string")
    assert sorted(str(r.y) for r in lookup.by_alias(df, "x", aliases, "a", "c", "y").collect()) == ["Aleph", "Aleph", "B", "C", "None"]
    counts = lookup.frequencies(df, F.col("x"), "x")
    assert [tuple(r) for r in lookup.most_frequent(counts, "x").collect()] == [("A.", 2), ("B", 1), ("C", 1)]
    assert lookup.most_frequent(counts, "x", n=1).count() == 1
    assert [r.x for r in lookup.unmatched_sample(df, F.col("x") == "B", "x", 1).collect()] == ["A."]
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 1, "n")], "k string, n int, v string")
    assert sorted(r.v for r in lookup.first_row(rows, ["k"], ["n"]).collect()) == ["a", "n"]


def test_more_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffn,x,s\n1,2.5,a\n2,,b\n")
    assert dict(files.read_csv(spark, str(tmp_path / "t.csv"), infer=True).dtypes) == {"n": "int", "x": "double", "s": "string"}
    df = spark.createDataFrame([(1, ["a"], None), (2, [], "x")], "id int, xs array<string>, s string")
    files.write_records(df, str(tmp_path / "j"))
    assert sorted(spark.read.json(str(tmp_path / "j"), schema=df.schema).collect()) == sorted(df.collect())
    (tmp_path / "w.json").write_text(json.dumps({"one": 1, "two": 2}))
    assert text.read_words(str(tmp_path / "w.json")) == ["one", "two"]
    lines = [f"line {i}" if i % 3 else "  " for i in range(2_000)]
    (tmp_path / "many.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.read_lines(spark, str(tmp_path / "many.txt"))
        assert [tuple(r) for r in got.orderBy("id").collect()] == list(enumerate((x for x in lines if x.strip()), 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files.append_new(df.where("id = 1").select("id"), str(tmp_path / "p"), "id")
    files.append_new(df.select("id"), str(tmp_path / "p"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 2]


def test_answers_that_are_no_json_are_asked_for_again(spark):
    answers = iter(["no json", "[1]", '{"a":1}'])
    assert services.with_retries(lambda t: next(answers), sleep=lambda s: None, valid=services.is_json_object)("x") == '{"a":1}'
    assert services.with_retries(lambda t: "never", tries=2, sleep=lambda s: None, valid=services.is_json_object)("x") == "never"
    df = spark.createDataFrame([("x",), (None,)], "t string")
    assert {r.a for r in services.enrich(df, "t", lambda t: "bad", "a", tries=2, wait=0.0, valid=services.is_json_object).collect()} == {"bad", None}


def test_cut_tables_and_stored_ones(spark, tmp_path):
    df = spark.range(5)
    table = lineage.cut(df)
    place = table.inputFiles()[0].rsplit("/", 1)[0]
    assert table.count() == 5 and lineage.exists(spark, place)
    assert lineage.release(spark) >= 1 and not lineage.exists(spark, place) and lineage.release(spark) == 0
    path, built = str(tmp_path / "kept"), []
    for _ in range(2):
        assert lineage.stored(spark, path, lambda: built.append(1) or df).count() == 5
    assert len(built) == 1
    assert lineage.one_process("local[4]") and lineage.one_process("local") and not lineage.one_process("local-cluster[2,1,1024]") and not lineage.one_process("spark://a:7077")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://a:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(session)


def test_published_fixed_values():
    assert len(ENGLISH) == len(set(ENGLISH)) == 31 and "IN" not in ENGLISH
    assert len(rules.EXCLUDED) == 23
