"""Text helpers and the heuristic scorer against plain-Python semantics."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.functions import text as T
from issuelens.functions.score import with_heuristic

EDGE_TEXTS = [
    "", "   ", "\n\t", "\xa0word\xa0", "\x1cx\x1f", "a \U0001F600 b", "one-line ![a](b) image",
    "split ![a\n](b) image", "two ``", "`code`", "```block```", "HTTPS://x", "http:/x", "<IMG src=x>",
    "tab\tsep\x0bvt", "　ideographic　space　", "trailing  ", None,
]


def test_strip_and_words_match_python(spark):
    df = spark.createDataFrame([(t,) for t in EDGE_TEXTS], "s string")
    rows = df.select(T.py_strip("s").alias("st"), T.py_word_count("s").alias("wc")).collect()
    for t, r in zip(EDGE_TEXTS, rows):
        if t is None:
            assert r.st is None and r.wc == 0
        else:
            assert r.st == t.strip(), repr(t)
            assert r.wc == len(t.split()), repr(t)


def test_patterns_match_python(spark):
    texts = [t for t in EDGE_TEXTS if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(T.has_code("s").alias("c"), T.has_image("s").alias("i"), T.has_url("s").alias("u")).collect()
    for t, r in zip(texts, rows):
        assert r.c == (1 if re.search(r"```|`[^`]+`", t, re.I) else 0), repr(t)
        assert r.i == (1 if re.search(r"!\[.*\]|<img", t, re.I) else 0), repr(t)
        assert r.u == (1 if re.search(r"http[s]?://", t, re.I) else 0), repr(t)


def test_split_trim_list(spark):
    vals = ["a, b,,  c ", "", None, " , ", "x"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(T.split_trim_list("s")).collect()]
    exp = [[x.strip() for x in (v or "").split(",") if x.strip()] for v in vals]
    assert got == exp


# title, body, labels -> class and p(simple), p(moderate), p(complex), worked out by hand from
# share = 0.6 * min(1, chars / 4000) + 0.4 * min(1, words / 800), plus the label points, clipped to 0..1.
HEURISTIC_CASES = [
    ("", "", [], "simple", 1.0, 0.0, 0.0),
    (None, None, None, "simple", 1.0, 0.0, 0.0),
    # 13 chars, 3 words: 0.00195 + 0.0015, perf +0.15, docs -0.1 -> 0.05345
    ("Perf issue", "x", ["Docs"], "simple", 0.8931, 0.1069, 0.0),
    # 1502 chars, 301 words: 0.2253 + 0.1505, security +0.25, bug +0.1 -> 0.7258
    ("t", "word " * 300, ["SECURITY", "bug"], "moderate", 0.0, 0.5484, 0.4516),
    # chars saturate: 0.6 + 0.001, performance +0.15, docs -0.1 -> 0.651
    ("t", "a" * 5000, ["performance", "docs"], "moderate", 0.0, 0.698, 0.302),
    # stripped: "spaced", blank line, "body" = 12 chars, 2 words: 0.0018 + 0.001, bug +0.1, security +0.25 -> 0.3528
    ("  spaced  ", "\n\n body \n", ["regression", "cve"], "moderate", 0.2944, 0.7056, 0.0),
    # 749 chars, 250 words: 0.11235 + 0.125 -> 0.23735
    ("", ("ab " * 250).strip(), [], "simple", 0.5253, 0.4747, 0.0),
    # 1000 chars, 200 words: 0.15 + 0.1 = 0.25, a tie of simple and moderate
    ("", "aaaa " * 199 + "aaaaa", [], "simple", 0.5, 0.5, 0.0),
    # the same text with +0.25 +0.15 +0.1 = 0.75, a tie of moderate and complex
    ("", "aaaa " * 199 + "aaaaa", ["security", "performance", "bug"], "moderate", 0.0, 0.5, 0.5),
    # both shares saturate, clipped to 1
    ("", "x" * 4000 + " " + " ".join(["y"] * 799), ["security"], "complex", 0.0, 0.0, 1.0),
    # docs alone would fall below 0
    ("", "x", ["documentation"], "simple", 1.0, 0.0, 0.0),
]


def test_heuristic_by_hand(spark):
    rows = [(i, c[0], c[1], c[2]) for i, c in enumerate(HEURISTIC_CASES)]
    df = spark.createDataFrame(rows, "id long, title string, body string, labels array<string>")
    for r in with_heuristic(df).collect():
        _, _, _, cls, ps, pm, pc = HEURISTIC_CASES[r.id]
        assert r.complexity == cls, r.id
        for got, want in ((r.p_simple, ps), (r.p_moderate, pm), (r.p_complex, pc), (r.confidence, max(ps, pm, pc))):
            assert abs(got - want) < 1e-12, r.id


def test_label_objects_and_text_score_like_names(spark):
    names = spark.createDataFrame([("t", "b", ["bug", "CVE"])], "title string, body string, labels array<string>")
    objects = spark.createDataFrame([("t", "b", [("bug",), ("CVE",)])],
                                    "title string, body string, labels array<struct<name:string>>")
    text = spark.createDataFrame([("t", "b", "bug, CVE")], "title string, body string, labels string")
    points = {with_heuristic(d).first().p_simple for d in (names, objects, text)}
    assert len(points) == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=400),
                          st.lists(st.sampled_from(["bug", "Docs", "perf", "performance", "CVE", "x"]), max_size=3)),
                min_size=1, max_size=40))
def test_heuristic_property(spark, items):
    """Probabilities lie in 0..1, sum to 1, and the class is the likeliest one."""
    df = spark.createDataFrame([(i, t, b, l) for i, (t, b, l) in enumerate(items)],
                               "id long, title string, body string, labels array<string>")
    for r in with_heuristic(df).collect():
        probs = {"simple": r.p_simple, "moderate": r.p_moderate, "complex": r.p_complex}
        assert all(0 <= p <= 1 for p in probs.values()) and abs(sum(probs.values()) - 1) < 1e-9
        assert probs[r.complexity] == max(probs.values()) == r.confidence


FEATURE_CASES = [
    # title, body, labels -> len_title, len_body, word_count, has_code, has_image, has_url, labels_count
    ("Perf", "use `x` now", ["a", "b"], 4, 11, 3, 1, 0, 0, 2),
    (None, None, None, 0, 0, 0, 0, 0, 0, 0),
    ("t", "![a](b.png) at HTTPS://x.y", [], 1, 26, 3, 0, 1, 1, 0),
    ("t", "<IMG src=x> ``", ["a"], 1, 14, 3, 0, 1, 0, 1),
]


def test_features_by_hand(spark):
    from issuelens.operators.features import numeric_text_features

    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(FEATURE_CASES)],
                               "id long, title string, body string, labels array<string>")
    for r in numeric_text_features(df).collect():
        got = (r.len_title, r.len_body, r.word_count, r.has_code, r.has_image, r.has_url, r.labels_count)
        assert got == FEATURE_CASES[r.id][3:], r.id
        assert r.reactions == 0


def test_given_reactions_and_label_counts_are_used(spark):
    from issuelens.operators.features import numeric_text_features

    df = spark.createDataFrame([("t", "b", ["x"], "7", "3.0"), ("t", "b", [], None, "nan")],
                               "title string, body string, labels array<string>, reactions string, labels_count string")
    out = numeric_text_features(df)
    assert out.columns.count("reactions") == 1 and out.columns.count("labels_count") == 1
    assert sorted((r.reactions, r.labels_count) for r in out.collect()) == [(0, 0), (7, 3)]


def test_number_and_percent_formats(spark):
    df = spark.createDataFrame([(0.125, "hELLO wOrld-x")], "x double, s string")
    r = df.select(T.percent("x"), T.percent("x", 1), T.percent("x", 2), T.number0(F.lit(2.5)), T.title_case("s")).first()
    assert tuple(r) == ("12%", "12.5%", "12.50%", "2", "Hello World-X")


def test_whole_numbers(spark):
    texts = ["3", "3.0", "nan", "abc", None, "-2", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(T.whole_number(F.col("s"))).collect()] == [3, 3, None, None, None, -2, 1000]


def test_complexity_label(spark):
    vals = [None, -1, 0, 1, 2, 5, 6, 100]
    from issuelens.functions.score import complexity_label as cl

    df = spark.createDataFrame([(v,) for v in vals], "c long")
    got = [r[0] for r in df.select(cl(F.col("c"))).collect()]
    assert got == [2, 0, 0, 0, 1, 1, 2, 2]


def test_whole_numbers_are_exact(spark):
    from issuelens.functions.text import whole_number

    given = {"9007199254740993": 9007199254740993, "9007199254740993.0": 9007199254740993, "3": 3, "3.0": 3, "nan": None, "": None, "x": None,
             "-7": -7, "1e3": 1000, "1e30": None, "9223372036854775807": 9223372036854775807, None: None}
    df = spark.createDataFrame([(k,) for k in given], "s string")
    from pyspark.sql import functions as F

    got = {r.s: r.n for r in df.select("s", whole_number(F.col("s")).alias("n")).collect()}
    assert got == given


def test_patterns_are_tried_only_where_their_characters_stand(spark):
    texts = [None, "", "`", "``", "```", "`a`", "a`\n`b", "![", "![x]", "! [x]", "<IMG", "< img", "<img src>", "![a\nb]", "HTTP://x", "https://", "http:/", "ftp://x", "://", "httpS://"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, s string")
    for found, regex in ((T.has_code, T.HAS_CODE_RE), (T.has_image, T.HAS_IMAGE_RE), (T.has_url, T.HAS_URL_RE)):
        assert "contains" in str(found("s")).lower()
        assert df.where(found("s") != T.has_pattern("s", regex)).count() == 0
    assert df.where(T.has_image("s") == 1).count() == 3 and df.where(T.has_url("s") == 1).count() == 3
