import pytest
from pyspark.sql import functions as F

from quillmill.functions import dates as D
from quillmill.functions import json_query as J
from quillmill.functions import linguistics as L
from quillmill.functions import markup as M
from quillmill.functions import text as T
from quillmill.functions import urls as U
from quillmill.functions.sentiment import Scorer


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col.alias("y")).first()["y"]


def X():
    return F.col("x")


def test_tokenizer_fixtures(spark):
    got = one(spark, T.sentences(X()), "Hello, world/foo|bar. Next one!")
    assert got == [["Hello", "world", "foo", "bar"], ["Next", "one"]]
    assert one(spark, T.sentences(X()), "It's X-Y") == [["It's", "X-Y"]]
    assert one(spark, T.sentences(X()), " ..  ") == []
    assert [(r.sent_ix, r.token) for r in one(spark, T.placed_tokens(T.sentences(X())), "a b. . c")] == [(0, "a"), (0, "b"), (1, "c")]


@pytest.mark.parametrize(("text", "want"), [("a  ,b ( c )", "a,b (c)"), (" a\t\nb﻿ . ", "a b."), ("", ""), ("( x ; y", "(x; y")])
def test_tidy(spark, text, want):
    assert one(spark, T.tidy(X()), text) == want


def test_text_functions(spark):
    assert one(spark, T.encode_percentage(X()), "100% %41 %4") == "100%25 %41 %254"
    assert one(spark, T.join_values(X(), ";"), ["a", "", "b"], "array<string>") == "a;b"
    assert one(spark, T.join_values(X(), ";", False), ["a", "", "b"], "array<string>") == "a;;b"
    assert [T.first_or_escape(o) for o in ("\\n", "\\t", ",;", "\\\\", "")] == ["\n", "\t", ",", "\\", ""]
    assert one(spark, T.split_text(X(), "."), "a.b.") == ["a", "b", ""] and one(spark, T.split_text(X(), "."), "") == []
    assert one(spark, T.to_bool(X()), " True ") is True
    assert one(spark, T.latin1_to_utf8(X()), b"\xe9", "binary") == "é"


@pytest.mark.parametrize(
    ("date", "resolution", "want"),
    [("2021-01-03", "weeks", "2020-#53"), ("2024-12-30", "weeks", "2025-#01"), ("2020-02-03", "days", "2020-02-03"), ("2020-02-03", "months", "2020-02"), ("2020-02-03", "years", "2020")],
)
def test_reduce_date(spark, date, resolution, want):
    assert one(spark, D.reduce_date(X(), resolution), date) == want


def test_reduce_date_refuses_other_lengths(spark):
    with pytest.raises(Exception, match="not an ISO date"):
        one(spark, D.reduce_date(X(), "months"), "2021-1-3")


@pytest.mark.parametrize(
    ("text", "fmt", "lang", "want"),
    [
        ("0", "UNIX+3600", None, "1969-12-31 23:00:00"), ("1.6", "UNIX", None, "1970-01-01 00:00:02"), ("2020-03-04 05:06:07", "%F %T", None, "2020-03-04 05:06:07"),
        ("3rd March 2020", "%d %B %Y", "en", "2020-03-03 00:00:00"), ("1er février 2020", "%d %B %Y", "fr", "2020-02-01 00:00:00"),
        ("5. März 2021", "%d. %B %Y", "de", "2021-03-05 00:00:00"), ("7/8/68", "%m/%d/%y", None, "2068-07-08 00:00:00"), ("7/8/70", "%m/%d/%y", None, "1970-07-08 00:00:00"),
        ("Tue, 5 Jan 2021 3:04 pm", "%a, %d %b %Y %I:%M %p", "en", "2021-01-05 15:04:00"), ("nonsense", "%F", None, None),
    ],
)
def test_parse_datetime(spark, text, fmt, lang, want):
    assert one(spark, D.parse_datetime(X(), fmt, lang), text) == want


def test_date_ranges_and_gaps(spark):
    assert one(spark, D.in_range(X(), "2020-01-05", ""), "2020-01-05") is True
    assert one(spark, D.in_range(X(), "2020-01-05", "2020-01-06"), "2020-01-07") is False
    assert one(spark, D.in_range(X()), "2020-1-5") is False
    for res, ends, want in (
        ("months", ("2020-11", "2021-02"), ["2020-11", "2020-12", "2021-01", "2021-02"]),
        ("weeks", ("2020-#52", "2021-#01"), ["2020-#52", "2020-#53", "2021-#01"]),
        ("years", ("2019", "2021"), ["2019", "2020", "2021"]),
    ):
        df = spark.createDataFrame([(e, 1) for e in ends], "date string, n int")
        rows = sorted(D.fill_gaps(df, res).collect())
        assert [r.date for r in rows] == want and sum(r.n for r in rows) == 2
    assert one(spark, D.pretty_duration(X()), 90_061_001, "long") == "1d 1h 1min 1s 1ms"


def test_json_pointer_and_path():
    doc = {"a": [{"x": 1}, {"y": 2}, {"x": 3}], "n": None, "s": "t", "m": [["p", 1]], "k/~": 5}
    assert J.pointer_all(doc, "/a/$$/x") == ["1"]
    assert J.pointer_bool(doc, "/n") and not J.pointer_bool(doc, "/z") and J.pointer(doc, "/k~1~0") == 5
    assert J.pointer_first(doc, "/a") == '{"x":1}' and J.pointer_first(doc, "/a", True).startswith("[")
    assert J.pointer_subsets(doc, "/n") == [] and J.pointer_subsets(doc, "/a/$$")[1] == '{"y":2}'
    assert J.path_all(doc, "$..x") == ["1", "3"] and J.path_first(doc, "$.m[0]") == "p" and J.path_all(doc, "$.m") == ['["p",1]']
    assert J.path_all(doc, "$.a[?(@.x > 1)].x") == ["3"] and J.path_all(doc, "$.a[-1:]") == ['{"x":3}'] and J.path_all(doc, "$['s','k/~']") == ["t", "5"]
    assert J.path_bool(doc, "$.a[?(@.y)]") and not J.path_bool(doc, "$.q") and J.parse("{") is J.parse(None)
    with pytest.raises(ValueError, match="JSONPath"):
        J.path_values(doc, "a.b")


HTML = "<p>One<p class=b>Two <b>bold</b><ul><li>x<li>y</ul><a href='/l?a=1&amp;b=2'>L</a><br>z<![CDATA[q<r]]><!-- c -->"


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//p", ["One", "Two bold"]), ("//p[@class='b']/b", ["bold"]), ("//li[2]", ["y"]), ("//li[last()]", ["y"]), ("//a/@href", ["/l?a=1&b=2"]), ("count(//li)", ["2"]),
        ("//ul/li[contains(., 'x')]", ["x"]), ("/html/body/p[1]/text()", ["One"]), ("//b | //li", ["bold", "x", "y"]), ("string(//b)", ["bold"]), ("//li[position() < 2]", ["x"]),
        ("//b/ancestor::p/@class", ["b"]), ("//li[not(. = 'x')]", ["y"]), ("normalize-space(//p[2])", ["Two bold"]), ("//none", []), ("//li/following-sibling::li", ["y"]),
    ],
)
def test_xpath(path, want):
    assert M.xpath_all(M.parse(HTML), M.XPath(path), text_only=True) == want


def test_xpath_results():
    doc = M.parse(HTML)
    assert M.xpath_bool(doc, M.XPath("//li = 'y'")) and not M.xpath_bool(doc, M.XPath("//h1"))
    assert M.xpath_first(doc, M.XPath("//p[2]")) == "Two <b>bold</b>"
    assert M.xpath_subsets(doc, M.XPath("//li")) == ["<li>x</li>", "<li>y</li>"]
    assert M.parse("  ") is None and M.xpath_first(None, M.XPath("//p")) == ""
    xml = M.parse("<?xml version='1.0'?><r><Loc>a</Loc><Loc/></r>")
    assert M.xpath_all(xml, M.XPath("/r/Loc | /r/loc")) == ["a"]
    with pytest.raises(M.XPathError):
        M.XPath("//p[")


def test_references_without_semicolon():
    page = "<title>a&amp;&amp</title><p title='x&lt;&lt y&amp=z'>1 &#x27;&#x27 &#39;&#3 &ampx; &am & &quot;</p><!-- &amp --><script>a&&b &amp;</script>"
    first = lambda path, **kw: M.xpath_first(M.parse(page, **kw), M.XPath(path), text_only=True)
    assert first("//title") == "a&&" and first("//title", closed_refs=True) == "a&&amp"
    assert first("//p", closed_refs=True) == "1 '&#x27 '&#3 &ampx; &am & \"" and first("//p/@title", closed_refs=True) == "x<&lt y&amp=z"
    assert first("//script", closed_refs=True) == first("//script") == "a&&b &amp;"
    assert "<!-- &amp -->" in M.parse(page, closed_refs=True).inner()


def test_urls(spark):
    assert U.resolve_link("../x y#f", "http://Ex.com/a/b/c") == "http://ex.com/a/x%20y"
    assert U.resolve_link("//h.org", "https://a.b/") == "https://h.org/" and U.resolve_link("mailto:a@b", "http://x/") == "" and U.resolve_link(" #a", "http://x/") == ""
    assert one(spark, U.filter_params(X(), blacklist=["a"]), "/p?a=1&b=2") == "/p?b=2"
    assert one(spark, U.filter_params(X(), whitelist=["a"]), "/p?a=1&b=2") == "/p?a=1" and one(spark, U.filter_params(X(), blacklist=["a"]), "/p?a") == "/p"
    assert one(spark, U.path_and_query(X()), "http://a.b/c?d#e") == "/c?d" and one(spark, U.same_domain(X(), "A.b"), "http://a.b/c") is True


@pytest.mark.parametrize(
    ("token", "stem"),
    [("running", "run"), ("flies", "fli"), ("happily", "happili"), ("nationalization", "nation"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("generously", "generous"), ("(Cats)", "cat"), ("a", "a"), ("consistency", "consist"), ("knightly", "knight")],
)
def test_stem_english(token, stem):
    assert L.stem_english(token) == stem


@pytest.mark.parametrize(("token", "stem"), [("Häuser", "hau"), ("gelaufen", "lauf"), ("Kinder", "kind"), ("Straße", "strass"), ("der", "der")])
def test_stem_german(token, stem):
    assert L.stem_german(token) == stem


def test_trim_and_correct():
    assert L.trim_token("ververlaufens", ["ver"], ["s", "en"]) == "lauf" and L.trim_token("ver", ["ver"], []) == "ver"
    assert L.correct("teh", {"the": 5, "ten": 1}) == "the" and L.correct("the", {"the": 5}) == "the" and L.correct("zzzz", {"the": 5}) == "zzzz"


def test_sentiment():
    s = Scorer({"good": 1.9, "bad": -2.5, "great": 3.1}, {"☺": "good"})
    c = lambda t: s.score(t.split())["compound"]
    assert c("it is good") > 0 > c("it is bad") and c("it is very good") > c("it is good") > c("it is slightly good")
    assert c("it is not good") < 0 and c("it is GOOD") > c("it is good") and c("") == 0.0 and c("so ☺") > 0
    assert c("good but bad") < 0 and abs(sum(s.score("a good day".split())[k] for k in ("pos", "neg", "neu")) - 1) < 1e-9
