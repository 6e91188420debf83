import datetime
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quillmill.operators import corpus as C
from quillmill.operators import crawl as K
from quillmill.operators import query as Q
from quillmill.operators import records as P
from quillmill.operators import relational as R
from quillmill.plans import algorithms as A
from quillmill.sources import sinks, tables


def arts(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], "source string, article_id string, date string, text string")


def test_association_window(spark):
    df = arts(spark, ("1", "2020-01-01", "k a b c k"), ("2", "2020-01-01", "a b"), ("3", None, "k c"))
    rows = {r.id: (r.occurrences, r.cat) for r in A.Assoc("^k$", {"cat": "^c$", "": "x"}, 2).run(df).collect()}
    assert rows == {"1": (2, 1), "2": (0, 0)}
    both = A.Assoc("^k$", {"cat": "^[kc]$"}, 4).run(df).where("id = '1'").first()
    assert both.cat == 2  # a keyword token is no category token
    with pytest.raises(ValueError, match="keyword"):
        A.Assoc("", {}, 1)


def test_words_over_time_fills_gaps_and_adds_up(spark):
    df = arts(spark, ("1", "2020-11-05", "a b. c!"), ("2", "2020-11-09", "d"), ("3", "2021-02-01", "e f"), ("4", "2021-02-01", ".,"))
    rows = sorted(map(tuple, A.WordsOverTime("months").run(df).collect()))
    assert rows == [("2020-11", 2, 3, 4), ("2020-12", 0, 0, 0), ("2021-01", 0, 0, 0), ("2021-02", 1, 1, 2)]
    assert sum(r[3] for r in rows) == C.tokens(df).count()


def test_statistics_truncate_even_medians(spark):
    df = arts(spark, ("1", "2020-01-01", "a bb"))
    assert A.CorpusStatistics().run(df).first().med_tokenlen == 1.0
    assert A.CorpusStatistics(truncate_median=False).run(df).first().med_tokenlen == 1.5


def test_article_filters(spark):
    df = arts(spark, ("1", "2020-01-01", "x y"), ("2", "2020-01-02", "x"), ("3", None, "z"))
    ids = lambda d: sorted(r.article_id for r in d.collect())
    assert ids(C.filter_articles(df, ["^x$", "^y$"])) == ["1", "2"] and ids(C.filter_articles(df, ["^x$", "^y$"], True)) == ["1"]
    assert ids(C.filter_by_date(df, "2020-01-02", "")) == ["2"]
    q = [Q.Query("regex", "^x$", "bool"), Q.Query("regex", "^y$", "bool")]
    assert ids(C.filter_tokens_by_queries(C.tokens(df), q, True).select("article_id").distinct()) == ["1"]


def test_combine_and_check(spark):
    a, b = arts(spark, ("1", "2020-01-01", "a b"), (None, None, "u")), arts(spark, ("1", "2020-01-01", "c"))
    toks = C.tokens(C.combine([a, b]))
    assert [(r.tok_ix, r.token) for r in toks.where("article_id = '1'").orderBy("tok_ix").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert C.check(toks).count() == 0 and C.check(toks.where("tok_ix != 1")).count() == 1


def test_manipulators_all_apply_in_turn(spark):
    toks = C.tokens(arts(spark, ("1", "2020-01-01", "the running cats. the end")))
    stops = spark.createDataFrame([("the",)], "token string")
    out = C.manipulate(toks, [C.remove(stops), C.stem_english()]).orderBy("tok_ix").collect()
    assert [(r.sent_ix, r.tok_ix, r.token) for r in out] == [(0, 0, "run"), (0, 1, "cat"), (1, 2, "end")]
    lemmas = spark.createDataFrame([("cats", "cat", "NNS", 5), ("cats", "cot", "VB", 9)], "form string, lemma string, tag string, count long")
    assert C.manipulate(toks, [C.tag(lambda t: "NN"), C.lemmatize(lemmas)]).where("token = 'cat'").count() == 1
    assert C.manipulate(toks, [C.trim(["c"], ["s"])]).where("token = 'at'").count() == 1


def test_text_maps(spark):
    df = spark.createDataFrame([(1, 1, "abc"), (1, 2, "de")], "c int, o int, text string")
    m = C.text_map(df, F.col("o").cast("string"), F.col("o"), "c")
    assert [(r.ordinal, r.p, r.l, r.v) for r in C.map_entries(m, "map").orderBy("ordinal").collect()] == [(1, 0, 3, "1"), (2, 4, 2, "2")]
    assert C.locate(m, "map", F.lit(4)).first().v == "2"


def test_queries_of_all_types(spark):
    df = spark.createDataFrame([('<div>{"a":[1,2]}</div> ab12cd3',), (None,), ("",)], "t string")
    qs = {
        "r": Q.Query("regex", "[0-9]+(?=cd)"), "rm": Q.Query("regex", "[0-9]", "multi"), "x": Q.Query("xpath", "//div", "single", True), "xb": Q.Query("xpath", "//p", "bool"),
        "xp": Q.Query("xpathjsonpointer", "//div\n/a/1"), "xj": Q.Query("xpathjsonpath", "//div\n$.a[*]", "multi"),
    }
    rows = Q.evaluate(df, "t", qs).collect()
    assert tuple(rows[0])[1:] == ("12", ["1", "2", "1", "2", "3"], '{"a":[1,2]}', False, "2", ["1", "2"])
    assert all(tuple(r)[1:] == ("", [], "", False, "", []) for r in rows[1:])
    with pytest.raises(ValueError, match="no such query"):
        Q.Query("sql", "x")
    assert Q.test_query(Q.Query("jsonpath", "$.a"), '{"a":[1,2]}')["multi"] == ["1", "2"]


def test_nested_subsets(spark):
    df = spark.createDataFrame([("<ul><li>a<ul><li>b</li></ul></li></ul>",)], "t string")
    out = Q.nested_subsets(df, "t", Q.Query("xpath", "//body/ul", "subsets"), Q.Query("xpath", "//ul//ul", "subsets"), depth=5)
    assert out.count() == 2


def test_parse_records(spark):
    page = "<html><h1> T  1 </h1><p>x</p><p></p><p>y</p><i>5 March 2020</i></html>"
    t = datetime.datetime
    df = spark.createDataFrame([(1, "/a/7", t(2020, 1, 1), page), (2, "/a/7", t(2020, 1, 2), page), (3, "/a/8", t(2020, 1, 1), page), (4, "/b", t(2020, 1, 1), page), (5, "/a/9", t(2020, 1, 3), None)], "id long, url string, crawltime timestamp, content string")
    cfg = P.ParserConfig(
        ids=[P.Value(Q.Query("regex", "[0-9]+$"), P.URL)],
        fields=[P.Field("head", P.Value(Q.Query("xpath", "//h1", text_only=True)), tidy=True), P.Field("ps", P.Value(Q.Query("xpath", "//p", "multi", True)), ";"), P.Field("js", P.Value(Q.Query("xpath", "//p", "multi", True)), json=True)],
        times=[P.Time(P.Value(Q.Query("xpath", "//i", text_only=True)), "%d %B %Y", "en")],
        ignore_ids=["8"],
    )
    rows = {r.parsed_id: r for r in P.parse(df, cfg).collect()}
    assert set(rows) == {"7", "9"} and rows["7"].content_id == 2 and rows["7"].head == "T 1" and rows["7"].ps == "x;y" and rows["7"].js == '["x","y"]'
    assert rows["7"].parsed_datetime == t(2020, 3, 5) and rows["9"].parsed_datetime is None and rows["9"].head == ""


def test_extract_and_link(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>k1<td>v1<tr><td>k2<td>v2</table>")], "id long, content string")
    cfg = P.ExtractorConfig([Q.Query("xpath", "//dl"), Q.Query("xpath", "//tr")], [P.Value(Q.Query("xpath", "//td[1]", text_only=True))], [P.Field("v", P.Value(Q.Query("xpath", "//td[2]", text_only=True)))])
    rows = P.extract(df, cfg).orderBy("subset_ix").collect()
    assert [(r.extracted_id, r.v) for r in rows] == [("k1", "v1"), ("k2", "v2")]
    linked = spark.createDataFrame([(9, "v1")], "id long, extracted_id string")
    assert {r.v: r.link for r in P.link(P.extract(df, cfg), linked, "v").collect()} == {"v1": 9, "v2": None}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, o int")
    once = R.upsert(old, new, ["k"], ["o"])
    twice = R.upsert(once, new, ["k"], ["o"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_crawl_rounds(spark):
    web = {"http://a/1": '<a href="/2">x</a><a href="2#f">y</a><a href="http://b/">z</a>', "http://a/2": '<a href="/3">x</a>', "http://a/3": ""}
    table = spark.createDataFrame(list(web.items()), "url string, content string")
    out = K.crawl(spark.createDataFrame([("http://a/1",)], "url string"), lambda u: u.join(table, "url"), 5, "a")
    assert {r.url: r.depth for r in out.collect()} == {"http://a/1": 0, "http://a/2": 1, "http://a/3": 2}
    n = K.counters(spark.createDataFrame([("/p/$n",), ("/q",)], "url string"), "$n", 1, 3)
    assert sorted(r.url for r in n.collect()) == ["/p/1", "/p/2", "/p/3", "/q"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("good\t1.9\tx\nbad\tno\n\n")
    assert [tuple(r) for r in tables.valence_dictionary(spark, str(tmp_path / "d.tsv")).collect()] == [("good", 1.9)]
    (tmp_path / "u.txt").write_text("url\n/a\n\n/b\r\n")
    assert [r.url for r in tables.import_list(spark, str(tmp_path / "u.txt"), True).collect()] == ["/a", "/b"]
    df = spark.createDataFrame([("a<", 1), (None, 2)], "analyzed__t string, analyzed__n int")
    assert sinks.without_prefix(df, "analyzed__").columns == ["t", "n"]
    with zipfile.ZipFile(BytesIO(sinks.spreadsheet({"one": df}))) as z:
        assert z.namelist()[0] == "mimetype" and b"a&lt;" in z.read("content.xml")
    for kind in ("none", "gzip", "zlib", "zip"):
        assert sinks.decompress(sinks.compress(b"data" * 99, kind), kind) == b"data" * 99
    sinks.export_list(df.withColumnRenamed("analyzed__t", "url").where("url is not null"), str(tmp_path / "out"), "url", compression="gzip")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a<"]
    assert [tables.value_kind(t) for t in ("BIGINT UNSIGNED", "varchar(10)", "tinyint(1)", "decimal(5,2)", "json", "int")] == ["uint64", "string", "bool", "double", "unknown", "int32"]
    src = tables.Source("parsed", "news", "id")
    assert (src.table_name("w"), src.column_name(), src.label) == ("w_parsed_news", "parsed_id", "parsed.news.id")
    assert tables.usable(spark, [src], "w") == ([], ["table w_parsed_news does not exist"])


def test_topics(spark):
    df = arts(spark, *[(str(i), "2020-01-01", ("cat dog cat pet " if i % 2 else "bank money cash bank ") * 5) for i in range(20)])
    algo = A.TopicModelling(k=2, min_df=1, iterations=20)
    model, vec, words = algo.fit(df)
    rows = algo.classify(model, vec, words).collect()
    assert len(rows) == 20 and all(abs(r.k0 + r.k1 - 1) < 1e-6 for r in rows)
    assert algo.topics(model, words).count() == 2 * min(5, len(words))


def test_sentiment_over_time(spark):
    df = arts(spark, ("1", "2020-01-01", "cats are good. cats are bad. dogs are good"))
    r = A.SentimentOverTime({"cat": "^cats$", "dog": "^dogs$"}, "years", threshold=None, articles=True).run(df).first()
    assert (r.cat_N, r.dog_N, r.cat_a_N) == (2, 1, 1) and r.dog > 0 and abs(r.cat - r.cat_a) < 1e-9
    none = A.SentimentOverTime({"cat": "^cats$"}, "years", threshold=100).run(df).collect()
    assert none == []
