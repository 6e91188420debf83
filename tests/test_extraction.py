"""The extractor's loop against pages that a plain Python dictionary holds."""

import json

from pyspark.sql import functions as F

from quillmill.functions.sentiment import BOOST, Scorer
from quillmill.operators import extraction as X
from quillmill.operators import records as P
from quillmill.operators.query import Query
from quillmill.plans.config import extractor_config


class Site:
    """Pages by URL as (responses in turn, content); a URL that isn't there answers 404."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def fetch(self, urls):
        spark, rows = urls.sparkSession, []
        for u in sorted(r.url for r in urls.collect()):
            codes, content = self.pages.get(u, ([404], ""))
            seen = self.asked.count(u)
            self.asked.append(u)
            rows.append((u, codes[min(seen, len(codes) - 1)], content))
        return spark.createDataFrame(rows, "url string, response int, content string")


def docs(spark):
    rows = [(1, "/c/11", "<a>k=7</a> pages: 3"), (2, "/c/12", "<a>k=8</a> pages: 1"), (3, "/c/13", "<a>k=skip</a> pages: 2")]
    return spark.createDataFrame(rows, "id long, url string, content string")


def q(text, kind="single", type_="regex"):
    return Query(type_, text, kind)


def test_variables_tokens_numbered_pages_and_retries(spark):
    pages = {f"/t/{k}": ([200], f"tok{k}") for k in (7, 8)}
    pages |= {f"/p/{n}/{tok}/{p}": ([503, 200] if p == 1 else [200], f"pages: {c} item{n}-{p}") for n, tok, c in ((12, "tok7", 3), (13, "tok8", 1)) for p in range(4)}
    site = Site(pages)
    plan = X.Pages(
        "/p/$num/$tok/$page", variables=[X.Variable("n", P.Value(q("[0-9]+$"), P.URL), "num", 1), X.Variable("k", P.Value(q("(?<=k=)[a-z0-9]+")), skip=q("skip", "bool"))],
        tokens=[X.Token("tok", "/t/$k", q("tok[0-9]+"))], paging=X.Paging(number=q("(?<=pages: )[0-9]+")),
    )
    got = X.gather(docs(spark), plan, site.fetch).collect()
    assert sorted((r.id, r.page, r.page_url) for r in got) == [(1, "0", "/p/12/tok7/0"), (1, "1", "/p/12/tok7/1"), (1, "2", "/p/12/tok7/2"), (2, "0", "/p/13/tok8/0")]
    assert site.asked.count("/p/12/tok7/1") == 2 and not any("skip" in u for u in site.asked)


def test_named_next_pages_errors_and_a_first_url(spark):
    pages = {"/first/1": ([200], "next=b"), "/x/b": ([200], "next=c"), "/x/c": ([200], "wrong"), "/first/2": ([200], "over"), "/first/3": ([500], "next=z")}
    plan = X.Pages("/x/$page", "/first/$i", [X.Variable("i", P.Value(q(".$"), P.URL))], paging=X.Paging(next=q("(?<=next=)[a-z]")), error_fail=[q("wrong", "bool")], retries=0)
    rows = spark.createDataFrame([(i, f"/{i}", "") for i in (1, 2, 3)], "id long, url string, content string")
    got = X.gather(rows, plan, Site(pages).fetch).collect()
    assert sorted((r.id, r.page_url) for r in got) == [(1, "/first/1"), (1, "/x/b"), (2, "/first/2")]
    assert X.gather(rows.where("false"), plan, Site(pages).fetch).count() == 0


def test_pages_until_a_query_says_no(spark):
    pages = {f"/x/{n}": ([200], "more" if n < 25 else "end") for n in (5, 15, 25, 35)}
    plan = X.Pages("/x/$page", paging=X.Paging(first=5, step=10, is_next=q("more", "bool")))
    rows = spark.createDataFrame([(1, "/", "")], "id long, url string, content string")
    assert sorted(int(r.page) for r in X.gather(rows, plan, Site(pages).fetch).collect()) == [5, 15, 25]


def test_nested_and_linked_records_and_expected_numbers(spark):
    html = "<body><div id='a'><b>x</b><div id='b'><b>y</b></div></div><p id='u1'>Una</p><p id='u1'>Two</p></body>"
    rows = spark.createDataFrame([(1, "/1", html)], "id long, url string, content string")
    cfg = P.ExtractorConfig([q("//body/div", "subsets", "xpath")], [P.Value(q("//div/@id", type_="xpath"))], [P.Field("t", P.Value(q("//div/b", type_="xpath")))])
    got = X.nested(rows, cfg, q("//div/div", "subsets", "xpath"), 5)
    assert sorted(r.extracted_id for r in got.collect()) == ["a", "b"]
    other = P.ExtractorConfig([q("//p", "subsets", "xpath")], [P.Value(q("//p/@id", type_="xpath"))], [P.Field("name", P.Value(q("//p", type_="xpath")))])
    main = P.ExtractorConfig([q("//body/div", "subsets", "xpath")], [P.Value(q("//div/@id", type_="xpath"))], [P.Field("who", P.Value(q("//div/@id", type_="xpath")))])
    records, links = X.linked(rows, main, other, "who")
    assert links.count() == 1 and records.select("link").collect()[0].link is None
    want = X.Expected(P.Value(q("[0-9]+"), P.URL), if_larger=True, if_smaller=True)
    assert X.count_errors(rows, got, want).collect()[0].error == "larger"


def test_extractor_configuration():
    reg = {1: q("[0-9]+"), 2: q("//h1", type_="xpath"), 3: q("x", "bool")}
    opts = {
        "variables": {"name": ["n", ""], "query": [1, 1], "source": [2], "alias": ["m"], "alias.add": [4], "tokens": ["t"], "tokens.source": ["/t"], "tokens.query": [2]},
        "paging": {"first": 1, "step": 5, "number.from": 1}, "source": {"url": "/x/$page"}, "general": {"retries": 2},
        "extracting": {"dataset.queries": [2], "id.queries": [1], "field.names": ["a", "b"], "field.queries": [2], "field.json": [True], "error.fail": [3], "remove.duplicates": True},
        "linked": {"dataset.queries": [2], "id.queries": [1], "field.names": ["z"], "field.queries": [1]},
    }
    text = json.dumps([{"cat": c, "name": n, "value": v} for c, vals in opts.items() for n, v in vals.items()])
    pages, main, other = extractor_config(text, reg)
    assert [(v.name, v.value.source, v.alias, v.alias_add) for v in pages.variables] == [("n", P.URL, "m", 4)] and pages.tokens[0].url == "/t"
    assert (pages.paging.first, pages.paging.step, pages.paging.number, pages.retries, pages.error_fail) == (1, 5, reg[1], 2, [reg[3]])
    assert main.remove_duplicates and [(f.name, f.json) for f in main.fields] == [("a", True)] and [f.name for f in other.fields] == ["z"]


def test_phrases_that_weaken_and_new_boosters():
    s = Scorer({"good": 2.0, "heart": 1.0})
    plain = s._valence("it was all good".split(), 3, False, False, [False] * 4)
    assert abs(s._valence("it sort of good".split(), 3, False, False, [False] * 4) - (plain - BOOST)) < 1e-9
    assert s.score(["total", "good"])["compound"] > s.score(["a", "good"])["compound"] > s.score(["slight", "good"])["compound"]
    assert s._valence("with a broken heart".split(), 3, False, False, [False] * 4) == -2.9


def test_the_loop_over_the_supplied_pages(spark):
    """Every page stands for its own URL, and a page number that its URL may name."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("id"), "url", F.col("html").alias("content"))
    plan = X.Pages("/$n", variables=[X.Variable("n", P.Value(q("(?<=/)[0-9]+"), P.URL))], retries=0)
    fetch = lambda urls: urls.select("url", F.lit(200).alias("response"), F.concat(F.lit("page "), "url").alias("content"))
    got = X.gather(pages, plan, fetch)
    assert got.count() == pages.count() and got.where("content <> concat('page ', page_url)").isEmpty()
