import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillmill.operators import corpus as C
from quillmill.operators import records as P
from quillmill.operators.query import Query
from quillmill.plans.config import AnalyzerConfig, parser_config, zipped
from quillmill.plans.engine import Engine
from quillmill.functions.dates import reduce_date
from quillmill.streaming.incremental import groups_over_time, parse_new, upsert_into


def config(*options):
    return json.dumps([{"cat": c, "name": n, "value": v} for c, n, v in options])


@pytest.fixture
def engine(spark):
    t = datetime.datetime
    rows = [("1", t(2020, 1, 5), "the cat was here. the dog"), ("2", t(2020, 3, 5), "a cat the"), ("3", None, "the the")]
    df = spark.createDataFrame(rows, "parsed_id string, parsed_datetime timestamp, parsed__text string")
    df.write.mode("overwrite").saveAsTable("web_parsed_news")
    yield Engine(spark, "web")
    spark.sql("DROP TABLE web_parsed_news")


BASE = [("general", "input.sources", [0, 0]), ("general", "input.tables", ["news", "none"]), ("general", "input.fields", ["text", "text"]), ("group-date", "resolution", 2)]


def test_run_by_configuration(engine):
    the, cat = engine.add_query(Query("regex", "^the$", "bool")), engine.add_query(Query("regex", "^cat$", "bool"))
    text = config(("", "algo", 42), *BASE, ("associations", "keyword", the), ("associations", "cat.labels", ["cat", "", "x"]), ("associations", "cat.queries", [cat, cat]), ("associations", "window.size", 2))
    engine.add_config("assoc", text)
    rows = [tuple(r) for r in engine.run("assoc", save=True).orderBy("date").collect()]
    assert rows == [("2020-01", 1, 2, 1), ("2020-02", 0, 0, 0), ("2020-03", 1, 1, 1)]
    assert engine.warnings == ["table web_parsed_none does not exist"]
    assert engine.spark.table("web_analyzed_result").count() == 3
    engine.spark.sql("DROP TABLE web_analyzed_result")


def test_filters_and_kept_corpora(engine):
    cat = engine.add_query(Query("regex", "^cat$", "bool"))
    stops = engine.spark.createDataFrame([("the",)], "token string")
    engine.manipulators = {6: lambda d: C.remove(stops), 3: lambda d: C.stem_english()}
    cfg = AnalyzerConfig.from_json(config(("general", "algo", 44), *BASE, ("filter-query", "queries", [cat]), ("tokenizer", "manipulators", [6, 3]), ("filter-date", "enable", True), ("filter-date", "from", "2020-02-01")))
    assert [r.token for r in engine.tokens(cfg).orderBy("tok_ix").collect()] == ["a", "cat"]
    assert len(engine._cache) == 1
    engine.tokens(cfg)
    assert len(engine._cache) == 1
    engine.forget()
    # "the" is gone for the analysis as well
    assert [tuple(r) for r in engine.run(cfg).collect()] == [("2020-03", 1, 1, 2)]
    none = engine.add_query(Query("xpath", "//cat", "bool"))
    both = AnalyzerConfig.from_json(config(("general", "algo", 44), *BASE, ("filter-query", "queries", [cat, none])))
    assert [tuple(r) for r in engine.run(both).collect()] == [("2020-01", 1, 2, 6), ("2020-02", 0, 0, 0), ("2020-03", 1, 1, 3)]
    both.filter_all = True
    assert engine.run(both).count() == 0
    with pytest.raises(ValueError, match="regular expression"):
        engine.run(config(("", "algo", 42), *BASE, ("associations", "keyword", none)))


def test_longer_chains_start_from_save_points_and_combined_corpora_keep_tokens(engine):
    stops = engine.spark.createDataFrame([("the",)], "token string")
    engine.manipulators = {6: lambda d: C.remove(stops), 3: lambda d: C.stem_english()}
    base = [("general", "input.sources", [0, 0]), ("general", "input.tables", ["news", "news"]), ("general", "input.fields", ["text", "text"]), ("group-date", "resolution", 2), ("corpus", "combine.sources", True)]
    one = AnalyzerConfig.from_json(config(("general", "algo", 46), *base, ("tokenizer", "manipulators", [6]), ("general", "target.table", "toks")))
    assert [tuple(r) for r in engine.run(one, save=True).collect()] == [("a", 2), ("cat", 4), ("dog", 2), ("here", 2), ("was", 2)]
    assert engine.spark.table("web_analyzed_toks_vocabulary").orderBy("tid").first().n == 4
    for t in ("toks", "toks_vocabulary"):
        engine.spark.sql(f"DROP TABLE web_analyzed_{t}")
    two = AnalyzerConfig.from_json(config(("general", "algo", 46), *base, ("tokenizer", "manipulators", [6, 3])))
    engine.run(two)
    assert len(engine._cache) == 2


def test_url_commands(engine, tmp_path):
    spark = engine.spark
    urls = spark.createDataFrame([("/a",), ("/b?x",)], "url string")
    n = engine.add_query(Query("regex", "[?]"))
    assert [r.url for r in engine.delete_urls(urls, n).collect()] == ["/a"]
    (tmp_path / "l.txt").write_text("/a\n/c\n")
    new = engine.import_urls(str(tmp_path / "l.txt"), urls)
    assert [r.url for r in new.collect()] == ["/c"] and engine.merge_urls([urls, new]).count() == 3
    engine.export_urls(urls, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["/a", "/b?x"]
    assert engine.test_query(Query("regex", "b+"), "abb")["single"] == "bb"
    m = engine.duplicate_query(n)
    engine.delete_query(n)
    assert list(engine.queries) == [m]


def test_parser_configuration():
    reg = {1: Query("regex", "[0-9]+"), 2: Query("xpath", "//h1")}
    cfg = parser_config(config(("parser", "id.queries", [1]), ("parser", "id.sources", [0]), ("parser", "field.names", ["t", "u"]), ("parser", "field.queries", [2]), ("parser", "field.delimiters", [";"]), ("general", "newest.only", False)), reg)
    assert cfg.ids == [P.Value(reg[1], P.URL)] and [f.name for f in cfg.fields] == ["t"] and cfg.fields[0].delimiter == ";" and not cfg.newest_only
    assert zipped({"a": [1, 2], "b": [3]}, "a", "b") == [(1, 3)]


def test_stream_parses_new_files_once(spark, tmp_path):
    schema = "id long, url string, crawltime timestamp, content string"
    rows = lambda *ids: spark.createDataFrame([(i, f"/p/{i}", datetime.datetime(2020, 1, 1), f"<h1>T{i}</h1>") for i in ids], schema)
    cfg = P.ParserConfig([P.Value(Query("regex", "[0-9]+$"), P.URL)], [P.Field("t", P.Value(Query("xpath", "//h1", text_only=True)))])
    src, at = str(tmp_path / "in"), str(tmp_path / "cp")
    for new, total in (((1, 2), 2), ((3,), 3)):
        rows(*new).write.mode("append").parquet(src)
        parse_new(spark, src, rows(1).schema, cfg, "stream_parsed", at).awaitTermination()
        assert spark.table("stream_parsed").count() == total
    assert sorted(r.t for r in spark.table("stream_parsed").collect()) == ["T1", "T2", "T3"]
    spark.sql("DROP TABLE stream_parsed")


def test_groups_of_an_event_stream(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    for r in ("days", "weeks", "months", "years"):
        q = groups_over_time(stream, "ts", r).writeStream.outputMode("complete").format("memory").queryName(f"groups_{r}").trigger(availableNow=True).start()
        q.awaitTermination()
        want = ev.groupBy(reduce_date(F.date_format("ts", "yyyy-MM-dd"), r).alias("date")).agg(F.count("*").alias("n"))
        assert sorted(map(tuple, spark.table(f"groups_{r}").collect())) == sorted(map(tuple, want.collect()))


def test_upserts_leave_one_whole_table(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    upsert_into(spark, "ups", rows((1, "a"), (1, "b"), (2, "c")), ["k"])
    upsert_into(spark, "ups", rows((2, "d"), (3, "e"), (3, "f")), ["k"])
    assert sorted(map(tuple, spark.table("ups").collect())) == [(1, "b"), (2, "d"), (3, "f")]
    spark.sql("ALTER TABLE ups RENAME TO ups__old")  # as if a run had ended between the renames
    upsert_into(spark, "ups", rows((4, "g")), ["k"])
    assert spark.table("ups").count() == 4
    spark.sql("DROP TABLE ups")
