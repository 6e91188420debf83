import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import language_id as L
from quillmill.llm import quality as Q

VOCAB = {
    "en": "the and that with from this have were which their would there about other into could".split(),
    "de": "der und nicht mit von auch werden eine einem haben wurde durch über können müssen schon".split(),
    "es": "que los las una para con por como pero más sus este cuando también desde entre".split(),
}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(VOCAB[lang], 40)), lang) for i in range(240) for lang in [list(VOCAB)[i % 3]]]


def test_language_of_held_out_texts(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "de"), (1003, "ja", None), (1004, "und nicht mit " * 40_000, "en"), (None, "the and that with", None), (1005, "the with from", "en"), (1005, "the with from", "en")]
    train = df.where("doc_id % 5 <> 0").unionByName(spark.createDataFrame([(2000, "x y", None)], df.schema))
    model = L.fit(train)
    assert model.langs == ["de", "en", "es"] and model.temperature > 0
    assert (model.table == 0).mean() > 0.9
    both = df.unionByName(spark.createDataFrame(odd, df.schema)).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    rows = L.predict(both, model).collect()
    assert len(rows) == len(texts) + len(odd)
    by = {r.doc_id: r for r in rows}
    assert np.mean([by[i].lang_pred == lang for i, _, lang in texts if i % 5 == 0]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1004].lang_pred == "de"
    assert by[None].lang_pred == "en"
    assert L.fit(train).predict("the and") == model.predict("the and")


def test_language_chunks_count_each_ngram_once(monkeypatch):
    text = "Die Straße über den Fluß " * 50
    want = L.counts(text)
    monkeypatch.setattr(L, "CHUNK", 97)
    got = L.counts(text)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(empty)
    df = spark.createDataFrame([(1, "the and", "en")], empty.schema)
    assert [(r.lang_pred, r.score) for r in L.predict(df, model).collect()] == [("und", 0.0)]
    assert L.predict(empty, model).count() == 0


def good(rng):
    return " ".join(f"{a}{b}" for a, b in rng.choice(VOCAB["en"] + VOCAB["es"], (rng.integers(30, 120), 2))) + "."


def bad(rng):
    w = rng.choice(VOCAB["en"], 2)
    return " ".join([w[0]] * 40 + [f"{w[1]}###", "$$$ &&&"] * 10)


def test_quality_of_held_out_texts(spark):
    rng = np.random.default_rng(1)
    made = [(i, good(rng) if rng.random() < 0.8 else bad(rng)) for i in range(900)]
    rows = [(i, t, int("###" not in t)) for i, t in made]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, quality int")
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 4 != 3
    model = Q.fit(docs.where(train), labels.where(train), per_set=400)
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "word"), (5002, "a b " * 200_000), (1, "x"), (1, "x")], docs.schema)
    got = Q.predict(docs.unionByName(odd).withColumn("predicted", F.lit("clash")), model).collect()
    assert len(got) == 906 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if i % 4 == 3]
    assert np.mean([by[i].predicted == y for i, y in held]) >= 0.95
    assert by[5000].score == by[5001].score
    again = Q.fit(docs.where(train), labels.where(train), per_set=400)
    assert np.allclose(again.w, model.w)


def test_risk_stays_non_negative_without_negatives():
    """With more positives than the prior allows, the negative part is held at zero instead of growing below it."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(Q.FEATURES)))
    m = Q.Model(cuts=[np.array([0.0])] * len(Q.FEATURES), prior=0.9)
    Q.nnpu(m, x[:200], x, epochs=200, batch=128)
    f, p = m.raw(x), m.raw(x[:200])
    assert np.logaddexp(0, f).mean() - 0.9 * np.logaddexp(0, p).mean() > -0.1


def test_quality_without_positives_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    (r,) = Q.predict(docs, Q.fit(docs, labels)).collect()
    assert r.score == 0.5 and r.predicted == 0
    empty = docs.where("false")
    assert Q.predict(empty, Q.fit(empty, labels)).count() == 0
