"""The vocabulary of topic modelling: every token that passes the pruning, and no other."""

from quillmill.plans import algorithms as A


def articles(spark, texts):
    return spark.createDataFrame([(str(i), "2024-01-01", t) for i, t in enumerate(texts)], "article_id string, date string, text string")


def test_no_token_that_passes_the_pruning_is_dropped(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    vec, words = A.TopicModelling(min_df=2).features(articles(spark, [text, text, "rare"]))
    assert sorted(words) == sorted(f"w{i}" for i in range(70_000))
    assert {r.article_id: r.features.numNonzeros() for r in vec.collect()} == {"0": 70_000, "1": 70_000, "2": 0}


def test_tokens_are_pruned_by_corpus_and_article_frequency_then_from_the_top(spark):
    arts = articles(spark, ["a a a b b c", "a b c d d d d", "a"])
    words = lambda **kw: A.TopicModelling(**kw).features(arts)[1]
    assert words(min_df=1) == ["a", "d", "b", "c"]
    assert words(min_df=1, min_cf=3) == ["a", "d", "b"]
    assert words(min_df=2, min_cf=3) == ["a", "b"]
    assert words(min_df=1, min_cf=3, remove_top=1) == ["d", "b"]
    assert words(min_df=1, vocabulary=2) == ["a", "d"]
