"""Analyses of a corpus. Each takes article tables and returns one lazy result table.

Work that stays inside an article is done on arrays in its row; only groups,
counts and matched tokens are shuffled.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.dates import fill_gaps, reduce_date
from quillmill.functions.sentiment import Scorer
from quillmill.operators import corpus as C
from quillmill.sources.checkpoints import checkpoint

REGISTRY: dict[int, type[Algorithm]] = {}


class Algorithm(ABC):
    """An analysis: subclass it, give it a number and a name, and it can be run by configuration."""

    number: ClassVar[int] = 0
    name: ClassVar[str] = ""

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        if cls.number:
            REGISTRY[cls.number] = cls

    @abstractmethod
    def run(self, arts: DataFrame) -> DataFrame:
        """The result table of a corpus."""

    #: Columns that results are sorted by, as far as they have them.
    order: ClassVar[tuple[str, ...]] = ("date", "id", "article", "token")

    def extra(self, arts: DataFrame) -> dict[str, DataFrame]:
        """Further result tables by name."""
        return {}


def _grouped(arts: DataFrame, resolution: str, ignore_empty: bool = True) -> DataFrame:
    """Articles with their date group; undated ones are in the group '' or left out."""
    dated = F.coalesce("date", F.lit("")) != ""
    group = F.when(dated, reduce_date(F.when(dated, F.col("date")), resolution)).otherwise(F.lit(""))
    out = arts.where(dated) if ignore_empty else arts
    return out.withColumn("group", group)


@dataclass
class CorpusStatistics(Algorithm):
    """Token and sentence lengths per source: number, mean, median, variance.

    Lengths are counted first; the statistics come from those few rows.
    """

    number = 40
    name = "Corpus Generator"
    truncate_median: bool = True

    def _lengths(self, df: DataFrame, lengths: Column, kind: str) -> DataFrame:
        hist = df.select("source", F.explode(lengths).alias("n")).groupBy("source", "n").agg(F.count("*").alias("k"))
        total = F.sum("k")
        mean = F.sum(F.col("n") * F.col("k")) / total
        square = F.sum(F.col("n").cast("double") * F.col("n") * F.col("k")) / total
        median = F.expr("percentile(n, 0.5, k)")
        return hist.groupBy("source").agg(
            total.alias(f"{kind}count"), mean.alias(f"avg_{kind}len"),
            (F.floor(median).cast("double") if self.truncate_median else median).alias(f"med_{kind}len"), (square - mean * mean).alias(f"sd2_{kind}len"),
        )

    def run(self, arts: DataFrame) -> DataFrame:
        t = C.tokenized(arts)
        tokens = self._lengths(t, F.transform(F.flatten("sentences"), lambda x: F.char_length(x)), "token")
        sents = self._lengths(t, F.transform("sentences", lambda s: F.size(s)), "sentence")
        return tokens.join(sents, "source")


@dataclass
class AllTokens(Algorithm):
    """The vocabulary with counts, per article, per date and article, or in all."""

    number = 46
    name = "All Tokens"
    by: tuple[str, ...] = ()

    def run(self, arts: DataFrame) -> DataFrame:
        toks = C.tokens(arts)
        return toks.groupBy(*self.by, "token").agg(F.count("*").alias("n"))

    def extra(self, arts: DataFrame) -> dict[str, DataFrame]:
        return {"vocabulary": vocabulary(arts)}


def vocabulary(arts: DataFrame) -> DataFrame:
    """(tid, token, n): token numbers by first occurrence in (date, article, place).

    Numbers need a global order of the distinct tokens; it is found by ranges,
    each range numbering its own and adding what the ranges before it hold.
    """
    first = F.min(F.struct(F.coalesce("date", F.lit("")).alias("d"), F.coalesce("article_id", F.lit("")).alias("a"), F.col("tok_ix").alias("t")))
    vocab = C.tokens(arts).groupBy("token").agg(first.alias("at"), F.count("*").alias("n"))
    return number_rows(vocab, ["at.d", "at.a", "at.t", "token"], "tid").select("tid", "token", "n")


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers rows from 0 in an order, without one task for all.

    Rows are sorted in ranges and the sorted table is fixed by a checkpoint, so
    a range's number of rows and its rows agree.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpoint(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_k"))
    start = sizes.withColumn("_b", F.coalesce(F.sum("_k").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    # one row per range
    return ranged.withColumn("_r", own).join(F.broadcast(start.select("_p", "_b")), "_p").withColumn(out, F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


@dataclass
class WordsOverTime(Algorithm):
    """Articles, sentences and tokens per date group.

    Counted per article row; only one small row per article is shuffled.
    """

    number = 44
    name = "Words over Time"
    resolution: str = "weeks"
    fill: bool = True

    def run(self, arts: DataFrame) -> DataFrame:
        t = _grouped(C.tokenized(arts), self.resolution).select(
            F.col("group").alias("date"), "article_id", F.size("sentences").alias("s"), F.size(F.flatten("sentences")).alias("t")
        )
        out = t.where("t > 0").groupBy("date").agg(
            F.count_distinct("article_id").alias("articles"), F.sum("s").alias("sentences"), F.sum("t").alias("tokens")
        )
        return fill_gaps(out, self.resolution) if self.fill else out


@dataclass
class ExtractIds(Algorithm):
    """The distinct article ids of a filtered corpus."""

    number = 48
    name = "Extract IDs"

    def run(self, arts: DataFrame) -> DataFrame:
        named = F.coalesce("article_id", F.lit("")) != ""
        return arts.where(named).select(F.col("article_id").alias("id")).distinct()


def matched(arts: DataFrame, keyword: str, categories: dict[str, str], keep: list[str]) -> DataFrame:
    """One row for each token that is the keyword or of a category, with its place; an article without one has a row of nulls.

    A keyword token is not tested for categories.
    """
    names = list(categories)
    patterns = [keyword, *categories.values()]
    # one expression looks at each token; only its few hits are looked at again, to tell which it is
    any_of = "|".join(f"(?:{p})" for p in patterns)
    numbered = any(re.search(r"\\[1-9k]|\(\?P?<[A-Za-z]", p) for p in patterns)

    def hit(x: Column) -> Column:
        return reduce(lambda a, b: a | b, [x["t"].rlike(p) for p in patterns]) if numbered else x["t"].rlike(any_of)

    def mark(x: Column) -> Column:
        kw = x["t"].rlike(keyword)
        return F.struct(x["pos"].alias("pos"), kw.alias("kw"), *[(~kw & x["t"].rlike(categories[n])).alias(f"c{k}") for k, n in enumerate(names)])

    def places(toks: Column) -> Column:
        found = F.transform(F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t.alias("t"))), hit), mark)
        return F.when(F.size(toks) > 0, found)

    # transform over a one-element array names a value, so a text is tokenized once
    found = F.transform(F.array(F.flatten(C.sentences_of(arts))), places)[0]
    rows = arts.select(*keep, F.explode(F.transform(F.array(found), _none_as_null)[0]).alias("m"))
    return rows.select(*keep, "m.*")


def _none_as_null(found: Column) -> Column:
    """An empty array as one with a null, so that its row stays; a null array has none."""
    return F.when(F.size(found) == 0, F.array(F.get(found, F.lit(0)))).otherwise(found)


def associations(hits: DataFrame, labels: list[str], window: int, by: list[str]) -> DataFrame:
    """Per article: keyword occurrences, and pairs of a keyword and a category within the window.

    A range frame over the matched tokens, both ends included; far tokens are
    never paired.
    """
    w = W.partitionBy(*by).orderBy("pos").rangeBetween(-window, window)
    near = hits
    for k in range(len(labels)):
        near = near.withColumn(f"n{k}", F.sum(F.col(f"c{k}").cast("long")).over(w))
    is_kw = F.coalesce("kw", F.lit(False))
    return near.groupBy(*by).agg(
        F.sum(is_kw.cast("long")).alias("occurrences"),
        *[F.sum(F.when(is_kw, F.coalesce(f"n{k}", F.lit(0))).otherwise(F.lit(0))).cast("long").alias(name) for k, name in enumerate(labels)],
    )


@dataclass
class Assoc(Algorithm):
    """Associations of a keyword with categories, per article."""

    number = 47
    name = "Associations"
    keyword: str = ""
    categories: dict[str, str] = field(default_factory=dict)
    window: int = 5
    ignore_empty_date: bool = True

    def __post_init__(self) -> None:
        if not self.keyword or self.window < 1:
            raise ValueError("a keyword and a window of 1 at least are needed")
        self.categories = {k: v for k, v in self.categories.items() if k and v}

    def run(self, arts: DataFrame) -> DataFrame:
        src = arts.where(F.coalesce("date", F.lit("")) != "") if self.ignore_empty_date else arts
        hits = matched(src, self.keyword, self.categories, ["date", "article_id"])
        out = associations(hits, list(self.categories), self.window, ["date", "article_id"])
        return out.select(F.col("article_id").alias("id"), "date", "occurrences", *self.categories)


@dataclass
class AssocOverTime(Algorithm):
    """Associations of a keyword with categories, per date group."""

    number = 42
    name = "Associations over Time"
    keyword: str = ""
    categories: dict[str, str] = field(default_factory=dict)
    window: int = 5
    resolution: str = "weeks"
    fill: bool = True
    ignore_empty_date: bool = True

    def run(self, arts: DataFrame) -> DataFrame:
        per = Assoc(self.keyword, self.categories, self.window, self.ignore_empty_date).run(arts)
        labels = [k for k, v in self.categories.items() if k and v]
        grouped = _grouped(per, self.resolution, self.ignore_empty_date)
        out = grouped.groupBy(F.col("group").alias("date")).agg(
            F.count_distinct("id").alias("n"), F.sum("occurrences").alias("occurrences"), *[F.sum(c).alias(c) for c in labels]
        )
        return fill_gaps(out, self.resolution) if self.fill else out


@dataclass
class SentimentOverTime(Algorithm):
    """Mean sentiment of sentences with a token of a category, per date group.

    A sentence is scored once, whatever number of categories it is in.
    """

    number = 43
    name = "Sentiment over Time"
    categories: dict[str, str] = field(default_factory=dict)
    resolution: str = "weeks"
    threshold: int | None = 10
    articles: bool = False
    fill: bool = True
    scorer: Scorer = field(default_factory=Scorer)

    def scored(self, arts: DataFrame) -> DataFrame:
        """(group, article_id, one truth value per category, score) of sentences in any category."""
        names = list(self.categories)
        sents = _grouped(arts, self.resolution).select("group", "article_id", F.explode(C.sentences_of(arts)).alias("s"))
        flags = [F.exists("s", T.matches(p)).alias(f"c{k}") for k, p in enumerate(self.categories.values())]
        marked = sents.select("group", "article_id", "s", *flags)
        cond = F.lit(False)
        for k in range(len(names)):
            cond = cond | F.col(f"c{k}")
        scorer = self.scorer

        @F.pandas_udf("double")
        def compound(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: scorer.score(list(t))["compound"])

        out = marked.where(cond).withColumn("score", compound("s")).drop("s")
        if self.threshold is not None:
            out = out.where(F.round(F.abs("score") * 100) >= self.threshold)
        return out

    def run(self, arts: DataFrame) -> DataFrame:
        rows, names = self.scored(arts), list(self.categories)
        cols = []
        for k, n in enumerate(names):
            own = F.when(F.col(f"c{k}"), F.col("score"))
            cols += [F.count(own).alias(f"{n}_N"), F.coalesce(F.avg(own), F.lit(0.0)).alias(n)]
        out = rows.groupBy(F.col("group").alias("date")).agg(*cols)
        if self.articles:
            per = rows.groupBy("group", "article_id").agg(*[F.avg(F.when(F.col(f"c{k}"), F.col("score"))).alias(f"a{k}") for k in range(len(names))])
            more = []
            for k, n in enumerate(names):
                more += [F.count(f"a{k}").alias(f"{n}_a_N"), F.coalesce(F.avg(f"a{k}"), F.lit(0.0)).alias(f"{n}_a")]
            out = out.join(per.groupBy(F.col("group").alias("date")).agg(*more), "date", "left")
        return fill_gaps(out, self.resolution) if self.fill else out


@dataclass
class TermsOverTime(Algorithm):
    """How often the tokens of each term's pattern occur, per date group."""

    number = 41
    name = "Terms over Time"
    terms: dict[str, str] = field(default_factory=dict)
    resolution: str = "weeks"
    fill: bool = True

    def run(self, arts: DataFrame) -> DataFrame:
        toks = F.flatten(C.sentences_of(arts))
        counted = {n: F.size(F.filter(toks, T.matches(p))) for n, p in self.terms.items()}
        rows = _grouped(arts, self.resolution).select(F.col("group").alias("date"), *[c.alias(n) for n, c in counted.items()])
        out = rows.groupBy("date").agg(*[F.sum(n).alias(n) for n in self.terms])
        return fill_gaps(out, self.resolution) if self.fill else out


@dataclass
class TopicModelling(Algorithm):
    """Topics of the articles: LDA with a fixed number of topics, or the number with the least perplexity.

    An open number of topics is searched over ``ks``; it is not a hierarchical
    Dirichlet process.
    """

    number = 45
    name = "Topic Modelling"
    k: int = 5
    ks: tuple[int, ...] = ()
    idf: bool = False
    min_cf: int = 1
    min_df: int = 2
    remove_top: int = 0
    iterations: int = 10
    seed: int = 1
    top_tokens: int = 5
    #: The most tokens to keep, the most frequent ones; none keeps all that pass min_cf and min_df.
    vocabulary: int | None = None

    def pruned(self, docs: DataFrame) -> list[str]:
        """The tokens of the model, most frequent first."""
        once, zero = F.lit(1), F.lit(0)
        every = docs.select(F.explode("words").alias("token"), once.alias("cf"), zero.alias("df"))
        in_article = docs.select(F.explode(F.array_distinct("words")).alias("token"), zero.alias("cf"), once.alias("df"))
        counts = every.unionByName(in_article).groupBy("token").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
        kept = counts.where((F.col("cf") >= self.min_cf) & (F.col("df") >= self.min_df)).orderBy(F.desc("cf"), "token")
        if self.vocabulary is not None:
            kept = kept.limit(self.vocabulary + self.remove_top)
        return [r["token"] for r in kept.select("token").collect()][self.remove_top :]

    def features(self, arts: DataFrame):
        from pyspark.ml.feature import IDF, CountVectorizerModel

        docs = arts.select("article_id", F.flatten(C.sentences_of(arts)).alias("words")).where(F.size("words") > 0)
        words = self.pruned(docs)
        cv = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="counts")
        vec = cv.transform(docs).drop("words")
        if self.idf:
            return IDF(inputCol="counts", outputCol="features").fit(vec).transform(vec).drop("counts"), words
        return vec.withColumnRenamed("counts", "features"), words

    def fit(self, arts: DataFrame):
        from pyspark.ml.clustering import LDA

        vec, words = self.features(arts)
        make = lambda k: LDA(k=k, maxIter=self.iterations, seed=self.seed, optimizer="online").fit(vec)
        if not self.ks:
            return make(self.k), vec, words
        models = [make(k) for k in self.ks]
        return min(models, key=lambda m: m.logPerplexity(vec)), vec, words

    def run(self, arts: DataFrame) -> DataFrame:
        """article, top, k0.. - the share of each topic and a description of the largest, null if all are equal."""
        model, vec, words = self.fit(arts)
        return self.classify(model, vec, words)

    def classify(self, model, vec: DataFrame, words: list[str]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        k = model.vocabSize() and len(model.describeTopics(1).collect())
        about = [" ".join(words[i] for i in r["termIndices"]) for r in model.describeTopics(self.top_tokens).orderBy("topic").collect()]
        shares = model.transform(vec).select("article_id", vector_to_array("topicDistribution").alias("p"))
        names = F.array(*[F.lit(a) for a in about])
        best = F.filter(F.transform("p", lambda x, i: F.when(x == F.array_max("p"), F.get(names, i))), lambda x: x.isNotNull())
        top = F.when(F.size(best) < k, F.array_join(best, "|"))
        return shares.select(F.col("article_id").alias("article"), top.alias("top"), *[F.col("p")[i].alias(f"k{i}") for i in range(k)])

    def topics(self, model, words: list[str]) -> DataFrame:
        """topic, token, probability, rank of each topic's first tokens."""
        terms = model.describeTopics(self.top_tokens).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
        names = F.array(*[F.lit(w) for w in words]) if len(words) <= 1000 else None
        if names is not None:
            return terms.select("topic", F.get(names, F.col("t.termIndices")).alias("token"), F.col("t.termWeights").alias("prob"), "rank")
        table = model.describeTopics(1).sparkSession.createDataFrame(list(enumerate(words)), "ix int, token string")
        return terms.join(F.broadcast(table), F.col("t.termIndices") == F.col("ix")).select("topic", "token", F.col("t.termWeights").alias("prob"), "rank")


def token_entropy(arts: DataFrame) -> DataFrame:
    """Sum of p ln p over the vocabulary, without a leading minus."""
    counts = C.tokens(arts).groupBy("token").agg(F.count("*").alias("n"))
    # sum of (n/N) ln(n/N) = sum(n ln n)/N - ln N: one aggregation, no second pass
    return counts.agg((F.sum(F.col("n") * F.log("n")) / F.sum("n") - F.log(F.sum("n"))).alias("entropy"))
