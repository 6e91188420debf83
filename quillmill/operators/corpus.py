"""The corpus: articles and their tokens.

    articles: source, article_id, date (ISO or null), and either text or sentences (arrays of tokens)
    tokens:   source, date, article_id, sent_ix, tok_ix, token

Tokens are numbered inside their article, sentence by sentence, in one native
pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import dates
from quillmill.functions import linguistics as L
from quillmill.functions import text as T
from quillmill.operators.query import Query, evaluate
from quillmill.sources.checkpoints import checkpoint

#: Source kinds and the column prefix of each.
SOURCE_KINDS = ("parsed", "extracted", "analyzed", "crawled")
KEY = ["source", "date", "article_id"]


def articles(df: DataFrame, text: str, article_id: Column | None = None, date: Column | None = None, source: str = "corpus") -> DataFrame:
    """The corpus scan: id, date and text; null and empty texts are left out."""
    null = F.lit(None).cast("string")
    return df.where(F.length(text) > 0).select(
        F.lit(source).alias("source"),
        (article_id if article_id is not None else null).cast("string").alias("article_id"),
        F.substring(date.cast("string"), 1, 10).alias("date") if date is not None else null.alias("date"),
        F.col(text).alias("text"),
    )


def sentences_of(arts: DataFrame) -> Column:
    """The sentences of articles as arrays of tokens, made from the text or, if it was tokenized, at hand."""
    return F.col("sentences") if "sentences" in arts.columns else T.sentences(F.col("text"))


def tokens(arts: DataFrame) -> DataFrame:
    """One row per token."""
    placed = arts.select(*KEY, F.posexplode(T.placed_tokens(sentences_of(arts))).alias("tok_ix", "t"))
    return placed.select(*KEY, F.col("t.sent_ix").alias("sent_ix"), "tok_ix", F.col("t.token").alias("token"))


def tokenized(arts: DataFrame) -> DataFrame:
    """One row per article with its sentences as arrays of tokens, for work inside an article."""
    return arts.withColumn("sentences", sentences_of(arts)).drop("text")


def from_sentences(df: DataFrame) -> DataFrame:
    placed = df.select(*KEY, F.posexplode(T.placed_tokens(F.col("sentences"))).alias("tok_ix", "t"))
    return placed.select(*KEY, F.col("t.sent_ix").alias("sent_ix"), "tok_ix", F.col("t.token").alias("token"))


def filter_by_date(df: DataFrame, first: str = "", last: str = "") -> DataFrame:
    """Rows dated in an inclusive range; undated ones go."""
    return df.where(dates.in_range(F.col("date"), first, last))


def filter_articles(arts: DataFrame, patterns: list[str], all_of: bool = False) -> DataFrame:
    """Articles with a token for any pattern, or with a token for every pattern.

    Decided inside the article's row: no shuffle, no join.
    """
    if not patterns:
        return arts
    toks = F.flatten(sentences_of(arts))
    hits = [F.exists(toks, T.matches(p)) for p in patterns]
    cond = hits[0]
    for h in hits[1:]:
        cond = (cond & h) if all_of else (cond | h)
    return arts.where(cond)


def filter_tokens_by_queries(toks: DataFrame, queries: list[Query], all_of: bool = False) -> DataFrame:
    """The same with queries of any type, on a token table."""
    named = {f"_f{i}": replace(q, kind="bool") for i, q in enumerate(queries)}
    marks = evaluate(toks.select("token").distinct(), "token", named)
    hit = toks.select(*KEY, "token").join(marks, "token").groupBy(*KEY).agg(*[F.max(n).alias(n) for n in named])
    cond = None
    for n in named:
        cond = F.col(n) if cond is None else (cond & F.col(n)) if all_of else (cond | F.col(n))
    keep = hit.where(cond).select(*[F.col(k).alias(f"_{k}") for k in KEY])
    same = None
    for k in KEY:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    return toks.join(keep, same, "left_semi")


def filter_by_queries(arts: DataFrame, queries: list[Query], all_of: bool = False) -> DataFrame:
    """Articles with a token for any query, or with a token for every query, of any type.

    Regular expressions are decided inside the row. The others look at each
    distinct token once; articles meet what was found by their row number.
    """
    if all(q.type == "regex" for q in queries):
        return filter_articles(arts, [q.text for q in queries], all_of)
    rows = checkpoint(tokenized(arts).withColumn("_row", F.monotonically_increasing_id()))
    toks = rows.select("_row", F.explode(F.array_distinct(F.flatten("sentences"))).alias("token"))
    named = {f"_f{i}": replace(q, kind="bool") for i, q in enumerate(queries)}
    marks = evaluate(toks.select("token").distinct(), "token", named)
    hit = toks.join(marks, "token").groupBy("_row").agg(*[F.max(n).alias(n) for n in named])
    cond = reduce((lambda a, b: a & b) if all_of else (lambda a, b: a | b), [F.col(n) for n in named])
    return rows.join(hit.where(cond).select("_row"), "_row", "left_semi").drop("_row")


def combine(corpora: list[DataFrame], source: str = "combined") -> DataFrame:
    """One corpus of several article tables: articles of the same date and id are joined in source order.

    Undated and unnamed articles come under the empty text.
    """
    if any("sentences" in c.columns for c in corpora):
        return _combine_tokenized([tokenized(c) for c in corpora], source)
    parts = [
        c.select(F.lit(i).alias("_i"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("article_id", F.lit("")).alias("article_id"), "text")
        for i, c in enumerate(corpora)
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    texts = F.array_sort(F.collect_list(F.struct("_i", "text")))
    # a sentence ends with its article, so the joint is a sentence end
    return (
        both.groupBy("date", "article_id")
        .agg(F.array_join(F.transform(texts, lambda x: x["text"]), ".\n").alias("text"))
        .select(F.lit(source).alias("source"), "article_id", "date", "text")
    )


def _combine_tokenized(corpora: list[DataFrame], source: str) -> DataFrame:
    parts = [
        c.select(F.lit(i).alias("_i"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("article_id", F.lit("")).alias("article_id"), "sentences")
        for i, c in enumerate(corpora)
    ]
    both = reduce(DataFrame.unionByName, parts)
    own = F.array_sort(F.collect_list(F.struct("_i", "sentences")))
    joined = both.groupBy("date", "article_id").agg(F.flatten(F.transform(own, lambda x: x["sentences"])).alias("sentences"))
    return joined.select(F.lit(source).alias("source"), "article_id", "date", "sentences")


def article_text(arts: DataFrame, article_id: str) -> DataFrame:
    return arts.where(F.col("article_id") == article_id)


def date_slice(arts: DataFrame, date: str) -> DataFrame:
    return arts.where(F.col("date") == date)


def renumber(toks: DataFrame) -> DataFrame:
    """Numbers tokens and sentences anew after some were dropped."""
    part = W.partitionBy(*KEY)
    return toks.withColumn("sent_ix", (F.dense_rank().over(part.orderBy("sent_ix")) - 1).cast("int")).withColumn(
        "tok_ix", (F.row_number().over(part.orderBy("tok_ix")) - 1).cast("int")
    )


# Manipulators: what becomes of a distinct token; an empty result drops it.

Manipulator = Callable[[DataFrame], DataFrame]


def _map_tokens(fn: Callable[[str], str]) -> Manipulator:
    """Applies a Python function to the distinct tokens of (token, out)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(fn)

    return lambda vocab: vocab.withColumn("out", run("out"))


def stem_english() -> Manipulator:
    return _map_tokens(L.stem_english)


def stem_german() -> Manipulator:
    return _map_tokens(L.stem_german)


def tag(tagger: Callable[[str], str]) -> Manipulator:
    """Appends the tag that a tagger gives a token, after a space."""
    return _map_tokens(lambda t: f"{t} {tagger(t)}")


def _word(column: str = "out") -> Column:
    """A token without its tag."""
    return F.substring_index(F.col(column), " ", 1)


def lemmatize(lemmas: DataFrame) -> Manipulator:
    """Dictionary lemmas (form, lemma, tag, count); a token may carry a tag.

    A form with several lemmas takes those whose tag shares the longest
    beginning with the token's tag, then the most frequent.
    """

    def run(vocab: DataFrame) -> DataFrame:
        tagged = vocab.withColumns({"_w": _word(), "_tag": F.when(F.instr("out", " ") > 0, F.substring_index("out", " ", -1)).otherwise("")})
        shared = F.expr(
            "aggregate(sequence(1, greatest(1, least(length(_tag), length(tag)))), 0, (a, i) -> if(a = i - 1 and substring(_tag, i, 1) = substring(tag, i, 1) and length(_tag) >= i, i, a))"
        )
        found = tagged.join(lemmas, tagged["_w"] == lemmas["form"])
        best = found.groupBy("token").agg(F.max_by("lemma", F.struct(shared, F.col("count"), F.col("lemma"))).alias("_l"))
        return vocab.join(best, "token", "left").withColumn("out", F.coalesce("_l", "out")).drop("_l")

    return run


def remove(dictionary: DataFrame) -> Manipulator:
    """Drops tokens that a dictionary (token) holds."""

    def run(vocab: DataFrame) -> DataFrame:
        known = dictionary.select(F.col("token").alias("_d")).distinct()
        gone = vocab.join(known, _word() == F.col("_d"), "left")
        return gone.withColumn("out", F.when(F.col("_d").isNotNull(), "").otherwise(F.col("out"))).drop("_d")

    return run


def trim(prefixes: list[str], suffixes: list[str]) -> Manipulator:
    return _map_tokens(lambda t: L.trim_token(t, prefixes, suffixes))


def correct(counts: dict[str, int]) -> Manipulator:
    """Replaces unknown tokens by the nearest word of a word list."""
    return _map_tokens(lambda t: L.correct(t, counts))


def manipulate(toks: DataFrame, chain: list[Manipulator]) -> DataFrame:
    """Applies manipulators in order, each to what the one before left.

    They see each distinct token once; results are joined back, and tokens that
    became empty go.
    """
    vocab = toks.select("token").distinct().withColumn("out", F.col("token"))
    for m in chain:
        vocab = m(vocab)
    done = toks.join(vocab, "token").where(F.length("out") > 0)
    return renumber(done.select(*KEY, "sent_ix", "tok_ix", F.col("out").alias("token")))


def manipulated(arts: DataFrame, chain: list[Manipulator]) -> DataFrame:
    """Articles as sentences of tokens after manipulators, for analyses; what has no token left goes.

    One shuffle by token brings what becomes of it, one by article brings its
    tokens together again.
    """
    rows = tokenized(arts).withColumn("_row", F.monotonically_increasing_id())
    toks = rows.select("_row", *KEY, F.posexplode(T.placed_tokens(F.col("sentences"))).alias("tok_ix", "t")).select(
        "_row", *KEY, "t.sent_ix", "tok_ix", "t.token"
    )
    vocab = tokens(tokenized(arts)).select("token").distinct().withColumn("out", F.col("token"))
    for m in chain:
        vocab = m(vocab)
    left = toks.join(vocab.select("token", "out"), "token").where(F.length("out") > 0).repartition("_row")
    in_order = lambda c: F.array_sort(F.collect_list(c))
    sents = left.groupBy("_row", *KEY, "sent_ix").agg(in_order(F.struct("tok_ix", "out")).alias("s"))
    whole = sents.groupBy("_row", *KEY).agg(in_order(F.struct("sent_ix", F.transform("s", lambda x: x["out"]).alias("s"))).alias("a"))
    return whole.select(*KEY, F.transform("a", lambda x: x["s"]).alias("sentences"))


# Text maps

TEXT_MAP = "array<struct<p:long,l:long,v:string>>"


def map_entries(df: DataFrame, column: str) -> DataFrame:
    """The entries of a JSON text map: position, length, value and ordinal from 1."""
    return df.select(
        *[c for c in df.columns if c != column], F.posexplode(F.from_json(column, TEXT_MAP)).alias("_i", "_e")
    ).select(
        *[c for c in df.columns if c != column], (F.col("_i") + 1).alias("ordinal"), F.col("_e.p").alias("p"), F.col("_e.l").alias("l"), F.col("_e.v").alias("v")
    )


def locate(df: DataFrame, column: str, offset: Column) -> DataFrame:
    """The map entry that covers an offset."""
    e = map_entries(df, column)
    return e.where((offset >= F.col("p")) & (offset < F.col("p") + F.col("l")))


def text_map(df: DataFrame, key: Column, order: Column, by: str) -> DataFrame:
    """A text map of concatenated texts, as JSON: where each begins, how long it is, what it is.

    One row per value of ``by``; its texts are put together with one space between.
    """
    w = W.partitionBy(by).orderBy(order)
    sized = df.withColumn("_l", F.char_length("text")).withColumn("_p", F.coalesce(F.sum(F.col("_l") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    entry = F.struct(F.col("_p").alias("p"), F.col("_l").cast("long").alias("l"), key.alias("v"))
    return sized.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("map"))


def chunk_offsets(df: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """Where each chunk of a corpus begins: the running sum of those before it."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def check(toks: DataFrame) -> DataFrame:
    """Articles whose token numbering has a gap or a step back; empty if all is well."""
    w = W.partitionBy(*KEY).orderBy("tok_ix")
    return (
        toks.withColumn("_p", F.lag("tok_ix", 1, -1).over(w))
        .withColumn("_s", F.lag("sent_ix", 1, 0).over(w))
        .where((F.col("tok_ix") != F.col("_p") + 1) | (F.col("sent_ix") < F.col("_s")) | (F.col("token") == ""))
        .select(*KEY)
        .distinct()
    )
