"""The supplied tables in the roles of a crawl: articles, URL lists, contents, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import corpus as C
from quillmill.sources.tables import read


def doc_date() -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")


def articles(spark: SparkSession, sf_dir: str, source: str = "parsed.documents.text") -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return C.articles(docs, "text", F.col("doc_id"), doc_date(), source)


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a second source; dated like the documents by their number."""
    d = read(spark, sf_dir, "conversations")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 400).cast("int")), "yyyy-MM-dd")
    return C.articles(d, "text", F.concat_ws("-", F.lit("c"), "conv_id", "turn"), date, "parsed.conversations.text")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a URL list: id, manual, url."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("manual"), F.concat(F.lit("/order/"), "o_orderkey").alias("url"))


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of contents: id, url (user), crawltime, response, type, content."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("url"), F.col("ts").alias("crawltime"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("response"), F.col("event_type").alias("type"), F.col("props").alias("content"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), "url", F.lit("2024-01-01").cast("timestamp").alias("crawltime"), F.col("html").alias("content"))
