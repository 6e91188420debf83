"""The extractor's loop: pages that a document stands for are fetched, then records are built from them.

A document gives variables and tokens; those fill in the URL of a page, and
paging says which pages there are. Fetching is injected: it turns a table of
URLs into (url, response, content). A round is one job over the pages of all
documents; the loop runs over rounds, not over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import relational as R
from quillmill.operators.crawl import RETRY_CODES
from quillmill.operators.query import Query, any_of, evaluate, nested_subsets
from quillmill.operators.records import URL, ExtractorConfig, Value, alias, build, expected, extract, substitute
from quillmill.sources.checkpoints import checkpoint

Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Variable:
    """A value of the document under a name; ``alias`` names it again as a number moved by an offset.

    A document whose value a skip query matches is left out.
    """

    name: str
    value: Value
    alias: str = ""
    alias_add: int = 0
    skip: Query | None = None


@dataclass(frozen=True)
class Token:
    """A value that a query finds on a page of its own."""

    name: str
    url: str
    query: Query


@dataclass(frozen=True)
class Paging:
    """Which pages there are. The next one is named by ``next``, or the number ``step`` further.

    It ends after as many pages as ``number`` says, where ``is_next`` doesn't
    match, or where ``next`` finds nothing; without any of these there is one page.
    """

    variable: str = "page"
    first: int = 0
    first_text: str = ""
    step: int = 1
    number: Query | None = None
    is_next: Query | None = None
    next: Query | None = None
    alias: str = ""
    alias_add: int = 0


@dataclass(frozen=True)
class Pages:
    url: str
    url_first: str = ""
    variables: list[Variable] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    paging: Paging = field(default_factory=Paging)
    #: Pages with these queries are errors: the first kind is tried again, the second left out.
    error_retry: list[Query] = field(default_factory=list)
    error_fail: list[Query] = field(default_factory=list)
    retries: int = 3
    retry_codes: tuple[int, ...] = RETRY_CODES
    rounds: int = 10_000


@dataclass(frozen=True)
class Expected:
    """How many records a document should give, by a query on it."""

    value: Value
    if_larger: bool = False
    if_smaller: bool = False


def _single(q: Query) -> Query:
    return replace(q, kind="single")


def _variables(df: DataFrame, plan: Pages, content: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents that aren't skipped, with their variables, and the column of each name."""
    where, out = {}, df
    for source, column in ((True, URL), (False, content)):
        named = {f"_v{i}": _single(v.value.query) for i, v in enumerate(plan.variables) if (v.value.source == URL) == source}
        out = evaluate(out, column, named) if named else out
    for i, v in enumerate(plan.variables):
        where[v.name] = f"_v{i}"
        if v.alias:
            where[v.alias] = f"_alias{i}"
            out = out.withColumn(f"_alias{i}", alias(F.col(f"_v{i}"), v.alias_add))
        if v.skip is not None:
            out = any_of(out, f"_v{i}", [v.skip], "_skip").where("not _skip").drop("_skip")
    return out, where


def fetched(urls: DataFrame, fetch: Fetch, plan: Pages) -> DataFrame:
    """(url, content) of the URLs that gave a page without an error, tried again as often as the plan says.

    Codes from 400 on and pages that an error query matches give none.
    """
    todo, good = checkpoint(urls.select("url").distinct()), []
    for attempt in range(plan.retries + 1):
        got = fetch(todo)
        again = F.coalesce(F.col("response").isin(list(plan.retry_codes)), F.lit(False))
        if plan.error_retry:
            got = any_of(got, "content", plan.error_retry, "_e")
            again = again | F.col("_e")
        got = checkpoint(got.withColumn("_again", again))
        good.append(got.where("not _again and response < 400").select("url", "content"))
        todo = got.where("_again").select("url")
        if attempt == plan.retries or todo.isEmpty():
            break
    out = reduce(DataFrame.unionByName, good)
    return any_of(out, "content", plan.error_fail, "_e").where("not _e").drop("_e") if plan.error_fail else out


def gather(df: DataFrame, plan: Pages, fetch: Fetch, content: str = "content") -> DataFrame:
    """The pages of each document (id, url, content): (id, page, page_url, content).

    ``page`` is the number or name that the page goes by.
    """
    docs, where = _variables(df, plan, content)
    for i, t in enumerate(plan.tokens):
        asked = docs.withColumn("_u", substitute(F.lit(t.url), {n: F.col(c) for n, c in where.items()}))
        got = fetched(asked.select(F.col("_u").alias("url")), fetch, plan)
        found = evaluate(got, "content", {f"_k{i}": _single(t.query)}).select(F.col("url").alias("_u"), f"_k{i}")
        docs, where[t.name] = asked.join(found, "_u").drop("_u"), f"_k{i}"
    p = plan.paging
    values = {n: F.col(c) for n, c in where.items()} | {p.variable: F.col("page")}
    if p.alias:
        values[p.alias] = alias(F.col("page"), p.alias_add)

    def address(template: str) -> Column:
        return substitute(F.lit(template), values)

    live = docs.select("id", *where.values(), F.lit(p.first_text or str(p.first)).alias("page"), F.lit(None).cast("long").alias("_left"))
    out = []
    for k in range(plan.rounds):
        live = checkpoint(live.withColumn("page_url", address(plan.url_first if k == 0 and plan.url_first else plan.url)))
        got = fetched(live.select(F.col("page_url").alias("url")), fetch, plan).withColumnRenamed("url", "page_url")
        asks = {n: _single(q) for n, q in (("_number", p.number), ("_next", p.next)) if q is not None}
        asks |= {"_is": replace(p.is_next, kind="bool")} if p.is_next is not None else {}
        here = checkpoint(evaluate(live.join(got, "page_url"), "content", asks) if asks else live.join(got, "page_url"))
        out.append(here.select("id", "page", "page_url", "content"))
        if not asks:
            break
        left = F.coalesce("_left", F.col("_number").try_cast("long") if p.number is not None else F.lit(None).cast("long")) - 1
        more = F.lit(True)
        if p.number is not None:
            more = more & F.coalesce(left > 0, F.lit(False))
        if p.is_next is not None:
            more = more & F.coalesce("_is", F.lit(False))
        if p.next is not None:
            more = more & (F.coalesce("_next", F.lit("")) != "")
        step = F.col("_next") if p.next is not None else alias(F.col("page"), p.step).cast("string")
        live = here.where(more).select("id", *where.values(), step.alias("page"), left.alias("_left"))
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def nested(df: DataFrame, cfg: ExtractorConfig, again: Query, depth: int = 100, content: str = "content") -> DataFrame:
    """A record for each sub-document and for each that a query finds inside it, down to a depth."""
    subs = nested_subsets(df, content, cfg.datasets[0], again, depth)
    made = build(subs, cfg.ids, cfg.fields, cfg.times, "subset", cfg.ignore_ids, "extracted")
    keep = [c for c in df.columns if c != content]
    out = made.select(*keep, "extracted_id", "extracted_datetime", *[f.name for f in cfg.fields])
    return R.latest(out, ["extracted_id"], keep, first=True) if cfg.remove_duplicates else out


def linked(df: DataFrame, cfg: ExtractorConfig, other: ExtractorConfig, on: str, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Records with ``link``, and the linked records (link, ...) that the same documents hold.

    A field of a record names the id of its linked record; of several with an id the first one counts.
    """
    rows, others = extract(df, cfg, content), extract(df, other, content)
    keep = [c for c in df.columns if c != content]
    once = R.latest(others, ["extracted_id"], [*keep, "subset_ix"], first=True).withColumn("link", F.xxhash64("extracted_id"))
    ids = once.select(F.col("extracted_id").alias(on), "link")
    return rows.join(ids, on, "left"), once


def count_errors(docs: DataFrame, records: DataFrame, want: Expected, content: str = "content") -> DataFrame:
    """(id, found, wanted, error) of documents with more or fewer records than expected, where that is an error."""
    column = URL if want.value.source == URL else content
    asked = evaluate(docs, column, {"_w": _single(want.value.query)})
    found = records.groupBy("id").agg(F.count("*").alias("found"))
    both = asked.select("id", F.col("_w").try_cast("long").alias("wanted")).join(found, "id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    wrong = expected(F.col("found"), F.col("wanted"), want.if_larger, want.if_smaller)
    return both.withColumn("error", wrong).where("error is not null").select("id", "found", "wanted", "error")
