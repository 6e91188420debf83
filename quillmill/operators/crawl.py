"""Crawling over stored pages: URL lists, links, frontier rounds, archives.

There is no network here. Pages come as a table, or from a ``fetch`` that the
caller injects; every step between them is a DataFrame operator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import urls as U
from quillmill.operators import relational as R
from quillmill.operators.query import Query, allow, evaluate
from quillmill.sources.checkpoints import checkpoint

#: Responses after which a fetch is tried again.
RETRY_CODES = (429, 502, 503, 504, 521, 522, 524)
LINKS_HTML = Query("xpath", "//body//a/@href", "multi")
LINKS_XML = Query("xpath", "//link|//loc", "multi", text_only=True)
MAX_URL = 2000
Fetch = Callable[[DataFrame], DataFrame]


def check_urls(df: DataFrame, whitelist: list[Query], blacklist: list[Query], column: str = "url") -> DataFrame:
    """Rows with a usable URL: not empty, valid, on the white list if any, not on the black list."""
    fine = df.where(F.col(column).isNotNull() & (F.col(column) != "") & F.is_valid_utf8(F.col(column)))
    return allow(fine, column, whitelist, blacklist)


def check_response(df: DataFrame, column: str = "response") -> DataFrame:
    return df.where(F.col(column) < 400)


def to_retry(df: DataFrame, column: str = "response", codes: tuple[int, ...] = RETRY_CODES) -> DataFrame:
    return df.where(F.col(column).isin(list(codes)))


def links(pages: DataFrame, url: str = "url", content: str = "content", queries: list[Query] | None = None) -> DataFrame:
    """(url, link) for every link that the queries find, in document order with repeats."""
    named = {f"_l{i}": q for i, q in enumerate(queries or [LINKS_HTML])}
    made = evaluate(pages.select(url, content), content, named)
    return made.select(url, F.explode(F.concat(*named)).alias("link"))


def normalise(found: DataFrame, domain: str | None = None, whitelist: list[str] | None = None, blacklist: list[str] | None = None, archive_prefix: str = "") -> DataFrame:
    """Links as absolute URLs, each once: resolved, of the domain, with allowed parameters, of usable length."""
    link = F.col("link")
    if archive_prefix:
        link = F.regexp_replace(link, "^" + re.escape(archive_prefix), "")
    out = found.select(U.filter_params(U.resolved(link, F.col("url")), whitelist, blacklist).alias("url"))
    out = out.where((F.col("url") != "") & (F.length("url") <= MAX_URL))
    return (out.where(U.same_domain(F.col("url"), domain)) if domain else out).distinct()


def frontier(pages: DataFrame, known: DataFrame, domain: str | None = None, queries: list[Query] | None = None) -> DataFrame:
    """One round: the URLs that pages link to and that are not known yet."""
    return R.add_if_new(known, normalise(links(pages, queries=queries), domain))


def crawl(start: DataFrame, fetch: Fetch, rounds: int, domain: str | None = None) -> DataFrame:
    """Breadth-first rounds: (url, depth) of everything reached. ``fetch`` turns (url) into (url, content).

    A round is one job; the loop runs over rounds, not over rows.
    """
    seen = start.select("url").distinct().withColumn("depth", F.lit(0))
    edge = seen
    for depth in range(1, rounds + 1):
        new = checkpoint(frontier(fetch(edge.select("url")), seen, domain).withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, edge = seen.unionByName(new), new
    return seen


def robots_sitemaps(robots: DataFrame, content: str = "content", domain: str | None = None) -> DataFrame:
    """Start URLs that robots.txt files name as site maps, each once."""
    line = robots.select(F.explode(F.split(content, "\n")).alias("line"))
    found = line.select(F.trim(F.regexp_extract("line", r"(?i)^sitemap:(.*)", 1)).alias("url"))
    found = found.select(F.regexp_replace("url", "\r$", "").alias("url")).where("url != ''")
    return (found.where(U.same_domain(F.col("url"), domain)) if domain else found).distinct()


def counters(urls: DataFrame, name: str, start: int, end: int, step: int = 1, alias: str = "", alias_add: int = 0, column: str = "url") -> DataFrame:
    """URLs with a counter variable filled in, from start to end; sorted uses need an order of their own.

    URLs without the variable stay. An alias is the counter moved by a number.
    """
    at = F.col("_n")
    has = F.instr(column, name) > 0
    numbers = F.when(has, F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(step).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    filled = F.replace(F.col(column), F.lit(name), at.cast("string"))
    if alias:
        filled = F.replace(filled, F.lit(alias), (at + alias_add).cast("string"))
    return urls.withColumn("_n", F.explode(numbers)).withColumn(column, F.when(has, filled).otherwise(F.col(column))).drop("_n").distinct()


def add_params(url: Column, params: list[str]) -> Column:
    extra = "&".join(params)
    if not extra:
        return url
    return F.concat(url, F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?")), F.lit(extra))


def redirect(df: DataFrame, pattern: str, to: str, variables: dict[str, str] | None = None, column: str = "url") -> DataFrame:
    """URLs that match a pattern, rewritten; ``$name`` in the target comes from a pattern of its own."""
    target = F.lit(to)
    for n, p in sorted((variables or {}).items(), key=lambda v: -len(v[0])):
        target = F.replace(target, F.lit(f"${n}"), F.regexp_extract(F.col(column), p, 0))
    return df.withColumn(column, F.when(F.col(column).rlike(pattern), target).otherwise(F.col(column)))


_MEMENTO = r'<([^>]+)>\s*;[^<]*rel="[^"]*memento[^"]*"[^<]*datetime="([^"]+)"'


def mementos(df: DataFrame, content: str = "content") -> DataFrame:
    """(url, stamp) of each archived version that a time map lists; stamps as yyyyMMddHHmmss."""
    entry = F.explode(F.regexp_extract_all(content, F.lit(r'<[^>]+>\s*;[^<]*rel="[^"]*memento[^"]*"[^<]*datetime="[^"]+"'), 0)).alias("_m")
    rest = [c for c in df.columns if c != content]
    m = df.select(*[F.col(c).alias(f"from_{c}") for c in rest], entry)
    when = F.try_to_timestamp(F.regexp_extract("_m", r'datetime="[A-Za-z]+, ([^"]+) GMT"', 1), F.lit("d MMM yyyy HH:mm:ss"))
    return m.select(*[f"from_{c}" for c in rest], F.regexp_extract("_m", _MEMENTO, 1).alias("url"), F.date_format(when, "yyyyMMddHHmmss").alias("stamp")).where("stamp is not null")


def next_timemap(content: Column) -> Column:
    """The page of a time map that follows, empty if none does."""
    return F.regexp_extract(content, r'<([^>]+)>\s*;[^<]*rel="timemap"', 1)


def archive_references(df: DataFrame, marker: str, stored: DataFrame, content: str = "content") -> DataFrame:
    """Archived contents that only point to another time of the same URL, which isn't stored yet.

    The pointer is the marker and a time stamp of 14 digits.
    """
    stamp = F.regexp_extract(content, "^" + re.escape(marker) + r"([0-9]{14})", 1)
    asked = df.select("url", stamp.alias("stamp")).where("stamp != ''").distinct()
    return asked.join(stored.select("url", "stamp"), ["url", "stamp"], "left_anti")


def check_content_types(df: DataFrame, whitelist: list[Query], blacklist: list[Query], column: str = "type") -> DataFrame:
    return allow(df, column, whitelist, blacklist)


def check_content(df: DataFrame, whitelist: list[Query], blacklist: list[Query], column: str = "content") -> DataFrame:
    return allow(df, column, whitelist, blacklist)
