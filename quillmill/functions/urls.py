"""URL functions."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SAFE = "!#$&'()*+,/:;=?@[]%-._~"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def path_and_query(url: Column) -> Column:
    """What follows the host, without a fragment; at least a slash."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def same_domain(url: Column, domain: str) -> Column:
    return host(url) == F.lit(domain.lower())


def to_cross_domain(sub_url: Column, domain: str) -> Column:
    return F.concat(F.lit(domain), sub_url)


def from_cross_domain(url: Column) -> Column:
    return F.regexp_replace(url, "^[^/]*", "")


def escape(text: Column) -> Column:
    return F.url_encode(text)


def unescape(text: Column) -> Column:
    return F.try_url_decode(text)


def filter_params(sub_url: Column, whitelist: list[str] | None = None, blacklist: list[str] | None = None) -> Column:
    """A URL with only the query parameters that a white list names or a black list doesn't, in order."""
    base = F.regexp_extract(sub_url, r"^[^?#]*", 0)
    query = F.regexp_extract(sub_url, r"\?([^#]*)", 1)
    params = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.regexp_extract(p, "^[^=]*", 0)
    if whitelist:
        params = F.filter(params, lambda p: name(p).isin(*whitelist))
    elif blacklist:
        params = F.filter(params, lambda p: ~name(p).isin(*blacklist))
    return F.when(F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)


def resolve_link(link: str | None, base: str) -> str:
    """A link of a page as an absolute URL without fragment; empty if it isn't one."""
    text = (link or "").strip().replace("&amp;", "&")
    text = text.split("#", 1)[0]
    if not text:
        return ""
    try:
        parts = urlsplit(urljoin(base, text))
    except ValueError:
        return ""
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return ""
    path = quote(parts.path or "/", safe=SAFE)
    return urlunsplit((parts.scheme, parts.netloc.lower(), path, quote(parts.query, safe=SAFE), ""))


@F.pandas_udf(StringType())
def resolved(link: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_link(a, b) for a, b in zip(link, base, strict=True)])

