"""Configurations: JSON options by category, as dataclasses with defaults.

Options that are parallel lists are cut to the shortest complete one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from quillmill.functions.dates import RESOLUTIONS
from quillmill.functions.text import first_or_escape
from quillmill.operators import crawl as K
from quillmill.operators import extraction as X
from quillmill.operators import query as Q
from quillmill.operators import records as P
from quillmill.sources.tables import KINDS, Source

Options = dict[str, dict[str, Any]]


def options(text: str) -> Options:
    """Options by category and name, from a JSON list of {cat, name, value}."""
    out: Options = {}
    for o in json.loads(text):
        if "name" in o:
            out.setdefault(o.get("cat", ""), {})[o["name"]] = o.get("value")
    return out


def zipped(cat: dict[str, Any], *names: str) -> list[tuple]:
    """Parallel list options as tuples, as many as the shortest list has."""
    return list(zip(*[cat.get(n) or [] for n in names], strict=False))


def padded(cat: dict[str, Any], base: str, **defaults: Any) -> list[dict[str, Any]]:
    """Parallel list options as dicts, as many as the base has; missing values get defaults."""
    n = len(cat.get(base) or [])
    cols = {k: [*(cat.get(k.replace("_", ".")) or []), *[v] * n][:n] for k, v in defaults.items()}
    return [{"base": cat[base][i]} | {k: c[i] for k, c in cols.items()} for i in range(n)]


@dataclass
class AnalyzerConfig:
    algorithm: int
    sources: list[Source] = field(default_factory=list)
    target: str = "result"
    resolution: str = "weeks"
    fill_gaps: bool = True
    date_from: str | None = None
    date_to: str | None = None
    filter_queries: list[int] = field(default_factory=list)
    filter_all: bool = False
    manipulators: list[int] = field(default_factory=list)
    dictionaries: list[str] = field(default_factory=list)
    combine: bool = False
    algorithm_options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> AnalyzerConfig:
        o = options(text)
        general, group = o.get("general", {}), o.get("group-date", {})
        dates, query, tok = o.get("filter-date", {}), o.get("filter-query", {}), o.get("tokenizer", {})
        known = {"general", "group-date", "filter-date", "filter-query", "tokenizer", "upload", ""}
        rest = {k: v for c, vals in o.items() if c not in known for k, v in vals.items()}
        return cls(
            algorithm=int(o.get("", {}).get("algo", general.get("algo", 0))),
            sources=[Source(KINDS[k], t, f) for k, t, f in zipped(general, "input.sources", "input.tables", "input.fields")],
            target=general.get("target.table", "result"),
            resolution=RESOLUTIONS[int(group.get("resolution", 0))],
            fill_gaps=bool(group.get("fill.gaps", True)),
            date_from=dates.get("from", "") if dates.get("enable") else None,
            date_to=dates.get("to", "") if dates.get("enable") else None,
            filter_queries=query.get("queries") or [],
            filter_all=bool(query.get("all", False)),
            manipulators=tok.get("manipulators") or [],
            dictionaries=tok.get("dicts") or [],
            combine=bool(rest.get("combine.sources", False)),
            algorithm_options=rest,
        )


def labelled_queries(cat: dict[str, Any], registry: dict[int, Q.Query]) -> dict[str, str]:
    """Category patterns by label; entries without a label or query are left out."""
    return {label: token_pattern(registry[q]) for label, q in zipped(cat, "cat.labels", "cat.queries") if label and q in registry}


def token_pattern(q: Q.Query) -> str:
    """The pattern of a query that marks tokens; only regular expressions can, any other type is an error."""
    if q.type != "regex":
        raise ValueError(f"a query on tokens must be a regular expression, not {q.type}: {q.text}")
    return q.text


def extractor_config(text: str, registry: dict[int, Q.Query]) -> tuple[X.Pages, P.ExtractorConfig, P.ExtractorConfig | None]:
    """An extractor's configuration: its pages, its records, and those that they link to if any."""
    o = options(text)
    cat, general, names = o.get("extracting", {}), o.get("general", {}), o.get("variables", {})
    page, source, link = o.get("paging", {}), o.get("source", {}), o.get("linked", {})
    of = lambda c, n: registry.get(c.get(n) or 0)
    every = lambda c, n: [registry[q] for q in c.get(n) or [] if q in registry]
    where = lambda s: P.URL if s == 2 else P.CONTENT
    variables = [
        X.Variable(v["base"], P.Value(registry[v["query"]], where(v["source"])), v["alias"], int(v["alias_add"]), registry.get(v["skip_query"] or 0))
        for v in padded(names, "name", query=0, source=1, alias="", alias_add=0, skip_query=0)
        if v["base"] and v["query"] in registry
    ]
    tokens = [
        X.Token(t["base"], t["tokens_source"], registry[t["tokens_query"]])
        for t in padded(names, "tokens", tokens_source="", tokens_query=0)
        if t["base"] and t["tokens_query"] in registry
    ]
    paging = X.Paging(
        page.get("variable") or "page", int(page.get("first") or 0), page.get("first.string") or "", int(page.get("step") or 1), of(page, "number.from"),
        of(page, "is.next.from"), of(page, "next.from"), page.get("alias") or "", int(page.get("alias.add") or 0),
    )
    pages = X.Pages(
        source.get("url") or "", source.get("url.first") or "", variables, tokens, paging, every(cat, "error.retry"), every(cat, "error.fail"),
        int(general.get("retries") or 0), tuple(general.get("retry.http") or K.RETRY_CODES),
    )

    def records(c: dict[str, Any], prefix: str = "field.") -> P.ExtractorConfig:
        fields = [
            P.Field(f["field.names"], P.Value(registry[f["field.queries"]]), first_or_escape(f[f"{prefix}delimiters"]), bool(f[f"{prefix}ignore.empty"]), bool(f[f"{prefix}json"]), bool(f[f"{prefix}tidy.texts"]))
            for f in _rows(c, {"field.names": "", "field.queries": 0, f"{prefix}delimiters": "\n", f"{prefix}ignore.empty": True, f"{prefix}json": False, f"{prefix}tidy.texts": False})
            if f["field.names"] and f["field.queries"] in registry
        ]
        times = [
            P.Time(P.Value(registry[t["datetime.queries"]]), t["datetime.formats"] or "%F %T", t["datetime.locales"] or None)
            for t in _rows(c, {"datetime.queries": 0, "datetime.formats": "%F %T", "datetime.locales": ""})
            if t["datetime.queries"] in registry
        ]
        return P.ExtractorConfig(
            every(c, "dataset.queries"), [P.Value(q) for q in every(c, "id.queries")], fields, times, c.get("id.ignore") or [], bool(c.get("remove.duplicates", False))
        )

    return pages, records(cat), records(link, "") if link.get("dataset.queries") else None


def _rows(cat: dict[str, Any], names: dict[str, Any]) -> list[dict[str, Any]]:
    """Parallel list options as dicts, as many as the first has; missing values get defaults."""
    n = len(cat.get(next(iter(names))) or [])
    cols = {k: [*(cat.get(k) or []), *[v] * n][:n] for k, v in names.items()}
    return [{k: c[i] for k, c in cols.items()} for i in range(n)]


def parser_config(text: str, registry: dict[int, Q.Query]) -> P.ParserConfig:
    """A parser's configuration; sources 0 and 1 are the URL and the content."""
    o = options(text)
    cat, general = o.get("parser", {}), o.get("general", {})
    where = lambda s: P.URL if not s else P.CONTENT
    fields = [
        P.Field(
            f["base"], P.Value(registry[f["field_queries"]], where(f["field_sources"])), first_or_escape(f["field_delimiters"]), bool(f["field_ignore_empty"]),
            bool(f["field_json"]), bool(f["field_tidy_texts"]), f["field_datetime_formats"] or None, f["field_datetime_locales"] or None,
        )
        for f in padded(
            cat, "field.names", field_queries=0, field_sources=1, field_delimiters="\\n", field_ignore_empty=True, field_json=False,
            field_tidy_texts=False, field_datetime_formats="", field_datetime_locales="",
        )
        if f["field_queries"] in registry and f["base"]
    ]
    times = [
        P.Time(P.Value(registry[t["base"]], where(t["datetime_sources"])), t["datetime_formats"] or "%F %T", t["datetime_locales"] or None)
        for t in padded(cat, "datetime.queries", datetime_sources=1, datetime_formats="%F %T", datetime_locales="")
        if t["base"] in registry
    ]
    return P.ParserConfig(
        ids=[P.Value(registry[q], where(s)) for q, s in zipped(cat, "id.queries", "id.sources") if q in registry],
        fields=fields, times=times, ignore_ids=cat.get("id.ignore") or [],
        ignore_content=[registry[q] for q in cat.get("content.ignore.queries") or [] if q in registry],
        newest_only=bool(general.get("newest.only", True)), skip_urls=[registry[q].text for q in general.get("skip") or [] if q in registry],
    )
