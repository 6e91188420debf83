"""Record building: documents to typed records by configuration.

A parser record has one id, an optional time and named fields, each from a
query on the content or on the URL. An extractor splits a document into
sub-documents first and builds a record from each.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import dates
from quillmill.functions import text as T
from quillmill.operators import relational as R
from quillmill.operators.query import Query, any_of, evaluate, subsets
from quillmill.sources.checkpoints import checkpoint

CONTENT, URL = "content", "url"


@dataclass(frozen=True)
class Value:
    """A query and where it looks: the content or the URL."""

    query: Query
    source: str = CONTENT


@dataclass(frozen=True)
class Time:
    value: Value
    format: str = "%F %T"
    locale: str | None = None


@dataclass(frozen=True)
class Field:
    """A named field; several values are joined by a delimiter or written as JSON."""

    name: str
    value: Value
    delimiter: str = "\n"
    ignore_empty: bool = True
    json: bool = False
    tidy: bool = False
    format: str | None = None
    locale: str | None = None


@dataclass(frozen=True)
class ParserConfig:
    ids: list[Value]
    fields: list[Field] = field(default_factory=list)
    times: list[Time] = field(default_factory=list)
    ignore_ids: list[str] = field(default_factory=list)
    ignore_content: list[Query] = field(default_factory=list)
    newest_only: bool = True
    skip_urls: list[str] = field(default_factory=list)


def _first_filled(cols: list[Column]) -> Column:
    """The first text that isn't empty, else an empty one."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("")) if cols else F.lit("")


def _all_values(values: dict[str, Value], df: DataFrame, content: str) -> DataFrame:
    """Evaluates named values; those on the URL stay native, those on the content share one parse."""
    on_url = {n: v.query for n, v in values.items() if v.source == URL}
    on_doc = {n: v.query for n, v in values.items() if v.source != URL}
    out = evaluate(df, URL, on_url) if on_url else df
    return evaluate(out, content, on_doc) if on_doc else out


def _field(f: Field, c: Column) -> Column:
    kind = f.value.query.kind
    if kind == "bool":
        out = c.cast("string")
    elif kind == "single":
        c = _dated(f, c)
        c = T.tidy(c) if f.tidy else c
        # a text as JSON: an object with one key, without what is around the value
        out = F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "") if f.json else c
    else:
        vals = F.transform(c, lambda x: T.tidy(_dated(f, x)) if f.tidy else _dated(f, x))
        out = F.to_json(vals) if f.json else T.join_values(vals, f.delimiter, f.ignore_empty)
    return F.coalesce(out, F.lit(""))


def _dated(f: Field, c: Column) -> Column:
    if not f.format:
        return c
    found = dates.parse_datetime(c, f.format, f.locale)
    if f.locale:
        found = F.coalesce(found, dates.parse_datetime(c, f.format))
    return F.coalesce(found, F.lit(""))


def build(df: DataFrame, ids: list[Value], fields: list[Field], times: list[Time], content: str = "content", ignore_ids: list[str] | None = None, prefix: str = "parsed") -> DataFrame:
    """Adds ``<prefix>_id``, ``<prefix>_datetime`` and a column per field; rows without a usable id go.

    If every id comes from the URL, rows are dropped before their content is looked at.
    """
    out = df
    by_url = all(v.source == URL for v in ids)
    early = {f"_id{i}": v for i, v in enumerate(ids)}
    rest = {f"_t{i}": t.value for i, t in enumerate(times)} | {f"_f{i}": f.value for i, f in enumerate(fields)}

    def with_id(d: DataFrame) -> DataFrame:
        d = d.withColumn(f"{prefix}_id", _first_filled([F.col(n) for n in early]))
        d = d.where(F.col(f"{prefix}_id") != "")
        return d.where(~F.col(f"{prefix}_id").isin(ignore_ids)) if ignore_ids else d

    if by_url:
        out = _all_values(rest, with_id(_all_values(early, out, content)), content) if rest else with_id(_all_values(early, out, content))
    else:
        out = with_id(_all_values(early | rest, out, content))
    cands = [F.coalesce(dates.parse_datetime(F.col(f"_t{i}"), t.format, t.locale), dates.parse_datetime(F.col(f"_t{i}"), t.format)) for i, t in enumerate(times)]
    out = out.withColumn(f"{prefix}_datetime", F.coalesce(*cands).try_cast("timestamp") if cands else F.lit(None).cast("timestamp"))
    out = out.withColumns({f.name: _field(f, F.col(f"_f{i}")) for i, f in enumerate(fields)})
    return out.drop(*early, *rest)


def parse(crawled: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Records of crawled content (id, url, crawltime, content).

    Newest-only takes the newest version of a URL that gives a record: newest
    versions are parsed first, older ones only of URLs that gave none then. An
    id belongs to the first content that has it.
    """
    rows = crawled
    for p in cfg.skip_urls:
        rows = rows.where(~F.col("url").rlike(p))
    if cfg.ignore_content:
        rows = any_of(rows, "content", cfg.ignore_content, "_ign").where("not _ign").drop("_ign")
    names = [f.name for f in cfg.fields]

    def records(some: DataFrame) -> DataFrame:
        made = build(some, cfg.ids, cfg.fields, cfg.times, "content", cfg.ignore_ids)
        return made.select(F.col("id").alias("content_id"), "url", "crawltime", "parsed_id", "parsed_datetime", *names)

    if cfg.newest_only:
        newest = rows.groupBy("url").agg(F.max(F.struct("crawltime", "id"))["id"].alias("id")).select("id")
        made = checkpoint(records(rows.join(newest, "id", "left_semi")))
        older = rows.join(newest, "id", "left_anti").join(made.select("url"), "url", "left_anti")
        made = made.unionByName(R.latest(records(older), ["url"], ["crawltime", "content_id"]))
    else:
        made = records(rows)
    return R.first_owner(made, "parsed_id", "content_id").drop("crawltime")


@dataclass(frozen=True)
class ExtractorConfig:
    datasets: list[Query]
    ids: list[Value]
    fields: list[Field] = field(default_factory=list)
    times: list[Time] = field(default_factory=list)
    ignore_ids: list[str] = field(default_factory=list)
    remove_duplicates: bool = False


def datasets(df: DataFrame, content: str, queries: list[Query]) -> DataFrame:
    """Sub-documents by the first query that finds any."""
    named = {f"_d{i}": replace(q, kind="subsets") for i, q in enumerate(queries)}
    made = evaluate(df, content, named)
    pick = F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in named])
    return made.withColumn("subset_ix", F.lit(0)).select(*df.columns, F.posexplode(pick).alias("subset_ix", "subset"))


def extract(df: DataFrame, cfg: ExtractorConfig, content: str = "content") -> DataFrame:
    """A record for each sub-document of each row."""
    subs = datasets(df, content, cfg.datasets)
    made = build(subs, cfg.ids, cfg.fields, cfg.times, "subset", cfg.ignore_ids, "extracted")
    keep = [c for c in df.columns if c != content]
    out = made.select(*keep, "subset_ix", "extracted_id", "extracted_datetime", *[f.name for f in cfg.fields])
    return R.latest(out, ["extracted_id"], [*keep, "subset_ix"], first=True) if cfg.remove_duplicates else out


def link(extracted: DataFrame, linked: DataFrame, on: str) -> DataFrame:
    """Extracted rows with the id of the linked row that a field names, null if there is none."""
    ids = linked.groupBy("extracted_id").agg(F.min("id").alias("link"))
    return extracted.join(ids.withColumnRenamed("extracted_id", on), on, "left")


def alias(value: Column, add: int = 0) -> Column:
    """A variable as a number moved by an offset; a text that is none gives the offset."""
    return F.coalesce(value.try_cast("long"), F.lit(0)) + add


def pages(df: DataFrame, first: int, count: Column, step: int = 1) -> DataFrame:
    """The page numbers of a document with so many pages."""
    last = F.lit(first) + (count - 1) * step
    return df.where(count > 0).withColumn("page", F.explode(F.sequence(F.lit(first).cast("long"), last.cast("long"), F.lit(step).cast("long"))))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """A text with ``$name`` in place of variables filled in; longer names first."""
    out = template
    for n in sorted(values, key=lambda n: (-len(n), n)):
        out = F.replace(out, F.lit(f"${n}"), values[n].cast("string"))
    return out


def expected(found: Column, wanted: Column, if_larger: bool = True, if_smaller: bool = True) -> Column:
    """``larger`` or ``smaller`` if a count isn't what was expected, else null."""
    out = F.lit(None).cast("string")
    if if_larger:
        out = F.when(found > wanted, F.lit("larger")).otherwise(out)
    return F.when(found < wanted, F.lit("smaller")).otherwise(out) if if_smaller else out


__all__ = [
    "CONTENT", "URL", "ExtractorConfig", "Field", "ParserConfig", "Time", "Value", "alias", "build", "datasets", "expected", "extract",
    "link", "pages", "parse", "subsets", "substitute",
]
