"""Document queries: six types, four kinds of result.

A regular expression is a native column. The other types need a parsed
document; all queries of a configuration that do run in one Arrow-batched pass,
so each document is parsed once however many queries look at it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import json_query as J
from quillmill.functions import markup as M

TYPES = ("regex", "xpath", "jsonpointer", "jsonpath", "xpathjsonpointer", "xpathjsonpath")
KINDS = ("bool", "single", "multi", "subsets")
SQL_TYPES = {"bool": "boolean", "single": "string", "multi": "array<string>", "subsets": "array<string>"}


@dataclass(frozen=True)
class Query:
    """A query of a type, with its kind of result.

    Combined types hold the XPath on the first line and the JSON query on the
    second; their XPath half is always text only. With ``closed_refs`` a
    character reference in markup needs its semicolon, else it is text.
    """

    type: str
    text: str
    kind: str = "single"
    text_only: bool = False
    closed_refs: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES or self.kind not in KINDS:
            raise ValueError(f"no such query: {self.type}, {self.kind}")


def regex_bool(text: Column, pattern: str) -> Column:
    """Whether a pattern is found; character classes follow Unicode."""
    return F.coalesce(text.rlike("(?U)" + pattern), F.lit(False))


def regex_first(text: Column, pattern: str) -> Column:
    """The first whole match, or an empty text."""
    return F.coalesce(F.regexp_substr(text, F.lit("(?U)" + pattern)), F.lit(""))


def regex_all(text: Column, pattern: str) -> Column:
    """All whole matches that don't overlap."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?U)" + pattern), 0), F.array().cast("array<string>"))


def default(kind: str) -> Any:
    return {"bool": False, "single": ""}.get(kind, [])


def native(q: Query, doc: Column) -> Column | None:
    """The query as a native column, if there is one with the same results."""
    if q.type == "regex" and q.kind != "subsets":
        return {"bool": regex_bool, "single": regex_first, "multi": regex_all}[q.kind](doc, q.text)
    path = {"jsonpath": J.native_path, "jsonpointer": J.pointer_to_path}.get(q.type, lambda _: None)(q.text)
    # an array or null would be told apart from text only by a parser
    if path and q.kind == "single" and q.text_only:
        return F.coalesce(F.get_json_object(doc, path), F.lit(""))
    return None


class Document:
    """A text with the parses that queries have asked for."""

    def __init__(self, text: str | None) -> None:
        self.text, self._json, self._trees, self._have = text or "", None, {}, set()

    @property
    def json(self) -> Any:
        if "json" not in self._have:
            self._json = J.parse(self.text)
            self._have.add("json")
        return self._json

    def tree(self, closed_refs: bool = False) -> M.Node | None:
        if closed_refs not in self._trees:
            self._trees[closed_refs] = M.parse(self.text, closed_refs=closed_refs)
        return self._trees[closed_refs]


class Evaluator:
    """A compiled query."""

    def __init__(self, q: Query) -> None:
        self.q = q
        lines = q.text.split("\n", 1)
        if q.type.startswith("xpath"):
            self.xpath = M.XPath(lines[0])
        self.path = lines[-1]
        if q.type == "regex":
            import regex

            self.regex = regex.compile(q.text)
        if q.type.endswith("jsonpath"):
            J.path_values({}, self.path)  # a wrong path is an error now, not in a task

    def __call__(self, doc: Document) -> Any:
        q, kind = self.q, self.q.kind
        if not doc.text:
            return default(kind)
        if q.type == "regex":
            found = (m[0] for m in self.regex.finditer(doc.text))
            return {"bool": lambda: any(True for _ in found), "single": lambda: next(found, "")}.get(kind, lambda: list(found))()
        if q.type == "xpath":
            if kind in ("bool", "subsets"):
                return (M.xpath_bool if kind == "bool" else M.xpath_subsets)(doc.tree(q.closed_refs), self.xpath)
            return (M.xpath_first if kind == "single" else M.xpath_all)(doc.tree(q.closed_refs), self.xpath, q.text_only)
        value = doc.json if not q.type.startswith("xpath") else J.parse(M.xpath_first(doc.tree(q.closed_refs), self.xpath, True))
        name = "pointer" if q.type.endswith("pointer") else "path"
        run = getattr(J, f"{name}_{ {'single': 'first', 'multi': 'all'}.get(kind, kind)}")
        return run(value, self.path) if kind in ("bool", "subsets") else run(value, self.path, q.text_only)


def evaluate(df: DataFrame, column: str, queries: dict[str, Query]) -> DataFrame:
    """Adds a column for each named query on a text column.

    Native queries become expressions; the others share one pass and one parse.
    A null or empty text gives false, an empty text or no values.
    """
    names = [c for c in df.columns if c not in queries]
    own: dict[str, Column] = {}
    rest: dict[str, Query] = {}
    for name, q in queries.items():
        c = native(q, F.col(column))
        if c is None:
            rest[name] = q
        else:
            own[name] = c
    if rest:
        types = ", ".join(f"`{n}` {SQL_TYPES[q.kind]}" for n, q in rest.items())
        df = df.withColumn("_q", _udf(tuple(rest.items()), types)(F.col(column)))
        df = df.withColumns({n: F.col("_q")[n] for n in rest}).drop("_q")
    return df.withColumns(own).select(*names, *queries) if own else df.select(*names, *queries)


def _udf(items: tuple[tuple[str, Query], ...], types: str):
    @F.pandas_udf(f"struct<{types.replace(' boolean', ':boolean').replace(' string', ':string').replace(' array<', ':array<')}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [(n, Evaluator(q)) for n, q in items]
        for texts in batches:
            rows = []
            for t in texts:
                doc = Document(t)
                rows.append([e(doc) for _, e in compiled])
            yield pd.DataFrame(rows, columns=[n for n, _ in compiled])

    return run


def subsets(df: DataFrame, column: str, q: Query, out: str = "subset") -> DataFrame:
    """One row for each sub-document that a query finds."""
    q = replace(q, kind="subsets")
    return evaluate(df, column, {"_s": q}).withColumn(out, F.explode("_s")).drop("_s")


def nested_subsets(df: DataFrame, column: str, first: Query, again: Query, depth: int = 100, out: str = "subset") -> DataFrame:
    """Sub-documents, each followed by those that a query finds inside it, down to a depth."""

    def walk(doc: str, level: int, find: Evaluator) -> list[str]:
        found = [doc]
        if level < depth:
            for s in find(Document(doc)):
                if s != doc:
                    found += walk(s, level + 1, find)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Evaluator(replace(first, kind="subsets"))
        inner = Evaluator(replace(again, kind="subsets"))
        for b in batches:
            at = b.schema.get_field_index(column)
            lists = [[x for s in top(Document(t)) for x in walk(s, 1, inner)] for t in b.column(at).to_pylist()]
            yield b.append_column("_s", pa.array(lists, pa.list_(pa.string())))

    schema = df.withColumn("_s", F.array().cast("array<string>")).schema
    return df.mapInArrow(run, schema).withColumn(out, F.explode("_s")).drop("_s")


def test_query(q: Query, text: str) -> dict[str, Any]:
    """All four kinds of result of a query on one text, with the time each took in ms."""
    out: dict[str, Any] = {}
    doc = Document(text)
    for kind in KINDS:
        began = time.perf_counter()
        out[kind] = Evaluator(replace(q, kind=kind))(doc)
        out[f"{kind}_ms"] = (time.perf_counter() - began) * 1000
    return out


def any_of(df: DataFrame, column: str, queries: list[Query], out: str) -> DataFrame:
    """Whether any of the queries holds."""
    named = {f"_a{i}": replace(q, kind="bool") for i, q in enumerate(queries)}
    if not named:
        return df.withColumn(out, F.lit(False))
    made = evaluate(df, column, named)
    cond = F.lit(False)
    for n in named:
        cond = cond | F.col(n)
    return made.withColumn(out, cond).drop(*named)


def allow(df: DataFrame, column: str, whitelist: list[Query], blacklist: list[Query]) -> DataFrame:
    """Rows that a white list names, if there is one, and a black list doesn't."""
    out = df
    if whitelist:
        out = any_of(out, column, whitelist, "_ok").where("_ok").drop("_ok")
    if blacklist:
        out = any_of(out, column, blacklist, "_no").where("not _no").drop("_no")
    return out
