"""Sinks: tables, text and spreadsheet exports, JSON results, compression."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def replace(df: DataFrame, table: str) -> None:
    """Creates or replaces a result table and notes when."""
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(table)
    stamp = spark.sql("select date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss') as t").first()["t"]
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('updated' = '{stamp}')")


def updated(spark, table: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where("key = 'updated'").collect()
    return rows[0]["value"] if rows else None


def insert_values(df: DataFrame, rows: list[dict]) -> DataFrame:
    """A table with rows put behind it; missing fields are null."""
    made = df.sparkSession.createDataFrame([tuple(r.get(c) for c in df.columns) for r in rows], df.schema)
    return df.unionByName(made)


def export_list(df: DataFrame, path: str, column: str, header: bool = False, compression: str = "none") -> None:
    """A text list; ``gzip`` and ``deflate`` (zlib) compress it."""
    writer = df.select(F.col(column).cast("string").alias(column)).write.option("header", header).option("compression", compression)
    writer.option("quote", "").csv(path) if header else writer.text(path)


def export_table(df: DataFrame, path: str, prefix: str = "", compression: str = "none") -> None:
    """A table as CSV with a header, without the prefix of its columns."""
    names = [c.removeprefix(prefix) for c in df.columns]
    df.toDF(*names).write.option("header", True).option("compression", compression).csv(path)


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[c.removeprefix(prefix) for c in df.columns])


def result_json(df: DataFrame, key: str, value: str, created: str, changed: str) -> DataFrame:
    """One JSON text: results by date, with when they were made and changed. For result tables, a row a date."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    return df.agg(entries.alias("results")).select(F.to_json(F.struct("results", F.lit(created).alias("created"), F.lit(changed).alias("updated"))).alias("json"))


def page_json(columns: list[str]) -> Column:
    """A record as JSON; a value that is JSON is put in as it is, a blank one as an empty object."""
    parts = []
    for c in columns:
        v = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        raw = F.when(v == "", F.lit("{}")).when(F.try_parse_json(v).isNotNull(), v).otherwise(
            F.regexp_replace(F.to_json(F.struct(v.alias("v"))), r'^\{"v":|\}$', "")
        )
        parts.append(F.concat(F.lit(f'"{c}":'), raw))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_ODS = "application/vnd.oasis.opendocument.spreadsheet"
_NS = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"'


def spreadsheet(tables: dict[str, DataFrame], bold_header: bool = True) -> bytes:
    """An OpenDocument spreadsheet, one sheet a table. Rows stream through the driver: for result tables."""

    def cell(v: object, style: str) -> str:
        if v is None:
            return "<table:table-cell/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f'<table:table-cell{style} office:value-type="float" office:value="{v}"><text:p>{v}</text:p></table:table-cell>'
        text = "".join(f"<text:p>{escape(p)}</text:p>" for p in str(v).split("\n"))
        return f'<table:table-cell{style} office:value-type="string">{text}</table:table-cell>'

    def rows(df: DataFrame) -> Iterable[str]:
        bold = ' table:style-name="bold"' if bold_header else ""
        yield "<table:table-row>" + "".join(cell(c, bold) for c in df.columns) + "</table:table-row>"
        for r in df.toLocalIterator():
            yield "<table:table-row>" + "".join(cell(v, "") for v in r) + "</table:table-row>"

    sheets = "".join(f'<table:table table:name="{escape(n)}">{"".join(rows(df))}</table:table>' for n, df in tables.items())
    style = '<office:automatic-styles><style:style style:name="bold" style:family="table-cell"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles>'
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {_NS} office:version="1.3">{style}<office:body><office:spreadsheet>{sheets}</office:spreadsheet></office:body></office:document-content>'
    manifest = f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODS}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", _ODS, zipfile.ZIP_STORED)
        z.writestr("content.xml", content, zipfile.ZIP_DEFLATED)
        z.writestr("META-INF/manifest.xml", manifest, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def compress(data: bytes, kind: str, name: str = "data") -> bytes:
    """``none``, ``gzip``, ``zlib`` or ``zip``."""
    if kind == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
        return out.getvalue()
    return {"none": lambda: data, "gzip": lambda: gzip.compress(data, mtime=0), "zlib": lambda: zlib.compress(data)}[kind]()


def decompress(data: bytes, kind: str) -> bytes:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(z.namelist()[0])
    return {"none": lambda: data, "gzip": lambda: gzip.decompress(data), "zlib": lambda: zlib.decompress(data)}[kind]()
