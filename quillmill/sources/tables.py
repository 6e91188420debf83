"""Scans, list imports and dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import trim_space

KINDS = ("parsed", "extracted", "analyzed", "crawled")


@dataclass(frozen=True)
class Source:
    """A text column of a target table of a kind."""

    kind: str
    table: str
    column: str

    def table_name(self, namespace: str) -> str:
        if self.kind not in KINDS:
            raise ValueError(f"no such source: {self.kind}")
        return f"{namespace}_crawled" if self.kind == "crawled" else f"{namespace}_{self.kind}_{self.table}"

    def column_name(self) -> str:
        """Fields carry their kind as a prefix; id and time of a record have one underscore, fields two."""
        if self.kind == "crawled":
            return self.column
        if self.column in ("id", "datetime") and self.kind in ("parsed", "extracted"):
            return f"{self.kind}_{self.column}"
        return f"{self.kind}__{self.column}"

    @property
    def label(self) -> str:
        return f"{self.kind}.{self.table}.{self.column}" if self.kind != "crawled" else f"crawled.{self.column}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(df: DataFrame, columns: list[str], where: Column | str | None = None, order: list[Column] | None = None, casts: dict[str, str] | None = None) -> DataFrame:
    """Some columns of a table, filtered, ordered and cast if asked for."""
    out = df if where is None else df.where(where)
    if order:
        out = out.orderBy(*order)
    return out.select(*[F.col(c).cast(casts[c]).alias(c) if casts and c in casts else F.col(c) for c in columns])


def point(df: DataFrame, columns: list[str], where: Column | str) -> DataFrame:
    """The columns of one row."""
    return df.where(where).select(*columns).limit(1)


def as_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns as texts."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns or df.columns])


def usable(spark: SparkSession, sources: list[Source], namespace: str) -> tuple[list[Source], list[str]]:
    """Sources whose table and column exist, and a warning for each other one."""
    good, warnings = [], []
    for s in sources:
        name = s.table_name(namespace)
        if not spark.catalog.tableExists(name):
            warnings.append(f"table {name} does not exist")
        elif s.column_name() not in spark.table(name).columns:
            warnings.append(f"table {name} has no column {s.column_name()}")
        else:
            good.append(s)
    return good, warnings


def import_list(spark: SparkSession, path: str, skip_first: bool = False, ignore_empty: bool = True, column: str = "url") -> DataFrame:
    """A text list, one value a line; gzip is read as it is.

    The header is the line at the start of a file, so a file is read by one task if it is skipped.
    """
    if skip_first:
        every = F.split("value", r"\r?\n")
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(every, F.lit(2), F.size(every) - 1)).alias(column))
    else:
        lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias(column))
    return lines.where(trim_space(F.col(column)) != "") if ignore_empty else lines


def valence_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, value) of a tab-separated lexicon; more columns and lines without a number are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.trim(parts[0]).alias("term"), F.get(parts, 1).try_cast("double").alias("value"))
    return rows.where("term != '' and value is not null").dropDuplicates(["term"])


def emoji_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(emoji, words) of a tab-separated list."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("emoji"), F.get(parts, 1).alias("words")).where("emoji != '' and words is not null")


def token_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(token): one a line, without what follows a tab."""
    return spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("token")).where("token != ''").distinct()


def lemma_dictionary(spark: SparkSession, path: str, lemma: int = 1, tag: int = 2, count: int = 3) -> DataFrame:
    """(form, lemma, tag, count) of a tab-separated list; 0 for a column that it lacks."""
    parts = F.split("value", "\t")
    get = lambda i: F.get(parts, i) if i else F.lit(None).cast("string")
    rows = spark.read.text(path).select(
        parts[0].alias("form"), get(lemma).alias("lemma"), F.coalesce(get(tag), F.lit("")).alias("tag"),
        F.coalesce(get(count).try_cast("long"), F.lit(0)).alias("count"),
    )
    return rows.where("form != '' and lemma is not null")


def table_info(df: DataFrame) -> dict[str, str]:
    """Column types by name."""
    return dict(df.dtypes)


# The value types that SQL type names stand for.
SQL_KINDS = {
    "bool": "bool boolean bit tinyint(1)",
    "int32": "tinyint smallint mediumint int integer",
    "int64": "bigint",
    "double": "float double real decimal dec numeric fixed",
    "string": "char varchar binary varbinary tinytext text mediumtext longtext tinyblob blob mediumblob longblob enum set",
}


def value_kind(sql_type: str) -> str:
    """bool, int32, uint32, int64, uint64, double, string or unknown."""
    name = sql_type.strip().lower()
    unsigned = "unsigned" in name
    base = name if name == "tinyint(1)" else name.split("(")[0].split()[0] if name else ""
    for kind, names in SQL_KINDS.items():
        if base in names.split():
            return f"u{kind}" if unsigned and kind.startswith("int") else kind
    return "unknown"
