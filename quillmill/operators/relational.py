"""Relational shapes of an incremental corpus pipeline: queues, versions, upserts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_urls(urls: DataFrame, state: DataFrame, after: int = -1, n: int = 1) -> DataFrame:
    """The next URLs to crawl: not manual, not done, not leased; by id.

    ``state``: url, success, locked.
    """
    s = state.select(F.col("url").alias("_u"), "success", "locked")
    joined = urls.where((F.col("id") > after) & ~F.col("manual")).join(s, F.col("id") == F.col("_u"), "left")
    free = joined.where(~F.coalesce("success", F.lit(False)) & ~F.coalesce("locked", F.lit(False)))
    return free.orderBy("id").limit(n).select(*urls.columns)


def pending(urls: DataFrame, ready: DataFrame, done: DataFrame, key: str = "url", id_col: str = "id") -> DataFrame:
    """URLs with usable content that are not done yet: a semi join, then an anti join."""
    return urls.join(ready.select(F.col(key).alias(id_col)), id_col, "left_semi").join(
        done.select(F.col(key).alias(id_col)), id_col, "left_anti"
    )


def state_of(log: DataFrame, key: str = "url") -> DataFrame:
    """One state per key: the last lock time and whether it ever succeeded."""
    return log.groupBy(key).agg(F.max("locktime").alias("locktime"), F.max("success").alias("success"))


def latest(df: DataFrame, key: list[str], by: list[str], where: Column | None = None, first: bool = False) -> DataFrame:
    """The row of each key with the largest values of ``by``, or the smallest; nulls are the smallest.

    An aggregation, so rows combine before the shuffle and a key may hold any share of them.
    """
    rows = df if where is None else df.where(where)
    rest = [c for c in df.columns if c not in key]
    best = (F.min_by if first else F.max_by)(F.struct(*rest), F.struct(*by))
    return rows.groupBy(*key).agg(best.alias("_v")).select(*key, "_v.*").select(*df.columns) if rest else rows.select(*key).distinct()


def latest_value(parsed: DataFrame, crawled: DataFrame, urls: DataFrame, columns: list[str]) -> DataFrame:
    """The value parsed from the newest content of each URL.

    parsed.content -> crawled.id, crawled.url -> urls.id.
    """
    p = parsed.select(F.col("content").alias("_c"), *columns)
    c = crawled.select(F.col("id").alias("_c"), F.col("url").alias("_u"))
    u = urls.select(F.col("id").alias("_u"), F.col("url"))
    # the newest content by aggregation, so rows combine before the shuffle
    value = F.max_by(F.struct(*columns), F.col("_c")).alias("_v")
    return p.join(c, "_c").groupBy("_u").agg(value).join(u, "_u").select("url", *[F.col(f"_v.{x}") for x in columns])


def purge_duplicates(df: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """The row with the largest id of each key."""
    top = df.groupBy(*key).agg(F.max(F.struct(id_col, *[c for c in df.columns if c not in (*key, id_col)])).alias("_t"))
    return top.select(*key, "_t.*").select(*df.columns)


def duplicates(df: DataFrame, column: str, case_sensitive: bool = True) -> DataFrame:
    """Values that occur more than once, with how often."""
    k = F.col(column) if case_sensitive else F.lower(column)
    return df.groupBy(k.alias(column)).agg(F.count("*").alias("n")).where("n > 1")


def add_if_new(old: DataFrame, new: DataFrame, column: str = "url", case_sensitive: bool = True, max_length: int = 2000) -> DataFrame:
    """Values of a new list that an old list lacks, each once.

    Of values that differ in case only, the first in order is taken.
    """
    k = (lambda c: c) if case_sensitive else F.lower
    fine = new.where((F.col(column) != "") & (F.length(column) <= max_length))
    once = fine.groupBy(k(F.col(column)).alias("_k")).agg(F.min(column).alias(column))
    return once.join(old.select(k(F.col(column)).alias("_k")), "_k", "left_anti").select(column)


def merge_lists(lists: list[DataFrame], column: str = "url") -> DataFrame:
    out = lists[0].select(column)
    for x in lists[1:]:
        out = out.unionByName(x.select(column))
    return out.distinct()


def upsert(old: DataFrame, new: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """A table with the rows of a new one put in, one for each key: the largest by ``by``, else by all other columns."""
    rows = latest(new, key, by or [c for c in new.columns if c not in key] or key)
    return old.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*old.columns))


def update_where(df: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    """An update as a rewrite."""
    return df.withColumns({c: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(~F.coalesce(cond, F.lit(False)))


def reset_state(state: DataFrame, cond: Column | None = None) -> DataFrame:
    """Marks rows as not done and not locked."""
    fresh = {"success": F.lit(False), "locktime": F.lit(None).cast(dict(state.dtypes)["locktime"])}
    return update_where(state, F.lit(True) if cond is None else cond, fresh)


def clone(df: DataFrame, into: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with their ids moved behind those of another table."""
    off = into.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_off"))
    return df.crossJoin(F.broadcast(off)).withColumn(id_col, F.col(id_col) + F.col("_off")).select(*df.columns)


def owner_of(parsed: DataFrame, ids: DataFrame, id_col: str = "parsed_id") -> DataFrame:
    """Which content owns an id: its first one."""
    return parsed.join(ids.select(id_col), id_col, "left_semi").groupBy(id_col).agg(F.min("content").alias("content"))


def first_owner(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Rows whose id no earlier row has."""
    return latest(df, [id_col], [order], first=True)


def median(column: Column, truncate: bool = False) -> Column:
    """The median; of an even count the mean of the middle two, as a whole number if truncated."""
    m = F.percentile(column, F.lit(0.5))
    return F.floor(m) if truncate else m


def top_n(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """A page of a log: rows from an offset."""
    return df.orderBy(*order).offset(offset).limit(n)
