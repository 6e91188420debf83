"""Incremental parsing: new files are processed once and upserted.

The stream's checkpoint takes the place of a table of finished keys: a run picks
up what came since the last one, and a run that fails starts the same batch again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from quillmill.functions.dates import reduce_date
from quillmill.operators import relational as R
from quillmill.operators.records import ParserConfig, parse


def upsert_into(spark: SparkSession, table: str, batch: DataFrame, key: list[str]) -> None:
    """Writes a table anew with a batch put in; the old version stays until the new one is complete.

    The new table is written beside the old one, then both change names. A run
    that ends between the two renames leaves the old one whole as ``__old``, and
    the next run begins by giving it its name back.
    """
    new, old = f"{table}__new", f"{table}__old"
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(old):
        spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
    if not spark.catalog.tableExists(table):
        R.latest(batch, key, [c for c in batch.columns if c not in key] or key).write.saveAsTable(table)
        return
    R.upsert(spark.table(table), batch, key).write.mode("overwrite").saveAsTable(new)
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")


def parse_new(spark: SparkSession, path: str, schema: StructType, cfg: ParserConfig, table: str, checkpoint: str) -> StreamingQuery:
    """Parses the files that came since the last run into a table of records, keyed by content."""
    stream = spark.readStream.schema(schema).parquet(path)

    def step(batch: DataFrame, _: int) -> None:
        upsert_into(spark, table, parse(batch, cfg), ["content_id"])

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def groups_over_time(stream: DataFrame, time: str, resolution: str, late: str = "7 days") -> DataFrame:
    """Counts per date group of an event stream, one row a group, for output modes update and complete.

    Days and weeks are windows, so their state goes once no event can come for
    them; months and years are a row of state each, and few.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    if resolution in ("days", "weeks"):
        # weeks begin on Monday; the epoch was a Thursday
        span = F.window(time, "1 day") if resolution == "days" else F.window(time, "7 days", "7 days", "4 days")
        date, grouped = F.col("window.start"), timed.groupBy(span)
        out = grouped.agg(F.count("*").alias("n"))
        return out.select(reduce_date(F.date_format(date, "yyyy-MM-dd"), resolution).alias("date"), "n")
    date = reduce_date(F.date_format(time, "yyyy-MM-dd"), resolution).alias("date")
    return timed.groupBy(date).agg(F.count("*").alias("n"))
