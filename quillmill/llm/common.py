"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separators of these operators.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"
#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts handed to a Python worker at once; keeps a batch of very long texts small.
ARROW_ROWS = 256


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lowers the number of rows in an Arrow batch, so long texts fit a worker.

    Spark reads the setting when a lazy result runs, so it stays lowered for
    the session; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without the setting, as in tests, gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, cutting the lineage.

    A lost executor costs no recomputation of what was written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batch, column: int, most: int = 4 << 20):
    """Slices of an Arrow batch whose values in a binary column hold ``most`` bytes, 64 a row included, or are one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def in_bulk(batches, column: int, most: int = 4 << 20):
    """Arrow batches joined, or cut, to about ``most`` bytes in a binary column each; none is empty."""
    held, size = [], 0
    for whole in batches:
        for part in by_bytes(whole, column, most):
            n = 64 * part.num_rows + (pc.sum(pc.binary_length(part.column(column))).as_py() or 0)
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of binary texts, A-Z lower-cased, end to end, and their number in each text."""
    low = pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string()))
    lists = pc.ascii_split_whitespace(low)
    flat, at = lists.flatten().view(pa.binary()), lists.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end, or more than one, gives empty words
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(before[at - at[0]])


def carried(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The text as bytes, then the columns that go on, for a Python worker.

    Bytes, because a string column may hold what isn't UTF-8.
    """
    return docs.select(F.col(text).cast("binary").alias(fresh("text", keep)), *keep)


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join of many rows a key with one row a key, whatever share of the rows a key holds.

    ``hot`` marks the keys of ``table`` that hold more than a fixed share of the
    rows, so they are few and are broadcast; all others meet in a shuffle.
    """
    hot_keys = F.broadcast(table.where(hot).select(*keys))
    cold = rows.join(hot_keys, keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(F.broadcast(table.where(hot)), keys).unionByName(cold)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank give an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS))


def count_words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS))).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id never has."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def key_hash(*cols: Column) -> Column:
    """The first 60 bits of the md5 of the keys, joined by a unit separator; null is as empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fraction_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fresh(name: str, taken) -> str:
    """A column name that clashes with none of the taken ones (names ignore case)."""
    low = {t.lower() for t in taken}
    out, n = f"__{name}", 0
    while out.lower() in low:
        n += 1
        out = f"__{name}_{n}"
    return out


def u64(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64, copy=False)


WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
