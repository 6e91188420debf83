"""Token-id output in ORC.

Documents are encoded and written in ascending doc_id order as ORC: integer
run-length encoding of the ids, a row index and a Bloom filter on doc_id in
each stripe. A file is a range of ids; stripes are read in parallel, and a
lookup by id prunes files, stripes and row groups by their metadata.

Defined results: a null or empty text is the end id alone; null ids come
first; rows of the same id follow by a hash of their text; an empty table
gives an empty folder that reads as an empty result; other columns of the
input are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import in_bulk, materialise, small_batches
from quillmill.llm.tokens import BULK, encoder, forget

SCHEMA = "doc_id long, part int, seq long, ids array<int>"
#: Text bytes of a file, and files whose totals are summed together.
FILE_BYTES = 64 << 20
FILES = 4096
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool, text: str = "text") -> None:
    """Encodes (doc_id, text) into ORC files under path.

    Texts, not ids, are shuffled: they are half the size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_t")).withColumn(
        "_tie", F.xxhash64("_t")
    )
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / FILE_BYTES))
    ordered = src.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer, spaced), np.array([end_id], "<u4").tobytes()
        for b in in_bulk(batches, 1, BULK):
            ids = [i + end for i in enc.encode(b.column(1))]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            values = np.frombuffer(b"".join(ids), "<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            cols = [
                b.column(0),
                pa.array(np.full(len(ids), part, np.int32)),
                pa.array(np.arange(seq, seq + len(ids))),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ]
            seq += len(ids)
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "seq", "ids"])

    ordered.mapInArrow(run, SCHEMA).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, seq, ids); a filter on doc_id prunes stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Prefix sums need no single task: totals of blocks of files, then of the
    files in a block, give a file's start, a window inside the file the rest.
    Documents meet their file's start in a join on the file, which its size bounds.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            lists = b.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            at = lists.offsets.to_numpy()
            view = memoryview(values).cast("B")
            crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cols = [*b.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    rows = materialise(
        read(spark, path).mapInArrow(run, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"), "token-digest"
    )
    # one row a file: a window over blocks of files, then one over the blocks, of which there are few
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr(f"part div {FILES}"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).withColumn("_block", ahead(W.orderBy("block"))).drop("n")
    inside = totals.withColumn("_file", ahead(W.partitionBy("block").orderBy("part")))
    base = inside.join(blocks, "block").select("part", (F.col("_block") + F.col("_file")).alias("_base"))
    before = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("_in", F.coalesce(before, F.lit(0)))
        .join(base, "part")
        .select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
    )


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents of these ids, through the Bloom filters and row indexes."""
    return read(spark, path).where(F.col("doc_id").isin(ids))
