"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit key hash. A bucket
over the byte limit splits on its next bit, and only such a bucket does, until
every shard fits. Rows whose whole hash is the same can't be told apart by
more bits; they go to overflow pages of the same prefix. Built from DataFrame
functions only.

The directory is found without a pass per bit: bytes are summed once at a
depth chosen from the total, rolled up to every shallower prefix, and the
shard of a prefix is the shallowest ancestor that fits. Only buckets that are
still too large go on to the next band of bits.

A row finds its shard in one join. The directory is laid out in cells of one
depth, as many bits as the directory has entries: a shallower entry stands in
each of its cells, deeper ones stand together in theirs. Cells are broadcast
up to ``MOST_CELLS``; beyond that the few that hold much of the bytes are, and
all others meet their rows in a shuffle.

Defined results: a null key hashes as an empty one; a null text weighs its
overhead only; a single row over the limit is a shard of its own; repeated
rows each have their place; an empty table gives an empty assignment; columns
that clash with the output are replaced. Pages of an overflow follow the rows'
contents, so they don't depend on how the input is split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillmill.llm.common import fresh, join_spread, key_hash, materialise

HASH_BITS = 60
#: Bits of a band are those that the mean shard needs and this many more.
SPARE_BITS = 6
#: Cells of the directory, about 50 bytes each, that are broadcast.
MOST_CELLS = 200_000
#: A cell with over one in this many bytes is hot.
HOT_SHARE = 1024
#: An overflow is summed in this many lanes, and equal rows in as many.
LANES = 4096
#: Bytes of shards that are written by one task.
TASK_BYTES = 32 << 20


def row_bytes(text: Column, overhead: int = 32) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def _prefix(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.shiftright(h, HASH_BITS - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes, n_rows) of each shard of rows (h, size); shards don't overlap.

    Depth 60 shards may be over the limit: they hold one hash only.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    step = max(4, min(24, math.ceil(math.log2(max(total / limit, 1))) + SPARE_BITS))
    lo, todo, parts = 0, rows, []
    while True:
        hi = min(HASH_BITS, lo + step)
        fine = todo.groupBy(_prefix(F.col("h"), hi).alias("p")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n_rows")
        )
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).groupBy(
            "depth", F.expr(f"shiftright(p, {hi} - depth)").alias("prefix")
        ).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        levels = materialise(levels, "shard-levels")
        # a shard fits while its parent doesn't; the root of a later band is known not to fit
        fits = levels.where((F.col("bytes") <= limit) | (F.col("depth") == HASH_BITS))
        parent = levels.where(F.col("bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up")
        )
        parts.append(
            fits.join(parent, (fits["depth"] == parent["depth"]) & (F.shiftright(fits["prefix"], 1) == parent["up"]), "left_semi")
        )
        if lo == 0:
            parts.append(fits.where("depth = 0"))
        over = materialise(levels.where((F.col("bytes") > limit) & (F.col("depth") == hi)).select("prefix", "bytes"), "shard-over")
        if hi == HASH_BITS or over.isEmpty():
            break
        # a hash that holds much of the bytes is in a prefix that does
        at = todo.withColumn("prefix", _prefix(F.col("h"), hi))
        todo = join_spread(at, over, ["prefix"], F.col("bytes") > total / HOT_SHARE).select("h", "size")
        lo, step = hi, 8
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialise(out, "shard-directory")


def cells(d: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(cell, bytes, entries) of a directory of n entries, and the depth of the cells.

    There are at most 2n cells, and as many copies of entries shallower than them.
    """
    depth = min(HASH_BITS, max(0, n.bit_length() - 1))
    first = F.expr(f"if(depth <= {depth}, shiftleft(prefix, {depth} - least(depth, {depth})), shiftright(prefix, greatest(depth, {depth}) - {depth}))")
    last = F.expr(f"if(depth < {depth}, _a + shiftleft(1L, {depth} - least(depth, {depth})) - 1, _a)")
    entry = F.struct("depth", "prefix", F.col("bytes").alias("shard_bytes"))
    spread = d.withColumn("_a", first).withColumn("cell", F.explode(F.sequence(F.col("_a"), last)))
    share = F.expr(f"bytes / shiftleft(1L, greatest(0, {depth} - depth))")
    return spread.groupBy("cell").agg(F.sum(share).alias("bytes"), F.collect_list(entry).alias("entries")), depth


def assign(
    docs: DataFrame, keys: list[str], limit: int, text: str = "text", size: str | None = None, most_cells: int = MOST_CELLS
) -> DataFrame:
    """The documents with ``shard`` (its prefix as bits, then its page), ``depth``, ``row_bytes`` and ``key_hash``.

    ``size`` names a column of byte counts; without it the text is measured.
    """
    new = {"row_bytes": F.col(size) if size else row_bytes(F.col(text)), "key_hash": key_hash(*[F.col(k) for k in keys])}
    rows = docs.withColumns(new)
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("shard", "depth")])
    d = directory(rows.select(F.col("key_hash").alias("h"), F.col("row_bytes").alias("size")), limit)
    n, total = d.agg(F.count("*"), F.sum("bytes")).first()
    table, bits = cells(d, n)
    cell, entries, weight, at = (fresh(c, rows.columns) for c in ("cell", "entries", "weight", "at"))
    table = materialise(table.select(F.col("cell").alias(cell), F.col("entries").alias(entries), F.col("bytes").alias(weight)), "shard-cells")
    placed = rows.withColumn(cell, _prefix(F.col("key_hash"), bits))
    if n <= most_cells:
        met = placed.join(F.broadcast(table), cell)
    else:
        met = join_spread(placed, table, [cell], F.col(weight) > total / HOT_SHARE)
    own = f"filter({entries}, e -> shiftright(key_hash, {HASH_BITS} - e.depth) = e.prefix)"
    met = met.withColumn(at, F.get(F.expr(own), F.lit(0)))
    bits_of = F.when(F.col(at)["depth"] == 0, F.lit("")).otherwise(F.expr(f"lpad(bin({at}.prefix), {at}.depth, '0')"))
    out = met.withColumns({"shard": F.concat(F.lit("s"), bits_of), "depth": F.col(at)["depth"]})
    over = (F.col("depth") == HASH_BITS) & (F.col(at)["shard_bytes"] > limit)
    carried = [*rows.columns, "shard", "depth"]
    if d.where((F.col("depth") == HASH_BITS) & (F.col("bytes") > limit)).isEmpty():
        return out.select(*carried)
    return out.where(~over).select(*carried).unionByName(_pages(out.where(over).select(*carried), limit))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of overflowing hashes, their shards named by page as well.

    Rows are laid end to end by a hash of their contents and cut every so many
    bytes that the largest row still fits behind a cut; rows over half the limit
    have pages of their own. Running bytes come from sums of lanes, then of equal
    contents inside a lane, then of rows, so no task holds an overflow.
    """
    cols = rows.columns
    big, row, body, copy, lane, run, part, lane_at, part_at, most, page = (
        fresh(c, cols) for c in ("big", "row", "body", "copy", "lane", "run", "part", "lane_at", "part_at", "most", "page")
    )
    hashable = [f.name for f in rows.schema.fields if not _holds_map(f.dataType)]
    keyed = rows.withColumns({big: F.col("row_bytes") > limit // 2, row: F.monotonically_increasing_id(), body: F.xxhash64(*hashable)})
    # rows are numbered once: sums and rows see the same copies
    keyed = materialise(
        keyed.withColumns({lane: F.pmod(F.shiftright(body, 40), F.lit(LANES)), copy: F.pmod(F.xxhash64(row), F.lit(LANES))}), "shard-overflow"
    )
    group = ["shard", big]
    parts = keyed.groupBy(*group, lane, body, copy).agg(F.sum("row_bytes").alias(part))
    lanes = parts.groupBy(*group, lane).agg(F.sum(part).alias(run))
    widest = keyed.groupBy(*group).agg(F.max("row_bytes").alias(most))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lanes = lanes.withColumn(lane_at, before(run, W.partitionBy(*group).orderBy(lane))).join(widest, group).drop(run)
    parts = parts.withColumn(part_at, before(part, W.partitionBy(*group, lane).orderBy(body, copy))).drop(part)
    start = materialise(parts.join(lanes, [*group, lane]), "shard-pages")
    inside = before("row_bytes", W.partitionBy(*group, lane, body, copy).orderBy(row))
    found = keyed.withColumn(run, inside).join(start, [*group, lane, body, copy])
    at = F.col(lane_at) + F.col(part_at) + F.col(run)
    # a page holds what starts within its stretch, and its last row ends by the limit
    stretch = F.greatest(F.lit(1), F.lit(limit) - F.col(most) + 1)
    # rows over half the limit are at least that far apart, so each starts alone in a stretch of half the limit
    number = F.when(F.col(big), F.floor(at / F.lit(limit // 2 + 1))).otherwise(F.floor(at / stretch))
    name = F.concat("shard", F.when(F.col(big), F.lit("-w")).otherwise(F.lit("-p")), number.cast("string"))
    return found.withColumn("shard", name).select(*cols)


def _holds_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _holds_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_holds_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType | T.VariantType)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard meet in one task, which its byte limit bounds."""
    spark = assigned.sparkSession
    total = assigned.agg(F.sum("row_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    assigned.repartition(tasks, "shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, assigned: DataFrame) -> DataFrame:
    """The rows of all shards, with the columns of what was written."""
    return spark.read.schema(assigned.schema).parquet(path).select(*assigned.columns)
