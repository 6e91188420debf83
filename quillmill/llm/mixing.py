"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / size of the source`` copies. The
documents of a source are laid end to end by size (then by a hash), every other
one on the way up and the rest on the way down, their expected copies are
prefix-summed, one random offset in [0, 1) is added, and a document is emitted
once per integer boundary that its stretch crosses. In this order the rounding
of one document is made up for by the next of nearly the same size, and both
ends are small documents, so the words taken stay near the target.

The prefix sum never puts a source into one task. Ranks come from counts: of
smaller sizes in the source, then of smaller hash cells of the same size, then
of the rows before it in its own cell. A source's sizes are few (they are
lengths); a cell holds rows of one source, one size and one of ``CELLS`` hashes.

Sources may be many, as web domains are, so their table stays distributed:
places in code point order come from a range sort and the row counts of its
partitions, targets from rounds of sums over the table. A source's rate reaches
its documents with their ranks, in the same join.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources of size 0 get target 0; repeated rows are sampled one
by one; an empty table gives an empty mix; added columns that clash with
columns of the input replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.llm.common import count_words, fresh, key_hash, materialise

CELLS = 512
#: Source weights by place in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def ranked_sources(sources: DataFrame) -> DataFrame:
    """The table of sources ``s`` with ``place``: its number from 0 in code point order, null last."""
    ordered = sources.repartitionByRange(F.col("s").asc_nulls_last()).sortWithinPartitions(F.col("s").asc_nulls_last())
    # an id is its partition's number, shifted by 33 bits, and the row's place in there
    numbered = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_id", 33)
    counts = numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    first, at = {}, 0
    for p, n in sorted(map(tuple, counts)):
        first[p], at = at, at + n
    base = sources.sparkSession.createDataFrame(list(first.items()), "_p long, _first long")
    return numbered.join(F.broadcast(base), part == F.col("_p")).select(
        *sources.columns, (F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to sources with ``place`` and size ``n``: by weight, at most ``most`` times the size.

    What a stopped source leaves is shared by weight among the others until
    none is above its stop: each round stops those above theirs at the current
    words a weight, which only grow, so a source once stopped stays so.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sized = sources.withColumns({"_w": weight, "_cap": most * F.col("n").cast("double")})
    total = (sized.agg(F.sum("n")).first()[0] or 0) * share
    unit, stopped, rest = 0.0, -1, None
    while True:
        over = F.col("_w") * F.lit(unit) > F.col("_cap")
        k, cap, rest = sized.agg(
            F.sum(over.cast("long")), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))
        ).first()
        if k == stopped or not rest:
            break
        stopped, unit = k, (total - cap) / rest
    if rest == 0.0:
        unit = float("inf")  # all are stopped
    return sized.withColumn("target", F.least("_cap", F.col("_w") * F.lit(unit))).drop("_w", "_cap")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): the same in every run."""
    name = F.when(source.isNull(), F.lit("\1")).otherwise(F.concat(F.lit("s"), source))
    return F.conv(F.substring(F.sha2(F.concat(name, F.lit(str(seed))).cast("binary"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    docs: DataFrame,
    source: str = "source",
    size: Column | None = None,
    ties: list[str] | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 17,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``ties`` name the columns that order documents of the same size.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c.lower() not in added]
    tie = key_hash(*[F.col(c) for c in (ties or ["doc_id"])])
    weighed = count_words(F.col("text")) if size is None else size.cast("long")
    # the columns of a row travel as one, so their names clash with none in here
    rows = docs.select(F.struct(*keep).alias("row"), weighed.alias("size"), F.col(source).cast("string").alias("src"), tie.alias("tie"))
    cell = rows.withColumn("cell", F.pmod("tie", F.lit(CELLS)))
    grouped = cell.groupBy(F.col("src").alias("s")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    plan = targets(ranked_sources(grouped), weights, share, most).select(
        "s", F.col("n").alias("source_size"), "target", rate.alias("rate"), offset(F.col("s"), seed).alias("offset"), "docs"
    )
    by_size = cell.groupBy("src", "size").agg(F.count("*").alias("n"))
    by_cell = cell.groupBy("src", "size", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over
    w_size = W.partitionBy("src").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    w_cell = W.partitionBy("src", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    w_row = W.partitionBy("src", "size", "cell").orderBy("tie")
    told = ["source_size", "target", "rate", "offset", "docs"]
    below = by_size.select("src", F.col("size").alias("b"), F.coalesce(before(w_size), F.lit(0)).alias("below"))
    first = below.join(plan, F.col("src").eqNullSafe(F.col("s"))).select(F.col("src").alias("a"), "b", "below", *told)
    inner = by_cell.select("src", "size", "cell", F.coalesce(before(w_cell), F.lit(0)).alias("inside"))
    start = inner.join(first, F.col("src").eqNullSafe(F.col("a")) & (F.col("size") == F.col("b"))).select(
        F.col("src").alias("a"), F.col("size").alias("b"), F.col("cell").alias("c"), (F.col("below") + F.col("inside")).alias("start"), *told
    )
    out = cell.withColumn("k", F.row_number().over(w_row)).join(
        start, F.col("src").eqNullSafe(F.col("a")) & (F.col("size") == F.col("b")) & (F.col("cell") == F.col("c"))
    )
    rank = F.col("start") + F.col("k")
    place = F.when(rank % 2 == 1, F.expr("(start + k + 1) div 2")).otherwise(F.col("docs") + 1 - F.expr("(start + k) div 2"))
    end = F.floor(place * F.col("rate") + F.col("offset"))
    begin = F.floor((place - 1) * F.col("rate") + F.col("offset"))
    return (
        out.withColumn("copies", (end - begin).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row.*", *added[:3], "copies", "taken")
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it was taken."""
    times = F.sequence(F.lit(1), F.col("copies"))
    return mixed.where("copies > 0").withColumn(fresh("copy", mixed.columns), F.explode(times)).select(*columns)
