"""Nearest neighbours by inner product with a forest of random-projection trees.

Vectors are given one more component that makes their lengths equal (queries
get zero), which turns largest inner product into nearest direction. Trees
split at the median along the difference of two sample vectors; they are fitted
on a bounded sample (``SAMPLE`` vectors), and every vector is routed to its
leaf in every tree. A query walks all trees through one priority queue, always
the most promising branch next, until the leaves it has taken hold its budget
of candidates; leaf sizes are known from counting the whole index. Candidates
are then scored exactly, on the original vectors.

Equal vectors are one entry with their smallest ids: more than ``k + 1`` equal
ones can't be told apart by any result. Leaves are dealt to groups of at most
about ``INDEX_BYTES``; a leaf over that is split over several. A task holds one
group of leaves at a time, the queries that ask it stream past, and each query's
best few go on, so neither pairs nor a hot leaf pile up and the index travels
once. Products are computed by the block; whatever could be among the best
within rounding is then summed exactly, so ties go to smaller ids.

The budget is a share of the index, so a query's work grows with it, and the
work of all queries with its square: that is what recall 0.9 takes on vectors
without structure (``share`` can be far smaller on others).

Defined results: vectors that are null, zero, of another size than most, or
hold a null or non-finite component take no part, nor do rows without an id;
rows repeated with the same id and vector count once; with fewer candidates
than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import fraction_hash, materialise

TREES = 4
#: Bounds on the vectors that the trees are fitted on.
SAMPLE = 1 << 16
SAMPLE_BYTES = 64 << 20
LEAVES = (256, 8192)
#: Rows of the index that a leaf should hold, while the sample allows it.
LEAF_ROWS = 200
#: Candidates of a query, as a share of the index, counted once per tree.
SHARE = 1.1
SALTS = 32
#: Groups of leaves at least, and the vectors' bytes in one.
GROUPS = 12
INDEX_BYTES = 32 << 20
#: Products computed at once, and candidates kept before they are reduced.
BLOCK = 1 << 22
HELD = 1 << 21


@dataclass
class Tree:
    """A heap-shaped tree: children of node i are 2i + 1 and 2i + 2; leaves are the last level."""

    normals: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return int(len(self.cuts) + 1).bit_length() - 1


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Median splits down to 2^depth leaves; a node without two distinct vectors splits at random."""
    n = (1 << depth) - 1
    normals, cuts = np.zeros((n, x.shape[1])), np.zeros(n)
    held = {0: np.arange(len(x))}
    for i in range(n):
        rows = held.pop(i, np.zeros(0, np.int64))
        v = np.zeros(x.shape[1])
        if len(rows) >= 2:
            a, b = rng.choice(len(rows), 2, replace=False)
            v = x[rows[a]] - x[rows[b]]
        size = np.linalg.norm(v)
        v = v / size if size > 1e-12 else _unit(rng.normal(size=x.shape[1]))
        p = x[rows] @ v
        normals[i], cuts[i] = v, np.median(p) if len(rows) else 0.0
        held[2 * i + 1], held[2 * i + 2] = rows[p <= cuts[i]], rows[p > cuts[i]]
    return Tree(normals, cuts)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


@dataclass
class Forest:
    trees: list[Tree]
    longest: float

    @property
    def leaves(self) -> int:
        return 1 << self.trees[0].depth

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1) / max(self.longest, 1e-300)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers (rows x trees), counted over all trees."""
        y, out = self.lift(x), []
        for t, tree in enumerate(self.trees):
            at = np.zeros(len(y), np.int64)
            for _ in range(tree.depth):
                right = np.einsum("ij,ij->i", y, tree.normals[at]) > tree.cuts[at]
                at = 2 * at + 1 + right
            out.append(at - (self.leaves - 1) + t * self.leaves)
        return np.stack(out, axis=1)

    def search(self, q: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
        """Leaves in order of promise, until they hold the budget."""
        y = np.append(q / max(np.linalg.norm(q), 1e-300), 0.0)
        sides = [(t.normals @ y - t.cuts).tolist() for t in self.trees]
        inner, per = self.leaves - 1, self.leaves
        heap, got, taken = [(0.0, t, 0) for t in range(len(self.trees))], 0.0, []
        while heap and got < budget:
            cost, t, i = heapq.heappop(heap)
            side = sides[t]
            while i < inner:
                m = side[i]
                near, far = (2 * i + 2, 2 * i + 1) if m > 0 else (2 * i + 1, 2 * i + 2)
                heapq.heappush(heap, (cost + m * m, t, far))
                i = near
            leaf = i - inner + t * per
            if sizes[leaf]:
                taken.append(leaf)
                got += sizes[leaf]
        return taken


def valid(vector: Column, dim: int | None = None) -> Column:
    fine = vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )
    fine = fine & F.exists(vector, lambda x: x != 0)
    return fine & (F.size(vector) == dim) if dim is not None else fine


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, vec, ids): distinct vectors, their smallest id and their k + 1 smallest ids."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    w = W.partitionBy("vec", "_s").orderBy("id")
    few = salted.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_set("id")), 1, k + 1)
    return few.groupBy("vec").agg(ids.alias("ids")).select(F.col("ids")[0].alias("cid"), "vec", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column of equal lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1), np.float64) if len(column) else np.zeros((0, 0))


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
    sample: int = SAMPLE,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products found, nearest first.

    ``is_query`` is a condition on the table's columns.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.col(vector)
    dims = table.where(valid(v)).groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return empty
    part = table.where(F.col(id_col).isNotNull() & valid(v, dims["d"]))
    rows = part.select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    cls = materialise(classes(rows, k), "ann-classes")
    n, longest = cls.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return empty
    owners = rows.where("q").select("id", "vec").join(cls.select("vec", "cid"), "vec").select(F.col("id").alias("query_id"), "cid").distinct()
    owners = materialise(owners, "ann-queries")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in _matrix(b.column(1))], pa.binary())], names=["cid", "v"])

    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dims["d"])))
    picked = cls.where(fraction_hash(F.lit(seed), F.col("cid")) < F.lit(sample / max(n, sample))).select("cid", "vec")
    got = sorted((r["cid"], bytes(r["v"])) for r in picked.mapInArrow(packed, "cid long, v binary").toLocalIterator())
    x = np.frombuffer(b"".join(g[1] for g in got), np.float64).reshape(-1, dims["d"])
    leaves = max(LEAVES[0], min(LEAVES[1], n // LEAF_ROWS, max(1, len(x) // 8)))
    depth = max(1, min(leaves.bit_length() - 1, max(1, len(x)).bit_length() - 1))
    forest = Forest([], float(np.sqrt(longest)))
    lifted = forest.lift(x)
    forest.trees = [grow(lifted, depth, np.random.default_rng([seed, t])) for t in range(trees)]
    model = spark.sparkContext.broadcast(forest)

    def leaf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        total = np.zeros(len(f.trees) * f.leaves, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(f.route(_matrix(b.column(0))).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["leaf", "n"])

    counted = cls.select("vec").mapInArrow(leaf_counts, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    sizes = np.zeros(trees << depth, np.int64)
    for leaf, m in counted.collect():  # at most one row a leaf of the model
        sizes[leaf] = m
    # the number follows the index alone: each group returns a few rows for every query
    block = max(1, INDEX_BYTES // (8 * dims["d"]))
    groups = max(GROUPS, ceil(n * trees / block))
    first, split = np.random.default_rng(seed).integers(0, groups, len(sizes)), np.maximum(1, -(-sizes // block))
    heavy = np.flatnonzero(split > 1)
    first[heavy] = groups + np.cumsum(split[heavy]) - split[heavy]  # each part of a heavy leaf is a group
    groups += int(split[heavy].sum())
    # k + 1 distinct candidates at least, however small the table: each is in every tree once
    budget = max(share * n, float(trees * (k + 1)))
    shared = spark.sparkContext.broadcast((sizes, first, split))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (_, group, parts) = model.value, shared.value
        for b in batches:
            if not b.num_rows:
                continue
            at = f.route(_matrix(b.column(0)))
            rows_of = np.repeat(np.arange(b.num_rows), at.shape[1])
            flat = at.ravel()
            lows = np.array([i[0] for i in b.column(1).to_pylist()], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((lows >> np.uint64(32))[rows_of] % parts[flat].astype(np.uint64)).astype(np.int64)
            cols = [pa.array(group[flat] + part), pa.array(flat), b.column(0).take(pa.array(rows_of)), b.column(1).take(pa.array(rows_of))]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "leaf", "vec", "ids"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (count, group, parts) = model.value, shared.value
        for b in batches:
            out: list[tuple] = []
            for row, (cid, q) in enumerate(zip(b.column(0).to_pylist(), _matrix(b.column(1)), strict=True)):
                by: dict[int, list[int]] = {}
                for leaf in f.search(q, count, budget):
                    for part in range(int(parts[leaf])):
                        by.setdefault(int(group[leaf]) + part, []).append(leaf)
                out += [(g, cid, row, ls) for g, ls in by.items()]
            if out:
                g, cid, row, ls = zip(*out, strict=True)
                cols = [pa.array(g, pa.int64()), pa.array(cid, pa.int64()), b.column(1).take(pa.array(row)), pa.array(ls, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "cid", "vec", "leaves"])

    idx = cls.select("vec", "ids").mapInArrow(index, "g long, leaf long, vec array<double>, ids array<long>")
    asked = cls.join(owners.select("cid").distinct(), "cid", "left_semi").select("cid", "vec")
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cid")
    ask = asked.mapInArrow(probes, "g long, cid long, vec array<double>, leaves array<long>")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            g, ask = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (ask[1:] != ask[:-1])) + 1, [len(g)]]).tolist()
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if x == y:
                    continue
                if g[x] != now:
                    now, held, ready = g[x], [], None
                part = b.slice(x, y - x)
                if not ask[x]:  # a group's leaves come before what asks them
                    held.append(part)
                    continue
                if ready is None:
                    ready = Group(pa.Table.from_batches(held)) if held else None
                    held = []
                if ready is not None:
                    yield ready.best(part, k)

    none = F.lit(None)
    both = idx.withColumns({"cid": none.cast("long"), "leaves": none.cast("array<long>")}).unionByName(ask, allowMissingColumns=True)
    dealt = both.select("g", "cid", "leaf", "vec", "ids", "leaves").repartition(groups, "g").sortWithinPartitions("g", "cid")  # nulls come first
    found = dealt.mapInArrow(rerank, "cid long, vec_id long, score double")
    best = found.groupBy("cid").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))
    own = owners.join(best, "cid").select("query_id", F.filter("best", lambda x: x["vec_id"] != F.col("query_id")).alias("best"))
    return own.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


class Group:
    """A group of leaves, ready for queries."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        self.c = _matrix(rows.column("vec").combine_chunks())
        self.ids = rows.column("ids").to_pylist()
        lows = np.array([i[0] for i in self.ids], np.int64)
        # the same vector comes from several trees: it has one number
        self.cls = np.unique(lows, return_inverse=True)[1]
        leaf = rows.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.rows_of = {int(leaf[r[0]]): r for r in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)}
        self.longest = float(np.sqrt((self.c * self.c).sum(axis=1).max()))

    def best(self, asks: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """Each query's k + 1 best ids of the leaves it asks for, scored exactly."""
        q, leaves = _matrix(asks.column(3)), asks.column(5).to_pylist()
        # twice what rounding can do to a product
        slack = np.sqrt((q * q).sum(axis=1)) * self.longest * (q.shape[1] + 2) * 2.0**-51
        by: dict[int, list[int]] = {}
        for i, ls in enumerate(leaves):
            for x in ls:
                by.setdefault(x, []).append(i)
        held, size = [], 0
        for x, who in by.items():
            rows = self.rows_of.get(x)
            if rows is None:
                continue
            step = max(1, BLOCK // len(rows))
            for at in range(0, len(who), step):
                qs = np.array(who[at : at + step])
                s = q[qs] @ self.c[rows].T
                if s.shape[1] > k + 1:
                    least = -np.partition(-s, k, axis=1)[:, k]
                    i, j = np.nonzero(s >= (least - slack[qs])[:, None])
                    held.append((qs[i], rows[j], s[i, j]))
                else:
                    held.append((np.repeat(qs, s.shape[1]), np.tile(rows, len(qs)), s.ravel()))
                size += len(held[-1][0])
                if size > HELD:
                    held = [self.reduce(q, held, slack, k)]
                    size = len(held[0][0])
        if not held:
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        qi, ci, s = self.reduce(q, held, slack, k)
        cids = asks.column(1).to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        start = np.concatenate([[0], np.flatnonzero(np.diff(qi)) + 1, [len(qi)]]).tolist() if len(qi) else [0]
        for a, b in zip(start[:-1], start[1:], strict=True):
            hits = sorted((-x, i) for x, r in zip(s[a:b].tolist(), ci[a:b].tolist(), strict=True) for i in self.ids[r])[: k + 1]
            out[0].extend([cids[qi[a]]] * len(hits))
            out[1].extend(i for _, i in hits)
            out[2].extend(-x for x, _ in hits)
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(out, kinds, strict=True)], names=["cid", "vec_id", "score"])

    def reduce(self, q: np.ndarray, held: list[tuple], slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact product) of each query's k + 1 best vectors, by exact product, then smallest id."""
        qi, ci, s = (np.concatenate(a) for a in zip(*held, strict=True))
        if not len(qi):
            return qi, ci, s
        pair = qi * (int(self.cls.max()) + 1) + self.cls[ci]
        one = np.unique(pair, return_index=True)[1]
        qi, ci, s = qi[one], ci[one], s[one]
        order = np.lexsort((-s, qi))
        qi, ci, s = qi[order], ci[order], s[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(qi)) + 1])
        size = np.diff(np.concatenate([start, [len(qi)]]))
        least = s[start + np.minimum(size - 1, k)]
        near = s >= np.repeat(least, size) - slack[qi]
        qi, ci = qi[near], ci[near]
        s = np.array([fsum(x) + 0.0 for at in range(0, len(qi), 1 << 14) for x in (q[qi[at : at + (1 << 14)]] * self.c[ci[at : at + (1 << 14)]]).tolist()])
        order = np.lexsort((self.cls[ci], -s, qi))
        qi, ci, s = qi[order], ci[order], s[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(qi)) + 1])
        size = np.diff(np.concatenate([start, [len(qi)]]))
        few = np.arange(len(qi)) - np.repeat(start, size) <= k
        return qi[few], ci[few], s[few]
