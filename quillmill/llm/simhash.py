"""SimHash near-duplicates with pivot distance tables.

Fingerprints link when at most ``MAX_BITS`` of 64 bits differ; documents link
through chains of them.

Search, on distinct fingerprints only:

1. Blocking without loss: cut into ``MAX_BITS + spare`` blocks of bits, two
   fingerprints within the limit agree on at least ``spare`` whole blocks, so
   each is entered under every choice of ``spare`` blocks. The number of blocks
   follows the number of fingerprints, so blocks keep a few members.
2. A block of over ``TILE`` members, as texts of one template make it, is
   entered again under blocks of its remaining bits: its members differ in at
   most ``MAX_BITS`` of those if they link, so the same holds again. That is
   done, up to ``FINER`` times, where it leaves fewer pairs to look at. A block
   of near copies, which agree on most bits, stays; it is cut into tiles, and
   every pair of tiles is a task of its own: exact, with bounded memory at any
   size, and nearly all its pairs are links.
3. The pivot table holds the Hamming distances of every fingerprint to
   ``N_PIVOTS`` reference fingerprints. It is computed once and travels with
   them. By the triangle inequality a pair with a coordinate difference over the
   limit can't link. Members are sorted by the first coordinate, so only a band
   is looked at; the other coordinates discard most of it; survivors are
   verified.
4. A task returns a spanning forest of its links, not its pairs: the
   components are the same, and a block of m members yields at most m - 1 rows.

Components of up to ``FEW_EDGES`` edges come from one task; of more, from
alternating large-star and small-star steps on that forest, each step cut by a
table in the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and link as
any other; a null doc_id is never the smallest unless its whole component has
null ids only (component_id null); repeated rows keep their own rows; an empty
table gives an empty result; extra columns are carried by ``with_components``,
but for those named as its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import LOWER, carried, fresh, join_spread, materialise, small_batches

MAX_BITS = 3
N_PIVOTS = 24
TILE = 4096
#: How often large blocks are entered under more bits.
FINER = 3
#: Edges whose components one task finds, with about 100 bytes each.
FEW_EDGES = 1 << 20
#: Rounds of the distributed components, which need about log2 of the longest chain.
ROUNDS = 200
SHINGLE = 3
SEED = 42
#: What holds over one in this many rows is hot; at most this many fingerprints or blocks can.
HOT_SHARE = 1024


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text over its word shingles, repeats included."""
    import xxhash

    ws = text.translate(LOWER).split()
    n = len(ws)
    if not n:
        return 0
    joined = b" ".join(ws)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(joined[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)],
        np.uint64,
        n - width + 1,
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = 2 * ones > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """The documents, without the text, with their fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, out)]
    src = carried(docs, keep, text)
    schema = docs.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"") for t in b.column(0).to_pylist()]
            col = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], col], names=[*keep, out])

    return src.mapInArrow(run, schema)


def pivots(n: int = N_PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints: random ones, the same on every worker."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (columns) to the references (rows)."""
    return np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int8)


class Forest:
    """Union-find over places in an array."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def flat(self) -> np.ndarray:
        """The root of every place."""
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        self.up = up.tolist()
        return up

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked_pairs(
    left: np.ndarray, tl: np.ndarray, right: np.ndarray | None, tr: np.ndarray | None, limit: int = MAX_BITS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in left, j in right) of the pairs within the limit, in chunks.

    ``tl`` and ``tr`` are their pivot tables. Without ``right``, the pairs inside
    ``left``, each once.
    """
    same = right is None
    right, tr = (left, tl) if same else (right, tr)
    order = np.argsort(tr[0], kind="stable")
    sorted_first, tr_sorted, right_sorted = tr[0][order], tr[:, order], right[order]
    by_first = np.argsort(tl[0], kind="stable")
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = by_first[at : at + step]
        lo = np.searchsorted(sorted_first, tl[0][rows[0]] - limit, "left")
        hi = np.searchsorted(sorted_first, tl[0][rows[-1]] + limit, "right")
        if hi <= lo:
            continue
        # discard by coordinate difference: two pivots on the band, the others on what is left
        ok = np.abs(tl[0][rows][:, None] - tr_sorted[0, lo:hi][None, :]) <= limit
        if len(tl) > 1:
            ok &= np.abs(tl[1][rows][:, None] - tr_sorted[1, lo:hi][None, :]) <= limit
        i, j = np.nonzero(ok)
        i, j = rows[i], j + lo
        if same:
            later = order[j] > i
            i, j = i[later], j[later]
        for p in range(2, len(tl)):
            if not len(i):
                break
            near = np.abs(tl[p][i] - tr_sorted[p][j]) <= limit
            i, j = i[near], j[near]
        good = np.bitwise_count(left[i] ^ right_sorted[j]) <= limit
        if good.any():
            yield i[good], order[j[good]]


def forest_edges(
    left: np.ndarray, tl: np.ndarray, right: np.ndarray | None, tr: np.ndarray | None, limit: int = MAX_BITS
) -> list[tuple[int, int]]:
    """A spanning forest of the links, as pairs of fingerprints."""
    both = left if right is None else np.concatenate([left, right])
    uf, out, shift = Forest(len(both)), [], 0 if right is None else len(left)
    for i, j in linked_pairs(left, tl, right, tr, limit):
        # in a dense block nearly all pairs are of places that are joined already
        j = j + shift
        up = uf.flat()
        new = up[i] != up[j]
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            if uf.join(a, b):
                out.append((a, b))
    return [(int(both[a]), int(both[b])) for a, b in out]


def block_plan(n: int, limit: int = MAX_BITS) -> list[int]:
    """Bit masks under which a fingerprint is entered: two within the limit share one at least.

    ``limit + spare`` blocks, any ``spare`` of them: 16 key bits for up to a
    million fingerprints, then 25, 32 and 37.
    """
    spare = 1 if n <= 1 << 20 else 2 if n <= 1 << 27 else 3 if n <= 1 << 34 else 4
    k = limit + spare
    cuts = [round(64 * i / k) for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, spare)]


def finer(mask: int, limit: int = MAX_BITS) -> list[int]:
    """The masks that take over from one: two fingerprints within the limit that agree on it agree on one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(len(free) * i / (limit + 1)) for i in range(limit + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_distances(fps: DataFrame, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Adds ``pd``: a byte for the distance of ``fp`` to each pivot."""
    refs, names = pivots(n_pivots), fps.columns
    at = names.index("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = np.ascontiguousarray(pivot_table(own, refs).T)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in rows], pa.binary())], names=[*names, "pd"])

    return fps.mapInArrow(run, fps.withColumn("pd", F.lit(b"")).schema)


def _entries(fps: DataFrame, masks: Column) -> DataFrame:
    """The fingerprints under each of their masks."""
    under = fps.withColumn("mask", F.explode(masks))
    return under.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "pd")


def _split(entries: DataFrame, big: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The entries of big blocks (mask, key, m), with m, and all others."""
    hot, by = F.col("m") > total / HOT_SHARE, ["mask", "key"]
    rest = entries.join(F.broadcast(big.where(hot).select(*by)), by, "left_anti").join(big.where(~hot).select(*by), by, "left_anti")
    return join_spread(entries, big, by, hot), rest


def links(fps: DataFrame, n: int, limit: int = MAX_BITS, tile: int = TILE, times: int = FINER) -> DataFrame:
    """Edges (a, b) of n distinct fingerprints (fp, pd) that connect what links."""
    masks = block_plan(n, limit)
    entries = _entries(fps, F.array(*[F.lit(_signed(m)) for m in masks]))
    total = n * len(masks)
    tiled = []
    for k in range(times + 1):
        # blocks over a tile are few: each holds over `tile` of the entries
        counts = entries.groupBy("mask", "key").agg(F.count("*").alias("m")).where(F.col("m") > tile)
        big = materialise(counts, "simhash-big")
        if big.isEmpty():
            break
        large, rest = _split(entries, big, total)
        if k == times:
            tiled.append(large)
            entries = rest
            break
        to = fps.sparkSession.createDataFrame([(_signed(m), [_signed(x) for x in finer(m, limit)]) for m in masks], "mask long, more array<long>")
        under = large.join(F.broadcast(to), "mask").withColumn("sub", F.explode("more"))
        size = under.groupBy("mask", "key", "m", "sub", F.col("fp").bitwiseAND(F.col("sub"))).agg(F.count("*").alias("c"))
        pairs = size.groupBy("mask", "key", "m").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        judged = materialise(pairs.select("mask", "key", "m", (2 * F.col("pairs") < F.col("m") * F.col("m")).alias("splits")), "simhash-judged")
        large, entries = _split(entries, judged, total)
        tiled.append(large.where("not splits"))
        again = large.where("splits").join(F.broadcast(to), "mask").select("fp", "pd", "more")
        entries = entries.unionByName(_entries(again, F.col("more")))
        masks = sorted({m for old in masks for m in finer(old, limit)} | set(masks))
    none = F.lit(0)
    cell = entries.select("mask", "key", none.alias("lo"), none.alias("hi"), none.alias("mine"), "fp", "pd")
    for large in tiled:
        groups = F.expr(f"cast(ceil(m / {tile}) as int)")
        mine = F.pmod(F.xxhash64("fp"), groups).cast("int")
        spread = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
        cell = cell.unionByName(
            spread.select("mask", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp", "pd")
        )
    parts = max(12, ceil(total / 250_000))
    dealt = cell.repartition(parts, "mask", "key", "lo", "hi").sortWithinPartitions("mask", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        near: list[np.ndarray] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:6]]))
            near.append(np.frombuffer(b"".join(b.column(6).to_pylist()), np.int8).reshape(b.num_rows, -1).T)
            rows += b.num_rows
            if rows >= 1 << 16:
                block, table = np.concatenate(held, axis=1), np.concatenate(near, axis=1)
                # the last cell may go on in the next batch
                change = np.flatnonzero(np.any(block[:4, 1:] != block[:4, :-1], axis=0))
                cut = int(change[-1]) + 1 if len(change) else 0
                yield from _edge_batch(block[:, :cut], table[:, :cut], limit)
                held, near, rows = [block[:, cut:]], [table[:, cut:]], block.shape[1] - cut
        if held:
            yield from _edge_batch(np.concatenate(held, axis=1), np.concatenate(near, axis=1), limit)

    return dealt.mapInArrow(run, "a long, b long")


def _edge_batch(cells: np.ndarray, table: np.ndarray, limit: int, small: int = 48) -> Iterator[pa.RecordBatch]:
    """Edges of whole cells, given as sorted columns mask, key, lo, hi, mine, fp, and their pivot table.

    Small cells go together, compared at growing distance in the sorted rows;
    larger ones go one by one.
    """
    n = cells.shape[1]
    if not n:
        return
    start = np.concatenate([[0], np.flatnonzero(np.any(cells[:4, 1:] != cells[:4, :-1], axis=0)) + 1, [n]])
    sizes = np.diff(start)
    fps = np.ascontiguousarray(cells[5]).view(np.uint64)
    plain = (cells[2] == cells[3])[start[:-1]]
    edges: list[tuple[int, int]] = []
    few = (sizes >= 2) & (sizes <= small) & plain
    if few.any():
        rows = np.flatnonzero(np.repeat(few, sizes))
        cell = np.repeat(np.arange(len(sizes)), sizes)[rows]
        part, near = fps[rows], table[:, rows]
        uf = Forest(len(part))
        for lag in range(1, int(sizes[few].max())):
            i = np.flatnonzero(cell[lag:] == cell[:-lag])
            for p in range(len(near)):
                if not len(i):
                    break
                i = i[np.abs(near[p][i] - near[p][i + lag]) <= limit]
            i = i[np.bitwise_count(part[i] ^ part[i + lag]) <= limit]
            edges += [(int(part[x]), int(part[x + lag])) for x in i.tolist() if uf.join(x, x + lag)]
    for k in np.flatnonzero((sizes >= 2) & ~few):
        at = slice(start[k], start[k + 1])
        own, near = fps[at], table[:, at]
        if plain[k]:
            edges += forest_edges(own, near, None, None, limit)
        else:
            one, two = cells[4, at] == cells[2, start[k]], cells[4, at] == cells[3, start[k]]
            edges += forest_edges(own[one], near[:, one], own[two], near[:, two], limit)
    if edges:
        e = np.array(edges, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (lo == hi).all():
            return nodes, nodes[up]
        np.minimum.at(up, hi, lo)
        while (up[up] != up).any():
            up = up[up]


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node on an edge; the root is the smallest node reachable.

    Over ``few`` edges, alternates large-star and small-star steps until a round changes nothing.
    Each step links a node's neighbours to the smallest of them, so no step
    makes more edges than it got, whatever the degree.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = near.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    cur = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "cc")
    if cur.count() <= few:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
            if held:
                found = roots(*[np.concatenate(c) for c in zip(*held, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["node", "root"])

        return cur.coalesce(1).mapInArrow(run, "node long, root long")
    mark = None
    for _ in range(ROUNDS):
        cur = materialise(star(star(cur, True), False), "cc")
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def with_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_BITS, n_pivots: int = N_PIVOTS, tile: int = TILE
) -> DataFrame:
    """The documents, without the text, with ``fp`` and ``component_id``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("fp", "component_id") and c not in (doc_id, text)])
    marked = materialise(fingerprints(docs, text), "simhash-fp")
    distinct = marked.groupBy("fp").agg(F.min(doc_id).alias("low"), F.count("*").alias("n"))
    classes = materialise(with_distances(distinct, n_pivots), "simhash-classes")
    size = classes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not size["k"]:
        return marked.withColumn("component_id", F.col(doc_id))
    comp = components(links(classes.select("fp", "pd"), size["k"], limit, tile))
    rooted = classes.join(comp, classes["fp"] == comp["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    n = fresh("n", marked.columns)
    labels = rooted.select("fp", F.col("n").alias(n), "root").join(low, "root").select("fp", n, "component_id")
    labels = materialise(labels, "simhash-labels")
    met = join_spread(marked, labels, ["fp"], F.col(n) > max(1000, ceil(size["n"] / HOT_SHARE)))
    return met.select(*marked.columns, "component_id")


def hexadecimal(fp) -> object:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Exact repeats of that id are told apart by a row number fixed before the search.
    """
    cols = docs.columns
    row = fresh("row", cols)
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    found = with_components(numbered.select(doc_id, text, row), doc_id, text)
    # one key a component; the aggregate combines before its shuffle, so hot components stay small
    keep = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_f")).agg(
        F.min_by(row, F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(row))).alias(row)
    )
    return numbered.join(keep.select(row), row, "left_semi").select(*cols)
