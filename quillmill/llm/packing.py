"""Best-two-fit packing of token sequences.

Documents longer than a sequence are cut into full pieces; only the first
piece may be shorter. A bin is filled greedily, each time with the largest
piece that fits its gap. If a gap is left, the bin's smallest piece is taken
out again and two unpacked pieces that fill the wider gap more tightly take its
place, for as long as that gains.

Pieces are dealt round-robin into groups, one for each ``GROUP_BYTES`` of text,
and each group is packed by itself: every group but for its last bins is as
tight as one packing of all, and no task holds more than a group. Lengths are
few, so a packing works on counts by length. The task that packs a group puts
its sequences together, so ids are shuffled once, and written once, packed.

Defined results: a null or empty text is its end id alone, a piece of length
1; repeated rows are packed one by one; an empty table gives no pieces and no
sequences; other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import in_bulk, small_batches
from quillmill.llm.tokens import encoder, forget

CAPACITY = 2048
#: Text of the pieces that one task packs; thousands of sequences, and at most a token a byte.
GROUP_BYTES = 64 << 20
PIECE = "doc_id long, piece int, start long, length long, ids binary"
#: Ids of a sequence are little-endian unsigned integers, as those of its pieces.
SEQUENCE = "sequence_id long, ids binary, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<long>"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: the rest first, then full ones."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned integers of 16 bits, or 32 if the vocabulary needs them."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaced), np.array([end_id], "<u4").tobytes()
        wide = enc.width if end_id < 1 << 16 else 4
        for b in in_bulk(batches, 1):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                own, at = np.frombuffer(ids + end, "<u4"), 0
                raw = own.astype(f"<u{wide}").tobytes()
                for k, n in enumerate(cut(len(own), capacity)):
                    rows.append((doc, k, at, n, raw[wide * at : wide * (at + n)]))
                    at += n
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids"])

    return src.mapInArrow(run, PIECE)


def ids_of(raw: bytes, length: int) -> np.ndarray:
    """The ids in the bytes of a sequence or a piece of so many tokens."""
    return np.frombuffer(raw, f"<u{len(raw) // length}")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are from 1 to the capacity."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2), "left")
    left = np.diff(ends).tolist()  # pieces of each length that aren't packed
    mask = sum(1 << n for n, c in enumerate(left) if c)
    bins: list[list[int]] = []

    def take(n: int) -> None:
        nonlocal mask
        left[n] -= 1
        if not left[n]:
            mask &= ~(1 << n)

    while mask:
        held, gap = [], capacity
        while gap:
            fits = mask & ((2 << gap) - 1)
            if fits:
                n = fits.bit_length() - 1
                take(n)
                held.append(n)
                gap -= n
                continue
            least = min(held)
            pair = _tightest_pair(mask, left, least + gap, least)
            if not pair:
                break
            held.remove(least)
            for n in pair:
                take(n)
            held += pair
            left[least] += 1
            mask |= 1 << least
            gap += least - sum(pair)
        bins.append(held)
    free = ends[:-1].tolist()
    out, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, held in enumerate(bins):
        at = 0
        for n in held:
            row = order[free[n]]
            free[n] += 1
            out[row], offset[row] = k, at
            at += n
    return out, offset


def _tightest_pair(mask: int, left: list[int], room: int, least: int) -> list[int]:
    """The two unpacked lengths with the largest sum up to ``room``, if it is over ``least``."""
    best, found = least, []
    tops = mask & ((1 << room) - 1)
    while tops:
        a = tops.bit_length() - 1
        if 2 * a <= best:
            break
        tops ^= 1 << a
        below = mask & ((2 << min(room - a, a)) - 1)
        if below >> a & 1 and left[a] < 2:
            below ^= 1 << a
        if below and a + (b := below.bit_length() - 1) > best:
            best, found = a + b, [a, b]
            if best == room:
                break
    return found


def groups_of(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups the pieces of the documents are packed in."""
    return max(1, ceil((docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) / group_bytes))


def pack(parts: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """The sequences: their ids, and of each piece in them, in order, its document, number, start and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        forget()
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        bins, offset = best_two_fit(rows.column("length").to_numpy(), capacity)
        order = np.lexsort((offset, bins))
        bins = bins[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1, [len(bins)]])
        number = TaskContext.get().partitionId() << 32
        for at in range(0, len(first) - 1, 1000):
            ends = first[at : at + 1001]
            own = rows.take(pa.array(order[ends[0] : ends[-1]])).combine_chunks()
            place = ends - ends[0]
            ids = own.column("ids").combine_chunks()
            # the pieces' bytes are end to end already: a sequence is those between its first and its last
            joined = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :][place]
            place = pa.array(place.astype(np.int32))
            lists = [own.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length")]
            cols = [pa.array(bins[ends[:-1]] + number), pa.Array.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer(joined.copy()), ids.buffers()[2]])]
            cols += [pa.ListArray.from_arrays(place, c) for c in lists]
            yield pa.RecordBatch.from_arrays(cols, names=["sequence_id", "ids", "doc_ids", "pieces", "starts", "lengths"])

    return parts.repartition(groups).mapInArrow(run, SEQUENCE)


def digest(sequences: DataFrame) -> DataFrame:
    """One row per piece of the sequences: ``PLACED``, the crc32 from the ids that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = b"".join(b.column(1).to_pylist())
            docs, number, start, length = (b.column(k).flatten() for k in range(2, 6))
            sizes = length.to_numpy()
            end = np.cumsum(sizes)
            at = end - sizes
            view = memoryview(np.frombuffer(raw, f"<u{len(raw) // int(end[-1])}").astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at.tolist(), end.tolist(), strict=True)]
            places = b.column(5).offsets.to_numpy()
            per = np.diff(places)
            tokens = np.diff(np.concatenate([[0], end])[places - places[0]])
            cols = [
                docs, number, start, length, pa.array(crc, pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(), per)),
                pa.array(at - np.repeat(np.cumsum(tokens) - tokens, per)),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=placed)

    placed = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
    return sequences.mapInArrow(run, PLACED)
