"""Language-model scoring with a log-frequency Bloom filter.

An n-gram (n = 1, 2) of the training texts with quantised count level q enters
the filter q times, as (n-gram, 1) to (n-gram, q); levels are logarithmic. A
lookup probes level 1, 2, ... until one is missing. A level stands for the mean
count of the n-grams on it, so the expected counts sum to the true total. From
them

    p1(w)   = (c(w) - D) / N            D V / N for a word never seen
    p(w|v)  = (c(v w) + M p1(w)) / (c(v) + M)

with D from the counts of counts. The prior strength M depends on the level of
c(v); it is the one of ``PRIORS`` that makes all training texts most probable
when each of their bigrams is left out of the counts in turn. Those likelihoods
are sums over the levels that occur together, so they take one pass over what
the filter said, and ``fit_and_score`` asks it once. A bigram is only probed if both its words are in the filter, which keeps false
positives down.

Counting is distributed: partial counts of hashed n-grams are packed by segment
(the leading hash bits), each segment is summed and made into its part of the
filter in one task. The filter holds ``BITS`` per entry, however many there are.
Up to ``MAX_BYTES`` its bits are broadcast. A larger one stays a table: chunks
of texts ask parts of it for their distinct n-grams, and the levels come back to
the chunk in a second join; both ways give the same scores.

The base score is exact: the counts of the most frequent words (at most
``HEAD``) are broadcast, long ones under a digest, all other words of a text meet
theirs in a join. Those words are rare by construction, so the join has no hot
key.

Defined results: a null, empty or blank text is the end token alone; a null
doc_id counts as training; repeated rows each count and are each scored;
without training rows N and V are 0, every base term is log10(1 / 1) and every
score 0; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import by_bytes, in_bulk, materialise, small_batches, split_words

HEAD = 1 << 17
#: Bytes of a word from which on the head holds its digest.
HEAD_WORD = 64
#: The largest filter that is broadcast.
MAX_BYTES = 128 << 20
BITS = 8
PROBES = 5
BASE = 1.5
#: Prior strengths to choose from.
PRIORS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1e3, 3e3, 1e4, 1e5, 1e6)
#: Distinct words that a worker counts before it passes them on.
KEPT = 300_000
#: log2 of the n-grams whose levels a task remembers, by their order; eight bytes each.
SEEN_BITS = {1: 17, 2: 20}
#: The share of n-grams, still found, below which a lookup drops the others.
DENSE = 0.75
#: N-grams that a worker sums before it passes them on.
CHUNK = 1 << 21
SEGMENT_BYTES = 16 << 20
#: Bytes of text whose words one task joins with their counts.
JOIN_BYTES = 128 << 20
#: How the counts of unigrams, which are of the whole corpus, and of bigrams, which are of a chunk, are packed.
PACKED = {1: "<u8", 2: "<u4"}
#: Tokens of the texts that ask a filter in a table together, and log2 of the segments that answer together.
ASKING = 1 << 19
PART_BITS = 2
END = b""
_U = np.uint64
#: What a segment keeps of a key: six bytes.
_KEPT_BITS = _U((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def unigram_key(h: np.ndarray) -> np.ndarray:
    return mix(h + _U(0x9E3779B97F4A7C15))


def bigram_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9FB21C651E98DF25) + (b ^ (b >> _U(29))))


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log of the count)."""
    return 1 + np.floor(np.log(counts.astype(np.float64)) / log(BASE) + 1e-9).astype(np.int64)


def sequence(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts end to end, each followed by the end token: numbers of its tokens in a list of distinct ones, and each text's end.

    The end token is number 0 and stands before the first text too.
    """
    flat, sizes = split_words(texts)
    coded = flat.dictionary_encode()
    ends = np.cumsum(sizes + 1)
    out = np.zeros(1 + len(flat) + len(sizes), np.int64)
    words = np.ones(len(out), bool)
    words[0] = words[ends] = False
    out[words] = coded.indices.to_numpy().astype(np.int64) + 1
    return out, [END, *_listed(coded.dictionary)], ends


def _listed(words: pa.Array) -> list[bytes]:
    """The words as Python's; ten times as fast as ``to_pylist``."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _probe(keys: np.ndarray, lvl: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the probes for (n-gram, level), modulo 2^32 as their type is."""
    g = mix(keys + _U(0xA0761D6478BD642F * lvl % (1 << 64)))
    return g.astype(np.uint32), (g >> _U(32)).astype(np.uint32) | np.uint32(1)


@dataclass
class Filter:
    """The log-frequency Bloom filter: segments of bits, end to end."""

    data: np.ndarray
    start: np.ndarray  # first bit of each segment
    bits: np.ndarray  # bits of each segment
    shift: int
    top: int  # the highest level that any n-gram has
    first: int = 0  # number of the first segment

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is not in the filter; fastest if they are sorted, as they meet a segment together."""
        out = np.zeros(len(keys), np.int64)
        seg = (keys >> _U(self.shift)).astype(np.int64) - self.first
        alive, low, start, bits = np.arange(len(keys)), keys & _KEPT_BITS, self.start[seg], self.bits[seg]
        for lvl in range(1, self.top + 1):
            a, d = _probe(low, lvl)
            found = np.ones(len(alive), np.uint8)
            for i in range(1, PROBES + 1):
                at = a * bits
                at >>= _U(32)
                at += start
                bit = at.astype(np.uint8) & np.uint8(7)
                at >>= _U(3)
                found &= self.data.take(at.view(np.int64)) >> bit
                left = np.count_nonzero(found)
                # those not found go once they are many
                if left < len(found) * (1 if i == PROBES else DENSE):
                    hit = np.flatnonzero(found)
                    alive, low, start, bits, a, d = (x.take(hit) for x in (alive, low, start, bits, a, d))
                    found = np.ones(left, np.uint8)
                a += d
            if not len(alive):
                break
            out[alive] = lvl
        return out


def join_segments(segments: Iterable[tuple[int, bytes]], n: int, shift: int, top: int, first: int = 0) -> Filter:
    """The filter of (number, bits) of segments; of n segments from the first, those not given are empty."""
    start, bits, chunks, at = np.zeros(n, np.uint64), np.full(n, 8, np.uint64), [np.zeros(1, np.uint8)], 8
    for seg, raw in segments:
        data = np.frombuffer(raw, np.uint8)
        start[seg - first], bits[seg - first] = at, len(data) * 8
        chunks.append(data)
        at += len(data) * 8
    return Filter(np.concatenate(chunks), start, bits, shift, top, first)


class Answers:
    """Levels of the n-grams that a chunk of texts has asked for."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.found = keys[order], levels[order].astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        if (self.keys[at] != keys).any():
            raise KeyError("an n-gram was not asked for")
        return self.found[at]


def build_segment(keys: np.ndarray, levels: np.ndarray, most_bytes: int | None) -> np.ndarray:
    """The bytes of a segment that holds these n-grams at these levels."""
    events = int(levels.sum())
    size = ceil(events * BITS / 8)
    size = max(8, size if most_bytes is None else min(most_bytes, size))
    data = np.zeros(size * 8, bool)
    bits = _U(size * 8)
    for lvl in range(1, int(levels.max(initial=0)) + 1):
        a, d = _probe(keys[levels >= lvl], lvl)
        for _ in range(PROBES):
            data[((a * bits) >> _U(32)).astype(np.int64)] = True
            a += d
    return np.packbits(data, bitorder="little")


@dataclass
class Model:
    filter: Filter | Answers | None  # none while the segments are a table
    n: int
    v: int
    discount: float
    mean1: np.ndarray  # mean count of the words on each level
    mean2: np.ndarray  # the same for bigrams
    head: dict[bytes, int]
    long: dict[bytes, int]  # long words of the head, by digest
    top: int  # the highest level that any n-gram has
    shift: int
    prior: np.ndarray  # prior strength by the level of the first word
    segments: DataFrame | None = None  # (seg, bits) of a filter that is too large to broadcast
    text_bytes: int = 0  # of all texts it was counted with
    shared: Broadcast | None = None  # this model, sent once; what looks up needs no priors

    @property
    def unit(self) -> float:
        return float(self.n + self.v + 1)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words with these expected counts."""
        return np.where(counts > 0, np.maximum(counts - self.discount, 0.05), self.discount * self.v) / self.n

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts for levels of (first word, second word, bigram), as arrays to broadcast."""
        every = np.arange(self.top + 1)
        one, two = _mean(self.mean1, every), _mean(self.mean2, every)
        first, second = one[:, None, None], one[None, :, None]
        return first, second, np.minimum(two[None, None, :], np.minimum(first, second))

    def log10(self) -> np.ndarray:
        """log10 p for levels of (first word, second word, bigram)."""
        if not self.n:
            return np.zeros([self.top + 1] * 3)
        c1, c, c2 = self.expected()
        prior, p1 = self.prior[:, None, None], self.unigram(c)
        p = np.where(c1 > 0, (c2 + prior * p1) / (c1 + prior), p1)
        return np.log10(np.minimum(p, 1.0))


def _vocabulary(train: DataFrame) -> DataFrame:
    """(token, n) of the training words, and of the end token as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in in_bulk(batches, 0):
            seen = split_words(b.column(0))[0].value_counts()
            held += [pa.table([seen.field(0), seen.field(1)], names=["token", "n"]), pa.table({"token": pa.array([END], pa.binary()), "n": [b.num_rows]})]
            size += len(seen)
            if size > 2 * KEPT:
                held = [summed(held)]
                size = held[0].num_rows
                if size > KEPT:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    def summed(tables: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(tables).group_by("token").aggregate([("n", "sum")])
        return pa.table([got.column("token"), got.column("n_sum")], names=["token", "n"])

    parts = train.select("t").mapInArrow(run, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def _segments_of(keys: np.ndarray, counts: np.ndarray, order: int, shift: int) -> pa.RecordBatch:
    """Sorted keys and counts as one row per segment; six bytes a key, as its segment is known."""
    seg = (keys >> _U(shift)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(seg)) + 1, [len(seg)]])
    low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    big = counts.astype(PACKED[order])
    where = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    cols = [
        pa.array(seg[cut[:-1]]),
        pa.array(np.full(len(where), order, np.int32)),
        pa.array([low[a:b].tobytes() for a, b in where], pa.binary()),
        pa.array([big[a:b].tobytes() for a, b in where], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["seg", "ord", "keys", "counts"])


_PARTS = "seg long, ord int, keys binary, counts binary"


def _bigram_parts(train: DataFrame, shift: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return _segments_of(keys, n, 2, shift)

        for b in in_bulk(batches, 0):
            seq, words, _ = sequence(b.column(0))
            h = word_hash(words)[seq]
            held.append(bigram_key(h[:-1], h[1:]))
            rows += len(h) - 1
            if rows >= CHUNK:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return train.select("t").mapInArrow(run, _PARTS)


def _unigram_parts(vocab: DataFrame, shift: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = unigram_key(word_hash(_listed(b.column(0))))
                order = np.argsort(keys)
                yield _segments_of(keys[order], b.column(1).to_numpy()[order], 1, shift)

    return vocab.select("token", "n").mapInArrow(run, _PARTS)


def _build(parts: DataFrame, n_segments: int, tasks: int, max_bytes: int | None) -> DataFrame:
    """One row per segment: its bits, and per order and level the n-grams and their counts."""
    most = None if max_bytes is None else max(8, max_bytes // n_segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(seg: int, blobs: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            every, levels, stats = [], [], []
            for order in (1, 2):
                raw = b"".join(k for o, k, _ in blobs if o == order)
                if not raw:
                    continue
                wide = np.zeros((len(raw) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
                low = wide.view("<u8").ravel()
                c = np.frombuffer(b"".join(c for o, _, c in blobs if o == order), PACKED[order]).astype(np.int64)
                keys, at = np.unique(low, return_inverse=True)
                total = np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64)
                lvl = level(total)
                num, summed = np.bincount(lvl), np.bincount(lvl, weights=total)
                stats += [(order, i, int(num[i]), int(summed[i])) for i in np.flatnonzero(num)]
                every.append(keys)
                levels.append(lvl)
            bits = build_segment(np.concatenate(every), np.concatenate(levels), most)
            o, i, n, s = zip(*stats, strict=True)
            cols = [
                pa.array([seg], pa.int64()), pa.array([bits.tobytes()], pa.binary()),
                *[pa.array([list(a)], pa.list_(pa.int64())) for a in (o, i, n, s)],
            ]
            return pa.RecordBatch.from_arrays(cols, names=["seg", "bits", "ord", "level", "num", "total"])

        now, held = None, []
        for b in batches:
            for seg, order, keys, counts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if seg != now and held:
                    yield close(now, held)
                    held = []
                now = seg
                held.append((order, keys, counts))
        if held:
            yield close(now, held)

    dealt = parts.repartition(tasks, "seg").sortWithinPartitions("seg")
    return dealt.mapInArrow(run, "seg long, bits binary, ord array<long>, level array<long>, num array<long>, total array<long>")


def fit(docs: DataFrame, train: Column, text: str = "text", **how) -> tuple[Model, DataFrame]:
    """The model of the training rows, and the exact vocabulary (token, n); ``how`` is as of ``count``."""
    model, vocab = count(docs, train, text, **how)
    rows = docs.where(train)
    _choose_priors(model, _looked(rows, F.lit(False), model, text, None))
    return model, vocab


def fit_and_score(docs: DataFrame, held: Column, text: str = "text", doc_id: str = "doc_id", **how) -> tuple[Model, DataFrame]:
    """The model of the rows that aren't held out, and the scores of all, as ``fit`` and ``score`` give them."""
    model, vocab = count(docs, ~held, text, **how)
    looked = materialise(_looked(docs, held, model, text, doc_id), "lm-looked")
    _choose_priors(model, looked.where("not held_out"))
    return model, _scores(looked, model, vocab)


def count(
    docs: DataFrame, train: Column, text: str = "text", max_bytes: int | None = None, head: int = HEAD, broadcast_bytes: int = MAX_BYTES
) -> tuple[Model, DataFrame]:
    """The counts of the training rows: a model without chosen priors, and the exact vocabulary.

    A caller can bound the filter by ``max_bytes``, at the price of false positives.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(train).select(F.col(text).cast("binary").alias("t"))
    vocab = materialise(_vocabulary(rows), "lm-vocabulary")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_segments = max(256, 1 << max(0, ceil(size / SEGMENT_BYTES) - 1).bit_length())
    shift = 64 - (n_segments.bit_length() - 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / (4 * SEGMENT_BYTES)))
    # at most a few hundred rows: log-scaled counts
    bucket = F.floor(F.log2("n") * 8).cast("int")
    hist = vocab.groupBy(bucket.alias("b")).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")
    ).collect()
    n, v = sum(r["n"] for r in hist), sum(r["k"] for r in hist)
    n1, n2 = sum(r["n1"] for r in hist), sum(r["n2"] for r in hist)
    room, low = head, None
    for r in sorted(hist, key=lambda r: -r["b"]):
        room -= r["k"]
        if room < 0:
            break
        low = r["b"]
    is_long = F.octet_length("token") > HEAD_WORD
    name = F.when(is_long, F.unhex(F.md5("token"))).otherwise(F.col("token"))
    # at most `head` words of HEAD_WORD bytes
    top = vocab.where(bucket >= low).select(name.alias("name"), is_long.alias("long"), "n").collect() if low is not None else []
    short, long = ({bytes(r["name"]): r["n"] for r in top if r["long"] == is_} for is_ in (False, True))
    parts = _bigram_parts(rows, shift).unionByName(_unigram_parts(vocab, shift))
    built = materialise(_build(parts, n_segments, tasks, max_bytes), "lm-segments")
    stats: Counter = Counter()
    each = built.select(F.explode(F.arrays_zip("ord", "level", "num", "total")).alias("s")).groupBy("s.ord", "s.level")
    for o, i, num, total in each.agg(F.sum("s.num"), F.sum("s.total")).collect():  # a row for each order and level
        stats[o, i, 0], stats[o, i, 1] = num, total
    highest = max([i for _, i, _ in stats], default=0)
    kept = built.select("seg", "bits")
    segments, found = kept, None
    if (built.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= broadcast_bytes:
        rows_of = kept.toLocalIterator(prefetchPartitions=False)  # broadcast_bytes of them at most
        segments, found = None, join_segments(((r["seg"], bytes(r["bits"])) for r in rows_of), n_segments, shift, highest)
    means = []
    for o in (1, 2):
        most = max([i for k, i, _ in stats if k == o], default=0)
        # a level that no n-gram has, reached by a false positive, stands for its lowest count
        means.append(np.array([0.0] + [stats[o, i, 1] / stats[o, i, 0] if stats[o, i, 0] else BASE ** (i - 1) for i in range(1, most + 40)]))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    prior = np.full(highest + 1, PRIORS[-1])
    model = Model(found, n, v, discount, means[0], means[1], short, long, highest, shift, prior, segments, size)
    return model, vocab


def _choose_priors(model: Model, looked: DataFrame) -> None:
    """Sets each level's prior strength by leave-one-out likelihood on the training texts, as looked up."""
    if not model.n:
        return
    size = model.top + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size**3, np.int64)
        for b in batches:
            code = _codes(b.column(0), b.column(1), size)
            seen += np.bincount(code, minlength=size**3)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["code", "n"])

    sums = looked.select("l1", "l2").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n"))
    times = np.zeros(size**3)
    for code, k in sums.collect():  # a row for each three levels that occur
        times[code] = k
    times = times.reshape(size, size, size)
    c1, c, c2 = model.expected()
    p1 = model.unigram(np.maximum(c - 1, 0))
    c1 = np.maximum(c1 - 1, 0)
    c2 = np.minimum(np.maximum(c2 - 1, 0), c1)
    table = np.stack([(times * np.log10((c2 + m * p1) / (c1 + m))).sum(axis=(1, 2)) for m in PRIORS], axis=1)
    for lvl in range(1, size):
        # a level that no text has takes what the level below it has
        model.prior[lvl] = PRIORS[int(table[lvl].argmax())] if table[lvl].any() else model.prior[lvl - 1]


def _codes(l1: pa.Array, l2: pa.Array, size: int) -> np.ndarray:
    """(first word, second word, bigram) levels of every place of the texts, as numbers to the base ``size``."""
    one = np.frombuffer(b"".join(l1.to_pylist()), np.uint8).astype(np.int64)
    two = np.frombuffer(b"".join(l2.to_pylist()), np.uint8)
    # every text ends with the end token, which is before the next one's first
    return (np.roll(one, 1) * size + one) * size + two


class Seen:
    """Levels of n-grams as the filter gave them; each n-gram has one place, where the last one asked stays.

    A place holds the bits of the n-gram that do not tell its place, and the level below them.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.mask = _U(bits), _U((1 << bits) - 1)
        self.held = np.full(1 << bits, ~_U(0))  # no n-gram: what remains of one has 64 - bits bits, fewer than 56

    def levels(self, keys: np.ndarray, source: Filter | Answers) -> np.ndarray:
        got = self.held.take((keys & self.mask).view(np.int64))
        out = (got & _U(255)).astype(np.uint8)
        new = np.flatnonzero((got >> _U(8)) != (keys >> self.bits))
        own, at = np.unique(keys[new], return_inverse=True)
        lvl = source.levels(own)
        self.held[(own & self.mask).view(np.int64)] = ((own >> self.bits) << _U(8)) | lvl.astype(np.uint64)
        out[new] = lvl.astype(np.uint8)[at]
        return out


class Scorer:
    """Looks texts up in a model's filter; remembers what it said about n-grams."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.seen = {order: Seen(bits) for order, bits in SEEN_BITS.items()}

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, levels (0 if not in the filter) and exact counts (-1 if not of the head) of distinct words."""
        h = word_hash(words)
        exact = np.fromiter(map(self.m.head.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > HEAD_WORD).tolist():
            exact[i] = self.m.long.get(hashlib.md5(words[i]).digest(), -1)
        return h, self.seen[1].levels(unigram_key(h), self.m.filter), exact

    def bigrams(self, h: np.ndarray, l1: np.ndarray) -> np.ndarray:
        """Levels of the bigrams of a sequence of words, by their hashes and levels; 0 if one of the words is not in the filter."""
        both = np.flatnonzero((l1[:-1] > 0) & (l1[1:] > 0))
        out = np.zeros(len(h) - 1, np.uint8)
        out[both] = self.seen[2].levels(bigram_key(h[:-1][both], h[1:][both]), self.m.filter)
        return out

    def rows(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """What the (row, doc_id, held_out, t) of a batch come to: ``LOOKED``."""
        seq, words, ends = sequence(b.column(3))
        h, l1, exact = self.words(words)
        l1, exact = l1[seq], exact[seq[1:]]
        l2 = self.bigrams(h[seq], l1)
        cut = np.concatenate([[0], ends])
        sizes = np.diff(cut)
        own = exact >= 0
        base = np.where(own, np.log10((np.maximum(exact, 0) + 1) / self.m.unit), 0.0)
        # the other words of each text, by its number
        text = np.repeat(np.arange(len(sizes)), sizes)[~own]
        tail, times = np.unique(text * len(words) + seq[1:][~own], return_counts=True)
        of = np.searchsorted(tail, np.arange(len(sizes) + 1) * len(words))
        cols = [
            pa.array(sizes), pa.array(np.add.reduceat(own, cut[:-1], dtype=np.int64)), pa.array(np.add.reduceat(base, cut[:-1])),
            pa.ListArray.from_arrays(of.astype(np.int32), pa.array(words, pa.binary()).take(pa.array(tail % len(words)))),
            pa.ListArray.from_arrays(of.astype(np.int32), pa.array(times)),
            *[pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(x.tobytes())]) for x in (l1[1:], l2)],
        ]
        return pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "words", "times", "l1", "l2"])


def _mean(means: np.ndarray, lvl: np.ndarray) -> np.ndarray:
    return means[np.minimum(lvl, len(means) - 1)]


#: What a text comes to.
LOOKED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, words array<binary>, times array<long>, l1 binary, l2 binary"


def _looked(docs: DataFrame, held: Column, model: Model, text: str, doc_id: str | None) -> DataFrame:
    """The rows as ``LOOKED``: levels of every word and bigram, counts of head words, and the other words."""
    small_batches(docs.sparkSession)
    own = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    src = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"), held.alias("held_out"), F.col(text).cast("binary").alias("t"))
    if model.shared is None:
        model.shared = src.sparkSession.sparkContext.broadcast(replace(model, segments=None))
    if model.segments is not None:
        return _look_up_by_join(src, model)
    shared = model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in in_bulk(batches, 3):
            yield s.rows(b)

    return src.mapInArrow(run, LOOKED)


def _look_up_by_join(src: DataFrame, model: Model) -> DataFrame:
    """The same for (row, doc_id, held_out, t) with segments in a table: chunks of texts ask for their n-grams, parts of the filter answer."""
    segments, shared = model.segments, model.shared
    shift, top = model.shift, model.top

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            sizes = np.concatenate([split_words(part.column(3))[1] + 1 for part in by_bytes(b, 3)] or [np.zeros(0, np.int64)])
            before = seen + np.cumsum(sizes) - sizes
            seen += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + before // ASKING)], names=[*b.schema.names, "chunk"])

    # chunks are numbered once: both sides of the join read the same ones
    texts = materialise(src.mapInArrow(number, "row long, doc_id long, held_out boolean, t binary, chunk long"), "lm-chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(held))
            part = (keys >> _U(shift + PART_BITS)).astype(np.int64)
            where = _runs(part)
            cols = [
                pa.array([int(part[a]) for a, _ in where], pa.int64()), pa.array([now] * len(where), pa.int64()),
                pa.array([None] * len(where), pa.int64()), pa.array([keys[a:z].tobytes() for a, z in where], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "seg", "data"])

        for b in batches:
            chunk = b.column(0).to_numpy()
            for a, z in _runs(chunk):
                if held and chunk[a] != now:
                    yield from close()
                    held = []
                now = int(chunk[a])
                for part in by_bytes(b.slice(a, z - a), 1):
                    seq, words, _ = sequence(part.column(1))
                    h = word_hash(words)
                    row = h[seq]
                    held.append(np.unique(np.concatenate([unigram_key(h), bigram_key(row[:-1], row[1:])])))
        if held:
            yield from close()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, found = None, [], None
        for b in batches:
            out = []
            for part, chunk, seg, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part != now:
                    now, bits, found = part, [], None
                if seg is not None:  # a part's segments come before what asks it
                    bits.append((seg, data))
                    continue
                if found is None:
                    found = join_segments(bits, 1 << PART_BITS, shift, top, part << PART_BITS)
                out.append((chunk, data, found.levels(np.frombuffer(data, np.uint64)).astype(np.uint8).tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk", "keys", "levels"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, now, got = Scorer(replace(shared.value)), None, []
        for b in batches:
            chunk, is_text = b.column(4).to_numpy(), b.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, z in _runs(chunk * 2 + is_text):
                if chunk[a] != now:
                    now, got = chunk[a], []
                    s.m.filter = None
                part = b.slice(a, z - a)
                if not is_text[a]:  # a chunk's answers come before its texts
                    got += zip(part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True)
                    continue
                if s.m.filter is None:
                    s.m.filter = Answers(np.frombuffer(b"".join(k for k, _ in got), np.uint64), np.frombuffer(b"".join(v for _, v in got), np.uint8))
                for few in by_bytes(part, 3):
                    yield s.rows(few)

    asks = texts.select("chunk", "t").mapInArrow(ask, "part long, chunk long, seg long, data binary")
    parts = segments.select(F.shiftright("seg", PART_BITS).alias("part"), F.lit(None).cast("long").alias("chunk"), "seg", F.col("bits").alias("data"))
    tasks = segments.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tasks = max(int(tasks), ceil((1 << (64 - shift)) / (1 << PART_BITS) / 4))
    # nulls come first
    dealt = asks.unionByName(parts).repartition(tasks, "part").sortWithinPartitions("part", "chunk")
    answers = dealt.mapInArrow(answer, "chunk long, keys binary, levels binary")
    none = F.lit(None)
    meet = texts.select("*", F.lit(True).alias("is_text"), none.cast("binary").alias("keys"), none.cast("binary").alias("levels")).unionByName(
        answers.withColumn("is_text", F.lit(False)), allowMissingColumns=True
    )
    return meet.repartition(tasks, "chunk").sortWithinPartitions("chunk", "is_text").mapInArrow(look, LOOKED)


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    if not len(a):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def score(docs: DataFrame, held: Column, model: Model, vocab: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The contract's row for each document."""
    return _scores(materialise(_looked(docs, held, model, text, doc_id), "lm-looked"), model, vocab)


def _scores(looked: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    table, size = model.log10(), model.top + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.ravel()
        for b in batches:
            n = b.column(3).to_numpy()
            code = _codes(b.column(6), b.column(7), size)
            sums = np.add.reduceat(logs[code], np.cumsum(n) - n) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(sums, pa.float64())], names=[*b.schema.names[:6], "score"])

    scored = looked.drop("words", "times").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, score double")
    rare = looked.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("token"), F.col("p.times").alias("tf"))
    tasks = max(int(looked.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(model.text_bytes / JOIN_BYTES))
    met = rare.repartition(tasks, "token").join(vocab.repartition(tasks, "token"), "token", "left")
    term = F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(model.unit))
    sums = met.groupBy("row").agg(F.sum(term).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rest_known"))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
