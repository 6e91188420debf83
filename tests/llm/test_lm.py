import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import lm
from quillmill.llm.common import LOWER, held_out, in_bulk, split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*WORD.findall(low), None]


def run(df, **kw):
    held = held_out(F.col("doc_id"), 7, 2)
    model, vocab = lm.fit(df, ~held, **kw)
    return model, lm.score(df, held, model, vocab).collect()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    words = [f"W{i}é" for i in range(3000)]
    p = 1 / np.arange(1, 3001)
    out = [(i, " ".join(rng.choice(words, 80, p=p / p.sum()))) for i in range(200)]
    return [*out, (900, None), (901, ""), (902, " \n"), (903, "x" * 50_000), (903, "x" * 50_000), (None, "W1é w2É")]


def test_words_of_any_bytes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"aB \t\n\x0b\x0c\r\x1c\x1f\x00\x85\xa0\xff\xc3\xa9Z"), rng.integers(0, 30)).tolist()) for _ in range(3000)] + [None, b"", b"  "]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or b"").translate(LOWER)) for t in texts]
    for at in (0, 17):
        words, sizes = split_words(pa.array(texts, pa.binary()).slice(at))
        assert words.to_pylist() == [w for ws in want[at:] for w in ws] and sizes.tolist() == [len(ws) for ws in want[at:]]
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])
    parts = list(in_bulk([whole.slice(0, 5), whole.slice(5, 0), whole.slice(5)], 0, 999))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == texts and max(p.num_rows for p in parts) < 30


def test_base_score_and_counts_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [toks(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    for head in (lm.HEAD, 4):
        model, got = run(df, head=head)
        assert (model.n, model.v) == (n, v) and len(model.head) <= head
        assert len(got) == len(rows)
        want = Counter()
        for d, t in rows:
            ws = toks(t)
            want[d, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score <= 0 for r in got)


def plain_scores(rows, model):
    """Every score from dictionaries of the training counts; the filter is asked one n-gram at a time."""
    train = [[b"", *[(w or "").encode() for w in toks(t)]] for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    one = Counter(w for seq in train for w in seq[1:])
    two = Counter(p for seq in train for p in zip(seq, seq[1:], strict=False))

    def quantised(counts, keys):
        q = {k: 1 + math.floor(math.log(n) / math.log(1.5) + 1e-9) for k, n in counts.items()}
        total, num = Counter(), Counter()
        for k, n in counts.items():
            total[q[k]] += n
            num[q[k]] += 1
        asked = model.filter.levels(keys)
        return asked, {lvl: total[lvl] / num[lvl] for lvl in num}

    words = sorted({(w or "").encode() for _, t in rows for w in toks(t)})
    level1, mean1 = quantised(one, lm.unigram_key(lm.word_hash(words)))
    level1 = dict(zip(words, level1.tolist(), strict=True))
    pairs = sorted({p for _, t in rows for seq in [[b"", *[(w or "").encode() for w in toks(t)]]] for p in zip(seq, seq[1:], strict=False)})
    level2, mean2 = quantised(two, lm.bigram_key(lm.word_hash([a for a, _ in pairs]), lm.word_hash([b for _, b in pairs])))
    level2 = dict(zip(pairs, level2.tolist(), strict=True))
    n, v = sum(one.values()), len(one)
    n1, n2 = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d = n1 / (n1 + 2 * n2)

    def mean(means, lvl):
        return 0.0 if not lvl else means.get(lvl, 1.5 ** (lvl - 1))

    def p1(c):
        return (max(c - d, 0.05) if c > 0 else d * v) / n

    def expected(a, b):
        c1, c = mean(mean1, level1[a]), mean(mean1, level1[b])
        c2 = mean(mean2, level2[a, b]) if level1[a] and level1[b] else 0.0
        return c1, c, min(c2, c1, c)

    def prob(a, b, prior):
        c1, c, c2 = expected(a, b)
        return min(1.0, (c2 + prior[level1[a]] * p1(c)) / (c1 + prior[level1[a]]) if c1 > 0 else p1(c))

    def left_out(lvl, m):
        total = 0.0
        for seq in train:
            for a, b in zip(seq, seq[1:], strict=False):
                if level1[a] == lvl:
                    c1, c, c2 = expected(a, b)
                    c1 = max(c1 - 1, 0)
                    total += math.log10((min(max(c2 - 1, 0), c1) + m * p1(max(c - 1, 0))) / (c1 + m))
        return total

    used = {level1[a] for seq in train for a in seq[:-1]}
    best = {lvl: [left_out(lvl, m) for m in lm.PRIORS] for lvl in used}
    scores = Counter()
    for doc, t in rows:
        seq = [b"", *[(w or "").encode() for w in toks(t)]]
        scores[doc, round(sum(math.log10(prob(a, b, model.prior)) for a, b in zip(seq, seq[1:], strict=False)), 6)] += 1
    return best, scores


def test_scores_and_priors_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, got = lm.fit_and_score(df, held_out(F.col("doc_id"), 7, 2))
    best, want = plain_scores(rows, model)
    for lvl, sums in best.items():
        assert sums[lm.PRIORS.index(model.prior[lvl])] == pytest.approx(max(sums), rel=1e-9)
    assert Counter((r.doc_id, round(r.score, 6)) for r in got.collect()) == want


def test_fitting_and_scoring_at_once_is_fit_and_score(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, apart = run(df)
    once, both = lm.fit_and_score(df, held_out(F.col("doc_id"), 7, 2))
    assert (once.prior == model.prior).all()
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart))


def test_counts_over_32_bits_and_long_words(spark):
    many = spark.createDataFrame([(b"w", (1 << 32) + 5)], "token binary, n long")
    built = lm._build(lm._unigram_parts(many, 56), 256, 2, None).first()
    assert built.total == [(1 << 32) + 5]
    long = "http" + "x" * 200
    rows = [(i, f"{long} a{i}") for i in range(50)]
    model, got = run(spark.createDataFrame(rows, "doc_id long, text string"), head=8)
    assert len(model.long) == 1 and len(model.head) <= 8
    assert {r.n_known for r in got if not r.held_out} == {3} and {r.n_known for r in got if r.held_out} == {2}


def test_model_beats_the_base_on_held_out_text(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, got = run(df)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_never_undercounts_and_rarely_overcounts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = held_out(F.col("doc_id"), 7, 2)
    model, _ = lm.fit(df, ~held)
    grams = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            seq = [b"", *[(w or "").encode() for w in toks(t)]]
            grams.update(zip(seq, seq[1:], strict=False))
    keys = lm.bigram_key(lm.word_hash([g[0] for g in grams]), lm.word_hash([g[1] for g in grams]))
    want, got = lm.level(np.array(list(grams.values()))), model.filter.levels(keys)
    assert (got >= want).all() and (got > want).mean() < 0.1
    unseen = lm.bigram_key(lm.word_hash([b"never%d" % i for i in range(20_000)]), lm.word_hash([b"w"] * 20_000))
    assert (model.filter.levels(unseen) > 0).mean() < 0.06


def test_a_small_filter_errs_more_but_holds_every_ngram(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, got = run(df, max_bytes=256 * 8)
    assert len(model.filter.data) <= 256 * 8 + 1 and len(got) == len(rows)
    known = lm.unigram_key(lm.word_hash([b"w1\xc3\xa9"]))
    assert (model.filter.levels(known) > 0).all()


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(empty)[1] == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(only, "a b")], "doc_id long, text string")
    (r,) = run(df)[1]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) == (3, 0, 0, 0.0, 0.0, True)


def test_a_filter_too_large_to_broadcast_is_joined_and_loses_nothing(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    broadcast, want = run(df)
    monkeypatch.setattr(lm, "ASKING", 500)
    joined, got = run(df, broadcast_bytes=256 * 8)
    assert joined.filter is None and joined.segments is not None
    # the whole filter, at BITS an entry, and not the bound's share of it
    bits = joined.segments.agg(F.sum(F.octet_length("bits"))).first()[0]
    assert bits == len(broadcast.filter.data) - 1 > 256 * 8
    assert (joined.prior == broadcast.prior).all()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert run(spark.createDataFrame([], "doc_id long, text string"), broadcast_bytes=-1)[1] == []


def test_bits_an_entry_do_not_fall_as_entries_grow():
    keys = lm.mix(np.arange(1 << 20, dtype=np.uint64))
    for n in (1 << 12, 1 << 20):
        assert len(lm.build_segment(keys[:n], np.ones(n, np.int64), None)) == n * lm.BITS // 8


def test_counts_on_a_level_differ_by_half_at_most_and_false_positives_stay_rare():
    counts = np.arange(1, 100_000)
    lvl = lm.level(counts)
    first = np.flatnonzero(np.diff(lvl, prepend=0))
    last = np.append(first[1:], len(counts)) - 1
    assert (counts[last] / counts[first] <= 1.5 + 1e-9).all()
    keys = lm.mix(np.arange(1 << 18, dtype=np.uint64))
    bits = lm.build_segment(keys[: 1 << 17], np.ones(1 << 17, np.int64), None)
    found = lm.join_segments([(0, bits.tobytes())], 1, 63, 1).levels(keys[1 << 17 :] >> np.uint64(1))
    assert (found > 0).mean() < 0.0225


def test_the_filter_is_asked_once_for_each_ngram(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = run(df)
    texts = [t.encode() for _, t in rows if t] * 4
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(texts, pa.binary())], names=["row", "doc_id", "held_out", "t"]
    )
    asked, levels = [], lm.Filter.levels
    monkeypatch.setattr(lm.Filter, "levels", lambda self, keys: asked.append(len(keys)) or levels(self, keys))
    scorer = lm.Scorer(model)
    got = scorer.rows(batch)
    seqs = [[b"", *[(w or "").encode() for w in toks(t.decode())]] for t in texts]
    distinct = len({w for s in seqs for w in s}) + len({p for s in seqs for p in zip(s, s[1:], strict=False)})
    assert sum(asked) <= distinct
    first = sum(asked)
    assert scorer.rows(batch).equals(got) and sum(asked) - first < 0.2 * distinct
    # what it said is what it says of each place; a bigram needs both its words
    one = {w: int(levels(model.filter, lm.unigram_key(lm.word_hash([w])))[0]) for w in {w for s in seqs for w in s}}
    assert got.column(8).to_pylist() == [bytes(one[w] for w in s[1:]) for s in seqs]
    for s, two in zip(seqs, got.column(9).to_pylist(), strict=True):
        h, known = lm.word_hash(s), np.array([one[w] > 0 for w in s])
        assert two == (levels(model.filter, lm.bigram_key(h[:-1], h[1:])) * (known[:-1] & known[1:])).astype(np.uint8).tobytes()


def test_remembered_levels_of_ngrams_that_share_a_place():
    keys = np.unique(np.concatenate([lm.mix(np.arange(5000, dtype=np.uint64)), np.array([0, 1, 511, 512, 2**64 - 1], np.uint64)]))
    level = {int(k): i % 109 for i, k in enumerate(keys)}

    class Source:
        def levels(self, asked):
            assert len(np.unique(asked)) == len(asked)
            return np.array([level[int(k)] for k in asked], np.int64)

    rng, seen = np.random.default_rng(0), lm.Seen(9)
    for n in (0, 1, 20, 3000, 3000):
        some = rng.choice(keys, n)
        assert seen.levels(some, Source()).tolist() == [level[int(k)] for k in some]
    assert seen.levels(keys, Source()).tolist() == list(level.values())
