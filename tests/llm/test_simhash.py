import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, limit=3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints_match_brute_force():
    texts = [None, "", " \n", "One", "one two", "One TWO three", "É à ü É à ü", "a b c d e f g " * 500, "x" * 10_000]
    for t in texts:
        assert S.fingerprint((t or "").encode()) == brute_fp(t), t


def clusters(n, seed=1):
    rnd, out = random.Random(seed), []
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 5, 40])):
            out.append(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 4])):
                base ^= 1 << rnd.randrange(64)
    return out[:n]


def test_pivots_lose_no_pair():
    fps = np.array(sorted(set(clusters(600))), np.uint64)
    refs = S.pivots()
    table = S.pivot_table(fps, refs)
    got = {tuple(sorted(p)) for i, j in S.linked_pairs(fps, table, None, None) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert got == want
    two = {tuple(p) for i, j in S.linked_pairs(fps[:200], table[:, :200], fps[200:], table[:, 200:]) for p in zip(i.tolist(), (j + 200).tolist(), strict=True)}
    assert two == {(i, j) for i, j in want if i < 200 <= j}


def test_blocks_lose_no_pair():
    rnd = random.Random(4)
    for n in (10, 1 << 21, 1 << 30, 1 << 40):
        masks = S.block_plan(n)
        for _ in range(300):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_finer_blocks_lose_no_pair():
    rnd = random.Random(5)
    for first in S.block_plan(10):
        masks = [first]
        for _ in range(S.FINER):
            x = rnd.getrandbits(64)
            mask = rnd.choice(masks)
            free = [i for i in range(64) if not mask >> i & 1]
            for _ in range(100):
                y = x
                for b in rnd.sample(free, 3):
                    y ^= 1 << b
                assert any(x & m == y & m for m in S.finer(mask))
            masks = S.finer(mask)


def _components(spark, fps, few=S.FEW_EDGES, **kw):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = S.with_distances(spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long"))
    edges = S.links(df, len(set(signed)), **kw)
    return {r.node: r.root for r in S.components(edges, few=few).collect()}, signed


def test_components_match_brute_force_with_small_and_tiled_blocks(spark):
    fps = clusters(500, seed=2) + [0x1234 ^ (1 << i) for i in range(40)] + [0x1234 ^ (3 << i) for i in range(40)]
    rnd = random.Random(6)
    fps += [0xABCD | rnd.getrandbits(24) << 16 for _ in range(60)]  # one template: a whole block and more agree
    roots = brute_roots(fps)
    for tile, times, few in ((16, 0, 0), (16, 3, 10**6), (4096, 3, 10**6)):
        comp, signed = _components(spark, fps, few, tile=tile, times=times)
        label = [comp.get(s, s) for s in signed]
        seen = {}
        for r, x in zip(roots, label, strict=True):
            assert seen.setdefault(r, x) == x
        assert len(set(seen.values())) == len(set(roots))


def test_a_dense_block_stays_and_its_pairs_are_joined_once(spark):
    rnd = random.Random(9)
    ball = {0x0F0F0F0F0F0F0F0F ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(700)}
    spread = {0x5555 | rnd.getrandbits(48) << 16 for _ in range(300)}
    fps = sorted(ball | spread)
    roots = brute_roots(fps)
    comp, signed = _components(spark, fps, tile=40, times=2)
    seen = {}
    for r, x in zip(roots, [comp.get(s, s) for s in signed], strict=True):
        assert seen.setdefault(r, x) == x
    assert len(set(seen.values())) == len(set(roots))


def test_one_task_and_stars_find_the_same_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a long, b long")
    few, many = ({r.node: r.root for r in S.components(df, few=k).collect()} for k in (10**6, 0))
    assert few == many and few[1059] == 1000


def test_whole_operator_on_hot_groups_nulls_and_repeats(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:i] + ["zz"] + base[i + 1 :])) for i in range(150)]
    rows += [(2000 + i, " ".join(f"u{rnd.randrange(9000)}" for _ in range(60))) for i in range(100)]
    rows += [(3000, None), (3001, ""), (3002, "one"), (3002, "one"), (None, "one"), (None, "lonely words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"FP": F.lit("clash"), "n": F.lit(1)})
    got = S.with_components(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_roots(fps)
    low = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            low[r] = min(d, low.get(r, d))
    want = sorted((str(d), fps[i], str(low.get(roots[i]))) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(5, "a b c d e", "x"), (3, "a b c d e", "y"), (3, "a b c d e", "y"), (9, "f g h i j k", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = S.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.with_components(empty).count() == 0
    assert S.one_of_each(empty).count() == 0
