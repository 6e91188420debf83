import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, is_query):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = sorted(good)
    x = np.array([v for _, v in good], np.float32).astype(float)
    out = {}
    for q, (i, _) in enumerate(good):
        if is_query(i):
            s = x @ x[q]
            best = sorted((-round(s[j], 12), good[j][0]) for j in range(len(good)) if good[j][0] != i)[:k]
            out[i] = best
    return out


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32) * rng.uniform(0.5, 3)], 1) for i in range(n)]
    same = rows[5][1]
    rows += [(10_000 + i, same, 2) for i in range(150)]
    rows += [(20_000, None, 0), (20_020, [0.0] * 8, 0), (20_040, [float("nan")] + [1.0] * 7, 0), (20_060, [None] + [1.0] * 7, 0), (20_080, [float("inf")] * 8, 0), (20_100, [1.0], 0), (None, [1.0] * 8, 0)]
    return [*rows, rows[20]]


def test_whole_search_is_exact(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, share=1e9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert [h[1] for h in hits] == [w[1] for w in want[q]]
        assert np.allclose([h[2] for h in hits], [-w[0] for w in want[q]], atol=1e-9)


def test_recall_of_the_default_budget(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 200 and hits / (200 * 20) >= 0.9


def test_ties_go_to_smaller_ids_at_the_cut(spark):
    """3,000 different vectors with the same inner product with the query; half of it again in one leaf of a small forest."""
    rng = np.random.default_rng(7)
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 0)]
    ids = rng.permutation(np.arange(1, 20_000)[np.arange(1, 20_000) % 20 != 0])[:3000]
    rows += [(int(i), [0.1, *map(float, rng.normal(size=3).astype(np.float32))], 0) for i in ids]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.search(df, F.col("vec_id") % 20 == 0, share=1e9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == sorted(ids.tolist())[:20]
    assert {r.score for r in got} == {float(np.float32(0.1))}


def test_split_leaves_and_reduced_candidates_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(data(), SCHEMA)
    want = sorted(map(repr, ann.search(df, F.col("vec_id") % 20 == 0, share=0.5).collect()))
    monkeypatch.setattr(ann, "INDEX_BYTES", 2048)  # 32 vectors a group
    assert sorted(map(repr, ann.search(df, F.col("vec_id") % 20 == 0, share=0.5).collect())) == want
    group = ann.Group(pa.table({"vec": [[float(i % 7), 1.0] for i in range(200)], "ids": [[i] for i in range(200)], "leaf": [i % 5 for i in range(200)]}))
    asks = pa.record_batch({"g": [0], "cid": [9], "leaf": [None], "vec": [[1.0, 0.0]], "ids": [None], "leaves": [[0, 1, 2, 3, 4]]})
    whole = group.best(asks, 20).to_pydict()
    monkeypatch.setattr(ann, "HELD", 1)
    assert group.best(asks, 20).to_pydict() == whole and whole["vec_id"] == [i for i in range(200) if i % 7 == 6][:21]


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [0.0, 2.0], 0), (3, [1.0, 1.0], 0)], SCHEMA)
    rows = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 0)], SCHEMA)
    assert ann.search(lone, F.col("vec_id") % 20 == 0).count() == 0
