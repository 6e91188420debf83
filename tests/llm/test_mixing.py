import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing as M
from quillmill.llm.common import key_hash


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, lo, hi = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):  # the share of a unit of weight at which all is dealt out
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * weight[s]) for s in sizes) < total else (lo, mid)
    return {s: min(2 * sizes[s], hi * weight[s]) for s in sizes}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 50}, {"x": 5}, {"a": 0, "b": 0}, {chr(97 + i): (i * 7919) % 1000 + 1 for i in range(20)}])
def test_targets_match_a_search_for_the_share(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "s string, n long").repartition(5)
    ranked = M.ranked_sources(table)
    assert [r.s for r in ranked.orderBy("place").collect()] == sorted(sizes, key=lambda s: (s is None, s or ""))
    got, want = {r.s: r.target for r in M.targets(ranked).collect()}, brute_targets(sizes)
    for s in sizes:
        assert got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6)


def offset(source):
    name = b"\1" if source is None else b"s" + source.encode()
    return int.from_bytes(hashlib.sha256(name + b"17").digest()[:6], "big") / (1 << 48)


def docs(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, " ".join(["w"] * (i * 31 % 97))) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_takes_match_a_plain_prefix_sum(spark):
    df = docs(spark).withColumn("t", key_hash(F.col("doc_id")))
    got = {r.doc_id: r for r in M.mix(df).collect()}
    assert len(got) == 1500
    by = {}
    for r in got.values():
        by.setdefault(r.source, []).append(r)
    for src, rows in by.items():
        rows.sort(key=lambda r: (r.size, r.t % M.CELLS, r.t))
        up, down = rows[0::2], rows[1::2][::-1]
        rate, u = rows[0].target / rows[0].source_size, offset(src)
        for k, r in enumerate(up + down, 1):
            assert r.copies == math.floor(k * rate + u) - math.floor((k - 1) * rate + u)
            assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        assert sum(r.taken for r in rows) == pytest.approx(rows[0].target, rel=0.02)


def test_reruns_agree_and_emit_repeats(spark):
    df = docs(spark)
    a = {(r.doc_id, r.copies) for r in M.mix(df).collect()}
    b = {(r.doc_id, r.copies) for r in M.mix(df.repartition(7)).collect()}
    assert a == b
    out = M.emit(M.mix(df), df.columns)
    assert out.columns == df.columns and out.count() == sum(c for _, c in a)


def test_nulls_repeats_ties_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, None, 3), (1, "a", "x y", 3), (1, "a", "x y", 3), (None, "a", "", 3)], "doc_id long, source string, text string, size int")
    rows = M.mix(df).collect()
    assert len(rows) == 4 and sorted(r.size for r in rows) == [0, 0, 2, 2]
    odd = df.withColumns({"row": F.lit(1), "start": F.lit(2), "target": F.lit("t"), "k": F.lit(4), "s": F.lit(5)})
    assert M.emit(M.mix(odd.drop("target")), odd.drop("target", "size").columns).columns == odd.drop("target", "size").columns
    assert sorted(r.taken for r in M.mix(odd).collect()) == sorted(r.taken for r in rows)
    long = spark.createDataFrame([(1, "a", "word " * 400_000), (2, "a", "x"), (3, "b", "y z")], "doc_id long, source string, text string")
    assert {r.doc_id: r.size for r in M.mix(long).collect()} == {1: 400_000, 2: 1, 3: 2}
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
