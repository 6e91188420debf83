import hashlib

from pyspark.sql import functions as F

from quillmill.llm import sharding as S


def bits(key):
    return format(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16), "060b")


def brute(rows, limit):
    """Splits on one more bit while a bucket is too large."""
    out, todo = {}, [("", rows)]
    while todo:
        p, own = todo.pop()
        if sum(s for _, s in own) <= limit or len(p) == 60:
            if own:
                out[p] = sorted(k for k, _ in own)
            continue
        for b in "01":
            todo.append((p + b, [x for x in own if bits(x[0])[len(p)] == b]))
    return out


def test_matches_splitting_bit_by_bit(spark):
    texts = [(i, "x" * (i * 37 % 500)) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (600, 5_000, 10**9):
        out = S.assign(df, ["doc_id"], limit)
        got = {}
        for r in out.collect():
            got.setdefault(r.shard, []).append(r.doc_id)
        want = brute([(i, len(t) + 32) for i, t in texts], limit)
        assert {k: sorted(v) for k, v in got.items()} == {"s" + k: v for k, v in want.items()}
        sums = out.groupBy("shard").agg(F.sum("row_bytes").alias("b")).agg(F.max("b")).first()[0]
        assert sums <= limit


def test_rows_of_one_key_overflow_and_still_fit(spark):
    df = spark.range(900).select(F.when(F.col("id") < 500, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("y" * 68).alias("text"))
    out = S.assign(df, ["doc_id"], 2_000)
    assert out.count() == 900
    assert out.groupBy("shard").agg(F.sum("row_bytes").alias("b")).agg(F.max("b")).first()[0] <= 2_000
    # 50,000 bytes of one key in pages of up to 2,000: a page is full but for its last row
    assert out.where("doc_id = 7").select("shard").distinct().count() <= 28


def test_pages_follow_the_contents_not_the_splits(spark):
    rows = [(7, "t" * (i % 90), i % 3) for i in range(400)] + [(7, "w" * n, 0) for n in (900, 1500, 900, 990, 5000)] + [(i, "o", 1) for i in range(50)]
    named = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(n)
        out = S.assign(df, ["doc_id"], 1_000)
        named.append(sorted(map(repr, out.select("doc_id", "text", "k", "shard", "row_bytes").collect())))
        worst = out.groupBy("shard").agg(F.sum("row_bytes").alias("b"), F.count("*").alias("n")).where("b > 1000")
        assert {r.n for r in worst.collect()} == {1}  # a row over the limit is alone
    assert named[0] == named[1] and len(named[0]) == len(rows)


def test_a_directory_too_large_to_broadcast_gives_the_same_shards(spark):
    rows = [(i, "t" * (i % 200)) for i in range(3000)] + [(5, "again" * 20)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (sorted(map(repr, S.assign(df, ["doc_id"], 400, most_cells=k).collect())) for k in (10**6, 0))
    assert small == large and len(small) == len(rows)


def test_more_than_two_hundred_thousand_shards_with_a_repeated_id(spark):
    ids = F.when(F.col("id") < 10, 3).otherwise(F.col("id"))
    df = spark.range(260_000).select(ids.alias("doc_id"), F.lit(100).cast("long").alias("size"))
    out = S.assign(df, ["doc_id"], 150, size="size")
    n, most, rows = out.groupBy("shard").agg(F.sum("row_bytes").alias("b"), F.count("*").alias("n")).agg(F.count("*"), F.max("b"), F.sum("n")).first()
    assert rows == 260_000 and most <= 150 and n > 200_000


def test_nulls_long_rows_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "z" * 5000, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, depth int")
    out = S.assign(df, ["doc_id"], 100)
    assert out.count() == 4 and out.columns.count("depth") == 1
    assert {r.row_bytes for r in out.collect()} == {32, 5032}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.assign(empty, ["doc_id"], 100).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string")
    df = df.unionByName(spark.createDataFrame([(3, "s" * 90), (3, None)] * 20, "doc_id long, text string"))
    made = S.assign(df, ["doc_id"], 500)
    S.write_shards(made, str(tmp_path / "s"))
    back = S.read_shards(spark, str(tmp_path / "s"), made)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect())) and back.count() == 90
