"""Every operator and stage on one table of odd rows, and on an empty one."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann, language_id, lm, mixing, packing, quality, rule_ledger, sharding, simhash, stages, token_files
from quillmill.llm.common import held_out

DATA = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
NAMES = ["score", "lang_pred", "predicted", "size", "target", "taken", "copies", "source_size", "fp", "component_id", "shard", "depth", "row_bytes", "key_hash", "n_words", "kept", "_text", "_t", "_d", "_j", "row", "_row", "cell", "k", "n", "rank"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, bad UTF-8, blank and very long texts, repeated rows, and names that clash."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    rows = [(None, None, None, None, None), (-1, "", "en", "src0", 0), (-2, " \n\t ", None, None, 3), (-3, "plain words repeat", "en", "src1", 18)]
    rows += [(-3, "plain words repeat", "en", "src1", 18)] * 2 + [(None, "no id", "de", None, 5), (-4, "the word " * 500_000, "en", "src0", 4_500_000)]
    made = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    bad = spark.range(3).select(
        (F.col("id") - 10).alias("doc_id"), F.expr("cast(unhex('66FF6F20C3285BE2') as string)").alias("text"),
        F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(8).cast("long").alias("n_chars"),
    )
    return made.unionByName(bad).withColumns({n: F.lit(1) for n in NAMES}).repartition(3).cache()


def check(df, n=None):
    rows = df.collect()
    assert n is None or len(rows) == n
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    return rows


@pytest.mark.parametrize("empty", [False, True])
def test_operators(spark, odd, tmp_path, empty):
    docs = odd.where("false") if empty else odd
    n, odd_ids = docs.count(), [-10, -9, -8]
    held = held_out(F.col("doc_id"), 7, 2)
    model, words = lm.fit(docs, ~held)
    scores = check(lm.score(docs, held, model, words), n)
    assert all(math.isfinite(r.score) and r.score <= 0 and r.n_known <= r.n_tokens for r in scores)
    led = rule_ledger.apply_policy(rule_ledger.ledger(docs), rule_ledger.STANDARD)
    assert {r.n_words for r in check(led, n) if r.doc_id in odd_ids} in ({2}, set())
    check(rule_ledger.ablations(led, rule_ledger.STANDARD))
    token_files.write(docs, str(tmp_path / "ids"), "word_bpe_49k.json", 1, False)
    check(token_files.digest(spark, str(tmp_path / "ids")), n)
    placed = check(packing.digest(packing.pack(packing.pieces(docs, "byte_bpe_50k.json", 0, True), 2)))
    assert sum(r.length for r in placed if r.start == 0) <= sum(r.length for r in placed) and sum(r.piece == 0 for r in placed) == n
    labels = spark.createDataFrame([(-3, 1), (-3, 0), (-3, None), (None, 1), (-1, 0), (10**12, 1)], "doc_id long, quality int")
    judged = check(quality.predict(docs, quality.fit(docs, labels)), n)
    assert all(0 <= r.score <= 1 for r in judged)
    said = check(language_id.predict(docs, language_id.fit(docs)), n)
    assert all(r.lang_pred == "und" for r in said if r.doc_id in (-1, -2)) and all(r.lang_pred != "und" for r in said if r.doc_id in odd_ids)
    mixed = check(mixing.mix(docs), n)
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)
    shards = sharding.assign(docs, ["doc_id"], 5_000)
    sharding.write_shards(shards, str(tmp_path / "shards"))
    check(sharding.read_shards(spark, str(tmp_path / "shards"), shards), n)
    linked = check(simhash.with_components(docs), n)
    if not empty:
        assert {r.component_id for r in linked if r.doc_id in odd_ids} == {-10}
        assert {r.component_id for r in linked if r.doc_id == -3} == {-3}
    check(simhash.one_of_each(docs))


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, odd, empty):
    docs = odd.where("false") if empty else odd
    n = docs.count()
    for stage in (stages.identify_language, stages.classify_quality, stages.near_dedup):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and len(check(out)) <= n
        assert set(map(repr, out.collect())) <= set(map(repr, docs.collect()))
    assert {r.doc_id for r in stages.identify_language(spark, docs, DATA).where("doc_id < 0").collect()}.isdisjoint({-1, -2})
    mixed = stages.mix_sources(spark, docs, DATA)
    assert mixed.columns == docs.columns and set(map(repr, check(mixed))) <= set(map(repr, docs.collect()))
    packed = check(stages.pack(spark, docs, DATA))
    assert sum(r.pieces.count(0) for r in packed) == n and all(sum(r.lengths) <= 2048 and len(r.ids) == 2 * sum(r.lengths) for r in packed)
    one = sorted(x for r in packed for x in r.doc_ids if x is not None)
    assert set(one) == {r.doc_id for r in docs.collect() if r.doc_id is not None}


def test_texts_without_a_letter_are_und(spark):
    texts = ["½ ² ①", "12 _ 34", "٣ 五", "a", "é 1", "́", "日"]
    train = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(["the and that"] * 30 + ["und der die"] * 30)], "doc_id long, text string, lang string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r.lang_pred for r in language_id.predict(df, language_id.fit(train)).collect()}
    assert {t for t, p in got.items() if p == "und"} == {t for t in texts if not any(c.isalpha() for c in t)}


def test_ids_of_bad_utf8_and_long_texts(spark, odd):
    """Bytes that aren't UTF-8 are read with replacement characters, as everywhere."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: bytes(r.t or b"").decode("utf-8", "replace") for r in odd.select("doc_id", F.col("text").cast("binary").alias("t")).where("doc_id < 0").collect()}
    by = {}
    for r in packing.digest(packing.pack(packing.pieces(odd.where("doc_id < 0 and doc_id <> -3"), "byte_bpe_50k.json", 0, True), 1)).collect():
        by.setdefault(r.doc_id, []).append(r)
    for doc, rows in by.items():
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert sum(r.length for r in rows) == len(ids)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_vectors(spark):
    df = spark.createDataFrame([(None, None, 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (20, [2.0], 1)], "vec_id long, embedding array<float>, rank int")
    assert ann.search(df, F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
