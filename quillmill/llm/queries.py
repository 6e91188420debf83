"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import ann, language_id, lm, mixing, oracle, packing, quality, rule_ledger, sharding, simhash, token_files
from quillmill.llm.common import count_words, held_out, materialise, new_path, read_table

SHARD_BYTES = 16 << 20
SMALL_SHARD_BYTES = 256 << 10


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.fit_and_score(docs, held_out(F.col("doc_id"), 7, 2))[1]


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    led = rule_ledger.apply_policy(rule_ledger.ledger(docs), rule_ledger.STANDARD)
    base = rule_ledger.BASE.mask(rule_ledger.RULES)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"), "kept", "fail_bits",
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-orc")
    token_files.write(docs, path, "word_bpe_49k.json", end_id=1, spaced=False)
    return token_files.digest(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = packing.pack(packing.pieces(docs, "byte_bpe_50k.json", end_id=0, spaced=True), packing.groups_of(docs))
    return packing.digest(materialise(made, "sequences"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 4, 2)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs.where(~held), labels.where(~held))
    return quality.predict(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 5, 0)
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    docs = materialise(docs, "mix-sizes")  # the texts are read once; sizes are used four times
    return mixing.mix(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "source")


def _shards(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """What the written shards of the whole table hold."""
    made = sharding.assign(read_table(spark, sf_dir, "documents"), ["doc_id"], limit)
    path = new_path(spark, "shards")
    sharding.write_shards(made, path)
    return sharding.read_shards(spark, path, made).select("doc_id", "row_bytes", "shard", "depth")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir, SHARD_BYTES)


def shards_of_256k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards small enough for the smallest tables to split."""
    return _shards(spark, sf_dir, SMALL_SHARD_BYTES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.with_components(docs).select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


QUERIES = {
    "op1_lm": op1_lm,
    "op2_ann": op2_ann,
    "op3_rule_ledger": op3_rule_ledger,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "llm_shards_of_256k": shards_of_256k,
}

ORACLE = {
    "op3_rule_ledger": oracle.RULE_LEDGER,
    "op7_mixing": oracle.mixed(),
    "op9_sharding": oracle.sharding(SHARD_BYTES),
    "llm_shards_of_256k": oracle.sharding(SMALL_SHARD_BYTES),
}
