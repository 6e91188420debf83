"""Pipeline stages: (spark, docs, sf_dir) -> the documents that go on.

Defined results of every stage: an empty table gives an empty one; repeated
rows are judged alike and each counts; other columns are carried, whatever their
names, up to the last stage. A null or empty text goes at the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import language_id, mixing, packing, quality, simhash
from quillmill.llm.common import count_words, held_out, read_table

#: Below this probability a language is not taken as identified.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null ones among them, and texts of no sure language go.

    Without any labelled training row no language is known, and all go.
    """
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    judged = _judged(docs, lambda d: language_id.predict(d, model, carry_text=True))
    sure = (F.col("_j.lang_pred") != language_id.UND) & (F.col("_j.score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(sure).select("_d.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose quality score is under the threshold go.

    A null or empty text is scored as the empty one; without a trusted positive
    every score is the prior.
    """
    train = ~held_out(F.col("doc_id"), 4, 2)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs.where(train), labels.where(train))
    judged = _judged(docs, lambda d: quality.predict(d, model, carry_text=True))
    return judged.where(F.col("_j.predicted") == 1).select("_d.*")


def _judged(docs: DataFrame, predict) -> DataFrame:
    """A struct _d of the columns of docs beside a struct _j of what a classifier adds, whatever the names."""
    inner = docs.select(F.struct(*docs.columns).alias("_d"), "text")
    out = predict(inner)
    added = [c for c in out.columns if c not in ("_d", "text")]
    return out.select("_d", F.struct(*added).alias("_j"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id.

    Null and empty texts have fingerprint zero and are one component; of rows
    without an id one stays where no row with an id is in the component.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it.

    A null source is a source of its own; a text without a word has no words to
    take, its copies cost nothing.
    """
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", count_words(F.col("text")).alias("words"))
    return mixing.emit(mixing.mix(whole, size=F.col("words")), ["whole"]).select("whole.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids, one row each, with the documents that are in them.

    A null or empty text is its end id alone.
    """
    return packing.pack(packing.pieces(docs, "byte_bpe_50k.json", end_id=0, spaced=True), packing.groups_of(docs))
