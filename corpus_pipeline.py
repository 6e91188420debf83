"""The corpus pipeline: stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and gives it, read again, to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import stages
from quillmill.llm.common import materialise, read_table

STAGES = [
    ("language_id", stages.identify_language),
    ("quality", stages.classify_quality),
    ("near_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("pack", stages.pack),
]

#: The classifiers are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
