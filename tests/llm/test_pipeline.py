from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import language_id, mixing, quality, simhash, stages
from quillmill.llm.common import held_out
from quillmill.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_names_and_columns():
    assert sum(q.startswith("op") for q in QUERIES) == 10 and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mix_sources", "pack"]


def test_each_stage_against_its_operator(spark):
    """Each stage's decisions, from what its operator says about the stage's own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34 56", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    at = docs.unionByName(odd).cache()
    out = stages.identify_language(spark, at, DATA).cache()
    model = language_id.fit(at.where(~held_out(F.col("doc_id"), 5, 0)))
    want = {r.doc_id for r in language_id.predict(at, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want and 10**6 not in want
    at = out
    out = stages.classify_quality(spark, at, DATA).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    train = ~held_out(F.col("doc_id"), 4, 2)
    want = {r.doc_id for r in quality.predict(at, quality.fit(at.where(train), labels.where(train))).where("predicted = 1").collect()}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want and 0 < len(want) <= at.count()
    at = out
    out = stages.near_dedup(spark, at, DATA).cache()
    comps = simhash.with_components(at.select("doc_id", "text")).collect()
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in comps})
    at = out
    out = stages.mix_sources(spark, at, DATA).cache()
    taken = {r.doc_id: r.copies for r in mixing.mix(at).where("copies > 0").collect()}
    counted = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.columns == docs.columns and counted == taken
    packed = stages.pack(spark, out, DATA)
    found = packed.select(F.explode(F.arrays_zip("doc_ids", "pieces")).alias("p")).groupBy("p.doc_ids", "p.pieces").count()
    assert {r.doc_ids: r["count"] for r in found.where("pieces = 0").collect()} == taken
    assert packed.where("length(ids) > 2 * 2048 or length(ids) <> 2 * aggregate(lengths, 0L, (a, x) -> a + x)").isEmpty()


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.select(F.max(F.length("ids"))).first()[0] <= 2 * 2048
    assert rows.count() == rows.select("sequence_id").distinct().count() > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "quillmill").rglob("*.py"):
        if p.parent.name != "llm":
            assert "quillmill.llm" not in p.read_text(), p
