"""The stages in order, each judged on its own input."""

import corpus_pipeline
from flowprism.llm import minmax, queries, quality_classifier, recompression
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring_dedup", "mixing", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert after.count() == quality_classifier.classify(before, labels).where("predicted = 1").count()
        if name == "near_duplicates":
            assert minmax.near_duplicates(after).where("not kept").count() == 0
        if name == "substring_dedup":
            assert recompression.remove_repeats(after).where("n_removed > 0").count() <= after.count() // 20
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count() and out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_oracles(spark):
    duck = connect(SF)
    for name, sql in queries.oracles().items():
        assert compare(queries.queries()[name](spark, SF), duck, sql) == []
