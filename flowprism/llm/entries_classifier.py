"""Query of the quality classifier."""

from flowprism.llm import quality_classifier
from flowprism.llm.registry import query, table


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
