"""Query of language-model scores."""

from flowprism.llm import kneser_ney
from flowprism.llm.registry import query, table


@query("op12_kneser_ney")
def op12_kneser_ney(spark, sf_dir):
    return kneser_ney.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
