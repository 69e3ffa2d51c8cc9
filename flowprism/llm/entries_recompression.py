"""Query of the removal of repeated passages."""

from pyspark.sql import functions as F

from flowprism.llm import recompression
from flowprism.llm.registry import query, table


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    out = recompression.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
