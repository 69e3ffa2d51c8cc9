"""Queries of the operators written in DataFrame functions only."""

from pyspark.sql import functions as F

from flowprism.llm import fingerprints, mixing
from flowprism.llm.registry import query, table


@query("op6_fingerprints")
def op6_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    # Documents have no topic column, so the form stands in for it: three marginals are raked.
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), {"topic": None})
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "probability", "sampled")
