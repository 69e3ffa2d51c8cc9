"""Query of the sharding."""

from flowprism.llm import sharding
from flowprism.llm.registry import query, table


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
