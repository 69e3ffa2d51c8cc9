"""Query of near-duplicate search."""

from flowprism.llm import minmax
from flowprism.llm.registry import query, table


@query("op5_near_duplicates")
def op5_near_duplicates(spark, sf_dir):
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
