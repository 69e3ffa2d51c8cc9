"""Query of the quality rules."""

from flowprism.llm import quality_rules
from flowprism.llm.registry import query, table


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
