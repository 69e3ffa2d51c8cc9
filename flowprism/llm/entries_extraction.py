"""Query of main-text extraction."""

from pyspark.sql import functions as F

from flowprism.llm import extraction
from flowprism.llm.registry import query, table


@query("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extraction.extract(pages, extraction.fit(pages))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
