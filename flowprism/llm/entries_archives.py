"""Query of the WARC archives."""

from pyspark.sql import functions as F

from flowprism.llm import archives
from flowprism.llm.registry import query, table

SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest,
  max(page_id) over (partition by payload) as largest from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to
from h
"""


@query("op2_warc", SQL)
def op2_warc(spark, sf_dir):
    out = archives.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", F.col("payload_bytes").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
