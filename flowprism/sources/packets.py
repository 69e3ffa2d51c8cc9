"""The ``packets`` table derived from an ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Same statement for both engines; only the epoch call and the JSON source differ.
_TEMPLATE = """
select seq, batch_id, day_id, ts_us, eth_type,
  case when rev = 1 then smac else cmac end as src_mac,
  case when rev = 1 then cmac else smac end as dst_mac,
  case when eth_type = 2054 then null when rev = 1 then sip else cip end as src_ip,
  case when eth_type = 2054 then null when rev = 1 then cip else sip end as dst_ip,
  case when proto not in (6, 17) then null when rev = 1 then svc else cport end as src_port,
  case when proto not in (6, 17) then null when rev = 1 then cport else svc end as dst_port,
  proto, ttl, frame_len,
  case when proto = 6 then flags else null end as tcp_flags
from (select event_id as seq,
  cast(floor(event_id / 100) as bigint) as batch_id,
  cast(floor(({us} - 1704067200000000) / 86400000000) as bigint) as day_id,
  {us} as ts_us,
  case when k < 8 then 2054 when k = 99 then 34525 else 2048 end as eth_type,
  case when k < 8 then 0 when event_type = 'error' then 1
       when event_type in ('purchase', 'view') then 17 else 6 end as proto,
  concat('192.168.20.', cast(100 + user_id % 5 as string)) as cip,
  concat('192.168.', case when k % 2 = 0 then '30' else '40' end, '.10') as sip,
  case when user_id % 5 = 2 then '00:0c:29:fa:80:88'
       else concat('00:0c:29:00:00:0', cast(user_id % 5 as string)) end as cmac,
  concat('00:0c:29:00:01:0', cast(k % 2 as string)) as smac,
  40000 + cast(user_id % 5 as int) as cport,
  case k % 7 when 0 then 80 when 1 then 443 when 2 then 53 when 3 then 22
             when 4 then 23 when 5 then 25 else 5683 end as svc,
  case when event_id % 3 = 1 then 1 else 0 end as rev,
  case when k % 2 = 0 then 64 else 128 end as ttl,
  60 + cast(floor(value) as int) as frame_len,
  (k * 37) % 256 as flags
  from {source} e) p
"""

SPARK_SQL = _TEMPLATE.format(
    us="unix_micros(cast(ts as timestamp))",
    # The one-element explode parses the JSON once per row: filters on the derived
    # columns stay above it instead of repeating the parse.
    source="""(select event_id, ts, user_id, event_type, value, parsed.k from {events}
      lateral view explode(array(cast(get_json_object(props, '$.k') as int))) parsed as k)""",
)
ORACLE_SQL = _TEMPLATE.format(
    us="epoch_us(ts)",
    source="(select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k from events)",
)
# Oracle statements start with this and read ``frames`` (IP and ARP only) or ``packets``.
ORACLE_WITH = f"with packets as ({ORACLE_SQL}), frames as (select * from packets where eth_type in (2048, 2054))"


def packets_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(SPARK_SQL, events=events)
