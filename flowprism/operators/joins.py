"""Lookups of packets against labels, zones, attackers and capture segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprism.functions.events import EVENT_TEXT, UNKNOWN, UNKNOWN_EVENT
from flowprism.functions.labels import label_where, touches_any
from flowprism.session import broadcast_if_small, durable


def label_join(rows: DataFrame, mapping: dict[str, str] = EVENT_TEXT) -> DataFrame:
    """Left lookup label -> event text with a default."""
    table = rows.sparkSession.createDataFrame(list(mapping.items()), "label string, event string")
    # The table holds the entries of a driver-side dictionary.
    return rows.join(F.broadcast(table), "label", "left").withColumn(
        "event", F.coalesce("event", F.lit(UNKNOWN_EVENT))
    )


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number; null when it is not four octets."""
    parts = [F.split_part(ip, F.lit("."), F.lit(i + 1)).try_cast("bigint") for i in range(4)]
    return ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]


def zone_table(spark: SparkSession, cidrs: dict[str, str]) -> DataFrame:
    """``zone, lo, hi`` rows from ``{"192.168.20.0/24": "LAN", ...}`` (disjoint networks)."""
    cidr = spark.createDataFrame(list(cidrs.items()), "cidr string, zone string")
    size = F.pow(F.lit(2.0), 32 - F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")).cast("bigint")
    start = ip_number(F.split_part("cidr", F.lit("/"), F.lit(1)))
    return cidr.select("zone", (start - F.pmod(start, size)).alias("lo"), size.alias("size")).select(
        "zone", "lo", (F.col("lo") + F.col("size") - 1).alias("hi")
    )


def zone_join(rows: DataFrame, zones: DataFrame, ip: str, name: str = "zone") -> DataFrame:
    """Address range lookup as a hash join on the first octet plus a range test."""
    octet = 1 << 24
    spread = zones.select(
        F.col("zone").alias("_zone"),
        "lo",
        "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / octet), F.floor(F.col("hi") / octet))).alias("_octet"),
    )
    keyed = rows.withColumn("_ip", ip_number(F.col(ip)))
    keyed = keyed.withColumn("_octet", F.floor(F.col("_ip") / octet))
    spread = broadcast_if_small(spread).alias("z")
    condition = (F.col("p._octet") == F.col("z._octet")) & F.col("p._ip").between(F.col("z.lo"), F.col("z.hi"))
    joined = keyed.alias("p").join(spread, condition, "left")
    return joined.select("p.*", F.coalesce("z._zone", F.lit(UNKNOWN)).alias(name)).drop("_ip", "_octet")


def attacker_rows(packets: DataFrame, attackers: DataFrame, *, complement: bool = False) -> DataFrame:
    """Packets whose source or destination hardware address is in ``attackers(mac)``."""
    macs = broadcast_if_small(durable(attackers.select("mac").distinct()))
    source = macs.select(F.col("mac").alias("_src"))
    target = macs.select(F.col("mac").alias("_dst"))
    # One lookup per end; the list is distinct, so no packet is repeated.
    marked = packets.join(source, F.col("src_mac") == F.col("_src"), "left").join(
        target, F.col("dst_mac") == F.col("_dst"), "left"
    )
    hit = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    return marked.where(~hit if complement else hit).drop("_src", "_dst")


def segment_range_join(packets: DataFrame, segments: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Attach ``name`` of the segment whose [start_us, end_us] holds the packet.

    Segments are spread over the time buckets they touch, so the lookup is an equality
    on the bucket plus a range test; packets outside every segment keep a null name.
    """
    spread = segments.select(
        F.col("name").alias("_name"),
        "start_us",
        "end_us",
        F.explode(
            F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor(F.col("end_us") / bucket_us))
        ).alias("_bucket"),
    )
    keyed = packets.withColumn("_bucket", F.floor(F.col("ts_us") / bucket_us)).alias("p")
    condition = (F.col("p._bucket") == F.col("s._bucket")) & F.col("p.ts_us").between(
        F.col("s.start_us"), F.col("s.end_us")
    )
    joined = keyed.join(broadcast_if_small(durable(spread)).alias("s"), condition, "left")
    return joined.select("p.*", F.col("s._name").alias("name")).drop("_bucket")


def label_by_segment(packets: DataFrame, segments: DataFrame, attackers: DataFrame) -> DataFrame:
    """``packets`` with ``name`` of their segment and the ``label`` its attackers (``name, mac``) give them.

    Addresses are gathered per segment name before they meet the segments, so a packet is met once however many
    attackers a segment has. A segment without attackers is benign; a packet in no segment has no label.
    """
    macs = attackers.where(F.col("mac").isNotNull()).groupBy(F.col("name").alias("_of")).agg(F.collect_set("mac").alias("_macs"))
    placed = segment_range_join(packets, segments)
    met = placed.join(broadcast_if_small(durable(macs)), F.col("name") == F.col("_of"), "left")
    label = F.when(F.col("name").isNotNull(), label_where(touches_any(F.col("_macs"))))
    return met.withColumn("label", label).drop("_of", "_macs")


def positional_zip(rows: DataFrame, predictions: DataFrame, keys: tuple = ("batch_id", "seq")) -> DataFrame:
    """Predictions back on their packets, by key instead of row position."""
    return rows.join(predictions, list(keys))


def union_captures(parts: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a ``source`` column naming each part."""
    tagged = [part.withColumn("source", F.lit(name)) for name, part in parts.items()]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out
