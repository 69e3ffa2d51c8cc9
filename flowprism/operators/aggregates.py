"""Grouped counts over packets and labelled rows. All combine map-side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprism.functions.labels import PROTOCOL_LABELS, protocol_type, touches_mac
from flowprism.functions.packet import is_ip, protocol_name


def both_ends(packets: DataFrame, source: str, target: str, name: str, keep: tuple = ()) -> DataFrame:
    """Each packet once per end: columns ``side`` (src/dst) and ``name``."""
    ends = F.array(
        F.struct(F.lit("src").alias("side"), F.col(source).alias(name)),
        F.struct(F.lit("dst").alias("side"), F.col(target).alias(name)),
    )
    return packets.select(*keep, F.explode(ends).alias("end")).select(*keep, "end.side", f"end.{name}")


def _count(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def wellknown_port_connections(packets: DataFrame) -> DataFrame:
    """Per address, packets where either port is in 1..1023."""
    low = F.col("src_port").between(1, 1023) | F.col("dst_port").between(1, 1023)
    return _count(both_ends(packets.where(is_ip() & low), "src_ip", "dst_ip", "ip"), "side", "ip")


def proto_ip_counts(packets: DataFrame) -> DataFrame:
    rows = packets.where(is_ip()).withColumn("protocol", protocol_name())
    return _count(both_ends(rows, "src_ip", "dst_ip", "ip", ("protocol",)), "protocol", "side", "ip")


def proto_port_counts(packets: DataFrame, compat: bool = True) -> DataFrame:
    """Packets per protocol and port; ``compat`` keeps destination counts at 1."""
    rows = packets.where(is_ip()).withColumn("protocol", protocol_name())
    counts = _count(both_ends(rows, "src_port", "dst_port", "port", ("protocol",)), "protocol", "side", "port")
    if compat:
        counts = counts.withColumn("n", F.when(F.col("side") == "dst", F.lit(1)).otherwise(F.col("n")))
    return counts


def proto_avg_rate(packets: DataFrame) -> DataFrame:
    """Packet counts per protocol and address over the summed times of all frames."""
    split = F.floor(F.col("ts_us") / 1_000_000)
    total = packets.agg(
        (F.sum(split).cast("double") + F.sum(F.col("ts_us") - split * 1_000_000) / 1e6).alias("total_seconds")
    )
    return packets.sparkSession.sql(
        "select protocol, side, ip, n, n / (select total_seconds from {total}) as rate from {counts}",
        total=total,
        counts=proto_ip_counts(packets),
    )


def packets_per_protocol(packets: DataFrame) -> DataFrame:
    """Count per protocol and the total over all of them."""
    named = packets.where(is_ip()).select(protocol_name().alias("protocol"))
    return (
        named.rollup("protocol")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("protocol").alias("g"))
        .select(F.when(F.col("g") == 1, "total").otherwise(F.col("protocol")).alias("protocol"), "n")
    )


def dst_port_counts(packets: DataFrame) -> DataFrame:
    return _count(packets.where(is_ip()).select(F.coalesce("dst_port", F.lit(-1)).alias("dst_port")), "dst_port")


def unique_ips(packets: DataFrame) -> DataFrame:
    """Every address seen, with the packets it appears in."""
    return _count(both_ends(packets.where(is_ip()), "src_ip", "dst_ip", "ip"), "ip")


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return _count(rows, label).orderBy(F.col("n").desc(), label)


def mask_counts(packets: DataFrame, mac: Column | str) -> DataFrame:
    return packets.agg(
        *[
            F.count_if(touches_mac(mac) & (protocol_type() == number)).alias(f"{name.lower()}_mask")
            for number, name in PROTOCOL_LABELS.items()
        ]
    )


def value_histogram(rows: DataFrame, label: str, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of ``value`` per label over that label's own range.

    Rows are counted per distinct value first, so the range lookup runs over a small
    table. A single-valued label gets a range one unit wide around its value.
    """
    counts = _count(rows.where(F.col(value).isNotNull()), label, value)
    span = counts.groupBy(label).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    span = span.select(
        label,
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return (
        counts.join(span, label)
        .withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy(label, "bin")
        .agg(F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    )


def null_profile(rows: DataFrame) -> DataFrame:
    """Per column: type, nulls and non-nulls, in one pass."""
    columns = rows.columns
    totals = rows.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(columns)]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(rows.schema[c].dataType.simpleString()).alias("type"),
            F.col(f"_c{i}").alias("non_nulls"),
            (F.col("_all") - F.col(f"_c{i}")).alias("nulls"),
        )
        for i, c in enumerate(columns)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
