"""Header fields of raw Ethernet frames as column expressions on a binary column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ETHERNET_HEADER = 14
IP_HEADER = 20
TCP_HEADER = 20
UDP_HEADER = 8
VLAN = "8100"


# Longest header stack read: tagged Ethernet, IP with options, TCP.
HEADER_BYTES = 18 + 60 + TCP_HEADER


def header_digits(frame: Column) -> Column:
    """The header bytes as hexadecimal text, made once per frame; fields are cut from it."""
    return F.hex(F.substring(frame, 1, HEADER_BYTES))


def _digits(header: Column, start: Column | int, size: int) -> Column:
    """``size`` bytes from 0-based ``start``, as hexadecimal digits."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(header, start * 2 + 1, F.lit(size * 2))


def _number(header: Column, start: Column | int, size: int) -> Column:
    return F.conv(_digits(header, start, size), 16, 10).cast("int")


def _mac(header: Column, start: int) -> Column:
    return F.regexp_replace(F.lower(_digits(header, start, 6)), "(..)(?=.)", "$1:")


def _ip(header: Column, start: Column) -> Column:
    return F.concat_ws(".", *[F.conv(_digits(header, start + i, 1), 16, 10) for i in range(4)])


def is_whole(frame: Column) -> Column:
    """Long enough for the Ethernet header, and for an IP header when it announces one."""
    size = F.coalesce(F.length(frame), F.lit(0))
    announced = F.hex(F.substring(frame, 13, 2))
    return (size >= ETHERNET_HEADER) & ((announced != "0800") | (size >= ETHERNET_HEADER + IP_HEADER))


def drop_malformed(frames: DataFrame) -> DataFrame:
    """Frames that cannot be decoded give no row."""
    return frames.where(is_whole(F.col("frame")))


def malformed_count(frames: DataFrame) -> DataFrame:
    whole = is_whole(F.col("frame"))
    return frames.agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("dropped"))


def decode_frames(frames: DataFrame) -> DataFrame:
    """``packets`` columns from ``frame`` (other columns stay).

    Ports and TCP flags are null when the transport header is missing, cut off or in a
    later fragment. The length of an IP frame leaves out link-layer padding.
    """
    frame = F.col("_header")
    size = F.length("frame")
    tag = F.when(_digits(frame, 12, 2) == VLAN, 4).otherwise(0)
    staged = drop_malformed(frames).withColumn("_header", header_digits(F.col("frame")))
    staged = staged.withColumn("_ip", tag + ETHERNET_HEADER)
    at = F.col("_ip")
    staged = staged.withColumn("eth_type", _number(frame, at - 2, 2))
    ip = F.col("eth_type") == 2048
    staged = staged.withColumns(
        {
            "_l4": at + F.when(ip, _number(frame, at, 1).bitwiseAND(F.lit(15)) * 4),
            "_total": F.when(ip, _number(frame, at + 2, 2)),
            "_offset": F.when(ip, _number(frame, at + 6, 2).bitwiseAND(F.lit(0x1FFF))),
            "proto": F.when(ip, _number(frame, at + 9, 1)).when(F.col("eth_type") == 2054, 0),
        }
    )
    l4 = F.col("_l4")
    room = size - l4
    readable = (F.col("_offset") == 0) & (
        ((F.col("proto") == 6) & (room >= TCP_HEADER)) | ((F.col("proto") == 17) & (room >= UDP_HEADER))
    )
    unpadded = (F.col("_total") >= IP_HEADER) & (at + F.col("_total") <= size)
    return staged.withColumns(
        {
            "src_mac": _mac(frame, 6),
            "dst_mac": _mac(frame, 0),
            "src_ip": F.when(ip, _ip(frame, at + 12)),
            "dst_ip": F.when(ip, _ip(frame, at + 16)),
            "src_port": F.when(readable, _number(frame, l4, 2)),
            "dst_port": F.when(readable, _number(frame, l4 + 2, 2)),
            "ttl": F.when(ip, _number(frame, at + 8, 1)),
            "tcp_flags": F.when(readable & (F.col("proto") == 6), _number(frame, l4 + 13, 1)),
            "frame_len": F.when(unpadded, at + F.col("_total")).otherwise(size),
        }
    ).drop("_header", "_ip", "_l4", "_total", "_offset")


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def encode_frames(packets: DataFrame) -> DataFrame:
    """Raw frames (zero payload) for IP and ARP packets: the inverse of ``decode_frames``."""
    ip = F.col("eth_type") == 2048

    def address(column: str) -> Column:
        return F.concat(*[_hex(F.split_part(column, F.lit("."), F.lit(i + 1)).cast("int"), 2) for i in range(4)])

    ethernet = F.concat(
        F.replace("dst_mac", F.lit(":"), F.lit("")), F.replace("src_mac", F.lit(":"), F.lit("")), _hex(F.col("eth_type"), 4)
    )
    network = F.concat(
        F.lit("4500"),
        _hex(F.col("frame_len") - ETHERNET_HEADER, 4),
        F.lit("00000000"),
        _hex(F.col("ttl"), 2),
        _hex(F.col("proto"), 2),
        F.lit("0000"),
        address("src_ip"),
        address("dst_ip"),
    )
    ports = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4))
    tcp = F.concat(ports, F.lit("0" * 16 + "50"), _hex(F.col("tcp_flags"), 2))
    head = F.concat(
        ethernet,
        F.when(ip, network).otherwise(""),
        F.when(ip & (F.col("proto") == 6), tcp).when(ip & (F.col("proto") == 17), ports).otherwise(""),
    )
    return packets.withColumn("frame", F.unhex(F.rpad(head, F.col("frame_len") * 2, F.lit("0"))))
