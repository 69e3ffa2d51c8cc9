"""Stateless packet expressions over the ``packets`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ether types, IP protocol numbers, service ports, TCP flag masks.
ETH_IPV4 = 2048
ETH_ARP = 2054
PROTOCOL_NAMES = {0: "IP", 1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP"}
UNKNOWN_PROTOCOL = "Unknown for now"
SERVICE_PORTS = {
    "CoAP": 5683,
    "DNS": 53,
    "HTTP": 80,
    "HTTPS": 443,
    "IRC": 21,
    "MQTT": 1883,
    "SMTP": 25,
    "SSH": 22,
    "Telnet": 23,
}
SERVICES_ANY_IP = ("CoAP", "SMTP")
SERVICES_TCP = ("HTTP", "HTTPS", "SSH", "IRC", "MQTT", "Telnet")
SERVICES_UDP = ("DNS",)
TCP_FLAG_MASKS = {
    "fin": 0x01,
    "syn": 0x02,
    "rst": 0x04,
    "psh": 0x08,
    "ack": 0x10,
    "urg": 0x20,
    "ece": 0x40,
    "cwr": 0x80,
}
# The link-layer "MAC" feature is one class-level constant for every IP frame.
MAC_CONSTANT = 1

FLOW_KEY = ["proto", "a_ip", "a_port", "b_ip", "b_port"]


def as_flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def is_ip() -> Column:
    return F.col("eth_type") == ETH_IPV4


def is_arp() -> Column:
    return F.col("eth_type") == ETH_ARP


def is_proto(number: int) -> Column:
    """IP packet of a protocol; TCP and UDP only with a readable header (ports known)."""
    matches = is_ip() & (F.col("proto") == number)
    return matches & F.col("src_port").isNotNull() if number in (6, 17) else matches


def has_flow() -> Column:
    """TCP and UDP packets with ports belong to a flow."""
    return is_ip() & F.col("proto").isin(6, 17) & F.col("src_port").isNotNull()


def filter_ip_arp(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("eth_type").isin(ETH_IPV4, ETH_ARP))


def protocol_name(proto: Column | str = "proto") -> Column:
    proto = F.col(proto) if isinstance(proto, str) else proto
    name = F.lit(UNKNOWN_PROTOCOL)
    for number, text in PROTOCOL_NAMES.items():
        name = F.when(proto == number, text).otherwise(name)
    return name


def port_is(port: int) -> Column:
    return as_flag((F.col("src_port") == port) | (F.col("dst_port") == port))


def app_flags() -> dict[str, Column]:
    """Service flag by either port, whatever the protocol."""
    return {name: port_is(port) for name, port in SERVICE_PORTS.items()}


def app_flags_scoped() -> dict[str, Column]:
    """Service flags limited to the protocols that may raise them."""
    def limited(name: str, applies: Column) -> Column:
        return F.when(applies, port_is(SERVICE_PORTS[name])).otherwise(0)

    flags = {name: limited(name, is_ip()) for name in SERVICES_ANY_IP}
    flags |= {name: limited(name, is_proto(6)) for name in SERVICES_TCP}
    flags |= {name: limited(name, is_proto(17)) for name in SERVICES_UDP}
    return flags | {"DHCP": F.when(is_proto(17), dhcp_flag()).otherwise(0)}


def dhcp_flag() -> Column:
    """Directional: client answers from 67 or requests to 68."""
    return as_flag((F.col("src_port") == 67) | (F.col("dst_port") == 68))


def l3_flags() -> dict[str, Column]:
    return {
        "TCP": as_flag(is_proto(6)),
        "UDP": as_flag(is_proto(17)),
        "ICMP": as_flag(is_proto(1)),
        "IGMP": as_flag(is_proto(2)),
        "IPv": as_flag(is_ip()),
        "ARP": as_flag(is_arp()),
    }


def const_flags(mac: int = MAC_CONSTANT) -> dict[str, Column]:
    """LLC is raised on every IP frame; MAC is one constant on IP frames."""
    return {
        "LLC": as_flag(is_ip()),
        "MAC": F.when(is_ip(), F.lit(mac)).otherwise(0),
    }


def zero_columns() -> dict[str, Column]:
    """Wireless and reverse-ARP fields are never reached for IP/ARP frames."""
    names = ("DS status", "Fragments", "Sequence number", "Protocol Version", "RARP")
    return {name: F.lit(0) for name in names}


def tcp_flag_bits() -> dict[str, Column]:
    return {
        name: as_flag(is_proto(6) & (F.col("tcp_flags").bitwiseAND(F.lit(mask)) != 0))
        for name, mask in TCP_FLAG_MASKS.items()
    }


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Unordered endpoint pair: addresses compare as text, then ports as numbers."""
    source = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    target = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    keyed = packets.withColumns({"_lo": F.least(source, target), "_hi": F.greatest(source, target)})
    return keyed.withColumns(
        {
            "a_ip": F.when(has_flow(), F.col("_lo.ip")),
            "a_port": F.when(has_flow(), F.col("_lo.port")),
            "b_ip": F.when(has_flow(), F.col("_hi.ip")),
            "b_port": F.when(has_flow(), F.col("_hi.port")),
            "is_forward": F.when(has_flow(), source == F.col("_lo")),
        }
    ).drop("_lo", "_hi")


def safe_rate(count: Column, duration: Column) -> Column:
    """Null where the duration is zero (ANSI mode raises on a plain x/0)."""
    return F.try_divide(count.cast("double"), duration)
