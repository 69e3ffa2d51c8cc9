"""The full per-packet feature table, in batch or real-time semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprism.functions import packet as P
from flowprism.operators.flows import FLAG_COUNTERS, rate_carry_forward, seconds, with_flow_features
from flowprism.operators.frames import direction_fold, frame20_stats, two_stream_stats, with_frame_group
from flowprism.operators.ordered import BLOCK_BITS, block_summary, earlier_rates, running
from flowprism.session import stored

# The feature names in output order (spelling kept).
_HEAD = [
    "ts", "flow_duration", "flow_byte", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port",
    "Protocol Type", "Duration", "Rate", "Srate", "Drate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number", "ack_flag_number",
    "urg_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "urg_count", "rst_count",
    "max_duration", "min_duration", "sum_duration", "average_duration", "std_duration",
    "CoAP", "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP", "IGMP",
    "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number", "MAC",
    "Magnitue", "Radius", "Covariance", "Variance", "Weight",
]
BATCH_COLUMNS = [
    *_HEAD, "DS status", "Fragments", "Sequence number", "Protocol Version", "flow_idle_time", "flow_active_time",
]
REALTIME_COLUMNS = [
    *_HEAD, "Correlation", "DS status", "Fragments", "Sequence number", "flow_idle_time", "flow_active_time",
]
_NOT_MODELLED = {
    "ts", "src_mac", "dst_mac", "src_ip", "dst_ip", "Protocol Type", "Number", "MAC", "Correlation",
    "Protocol Version", "max_duration", "min_duration", "sum_duration", "average_duration", "std_duration",
}
MODEL_COLUMNS = [name for name in REALTIME_COLUMNS if name not in _NOT_MODELLED]


def iat_batch() -> Column:
    """Seconds since the previous frame; the first frame reports its own time."""
    return seconds(F.col("ts_us") - F.coalesce("prev_us", F.lit(0)))


def iat_realtime() -> Column:
    """Seconds since the first frame of the micro-batch."""
    return seconds(F.col("ts_us") - F.col("first_us"))


def extract_features(
    packets: DataFrame,
    mode: str = "batch",
    scope: str = "capture_id",
    *,
    block_bits: int = BLOCK_BITS,
    mac: int = P.MAC_CONSTANT,
) -> DataFrame:
    """All feature columns plus ``scope`` and ``seq``.

    batch: one scope is a capture file, state lives for the whole capture.
    realtime: one scope is a micro-batch of at most 100 packets.
    """
    if mode not in ("batch", "realtime"):
        raise ValueError(f"unknown mode {mode!r}")
    live = mode == "realtime"
    packets = P.filter_ip_arp(packets)
    summary = None if live else stored(block_summary(packets, scope, block_bits), "blocks")
    frames = running(packets, scope, ["scope", "flow"], bounded=live, block_bits=block_bits, summary=summary)
    earlier = None if live else earlier_rates(summary, scope)
    frames = rate_carry_forward(with_flow_features(frames), scope, earlier)
    frames = with_frame_group(frames)
    frames = direction_fold(frames, scope, arp_moves=not live)
    frames = two_stream_stats(frame20_stats(frames, scope), scope)

    bits = P.tcp_flag_bits()
    arp_ip = F.lit("0") if live else F.lit(None).cast("string")

    def outside_arp(column: str, arp_value: Column) -> Column:
        return F.when(P.is_arp(), arp_value).otherwise(F.col(column))

    derived = (
        {
            "ts": seconds("ts_us"),
            "src_ip": outside_arp("src_ip", arp_ip),
            "dst_ip": outside_arp("dst_ip", arp_ip),
            "src_port": outside_arp("src_port", F.lit(0)),
            "dst_port": outside_arp("dst_port", F.lit(0)),
            "Protocol Type": outside_arp("proto", F.lit(0)),
            "Duration": outside_arp("ttl", F.lit(0)),
            "IAT": iat_realtime() if live else iat_batch(),
        }
        | {f"{name}_flag_number": bit for name, bit in bits.items()}
        | P.app_flags_scoped()
        | P.l3_flags()
        | P.const_flags(mac)
        | P.zero_columns()
    )
    columns = REALTIME_COLUMNS if live else BATCH_COLUMNS
    return frames.select(
        F.col(scope),
        F.col("seq"),
        *[derived[c].alias(c) if c in derived else F.col(f"`{c}`") for c in columns],
    )


def select_model_features(features: DataFrame, scope: str) -> DataFrame:
    """Model inputs: row number in the micro-batch first, nulls as 0, all doubles.

    The reference feeds the row number to the model, so it stays a column.
    """
    from pyspark.sql import Window

    in_batch = Window.partitionBy(scope).orderBy("seq")
    numbered = features.withColumn("row_number", F.row_number().over(in_batch))
    return numbered.select(
        scope,
        "seq",
        "row_number",
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in MODEL_COLUMNS],
    )


def model_vector(model_features: DataFrame) -> DataFrame:
    """The 55 model inputs as one array column."""
    inputs = [F.col("row_number").cast("double"), *[F.col(f"`{c}`") for c in MODEL_COLUMNS]]
    return model_features.withColumn("vector", F.array(*inputs))


__all__ = [
    "BATCH_COLUMNS",
    "REALTIME_COLUMNS",
    "MODEL_COLUMNS",
    "FLAG_COUNTERS",
    "extract_features",
    "select_model_features",
    "model_vector",
    "iat_batch",
    "iat_realtime",
]
