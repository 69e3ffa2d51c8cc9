"""Detection event expressions: texts, zones, confidence and the event document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event texts, network zones, event document fields.
EVENT_TEXT = {
    "0_normal": "Normal Traffic",
    "TCP": "TCP Scanning Attack",
    "UDP": "UDP Scanning Attack",
    "ICMP": "ICMP Scanning Attack",
    "ARP": "ARP Scanning Attack",
}
UNKNOWN_EVENT = "Unknown event"
ZONES = {
    "192.168.111.": "WAN",
    "192.168.20.": "LAN",
    "192.168.30.": "SERVER",
    "192.168.40.": "DMZ",
}
UNKNOWN = "Unknown"
NO_ADDRESS = "0.0.0.0"
DETECTION_SOURCE = "NIDS-kINN"
EVENT_FEATURES = [
    "flow_duration", "flow_byte", "src_port", "dst_port", "Duration", "Rate", "Srate", "Drate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number", "ack_flag_number",
    "urg_flag_number", "ece_flag_number", "cwr_flag_number", "ack_count", "syn_count", "fin_count",
    "urg_count", "rst_count", "max_duration", "min_duration", "sum_duration", "average_duration",
    "std_duration", "TCP", "UDP", "ICMP", "ARP",
]


def zone_of_ip(ip: Column | str, zones: dict[str, str] = ZONES) -> Column:
    ip = F.col(ip) if isinstance(ip, str) else ip
    zone = F.lit(UNKNOWN)
    for prefix, name in reversed(list(zones.items())):
        zone = F.when(ip.startswith(prefix), name).otherwise(zone)
    return zone


def event_text(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    text = F.lit(UNKNOWN_EVENT)
    for name, wording in EVENT_TEXT.items():
        text = F.when(label == name, wording).otherwise(text)
    return text


def event_confidence(event: Column | str) -> Column:
    event = F.col(event) if isinstance(event, str) else event
    return F.when(event != UNKNOWN_EVENT, 0.95).otherwise(0.5)


def event_protocol(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.isin(*EVENT_TEXT), label).otherwise(UNKNOWN)


def clean_ip(ip: Column) -> Column:
    """Missing, empty or all-digit addresses become 0.0.0.0."""
    return F.when(ip.isNull() | (ip == "") | ip.rlike("^[0-9]+$"), NO_ADDRESS).otherwise(ip)


def event_id(epoch_seconds: Column, source: Column, target: Column) -> Column:
    """Time plus a stable 4-digit hash of the two addresses."""
    digest = F.conv(F.substring(F.md5(F.concat(source, target)), 1, 8), 16, 10).cast("bigint")
    return F.concat_ws("-", F.lit("NIDS"), epoch_seconds.cast("string"), F.pmod(digest, F.lit(10000)).cast("string"))


def features_struct(available: Sequence[str]) -> Column:
    """The nested feature fields; a field the model does not have stays null."""
    fields = [
        (F.col(f"`{name}`") if name in available else F.lit(None)).cast("double").alias(name)
        for name in EVENT_FEATURES
    ]
    return F.struct(*fields)


def format_events(detections: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Event documents from detections with ``ts_us, src_ip, dst_ip, src_port, dst_port, label``.

    ``extra`` columns are merged into the document. Columns ``batch_id`` and ``seq``
    are kept when present, so a sink can be idempotent.
    """
    source, target = clean_ip(F.col("src_ip")), clean_ip(F.col("dst_ip"))
    moment = F.timestamp_micros(F.col("ts_us"))
    event = event_text("label")
    keep = [c for c in ("batch_id", "seq") if c in detections.columns]
    return detections.select(
        *keep,
        event_id(F.floor(F.col("ts_us") / 1_000_000), source, target).alias("event_id"),
        moment.alias("timestamp"),
        source.alias("source_ip"),
        target.alias("destination_ip"),
        F.coalesce(F.col("src_port").cast("int"), F.lit(0)).alias("source_port"),
        F.coalesce(F.col("dst_port").cast("int"), F.lit(0)).alias("destination_port"),
        event.alias("event_type"),
        event_confidence(event).alias("confidence"),
        event_protocol("label").alias("protocol"),
        zone_of_ip("src_ip").alias("network_zone"),
        F.lit(DETECTION_SOURCE).alias("detection_source"),
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("detection_time"),
        F.col("label").alias("original_label"),
        *extra,
    )


def iso_utc(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def event_json(events: DataFrame) -> DataFrame:
    """One JSON text per event, time as ISO UTC."""
    fields = [iso_utc(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in events.columns]
    return events.select(F.to_json(F.struct(*fields)).alias("value"))


def parse_event_time(text: Column) -> Column:
    """Three accepted forms: ``yyyy-MM-dd HH:mm:ss``, ISO, epoch milliseconds."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.when(text.rlike("^[0-9]+$"), F.timestamp_millis(text.try_cast("bigint"))),
        text.try_cast("timestamp"),
    )


def enforce_event_schema(raw: DataFrame) -> DataFrame:
    """Cast a loose event table to the typed mapping; extra columns stay."""
    typed = {
        "event_id": F.col("event_id").cast("string"),
        "timestamp": parse_event_time(F.col("timestamp").cast("string")),
        "source_ip": F.col("source_ip").cast("string"),
        "destination_ip": F.col("destination_ip").cast("string"),
        "source_port": F.col("source_port").try_cast("int"),
        "destination_port": F.col("destination_port").try_cast("int"),
        "event_type": F.col("event_type").cast("string"),
        "confidence": F.col("confidence").try_cast("float"),
        "protocol": F.col("protocol").cast("string"),
        "network_zone": F.col("network_zone").cast("string"),
        "detection_source": F.col("detection_source").cast("string"),
        "detection_time": parse_event_time(F.col("detection_time").cast("string")),
        "original_label": F.col("original_label").cast("string"),
    }
    return raw.withColumns({name: value for name, value in typed.items() if name in raw.columns})
