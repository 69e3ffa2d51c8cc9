"""Dashboard panels over the detection event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprism.functions.events import EVENT_TEXT, UNKNOWN, UNKNOWN_EVENT

# Bucket widths in seconds an automatic histogram may choose.
_WIDTHS = [1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 43200, 86400, 604800, 2592000, 31536000]
MAX_BUCKETS = 100
SEARCH_COLUMNS = [
    "timestamp", "event_id", "event_type", "source_ip", "source_port", "destination_ip", "destination_port",
    "protocol", "network_zone", "confidence",
]


def auto_width(events: DataFrame, time: str = "timestamp", buckets: int = MAX_BUCKETS) -> int:
    """Smallest round width (seconds) that needs at most ``buckets`` buckets: one min/max job."""
    low, high = events.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    span = 0 if low is None else (high - low) / 1e6
    return next((width for width in _WIDTHS if span <= width * buckets), _WIDTHS[-1])


def bucket_start(width: int, time: str = "timestamp") -> Column:
    """Start of the time bucket, epoch microseconds."""
    step = width * 1_000_000
    return (F.floor(F.unix_micros(time) / step) * step).cast("long")


def event_counts(events: DataFrame) -> DataFrame:
    """Events per known type and "Unknown", zero rows included."""
    spark = events.sparkSession
    names = [(text,) for text in EVENT_TEXT.values()] + [(UNKNOWN,)]
    types = spark.createDataFrame(names, "event_type string")
    seen = F.when(F.col("event_type") == UNKNOWN_EVENT, UNKNOWN).otherwise(F.col("event_type"))
    counts = events.groupBy(seen.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return types.join(counts, "event_type", "left").fillna(0, ["n"])


def top_terms(events: DataFrame, field: str, size: int = 10) -> DataFrame:
    """The ``size`` most frequent values (ties by value)."""
    return events.groupBy(field).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), field).limit(size)


def events_over_time(events: DataFrame, width: int | None = None, series: int = 5) -> DataFrame:
    """Counts per time bucket for the most frequent event types; empty buckets are absent."""
    width = width or auto_width(events)
    counts = events.groupBy(bucket_start(width).alias("bucket_us"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    leading = top_terms(events, "event_type", series).select("event_type")
    # At most ``series`` rows by construction.
    return counts.join(F.broadcast(leading), "event_type", "left_semi")


def label_over_time(events: DataFrame, width: int | None = None) -> DataFrame:
    """Stacked counts of the original label per bucket, empty buckets kept as 0."""
    width = width or auto_width(events)
    counts = events.groupBy(bucket_start(width).alias("bucket_us"), "original_label").agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = counts.agg(
        F.sequence(F.min("bucket_us"), F.max("bucket_us"), F.lit(width * 1_000_000)).alias("buckets"),
        F.array_sort(F.collect_set("original_label")).alias("labels"),
    ).select(F.explode("buckets").alias("bucket_us"), "labels")
    grid = grid.select("bucket_us", F.explode("labels").alias("original_label"))
    return grid.join(counts, ["bucket_us", "original_label"], "left").fillna(0, ["n"])


def last_confidence(events: DataFrame, width: int | None = None) -> DataFrame:
    """Latest confidence value in each time bucket."""
    width = width or auto_width(events)
    return events.groupBy(bucket_start(width).alias("bucket_us")).agg(
        F.max_by("confidence", "timestamp").alias("confidence")
    )


def recent_events(events: DataFrame, size: int = 500) -> DataFrame:
    """The search panel: newest events first."""
    return events.select(*SEARCH_COLUMNS).orderBy(F.col("timestamp").desc(), "event_id").limit(size)
