"""Flow operators: grouped summaries, direction totals and running flow state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprism.functions.packet import FLOW_KEY, has_flow, tcp_flag_bits, with_flow_key
from flowprism.operators.ordered import BLOCK_BITS, carry_last, running

# The counter names do not match the flags they count; the pairing is kept.
FLAG_COUNTERS = {
    "ack_count": "fin",
    "syn_count": "syn",
    "fin_count": "rst",
    "urg_count": "psh",
    "rst_count": "ack",
}
INTENDED_COUNTERS = {name: name.removesuffix("_count") for name in FLAG_COUNTERS}
# Anchor for statistics of absolute times, so doubles keep microseconds: 2024-01-01 UTC.
ANCHOR_US = 1_704_067_200_000_000


def seconds(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return us.cast("double") / 1e6


def flow_frames(packets: DataFrame) -> DataFrame:
    return with_flow_key(packets).where(has_flow())


def flow_summary(packets: DataFrame, scope: str) -> DataFrame:
    """One row per flow. Idle is last minus second-last time (the time itself for one packet).

    Sums combine map-side; the two latest times per flow come from a ranked filter,
    which Spark limits per map task before the shuffle, so a hot flow stays cheap.
    """
    keys = [scope, *FLOW_KEY]
    frames = flow_frames(packets)
    rel = F.col("ts_us") - F.lit(ANCHOR_US)
    totals = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("frame_len").alias("flow_byte"),
        F.max("ts_us").alias("max_us"),
        F.min("ts_us").alias("min_us"),
        F.avg(rel.cast("double")).alias("avg_rel"),
        F.stddev_pop(rel.cast("double")).alias("std_us"),
    )
    latest = Window.partitionBy(*keys).orderBy(F.col("ts_us").desc(), F.col("seq").desc())
    idle = (
        frames.select(*keys, "ts_us", "seq")
        .withColumn("_rank", F.row_number().over(latest))
        .where(F.col("_rank") <= 2)
        .groupBy(*keys)
        .agg((F.max("ts_us") - F.when(F.count(F.lit(1)) > 1, F.min("ts_us")).otherwise(0)).alias("idle_us"))
    )
    return totals.join(idle, keys).select(
        *keys,
        "packets",
        "flow_byte",
        seconds(F.col("max_us") - F.col("min_us")).alias("flow_duration"),
        seconds("max_us").alias("max_duration"),
        seconds("min_us").alias("min_duration"),
        (F.col("avg_rel") / 1e6 * F.col("packets") + F.col("packets") * (ANCHOR_US / 1e6)).alias("sum_duration"),
        (F.col("avg_rel") / 1e6 + ANCHOR_US / 1e6).alias("average_duration"),
        (F.col("std_us") / 1e6).alias("std_duration"),
        seconds("idle_us").alias("flow_idle_time"),
        seconds(F.col("max_us") - F.col("min_us")).alias("flow_active_time"),
    )


def flow_direction_totals(packets: DataFrame, scope: str) -> DataFrame:
    """Packets and bytes per direction of each flow, smaller endpoint first.

    ``src_to_dst_pkt``/``dst_to_src_pkt`` keep the sorted-key behaviour: the reversed
    key only exists when both endpoints are equal.
    """
    keys = [scope, *FLOW_KEY]
    forward = F.col("is_forward")
    same_end = (F.col("a_ip") == F.col("b_ip")) & (F.col("a_port") == F.col("b_port"))
    return (
        flow_frames(packets)
        .groupBy(*keys)
        .agg(
            F.count_if(forward).alias("ab_pkt"),
            F.count_if(~forward).alias("ba_pkt"),
            F.sum(F.when(forward, F.col("frame_len")).otherwise(0)).alias("ab_byte"),
            F.sum(F.when(~forward, F.col("frame_len")).otherwise(0)).alias("ba_byte"),
        )
        .withColumns(
            {
                "src_to_dst_pkt": F.col("ab_pkt") + F.col("ba_pkt"),
                "src_to_dst_byte": F.col("ab_byte") + F.col("ba_byte"),
                "dst_to_src_pkt": F.when(same_end, F.col("ab_pkt") + F.col("ba_pkt")).otherwise(0),
                "dst_to_src_byte": F.when(same_end, F.col("ab_byte") + F.col("ba_byte")).otherwise(0),
            }
        )
    )


def reverse_flow_totals(packets: DataFrame, scope: str) -> DataFrame:
    """Per directed flow, its own totals beside those of the reversed direction."""
    ends = ["src_ip", "src_port", "dst_ip", "dst_port"]
    totals = (
        flow_frames(packets)
        .groupBy(scope, "proto", *ends)
        .agg(F.count(F.lit(1)).alias("pkt"), F.sum("frame_len").alias("byte"))
    )
    reverse = totals.select(
        scope,
        "proto",
        F.col("dst_ip").alias("src_ip"),
        F.col("dst_port").alias("src_port"),
        F.col("src_ip").alias("dst_ip"),
        F.col("src_port").alias("dst_port"),
        F.col("pkt").alias("reverse_pkt"),
        F.col("byte").alias("reverse_byte"),
    )
    return totals.join(reverse, [scope, "proto", *ends], "left").fillna(0, ["reverse_pkt", "reverse_byte"])


def flow_flag_counts(packets: DataFrame, scope: str, counters: dict[str, str] | None = None) -> DataFrame:
    """TCP flag counters per flow; pass ``INTENDED_COUNTERS`` for unshifted names."""
    bits = tcp_flag_bits()
    counters = counters or FLAG_COUNTERS
    return (
        flow_frames(packets)
        .where(F.col("proto") == 6)
        .groupBy(scope, *FLOW_KEY)
        .agg(*[F.sum(bits[flag]).alias(name) for name, flag in counters.items()])
    )


def with_flow_features(frames: DataFrame) -> DataFrame:
    """Turn the running flow columns into the per-packet flow features (0 outside flows)."""
    n = F.col("flow_n").cast("double")
    base = F.col("flow_base_us")
    mean_off = F.col("flow_s1") / n
    variance = F.greatest(F.col("flow_s2") / n - mean_off * mean_off, F.lit(0.0))
    tcp = has_flow() & (F.col("proto") == 6)

    def flow_only(value: Column) -> Column:
        return F.when(has_flow(), value).otherwise(0.0)

    duration = seconds(F.col("flow_max_us") - F.col("flow_min_us"))
    features = {
        "flow_byte": F.when(has_flow(), F.col("flow_bytes")).otherwise(0),
        "flow_duration": flow_only(duration),
        "max_duration": flow_only(seconds("flow_max_us")),
        "min_duration": flow_only(seconds("flow_min_us")),
        "sum_duration": flow_only(n * seconds(base) + F.col("flow_s1") / 1e6),
        "average_duration": flow_only(seconds(base) + mean_off / 1e6),
        "std_duration": flow_only(F.sqrt(variance) / 1e6),
        "flow_idle_time": flow_only(seconds(F.col("flow_max_us") - F.coalesce("flow_second_us", F.lit(0)))),
        "flow_active_time": flow_only(duration),
    }
    features |= {
        name: F.when(tcp, F.col(f"run_{flag}")).otherwise(0) for name, flag in FLAG_COUNTERS.items()
    }
    return frames.withColumns(features)


def flow_running(packets: DataFrame, scope: str, *, bounded: bool = False, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Flow state after every packet of the flow."""
    frames = running(packets, scope, ["flow"], bounded=bounded, block_bits=block_bits)
    return with_flow_features(frames).where(has_flow())


def rate_carry_forward(frames: DataFrame, scope: str, earlier: DataFrame | None = None) -> DataFrame:
    """Rate, Srate, Drate of frames with flow features.

    With ``earlier`` (see ``earlier_rates``) the last known rates persist, as in batch
    mode; without it they fall to 0 on rows that have none, as in real time.

    Rates exist once a flow has a duration. Keys are sorted, so all packets of a flow
    count as source-to-destination; the reverse direction only exists when both
    endpoints are equal.
    """
    duration = F.nullif(F.col("flow_duration"), F.lit(0.0))
    n = F.col("flow_n").cast("double")
    same_end = (F.col("a_ip") == F.col("b_ip")) & (F.col("a_port") == F.col("b_port"))
    rated = frames.withColumns(
        {"_rate": n / duration, "_drate": F.when(duration.isNotNull(), F.when(same_end, n / duration).otherwise(0.0))}
    )
    rate, drate = "_rate", "_drate"
    if earlier is not None:
        rate, drate = "_kept_rate", "_kept_drate"
        rated = carry_last(rated, scope, {"_rate": rate, "_drate": drate}, earlier)
    zero = F.lit(0.0)
    return rated.withColumns(
        {"Rate": F.coalesce(rate, zero), "Srate": F.coalesce(rate, zero), "Drate": F.coalesce(drate, zero)}
    ).drop("_rate", "_drate", "_kept_rate", "_kept_drate")
