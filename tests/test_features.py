"""Hand-computed cases and properties of the packet features."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowprism.functions.packet import filter_ip_arp
from flowprism.operators.features import BATCH_COLUMNS, MODEL_COLUMNS, REALTIME_COLUMNS, extract_features
from flowprism.operators.flows import INTENDED_COUNTERS, flow_flag_counts, flow_running, flow_summary
from flowprism.operators.ordered import running
from flowprism.sources.packets import packets_from_events
from tests.conftest import SF, packet

S = 1_000_000


def features(df, mode="batch", **options):
    rows = extract_features(df, mode, "capture_id", **options).orderBy("seq").collect()
    return [row.asDict() for row in rows]


def test_column_lists():
    assert len(BATCH_COLUMNS) == len(REALTIME_COLUMNS) == 68
    assert len(MODEL_COLUMNS) == 54
    assert "Protocol Version" in BATCH_COLUMNS and "Correlation" in REALTIME_COLUMNS


def test_one_packet_flow_reports_its_own_time_as_idle(make_packets):
    (row,) = features(make_packets([packet(0, 5 * S)]))
    assert row["flow_idle_time"] == 5.0
    assert row["flow_duration"] == 0.0
    assert row["IAT"] == 5.0  # the first frame's gap is its own time
    assert row["std_duration"] == 0.0


def test_rates_of_a_zero_duration_flow_are_carried_in_batch_mode(make_packets):
    rows = [packet(0, 0), packet(1, 2 * S), packet(2, 3 * S, src="10.0.0.9", proto=17)]
    batch = features(make_packets(rows))
    assert [r["Rate"] for r in batch] == [0.0, 1.0, 1.0]
    live = features(make_packets(rows), "realtime")
    assert [r["Rate"] for r in live] == [0.0, 1.0, 0.0]
    assert [r["Drate"] for r in batch] == [0.0, 0.0, 0.0]


def test_group_of_twenty_restarts(make_packets):
    rows = features(make_packets([packet(i, i * S, length=60 + i) for i in range(23)]))
    assert [r["Number"] for r in rows] == [*range(1, 21), 1, 2, 3]
    assert rows[19]["Tot sum"] == sum(range(60, 80))
    assert rows[20]["Tot sum"] == 80 and rows[20]["Weight"] == 0


def test_direction_of_replies(make_packets):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [packet(0, 0, a, b), packet(1, 1, b, a), packet(2, 2, b, a), packet(3, 3, a, b)]
    out = features(make_packets(rows))
    # request in, two replies out, second request in
    assert [r["Weight"] for r in out] == [0, 1, 2, 4]


def test_arp_frames_join_the_direction_walk_only_in_batch_mode(make_packets):
    rows = [packet(0, 0, eth=2054), packet(1, 1, eth=2054), packet(2, 2)]
    batch = features(make_packets(rows))
    assert [r["Weight"] for r in batch] == [0, 1, 2]
    assert batch[0]["src_ip"] is None and batch[0]["src_port"] == 0
    live = features(make_packets(rows), "realtime")
    assert [r["Weight"] for r in live] == [0, 0, 0]
    assert live[0]["src_ip"] == "0" and live[2]["Magnitue"] == 10.0


def test_flag_counters_are_shifted(make_packets):
    rows = make_packets([packet(0, 0, flags=0x01), packet(1, 1, flags=0x14), packet(2, 2, flags=0x02)])
    (row,) = flow_flag_counts(rows, "capture_id").collect()
    assert (row["ack_count"], row["syn_count"], row["fin_count"], row["urg_count"], row["rst_count"]) == (1, 1, 1, 0, 1)
    (row,) = flow_flag_counts(rows, "capture_id", INTENDED_COUNTERS).collect()
    assert (row["fin_count"], row["rst_count"], row["ack_count"]) == (1, 1, 1)


def test_covariance_stops_at_the_shorter_list(make_packets):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [
        packet(0, 0, a, b, length=100),
        packet(1, 1, b, a, length=70),
        packet(2, 2, a, b, length=130),
        packet(3, 3, a, b, length=160),
    ]
    last = features(make_packets(rows), "realtime")[3]
    # incoming 100, 130, 160 (mean 130); outgoing 70 (mean 70): one pair
    assert last["Covariance"] == pytest.approx((100 - 130) * (70 - 70) / 3)
    assert last["Magnitue"] == pytest.approx(math.sqrt(130 + 70))
    assert last["Variance"] == 0 and last["Correlation"] == 0


def test_other_ether_types_are_no_rows(make_packets):
    rows = make_packets([packet(0, 0, eth=34525), packet(1, 1)])
    assert [r["seq"] for r in features(rows)] == [1]


def test_fragments_without_ports_belong_to_no_flow(make_packets):
    row = list(packet(0, S))
    row[8] = row[9] = row[13] = None
    (out,) = features(make_packets([tuple(row)]))
    assert out["TCP"] == 0 and out["flow_byte"] == 0 and out["src_port"] is None


def test_equal_endpoints_count_both_ways(make_packets):
    rows = [packet(i, i * S, "10.0.0.1", "10.0.0.1", 80, 80) for i in range(3)]
    assert features(make_packets(rows))[2]["Drate"] == pytest.approx(1.5)


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_blocks_do_not_change_results(packets, bits):
    """Carry rows: many small blocks give what one block gives."""
    whole = extract_features(packets, "batch", "day_id")
    cut = extract_features(packets, "batch", "day_id", block_bits=bits)
    keep = [c for c in whole.columns if c not in ("std_duration", "sum_duration", "average_duration")]

    def rows(df):
        exact = df.select(*[F.round(f"`{c}`", 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(f"`{c}`") for c in keep])
        near = df.orderBy("seq").select("std_duration", "sum_duration", "average_duration").collect()
        return exact.orderBy("seq").collect(), near

    (left, left_near), (right, right_near) = rows(whole), rows(cut)
    assert left == right
    for a, b in zip(left_near, right_near, strict=True):
        assert list(a) == pytest.approx(list(b), abs=2e-3)


def test_running_counts_survive_a_hot_address(make_packets):
    random.seed(1)
    rows = [packet(i, i * S, src="10.0.0.1" if random.random() < 0.7 else f"10.0.1.{i % 5}") for i in range(200)]
    df = make_packets(rows)
    out = running(df, "capture_id", ["scope", "src", "dst"], block_bits=3).orderBy("seq").collect()
    seen = {}
    for row, made in zip(out, rows, strict=True):
        seen[made[6]] = seen.get(made[6], 0) + 1
        assert (row["rn"], row["src_seen"], row["dst_seen"]) == (made[1] + 1, seen[made[6]], made[1] + 1)


def test_flow_summary_is_the_last_running_row(packets):
    frames = filter_ip_arp(packets)
    last = flow_running(frames, "day_id", block_bits=4)
    keys = ["day_id", "proto", "a_ip", "a_port", "b_ip", "b_port"]
    ends = last.groupBy(*keys).agg(
        F.max("flow_n").alias("packets"), F.max_by("flow_byte", "seq").alias("flow_byte"), F.max_by("flow_idle_time", "seq").alias("idle")
    )
    left = sorted(map(tuple, ends.select(*keys, "packets", "flow_byte", F.round("idle", 6)).collect()))
    whole = flow_summary(frames, "day_id").select(*keys, "packets", "flow_byte", F.round("flow_idle_time", 6))
    assert left == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("bits", [0, 1, 18])
def test_idle_time_of_frames_out_of_order(make_packets, bits):
    df = make_packets([packet(i, t * S) for i, t in enumerate([1, 5, 3, 5, 9])])
    idle = [r["flow_idle_time"] for r in flow_running(df, "capture_id", block_bits=bits).orderBy("seq").collect()]
    assert idle == [1, 4, 2, 0, 4]


def test_swapping_ends_keeps_the_flow(make_packets):
    df = make_packets([packet(0, 0), packet(1, S, "10.0.0.2", "10.0.0.1", 80, 1000)])
    rows = flow_summary(df, "capture_id").collect()
    assert len(rows) == 1 and rows[0]["packets"] == 2


def test_feature_plan_shuffles(spark, packets):
    """Real time: one shuffle on the batch. Batch: one on blocks, one on groups of 20."""
    live = extract_features(packets, "realtime", "batch_id")
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan
    rows = packets_from_events(spark, spark.read.parquet(f"{SF}/events.parquet"))
    batch = extract_features(rows, "batch", "day_id")._jdf.queryExecution().executedPlan().toString()
    assert batch.count("events.parquet") == 1  # the stored block summary read them once before
    assert batch.count("day_id") and "SinglePartition" not in batch


def test_a_task_holds_a_bounded_number_of_frames(spark, monkeypatch):
    """More frames make more tasks, not larger ones, whatever the engine would join."""
    from flowprism.operators import ordered
    from flowprism.session import stored

    monkeypatch.setattr(ordered, "TASK_FRAMES", 1 << 7)
    frames = filter_ip_arp(packets_from_events(spark, spark.read.parquet(f"{SF}/events.parquet")))
    frames = frames.unionByName(frames.withColumn("seq", F.col("seq") + 1000)).unionByName(frames.withColumn("seq", F.col("seq") + 2000))
    summary = stored(ordered.block_summary(frames, "day_id", 5), "blocks")
    out = running(frames, "day_id", ["scope", "flow"], block_bits=5, summary=summary)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == frames.count()
    assert out.rdd.getNumPartitions() >= sum(sizes) / 128 and max(sizes) <= 6 * 128, sizes
