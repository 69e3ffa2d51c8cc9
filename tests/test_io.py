"""Frames, captures, events and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowprism.functions import events as E
from flowprism.functions import labels as L
from flowprism.functions.packet import filter_ip_arp
from flowprism.functions.wire import decode_frames, encode_frames, malformed_count
from flowprism.operators import joins
from flowprism.operators.features import extract_features
from flowprism.sources.captures import read_packets, write_capture
from flowprism.sources.packets import packets_from_events
from flowprism.streaming import pipeline
from tests.conftest import SF


def frame(*, vlan=False, proto=6, offset=0, sport=1234, dport=80, flags=0x12, options=0, pad=0, cut=None):
    tag = b"\x81\x00\x00\x05" if vlan else b""
    l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)
    if proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, 8, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45 + options, 0, 20 + 4 * options + len(l4), 0, offset, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([192, 168, 20, 7]))
    whole = bytes.fromhex("aabbccddeeff112233445566") + tag + b"\x08\x00" + ip + b"\x00" * 4 * options + l4 + b"\x00" * pad
    return whole[:cut]


CASES = {
    "plain": (frame(), dict(src_port=1234, tcp_flags=0x12, frame_len=54, src_ip="10.0.0.1", dst_ip="192.168.20.7", ttl=64)),
    "tagged": (frame(vlan=True), dict(src_port=1234, eth_type=2048, frame_len=58)),
    "options": (frame(options=2), dict(dst_port=80, frame_len=62)),
    "padded": (frame(proto=17, pad=18), dict(src_port=1234, tcp_flags=None, frame_len=42)),
    "fragment": (frame(offset=5), dict(src_port=None, proto=6, tcp_flags=None)),
    "cut": (frame(cut=40), dict(src_port=None, src_ip="10.0.0.1", frame_len=40)),
    "short": (b"\x01\x02", None),
}


def test_decode_cases(spark):
    df = spark.createDataFrame([(name, bytearray(raw)) for name, (raw, _) in CASES.items()], "name string, frame binary")
    got = {r["name"]: r.asDict() for r in decode_frames(df).collect()}
    for name, (_, expected) in CASES.items():
        if expected is None:
            assert name not in got
        else:
            assert {k: got[name][k] for k in expected} == expected, name
    assert got["plain"]["src_mac"] == "11:22:33:44:55:66"
    assert tuple(malformed_count(df).first()) == (6, 1)


def test_captures_round_trip(spark, packets, tmp_path):
    frames = encode_frames(filter_ip_arp(packets)).orderBy("seq").select("ts_us", "frame").collect()
    half = len(frames) // 2
    write_capture([(r["ts_us"], bytes(r["frame"])) for r in frames[:half]], str(tmp_path / "a.pcap"))
    write_capture([(r["ts_us"], bytes(r["frame"])) for r in frames[half:]], str(tmp_path / "b.pcap"))
    with open(tmp_path / "b.pcap", "ab") as out:
        out.write(b"\x00" * 20)
    (tmp_path / "other.txt").write_text("no capture")
    back = read_packets(spark, str(tmp_path)).orderBy("capture_id", "seq").collect()
    # what was appended is an empty record, which decoding drops, and a cut-off one
    assert [r["ts_us"] for r in back] == [r["ts_us"] for r in frames]


def test_label_helpers(spark):
    df = spark.createDataFrame([("2.1 M",), ("0.7 M",), ("15",), ("bad",), (None,), ("M",), (" 7 ",)], "b string")
    assert [r[0] for r in df.select(L.parse_bytes("b")).collect()] == [2100000, int(0.7 * 10**6), 15, 0, 0, 0, 7]
    kinds = spark.createDataFrame([("0_normal",), ("normal",), ("TCP",)], "label string")
    kept = kinds.where(L.is_known_class(F.col("label"), "oneclass")).collect()
    assert [r[0] for r in kept] == ["0_normal", "normal"]


def test_event_addresses_and_zones(spark):
    rows = [("192.168.111.4",), ("",), ("0",), (None,), ("1234",), ("192.168.40.9",), ("8.8.8.8",)]
    df = spark.createDataFrame(rows, "ip string")
    out = [tuple(r) for r in df.select(E.clean_ip(F.col("ip")), E.zone_of_ip("ip")).collect()]
    none = ("0.0.0.0", "Unknown")
    assert out == [("192.168.111.4", "WAN"), none, none, none, none, ("192.168.40.9", "DMZ"), ("8.8.8.8", "Unknown")]


def test_labels_follow_the_attackers_of_the_segment(spark):
    columns = "seq bigint, ts_us bigint, eth_type int, proto int, src_mac string, dst_mac string"
    rows = [(1, 10, 2048, 6, "x", "a"), (2, 10, 2048, 6, "b", "x"), (3, 60, 2048, 17, "b", "x"), (4, 60, 2048, 1, "x", "c"), (5, 60, 2048, 6, "a", None), (6, 120, 2054, 0, "a", "b"), (7, 999, 2048, 6, "a", "b")]
    segments = spark.createDataFrame([("in", 0, 50), ("out", 51, 100), ("calm", 101, 200)], "name string, start_us bigint, end_us bigint")
    attackers = spark.createDataFrame([("in", "a"), ("out", "b"), ("out", "c"), ("calm", None)], "name string, mac string")
    packets = spark.createDataFrame(rows, columns)
    out = joins.label_by_segment(packets, segments, attackers)
    assert {r["seq"]: r["label"] for r in out.collect()} == {1: "TCP", 2: "benign", 3: "UDP", 4: "ICMP", 5: "benign", 6: "benign", 7: None}
    assert out.columns == [*packets.columns, "name", "label"]
    assert joins.label_by_segment(packets.limit(0), segments, attackers).count() == 0


def test_segment_join_keeps_unmatched_packets(spark):
    packets = spark.createDataFrame([(i, i * 1_000_000) for i in range(10)], "seq bigint, ts_us bigint")
    segments = spark.createDataFrame([("a", 1_000_000, 3_000_000), ("b", 5_000_000, 5_500_000)], "name string, start_us bigint, end_us bigint")
    rows = joins.segment_range_join(packets, segments, 2_000_000).orderBy("seq").collect()
    assert [r["name"] for r in rows] == [None, "a", "a", "a", None, "b", None, None, None, None]


def test_attackers_and_complement_cover_everything(spark, packets):
    macs = spark.createDataFrame([(L.ATTACKER_INSIDE,)], "mac string")
    hit, rest = joins.attacker_rows(packets, macs), joins.attacker_rows(packets, macs, complement=True)
    assert hit.count() + rest.count() == packets.count() and hit.count() > 0
    assert hit.columns == packets.columns


@pytest.fixture
def files(spark, packets, tmp_path):
    """The packets cut into files at batch borders, so a stream sees several micro-batches."""
    for part in range(5):
        piece = packets.where(F.floor(F.col("batch_id") / 2) == part)
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stream_features_equal_batch(spark, packets, files, tmp_path):
    stream = pipeline.read_packet_stream(spark, files, packets.schema, max_files=1)
    out = str(tmp_path / "out")
    pipeline.finish(pipeline.start(stream, pipeline.feature_batches(out), str(tmp_path / "state")))
    live = spark.read.parquet(out)
    assert live.select("epoch").distinct().count() > 1
    whole = extract_features(packets, "realtime", "batch_id")
    assert sorted(map(tuple, live.select(*whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_batches_cut_by_files_wait_for_the_rest(spark, packets, tmp_path):
    """Files of 250 packets cut every third batch; 30 packets of the last batch never come."""
    for part in range(4):
        low, high = 250 * part, min(250 * (part + 1), 970)
        packets.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipeline.read_packet_stream(spark, str(tmp_path / "in"), packets.schema, max_files=1)
    out = str(tmp_path / "out")
    whole = pipeline.WholeBatches(pipeline.feature_batches(out), str(tmp_path / "waiting"))
    pipeline.finish(pipeline.start(stream, whole, str(tmp_path / "state")))
    assert spark.read.parquet(out).where("batch_id = 9").count() == 0
    whole.flush(spark)
    expected = extract_features(packets.where("seq < 970"), "realtime", "batch_id")
    live = spark.read.parquet(out).select(*expected.columns)
    assert sorted(map(tuple, live.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_flow_state_of_frames_out_of_order():
    import pandas as pd

    rows = pd.DataFrame({"seq": range(4), "ts_us": [1_000_000, 5_000_000, 3_000_000, 5_000_000], "flow_byte": 10, **{c: 1 for c in pipeline.FLAG_COUNTERS}})
    whole, end = pipeline._advance_flow(rows, None)
    assert list(whole["flow_idle_time"]) == [1, 4, 2, 0] and list(whole["flow_duration"]) == [0, 4, 4, 4]
    first, state = pipeline._advance_flow(rows[:2], None)
    rest, same = pipeline._advance_flow(rows[2:], state)
    assert same == end and pd.concat([first, rest]).reset_index(drop=True).equals(whole)


def test_flow_state_continues_over_micro_batches(spark, packets, files, tmp_path):
    from flowprism.operators.flows import flow_running

    stream = filter_ip_arp(pipeline.read_packet_stream(spark, files, packets.schema, max_files=1))
    rows = pipeline.flow_state(stream, "day_id", "60 days")
    query = (
        rows.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    pipeline.finish(query)
    got = {r["seq"]: (r["flow_n"], r["flow_byte"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    expected = flow_running(filter_ip_arp(packets), "day_id").select("seq", "flow_n", "flow_byte").collect()
    assert got == {r["seq"]: (r["flow_n"], r["flow_byte"]) for r in expected}


def test_flow_totals_stream_updates(spark, packets, files, tmp_path):
    stream = filter_ip_arp(pipeline.read_packet_stream(spark, files, packets.schema, max_files=2))
    query = (
        pipeline.flow_totals(stream, "day_id", "60 days").writeStream.format("memory").queryName("totals").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    pipeline.finish(query)
    flows = filter_ip_arp(packets).where("proto in (6, 17)").count()
    assert spark.table("totals").agg(F.sum("flow_n")).first()[0] == flows


def test_bounded_stream_stops(spark, packets, files, tmp_path):
    stream = pipeline.bounded(pipeline.read_packet_stream(spark, files, packets.schema, max_files=1).select("seq"), 120)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    assert pipeline.finish(query, 60)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 120


def test_events_view_matches_schema(spark):
    rows = packets_from_events(spark, spark.read.parquet(f"{SF}/events.parquet"))
    assert rows.where("eth_type = 2054 and src_ip is not null").count() == 0


def test_bad_captures(spark, tmp_path):
    from flowprism.sources.captures import capture_problems, read_frames

    frames = [(1_000_000 * i, b"\x00" * 60) for i in range(5)]
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        write_capture(frames, str(tmp_path / folder / "x.pcap"))
    assert read_frames(spark, str(tmp_path)).select("capture_id").distinct().count() == 2
    whole = (tmp_path / "a" / "x.pcap").read_bytes()
    (tmp_path / "a" / "cut.pcap").write_bytes(whole[:-7])
    assert read_frames(spark, str(tmp_path)).count() == 14
    (tmp_path / "a" / "new.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + b"\x00" * 40)
    with pytest.raises(Exception, match="pcap"):
        read_frames(spark, str(tmp_path)).count()
    assert read_frames(spark, str(tmp_path), on_bad="report").count() == 14
    found = {r["path"].rsplit("/", 1)[-1]: (r["problem"], r["frames"]) for r in capture_problems(spark, str(tmp_path)).collect()}
    assert found == {"cut.pcap": ("ends inside a record", 4), "new.pcap": ("not a classic capture file", 0)}


def test_one_capture_is_read_in_pieces(spark, tmp_path):
    """Pieces give the rows of one task; payloads that look like records do not mislead, and long frames span pieces."""
    from flowprism.sources.captures import read_frames

    rng = np.random.default_rng(1)
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 5, 40, 40) + b"x" * 40 for _ in range(120))
    frames = []
    for i in range(900):
        size = int(rng.integers(60, 1500))
        data = inner if i % 40 == 7 else b"\x01" * 50_000 if i == 400 else rng.integers(0, 256, size, dtype=np.uint8).tobytes()
        frames.append((1_700_000_000_000_000 + 1000 * i, data))
    write_capture(frames, str(tmp_path / "long.pcap"))
    write_capture(frames[:3], str(tmp_path / "short.pcap"))
    write_capture([], str(tmp_path / "empty.pcap"))
    (tmp_path / "cut.pcap").write_bytes((tmp_path / "long.pcap").read_bytes()[:-7])
    pieces = read_frames(spark, str(tmp_path), piece_bytes=9_000)
    assert pieces.rdd.getNumPartitions() > 50
    got = {}
    for r in pieces.orderBy("capture_id", "seq").collect():
        got.setdefault(r["capture_id"].rsplit("/", 1)[-1], []).append((r["seq"], r["ts_us"], bytes(r["frame"])))
    want = [(i, *f) for i, f in enumerate(frames)]
    assert got == {"long.pcap": want, "short.pcap": want[:3], "cut.pcap": want[:-1]}


@pytest.mark.parametrize("order", ["<", ">"])
def test_captures_in_block_form(spark, tmp_path, order):
    from flowprism.sources.captures import capture_problems, read_frames

    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        size = struct.pack(order + "I", len(body) + 12)
        return struct.pack(order + "I", kind) + size + body + size

    def interface(option=b""):
        return block(1, struct.pack(order + "HHI", 1, 0, 100) + option)

    section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    nanos = struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HHq", 14, 8, 100) + struct.pack(order + "HH", 0, 0)

    def packet(number, ticks, data):
        return block(6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)

    whole = section + interface() + interface(nanos) + packet(0, 1_700_000_000_000_007, b"a" * 61) + block(5, b"statistics!!")
    whole += packet(1, 1_700_000_000_000_009_000, b"b" * 64) + block(3, struct.pack(order + "I", 200) + b"c" * 100)
    (tmp_path / "x.pcap").write_bytes(whole)
    (tmp_path / "cut.pcap").write_bytes(whole[:-5])
    want = [(0, 1_700_000_000_000_007, b"a" * 61), (1, 1_700_000_100_000_009, b"b" * 64), (2, None, b"c" * 100)]
    for piece_bytes in (100, 1 << 20):
        rows = read_frames(spark, str(tmp_path), piece_bytes=piece_bytes).orderBy("capture_id", "seq").collect()
        got = {}
        for r in rows:
            got.setdefault(r["capture_id"].rsplit("/", 1)[-1], []).append((r["seq"], r["ts_us"], bytes(r["frame"])))
        assert got == {"x.pcap": want, "cut.pcap": want[:2]}
    found = {r["path"].rsplit("/", 1)[-1]: (r["problem"], r["frames"]) for r in capture_problems(spark, str(tmp_path)).collect()}
    assert found == {"cut.pcap": ("ends inside a record", 2)}


def test_short_pieces_share_tasks(spark, tmp_path):
    """Hundreds of short pieces are read by a bounded number of tasks, with the same frames and numbers."""
    from flowprism.sources.captures import read_frames, write_capture

    frames = [(1_700_000_000_000_000 + i, bytes([i % 251]) * (60 + i % 200)) for i in range(3000)]
    write_capture(frames, str(tmp_path / "one.pcap"))
    out = read_frames(spark, str(tmp_path), piece_bytes=1024)
    assert out.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    got = out.orderBy("seq").collect()
    assert [(r["ts_us"], bytes(r["frame"])) for r in got] == frames
    assert len({r["seq"] for r in got}) == len(frames)
