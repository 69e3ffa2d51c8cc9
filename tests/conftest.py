import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flowprism.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def packets(spark):
    from flowprism.sources.packets import packets_from_events

    rows = packets_from_events(spark, spark.read.parquet(f"{SF}/events.parquet")).cache()
    rows.count()
    return rows


PACKET_SCHEMA = (
    "capture_id string, seq bigint, ts_us bigint, eth_type int, src_mac string, dst_mac string, src_ip string, "
    "dst_ip string, src_port int, dst_port int, proto int, ttl int, frame_len int, tcp_flags int"
)


def packet(seq, ts_us, src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=80, proto=6, length=100, flags=0, eth=2048):
    if eth == 2054:
        src = dst = sport = dport = flags = None
        proto = 0
    elif proto not in (6, 17):
        sport = dport = flags = None
    elif proto == 17:
        flags = None
    return ("c", seq, ts_us, eth, "aa:aa:aa:aa:aa:aa", "bb:bb:bb:bb:bb:bb", src, dst, sport, dport, proto, 64, length, flags)


@pytest.fixture
def make_packets(spark):
    return lambda rows: spark.createDataFrame(rows, PACKET_SCHEMA)
