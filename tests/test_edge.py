import math
import struct

import pytest
from pyspark.sql import functions as F

from granary.functions import frames as D
from granary.operators import agents


def test_doubles_from_bytes(spark):
    values = [0.0, -0.0, 1.5, -2.25, 1e308, 5e-324, 2.2250738585072014e-308, 1e-310, math.inf, -math.inf, math.pi, 1_700_000_000.123456]
    rows = [(k, b"\x01" + struct.pack(">d", v) + b"jpeg") for k, v in enumerate(values)] + [(98, b"\x01" + struct.pack(">d", math.nan)), (99, b"\x01abc")]
    df = spark.createDataFrame(rows, "k int, b binary").select("k", D.big_endian_double(F.col("b"), 2).alias("v"))
    got = {r.k: r.v for r in df.collect()}
    assert [struct.pack(">d", got[k]) for k in range(len(values))] == [struct.pack(">d", v) for v in values]
    assert math.isnan(got[98]) and got[99] is None


def test_frames(spark):
    rows = [("e", b"\x01" + struct.pack(">d", 12.5) + b"xyz"), ("e", b"\x0312.5"), ("e", b"\x02{}"), ("f", b"\x00[1]"), ("f", b"\x09?"), ("f", b"\x01"), ("f", None), ("f", b"\x03no number"), ("f", b"\x01abc")]
    df = spark.createDataFrame(rows, "edge_id string, data binary")
    got = {tuple(r) for r in D.frames(df).collect()}
    assert got == {
        ("e", "video", 12.5, 3, None, None), ("e", "heartbeat", None, None, 12.5, None), ("e", "sensor_data", None, None, None, "{}"), ("f", "json", None, None, None, "[1]"),
        ("f", None, None, None, None, None), ("f", "heartbeat", None, None, None, None), ("f", "video", None, 0, None, None),
    }
    assert D.frames(df.limit(0)).count() == 0


@pytest.mark.parametrize(("line", "first", "switches"), [
    ("DATA 0 CH1:1500 CH10:-3 SW:0001000", (1500, -3), [False] * 3 + [True] + [False] * 3), ("DATA 1 CH1:1 CH1:2 CH11:9 CH0:4", (2, None), None), ("DATA 1 CH1:7 CH1:x SW:01", (7, None), None), ("DATA 1", None, None),
    ('{"channels": [5, 6], "switches": [true]}', (5, None), [True]), ('{"switches": [true]}', None, None), ("noise", None, None), (None, None, None),
])
def test_packets(spark, line, first, switches):
    p = spark.createDataFrame([(line,)], "l string").select(D.control_packet(F.col("l")).alias("p")).first().p
    assert (p is None) == (first is None)
    if p is not None:
        assert (p.channels[0], p.channels[9]) == first and p.switches == switches


def test_registry(spark):
    log = [("a", 1, 1, "register", ["x"]), ("a", 5, 2, "heartbeat", None), ("a", 6, 3, "register", ["x", "y"]), ("b", 1, 4, "register", ["y", "y"]), ("b", 2, 5, "unregister", None), ("c", 1, 6, "heartbeat", None), ("d", 3, 7, "unregister", None), ("d", 3, 8, "register", None), ("d", 9, 9, "heartbeat", None), (None, 1, 10, "register", ["x"])]
    df = spark.createDataFrame(log, "agent string, ts long, event_id long, kind string, capabilities array<string>").withColumn("ts", F.timestamp_seconds("ts"))
    state = {r.agent: r for r in agents.registry(df, timeout=4.0).collect()}
    assert set(state) == {"a", "d"} and state["a"].capabilities == ["x", "y"] and state["a"].replaced == 1 and state["a"].last_seen is None
    assert state["d"].healthy and state["a"].healthy and not {r.agent: r for r in agents.registry(df, timeout=3.0).collect()}["a"].healthy
    early = agents.registry(df, F.timestamp_seconds(F.lit(1)))
    assert {r.agent for r in early.collect()} == {"a", "b"} and {r.agent for r in agents.discover(early, "y").collect()} == {"b"}
    index = {r.capability: (r.n, r.agents) for r in agents.capability_index(early).collect()}
    assert index == {"x": (1, ["a"]), "y": (1, ["b"])} and agents.registry(df.limit(0)).count() == 0
