"""The chain shuffles wide rows no more often than its steps need."""

import re

import pytest
from pyspark.sql import functions as F

from flowloom.operators import alerts, flows, hostwindows
from flowloom.plans import chain

EVENTS = ("capture_id string, frame_no long, ts_us long, flow_start long, src_ip string, dst_ip string, dst_port int, protocol string, "
          "packet_length long, is_new boolean, domains array<string>")
PACKETS = ("capture_id string, frame_no long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
           "packet_length long, payload_length long, tcp_flags array<string>, dns struct<queries:array<struct<name:string,type:int>>>, "
           "tls struct<record_version:int,cipher_suite_count:int,extension_count:int,ja3:string>, quic struct<version:long,long_header:boolean>")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stages(spark):
    rows = [("cap", i, 1_700_000_000_000_000 + i * 400_000, f"10.0.0.{i % 4}", "192.0.2.1", 40000 + i % 4, 443, "TCP", 100 + i, 60 + i, ["SYN"],
             None, None, None) for i in range(60)]
    return chain.Stages(spark.createDataFrame(rows, PACKETS))


def test_verdicts_do_not_join_snapshots_with_themselves(stages):
    """F1, F5, F8: one join, that of stored snapshots and their windows."""
    named = re.escape(stages.named_snapshots.inputFiles()[0].rsplit("/", 1)[0].rsplit("-", 1)[-1])
    assert stages.verdicts.count() == stages.named_snapshots.count()
    assert len(re.findall(r"^[ :+\-|]*Join ", plan_of(stages.verdicts), re.M)) <= 1 + plan_of(stages.windows).count("Join ")
    sources = [f for f in stages.verdicts.inputFiles() if re.search(named, f)]
    assert sources and len(set(sources)) == len(set(stages.named_snapshots.inputFiles()))


def test_roles_of_a_point_come_together_without_joins(spark):
    rows = [("cap", i, 1_700_000_000_000_000 + i, 0, "a", "b", 80, "TCP", 100, i == 0, []) for i in range(6)]
    events = hostwindows.with_widths(spark.createDataFrame(rows, EVENTS), [60])
    points = events.where("frame_no > 3").select("capture_id", "width_us", "src_ip", "dst_ip", "ts_us", F.col("frame_no").alias("trigger_frame"))
    found = hostwindows.temporal_snapshot(events, points)
    assert plan_of(found).count("Join Inner") == 0  # before: five, each with shuffles of its own
    assert {(r["trigger_frame"], r["packet_count"], r["target_packet_count"], r["total_window_packets"], r["inbound_bytes"]) for r in found.collect()} == {
        (4, 5, 5, 5, 0), (5, 6, 6, 6, 0)}


def test_points_without_a_host_have_no_windows(spark):
    rows = [("cap", i, 1_700_000_000_000_000 + i, 0, "a", "b", 80, "TCP", 100, i == 0, []) for i in range(3)]
    events = hostwindows.with_widths(spark.createDataFrame(rows, EVENTS), [60])
    points = spark.createDataFrame([("cap", 60_000_000, "a", "b", 1_700_000_000_000_002, 2), ("cap", 60_000_000, None, "b", 1_700_000_000_000_002, 2)],
                                   "capture_id string, width_us long, src_ip string, dst_ip string, ts_us long, trigger_frame long")
    assert [(r["src_ip"], r["packet_count"]) for r in hostwindows.temporal_snapshot(events, points).collect()] == [("a", 3)]


def test_every_snapshot_of_a_flow_at_a_trigger_is_told_beside_each_vector(stages):
    """Repeated flow rows: as many verdicts as a join by flow and trigger gives."""
    rows = stages.snapshot_rows.drop("contexts")
    one = rows.orderBy("flow_start", "trigger_frame").limit(1)
    twice = one.withColumn("flow_id", F.lit("x")).unionByName(one.withColumn("flow_id", F.lit("y")))
    got = chain.scored_snapshots(chain.with_contexts(twice)).select("flow_id").collect()
    assert sorted(r["flow_id"] for r in got) == ["x", "x", "y", "y"]


def test_a_flow_that_restarts_is_split_in_one_scan(spark):
    sessions = spark.createDataFrame(
        [("cap", "k", 0, i, i * 1_000_000, "wide") for i in range(10)] + [("cap", "j", 3, 3 + 100 * i, i, None) for i in range(3)],
        "capture_id string, flow_key string, session_start long, frame_no long, ts_us long, other string")
    found = flows.split_active(sessions, 4_000_000)
    assert {r["frame_no"]: r["flow_start"] for r in found.where("flow_key = 'k'").collect()} == {i: i // 4 * 4 for i in range(10)}
    assert [r["flow_start"] for r in found.where("flow_key = 'j'").collect()] == [3, 3, 3]
    assert found.columns == [*sessions.columns, "flow_start"] and found.where("other = 'wide'").count() == 10
    # Before: the starts were joined with all packets, and a running maximum joined them again with the sums of their chunks.
    assert len(re.findall(r"Join ", plan_of(found))) == 1 and "rightHint=(strategy=broadcast)" in plan_of(found)


def test_suppression_stores_times_not_ids(spark, monkeypatch):
    """the stage tables of the chain hold no ids; of alerts at one time the first in order is kept."""
    columns = ["threat_class", "source_ip", "destination_ip", "detector_id", "decision"]
    rows = [("C", "a", "b", "d", "ACCEPT", ts, flow, "w", f"{flow}-{ts}") for ts, flow in [(0, "f2"), (0, "f1"), (5, "f0"), (100, "f4"), (100, "f3")]]
    table = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in columns) + ", ts_us long, flow_id string, window_id string, alert_id string")
    stored = []
    from flowloom.operators import scan
    real = scan.checkpoint
    monkeypatch.setattr(scan, "checkpoint", lambda df: stored.append(df.dtypes) or real(df))
    found = alerts.dedupe_alerts(table, 50).collect()
    assert sorted(r["alert_id"] for r in found) == ["f1-0", "f3-100"]
    assert stored and not any("struct" in kind for dtypes in stored for _, kind in dtypes)
