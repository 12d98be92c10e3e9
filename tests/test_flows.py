"""Flows against a plain step-by-step model of the same rules, on small and on planted data."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowloom.fixed import ACTIVE_US, IDLE_US
from flowloom.operators import flows, packets, scan
from flowloom.plans import chain, inputs

SCHEMA = (
    "capture_id string, frame_no long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol string, packet_length long, payload_length long, tcp_flags array<string>, "
    "dns struct<queries:array<struct<name:string,type:int>>>, tls struct<record_version:int,ja3:string>, "
    "quic struct<version:long,long_header:boolean>"
)
T0 = 1_788_256_800_000_000


def packet(frame, offset_us, src, dst, sport=50000, dport=443, protocol="TCP", length=60, payload=10, flags=("ACK",), dns=None):
    named = {"queries": [{"name": dns, "type": 1}]} if dns else None
    return ("cap", frame, T0 + offset_us, src, dst, sport, dport, protocol, length, payload,
            list(flags) if flags is not None else None, named, None, None)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(n, seed, hosts=4):
    rng = random.Random(seed)
    now, rows = 0, []
    for i in range(n):
        now += rng.choice([0, 1, 500_000, 1_000_000, 7_000_000, 30_000_000, 59_999_999])
        late = rng.random() < 0.05
        a, b = rng.sample(range(1, hosts + 1), 2)
        rows.append(packet(i * 3, now - (20_000_000 if late else 0), f"10.0.0.{a}", f"10.0.0.{b}",
                           sport=5000, dport=5000, length=60 + rng.randrange(40)))
    return rows


def model_flows(rows):
    """Direct reading of the rules: drop late packets, close by idle or active limit, count per flow."""
    seen, table, out, number = None, {}, {}, 0
    for r in sorted(rows, key=lambda x: x[1]):
        _, frame, ts, src, dst, sport, dport, protocol, length = r[:9]
        if seen is not None and ts < seen:
            continue
        seen = ts
        ends = sorted([(src, sport), (dst, dport)], key=lambda e: ([int(x) for x in e[0].split(".")], e[1]))
        key = (*ends[0], *ends[1], protocol)
        flow = table.get(key)
        if flow is None or ts - flow["last"] >= IDLE_US or ts - flow["start"] >= ACTIVE_US:
            text = "\x1f".join(map(str, (ends[0][0], ends[0][1], ends[1][0], ends[1][1], protocol, ts // 60_000_000, number)))
            flow = {"start": ts, "first": frame, "id": "flow-" + hashlib.sha256(text.encode()).hexdigest()[:24],
                    "sizes": [], "ab": 0}
            table[key], out[frame], number = flow, flow, number + 1
        flow["last"] = ts
        flow["sizes"].append(length)
        flow["ab"] += (src, sport) == ends[0]
    return {f["id"]: (f["first"], f["start"], f["last"], len(f["sizes"]), f["ab"], sum(f["sizes"])) for f in out.values()}


@pytest.mark.parametrize("chunk", [1 << 17, 7])
def test_flows_equal_the_rules(spark, chunk):
    rows = random_rows(400, seed=chunk)
    ordered = packets.canonical_endpoints(packets.drop_out_of_order(frame_of(spark, rows), chunk))
    fp = flows.assign_flows(ordered, chunk_frames=chunk)
    got = flows.aggregate_flows(fp).join(flows.flow_identities(fp, chunk), flows.FLOW).collect()
    found = {
        r["flow_id"]: (r["flow_start"], r["start_us"], r["last_seen_us"], r["packets_a_to_b"] + r["packets_b_to_a"],
                       r["packets_a_to_b"], r["bytes_a_to_b"] + r["bytes_b_to_a"])
        for r in got
    }
    assert found == model_flows(rows)


@pytest.mark.parametrize("widths,span", [(16, 5000), (1, 5000), (3, 60_000)])
def test_greedy_chain_equals_the_rule(spark, monkeypatch, widths, span):
    monkeypatch.setattr(scan, "CHAIN_WIDTHS", widths)
    rng = random.Random(widths + span)
    rows, expected = [], set()
    for key in [0, 1, None]:
        times = sorted(rng.randrange(-span // 2, span) for _ in range(300))
        last = None
        for pos, t in enumerate(times):
            rows.append((key, t, pos))
            if last is None or t - last >= 70:
                expected.add((key, t))
                last = t
    df = spark.createDataFrame(rows, "k int, ts_us long, pos long")
    got = scan.greedy_chain(df, ["k"], 70).collect()
    assert {(r["k"], r["ts_us"]) for r in got} == expected
    assert all(r["pos"] == min(p for k, t, p in rows if (k, t) == (r["k"], r["ts_us"])) for r in got)


def test_other_protocols_and_hidden_names(spark, sf):
    derived = inputs.packets(spark, sf)
    stages = chain.Stages(derived)
    assert stages.flow_packets.where("protocol = 'OTHER'").count() == 0
    log = {r["status"]: r["count"] for r in stages.frame_log.groupBy("status").count().collect()}
    assert log["skipped"] == derived.where("protocol = 'OTHER'").count() > 0
    assert sum(log.values()) == derived.count()
    name = F.when(F.col("frame_no") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("dns.queries")[0]["name"])
    hidden = F.struct(F.array(F.struct(name.alias("name"), F.lit(1).alias("type"))).alias("queries"))
    some = chain.Stages(derived.withColumn("dns", F.when(F.col("dns").isNotNull(), hidden)))
    asked = some.snapshot_rows.where("dns is not null")
    vectors = some.dns()
    assert vectors.count() == asked.count()
    nameless = asked.where("dns.queries[0].name is null").count()
    assert vectors.where("feature__query_frequency is null").count() == nameless > 0


def test_idle_boundary_is_inclusive(spark):
    rows = [packet(1, 0, "10.0.0.1", "10.0.0.2"), packet(2, IDLE_US - 1, "10.0.0.2", "10.0.0.1", 443, 50000),
            packet(3, 2 * IDLE_US - 1, "10.0.0.1", "10.0.0.2")]
    fp = flows.assign_flows(packets.canonical_endpoints(frame_of(spark, rows)))
    assert [r["flow_start"] for r in fp.orderBy("frame_no").collect()] == [1, 1, 3]


def test_syn_and_syn_ack_make_one_flow(spark):
    rows = [packet(1, 0, "10.0.0.15", "10.0.0.20", flags=("SYN",)),
            packet(2, 100_000, "10.0.0.20", "10.0.0.15", 443, 50000, flags=("SYN", "ACK"))]
    flow = flows.aggregate_flows(flows.assign_flows(packets.canonical_endpoints(frame_of(spark, rows)))).collect()
    assert len(flow) == 1
    assert (flow[0]["packets_a_to_b"], flow[0]["packets_b_to_a"]) == (1, 1)
    assert flow[0]["tcp_flag_counts"] == {"SYN": 2, "ACK": 1}
    assert flow[0]["inter_arrival_stats"]["count"] == 1 and flow[0]["a_is_initiator"]


def test_icmp_has_no_ports_and_same_endpoint_is_forward(spark):
    rows = [packet(1, 0, "10.0.0.9", "10.0.0.1", None, None, "ICMP", flags=None, payload=None),
            packet(2, 1, "10.0.0.1", "10.0.0.1", 7, 7)]
    got = packets.canonical_endpoints(frame_of(spark, rows)).orderBy("frame_no").collect()
    assert (got[0]["a_ip"], got[0]["direction"]) == ("10.0.0.1", "B_TO_A")
    assert got[1]["direction"] == "A_TO_B"


def model_snapshots(rows):
    """Engine order at one packet: flow update, closes, then the clock tick over changed flows."""
    seen, table, counts, dirty, done, next_tick, out = None, {}, {}, set(), {}, None, []

    def emit(frame, when, trigger, reason):
        if counts[frame]["n"] != done.get(frame):
            done[frame] = counts[frame]["n"]
            out.append((frame, counts[frame]["n"], when, trigger, reason))

    last_frame = None
    for r in sorted(rows, key=lambda x: x[1]):
        _, frame, ts, src, dst, sport, dport, protocol = r[:8]
        if seen is not None and ts < seen:
            continue
        seen, last_frame = ts, frame
        closed = [(k, f) for k, f in table.items() if ts - counts[f]["last"] >= IDLE_US]
        key = (*sorted([(src, sport), (dst, dport)]), protocol)
        for k, _f in closed:
            del table[k]
        reasons = [(f, "idle") for _, f in closed]
        if key in table and ts - counts[table[key]]["start"] >= ACTIVE_US:
            reasons.append((table.pop(key), "active"))
        if key not in table:
            table[key] = frame
            counts[frame] = {"n": 0, "start": ts, "last": ts}
        counts[table[key]]["n"] += 1
        counts[table[key]]["last"] = ts
        dirty.add(table[key])
        for f, reason in reasons:
            emit(f, ts, frame, reason)
            dirty.discard(f)
        if next_tick is None:
            next_tick = ts + 1_000_000
        if ts >= next_tick:
            for f in list(dirty):
                if counts[f]["n"] >= 2:
                    emit(f, ts, frame, "tick")
                    dirty.discard(f)
            next_tick = ts + 1_000_000
    for f in table.values():
        emit(f, seen, last_frame, "end")
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshots_equal_the_rules(spark, seed):
    rows = random_rows(250, seed, hosts=3)
    ordered = packets.canonical_endpoints(packets.drop_out_of_order(frame_of(spark, rows)))
    fp = flows.assign_flows(ordered)
    closes = flows.flow_close_events(fp, flows.aggregate_flows(fp))
    ticks = flows.snapshot_ticks(fp)
    got = flows.flow_snapshots(fp, closes, ticks).collect()
    found = sorted((r["flow_start"], r["packet_count"], r["observed_us"], r["trigger_frame"], r["snapshot_reason"]) for r in got)
    assert found == model_snapshots(rows)
    assert flows.changed_only(flows.flow_snapshots(fp, closes, ticks)).count() == len(got)


def test_flow_totals_are_kept_packets(spark):
    rows = random_rows(200, 9)
    kept = packets.drop_out_of_order(frame_of(spark, rows))
    total = flows.aggregate_flows(flows.assign_flows(packets.canonical_endpoints(kept))).agg(
        F.sum(F.col("packets_a_to_b") + F.col("packets_b_to_a"))).first()[0]
    assert total == kept.count()
