"""Host windows against a brute-force scan of the events, and feature values of known cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.functions import values
from flowloom.operators import features, hostwindows
from tests.test_flows import T0

EVENTS = (
    "capture_id string, frame_no long, ts_us long, flow_start long, src_ip string, dst_ip string, dst_port int, "
    "protocol string, packet_length long, is_new boolean, domains array<string>"
)


def make_events(n, seed):
    rng = random.Random(seed)
    rows, now, seen = [], T0, set()
    for i in range(n):
        now += rng.choice([0, 0, 1, 400_000, 900_000, 3_000_000, 10_000_000])
        src, dst = rng.sample("abcd", 2)
        flow = rng.randrange(12)
        names = [f"n{rng.randrange(3)}"] * rng.randrange(3) if rng.random() < 0.4 else []
        rows.append(("cap", i * 2, now, flow, src, dst, rng.choice([None, 53, 80]), rng.choice(["TCP", "UDP"]),
                     60 + rng.randrange(50), flow not in seen or rng.random() < 0.3, names))
        seen.add(flow)
    return rows


def brute(rows, src, dst, t, trigger, width):
    inside = [r for r in rows if r[1] <= trigger and t - width <= r[2] <= t]
    out = [r for r in inside if r[4] == src]
    target = [r for r in inside if r[5] == dst]
    new = [r for r in out if r[9]]
    spans = {}
    for r in out:
        spans.setdefault(r[3], [r[2], r[2]])[1] = r[2]
    bins = Counter(r[2] // 1_000_000 for r in target)
    entropy = lambda c: -sum(n / sum(c.values()) * math.log2(n / sum(c.values())) for n in c.values()) if c else 0.0
    conns = [r[2] for r in new if r[5] == dst]
    names = [d for r in out for d in r[10]]
    mean = sum(bins.values()) / len(bins) if bins else 0
    return {
        "packet_count": len(out), "byte_count": sum(r[8] for r in out), "flow_count": len(new),
        "unique_destinations": len({r[5] for r in out}), "unique_destination_ports": len({r[6] for r in out} - {None}),
        "inbound_bytes": sum(r[8] for r in inside if r[5] == src), "target_packet_count": len(target),
        "unique_sources": len({r[4] for r in target}), "udp_packets": sum(r[7] == "UDP" for r in target),
        "window_flows": len(spans), "short_flows": sum(b - a <= 2_000_000 for a, b in spans.values()),
        "domain_count": len(names), "unique_domains": len(set(names)), "total_window_packets": len(inside),
        "connection_count": len(conns), "first_us": out[0][2] if out else 0,
        "connection_gaps": conns[-1] - conns[0] if conns else 0,
        "connection_gaps2": sum((b - a) ** 2 for a, b in zip(conns, conns[1:])),
        "destination_entropy": entropy(Counter(r[5] for r in new)),
        "source_entropy": entropy(Counter(r[4] for r in target)),
        "burstiness": math.sqrt(sum((v - mean) ** 2 for v in bins.values()) / len(bins)) / mean if len(bins) >= 2 else None,
    }


@pytest.mark.parametrize("width_s", [10, 60])
def test_every_measure_equals_brute_force(spark, width_s):
    rows = make_events(150, width_s)
    rng = random.Random(3)
    asked = {(rng.choice("abcde"), rng.choice("abcde"), *rng.choice([(r[2], r[1]) for r in rows])) for _ in range(60)}
    asked |= {("a", "b", rows[-1][2] + 5_000_000, rows[-1][1])}  # a time after the last packet
    events = hostwindows.with_widths(spark.createDataFrame(rows, EVENTS), [width_s])
    points = spark.createDataFrame([("cap", width_s * 1_000_000, *p) for p in asked],
                                   "capture_id string, width_us long, src_ip string, dst_ip string, ts_us long, trigger_frame long")
    snapshot = hostwindows.temporal_snapshot(events, points).withColumn(
        "destination_entropy", values.entropy_from_sums(F.col("flow_count"), F.col("destination_nlogn"))
    ).withColumn("source_entropy", values.entropy_from_sums(F.col("target_packet_count"), F.col("source_nlogn"))).withColumn(
        "burstiness", hostwindows.burstiness(F.col("target_packet_count"), F.col("bins"), F.col("bin_squares")))
    got = snapshot.collect()
    assert len(got) == len(asked)
    for r in got:
        expected = brute(rows, r["src_ip"], r["dst_ip"], r["ts_us"], r["trigger_frame"], width_s * 1_000_000)
        for name, value in expected.items():
            assert (r[name] == pytest.approx(value, abs=1e-9)) if value is not None else r[name] is None, (name, r)


def test_window_is_closed_at_both_ends(spark):
    rows = [("cap", i, T0 + i * 10_000_000, 1, "a", "b", 80, "TCP", 100, i == 0, []) for i in range(8)]
    events = hostwindows.with_widths(spark.createDataFrame(rows, EVENTS), [60])
    points = events.select("capture_id", "width_us", "src_ip", "ts_us", F.col("frame_no").alias("trigger_frame"))
    got = {r["trigger_frame"]: r["packet_count"] for r in hostwindows.source_windows(events, points, {"packet_count"}).collect()}
    assert [got[i] for i in range(8)] == [1, 2, 3, 4, 5, 6, 7, 7]


def test_widths_must_be_positive(spark):
    with pytest.raises(ValueError):
        hostwindows.with_widths(spark.range(1), [0, 10])


def test_periodicity_from_list(spark):
    second = 1_000_000
    df = spark.createDataFrame([([0, second],), ([0, second, 2 * second],), ([5, 5, 5],), ([0, second, 3 * second],)], "t array<long>")
    p = values.periodicity(F.col("t"))
    got = df.select(*[v.alias(n) for n, v in p.items()]).collect()
    assert tuple(got[0]) == (None, None, None)
    assert tuple(got[1]) == (1.0, 0.0, 1.0)
    assert tuple(got[2]) == (0.0, None, 0.0)
    assert got[3]["mean_connection_interval"] == 1.5 and got[3]["connection_interval_cv"] == pytest.approx(1 / 3)


def test_offline_and_live_formulas_agree(spark):
    """Payloads 10, 20 out and 30, 40 in, one second apart."""
    from flowloom.operators import flows, packets
    from tests.test_flows import frame_of, packet

    rows = [packet(i, i * 1_000_000, *(("10.0.0.1", "10.0.0.2", 5, 443) if i < 2 else ("10.0.0.2", "10.0.0.1", 443, 5)),
                   length=p + 54, payload=p) for i, p in enumerate((10, 20, 30, 40))]
    fp = flows.assign_flows(packets.canonical_endpoints(frame_of(spark, rows)))
    live = flows.state_measures(flows.running_flow_state(fp)).where("packet_count = 4")
    c = F.col
    named = values.flow_model_values(
        duration=(c("last_seen_us") - c("start_us")) / 1e6, packets_out=c("packets_a_to_b"), packets_in=c("packets_b_to_a"),
        payload_out=c("payload_bytes_a_to_b"), payload_in=c("payload_bytes_b_to_a"),
        payload_variance=c("payload_size_variance"), iat_variance=c("inter_arrival_variance"))
    a = live.select(*[v.alias(n) for n, v in named.items()]).first().asDict()
    d = lambda x: F.lit(float(x))
    std = math.sqrt(50)
    off = values.flow_model_values(
        duration=d(3), packets_out=d(2), packets_in=d(2), payload_out=d(30), payload_in=d(70),
        payload_variance=values.pooled_variance(d(2), d(2), d(30), d(70), d(std), d(std)),
        iat_variance=values.population_variance(d(0), d(3)))
    b = spark.range(1).select(*[v.alias(n) for n, v in off.items()]).first().asDict()
    assert a == pytest.approx(b)
    assert (a["payload_packet_size_mean"], a["payload_packet_size_variance"], a["payload_bytes_outbound"]) == (25, pytest.approx(125), 30)


def test_hidden_query_name_hides_dns_features(spark):
    from flowloom.functions.text import dns_lexical

    row = spark.createDataFrame([("abc-123.example",), ("",), (None,)], "d string").select(
        *[v.alias(n) for n, v in dns_lexical(F.col("d")).items()]).collect()
    assert row[0]["domain_length"] == 15 and row[0]["subdomain_count"] == 0
    assert row[0]["digit_ratio"] == pytest.approx(3 / 14) and row[0]["hyphen_ratio"] == pytest.approx(1 / 14)
    assert all(v is None for v in row[1]) and all(v is None for v in row[2])


def test_feature_table_checks(spark):
    v = spark.createDataFrame([(1, "behaviour", "behaviour.v1", "e", "w", 1.0, True)],
                              "id int, family string, schema_version string, entity_id string, window_id string, feature__x double, available__x boolean")
    good = spark.createDataFrame([(1, "BENIGN", "g", "s")], "id int, label string, group_id string, source_name string")
    assert features.feature_table(v, good, ["id"]).count() == 1
    with pytest.raises(ValueError):
        features.feature_table(v, good.where("id = 2"), ["id"])
    with pytest.raises(ValueError):
        features.feature_table(v, good.withColumn("label", F.lit(None).cast("string")), ["id"])
