"""Gate truth table, alert suppression, contracts and ids."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowloom.fixed import CAPABILITIES
from flowloom.functions import ids
from flowloom.operators import alerts, evidence

VERDICT = (
    "n int, threat_class string, calibrated_confidence double, class_threshold double, missing_evidence array<string>, "
    "evidence map<string,double>, evidence_flags map<string,boolean>, capabilities struct<"
    + ",".join(f"{c}:boolean" for c in CAPABILITIES) + ">"
)
ALL = tuple(True for _ in CAPABILITIES)
NO_NAME = tuple(c != "has_dns_query_name" for c in CAPABILITIES)


def gate(spark, rows):
    got = evidence.evidence_gate(spark.createDataFrame(rows, VERDICT)).orderBy("n").collect()
    return [(r["decision"], r["evidence_quality"], r["gate_missing"]) for r in got]


def test_truth_table(spark):
    ddos = {"target_packets_per_second": 1.0, "unique_sources_for_destination": 2.0, "source_entropy_for_destination": 1.0,
            "target_concentration": 0.5, "target_window_packets": 10.0, "history_seconds": 1.0}
    bot = {"connection_count": 2.0, "periodicity_score": 0.9, "destination_recurrence": 1.0, "mean_connection_interval": 5.0,
           "history_seconds": 5.0}
    full = {"history_complete": True}
    rows = [
        (0, "BENIGN", 0.98, None, [], {}, {}, ALL),
        (1, "DGA", 0.9, 0.5, [], {"domain_length": 9.0, "character_entropy": 2.0}, {}, NO_NAME),
        (2, "DDOS", 0.9, 0.5, [], ddos, full, ALL),
        (3, "BOT_OR_C2_LIKE", 0.98, 0.5, [], bot, full, ALL),
        (4, "DDOS", 0.6, 0.7, [], ddos, full, ALL),
        (5, "DDOS", 0.4, 0.7, [], ddos, full, ALL),
        (6, "DDOS", 0.9, None, ["own"], ddos, {"history_complete": False}, ALL),
        (7, "UNKNOWN", 0.9, 0.5, [], {}, {}, ALL),
        (8, "SUSPICIOUS_ENCRYPTED", 0.9, 0.5, [], {"packet_count": 1.0, "packet_size_mean": 2.0}, {},
         tuple(c not in ("has_tls_metadata", "has_quic_metadata") for c in CAPABILITIES)),
        (9, "DGA", 0.9, 0.5, [], {"domain_length": 9.0, "character_entropy": 2.0}, {}, ALL),
    ]
    assert gate(spark, rows) == [
        (None, "ADEQUATE", []),
        ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT", ["has_dns_query_name"]),
        ("ACCEPT", "STRONG", []),
        ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT", ["connection_count>=3", "history_seconds>=10"]),
        ("UNKNOWN_SUSPICIOUS", "ADEQUATE", []),
        (None, "WEAK", []),
        ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT", ["own", "validation_threshold_unavailable", "history_complete"]),
        ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT", ["evidence_policy_not_configured"]),
        ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT", ["one_of:has_tls_metadata,has_quic_metadata"]),
        ("ACCEPT", "ADEQUATE", []),
    ]


def test_suppression_counts_from_the_last_kept_alert(spark):
    rng = random.Random(4)
    rows, expected, last = [], set(), {}
    for i in range(200):
        key = rng.choice("xy")
        t = i * 13_000_000
        rows.append((f"a{i:03d}", f"f{i:03d}", "w", t, "DDOS", key, "d", "behaviour", "ACCEPT"))
        if key not in last or t - last[key] >= 60_000_000:
            expected.add(f"a{i:03d}")
            last[key] = t
    df = spark.createDataFrame(rows, "alert_id string, flow_id string, window_id string, ts_us long, threat_class string, "
                               "source_ip string, destination_ip string, detector_id string, decision string")
    assert {r["alert_id"] for r in alerts.dedupe_alerts(df).collect()} == expected


def test_ids(spark):
    def digest(prefix, *parts):
        return f"{prefix}-" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:24]

    us = 1_788_256_800_000_000
    df = spark.createDataFrame([(us,), (us + 250_000,)], "t long")
    got = df.select(
        ids.flow_id(F.lit("10.0.0.1"), F.lit(None), F.lit("::1"), F.lit(5), F.lit("ICMP"), F.col("t"), F.lit(7)).alias("f"),
        ids.window_id(F.lit("10.0.0.1"), F.col("t"), 60).alias("w"),
        ids.alert_id(F.lit("d"), F.lit("DDOS"), F.col("t"), F.lit("flow-x"), F.lit(None)).alias("a"),
    ).collect()
    bucket = str(us // 60_000_000)
    assert got[0]["f"] == digest("flow", "10.0.0.1", "None", "::1", "5", "ICMP", bucket, "7")
    assert got[0]["w"] == digest("window", "10.0.0.1", "60", bucket)
    assert got[0]["a"] == digest("sx", "d", "DDOS", "flow-x", "", "2026-09-01T10:00:00+00:00")
    assert got[1]["a"] == digest("sx", "d", "DDOS", "flow-x", "", "2026-09-01T10:00:00.250000+00:00")


def test_endpoint_order_is_by_version_then_bytes(spark):
    pairs = [("9.0.0.1", "10.0.0.1", True), ("10.0.0.2", "10.0.0.10", True), ("255.0.0.1", "::1", True),
             ("2001:db8::2", "2001:db8::1", False), ("fe80::1", "2001:db8::1", False), ("10.0.0.1", "10.0.0.1", True)]
    df = spark.createDataFrame(pairs, "a string, b string, first boolean")
    got = df.select("first", ids.source_is_first(F.col("a"), F.lit(1), F.col("b"), F.lit(2)).alias("g")).collect()
    assert all(r["first"] == r["g"] for r in got)


def test_buckets_equal_the_standard_library(spark):
    from flowloom.functions.text import bigram_counts, stable_bucket

    words = ["ab", "zz", "é-", "a" * 50, None]
    expected = [None if w is None else int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 7 for w in words]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(stable_bucket(F.col("w"), 7)).collect()] == expected
    sha = [None if w is None else int(hashlib.sha256(w.encode()).hexdigest()[:16], 16) % 7 for w in words]
    assert [r[0] for r in df.orderBy("i").select(stable_bucket(F.col("w"), 7, "sha2")).collect()] == sha
    counts = df.where("i = 3").select(bigram_counts(F.col("w")), bigram_counts(F.col("w"), "sha2")).first()
    assert sum(counts[0]) == 49 and sum(counts[1]) == 49 and max(counts[0]) == 49
