"""Windows of a stream and states of a hot flow against plain loops; batches that are replayed."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.operators import flows
from flowloom.streaming import packets as streams
from flowloom.streaming import windows


@given(st.lists(st.tuples(st.integers(-1, 4), st.integers(0, 3)), max_size=40), st.integers(0, 6))
def test_distinct_counts_equal_sets(rows, width):
    codes = np.array([code for code, _ in rows], dtype=int)
    times = np.cumsum(np.array([gap for _, gap in rows], dtype=int))
    start = np.searchsorted(times, times - width)
    want = [len({code for code in codes[start[i] : i + 1] if code >= 0}) for i in range(len(codes))]
    assert windows.distinct_in_windows(codes, start).tolist() == want


ROWS = "capture_id string, host string, frame_no long, ts_us long, size long, peer string"


@pytest.mark.parametrize("hot", [0.3, 1.0])
def test_windows_of_a_stream_equal_a_loop(spark, tmp_path, hot):
    rng, now, rows = random.Random(11), 0, []
    for i in range(240):
        now += rng.choice([0, 1_000_000, 9_000_000, 20_000_000] + [150_000_000] * (i % 60 == 0))
        host = "hot" if rng.random() < hot else rng.choice("ab")
        rows.append((rng.choice("cd"), host, i, now, rng.choice([None, 5, 70]), rng.choice([None, "x", "y", "z"])))
    bad = [("c", None, 997, now, 1, "x"), ("c", "a", None, now, 1, "x"), ("c", "a", 998, None, 1, "x")]
    frame = spark.createDataFrame(rows + bad, ROWS)
    for lo in range(0, 240, 80):
        frame.where(F.col("frame_no").between(lo, lo + 79)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame.where("frame_no > 900 or frame_no is null").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.closing_marker(frame).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.packet_stream(spark, str(tmp_path / "in"), frame.schema, 1)
    with streams.rocksdb(spark):
        out = windows.host_windows(source, "host", {"n": F.lit(1), "bytes": F.col("size")}, {"peers": F.col("peer")})
        streams.drain(out, str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for capture, host, at, ts, _, _ in rows:
        held = [r for r in rows[: at + 1] if r[:2] == (capture, host) and r[3] >= ts - windows.WIDTH_US]
        want.append((capture, host, at, ts, len(held), sum(r[4] or 0 for r in held), len({r[5] for r in held} - {None})))
    assert got == sorted(want)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    streams.write_once(spark.range(5), str(tmp_path / "out"), 3)
    files = sorted(p.name for p in (tmp_path / "out" / "batch=3").iterdir())
    streams.write_once(spark.range(9), str(tmp_path / "out"), 3)
    assert sorted(p.name for p in (tmp_path / "out" / "batch=3").iterdir()) == files
    (tmp_path / "out" / "batch=3" / "_SUCCESS").unlink()  # broke off before it was whole
    streams.write_once(spark.range(9), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_states_of_one_hot_flow_equal_a_window(spark):
    rng = random.Random(4)
    named = lambda n: {"name": n}
    rows = []
    for i in range(400):
        flow = 0 if i % 10 else i
        new = i == flow
        rows.append(("c", flow, f"k{flow}", i, i * 10, "1.1.1.1", "1.1.1.1", 5, "2.2.2.2", 6, "TCP", new, rng.choice(["A_TO_B", "B_TO_A"]), rng.randrange(40, 90),
                     rng.choice([None, 3]), None if new else 10, ["SYN"] if new else None, named(f"d{i}") if i % 7 == 0 else None, named(f"t{i}") if i == 33 else None, None))
    schema = """capture_id string, flow_start long, flow_key string, frame_no long, ts_us long, src_ip string, a_ip string, a_port int, b_ip string, b_port int,
        protocol string, is_new boolean, direction string, packet_length long, payload_length long, gap_us long, tcp_flags array<string>,
        dns struct<name:string>, tls struct<name:string>, quic struct<name:string>"""
    frame = spark.createDataFrame(rows, schema)
    got = {r.frame_no: r for r in flows.running_flow_state(frame).collect()}
    upto = Window.partitionBy("capture_id", "flow_start").orderBy("frame_no")
    ahead = F.col("direction") == "A_TO_B"
    plain = frame.select("frame_no", F.min("ts_us").over(upto).alias("start_us"), F.max(F.col("is_new") & ahead).over(upto).alias("a_is_initiator"),
                         F.sum(ahead.cast("long")).over(upto).alias("packets_a_to_b"), F.sum(F.expr("packet_length * packet_length")).over(upto).alias("size_squares"),
                         F.sum(F.coalesce("gap_us", F.lit(0))).over(upto).alias("gap_sum"), F.max(F.size("tcp_flags")).over(upto).cast("long").alias("syn_count"),
                         *[F.last(k, ignorenulls=True).over(upto).alias(k) for k in ("dns", "tls", "quic")]).collect()
    assert len(got) == len(plain) == 400
    for r in plain:
        assert {n: got[r.frame_no][n] for n in r.asDict()} == r.asDict()
