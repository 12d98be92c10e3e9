"""Host windows: a step carries its kind and few values, and sums of one kind equal a loop."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from flowloom.operators import hostwindows
from flowloom.operators.scan import KIND, ordered_scan


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_of_kinds(spark, partitions):
    """Each row adds to the sums of its own kind only, whatever the ranges are; keys may be null, a row may have no kind."""
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None, "c"]) if i % 3 else "a", i, draw.choice([0, 1, 2, None]), draw.randrange(-9, 9), draw.choice([None, 4, 7]),
             i % 4 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, f"k string, at long, {KIND} long, v long, w long, asked boolean").repartition(3)
    folds = {"v0": ("sum", "v", True, 0), "v1": ("sum", "v", True, 1), "w1": ("sum", "w", True, 1), "never": ("sum", "v", True, 9)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {(r.k, r["at"]): (r.v0, r.v1, r.w1, r.never) for r in ordered_scan(df, ["k"], ["at"], folds, keep="asked").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums, want = defaultdict(lambda: [0, 0, 0]), {}
    for k, at, kind, v, w, asked in rows:
        own = sums[k]
        own[0] += v if kind == 0 else 0
        own[1] += v if kind == 1 else 0
        own[2] += (w or 0) if kind == 1 else 0
        if asked:
            want[k, at] = (*own, 0)
    assert got == want


def test_steps_of_hosts_are_narrow(spark):
    """A step has its kind and at most four values, not a column for each of some twenty measures."""
    events = spark.createDataFrame(
        [("c", f, 1_000_000 * f, 1, f"s{f % 3}", "d", 80, "UDP", 60, f < 4, ["x.example"]) for f in range(1, 9)],
        "capture_id string, frame_no long, ts_us long, flow_start long, src_ip string, dst_ip string, dst_port int, protocol string, packet_length long, "
        "is_new boolean, domains array<string>")
    totals = hostwindows._sub_totals(hostwindows.with_widths(events, [60]), list(hostwindows.FAMILIES))
    steps, names = hostwindows._derived_steps(totals, list(hostwindows.FAMILIES), None)
    assert set(names) == {n for _, _, sides in hostwindows.FAMILIES.values() for _, values in sides for n in values}
    for part in steps:
        assert set(part.columns) <= {*hostwindows.HOST, *hostwindows.STEP, KIND, *hostwindows.VALUES}
    assert len(hostwindows.VALUES) == 4
