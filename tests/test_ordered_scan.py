"""Scans over ranges against plain loops: every key, hot keys over many ranges, nulls, kept rows and both directions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom import session
from flowloom.operators import scan
from flowloom.operators.scan import CHUNK, first_at_or_after, greedy_chain, ordered_scan

ROWS = "k string, j long, at long, v long, w long, asked boolean, name string"


def made(n, seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice(["a", "b", None, "zz"])
        rows.append((k, rng.choice([1, None]), i * 3 + rng.randrange(3), rng.randrange(-5, 9), rng.choice([None, None, rng.randrange(1000)]), rng.random() < 0.4, f"n{i}"))
    rng.shuffle(rows)
    return rows


def plain(rows):
    out, sums, last = {}, defaultdict(int), {}
    for k, j, _, v, w, _, name in sorted(rows, key=lambda r: r[2]):
        key = (k, j)
        before, last_before = sums[key], last.get(key)
        sums[key] += v
        if w is not None:
            last[key] = w
        out[name] = (before, sums[key], last_before, last.get(key))
    return out


FOLDS = {"before": ("sum", "v", False), "upto": ("sum", "v", True), "seen": ("last", "w", False), "now": ("last", "w", True)}


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("keep", [None, "asked"])
def test_scan_equals_a_loop(spark, hot, keep):
    rows = made(600, 3, hot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = ordered_scan(spark.createDataFrame(rows, ROWS).repartition(3), ["k", "j"], ["at"], FOLDS, keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain(rows)
    assert {r.name: (r.before, r.upto, r.seen, r.now) for r in got} == {r[6]: want[r[6]] for r in rows if keep is None or r[5]}
    assert len(got) == sum(keep is None or r[5] for r in rows)


def test_one_key_is_spread_over_all_ranges(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.lit(1).cast("long").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_scan(rows, ["k"], ["at"], {"n": ("sum", "v", True)})
        sizes = [r["count"] for r in spark.read.parquet(session._WRITTEN[-1]).groupBy(CHUNK).count().collect()]
        assert got.where("n <> at + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 2.5 * 40_000 / 4


def test_scan_of_nothing(spark):
    assert ordered_scan(spark.createDataFrame([], ROWS), ["k", "j"], ["at"], FOLDS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_first_at_or_after_equals_a_search(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice("ab"), rng.randrange(100), rng.randrange(50)) for _ in range(80)]
    points = [(rng.choice("abc"), rng.randrange(120), i) for i in range(90)]
    got = first_at_or_after(spark.createDataFrame(points, "k string, at long, id long"), spark.createDataFrame(events, "k string, at long, frame long"),
                            ["k"], "at", F.struct("at", "frame"), "hit").collect()
    want = {i: min(((t, f) for e, t, f in events if e == k and t >= at), default=None) for k, at, i in points}
    assert {r.id: tuple(r.hit) if r.hit else None for r in got} == want and len(got) == len(points)


@pytest.mark.parametrize(("fan", "widths"), [(3, 1), (5, 2), (256, 16)])
def test_chain_equals_a_loop(spark, monkeypatch, fan, widths):
    """Crowded and empty stretches, gaps of just under and over a width, many levels of chunks, a null key, one key with most rows."""
    monkeypatch.setattr(scan, "CHAIN_FAN", fan)
    monkeypatch.setattr(scan, "CHAIN_WIDTHS", widths)
    rng = random.Random(fan)
    rows, at = [], -900
    for i in range(700):
        at += rng.choice([0, 1, 3, 9, 10, 11, 11, 40] if i % 100 > 5 else [10, 500])
        rows.append((rng.choice(["hot", "hot", "hot", "a", None]), at, i))
    rows += [("lone", 5, 0)]
    want, last = [], {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= 10:
            want.append((k, t, i))
            last[k] = t
    rng.shuffle(rows)
    got = greedy_chain(spark.createDataFrame(rows, "k string, ts_us long, pos long").repartition(3), ["k"], 10).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert greedy_chain(spark.createDataFrame([], "k string, ts_us long, pos long"), ["k"], 10).count() == 0
