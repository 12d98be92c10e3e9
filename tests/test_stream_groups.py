"""Stream state is kept by groups of keys: few calls to the state store, and the same rows as one key at a time."""

import random
from types import SimpleNamespace

import pandas as pd

from flowloom.operators.alerts import ALERT_KEY
from flowloom.streaming import packets as streams


class Store:
    """A group's list state and timers, with a count of the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.put([])

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers = [t for t in self.timers if t != at]

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def run(processor, key, batches, times):
    """What a group emits for its batches; after each of them the watermark is ``times`` of it."""
    store, out = Store(), []
    processor.init(store)
    for batch, now in zip(batches, times, strict=True):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
        if len(batch):
            out += [tuple(r) for part in processor.handleInputRows(key, iter([batch]), clock) for r in part.itertuples(index=False)]
        if any(t <= now for t in store.timers):
            out += [tuple(r) for part in processor.handleExpiredTimer(key, clock, None) for r in part.itertuples(index=False)]
    return out, store


def of_each(make, key, batches, times, by):
    """The same with a group for each key."""
    out = []
    for own in sorted({tuple(r) for b in batches for r in b[by].itertuples(index=False)}):
        held = [b[(b[by] == list(own)).all(axis=1)] for b in batches]
        out += run(make(), key, held, times)[0]
    return out


def test_flows_of_a_group_equal_those_of_single_keys():
    rng, now, rows = random.Random(3), 0, []
    for i in range(2000):
        now += rng.choice([0, 50_000, 400_000] + [70_000_000] * (i % 500 == 0))
        rows.append((f"f{rng.randrange(60)}", now - rng.choice([0, 0, 300_000]), i, rng.choice(["A_TO_B", "B_TO_A"]), rng.randrange(60, 1500)))
    frame = pd.DataFrame(rows, columns=["flow_key", "ts_us", "frame_no", "direction", "packet_length"]).sample(frac=1, random_state=1)
    batches = [frame[frame["frame_no"] // 400 == i] for i in range(5)] + [frame[:0]]
    times = [int(b["ts_us"].max()) // 1000 - 1000 if len(b) else 10**9 for b in batches]
    got, store = run(streams.FlowProcessor(), ("cap", 7), batches, times)
    assert sorted(got) == sorted(of_each(streams.FlowProcessor, ("cap", 7), batches, times, ["flow_key"]))
    assert {r[-1] for r in got} == {"idle", "active"} and sum(r[5] + r[6] for r in got) == 2000
    assert store.calls < 40 and not store.rows and not store.timers  # not a call for each of 60 keys


def test_alerts_of_a_group_equal_those_of_single_keys():
    rng, rows = random.Random(4), []
    for i in range(900):
        rows.append((rng.choice(["DDOS", "RECON"]), f"s{rng.randrange(5)}", rng.choice(["d0", "d1", "d2"]), "behaviour", "ALERT", i * 500_000 + rng.randrange(3), f"f{i % 7}", f"a{i}"))
    frame = pd.DataFrame(rows, columns=[*ALERT_KEY, "ts_us", "flow_id", "alert_id"])
    batches = [frame[i : i + 300].sample(frac=1, random_state=i) for i in (0, 300, 600)] + [frame[:0]]
    times = [int(b["ts_us"].max()) // 1000 - 1000 if len(b) else 10**9 for b in batches]
    make = lambda: streams.CooldownProcessor(60_000_000, list(ALERT_KEY), [*ALERT_KEY, "ts_us", "flow_id", "alert_id"])
    got, store = run(make(), (7,), batches, times)
    assert sorted(got) == sorted(of_each(make, (7,), batches, times, list(ALERT_KEY))) and 30 < len(got) < 900
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[5], r[6], r[7])):
        if r[:5] not in last or r[5] - last[r[:5]] >= 60_000_000:
            last[r[:5]] = r[5]
            want.append(r)
    assert sorted(got) == sorted(want) and store.calls < 30 and not store.rows  # 30 keys, four batches


def test_chunks_of_a_chain_are_worked_in_whole_tables():
    import numpy as np
    import pyarrow as pa

    from flowloom.operators import scan

    rng = np.random.default_rng(5)
    run = np.sort(rng.integers(0, 900, 6000))
    times = np.concatenate([np.sort(rng.choice(1600, n, replace=False)) for n in np.unique(run, return_counts=True)[1]])
    enter = np.repeat(rng.integers(0, 200, 900), np.bincount(run, minlength=900))
    table = pa.table({"k": run, "_run": run, "ts_us": times, "_enter": enter})
    batches = [b for lo in range(0, 6000, 700) for b in table.slice(lo, 700).to_batches()]
    whole = list(scan._whole_runs(iter(batches)))
    assert len(whole) <= len(batches) + 1 and sum(t.num_rows for t in whole) == 6000  # not one for each of 900 runs
    kept = pa.Table.from_batches(scan._kept(iter(batches), 100, ["k", "ts_us"])).to_pydict()
    doors = pa.Table.from_batches(scan._chunk_tables(iter([b.drop_columns(["_enter"]) for b in batches]), 100, 1600)).to_pydict()
    want, tables = [], []
    for k in np.unique(run):
        own = times[run == k]

        def chain(due, own=own):
            out = []
            for t in own:
                if t >= due:
                    out.append(int(t))
                    due = t + 100
            return out

        want += [(k, t) for t in chain(enter[run == k][0])]
        first = int(np.searchsorted(own, 100)) + 1
        tables += [(k, t, chain(t)[-1]) for t in own[:first]]
    assert list(zip(kept["k"], kept["ts_us"])) == want
    assert list(zip(doors["k"], doors["ts_us"], doors["last_us"])) == tables


def test_closing_marker_is_no_alert_and_nulls_in_a_key_are_a_key(spark, tmp_path):
    rows = [("DDOS", f"s{i % 3}" if i % 4 else None, "d0", "behaviour", "ALERT", (i + 50) * 20_000_000, "f", f"a{i:02}") for i in range(40)]
    schema = ", ".join(f"{n} string" for n in ALERT_KEY) + ", ts_us long, flow_id string, alert_id string"
    for lo in (0, 20):
        spark.createDataFrame(rows[lo : lo + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(rows, schema)
    streams.closing_marker(frame).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.packet_stream(spark, str(tmp_path / "in"), frame.schema, 1)
    with streams.rocksdb(spark):
        streams.drain(streams.suppress_alerts(source), str(tmp_path / "out"), str(tmp_path / "log"))
    want, last = [], {}
    for r in rows:
        if r[:5] not in last or r[5] - last[r[:5]] >= 60_000_000:
            last[r[:5]] = r[5]
            want.append(r[-1])
    got = [r["alert_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == want
