"""Exact rolling windows per host over a packet stream: one row per packet, as of that packet."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.streaming.packets import DEFAULT_DELAY, well_formed

WIDTH_US = 60_000_000


def sums_in_windows(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums over rows ``start[i]`` to i."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[1:] - upto[start]


def distinct_in_windows(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distinct codes among rows ``start[i]`` to i, where ``start`` never falls; negative codes count for nothing.

    A code opens at a row when the row with it before has left the window by then, and closes when a row leaves that no later one with the
    code followed in time. What has opened less what has closed is open.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    before, after = np.full(n, -1), np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    opens = (codes >= 0) & (before < start)
    closes = (codes >= 0) & ((after < 0) | opens[after])
    return np.cumsum(opens) - np.concatenate([[0], np.cumsum(closes)])[start]


class WindowProcessor(StatefulProcessor):
    """Keeps the packets of one host that a later window may still hold, and nothing older.

    A micro-batch of a host is worked off at once: kept packets and new ones are laid in one array, window starts are searched, sums are
    differences of running sums, and distinct counts those of openings and closings.
    """

    def __init__(self, width_us: int, sums: list[str], distinct: list[str], keys: list[str]) -> None:
        self.width_us, self.sums, self.distinct, self.keys = width_us, sums, distinct, keys
        self.columns = ["ts_us", *sums, *distinct]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ["ts_us long", *[f"{n} long" for n in self.sums], *[f"{n} string" for n in self.distinct]]
        self.held = handle.getListState("held", ", ".join(fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if any(part is None for part in key):  # the closing marker
            return
        fresh = pd.concat(list(rows)).sort_values("frame_no")
        kept = list(zip(*self.held.get(), strict=True)) or [()] * len(self.columns)
        both = {n: [*old, *fresh[n].tolist()] for n, old in zip(self.columns, kept, strict=True)}
        times = np.array(both["ts_us"], dtype="int64")
        start = np.searchsorted(times, times - self.width_us)
        new = slice(len(times) - len(fresh), None)
        out = {k: [part] * len(fresh) for k, part in zip(self.keys, key, strict=True)}
        out |= {"frame_no": fresh["frame_no"].to_numpy(), "ts_us": times[new]}
        for name in self.sums:
            out[name] = sums_in_windows(np.array(both[name], dtype="int64"), start)[new]
        for name in self.distinct:
            out[name] = distinct_in_windows(pd.factorize(np.array(both[name], dtype=object))[0], start)[new]
        self.held.put(list(zip(*[both[n][int(start[-1]) :] for n in self.columns], strict=True)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(times[-1]) + self.width_us) // 1000 + 1)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame(columns=[*self.keys, "frame_no", "ts_us", *self.sums, *self.distinct])

    def close(self) -> None:
        pass


def window_needs(host: str) -> tuple[str, ...]:
    return ("capture_id", host, "frame_no", "ts_us")


def host_windows(
    packets: DataFrame, host: str, sums: dict[str, Column], distinct: dict[str, Column], width_us: int = WIDTH_US, delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Per packet of a stream: sums and distinct counts over the packets with its value of ``host`` in the last ``width_us``, itself included.

    ``packets`` is in order within a capture (see ``mark_late``) and has event time ``ts``; ``sums`` are whole numbers, null counts as nothing
    in either kind. A packet exactly ``width_us`` old still counts. State is what one window holds; it goes when the watermark has passed it.
    A host is one key, so one task takes what a micro-batch brings of it. Rows without a key, frame number or time are left out:
    ``malformed(packets, ("capture_id", host), window_needs(host))`` are these.
    """
    keys = ["capture_id", host]
    kinds = {f.name: f.dataType.simpleString() for f in packets.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} long" for n in ("frame_no", "ts_us", *sums, *distinct)])
    rows = well_formed(packets, keys, window_needs(host)).select(
        *keys, "frame_no", "ts_us", "ts", *[F.coalesce(m.cast("long"), F.lit(0)).alias(n) for n, m in sums.items()], *[m.cast("string").alias(n) for n, m in distinct.items()])
    return rows.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(
        WindowProcessor(width_us, list(sums), list(distinct), keys), outputStructType=schema, outputMode="Append", timeMode="EventTime")
