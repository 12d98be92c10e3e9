"""Closed rolling windows [t - w, t] per host, read at snapshot points, with work linear in the rows.

Nothing is joined pairwise. Every packet changes a window twice: when it arrives and when it leaves at
``ts + w + 1``. A window measure is the running sum of these changes. Measures that do not add up over
packets (distinct counts, entropies, flow spans, bins) are first kept per sub-key (host and peer, host
and port, ...); the *changes* of the sub-key's value then add up per host.

Both sums are ``ordered_scan``s: rows are dealt by ranges of (key, time), so a host, a pair or a capture that holds most packets is
spread over as many tasks as its rows need. All kinds of sub-keys are one scan, and all hosts with the whole capture (a key without a host)
are one more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.fixed import MAX_WINDOW_EVENTS, SECOND_US
from flowloom.functions.ids import floor_div
from flowloom.functions.values import exact_variance
from flowloom.operators.scan import KIND, first_at_or_after, ordered_scan

STEP = ["at_us", "seq"]
BEFORE = "_before_"
#: n * log2(n) is summed as whole numbers and a rest in units of this fraction, so that what arrives and what leaves cancels exactly.
LOG_UNITS = float(1 << 36)


def traffic_events(flow_packets: DataFrame) -> DataFrame:
    """The columns windows need: who sent what to whom, flow, and visible query names."""
    names = F.filter(F.transform("dns.queries", lambda q: q["name"]), lambda n: n.isNotNull())
    return flow_packets.select(
        "capture_id", "frame_no", "ts_us", "flow_start", "src_ip", "dst_ip", "dst_port", "protocol",
        "packet_length", "is_new", F.coalesce(names, F.array().cast("array<string>")).alias("domains"),
    )


def with_widths(df: DataFrame, widths_s: Sequence[int]) -> DataFrame:
    """One copy per window width; widths are distinct, sorted and positive."""
    widths = sorted(set(widths_s))
    if not widths or widths[0] <= 0:
        raise ValueError("window sizes must be positive")
    lits = F.array(*[F.lit(w * SECOND_US).cast("long") for w in widths])
    return df.withColumn("width_us", F.explode(lits))


def _steps(events: DataFrame, keys: Sequence[str], measures: dict[str, Column], *extra: str) -> DataFrame:
    """Each event as two rows: its measures when it arrives, and their opposite when it leaves the window."""
    c = F.col
    names = list(measures)
    base = events.select(*keys, "width_us", "ts_us", "frame_no", *extra, *[m.cast("long").alias(n) for n, m in measures.items()])

    def change(at: Column, seq: Column, sign: int) -> Column:
        arrived = c("ts_us") if sign > 0 else F.lit(None).cast("long")
        return F.struct(at.alias("at_us"), seq.cast("long").alias("seq"), *[(c(n) * sign).alias(n) for n in names], arrived.alias("arrived_us"))

    both = F.array(change(c("ts_us"), c("frame_no"), 1), change(c("ts_us") + c("width_us") + 1, F.lit(-1), -1))
    return base.select(*keys, *extra, F.explode(both).alias("_s")).select(*keys, *extra, "_s.*")


def _gap_steps(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps between neighbouring events of a key, as steps: a gap counts while both of its ends are inside the window."""
    c = F.col
    lagged = ordered_scan(events.select(*keys, *[n for n in ("width_us", "ts_us", "frame_no") if n not in keys]), keys, ["ts_us", "frame_no"],
                          {"before_us": ("last", "ts_us", False)})
    gap = c("ts_us") - c("before_us")
    inside = lagged.where(gap <= c("width_us")).withColumn("gap", gap)

    def change(at: Column, seq: Column, sign: int) -> Column:
        return F.struct(at.alias("at_us"), seq.cast("long").alias("seq"), (c("gap") * sign).alias("gap"), (c("gap") * c("gap") * sign).alias("gap2"))

    both = F.array(change(c("ts_us"), c("frame_no"), 1), change(c("before_us") + c("width_us") + 1, F.lit(-1), -1))
    return inside.select(*keys, F.explode(both).alias("_s")).select(*keys, "_s.*")


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _asked(points: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Points as rows of a scan: they come after the packet that triggers them."""
    return points.select(*keys, F.col("ts_us").alias("at_us"), F.col("trigger_frame").alias("seq"), F.lit(True).alias("is_point"), *also)


def _sums(steps: DataFrame, keys: Sequence[str], names: Sequence[str], points: DataFrame | None, last: bool = False, only_points: bool = False, numbered: bool = True) -> DataFrame:
    """Running sums of the steps after each of them, and at the points. ``step_no`` counts the steps of a key in the order of the scan."""
    numbered = numbered and not only_points
    rows = steps if points is None else _together([steps, _asked(points, keys)])
    rows = rows if "is_point" in rows.columns else rows.withColumn("is_point", F.lit(False))
    rows = rows.withColumn("is_point", F.coalesce("is_point", F.lit(False))).withColumn("_turn", F.col("is_point").cast("int"))
    own = {f"_own_{n}": F.coalesce(F.col(n), F.lit(0).cast("long")) for n in names} | ({"_one": F.lit(1).cast("long")} if numbered else {})
    rows = rows.select(*keys, *STEP, "_turn", "is_point", *[v.alias(n) for n, v in own.items()], *(["arrived_us"] if last else []),
                       *([F.col("is_point").alias("_keep")] if only_points else []))
    folds = {n: ("sum", f"_own_{n}", True) for n in names} | ({"step_no": ("sum", "_one", True)} if numbered else {})
    if last:
        folds |= {"last_us": ("last", "arrived_us", True), f"{BEFORE}last_us": ("last", "arrived_us", False)}
    found = ordered_scan(rows, keys, [*STEP, "_turn"], folds, keep="_keep" if only_points else None)
    before = [] if only_points else [(F.col(n) - F.col(f"_own_{n}")).alias(BEFORE + n) for n in names]
    return found.select(*keys, *STEP, "is_point", *folds, *before)


def sub_key_totals(
    events: DataFrame,
    keys: Sequence[str],
    measures: dict[str, Column],
    *,
    gap_of: Column | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """Window totals of every key after each change (and at each point).

    ``gap_of`` selects the events whose gaps to the previous selected event of the key are summed as
    ``gap`` and ``gap2`` (a gap counts while both of its ends are inside the window), and whose latest
    time is kept as ``last_us``.
    """
    keys = list(keys)
    if gap_of is None:
        return _sums(_steps(events, keys, measures), keys, list(measures), points)
    steps = _steps(events.withColumn("_selected", gap_of), keys, measures, "_selected")
    steps = steps.withColumn("arrived_us", F.when(F.col("_selected"), F.col("arrived_us"))).drop("_selected")
    steps = _together([steps, _gap_steps(events.where(gap_of), keys)])
    return _sums(steps, keys, [*measures, "gap", "gap2"], points, last=True)


Totals = Callable[[str], Column]

PAIR = ["capture_id", "width_us", "src_ip", "dst_ip"]
HOST = ["capture_id", "width_us", "host"]
SUB = ["capture_id", "width_us", "family", "first", "second"]
PEERS = ["src_ip", "dst_ip"]
POINT = [*PAIR, "ts_us", "trigger_frame"]


def pair_totals(events: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(source, destination): packets, new flows, and the gaps between new flows."""
    return sub_key_totals(
        events, PAIR, {"n": F.lit(1), "new": F.col("is_new").cast("long")}, gap_of=F.col("is_new"), points=points
    )


def _n_log_n(name: str, of: str) -> dict[str, Callable[[Totals], Column]]:
    """n * log2(n) of a total, worked out before as ``log_``, as a sum of two whole numbers."""
    return {
        name: lambda t: F.floor(t(f"log_{of}")).cast("long"),
        f"{name}_rest": lambda t: F.round((t(f"log_{of}") - F.floor(t(f"log_{of}"))) * LOG_UNITS).cast("long"),
    }


def _log(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _flag(value: Column) -> Column:
    return (value > 0).cast("long")


def _short(t: Totals) -> Column:
    return ((t("n") > 0) & (t("gap") <= 2 * SECOND_US)).cast("long")


#: Kinds of sub-keys: the host and the rest of the key, and what their totals add to which host's measures.
FAMILIES: dict[str, tuple[str, str, list[tuple[str, dict[str, Callable[[Totals], Column]]]]]] = {
    "pair": ("src_ip", "dst_ip", [
        ("first", {"unique_destinations": lambda t: _flag(t("n"))} | _n_log_n("destination_nlogn", "new")),
        ("second", {"unique_sources": lambda t: _flag(t("n"))} | _n_log_n("source_nlogn", "n"))]),
    "port": ("src_ip", "dst_port", [("first", {"unique_destination_ports": lambda t: _flag(t("n"))})]),
    "flow": ("src_ip", "flow_start", [("first", {"window_flows": lambda t: _flag(t("n")), "short_flows": _short})]),
    "name": ("src_ip", "domain", [("first", {"unique_domains": lambda t: _flag(t("n"))})]),
    "bin": ("dst_ip", "second_no", [("first", {"bins": lambda t: _flag(t("n")), "bin_squares": lambda t: t("n") * t("n")})]),
}
#: The total whose n * log2(n) a side of a family needs.
LOGS = {("pair", "first"): "new", ("pair", "second"): "n"}
SOURCE_SUMS = ("packet_count", "byte_count", "flow_count", "domain_count")
TARGET_SUMS = ("target_packet_count", "udp_packets", "inbound_bytes")
SOURCE_MEASURES = (*SOURCE_SUMS, "first_us", "unique_destinations", "destination_nlogn", "unique_destination_ports", "window_flows", "short_flows",
                   "unique_domains")
TARGET_MEASURES = ("target_packet_count", "udp_packets", "unique_sources", "source_nlogn", "bins", "bin_squares")
#: The measures that one step of a host may change, by kind of step; and for each measure its kind and its place in a step.
KINDS = [*[tuple(values) for _, _, sides in FAMILIES.values() for _, values in sides], SOURCE_SUMS, TARGET_SUMS, ("total_window_packets",)]
VALUES = [f"_value_{i}" for i in range(max(map(len, KINDS)))]
PLACES = {name: (kind, place) for kind, names in enumerate(KINDS) for place, name in enumerate(names)}


def _family_events(events: DataFrame, family: str) -> DataFrame:
    c = F.col
    host, rest, _ = FAMILIES[family]
    if family == "name":
        events = events.withColumn("domain", F.explode("domains"))
    elif family == "bin":
        events = events.withColumn("second_no", floor_div(c("ts_us"), SECOND_US))
    elif family == "port":
        events = events.where("dst_port IS NOT NULL")
    return events.select("capture_id", "width_us", F.lit(family).alias("family"), c(host).alias("first"), c(rest).cast("string").alias("second"),
                         "ts_us", "frame_no", "is_new")


def _sub_totals(events: DataFrame, families: Sequence[str], pair_points: DataFrame | None = None) -> DataFrame:
    """Totals of all sub-keys of these families, in one scan; at ``pair_points`` those of the pairs."""
    own = {f: _family_events(events, f) for f in families}
    steps = [_steps(_together(list(own.values())), SUB, {"n": F.lit(1), "new": F.col("is_new").cast("long")})]
    names = ["n", "new"]
    spans = [own["flow"]] if "flow" in own else []
    if pair_points is not None:
        spans.append(own["pair"].where("is_new"))
    if spans:
        steps.append(_gap_steps(_together(spans), SUB))
        names += ["gap", "gap2"]
    asked = None
    if pair_points is not None:
        asked = pair_points.select("capture_id", "width_us", F.lit("pair").alias("family"), F.col("src_ip").alias("first"), F.col("dst_ip").alias("second"),
                                   "ts_us", "trigger_frame")
    return _sums(_together(steps), SUB, names, asked, numbered=False)


def _derived_steps(totals: DataFrame, families: Sequence[str], wanted: set[str] | None) -> tuple[list[DataFrame], list[str]]:
    """Changes of what sub-keys add to their hosts: each derived value after a step less its value before."""
    parts, names = [], []
    before = lambda m: F.col(BEFORE + m)
    for family in families:
        for side, values in FAMILIES[family][2]:
            own = [n for n in values if wanted is None or n in wanted]
            if not own:
                continue
            names += own
            rows = totals.where((F.col("family") == family) & ~F.col("is_point"))
            of = LOGS.get((family, side))
            if of:  # logarithms in a step of their own, so that each is worked out once; rows that change neither total are left out first
                rows = rows.where((_flag(F.col("n")) != _flag(before("n"))) | (F.col(of) != before(of)))
                rows = rows.withColumns({f"log_{of}": _log(F.col(of)), f"{BEFORE}log_{of}": _log(before(of))})
            steps = rows.select("capture_id", "width_us", F.col(side).alias("host"), *STEP, F.lit(PLACES[own[0]][0]).cast("long").alias(KIND),
                                *[(values[n](F.col) - values[n](before)).alias(VALUES[PLACES[n][1]]) for n in own])
            parts.append(steps if of else steps.where(reduce(lambda a, b: a | b, [F.col(VALUES[PLACES[n][1]]) != 0 for n in own])))
    return parts, names


def _additive_steps(events: DataFrame, host: str, names: Sequence[str]) -> DataFrame:
    c = F.col
    values = {
        "packet_count": F.lit(1), "byte_count": c("packet_length"), "flow_count": c("is_new").cast("long"), "domain_count": F.size("domains"),
        "target_packet_count": F.lit(1), "udp_packets": (c("protocol") == "UDP").cast("long"), "inbound_bytes": c("packet_length"),
        "total_window_packets": F.lit(1),
    }
    own = c(host) if host else F.lit(None).cast("string")
    steps = _steps(events.withColumn("host", own), HOST, {VALUES[PLACES[n][1]]: values[n] for n in names}).drop("arrived_us")
    return steps.withColumn(KIND, F.lit(PLACES[names[0]][0]).cast("long"))


def _host_points(points: DataFrame, *sides: str, also: Sequence[str] = ()) -> DataFrame:
    """Points of the hosts in these columns; '' stands for the capture as a whole. With ``also``, these columns and ``side`` (a number) beside them."""
    whole = F.lit(None).cast("string")
    out = [points.select("capture_id", "width_us", (F.col(side) if side else whole).alias("host"), "ts_us", "trigger_frame",
                         *([*also, F.lit(i).alias("side")] if also else [])) for i, side in enumerate(sides)]
    return _together(out)


def _ledger(parts: Sequence[DataFrame], names: Sequence[str], points: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """All measures of all hosts at their points. A step has a few values and its kind, which tells the measures they add to."""
    rows = _together([*parts, _asked(points, HOST, also)])
    used = [v for v in VALUES if v in rows.columns]
    rows = rows.select(*HOST, *STEP, F.col("is_point").cast("int").alias("_turn"), F.coalesce("is_point", F.lit(False)).alias("_keep"), KIND, *used, *also)
    rows = rows.withColumn("_turn", F.coalesce("_turn", F.lit(0)))
    folds = {n: ("sum", VALUES[PLACES[n][1]], True, PLACES[n][0]) for n in names}
    found = ordered_scan(rows, HOST, [*STEP, "_turn"], folds, keep="_keep").select(*HOST, *STEP, *also, *names)
    return found.withColumns({n: F.col(n) + F.col(f"{n}_rest") / LOG_UNITS for n in names if n.endswith("_nlogn")})


def read_points(ledger: DataFrame, points: DataFrame, host: str, names: Sequence[str]) -> DataFrame:
    """Ledger values at the points, by an equi-join on (host, time, trigger)."""
    seen = ledger.where(F.col("host").isNotNull()).select(
        "capture_id", "width_us", F.col("host").alias(host), F.col("at_us").alias("ts_us"),
        F.col("seq").alias("trigger_frame"), *names,
    )
    at = ["capture_id", "width_us", host, "ts_us", "trigger_frame"]
    return points.join(seen.dropDuplicates(at), at)  # many points may ask for the same host at once; dealt like the join


def _oldest(asked: DataFrame, events: DataFrame) -> DataFrame:
    """``asked`` (points of sources) with ``_oldest``: the first packet of the source that is not older than the window."""
    keys = ["capture_id", "width_us", "src_ip"]
    since = asked.withColumn("at_us", F.col("ts_us") - F.col("width_us"))
    hits = first_at_or_after(since, events.select(*keys, F.col("ts_us").alias("at_us")), keys, "at_us", F.struct("at_us"), "_hit")
    return hits.select(*asked.columns, F.col("_hit.at_us").alias("_oldest"))


def _with_first(out: DataFrame) -> DataFrame:
    """``first_us``: the oldest packet in the window of a source, 0 for none."""
    return out.withColumn("first_us", F.when(F.col("packet_count") > 0, F.col("_oldest")).otherwise(0)).drop("_oldest")


def _with_oldest(out: DataFrame, events: DataFrame) -> DataFrame:
    at = ["capture_id", "width_us", "src_ip", "ts_us", "trigger_frame"]
    return _with_first(out.join(_oldest(out.select(*at).distinct(), events), at))


def _one_side(events: DataFrame, points: DataFrame, host: str, sums: Sequence[str], measures: Sequence[str], only: set[str] | None) -> DataFrame:
    """The wanted measures of hosts in one role; ``only`` leaves out what nobody asked for."""
    families = [f for f, (own, _, sides) in FAMILIES.items() for side, values in sides
                if (own if side == "first" else FAMILIES[f][1]) == host and (only is None or only & set(values))]
    parts, names = [], []
    if only is None or only & {*sums, "first_us"}:
        parts.append(_additive_steps(events, host, sums))
        names += sums
    if families:
        steps, own = _derived_steps(_sub_totals(events, families), families, {n for f in families for side, values in FAMILIES[f][2] for n in values
                                                                             if (FAMILIES[f][0] if side == "first" else FAMILIES[f][1]) == host})
        parts += steps
        names += own
    out = read_points(_ledger(parts, names, _host_points(points, host)), points, host, names)
    return _with_oldest(out, events) if "first_us" in measures and "packet_count" in names and (only is None or "first_us" in only) else out


def source_windows(events: DataFrame, points: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Source measures at points (capture_id, width_us, src_ip, ts_us, trigger_frame)."""
    return _one_side(events, points, "src_ip", SOURCE_SUMS, SOURCE_MEASURES, only)


def target_windows(events: DataFrame, points: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Destination measures at points (capture_id, width_us, dst_ip, ts_us, trigger_frame)."""
    return _one_side(events, points, "dst_ip", TARGET_SUMS, TARGET_MEASURES, only)


def total_window_packets(events: DataFrame, points: DataFrame) -> DataFrame:
    """Packets of the whole capture in the window, at points (capture_id, width_us, ts_us, trigger_frame)."""
    keys = ["capture_id", "width_us"]
    steps = _steps(events, keys, {"total_window_packets": F.lit(1)}).drop("arrived_us")
    seen = _sums(steps, keys, ["total_window_packets"], points, only_points=True)
    at = [*keys, "ts_us", "trigger_frame"]
    return points.join(seen.select(*keys, F.col("at_us").alias("ts_us"), F.col("seq").alias("trigger_frame"), "total_window_packets").dropDuplicates(at), at)


def history_complete(total: Column, max_events: int = MAX_WINDOW_EVENTS) -> Column:
    """False when a store of the newest ``max_events`` would have lost packets of this window."""
    return total <= max_events


def burstiness(packets: Column, bins: Column, squares: Column) -> Column:
    """Spread over mean of the packets per non-empty second; null for fewer than two seconds."""
    mean = packets / bins
    return F.when(bins >= 2, F.sqrt(F.greatest(exact_variance(bins, packets, squares), F.lit(0.0))) / mean)


def temporal_snapshot(events: DataFrame, points: DataFrame) -> DataFrame:
    """All window measures at snapshot points.

    ``points``: capture_id, width_us, src_ip, dst_ip, ts_us, trigger_frame (distinct). One scan follows all sub-keys, one more all
    hosts in both roles together with the capture; only the points leave it.
    """
    c = F.col
    totals = _sub_totals(events, list(FAMILIES), points)
    steps, derived = _derived_steps(totals, list(FAMILIES), None)
    parts = [*steps, _additive_steps(events, "src_ip", SOURCE_SUMS), _additive_steps(events, "dst_ip", TARGET_SUMS),
             _additive_steps(events, "", ["total_window_packets"])]
    names = [*derived, *SOURCE_SUMS, *TARGET_SUMS, "total_window_packets"]
    ledger = _ledger(parts, names, _host_points(points, "src_ip", "dst_ip", "", also=PEERS), [*PEERS, "side"])
    at = [c("at_us").alias("ts_us"), c("seq").alias("trigger_frame")]
    read = {n: 0 for n in (*SOURCE_MEASURES, "inbound_bytes") if n != "first_us"} | {n: 1 for n in TARGET_MEASURES} | {"total_window_packets": 2}
    of_hosts = ledger.select("capture_id", "width_us", *PEERS, *at, *[F.when(c("side") == side, c(n)).alias(n) for n, side in read.items()])
    pairs = {"connection_count": "new", "connection_gaps": "gap", "connection_gaps2": "gap2"}
    of_pairs = totals.where("is_point").select(
        "capture_id", "width_us", c("first").alias("src_ip"), c("second").alias("dst_ip"), *at, *[c(of).alias(n) for n, of in pairs.items()])
    of_oldest = _oldest(points, events).select(*POINT, "_oldest")
    # What was read for a point in each of its roles comes together by its key: narrow rows, one shuffle.
    roles = _together([of_hosts, of_pairs, of_oldest]).dropna(subset=POINT)
    out = roles.groupBy(*POINT).agg(*[F.max(n).alias(n) for n in (*read, *pairs, "_oldest")])
    return _with_first(out)
