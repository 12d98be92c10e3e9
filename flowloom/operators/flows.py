"""Packets to bidirectional flows, flow records, closes, ticks and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.fixed import ACTIVE_US, IDLE_US, SNAPSHOT_MIN_PACKETS, SNAPSHOT_US, TCP_FLAGS
from flowloom.functions.ids import flow_id
from flowloom.functions.values import exact_variance
from flowloom.operators.packets import frame_chunk
from flowloom.operators.scan import FRAMES_PER_CHUNK, chunk_scan, first_at_or_after, greedy_chain, ordered_scan
from flowloom.session import checkpoint

FLOW = ["capture_id", "flow_start"]
SESSION = ["capture_id", "flow_key", "session_start"]
#: What all packets of a flow have in common.
ENDPOINTS = ["flow_key", "a_ip", "a_port", "b_ip", "b_port", "protocol"]


def sessionize_idle(
    packets: DataFrame, idle_us: int = IDLE_US, chunk_frames: int = FRAMES_PER_CHUNK
) -> DataFrame:
    """Add ``prev_us`` (previous packet of the key) and ``session_start`` (its first frame number).

    A gap of ``idle_us`` or more starts a new session. Input is in capture order (no late packets), so
    frame order is time order. Keys are cut into frame chunks; one summary row per key and chunk
    carries the last time and the open session forward.
    """
    c = F.col
    key = ["capture_id", "flow_key"]
    part = [*key, "_chunk"]
    inside = Window.partitionBy(*part).orderBy("frame_no")
    rows = packets.withColumn("_chunk", frame_chunk(chunk_frames))
    starts_inside = F.when(c("ts_us") - c("_prev_in") >= idle_us, c("frame_no"))

    def lagged(df: DataFrame) -> DataFrame:
        return df.withColumn("_prev_in", F.lag("ts_us").over(inside))

    summary = (
        lagged(rows.select(*part, "frame_no", "ts_us"))
        .groupBy(*part)
        .agg(
            F.min("ts_us").alias("_first_us"),
            F.max("ts_us").alias("_last_us"),
            F.min("frame_no").alias("_first_frame"),
            F.max(starts_inside).alias("_last_start"),
        )
    )
    chunks = Window.partitionBy(*key).orderBy("_chunk")
    opens = c("_before_us").isNull() | (c("_first_us") - c("_before_us") >= idle_us)
    carry = (
        summary.withColumn("_before_us", F.lag("_last_us").over(chunks))
        .withColumn("_opened", F.when(opens, c("_first_frame")))
        .withColumn(
            "_carried",
            F.max(F.coalesce("_last_start", "_opened")).over(chunks.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(*part, "_before_us", F.coalesce("_opened", "_carried").alias("_open_start"))
    )
    return (
        lagged(rows)
        .withColumn("_start_in", F.max(starts_inside).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carry, part)
        .withColumn("prev_us", F.coalesce("_prev_in", "_before_us"))
        .withColumn("session_start", F.coalesce("_start_in", "_open_start"))
        .drop("_chunk", "_prev_in", "_before_us", "_start_in", "_open_start")
    )


def active_restarts(sessions: DataFrame, active_us: int = ACTIVE_US, staged: bool = False) -> DataFrame:
    """Flow starts inside idle sessions that last ``active_us`` or longer: one row per start.

    ``staged`` says that ``sessions`` is a stage table; otherwise its needed columns become one.
    """
    rows = sessions.select(*SESSION, "ts_us", F.col("frame_no").alias("pos"))
    rows = rows if staged else checkpoint(rows)
    long = (
        rows.groupBy(*SESSION)
        .agg((F.max("ts_us") - F.min("ts_us")).alias("_span"))
        .where(F.col("_span") >= active_us)
        .drop("_span")
    )
    return greedy_chain(rows.join(long, SESSION, "left_semi"), SESSION, active_us)


def split_active(sessions: DataFrame, active_us: int = ACTIVE_US, staged: bool = False) -> DataFrame:
    """Add ``flow_start``: a session restarts at the first packet ``active_us`` after the flow's start.

    The starts are rows of their own before their packets; the newest one so far is carried along each session in one scan, so wide
    packet rows are shuffled once.
    """
    c = F.col
    starts = active_restarts(sessions, active_us, staged).select(
        *SESSION, c("pos").alias("frame_no"), c("pos").alias("_start"), F.lit(0).alias("_turn"), F.lit(False).alias("_packet"))
    rows = sessions.withColumns({"_start": F.lit(None).cast("long"), "_turn": F.lit(1), "_packet": F.lit(True)})
    run = ordered_scan(rows.unionByName(starts, allowMissingColumns=True), SESSION, ["frame_no", "_turn"], {"_newest": ("last", "_start", True)},
                       keep="_packet")
    return run.select(*sessions.columns, F.coalesce("_newest", "session_start").alias("flow_start"))


def assign_flows(
    packets: DataFrame,
    idle_us: int = IDLE_US,
    active_us: int = ACTIVE_US,
    *,
    chunk_frames: int = FRAMES_PER_CHUNK,
) -> DataFrame:
    """Ordered packets with ``flow_start``, ``is_new`` and the gap to the flow's previous packet."""
    sessions = checkpoint(sessionize_idle(packets, idle_us, chunk_frames))
    flows = split_active(sessions, active_us, True)
    is_new = F.col("frame_no") == F.col("flow_start")
    return flows.withColumn("is_new", is_new).withColumn(
        "gap_us", F.when(~is_new, F.greatest(F.col("ts_us") - F.col("prev_us"), F.lit(0)))
    )


def flow_identities(flow_packets: DataFrame, chunk_frames: int = FRAMES_PER_CHUNK, exact: bool = True) -> DataFrame:
    """One row per flow with its id. ``exact`` numbers flows per capture, otherwise per key."""
    firsts = flow_packets.where("is_new").select(
        *FLOW, "frame_no", "ts_us", "flow_key", "a_ip", "a_port", "b_ip", "b_port", "protocol"
    )
    if exact:
        numbered = chunk_scan(
            firsts, ["capture_id"], frame_chunk(chunk_frames), [F.col("frame_no")],
            {"ordinal": ("sum", F.lit(1).cast("long"), False)},
        )
    else:
        per_key = Window.partitionBy("capture_id", "flow_key").orderBy("frame_no")
        numbered = firsts.withColumn("ordinal", F.row_number().over(per_key).cast("long") - 1)
    c = F.col
    return numbered.select(
        *FLOW,
        "ordinal",
        flow_id(
            c("a_ip"), c("a_port"), c("b_ip"), c("b_port"), c("protocol"), c("ts_us"), c("ordinal")
        ).alias("flow_id"),
    )


def numeric_stats(value: Column) -> Column:
    """count, minimum, maximum, mean and population variance of a numeric column, as an aggregate."""
    v = value.cast("double")
    return F.struct(
        F.count(v).alias("count"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"),
    )


def flag_columns() -> list[Column]:
    has = lambda name: F.array_contains("tcp_flags", name)
    return [F.count_if(has(name)).alias(f"flag_{name.lower()}") for name in TCP_FLAGS]


def flag_map() -> Column:
    """Flag name → count, without flags that never occurred."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("key"), F.col(f"flag_{name.lower()}").alias("value")) for name in TCP_FLAGS]
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def last_metadata(kind: str) -> Column:
    return F.max_by(F.col(kind), F.when(F.col(kind).isNotNull(), F.col("frame_no"))).alias(kind)


def aggregate_flows(flow_packets: DataFrame) -> DataFrame:
    """One record per flow; every aggregate has a partial stage before the shuffle."""
    c = F.col
    forward = c("direction") == "A_TO_B"

    def one_way(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("long"))

    payload = F.coalesce(c("payload_length"), F.lit(0))
    flat = flow_packets.groupBy(*FLOW).agg(
        *[F.first(x).alias(x) for x in ("flow_key", "a_ip", "a_port", "b_ip", "b_port", "protocol")],
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.max("frame_no").alias("last_frame"),
        F.max(c("is_new") & forward).alias("a_is_initiator"),
        F.count_if(forward).alias("packets_a_to_b"),
        F.count_if(~forward).alias("packets_b_to_a"),
        one_way(forward, c("packet_length")).alias("bytes_a_to_b"),
        one_way(~forward, c("packet_length")).alias("bytes_b_to_a"),
        one_way(forward, payload).alias("payload_bytes_a_to_b"),
        one_way(~forward, payload).alias("payload_bytes_b_to_a"),
        numeric_stats(c("packet_length")).alias("packet_size_stats"),
        numeric_stats(c("payload_length")).alias("payload_size_stats"),
        numeric_stats(c("gap_us") / 1_000_000).alias("inter_arrival_stats"),
        *flag_columns(),
        last_metadata("dns"),
        last_metadata("tls"),
        last_metadata("quic"),
    )
    flags = [f"flag_{name.lower()}" for name in TCP_FLAGS]
    return flat.withColumn("tcp_flag_counts", flag_map()).drop(*flags)


def orient(prefix_ab: str, prefix_ba: str) -> tuple[Column, Column]:
    """(outbound, inbound) of a directional pair; outbound is what the first sender sent."""
    a, b = F.col(prefix_ab), F.col(prefix_ba)
    first = F.col("a_is_initiator")
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def orient_flow(flows: DataFrame) -> DataFrame:
    out = flows
    for name, ab, ba in (
        ("packets", "packets_a_to_b", "packets_b_to_a"),
        ("bytes", "bytes_a_to_b", "bytes_b_to_a"),
        ("payload", "payload_bytes_a_to_b", "payload_bytes_b_to_a"),
    ):
        outbound, inbound = orient(ab, ba)
        out = out.withColumn(f"{name}_outbound", outbound).withColumn(f"{name}_inbound", inbound)
    source_ip, target_ip = orient("a_ip", "b_ip")
    source_port, target_port = orient("a_port", "b_port")
    return (
        out.withColumn("source_ip", source_ip)
        .withColumn("source_port", source_port)
        .withColumn("destination_ip", target_ip)
        .withColumn("destination_port", target_port)
    )


def flow_close_events(
    flow_packets: DataFrame, flows: DataFrame, idle_us: int = IDLE_US
) -> DataFrame:
    """When and why each flow closes, with the frame of the packet that triggers it.

    ``active``: the next flow of the same session starts. ``idle``: first later packet of the capture at
    least ``idle_us`` after the flow's last packet. ``end``: the capture ends; the last packet counts.
    """
    # One row per flow start, so the lead window sees flows, not packets.
    starts = flow_packets.where("is_new").select("capture_id", "flow_key", "session_start", "flow_start", "ts_us")
    in_session = Window.partitionBy(*SESSION).orderBy("flow_start")
    active = starts.select(
        *FLOW,
        F.lead("flow_start").over(in_session).alias("_next_frame"),
        F.lead("ts_us").over(in_session).alias("_next_us"),
    )
    base = flows.select(*FLOW, "last_seen_us").join(active, FLOW)
    arrivals = flow_packets.groupBy("capture_id", F.col("ts_us").alias("at_us")).agg(F.min("frame_no").alias("frame_no"))
    hits = first_at_or_after(
        base.withColumn("at_us", F.col("last_seen_us") + idle_us),
        arrivals,
        ["capture_id"],
        "at_us",
        F.struct("at_us", "frame_no"),
        "hit",
    )
    end = flow_packets.groupBy("capture_id").agg(
        F.max("ts_us").alias("_end_us"), F.max("frame_no").alias("_end_frame")
    )
    c = F.col
    split, idle = c("_next_frame").isNotNull(), c("hit").isNotNull()
    return hits.join(end, "capture_id").select(
        *FLOW,
        "last_seen_us",
        F.when(split, "active").when(idle, "idle").otherwise("end").alias("reason"),
        F.when(split, c("_next_us")).when(idle, c("hit.at_us")).otherwise(c("_end_us")).alias("close_us"),
        F.when(split, c("_next_frame")).when(idle, c("hit.frame_no")).otherwise(c("_end_frame")).alias("close_frame"),
    )


def snapshot_ticks(packets: DataFrame, every_us: int = SNAPSHOT_US) -> DataFrame:
    """Clock of a capture: first packet at least ``every_us`` after the last tick (or the first packet)."""
    rows = packets.select("capture_id", "ts_us", F.col("frame_no").alias("pos"))
    chain = greedy_chain(rows, ["capture_id"], every_us)
    first = packets.groupBy("capture_id").agg(F.min("frame_no").alias("pos"))
    return chain.join(first, ["capture_id", "pos"], "left_anti").select(
        "capture_id", F.col("pos").alias("tick_frame"), F.col("ts_us").alias("tick_us")
    )


def with_tick(flow_packets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Add the first tick at or after each packet (null after the last one)."""
    points = flow_packets.withColumn("_at", F.col("frame_no"))
    marks = ticks.select("capture_id", F.col("tick_frame").alias("_at"), "tick_us")
    hit = first_at_or_after(
        points, marks, ["capture_id"], "_at", F.struct(F.col("_at"), F.col("tick_us")), "_tick",
    )
    return hit.select(
        *flow_packets.columns, F.col("_tick._at").alias("tick_frame"), F.col("_tick.tick_us").alias("tick_us")
    )


_SUMS = (
    "packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a", "payload_bytes_a_to_b",
    "payload_bytes_b_to_a", "payload_count", "size_squares", "payload_squares", "gap_count", "gap_sum",
    "gap_squares", "syn_count",
)


def _increments() -> list[Column]:
    c = F.col
    forward = c("direction") == "A_TO_B"
    zero = F.lit(0).cast("long")
    size, payload = c("packet_length"), F.coalesce(c("payload_length"), zero)
    gap = F.coalesce(c("gap_us"), zero)
    pick = lambda cond, v: F.when(cond, v).otherwise(zero)
    one = F.lit(1).cast("long")
    values = (
        pick(forward, one), pick(~forward, one), pick(forward, size), pick(~forward, size),
        pick(forward, payload), pick(~forward, payload), pick(c("payload_length").isNotNull(), one),
        size * size, payload * payload, pick(c("gap_us").isNotNull(), one), gap, gap * gap,
        pick(F.array_contains(F.coalesce(c("tcp_flags"), F.array().cast("array<string>")), "SYN"), one),
    )
    return [v.cast("long").alias(n) for n, v in zip(_SUMS, values, strict=True)]


def _state_after_packets(flow_packets: DataFrame) -> DataFrame:
    """Sums and newest values run along each flow. Of dns, tls and quic the newest frame that has one is carried; their content is joined to it."""
    c, kinds = F.col, ("dns", "tls", "quic")
    shown = ["flow_key", "a_ip", "a_port", "b_ip", "b_port", "protocol"]
    first = lambda v: F.when(c("is_new"), v.cast("long"))
    rows = flow_packets.select(*FLOW, "frame_no", *shown, c("ts_us").alias("last_seen_us"), c("src_ip").alias("last_src_ip"),
                               first(c("ts_us")).alias("_first_us"), first(c("direction") == "A_TO_B").alias("_a_first"),
                               *[F.when(c(k).isNotNull(), c("frame_no")).alias(f"_has_{k}") for k in kinds], *_increments())
    rows = rows.withColumnsRenamed({n: f"_add_{n}" for n in _SUMS})
    folds = {"start_us": ("last", "_first_us", True), "_from_a": ("last", "_a_first", True)}
    folds |= {f"_of_{k}": ("last", f"_has_{k}", True) for k in kinds} | {n: ("sum", f"_add_{n}", True) for n in _SUMS}
    state = ordered_scan(rows, FLOW, ["frame_no"], folds)
    for k in kinds:  # one frame may be the newest for most packets of a flow: adaptive execution splits the packets' side
        content = flow_packets.where(c(k).isNotNull()).select(*FLOW, c("frame_no").alias(f"_of_{k}"), k)
        state = state.join(content, [*FLOW, f"_of_{k}"], "left")
    return state.select(*FLOW, "frame_no", *shown, "last_seen_us", c("frame_no").alias("last_frame"), "last_src_ip", "start_us",
                        (c("_from_a") == 1).alias("a_is_initiator"), *_SUMS, *kinds)


def running_flow_state(flow_packets: DataFrame, by: str = "frame_no") -> DataFrame:
    """Flow state after each packet, or after each tick when ``by`` is ``tick_frame``.

    After packets: one scan over even ranges of (flow, frame), so a flow may hold most packets. After ticks: an active limit
    bounds the ticks of a flow, and packets are summed per tick before the window; ``ENDPOINTS`` may be left out there.
    """
    if by == "frame_no":
        return _state_after_packets(flow_packets)
    shown = [n for n in ENDPOINTS if n in flow_packets.columns]
    steps = flow_packets.select(
        *FLOW, F.col(by).alias("_step"), "frame_no", "ts_us", "src_ip", *shown, "is_new", "direction", "dns", "tls", "quic", *_increments(),
        *([F.col("tick_us")] if by == "tick_frame" else []),
    )
    tick = [F.max("tick_us").alias("tick_us")] if by == "tick_frame" else []
    grouped = steps.groupBy(*FLOW, "_step").agg(
        *[F.first(x).alias(x) for x in shown],
        F.max("ts_us").alias("last_seen_us"),
        F.min("ts_us").alias("_first_us"),
        F.max("frame_no").alias("last_frame"),
        F.max_by("src_ip", "frame_no").alias("last_src_ip"),
        F.max(F.col("is_new") & (F.col("direction") == "A_TO_B")).alias("_a_first"),
        *[F.sum(n).alias(n) for n in _SUMS],
        last_metadata("dns"), last_metadata("tls"), last_metadata("quic"), *tick,
    )
    upto = Window.partitionBy(*FLOW).orderBy("last_frame").rowsBetween(Window.unboundedPreceding, 0)
    keep = [*shown, "last_seen_us", "last_frame", "last_src_ip"]
    return grouped.select(
        *FLOW,
        F.col("_step").alias(by),
        *(["tick_us"] if tick else []),
        *[k for k in keep if k != by],
        F.min("_first_us").over(upto).alias("start_us"),
        F.max("_a_first").over(upto).alias("a_is_initiator"),
        *[F.sum(n).over(upto).alias(n) for n in _SUMS],
        *[F.last(m, ignorenulls=True).over(upto).alias(m) for m in ("dns", "tls", "quic")],
    )


def state_measures(state: DataFrame) -> DataFrame:
    """Means and population variances from the running sums."""
    c = F.col
    n = c("packets_a_to_b") + c("packets_b_to_a")
    size = c("bytes_a_to_b") + c("bytes_b_to_a")
    payload = c("payload_bytes_a_to_b") + c("payload_bytes_b_to_a")
    gaps = c("gap_count")
    return (
        state.withColumn("packet_count", n)
        .withColumn("packet_size_mean", size / n)
        .withColumn("packet_size_variance", exact_variance(n, size, c("size_squares")))
        .withColumn("payload_size_variance", exact_variance(c("payload_count"), payload, c("payload_squares")))
        .withColumn("inter_arrival_mean", F.when(gaps > 0, c("gap_sum") / gaps / 1e6))
        .withColumn("inter_arrival_variance", exact_variance(gaps, c("gap_sum"), c("gap_squares")) / 1e12)
    )


def flow_snapshots(
    flow_packets: DataFrame, closes: DataFrame, ticks: DataFrame, min_packets: int = SNAPSHOT_MIN_PACKETS
) -> DataFrame:
    """Every flow state that gets scored: changed flows at ticks, and the rest when they close.

    ``observed_us`` / ``trigger_frame`` name the packet that caused the snapshot. At one packet closes
    come before the tick, so a tick at the closing frame no longer sees the flow.
    """
    c = F.col
    used = ("frame_no", "ts_us", "src_ip", "is_new", "direction", "packet_length", "payload_length", "gap_us", "tcp_flags", "dns", "tls", "quic")
    states = state_measures(running_flow_state(with_tick(flow_packets.select(*FLOW, *used), ticks), "tick_frame"))
    joined = states.join(
        closes.select(*FLOW, "reason", "close_us", "close_frame"), FLOW
    )
    # Told once a flow, not carried along with every packet.
    ends = flow_packets.where("is_new").groupBy(*FLOW).agg(*[F.first(x).alias(x) for x in ENDPOINTS])
    final = c("reason") == "end"
    ticked = (
        c("tick_frame").isNotNull()
        & (c("packet_count") >= min_packets)
        & ((c("tick_frame") < c("close_frame")) | (final & (c("tick_frame") <= c("close_frame"))))
    )
    # Where repeated rows give a flow two closes, the earlier one comes last, whatever order a join gives them.
    later = Window.partitionBy(*FLOW).orderBy("last_frame", c("close_frame").desc(), c("reason").desc())
    is_last = F.lead("last_frame").over(later).isNull()
    # The steps before the last one only matter when they were ticked.
    return (
        joined.withColumn("_ticked", ticked)
        .withColumn("_last", is_last)
        .where(c("_ticked") | c("_last"))
        .withColumn("snapshot_reason", F.when(c("_ticked"), "tick").otherwise(c("reason")))
        .withColumn("observed_us", F.when(c("_ticked"), c("tick_us")).otherwise(c("close_us")))
        .withColumn("trigger_frame", F.when(c("_ticked"), c("tick_frame")).otherwise(c("close_frame")))
        .drop("_ticked", "_last", "reason", "close_us", "close_frame", "tick_us", "tick_frame")
        .join(ends, FLOW)
    )


def changed_only(snapshots: DataFrame) -> DataFrame:
    """Drop a snapshot whose packet count equals the flow's previous one."""
    order = Window.partitionBy(*FLOW).orderBy("trigger_frame")
    return (
        snapshots.withColumn("_before", F.lag("packet_count").over(order))
        .where(~F.col("packet_count").eqNullSafe(F.col("_before")))
        .drop("_before")
    )
