"""Queries over derived packets: contracts, flows, windows, features, evidence, alerts, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.fixed import CAPABILITIES, EVIDENCE_POLICY
from flowloom.functions import ids, wire
from flowloom.operators import alerts as al
from flowloom.operators import contracts, evidence, features, flows, hostwindows, packets, telemetry
from flowloom.operators.flows import FLOW
from flowloom.operators.scan import ordered_scan
from flowloom.plans import inputs
from flowloom.plans.catalog import big, joined, query, r6, stages
from flowloom.plans.oracles import BEHAVIOUR_COLUMNS, WINDOW_ID, block, digest, iso, sql
from flowloom.plans.chain import Stages
from flowloom.session import checkpoint
from flowloom.sources.captures import packets_from_frames, with_header_metadata

c = F.col


# --- payload and frame fields ---------------------------------------------------------------------
def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up payload per event: a varying first byte and the md5 of the id."""
    return inputs.table(spark, sf, "events").selectExpr(
        "event_id", "unhex(concat(lpad(hex(pmod(event_id * 7 + 16, 256)), 2, '0'), '0303', "
        "lpad(hex(pmod(event_id, 3)), 4, '0'), md5(cast(event_id as string)))) as payload"
    )


PAYLOADS = """with p as (select event_id, printf('%02x', (event_id * 7 + 16) % 256) || '0303' || printf('%04x', event_id % 3)
  || md5(cast(event_id as varchar)) as h from events),
q as (select *, cast('0x' || substr(h, 1, 2) as bigint) as b0 from p) """


@query("tls_record_fields", PAYLOADS + """select event_id, b0 as record_type, cast('0x' || substr(h, 3, 4) as bigint) as record_version,
  cast('0x' || substr(h, 7, 4) as bigint) as record_length from q where b0 between 20 and 23 and event_id % 3 > 0""")
def tls_record_fields(spark, sf):
    fields = _payloads(spark, sf).select("event_id", wire.tls_record_fields(c("payload")).alias("t"))
    return fields.where(c("t").isNotNull()).select(
        "event_id", *[big(f"t.{n}", n) for n in ("record_type", "record_version", "record_length")]
    )


@query("quic_header_fields", PAYLOADS + """select event_id, b0 >= 128 as long_header, (b0 & 3) + 1 as packet_number_length,
  case when b0 >= 128 then cast('0x' || substr(h, 3, 8) as bigint) end as version, case when b0 >= 128 then (b0 >> 4) & 3 end as packet_type,
  case when b0 >= 128 then cast('0x' || substr(h, 11, 2) as bigint) end as connection_id_length from q where b0 & 64 <> 0""")
def quic_header_fields(spark, sf):
    fields = _payloads(spark, sf).select("event_id", wire.quic_header_fields(c("payload")).alias("q"))
    return fields.where(c("q").isNotNull()).select(
        "event_id", "q.long_header", big("q.packet_number_length", "packet_number_length"), big("q.version", "version"),
        big("q.packet_type", "packet_type"), big("q.destination_connection_id_length", "connection_id_length"),
    )


@query("ja3_fingerprint", """select event_id, md5('771,' || (event_id % 7) || '-' || (event_id % 11) || ',' || (user_id % 5) || '-16,,') as ja3 from events""")
def ja3_fingerprint(spark, sf):
    e = inputs.table(spark, sf, "events")
    return e.select("event_id", wire.ja3_fingerprint(
        F.lit(771), F.array(c("event_id") % 7, c("event_id") % 11), F.array(c("user_id") % 5, F.lit(16).cast("long"))
    ).alias("ja3"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Ethernet frames built from the derived packets: IPv4, some behind one VLAN tag, padded payload."""
    p = inputs.packets(spark, sf)
    hexed = lambda v, n: F.lpad(F.hex(v.cast("long")), n, "0")
    ip = lambda v: F.substring(ids.ip_sort_key(v), 2, 8)
    bits = F.aggregate(
        F.transform("tcp_flags", lambda f: F.expr("0") + sum(
            (F.when(f == n, F.lit(b)).otherwise(F.lit(0)) for n, b in (("SYN", 2), ("PSH", 8), ("ACK", 16))), F.lit(0))),
        F.lit(0), lambda a, x: a + x,
    )
    size = F.coalesce(c("payload_length"), F.lit(0))
    tcp, udp = c("protocol") == "TCP", c("protocol") == "UDP"
    head = F.when(tcp, F.lit(20)).when(udp, F.lit(8)).otherwise(F.lit(8))
    transport = F.when(
        tcp, F.concat(hexed(c("src_port"), 4), hexed(c("dst_port"), 4), F.lit("0" * 16 + "50"), hexed(bits, 2), F.lit("0" * 12))
    ).when(
        udp, F.concat(hexed(c("src_port"), 4), hexed(c("dst_port"), 4), hexed(size + 8, 4), F.lit("0000"))
    ).otherwise(F.lit("0800" + "0" * 12))
    vlan = F.when(c("frame_no") % 3 == 0, F.lit("81000005")).otherwise(F.lit(""))
    number = F.when(tcp, F.lit(6)).when(udp, F.lit(17)).when(c("protocol") == "ICMP", F.lit(1)).otherwise(F.lit(47))
    # Every 11th frame is a fragment and every 13th is cut short; both must be dropped.
    fragment = F.when(c("frame_no") % 11 == 0, F.lit("2000")).otherwise(F.lit("0000"))
    total = size + head + 20 + F.when(c("frame_no") % 13 == 0, F.lit(9)).otherwise(F.lit(0))
    text = F.concat(
        F.lit("0" * 24), vlan, F.lit("0800"), F.lit("4500"), hexed(total, 4), F.lit("0000"), fragment, F.lit("40"),
        hexed(number, 2), F.lit("0000"), ip(c("src_ip")), ip(c("dst_ip")), transport,
        F.repeat(F.lit("41"), size.cast("int")),
    )
    return p.select("capture_id", "frame_no", "ts_us", F.unhex(text).alias("frame"))


@query("packet_projection", sql("""select frame_no, ts_us, src_ip, dst_ip, cast(src_port as bigint) as src_port, cast(dst_port as bigint) as dst_port,
  protocol, payload_length, 14 + case when frame_no % 3 = 0 then 4 else 0 end + 20 + case protocol when 'TCP' then 20 else 8 end
  + coalesce(payload_length, 0) as packet_length, array_to_string(list_reverse_sort(string_split(tcp_flags, '|')), ',') as tcp_flags
  from packets where frame_no % 11 <> 0 and frame_no % 13 <> 0 and protocol <> 'OTHER'""", "packets"))
def packet_projection(spark, sf):
    return packets_from_frames(frames(spark, sf)).select(
        "frame_no", "ts_us", "src_ip", "dst_ip", big("src_port"), big("dst_port"), "protocol", "payload_length",
        "packet_length", F.array_join(F.sort_array("tcp_flags", asc=False), ",").alias("tcp_flags"),
    )


# --- contracts ------------------------------------------------------------------------------------
def _broken_packets(spark, sf):
    """Packets with rule breaks planted by frame number."""
    return inputs.packets(spark, sf).withColumn(
        "packet_length", F.when(c("frame_no") % 70 == 0, F.lit(-1)).otherwise(c("packet_length"))
    ).withColumn("dst_port", F.when(c("frame_no") % 90 == 0, F.lit(None)).when(c("frame_no") % 110 == 0, F.lit(70000)).otherwise(c("dst_port"))
    ).withColumn("tcp_flags", F.when(c("frame_no") % 130 == 0, F.array(F.lit("ACK"))).otherwise(c("tcp_flags")))


@query("validate_packets", sql("""select frame_no, array_to_string(list_filter([
  case when frame_no % 70 = 0 then 'negative_length' end,
  case when frame_no % 90 <> 0 and frame_no % 110 = 0 then 'port_range' end,
  case when protocol in ('TCP', 'UDP') and frame_no % 90 = 0 then 'ports_required' end,
  case when protocol <> 'TCP' and frame_no % 130 = 0 then 'flags_only_tcp' end], lambda x: x is not null), ',') as violations
  from packets""", "packets"))
def validate_packets(spark, sf):
    return contracts.validate_packets(_broken_packets(spark, sf)).select("frame_no", joined("violations", "violations"))


@query("validate_flows", sql("""select flow_start, array_to_string(list_filter([case when flow_start % 7 = 0 then 'time_order' end,
  case when flow_start % 11 = 0 then 'size_count' end, case when flow_start % 11 = 0 then 'inter_arrival_count' end], lambda x: x is not null), ',') as violations from flows""", "flows"))
def validate_flows(spark, sf):
    broken = stages(spark, sf).flows.withColumn(
        "last_seen_us", F.when(c("flow_start") % 7 == 0, c("start_us") - 1).otherwise(c("last_seen_us"))
    ).withColumn("packets_a_to_b", c("packets_a_to_b") + F.when(c("flow_start") % 11 == 0, F.lit(3)).otherwise(F.lit(0)))
    return contracts.validate_flows(broken).select("flow_start", joined("violations", "violations"))


@query("validate_features", sql("""select flow_start, trigger_frame, array_to_string(list_filter([case when flow_start % 7 = 0 then 'schema_version' end,
  case when flow_start % 9 = 0 and burst is not null then 'availability' end], lambda x: x is not null), ',') as violations from behaviour""", "behaviour"))
def validate_features(spark, sf):
    broken = stages(spark, sf).behaviour.withColumn(
        "schema_version", F.when(c("flow_start") % 7 == 0, F.lit("dns.v1")).otherwise(c("schema_version"))
    ).withColumn("feature__burstiness", F.when(c("flow_start") % 9 != 0, c("feature__burstiness")))
    return contracts.validate_feature_vectors(broken).select("flow_start", "trigger_frame", joined("violations", "violations"))


@query("validate_verdicts", sql("""select flow_start, trigger_frame, array_to_string(list_filter([case when flow_start % 5 = 0 then 'probability_range' end,
  case when flow_start % 7 = 0 then 'missing_not_required' end], lambda x: x is not null), ',') as violations from verdicts""", "verdicts"))
def validate_verdicts(spark, sf):
    broken = stages(spark, sf).verdicts.withColumn(
        "raw_score", F.when(c("flow_start") % 5 == 0, c("raw_score") + 1).otherwise(c("raw_score"))
    ).withColumn("missing_evidence", F.when(c("flow_start") % 7 == 0, F.array(F.lit("x"))).otherwise(c("missing_evidence")))
    return contracts.validate_verdicts(broken).select("flow_start", "trigger_frame", joined("violations", "violations"))


@query("validate_alerts", sql("""select alert_id, flow_start, trigger_frame, array_to_string(list_filter([
  case when flow_start % 5 = 0 then 'context_required' end,
  case when flow_start % 3 = 0 and decision = 'INSUFFICIENT_EVIDENCE' then 'decision_lists_missing' end,
  case when flow_start % 3 = 0 and quality = 'INSUFFICIENT' then 'quality_lists_missing' end], lambda x: x is not null), ',') as violations from alerts""", "alerts"))
def validate_alerts(spark, sf):
    a = stages(spark, sf).alerts
    gone = c("flow_start") % 5 == 0
    broken = a.withColumn("flow_id", F.when(~gone, c("flow_id"))).withColumn("window_id", F.when(~gone, c("window_id"))).withColumn(
        "missing_evidence", F.when(c("flow_start") % 3 == 0, F.array().cast("array<string>")).otherwise(c("missing_evidence")))
    return contracts.validate_alerts(broken).select("alert_id", "flow_start", "trigger_frame", joined("violations", "violations"))


# --- order, endpoints, ids ------------------------------------------------------------------------
@query("drop_out_of_order", sql("select frame_no, ts_us, late from marked", "marked"))
def drop_out_of_order(spark, sf):
    return packets.mark_out_of_order(packets.known_protocols(inputs.packets(spark, sf))).select("frame_no", "ts_us", "late")


@query("canonical_endpoints", sql("select frame_no, a_ip, cast(a_port as bigint) as a_port, b_ip, cast(b_port as bigint) as b_port from keyed", "keyed"))
def canonical_endpoints(spark, sf):
    return stages(spark, sf).ordered.select("frame_no", "a_ip", big("a_port"), "b_ip", big("b_port"))


@query("packet_direction", sql("select direction, protocol, count(*) as packets from keyed group by all", "keyed"))
def packet_direction(spark, sf):
    return stages(spark, sf).ordered.groupBy("direction", "protocol").agg(F.count("*").alias("packets"))


@query("flow_ids", sql("select flow_start, ordinal, flow_id from ids", "ids"))
def flow_ids(spark, sf):
    return stages(spark, sf).identities.select("flow_start", "ordinal", "flow_id")


@query("window_ids", sql(f"select frame_no, {WINDOW_ID('src_ip', 'ts_us')} as window_id from packets", "packets"))
def window_ids(spark, sf):
    return inputs.packets(spark, sf).select("frame_no", ids.window_id(c("src_ip"), c("ts_us"), 60).alias("window_id"))


@query("alert_ids", sql(f"""select frame_no, {digest('sx', "'behaviour'", "'DDOS'", "''", 'src_ip', iso('(ts_us - case when frame_no % 20 = 0 then ts_us % 1000000 else 0 end)'))} as alert_id from packets""", "packets"))
def alert_ids(spark, sf):
    p = inputs.packets(spark, sf)
    at = c("ts_us") - F.when(c("frame_no") % 20 == 0, c("ts_us") % 1_000_000).otherwise(F.lit(0))
    return p.select("frame_no", ids.alert_id(F.lit("behaviour"), F.lit("DDOS"), at, F.lit(None), c("src_ip")).alias("alert_id"))


@query("orient_flow", sql("""select flow_start, case when a_first then a_ip else b_ip end as source_ip, case when a_first then b_ip else a_ip end as destination_ip,
  cast(case when a_first then a_port else b_port end as bigint) as source_port, cast(case when a_first then b_port else a_port end as bigint) as destination_port,
  case when a_first then packets_a_to_b else packets_b_to_a end as packets_outbound, case when a_first then packets_b_to_a else packets_a_to_b end as packets_inbound,
  case when a_first then bytes_a_to_b else bytes_b_to_a end as bytes_outbound, case when a_first then payload_b_to_a else payload_a_to_b end as payload_inbound from flows""", "flows"))
def orient_flow(spark, sf):
    return flows.orient_flow(stages(spark, sf).flows).select(
        "flow_start", "source_ip", "destination_ip", big("source_port"), big("destination_port"), "packets_outbound",
        "packets_inbound", "bytes_outbound", "payload_inbound",
    )


@query("flow_capabilities", sql("""select flow_start, protocol = 'TCP' as has_tcp_flags, dns_name is not null as has_dns_query_name,
  dns_name is not null as has_dns_query_type, tls_frame is not null as has_tls_metadata,
  coalesce((select p.ja3 is not null from fp p where p.frame_no = f.tls_frame), false) as has_tls_fingerprint, quic_frame is not null as has_quic_metadata,
  packets_a_to_b > 0 and packets_b_to_a > 0 as has_bidirectional_stats from flows f""", "flows", "fp"))
def flow_capabilities(spark, sf):
    return stages(spark, sf).flows.select("flow_start", packets.flow_capabilities().alias("k")).select(
        "flow_start", *[f"k.{n}" for n in CAPABILITIES[3:]]
    )


@query("packet_capabilities", sql("""select p.frame_no, p.protocol = 'TCP' as has_tcp_flags, p.dns_name is not null as has_dns_query_name,
  f.tls_frame is not null as has_tls_metadata, case when p.tls_version is not null then p.ja3 is not null
     else coalesce((select t.ja3 is not null from fp t where t.frame_no = f.tls_frame), false) end as has_tls_fingerprint,
  f.quic_frame is not null as has_quic_metadata, f.packets_a_to_b > 0 and f.packets_b_to_a > 0 as has_bidirectional_stats
  from fp p join flows f using (capture_id, flow_start)""", "flows", "fp"))
def packet_capabilities(spark, sf):
    s = stages(spark, sf)
    return packets.packet_capabilities(s.flow_packets, s.flows).select(
        "frame_no", "has_tcp_flags", "has_dns_query_name", "has_tls_metadata", "has_tls_fingerprint", "has_quic_metadata",
        "has_bidirectional_stats",
    )


@query("scorable_flows", sql("""select flow_start, array_to_string(list_filter([case when protocol in ('TCP', 'UDP') then 'behaviour' end,
  case when dns_name is not null then 'dns' end, case when tls_frame is not null or quic_frame is not null then 'tls_quic' end], lambda x: x is not null), ',') as families from flows""", "flows"))
def scorable_flows(spark, sf):
    return stages(spark, sf).flows.select("flow_start", joined(packets.scorable(), "families"))


# --- flows ----------------------------------------------------------------------------------------
@query("flow_sessions_idle", sql("select frame_no, session_start, prev_us from sessions", "sessions"))
def flow_sessions_idle(spark, sf):
    return stages(spark, sf).sessions.select("frame_no", "session_start", "prev_us")


@query("flow_sessions_active", sql("select frame_no, session_start, flow_start from fp", "fp"))
def flow_sessions_active(spark, sf):
    return flows.split_active(stages(spark, sf).sessions).select("frame_no", "session_start", "flow_start")


@query("new_flow_marks", sql("""select p.frame_no, p.is_new, i.ordinal, row_number() over (partition by a_ip, a_port, b_ip, b_port, protocol order by p.frame_no) - 1 as key_ordinal
  from fp p join ids i on p.frame_no = i.flow_start where is_new""", "fp", "ids"))
def new_flow_marks(spark, sf):
    s = stages(spark, sf)
    per_key = flows.flow_identities(s.flow_packets, exact=False).select("flow_start", c("ordinal").alias("key_ordinal"))
    marks = s.flow_packets.where("is_new").select("flow_start", "frame_no", "is_new")
    return s.identities.join(per_key, "flow_start").join(marks, "flow_start").select("frame_no", "is_new", "ordinal", big("key_ordinal"))


@query("flow_records", sql("""select flow_start, a_ip, b_ip, protocol, start_us, last_seen_us, packets_a_to_b, packets_b_to_a, bytes_a_to_b, bytes_b_to_a,
  payload_a_to_b, payload_b_to_a, a_first as a_is_initiator, round(size_mean, 6) as size_mean, round(size_var, 6) as size_variance,
  round(payload_var, 6) as payload_variance, gap_n as gap_count, round(gap_mean, 10) as gap_mean, round(gap_var, 6) as gap_variance from flows""", "flows"))
def flow_records(spark, sf):
    return stages(spark, sf).flows.select(
        "flow_start", "a_ip", "b_ip", "protocol", "start_us", "last_seen_us", "packets_a_to_b", "packets_b_to_a",
        "bytes_a_to_b", "bytes_b_to_a", c("payload_bytes_a_to_b").alias("payload_a_to_b"),
        c("payload_bytes_b_to_a").alias("payload_b_to_a"), "a_is_initiator",
        r6("packet_size_stats.mean", "size_mean"), r6("packet_size_stats.variance", "size_variance"),
        r6("payload_size_stats.variance", "payload_variance"), c("inter_arrival_stats.count").alias("gap_count"),
        r6("inter_arrival_stats.mean", "gap_mean", 10), r6("inter_arrival_stats.variance", "gap_variance"),
    )


@query("numeric_stats", sql("""select protocol, src_ip, count(payload_length) as n, cast(min(payload_length) as double) as minimum, cast(max(payload_length) as double) as maximum,
  round(avg(payload_length), 6) as mean, round(var_pop(payload_length), 6) as variance from packets group by all""", "packets"))
def numeric_stats(spark, sf):
    grouped = inputs.packets(spark, sf).groupBy("protocol", "src_ip").agg(flows.numeric_stats(c("payload_length")).alias("s"))
    return grouped.select("protocol", "src_ip", c("s.count").alias("n"), "s.minimum", "s.maximum", r6("s.mean", "mean"), r6("s.variance", "variance"))


@query("inter_arrivals", sql("select frame_no, gap_us from fp", "fp"))
def inter_arrivals(spark, sf):
    return stages(spark, sf).flow_packets.select("frame_no", "gap_us")


@query("tcp_flag_counts", sql("""select flow_start, flag, count(*) as n from (select flow_start, unnest(string_split(tcp_flags, '|')) as flag from fp) group by all""", "fp"))
def tcp_flag_counts(spark, sf):
    return stages(spark, sf).flows.select("flow_start", F.explode("tcp_flag_counts").alias("flag", "n"))


@query("flow_last_metadata", sql("""select f.flow_start, f.dns_name, cast(t.tls_ciphers as bigint) as tls_ciphers, t.ja3, case when f.quic_frame is not null then q.quic_long end as quic_long
  from flows f left join fp t on t.frame_no = f.tls_frame left join fp q on q.frame_no = f.quic_frame""", "flows", "fp"))
def flow_last_metadata(spark, sf):
    return stages(spark, sf).flows.select(
        "flow_start", F.try_element_at("dns.queries", F.lit(1))["name"].alias("dns_name"),
        big("tls.cipher_suite_count", "tls_ciphers"), c("tls.ja3").alias("ja3"), c("quic.long_header").alias("quic_long"),
    )


@query("running_flow_state", sql("""select frame_no, count(*) over w as packets, cast(sum(packet_length) over w as bigint) as bytes, round(avg(packet_length) over w, 6) as size_mean,
  round(var_pop(packet_length) over w, 6) as size_variance, count(gap_us) over w as gaps from fp
  window w as (partition by capture_id, flow_start order by frame_no rows between unbounded preceding and current row)""", "fp"))
def running_flow_state(spark, sf):
    state = flows.state_measures(flows.running_flow_state(stages(spark, sf).flow_packets))
    return state.select(
        "frame_no", c("packet_count").alias("packets"), (c("bytes_a_to_b") + c("bytes_b_to_a")).alias("bytes"),
        r6("packet_size_mean", "size_mean"), r6("packet_size_variance", "size_variance"), c("gap_count").alias("gaps"),
    )


@query("flow_close_events", sql("select flow_start, reason, close_us, close_frame from closes", "closes"))
def flow_close_events(spark, sf):
    s = stages(spark, sf)
    return flows.flow_close_events(s.flow_packets, s.flows).select("flow_start", "reason", "close_us", "close_frame")


@query("snapshot_ticks", sql("select tick_frame, tick_us from ticks", "ticks"))
def snapshot_ticks(spark, sf):
    return flows.snapshot_ticks(stages(spark, sf).flow_packets).select("tick_frame", "tick_us")


@query("dirty_flow_snapshots", sql("select flow_start, snapshot_reason, n as packet_count, observed_us, trigger_frame from snaps", "snaps"))
def dirty_flow_snapshots(spark, sf):
    return stages(spark, sf).snapshots.select("flow_start", "snapshot_reason", "packet_count", "observed_us", "trigger_frame")


@query("changed_snapshots", sql("""select flow_start, trigger_frame, n as packet_count from (
  select *, lag(n) over (partition by capture_id, flow_start order by trigger_frame) as before from snaps) where n is distinct from before""", "snaps"))
def changed_snapshots(spark, sf):
    # The same snapshots twice, one frame apart: the copies add nothing and must go.
    s = stages(spark, sf).snapshots
    doubled = s.select(*FLOW, "trigger_frame", "packet_count")
    copies = doubled.withColumn("trigger_frame", c("trigger_frame") + 1)
    return flows.changed_only(doubled.unionByName(copies)).select("flow_start", "trigger_frame", "packet_count")


# --- host windows, read at every packet -----------------------------------------------------------
@query("traffic_events", sql("""select p.frame_no, p.ts_us, i.flow_id, p.src_ip, p.dst_ip, cast(p.dst_port as bigint) as dst_port, p.protocol, p.packet_length, p.is_new,
  coalesce(p.dns_name, '') as domains from fp p join ids i using (capture_id, flow_start)""", "fp", "ids"))
def traffic_events(spark, sf):
    s = stages(spark, sf)
    return s.events.join(s.identities.select(*FLOW, "flow_id"), FLOW).select(
        "frame_no", "ts_us", "flow_id", "src_ip", "dst_ip", big("dst_port"), "protocol", "packet_length", "is_new", joined("domains", "domains"),
    )


def _at_packets(spark, sf, widths=(60,)):
    """Events, and one read point per packet."""
    events = hostwindows.with_widths(stages(spark, sf).events, widths)
    points = events.select(
        "capture_id", "width_us", "src_ip", "dst_ip", "ts_us", c("frame_no").alias("trigger_frame")
    )
    return events, points


def _source(spark, sf, *names, widths=(60,)):
    events, points = _at_packets(spark, sf, widths)
    return hostwindows.source_windows(events, points.drop("dst_ip"), set(names))


def _target(spark, sf, *names):
    events, points = _at_packets(spark, sf)
    return hostwindows.target_windows(events, points.drop("src_ip"), set(names))


def _each(select: str, match: str, extra: str = "") -> str:
    return sql(f"""select p.frame_no, {select} from fp p join fp e on {match} and e.capture_id = p.capture_id and e.frame_no <= p.frame_no
  and e.ts_us >= p.ts_us - 60000000 {extra} group by p.frame_no""", "fp")


def _frame():
    return c("trigger_frame").alias("frame_no")


@query("src_window_volume", _each("count(*) as packets, cast(sum(e.packet_length) as bigint) as bytes", "e.src_ip = p.src_ip"))
def src_window_volume(spark, sf):
    return _source(spark, sf, "packet_count").select(_frame(), c("packet_count").alias("packets"), c("byte_count").alias("bytes"))


@query("src_window_flows", _each("count(*) filter (e.is_new) as flows", "e.src_ip = p.src_ip"))
def src_window_flows(spark, sf):
    return _source(spark, sf, "flow_count").select(_frame(), c("flow_count").alias("flows"))


@query("src_window_diversity", _each("count(distinct e.dst_ip) as destinations, count(distinct e.dst_port) as ports", "e.src_ip = p.src_ip"))
def src_window_diversity(spark, sf):
    return _source(spark, sf, "unique_destinations", "unique_destination_ports").select(
        _frame(), c("unique_destinations").alias("destinations"), c("unique_destination_ports").alias("ports"))


@query("inbound_window_bytes", sql("""select p.frame_no, cast(coalesce(sum(e.packet_length), 0) as bigint) as inbound_bytes from fp p left join fp e
  on e.dst_ip = p.src_ip and e.frame_no <= p.frame_no and e.ts_us >= p.ts_us - 60000000 group by p.frame_no""", "fp"))
def inbound_window_bytes(spark, sf):
    events, points = _at_packets(spark, sf)
    asked = points.select("capture_id", "width_us", c("src_ip").alias("dst_ip"), "ts_us", "trigger_frame")
    return hostwindows.target_windows(events, asked, {"inbound_bytes"}).select(_frame(), "inbound_bytes")


@query("target_window", _each("count(*) as packets, count(distinct e.src_ip) as sources, round(count(*) filter (e.protocol = 'UDP') / count(*), 6) as udp_share", "e.dst_ip = p.dst_ip"))
def target_window(spark, sf):
    t = _target(spark, sf, "target_packet_count", "unique_sources")
    return t.select(_frame(), c("target_packet_count").alias("packets"), c("unique_sources").alias("sources"),
                    r6(c("udp_packets") / F.greatest(c("target_packet_count"), F.lit(1)), "udp_share"))


def _pair_counts(spark, sf, own: str, measure: str) -> DataFrame:
    """Long form of the count maps at ticks: one row per (host, tick, peer) with a positive count.

    A pair's count is constant between its changes, so each stretch is matched to the ticks inside it
    by tick number; nothing but result rows is made.
    """
    s = stages(spark, sf)
    events = hostwindows.with_widths(s.events, [60])
    pairs = hostwindows.pair_totals(events)
    # The next step of a pair is the newest one of a scan downwards.
    downwards = pairs.select(*hostwindows.PAIR, "at_us", "seq", c(measure).alias("n"), (-c("step_no")).alias("down"))
    next_step = {"to_us": ("last", "at_us", False), "to_seq": ("last", "seq", False)}
    stretches = ordered_scan(downwards, hostwindows.PAIR, ["down"], next_step).where(c("n") > 0).select(
        "capture_id", "src_ip", "dst_ip", "n", c("at_us").alias("from_us"), c("seq").alias("from_seq"), "to_us", "to_seq")
    # One tick per second at most: a small table of one capture's clock, matched by whole second.
    ticks = s.ticks.select("capture_id", "tick_us", "tick_frame", (c("tick_us") / 1_000_000).cast("long").alias("second"))
    span = stretches.withColumn("second", F.explode(F.sequence((c("from_us") / 1_000_000).cast("long"), (c("to_us") / 1_000_000).cast("long"))))
    begun = (c("tick_us") > c("from_us")) | ((c("tick_us") == c("from_us")) & (c("tick_frame") >= c("from_seq")))
    over = (c("tick_us") > c("to_us")) | ((c("tick_us") == c("to_us")) & (c("tick_frame") >= c("to_seq")))
    peer = "dst_ip" if own == "src_ip" else "src_ip"
    return span.join(ticks, ["capture_id", "second"]).where(begun & ~over).select(
        c(own).alias("host"), "tick_frame", c(peer).alias("peer"), "n"
    )


def _tick_counts(own: str, peer: str, extra: str) -> str:
    return sql(f"""select e.{own} as host, t.tick_frame, e.{peer} as peer, count(*) as n from ticks t join fp e on e.capture_id = t.capture_id
  and e.frame_no <= t.tick_frame and e.ts_us >= t.tick_us - 60000000 {extra} group by all""", "fp", "ticks")


@query("dst_counts", _tick_counts("src_ip", "dst_ip", "and e.is_new"))
def dst_counts(spark, sf):
    return _pair_counts(spark, sf, "src_ip", "new")


@query("src_counts", _tick_counts("dst_ip", "src_ip", ""))
def src_counts(spark, sf):
    return _pair_counts(spark, sf, "dst_ip", "n")


TOTAL = """select p.frame_no, count(*) as total_packets from fp p join fp e on e.capture_id = p.capture_id and e.frame_no <= p.frame_no
  and e.ts_us >= p.ts_us - 60000000 group by p.frame_no"""


@query("total_window_packets", sql(TOTAL, "fp"))
def total_window_packets(spark, sf):
    events, points = _at_packets(spark, sf)
    asked = points.drop("src_ip", "dst_ip")
    return hostwindows.total_window_packets(events, asked).select(_frame(), c("total_window_packets").alias("total_packets"))


@query("history_complete", sql(f"select frame_no, total_packets <= 1000 as history_complete from ({TOTAL})", "fp"))
def history_complete(spark, sf):
    events, points = _at_packets(spark, sf)
    total = hostwindows.total_window_packets(events, points.drop("src_ip", "dst_ip"))
    return total.select(_frame(), hostwindows.history_complete(c("total_window_packets"), 1000).alias("history_complete"))


@query("connection_times", sql("""select p.frame_no, count(e.frame_no) as connections, max(e.ts_us) as latest_us,
  cast(coalesce(max(e.ts_us) - min(e.ts_us), 0) as bigint) as span_us
  from fp p left join fp e on e.src_ip = p.src_ip and e.dst_ip = p.dst_ip and e.is_new and e.frame_no <= p.frame_no
  and e.ts_us >= p.ts_us - 60000000 group by p.frame_no""", "fp"))
def connection_times(spark, sf):
    events, points = _at_packets(spark, sf)
    seen = hostwindows.pair_totals(events, points).where("is_point")
    some = c("new") > 0
    return seen.select(c("seq").alias("frame_no"), c("new").alias("connections"), F.when(some, c("last_us")).alias("latest_us"), c("gap").alias("span_us"))


@query("recent_domains", _each("count(e.dns_name) as names, count(distinct e.dns_name) as unique_names", "e.src_ip = p.src_ip"))
def recent_domains(spark, sf):
    return _source(spark, sf, "domain_count", "unique_domains").select(_frame(), c("domain_count").alias("names"), c("unique_domains").alias("unique_names"))


@query("history_seconds", _each("round((any_value(p.ts_us) - min(e.ts_us)) / 1e6, 6) as history_seconds", "e.src_ip = p.src_ip"))
def history_seconds(spark, sf):
    return _source(spark, sf, "first_us").select(_frame(), r6((c("ts_us") - c("first_us")) / 1_000_000, "history_seconds"))


@query("short_flow_ratio", sql("""select frame_no, round(count(*) filter (span <= 2000000) / count(*), 6) as short_flow_ratio from (
  select p.frame_no, e.flow_start, max(e.ts_us) - min(e.ts_us) as span from fp p join fp e on e.src_ip = p.src_ip and e.frame_no <= p.frame_no
  and e.ts_us >= p.ts_us - 60000000 group by all) group by frame_no""", "fp"))
def short_flow_ratio(spark, sf):
    w = _source(spark, sf, "short_flows")
    return w.select(_frame(), r6(c("short_flows") / c("window_flows"), "short_flow_ratio"))


@query("burstiness", sql("""select frame_no, round(case when count(*) >= 2 then stddev_pop(n) / avg(n) end, 6) as burstiness from (
  select p.frame_no, e.ts_us // 1000000 as b, count(*) as n from fp p join fp e on e.dst_ip = p.dst_ip and e.frame_no <= p.frame_no
  and e.ts_us >= p.ts_us - 60000000 group by all) group by frame_no""", "fp"))
def burstiness(spark, sf):
    w = _target(spark, sf, "target_packet_count", "bins")
    return w.select(_frame(), r6(hostwindows.burstiness(c("target_packet_count"), c("bins"), c("bin_squares")), "burstiness"))


@query("temporal_snapshot", sql("""select src_ip, dst_ip, ts_us, trigger_frame, cast(w_packets as bigint) as packets, cast(w_bytes as bigint) as bytes, w_flows as flows, w_dsts as destinations,
  w_ports as ports, w_names as names, w_unique_names as unique_names, round(history, 6) as history_seconds, w_n as window_flows, w_short as short_flows,
  round(dst_entropy, 6) as destination_entropy, cast(w_inbound as bigint) as inbound_bytes, t_packets as target_packets, t_udp as udp_packets, t_sources as sources,
  round(src_entropy, 6) as source_entropy, round(burst, 6) as burstiness, conns as connections, w_total as total_packets from windows""", "windows"))
def temporal_snapshot(spark, sf):
    from flowloom.functions.values import entropy_from_sums

    some = c("w_packet_count") > 0
    return stages(spark, sf).windows.select(
        "src_ip", "dst_ip", "ts_us", "trigger_frame", c("w_packet_count").alias("packets"), c("byte_count").alias("bytes"),
        c("flow_count").alias("flows"), c("unique_destinations").alias("destinations"), c("unique_destination_ports").alias("ports"),
        c("domain_count").alias("names"), c("unique_domains").alias("unique_names"),
        r6(F.when(some, (c("ts_us") - c("first_us")) / 1_000_000).otherwise(F.lit(0.0)), "history_seconds"),
        "window_flows", "short_flows", r6(entropy_from_sums(c("flow_count"), c("destination_nlogn")), "destination_entropy"),
        "inbound_bytes", c("target_packet_count").alias("target_packets"), "udp_packets", c("unique_sources").alias("sources"),
        r6(entropy_from_sums(c("target_packet_count"), c("source_nlogn")), "source_entropy"),
        r6(hostwindows.burstiness(c("target_packet_count"), c("bins"), c("bin_squares")), "burstiness"),
        c("connection_count").alias("connections"), c("total_window_packets").alias("total_packets"),
    )


@query("multi_window_rates", sql("""select p.frame_no, w.width_s, round(count(*) / w.width_s, 6) as packets_per_second, round(sum(e.packet_length)::double / w.width_s, 6) as bytes_per_second,
  round(count(*) filter (e.is_new) / w.width_s, 6) as flows_per_second from fp p cross join (values (10), (60), (300)) w(width_s)
  join fp e on e.src_ip = p.src_ip and e.frame_no <= p.frame_no and e.ts_us >= p.ts_us - w.width_s * 1000000 group by p.frame_no, w.width_s""", "fp"))
def multi_window_rates(spark, sf):
    w = _source(spark, sf, "packet_count", widths=(10, 60, 300))
    width = (c("width_us") / 1_000_000).cast("int")
    return w.select(_frame(), width.alias("width_s"), r6(c("packet_count") / width, "packets_per_second"),
                    r6(c("byte_count") / width, "bytes_per_second"), r6(c("flow_count") / width, "flows_per_second"))


def digits(name: str) -> int:
    """Means of microsecond gaps are shown to ten places: at six, half of a microsecond is a tie."""
    return 10 if name in ("inter_arrival_mean", "mean_connection_interval") else 6


# --- feature vectors ------------------------------------------------------------------------------
@query("behaviour_features", sql("select flow_id, trigger_frame, window_id, complete as history_complete, " + ", ".join(
    f"round(cast({e} as double), {digits(n)}) as {n}" for n, e in BEHAVIOUR_COLUMNS.items()) + " from behaviour", "behaviour"))
def behaviour_features(spark, sf):
    b = stages(spark, sf).behaviour
    return b.select(c("entity_id").alias("flow_id"), "trigger_frame", "window_id", c("feature__history_complete").alias("history_complete"),
                    *[r6(f"feature__{n}", n, digits(n)) for n in BEHAVIOUR_COLUMNS])


block("d", """select *, string_split(dns_name, '.') as labels, string_split(replace(dns_name, '.', ''), '') as chars,
  (select count(*) from fp e where e.src_ip = s.src_ip and e.dns_name = s.dns_name and e.frame_no <= s.trigger_frame and e.ts_us >= s.observed_us - 60000000) as freq
  from snaprows s where dns_name is not null""", "snaprows", "fp")

DNS_SQL = f"""select 'dns:' || last_src_ip as entity_id, trigger_frame, flow_start, {WINDOW_ID('last_src_ip', 'observed_us')} as window_id,
  len(dns_name)::double as domain_length, greatest(len(labels) - 2, 0)::double as subdomain_count,
  round(list_sum(list_transform(labels, lambda x: len(x))) / len(labels), 6) as mean_label_length,
  round(len(list_filter(chars, lambda x: x between '0' and '9')) / len(chars), 6) as digit_ratio,
  round(len(list_filter(chars, lambda x: x between 'a' and 'z')) / len(chars), 6) as letter_ratio,
  round(list_entropy, 6) as character_entropy, 1.0::double as query_type, freq::double as query_frequency,
  round(case when w_names > 0 then w_unique_names / w_names end, 6) as unique_domain_ratio, {{buckets}}
from d left join (select dns_name, greatest(0.0, -sum(n / t * log2(n / t))) + 0.0 as list_entropy from (
    select *, sum(n) over (partition by dns_name) as t from (select dns_name, ch, count(*)::double as n from (
      select dns_name, unnest(string_split(replace(dns_name, '.', ''), '')) as ch from (select distinct dns_name from d)) group by all)) group by all) using (dns_name)
left join (select dns_name, {{counts}} from (select dns_name, b.bucket from (
    select dns_name, substr(dns_name, i, 2) as pair from (select dns_name, unnest(range(1, len(dns_name))) as i from (select distinct dns_name from d)))
    join bigram_table b using (pair)) group by all) using (dns_name)"""


@query("dns_features", sql(DNS_SQL.format(
    buckets=", ".join(f"coalesce(b{i}, 0)::double as bigram_bucket_{i}" for i in range(8)),
    counts=", ".join(f"count(*) filter (bucket = {i}) as b{i}" for i in range(8))), "d", "bigram_table"))
def dns_features(spark, sf):
    names = ("domain_length", "subdomain_count", "mean_label_length", "digit_ratio", "letter_ratio", "character_entropy",
             "query_type", "query_frequency", "unique_domain_ratio", *[f"bigram_bucket_{i}" for i in range(8)])
    return stages(spark, sf).dns().select("entity_id", "trigger_frame", "flow_start", "window_id", *[r6(f"feature__{n}", n) for n in names])


@query("tls_quic_features", sql("""select flow_id, trigger_frame, window_id, duration as flow_duration_seconds, n::double as packet_count,
  (by_ab + by_ba)::double as total_bytes, round(size_mean, 6) as packet_size_mean, round(size_var, 6) as packet_size_variance,
  round(gap_mean, 10) as inter_arrival_mean, round(gap_var, 6) as inter_arrival_variance, pk_ab::double as packets_a_to_b, round(by_ab / (by_ba + 1), 6) as directional_byte_ratio,
  tls_version::double as tls_record_version, case when tls_version is not null then tls_ciphers::double end as tls_cipher_suite_count,
  case when tls_version is not null then tls_extensions::double end as tls_extension_count, f.bucket::double as tls_fingerprint_bucket,
  case when has_quic and tls_version is null then 1.0::double end as quic_version,
  case when has_quic then case when tls_version is null then quic_long::int::double else 0.0 end end as quic_long_header,
  round(conns / greatest(w_packets, 1), 6) as destination_recurrence, round(w_flows / 60.0, 6) as connection_frequency
  from behaviour left join fingerprint_table f using (ja3) where tls_version is not null or has_quic""", "behaviour", "fingerprint_table"))
def tls_quic_features(spark, sf):
    exact = ("flow_duration_seconds", "packet_count", "total_bytes", "packets_a_to_b", "tls_record_version",
             "tls_cipher_suite_count", "tls_extension_count", "tls_fingerprint_bucket", "quic_version", "quic_long_header")
    rounded = ("packet_size_mean", "packet_size_variance", "inter_arrival_mean", "inter_arrival_variance",
               "directional_byte_ratio", "destination_recurrence", "connection_frequency")
    t = stages(spark, sf).tls_quic()
    return t.select(c("entity_id").alias("flow_id"), "trigger_frame", "window_id", *[c(f"feature__{n}").alias(n) for n in exact],
                    *[r6(f"feature__{n}", n, digits(n)) for n in rounded])


@query("feature_table", sql("""select case when t_udp > 0 then 'DDOS' else 'BENIGN' end as label, 'host:' || src_ip as group_id, 'events' as source_name, 'behaviour' as family,
  flow_id as entity_id, window_id, round(size_mean, 6) as packet_size_mean, burst is not null as burstiness_available from behaviour""", "behaviour"))
def feature_table(spark, sf):
    s = stages(spark, sf)
    labels = s.snapshot_rows.select(
        *FLOW, "trigger_frame", F.when(c("udp_packets") > 0, "DDOS").otherwise("BENIGN").alias("label"),
        F.concat(F.lit("host:"), "src_ip").alias("group_id"), F.lit("events").alias("source_name"))
    table = features.feature_table(s.behaviour, labels, [*FLOW, "trigger_frame"])
    return table.select("label", "group_id", "source_name", "family", "entity_id", "window_id",
                        r6("feature__packet_size_mean", "packet_size_mean"), c("available__burstiness").alias("burstiness_available"))


# --- evidence and alerts --------------------------------------------------------------------------
PROBE_CLASSES = ("BENIGN", "DDOS", "C2", "BOT_OR_C2_LIKE", "RECON", "EXFILTRATION", "DGA", "DNS_TUNNEL", "SUSPICIOUS_ENCRYPTED", "UNKNOWN")


def _probes(spark, sf) -> DataFrame:
    """Gate inputs that walk through all classes, with capabilities and evidence switched by id bits."""
    e = inputs.table(spark, sf, "events").selectExpr("event_id", "user_id", "value")
    every = sorted({n for p in EVIDENCE_POLICY.values() for n in (*p.get("required_evidence", ()), *p.get("minimum_evidence", ()))})
    entries = F.array(*[
        F.struct(F.lit(n).alias("key"), (c("event_id") % (5 + i)).cast("double").alias("value")) for i, n in enumerate(every)
    ])
    held = F.filter(entries, lambda p: p["value"] != 0)
    caps = F.struct(*[((c("event_id") % (2 + i)) != 0).alias(n) for i, n in enumerate(CAPABILITIES)])
    return e.select(
        "event_id", F.get(F.array(*[F.lit(n) for n in PROBE_CLASSES]), (c("event_id") % 10).cast("int")).alias("threat_class"),
        ((c("user_id") % 101) / 100.0).alias("calibrated_confidence"),
        F.when(c("event_id") % 4 != 0, F.lit(0.6)).alias("class_threshold"),
        F.when(c("event_id") % 6 == 0, F.array(F.lit("own_gap"))).otherwise(F.array().cast("array<string>")).alias("missing_evidence"),
        F.map_from_entries(held).alias("evidence"),
        F.create_map(F.lit("history_complete"), c("event_id") % 3 != 0).alias("evidence_flags"), caps.alias("capabilities"),
    )


def _probe_sql() -> str:
    every = sorted({n for p in EVIDENCE_POLICY.values() for n in (*p.get("required_evidence", ()), *p.get("minimum_evidence", ()))})
    value = {n: f"nullif(event_id % {5 + i}, 0)" for i, n in enumerate(every)}
    cap = {n: f"event_id % {2 + i} <> 0" for i, n in enumerate(CAPABILITIES)}

    def cases(build) -> str:
        arms = " ".join(f"when {i} then {build(EVIDENCE_POLICY[n])}" for i, n in enumerate(PROBE_CLASSES) if n in EVIDENCE_POLICY)
        return f"case event_id % 10 {arms} else [] end"

    def listed(items) -> str:
        return "list_filter([" + ", ".join(items) + "], lambda x: x is not null)" if items else "[]::varchar[]"

    caps = cases(lambda p: listed([f"case when not ({cap[n]}) then '{n}' end" for n in p.get("required_capabilities", [])]))
    either = cases(lambda p: listed(
        ["case when not (" + " or ".join(cap[n] for n in p["any_capabilities"]) + ") then 'one_of:" + ",".join(p["any_capabilities"]) + "' end"]
        if p.get("any_capabilities") else []))
    needs = cases(lambda p: listed([f"case when {value[n]} is null then '{n}' end" for n in p.get("required_evidence", [])]))
    least = cases(lambda p: listed([f"case when coalesce({value[n]}, -1) < {m} then '{n}>={m}' end" for n, m in p.get("minimum_evidence", {}).items()]))
    true = cases(lambda p: listed([f"case when event_id % 3 = 0 then '{n}' end" for n in p.get("required_true", [])]))
    strong = " ".join(f"when {i} then {str(len(EVIDENCE_POLICY[n].get('required_evidence', [])) >= 3).lower()}" for i, n in enumerate(PROBE_CLASSES) if n in EVIDENCE_POLICY)
    names = "[" + ", ".join(f"'{n}'" for n in PROBE_CLASSES) + "]"
    return f"""with g as (select event_id, user_id, {names}[event_id % 10 + 1] as threat_class, (user_id % 101) / 100.0::double as conf,
  event_id % 10 = 0 as benign, {caps} as caps, {either} as either, {needs} as needs, {least} as least, {true} as trues,
  case event_id % 10 {strong} else false end as strong from events),
m as (select *, case when benign then [] else list_concat(case when event_id % 6 = 0 then ['own_gap'] else [] end,
  case when event_id % 10 = 9 then ['{evidence.NO_POLICY}'] else [] end, case when event_id % 4 = 0 then ['{evidence.NO_THRESHOLD}'] else [] end,
  caps, either, list_filter(needs, lambda x: true), least, trues) end as missing from g) """


PROBE_SQL = _probe_sql()


@query("gate_capabilities", PROBE_SQL + "select event_id, threat_class, array_to_string(list_concat(caps, either), ',') as missing from m")
def gate_capabilities(spark, sf):
    return _probes(spark, sf).select("event_id", "threat_class", joined(F.concat(evidence.missing_capabilities(), evidence.missing_any_capability()), "missing"))


@query("gate_evidence", PROBE_SQL + "select event_id, threat_class, array_to_string(list_concat(needs, least, trues), ',') as missing from m")
def gate_evidence(spark, sf):
    return _probes(spark, sf).select("event_id", "threat_class", joined(F.concat(evidence.missing_evidence(), evidence.below_minimum(), evidence.not_true()), "missing"))


# No text is listed twice under the policy: own gaps, names, minima and flags all differ.
@query("gate_missing", PROBE_SQL + "select event_id, array_to_string(missing, ',') as missing from m")
def gate_missing(spark, sf):
    return evidence.evidence_gate(_probes(spark, sf)).select("event_id", joined("gate_missing", "missing"))


@query("evidence_gate", PROBE_SQL + """select event_id, case when benign then null when len(missing) > 0 then 'INSUFFICIENT_EVIDENCE' when conf >= 0.6 then 'ACCEPT' when conf >= 0.5 then 'UNKNOWN_SUSPICIOUS' end as decision,
  case when benign then 'ADEQUATE' when len(missing) > 0 then 'INSUFFICIENT' when conf >= 0.6 then case when strong then 'STRONG' else 'ADEQUATE' end when conf >= 0.5 then 'ADEQUATE' else 'WEAK' end as quality from m""")
def evidence_gate(spark, sf):
    return evidence.evidence_gate(_probes(spark, sf)).select("event_id", "decision", c("evidence_quality").alias("quality"))


@query("severity_lookup", f"""select event_id, case [{', '.join(f"'{n}'" for n in PROBE_CLASSES)}][event_id % 10 + 1] when 'DDOS' then 'HIGH' when 'C2' then 'HIGH' when 'BOT_OR_C2_LIKE' then 'HIGH'
  when 'RECON' then 'MEDIUM' when 'EXFILTRATION' then 'HIGH' when 'DGA' then 'MEDIUM' when 'DNS_TUNNEL' then 'HIGH' when 'SUSPICIOUS_ENCRYPTED' then 'MEDIUM' else 'LOW' end as severity from events""")
def severity_lookup(spark, sf):
    return _probes(spark, sf).select("event_id", evidence.severity(c("threat_class")).alias("severity"))


ALERT_COLUMNS = """alert_id, flow_id, window_id, last_seen_us as ts_us, threat_class, severity, decision, quality as evidence_quality,
  round(calibrated, 6) as calibrated_confidence, round(raw_score, 6) as raw_score, threshold as class_threshold, src_ip as source_ip, cast(src_port as bigint) as source_port,
  dst_ip as destination_ip, cast(dst_port as bigint) as destination_port, array_to_string(missing, ',') as missing_evidence"""


def _alert_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "alert_id", "flow_id", "window_id", "ts_us", "threat_class", "severity", "decision", "evidence_quality",
        r6("calibrated_confidence"), r6("raw_score"), "class_threshold", "source_ip", big("source_port"), "destination_ip",
        big("destination_port"), joined("missing_evidence", "missing_evidence"),
    )


@query("alerts", sql(f"select {ALERT_COLUMNS} from alerts", "alerts"))
def alerts(spark, sf):
    return _alert_columns(stages(spark, sf).alerts)


@query("dedupe_alerts", sql(f"select {ALERT_COLUMNS} from kept_alerts", "kept_alerts"))
def dedupe_alerts(spark, sf):
    return _alert_columns(al.dedupe_alerts(stages(spark, sf).alerts))


@query("decision_counts", sql("select coalesce(decision, 'NO_ALERT') as decision, count(*) as verdicts from gated group by all", "gated"))
def decision_counts(spark, sf):
    return al.decision_counts(stages(spark, sf).gated)


@query("latest_alerts", sql("select alert_id, last_seen_us as ts_us, threat_class from kept_alerts order by last_seen_us desc, alert_id limit 100", "kept_alerts"))
def latest_alerts(spark, sf):
    return al.latest_alerts(stages(spark, sf).kept_alerts, 100).select("alert_id", "ts_us", "threat_class")


@query("alert_lookup", sql("select alert_id, last_seen_us as ts_us, threat_class, decision from alerts where alert_id = (select max(alert_id) from alerts)", "alerts"))
def alert_lookup(spark, sf):
    stored = checkpoint(stages(spark, sf).alerts.select("alert_id", "ts_us", "threat_class", "decision"))
    newest = stored.agg(F.max("alert_id")).first()[0]
    return al.alert_by_id(stored, newest)  # a literal: the scan gets it as a filter


EVIDENCE_SQL = sql("select alert_id, flow_start, trigger_frame, unnest([" + ", ".join(
    f"{{'kind': 'evidence', 'name': '{n}', 'number': round(cast({e} as double), {digits(n)}), 'flag': null::boolean}}" for n, e in BEHAVIOUR_COLUMNS.items())
    + ", {'kind': 'evidence', 'name': 'history_complete', 'number': null::double, 'flag': complete}"
    + "".join(f", {{'kind': 'capability', 'name': '{n}', 'number': null::double, 'flag': {x}}}" for n, x in zip(CAPABILITIES, (
        "true", "true", "true", "protocol = 'TCP'", "dns_name is not null", "dns_name is not null", "tls_version is not null",
        "coalesce(ja3, '') <> ''", "coalesce(has_quic, false)", "pk_ab > 0 and pk_ba > 0"), strict=True))
    + "]) as u from alerts", "alerts")


@query("alert_evidence_rows", f"select alert_id, u.kind, u.name, u.number, u.flag from ({EVIDENCE_SQL}) where u.number is not null or u.flag is not null")
def alert_evidence_rows(spark, sf):
    return al.explain_alerts(stages(spark, sf).alerts).select(
        "alert_id", "kind", "name",
        F.when(c("name").isin("inter_arrival_mean", "mean_connection_interval"), r6("number", digits=10)).otherwise(r6("number")).alias("number"), "flag")


@query("capture_alerts")  # test_sources holds it against the chain over the same packets
def capture_alerts(spark, sf):
    """Frames to alerts: parsed frames through the whole chain."""
    parsed = with_header_metadata(packets_from_frames(frames(spark, sf)))
    return Stages(checkpoint(parsed)).kept_alerts.select("alert_id", "flow_id", "threat_class", "decision", "ts_us")


# --- telemetry ------------------------------------------------------------------------------------
@query("ingest_counters", sql("""select capture_id, count(*) as packets, count(*) filter (status = 'parsed') as parsed_packets, count(*) filter (status = 'skipped') as skipped_frames,
  count(*) filter (status = 'late') as out_of_order_packets, cast(sum(frame_length) as bigint) as bytes, count(*) filter (status = 'parsed') as flow_updates,
  count(*) filter (is_new) as flows from frame_log group by all""", "frame_log"))
def ingest_counters(spark, sf):
    return telemetry.ingest_counters(stages(spark, sf).frame_log)


@query("protocol_counts", sql("select capture_id, protocol, count(*) as packets from keyed group by all", "keyed"))
def protocol_counts(spark, sf):
    return telemetry.protocol_counts(packets.drop_out_of_order(packets.known_protocols(inputs.packets(spark, sf))))


@query("stage_percentiles", """select event_type as stage, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, count(*) as samples
  from (select * from events qualify row_number() over (partition by event_type order by event_id desc) <= 2000) group by event_type""")
def stage_percentiles(spark, sf):
    e = inputs.table(spark, sf, "events").select(c("event_type").alias("stage"), c("event_id").alias("seq"), c("value").alias("milliseconds"))
    return telemetry.stage_percentiles(e).select("stage", r6("p50"), r6("p95"), "samples")


RATES = """select *, row_number() over (partition by capture_id order by interval_us desc) as r from (
  select capture_id, interval_us, cast(sum(p) over w as bigint) as packets, cast(sum(b) over w as bigint) as bytes, cast(sum(f) over w as bigint) as flows, cast(sum(u) over w as bigint) as flow_updates,
  p / 0.25 as packets_per_second, f / 0.25 as flows_per_second, b * 8 / 1000000 / 0.25 as mbps from (
    select capture_id, ts_us // 250000 * 250000 as interval_us, count(*) as p, sum(frame_length) as b, count(*) filter (is_new) as f, count(*) filter (status = 'parsed') as u
    from frame_log group by all) window w as (partition by capture_id order by interval_us))"""


@query("rate_samples", sql(f"""select capture_id, interval_us, packets, bytes, flows, flow_updates, round(packets_per_second::double, 6) as packets_per_second,
  round(flows_per_second::double, 6) as flows_per_second, round(mbps::double, 6) as mbps from ({RATES}) where r <= 720""", "frame_log"))
def rate_samples(spark, sf):
    return telemetry.rate_samples(stages(spark, sf).frame_log).select(
        "capture_id", "interval_us", "packets", "bytes", "flows", "flow_updates", r6("packets_per_second"), r6("flows_per_second"), r6("mbps"))


@query("capture_summary", sql("""select capture_id, count(*) as packets, cast(sum(frame_length) as bigint) as bytes, round((max(ts_us) - arg_min(ts_us, frame_no)) / 1e6, 6) as capture_duration_seconds,
  round(sum(frame_length) * 8 / 1e6 / nullif((max(ts_us) - arg_min(ts_us, frame_no)) / 1e6, 0), 6) as observed_average_mbps from frame_log group by all""", "frame_log"))
def capture_summary(spark, sf):
    return telemetry.capture_summary(stages(spark, sf).frame_log).select(
        "capture_id", "packets", "bytes", r6("capture_duration_seconds"), r6("observed_average_mbps"))


@query("timeline_points", sql(f"""select interval_us, packets, round(coalesce(greatest(bytes - lag(bytes) over w, 0), 0) * 8 / coalesce(greatest((interval_us - lag(interval_us) over w) / 1e6, 0.001), 1.0) / 1e6, 6) as mbps,
  round(coalesce(greatest(packets - lag(packets) over w, 0), 0) / coalesce(greatest((interval_us - lag(interval_us) over w) / 1e6, 0.001), 1.0), 6) as packets_per_second,
  round(coalesce(greatest(flows - lag(flows) over w, 0), 0) / coalesce(greatest((interval_us - lag(interval_us) over w) / 1e6, 0.001), 1.0), 6) as flows_per_second
  from ({RATES}) window w as (partition by capture_id order by interval_us)""", "frame_log"))
def timeline_points(spark, sf):
    samples = telemetry.rate_samples(stages(spark, sf).frame_log, keep=None)
    return telemetry.timeline_points(samples).select("interval_us", "packets", r6("mbps"), r6("packets_per_second"), r6("flows_per_second"))


@query("alert_markers", sql("""select a.alert_id, round((a.observed_us - s.lo) / greatest(s.hi - s.lo, 1000) * 100, 6) as left_percent
  from kept_alerts a join (select capture_id, min(ts_us) + 60000000 as lo, max(ts_us) as hi from fp group by all) s on a.observed_us between s.lo and s.hi""", "kept_alerts", "fp"))
def alert_markers(spark, sf):
    s = stages(spark, sf)
    spans = s.flow_packets.groupBy("capture_id").agg((F.min("ts_us") + 60_000_000).alias("first_us"), F.max("ts_us").alias("last_us"))
    return al.alert_markers(s.kept_alerts, spans).select("alert_id", r6("left_percent"))
