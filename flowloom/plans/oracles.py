"""Comparison SQL for DuckDB: named building blocks, put together as WITH chains.

The blocks state the meaning in the plainest SQL there is (range joins, list folds), independent of how
the Spark operators compute it.
"""

from __future__ import annotations

from hashlib import blake2b

from flowloom.fixed import BIGRAM_BUCKETS, FINGERPRINT_BUCKETS

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, text: str, *needs: str) -> None:
    BLOCKS[name] = (needs, text)


def sql(final: str, *needs: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in BLOCKS[name][0]:
                add(need)
            ordered.append(name)

    for need in needs:
        add(need)
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in ordered) + "\n" + final


def macro_ip(column: str) -> str:
    return "+".join(f"split_part({column},'.',{i + 1})::bigint*{256 ** (3 - i)}" for i in range(4))


def digest(prefix: str, *parts: str) -> str:
    return f"'{prefix}-' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 24)"


def iso(us: str) -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || case when {us} % 1000000 = 0 then '' "
        f"else '.' || lpad(cast({us} % 1000000 as varchar), 6, '0') end || '+00:00'"
    )


block("packets", """
with e as (
  select event_id, user_id, event_type, cast(floor(value) as int) as v,
         cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 5000 as ts_us
  from events),
c as (
  select *, case when k % 50 = 0 then 'ICMP' when k % 50 = 1 then 'OTHER' when event_type = 'error' then 'UDP' else 'TCP' end as protocol,
         concat('10.0.', cast(user_id // 256 as varchar), '.', cast(user_id % 256 as varchar)) as client_ip,
         concat('192.0.2.', cast(case when user_id % 10 = 0 then k % 50 else user_id % 4 end as varchar)) as server_ip,
         cast(40000 + user_id % 1000 as int) as client_port,
         case event_type when 'click' then 443 when 'view' then 80 when 'error' then 53
                         when 'signup' then 22 else 8443 end as server_port,
         event_id % 3 = 0 as reply
  from e)
select 'cap0' as capture_id,
       event_id * 10 + case when event_id % 17 = 0 then 35 else 0 end as frame_no,
       ts_us,
       case when reply then server_ip else client_ip end as src_ip,
       case when reply then client_ip else server_ip end as dst_ip,
       case when protocol in ('ICMP', 'OTHER') then null when reply then server_port else client_port end as src_port,
       case when protocol in ('ICMP', 'OTHER') then null when reply then client_port else server_port end as dst_port,
       protocol, cast(60 + v as bigint) as packet_length,
       cast(case when protocol in ('ICMP', 'OTHER') then null else v end as bigint) as payload_length,
       case when protocol <> 'TCP' then null when event_id % 4 = 0 then 'SYN' when event_id % 4 = 1 then 'SYN|ACK'
            when event_id % 4 = 2 then 'ACK' else 'PSH|ACK' end as tcp_flags,
       case when protocol = 'UDP' then concat('h', cast(k as varchar), '-', cast(user_id % 10 as varchar), '.zone.example') end as dns_name,
       case when protocol = 'TCP' and server_port in (443, 8443) and event_id % 2 = 0 then 771 end as tls_version,
       5 + k % 11 as tls_ciphers, 3 + k % 5 as tls_extensions,
       case when protocol = 'TCP' and server_port in (443, 8443) and event_id % 4 = 0
            then md5(concat('771,', cast(k % 13 as varchar))) end as ja3,
       protocol = 'UDP' and event_id % 5 = 0 as has_quic, event_id % 10 = 0 as quic_long
from c""")

block("marked", """
select *, coalesce(ts_us < max(ts_us) over (partition by capture_id order by frame_no
          rows between unbounded preceding and 1 preceding), false) as late from packets where protocol <> 'OTHER'""", "packets")

block("keyed", f"""
select *, case when first then src_ip else dst_ip end as a_ip, case when first then src_port else dst_port end as a_port,
       case when first then dst_ip else src_ip end as b_ip, case when first then dst_port else src_port end as b_port,
       case when first then 'A_TO_B' else 'B_TO_A' end as direction
from (select *, ({macro_ip('src_ip')}, coalesce(src_port, -1)) <= ({macro_ip('dst_ip')}, coalesce(dst_port, -1)) as first
      from marked where not late)""", "marked")

KEY = "capture_id, a_ip, coalesce(a_port,-1), b_ip, coalesce(b_port,-1), protocol"

block("sessions", f"""
select *, max(case when prev_us is null or ts_us - prev_us >= 60000000 then frame_no end)
          over (partition by {KEY} order by frame_no) as session_start
from (select *, lag(ts_us) over (partition by {KEY} order by frame_no) as prev_us from keyed)""", "keyed")

block("starts", f"""
select capture_id, session_start, a_ip, b_ip, protocol, list_transform(list_reduce(
         list_transform(list([ts_us, frame_no] order by frame_no), lambda x: [x]),
         lambda acc, v: case when v[1][1] - acc[-1][1] >= 120000000 then list_concat(acc, v) else acc end),
         lambda x: x[2]) as flow_starts
from sessions group by {KEY}, session_start""", "sessions")

block("fp", """
select s.*, list_max(list_filter(t.flow_starts, lambda f: f <= s.frame_no)) as flow_start,
       s.frame_no = list_max(list_filter(t.flow_starts, lambda f: f <= s.frame_no)) as is_new,
       case when s.frame_no <> list_max(list_filter(t.flow_starts, lambda f: f <= s.frame_no))
            then greatest(s.ts_us - s.prev_us, 0) end as gap_us
from sessions s join starts t using (capture_id, session_start)""", "sessions", "starts")

block("ids", f"""
select capture_id, flow_start, cast(ordinal as bigint) as ordinal, {digest('flow', 'a_ip', "coalesce(cast(a_port as varchar),'None')",
       'b_ip', "coalesce(cast(b_port as varchar),'None')", 'protocol', 'cast(ts_us // 60000000 as varchar)', 'cast(ordinal as varchar)')} as flow_id
from (select *, row_number() over (partition by capture_id order by frame_no) - 1 as ordinal from fp where is_new)""", "fp")

block("flows", """
select capture_id, flow_start, any_value(a_ip) as a_ip, any_value(a_port) as a_port, any_value(b_ip) as b_ip,
       any_value(b_port) as b_port, any_value(protocol) as protocol, any_value(session_start) as session_start,
       min(ts_us) as start_us, max(ts_us) as last_seen_us, max(frame_no) as last_frame,
       bool_or(is_new and direction = 'A_TO_B') as a_first,
       count(*) filter (direction = 'A_TO_B') as packets_a_to_b, count(*) filter (direction <> 'A_TO_B') as packets_b_to_a,
       cast(coalesce(sum(packet_length) filter (direction = 'A_TO_B'), 0) as bigint) as bytes_a_to_b,
       cast(coalesce(sum(packet_length) filter (direction <> 'A_TO_B'), 0) as bigint) as bytes_b_to_a,
       cast(coalesce(sum(payload_length) filter (direction = 'A_TO_B'), 0) as bigint) as payload_a_to_b,
       cast(coalesce(sum(payload_length) filter (direction <> 'A_TO_B'), 0) as bigint) as payload_b_to_a,
       count(*) as n, count(payload_length) as payload_n,
       avg(packet_length) as size_mean, var_pop(packet_length) as size_var,
       min(packet_length) as size_min, max(packet_length) as size_max,
       var_pop(payload_length) as payload_var, count(gap_us) as gap_n, avg(gap_us / 1e6) as gap_mean, var_pop(gap_us / 1e6) as gap_var,
       count(*) filter (contains(tcp_flags, 'SYN')) as syn_n, count(*) filter (contains(tcp_flags, 'ACK')) as ack_n,
       count(*) filter (contains(tcp_flags, 'PSH')) as psh_n,
       arg_max(dns_name, frame_no) filter (dns_name is not null) as dns_name,
       max(frame_no) filter (tls_version is not null) as tls_frame, max(frame_no) filter (has_quic) as quic_frame
from fp group by capture_id, flow_start""", "fp")

block("closes", """
select f.capture_id, f.flow_start, f.last_seen_us,
       case when x.next_frame is not null then 'active' when i.frame_no is not null then 'idle' else 'end' end as reason,
       case when x.next_frame is not null then x.next_us when i.frame_no is not null then i.ts_us else e.ts_us end as close_us,
       case when x.next_frame is not null then x.next_frame when i.frame_no is not null then i.frame_no else e.frame_no end as close_frame
from flows f
join (select capture_id, flow_start, lead(flow_start) over w as next_frame, lead(start_us) over w as next_us
      from flows window w as (partition by capture_id, session_start order by flow_start)) x using (capture_id, flow_start)
asof left join (select capture_id, ts_us, min(frame_no) as frame_no from fp group by 1, 2) i
     on f.capture_id = i.capture_id and f.last_seen_us + 60000000 <= i.ts_us
join (select capture_id, max(ts_us) as ts_us, max(frame_no) as frame_no from fp group by 1) e on f.capture_id = e.capture_id""",
      "flows")

block("ticks", """
select capture_id, unnest.item[2] as tick_frame, unnest.item[1] as tick_us from (
  select capture_id, unnest(list_transform(list_reduce(list_transform(list([ts_us, frame_no] order by frame_no), lambda x: [x]),
         lambda acc, v: case when v[1][1] - acc[-1][1] >= 1000000 then list_concat(acc, v) else acc end)[2:],
         lambda x: {'item': x})) as unnest
  from fp group by capture_id)""", "fp")

block("ticked", """
select p.*, t.tick_frame, t.tick_us from fp p
asof left join ticks t on p.capture_id = t.capture_id and p.frame_no <= t.tick_frame""", "fp", "ticks")

block("steps", """
select capture_id, flow_start, tick_frame, max(tick_us) as tick_us, max(frame_no) as last_frame from ticked
group by capture_id, flow_start, tick_frame""", "ticked")

block("snaps", """
with s as (
  select s.*, c.reason, c.close_us, c.close_frame,
         (select count(*) from fp p where p.capture_id = s.capture_id and p.flow_start = s.flow_start and p.frame_no <= s.last_frame) as n,
         lead(s.last_frame) over (partition by s.capture_id, s.flow_start order by s.last_frame) is null as is_last
  from steps s join closes c using (capture_id, flow_start)),
m as (
  select *, coalesce(tick_frame is not null and n >= 2 and (tick_frame < close_frame or (reason = 'end' and tick_frame <= close_frame)), false) as ticked
  from s)
select capture_id, flow_start, last_frame, n, case when ticked then 'tick' else reason end as snapshot_reason,
       case when ticked then tick_us else close_us end as observed_us,
       case when ticked then tick_frame else close_frame end as trigger_frame
from m where ticked or is_last""", "steps", "closes")

block("states", """
select s.capture_id, s.flow_start, s.snapshot_reason, s.observed_us, s.trigger_frame, s.last_frame,
       any_value(p.a_ip) as a_ip, any_value(p.a_port) as a_port, any_value(p.b_ip) as b_ip, any_value(p.b_port) as b_port,
       any_value(p.protocol) as protocol, min(p.ts_us) as start_us, max(p.ts_us) as last_seen_us,
       bool_or(p.is_new and direction = 'A_TO_B') as a_first,
       count(*) as n, count(*) filter (direction = 'A_TO_B') as pk_ab, count(*) filter (direction <> 'A_TO_B') as pk_ba,
       cast(coalesce(sum(packet_length) filter (direction = 'A_TO_B'), 0) as bigint) as by_ab,
       cast(coalesce(sum(packet_length) filter (direction <> 'A_TO_B'), 0) as bigint) as by_ba,
       cast(coalesce(sum(payload_length) filter (direction = 'A_TO_B'), 0) as bigint) as pl_ab,
       cast(coalesce(sum(payload_length) filter (direction <> 'A_TO_B'), 0) as bigint) as pl_ba,
       count(payload_length) as payload_n, avg(packet_length) as size_mean, var_pop(packet_length) as size_var,
       var_pop(payload_length) as payload_var, count(gap_us) as gap_n, avg(gap_us / 1e6) as gap_mean, var_pop(gap_us / 1e6) as gap_var,
       count(*) filter (contains(tcp_flags, 'SYN')) as syn_n, arg_max(src_ip, frame_no) as last_src_ip,
       arg_max(dns_name, frame_no) filter (dns_name is not null) as dns_name,
       arg_max(tls_version, frame_no) filter (tls_version is not null) as tls_version,
       arg_max(tls_ciphers, frame_no) filter (tls_version is not null) as tls_ciphers,
       arg_max(tls_extensions, frame_no) filter (tls_version is not null) as tls_extensions,
       arg_max(coalesce(ja3, ''), frame_no) filter (tls_version is not null) as ja3,
       bool_or(has_quic) as has_quic, arg_max(quic_long, frame_no) filter (has_quic) as quic_long
from snaps s join fp p on p.capture_id = s.capture_id and p.flow_start = s.flow_start and p.frame_no <= s.last_frame
group by all""", "snaps", "fp")

block("points", """
select distinct capture_id, case when a_first then a_ip else b_ip end as src_ip, case when a_first then b_ip else a_ip end as dst_ip,
       observed_us as ts_us, trigger_frame from states""", "states")


def window_blocks(width_us: int) -> None:
    inside = f"e.capture_id = p.capture_id and e.frame_no <= p.trigger_frame and e.ts_us >= p.ts_us - {width_us}"
    block("w_out", f"""
select p.src_ip, p.ts_us, p.trigger_frame, count(*) as w_packets, cast(sum(packet_length) as bigint) as w_bytes,
       count(*) filter (is_new) as w_flows, count(distinct e.dst_ip) as w_dsts, count(distinct e.dst_port) as w_ports,
       count(dns_name) as w_names, count(distinct dns_name) as w_unique_names, min(e.ts_us) as first_us
from (select distinct capture_id, src_ip, ts_us, trigger_frame from points) p join fp e on e.src_ip = p.src_ip and {inside}
group by all""", "points", "fp")
    block("w_short", f"""
select src_ip, ts_us, trigger_frame, count(*) as w_n, count(*) filter (span <= 2000000) as w_short from (
  select p.src_ip, p.ts_us, p.trigger_frame, e.flow_start, max(e.ts_us) - min(e.ts_us) as span
  from (select distinct capture_id, src_ip, ts_us, trigger_frame from points) p join fp e on e.src_ip = p.src_ip and {inside}
  group by all) group by all""", "points", "fp")
    block("w_dst_entropy", f"""
select src_ip, ts_us, trigger_frame, -sum(n / t * log2(n / t)) as dst_entropy from (
  select *, sum(n) over (partition by src_ip, ts_us, trigger_frame) as t from (
    select p.src_ip, p.ts_us, p.trigger_frame, e.dst_ip, count(*)::double as n
    from (select distinct capture_id, src_ip, ts_us, trigger_frame from points) p join fp e on e.src_ip = p.src_ip and e.is_new and {inside}
    group by all)) group by all""", "points", "fp")
    block("w_in", f"""
select p.src_ip, p.ts_us, p.trigger_frame, cast(sum(packet_length) as bigint) as w_inbound
from (select distinct capture_id, src_ip, ts_us, trigger_frame from points) p join fp e on e.dst_ip = p.src_ip and {inside}
group by all""", "points", "fp")
    block("w_target_src", f"""
select p.dst_ip, p.ts_us, p.trigger_frame, e.src_ip, count(*) as n, count(*) filter (protocol = 'UDP') as udp
from (select distinct capture_id, dst_ip, ts_us, trigger_frame from points) p join fp e on e.dst_ip = p.dst_ip and {inside}
group by all""", "points", "fp")
    block("w_target", """
select dst_ip, ts_us, trigger_frame, cast(sum(n) as bigint) as t_packets, cast(sum(udp) as bigint) as t_udp, count(*) as t_sources,
       -sum(n::double / t * log2(n::double / t)) as src_entropy
from (select *, sum(n) over (partition by dst_ip, ts_us, trigger_frame) as t from w_target_src) group by all""", "w_target_src")
    block("w_bins", f"""
select dst_ip, ts_us, trigger_frame, count(*) as t_bins, case when count(*) >= 2 then stddev_pop(n) / avg(n) end as burst from (
  select p.dst_ip, p.ts_us, p.trigger_frame, e.ts_us // 1000000 as b, count(*) as n
  from (select distinct capture_id, dst_ip, ts_us, trigger_frame from points) p join fp e on e.dst_ip = p.dst_ip and {inside}
  group by all) group by all""", "points", "fp")
    block("w_pair", f"""
select src_ip, dst_ip, ts_us, trigger_frame, count(*) as conns, avg(gap) as gap_mean_us, stddev_pop(gap) as gap_std_us from (
  select p.src_ip, p.dst_ip, p.ts_us, p.trigger_frame, e.ts_us as c_us,
         (e.ts_us - lag(e.ts_us) over (partition by p.src_ip, p.dst_ip, p.ts_us, p.trigger_frame order by e.frame_no))::double as gap
  from points p join fp e on e.src_ip = p.src_ip and e.dst_ip = p.dst_ip and e.is_new and {inside})
group by all""", "points", "fp")
    block("w_total", f"""
select p.capture_id, p.ts_us, p.trigger_frame, count(*) as w_total
from (select distinct capture_id, ts_us, trigger_frame from points) p join fp e on {inside} group by all""", "points", "fp")
    block("windows", """
select p.*, coalesce(o.w_packets, 0) as w_packets, coalesce(o.w_bytes, 0) as w_bytes, coalesce(o.w_flows, 0) as w_flows,
       coalesce(o.w_dsts, 0) as w_dsts, coalesce(o.w_ports, 0) as w_ports, coalesce(o.w_names, 0) as w_names,
       coalesce(o.w_unique_names, 0) as w_unique_names,
       coalesce((p.ts_us - o.first_us) / 1e6, 0.0) as history, coalesce(s.w_n, 0) as w_n, coalesce(s.w_short, 0) as w_short,
       greatest(coalesce(d.dst_entropy, 0.0), 0.0) + 0.0 as dst_entropy, coalesce(i.w_inbound, 0) as w_inbound,
       coalesce(t.t_packets, 0) as t_packets, coalesce(t.t_udp, 0) as t_udp, coalesce(t.t_sources, 0) as t_sources,
       greatest(coalesce(t.src_entropy, 0.0), 0.0) + 0.0 as src_entropy, b.burst, coalesce(c.conns, 0) as conns,
       case when c.conns >= 3 then c.gap_mean_us / 1e6 end as conn_mean,
       case when c.conns >= 3 and c.gap_mean_us > 0 then c.gap_std_us / c.gap_mean_us end as conn_cv,
       case when c.conns >= 3 and c.gap_mean_us > 0 then greatest(0.0, least(1.0, 1 - c.gap_std_us / c.gap_mean_us))
            when c.conns >= 3 then 0.0 end as conn_score,
       w.w_total
from points p left join w_out o using (src_ip, ts_us, trigger_frame) left join w_short s using (src_ip, ts_us, trigger_frame)
left join w_dst_entropy d using (src_ip, ts_us, trigger_frame) left join w_in i using (src_ip, ts_us, trigger_frame)
left join w_target t using (dst_ip, ts_us, trigger_frame) left join w_bins b using (dst_ip, ts_us, trigger_frame)
left join w_pair c using (src_ip, dst_ip, ts_us, trigger_frame) left join w_total w using (capture_id, ts_us, trigger_frame)""",
          "points", "w_out", "w_short", "w_dst_entropy", "w_in", "w_target", "w_bins", "w_pair", "w_total")


window_blocks(60_000_000)

block("snaprows", """
select s.*, i.flow_id, case when s.a_first then s.a_ip else s.b_ip end as src_ip, case when s.a_first then s.b_ip else s.a_ip end as dst_ip,
       case when s.a_first then s.a_port else s.b_port end as src_port, case when s.a_first then s.b_port else s.a_port end as dst_port,
       w.* exclude (capture_id, src_ip, dst_ip, ts_us, trigger_frame)
from states s join ids i using (capture_id, flow_start)
join windows w on w.capture_id = s.capture_id and w.src_ip = case when s.a_first then s.a_ip else s.b_ip end
     and w.dst_ip = case when s.a_first then s.b_ip else s.a_ip end and w.ts_us = s.observed_us and w.trigger_frame = s.trigger_frame""",
      "states", "ids", "windows")

WINDOW_ID = lambda host, us: digest("window", host, "'60'", f"cast({us} // 60000000 as varchar)")

block("behaviour", f"""
with o as (select *, case when a_first then pk_ab else pk_ba end as po, case when a_first then pk_ba else pk_ab end as pi,
       case when a_first then by_ab else by_ba end as bo, case when a_first then by_ba else by_ab end as bi,
       case when payload_n = n then case when a_first then pl_ab else pl_ba end end as yo,
       case when payload_n = n then case when a_first then pl_ba else pl_ab end end as yi,
       (last_seen_us - start_us) / 1e6 as duration from snaprows)
select *, {WINDOW_ID('src_ip', 'observed_us')} as window_id,
       case protocol when 'TCP' then 6.0 when 'UDP' then 17.0 when 'ICMP' then 1.0 else 0.0 end as protocol_id,
       case when protocol = 'TCP' then syn_n end as tcp_syn,
       bo / (bi + 1) as byte_ratio, w_flows / 60.0 as fps, w_packets / 60.0 as pps, w_bytes / 60.0 as bps,
       t_packets / greatest(w_total, 1) as concentration, conns / greatest(w_flows, 1) as recurrence,
       w_ports / greatest(w_dsts, 1) as ports_per_host, w_bytes / (w_inbound + 1) as volume_ratio,
       w_total <= 200000 as complete, case when w_n > 0 then w_short / w_n end as short_ratio,
       t_udp / greatest(t_packets, 1) as udp_share, t_packets / 60.0 as tpps,
       (yo + yi) / n as payload_mean, case when payload_n = n then payload_var end as payload_variance,
       case when n > 1 then duration / (n - 1) end as iat_mean, yo / (yi + 1) as payload_ratio,
       case when duration > 0 then n / duration end as rate, case when duration > 0 then (yo + yi) / duration end as payload_rate
from o""", "snaprows")

BEHAVIOUR_COLUMNS = {
    "flow_duration_seconds": "duration", "packets_outbound": "po", "packets_inbound": "pi", "packet_count": "n",
    "payload_bytes_outbound": "yo", "payload_bytes_inbound": "yi", "payload_bytes_total": "yo + yi",
    "payload_packet_size_mean": "payload_mean", "payload_packet_size_variance": "payload_variance",
    "inter_arrival_mean": "iat_mean", "inter_arrival_variance": "gap_var", "payload_directional_ratio": "payload_ratio",
    "flow_packets_per_second": "rate", "flow_payload_bytes_per_second": "payload_rate",
    "bytes_outbound": "bo", "bytes_inbound": "bi", "packet_size_mean": "size_mean", "packet_size_variance": "size_var",
    "protocol_id": "protocol_id", "tcp_syn_count": "tcp_syn", "directional_byte_ratio": "byte_ratio",
    "flows_per_second": "fps", "packets_per_second": "pps", "bytes_per_second": "bps", "unique_destinations": "w_dsts",
    "unique_destination_ports": "w_ports", "unique_sources_for_destination": "t_sources",
    "destination_entropy": "dst_entropy", "source_entropy_for_destination": "src_entropy",
    "target_concentration": "concentration", "destination_recurrence": "recurrence", "connection_count": "conns",
    "mean_connection_interval": "conn_mean", "connection_interval_cv": "conn_cv", "periodicity_score": "conn_score",
    "ports_per_host": "ports_per_host", "outbound_volume_window": "w_bytes", "outbound_inbound_ratio_window": "volume_ratio",
    "history_seconds": "history", "short_flow_ratio": "short_ratio", "udp_share": "udp_share", "burstiness": "burst",
    "target_packets_per_second": "tpps", "source_window_packets": "w_packets", "source_window_flow_count": "w_flows",
    "target_window_packets": "t_packets",
}

block("verdicts", """
with w as (select *, 40.0::double as w0, (t_packets + 4 * t_sources)::double as w1, (12 * w_dsts + 6 * w_ports)::double as w2,
                  (30 * conns)::double as w3 from behaviour where protocol in ('TCP', 'UDP')),
m as (select *, greatest(w0, w1, w2, w3) as top, w0 + w1 + w2 + w3 as total, w0*w0 + w1*w1 + w2*w2 + w3*w3 as squares from w)
select *, case top when w0 then 'BENIGN' when w1 then 'DDOS' when w2 then 'RECON' else 'BOT_OR_C2_LIKE' end as threat_class,
       top / total as raw_score, top * top / squares as calibrated,
       case top when w0 then 0.5 when w1 then 0.45 when w2 then 0.55 else 0.6 end::double as threshold
from m""", "behaviour")

# Capabilities that decide here (timestamps and direction) are always visible; the other rules follow.
block("gated", """
with g as (select *, case threat_class
  when 'DDOS' then list_filter([case when t_packets >= 10 then null else 'target_window_packets>=10' end,
                                case when history >= 1 then null else 'history_seconds>=1' end,
                                case when t_sources >= 2 then null else 'unique_sources_for_destination>=2' end,
                                case when complete then null else 'history_complete' end], lambda x: x is not null)
  when 'RECON' then list_filter([case when short_ratio is null then 'short_flow_ratio' end,
                                case when w_packets >= 3 then null else 'source_window_packets>=3' end,
                                case when history >= 1 then null else 'history_seconds>=1' end,
                                case when w_flows >= 3 then null else 'source_window_flow_count>=3' end,
                                case when complete then null else 'history_complete' end], lambda x: x is not null)
  when 'BOT_OR_C2_LIKE' then list_filter([case when conn_score is null then 'periodicity_score' end,
                                case when conn_mean is null then 'mean_connection_interval' end,
                                case when conns >= 3 then null else 'connection_count>=3' end,
                                case when history >= 10 then null else 'history_seconds>=10' end,
                                case when complete then null else 'history_complete' end], lambda x: x is not null)
  else [] end as missing from verdicts)
select *, case when threat_class = 'BENIGN' then null when len(missing) > 0 then 'INSUFFICIENT_EVIDENCE'
               when calibrated >= threshold then 'ACCEPT' when calibrated >= 0.5 then 'UNKNOWN_SUSPICIOUS' end as decision,
       case when threat_class = 'BENIGN' then 'ADEQUATE' when len(missing) > 0 then 'INSUFFICIENT'
            when calibrated >= threshold then 'STRONG' when calibrated >= 0.5 then 'ADEQUATE' else 'WEAK' end as quality
from g""", "verdicts")

block("alerts", f"""
select *, {digest('sx', "'behaviour'", 'threat_class', 'flow_id', 'window_id', iso('last_seen_us'))} as alert_id,
       case threat_class when 'RECON' then 'MEDIUM' when 'UNKNOWN' then 'LOW' else 'HIGH' end as severity
from gated where decision is not null""", "gated")

block("kept_alerts", """
with ranked as (select *, row_number() over (partition by threat_class, src_ip, dst_ip, decision
                                             order by last_seen_us, flow_id, window_id, alert_id) as r from alerts),
k as (select threat_class, src_ip, dst_ip, decision, list_transform(list_reduce(
        list_transform(list([last_seen_us, r] order by r), lambda x: [x]),
        lambda acc, v: case when v[1][1] - acc[-1][1] >= 60000000 then list_concat(acc, v) else acc end), lambda x: x[2]) as keep
      from ranked group by all)
select r.* from ranked r join k using (threat_class, src_ip, dst_ip, decision) where list_contains(k.keep, r.r)""", "alerts")

block("frame_log", """
select m.capture_id, m.frame_no, m.ts_us, m.protocol, case when m.late then 'late' else 'parsed' end as status,
       m.packet_length as frame_length, coalesce(f.is_new, false) as is_new
from marked m left join fp f using (capture_id, frame_no)
union all select capture_id, frame_no, ts_us, protocol, 'skipped', packet_length, false from packets where protocol = 'OTHER'""", "packets", "marked", "fp")

block("domains", r"select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as domain from pages")

block("labelled", """
with l as (
  select *, case when l_partkey % 89 = 0 then 'Other' when l_partkey % 97 = 0 then 'Bot'
                 when l_returnflag = 'R' then 'DDoS' when l_returnflag = 'A' then ' PortScan ' else 'BENIGN' end as label,
         cast(l_quantity as bigint) as q, cast(l_linenumber as bigint) as ln
  from lineitem)
select concat('file', cast(l_orderkey % 3 as varchar), '.csv') as source_name,
       cast(row_number() over (partition by l_orderkey % 3
            order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as source_index,
       case when l_partkey % 101 = 0 then -1
            else (l_orderkey % 50) * 10000 + case when l_partkey % 50 = 0 then 0 when label = 'DDoS' then 1000
                 when label = ' PortScan ' then 2000 when label = 'Bot' then 3000 else 0 end end as duration_us,
       q % 5 as n_out, ln % 3 as n_in,
       (cast(floor(l_extendedprice) as bigint) % 8) * (q % 5) as b_out, (ln % 3) * 7 as b_in,
       cast(case when q % 5 > 1 then 2 else 0 end as double) as std_out,
       cast(case when ln % 3 > 1 then 1 else 0 end as double) as std_in,
       cast(l_orderkey % 2 as double) * 1000 as iat_std_us, label
from l""")

block("mapped", """
select *, trim(label) as raw_label, case trim(label) when 'BENIGN' then 'BENIGN' when 'DDoS' then 'DDOS'
       when 'PortScan' then 'RECON' when 'Bot' then 'BOT_OR_C2_LIKE' end as class from labelled""", "labelled")

block("valid", """
select * from mapped where class is not null and duration_us >= 0 and n_out >= 0 and n_in >= 0 and b_out >= 0
   and b_in >= 0 and n_out + n_in >= 1""", "mapped")

MODEL_SQL = {
    "flow_duration_seconds": "d", "packets_outbound": "n_out::double", "packets_inbound": "n_in::double",
    "packet_count": "(n_out + n_in)::double", "payload_bytes_outbound": "b_out::double",
    "payload_bytes_inbound": "b_in::double", "payload_bytes_total": "(b_out + b_in)::double",
    "payload_packet_size_mean": "(b_out + b_in)::double / (n_out + n_in)", "payload_packet_size_variance": "pooled",
    "inter_arrival_mean": "case when n_out + n_in > 1 then d / (n_out + n_in - 1) end", "inter_arrival_variance": "iat",
    "payload_directional_ratio": "b_out::double / (b_in + 1)",
    "flow_packets_per_second": "case when d > 0 then (n_out + n_in) / d end",
    "flow_payload_bytes_per_second": "case when d > 0 then (b_out + b_in) / d end",
}

block("prepared", f"""
with v as (select *, duration_us / 1000000.0::double as d, (b_out + b_in)::double / (n_out + n_in) as mean,
                  iat_std_us / 1000000.0::double as s, (n_out + n_in - 1)::double as k from valid),
x as (select *, (case when n_out > 0 then greatest(n_out - 1, 0)::double * (std_out * std_out)
                      + n_out::double * ((b_out::double / n_out - mean) * (b_out::double / n_out - mean)) else 0.0 end
                 + case when n_in > 0 then greatest(n_in - 1, 0)::double * (std_in * std_in)
                      + n_in::double * ((b_in::double / n_in - mean) * (b_in::double / n_in - mean)) else 0.0 end) / (n_out + n_in) as pooled,
             case when k = 1 then 0.0 when k > 0 then s * s * (greatest(k - 1, 0.0) / k) end as iat from v)
select source_name, source_index + 2 as source_row, source_name || ':row-block:' || cast(source_index // 512 as varchar) as group_id,
       class as label, {', '.join(f'{e} as feature__{n}' for n, e in MODEL_SQL.items())} from x""", "valid")

FEATURE_LIST = ", ".join(f"feature__{n}" for n in MODEL_SQL)

block("conflicts", f"""
select *, count(*) over (partition by {FEATURE_LIST}) as vector_rows,
       min(label) over (partition by {FEATURE_LIST}) <> max(label) over (partition by {FEATURE_LIST}) as clash,
       row_number() over (partition by {FEATURE_LIST} order by source_name, source_row) as copy
from prepared""", "prepared")

block("unique_vectors", "select * exclude (vector_rows, clash, copy) from conflicts where not clash and copy = 1", "conflicts")


def roles_block(name: str, groups: str, seed: int, *needs: str) -> None:
    block(name, f"""
with g as (select group_id, row_number() over (order by md5(group_id || '|{seed}'), group_id) - 1 as r, count(*) over () as n
           from (select distinct group_id from {groups})),
b as (select *, (n * 3 + 9) // 10 as held from g),
c as (select *, (held * 2 + 2) // 3 as rest from b),
d as (select *, (rest + 1) // 2 as test from c)
select group_id, case when r < n - held then 'train' when r < n - rest then 'validation'
                      when r < n - test then 'calibration' else 'test' end as split from d""", *needs)


roles_block("roles", "unique_vectors", 42, "unique_vectors")

block("probs", """
with y as (select vec_id, label % 4 as label_idx, cast(embedding[1] as double) as e0, cast(embedding[2] as double) as e1,
                  cast(embedding[3] as double) as e2, cast(embedding[4] as double) as e3,
                  case when vec_id % 5 <> 0 then 3 else 0 end as boost from embeddings),
x as (select vec_id, label_idx, exp(4 * e0 + case when label_idx = 0 then boost else 0 end) as a,
             exp(4 * e1 + case when label_idx = 1 then boost else 0 end) as b,
             exp(4 * e2 + case when label_idx = 2 then boost else 0 end) as c,
             exp(4 * e3 + case when label_idx = 3 then boost else 0 end) as d from y)
select vec_id, label_idx, round(a/(a+b+c+d), 9) as p0, round(b/(a+b+c+d), 9) as p1,
       round(c/(a+b+c+d), 9) as p2, round(d/(a+b+c+d), 9) as p3 from x""")

CLASS_SQL = "['BENIGN', 'DDOS', 'RECON', 'BOT_OR_C2_LIKE']"
block("predicted", """
select *, greatest(p0, p1, p2, p3) as confidence,
       case greatest(p0, p1, p2, p3) when p0 then 0 when p1 then 1 when p2 then 2 else 3 end as predicted_idx from probs""", "probs")


def blake_bucket(text: str, buckets: int) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big") % buckets


def bigram_values() -> str:
    """Bucket of every bigram over the characters of host names, by rule."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789.-"
    return ", ".join(f"('{a}{b}', {blake_bucket(a + b, BIGRAM_BUCKETS)})" for a in letters for b in letters)


block("bigram_table", f"select * from (values {bigram_values()}) t(pair, bucket)")


def fingerprint_values() -> str:
    """Bucket of each fingerprint that the derived packets can carry."""
    from hashlib import md5

    prints = [md5(f"771,{k}".encode()).hexdigest() for k in range(13)]
    return ", ".join(f"('{p}', {blake_bucket(p, FINGERPRINT_BUCKETS)})" for p in prints)


block("fingerprint_table", f"select * from (values {fingerprint_values()}) t(ja3, bucket)")
