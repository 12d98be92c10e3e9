"""Versioned feature vectors with explicit availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.fixed import BIGRAM_BUCKETS, FINGERPRINT_BUCKETS, FLOW_MODEL_FEATURES, SCHEMA_VERSIONS, SECOND_US
from flowloom.functions.ids import window_id
from flowloom.functions.text import BIGRAM_COLUMNS, bigram_counts, dns_lexical, stable_bucket
from flowloom.functions.values import (
    entropy_from_sums,
    finite,
    flow_model_values,
    periodicity_from_sums,
    safe_ratio,
)
from flowloom.operators.flows import orient
from flowloom.operators.hostwindows import POINT, burstiness, history_complete
from flowloom.operators.packets import flow_capabilities, protocol_number

__all__ = [
    "availability", "behaviour_features", "behaviour_values", "dns_features", "feature_table",
    "snapshot_points", "tls_quic_features", "flow_capabilities", "FLOW_MODEL_FEATURES",
]


def snapshot_points(snapshots: DataFrame, width_s: int) -> DataFrame:
    """Source, destination, time and trigger of each snapshot, as window read points."""
    source, _ = orient("a_ip", "b_ip")
    _, target = orient("a_ip", "b_ip")
    return snapshots.select(
        "capture_id",
        F.lit(width_s * SECOND_US).cast("long").alias("width_us"),
        source.alias("src_ip"),
        target.alias("dst_ip"),
        F.col("observed_us").alias("ts_us"),
        "trigger_frame",
    ).distinct()


def with_windows(snapshots: DataFrame, windows: DataFrame) -> DataFrame:
    """Snapshot states beside the host windows read for them. ``snapshots`` names the ``width_us`` it asked for."""
    source, target = orient("a_ip", "b_ip")
    keyed = snapshots.withColumn("src_ip", source).withColumn("dst_ip", target).withColumn(
        "ts_us", F.col("observed_us")
    )
    return keyed.join(windows, POINT)  # windows lie by point already


def _duration() -> Column:
    return F.greatest(F.col("last_seen_us") - F.col("start_us"), F.lit(0)) / 1_000_000


def behaviour_values() -> dict[str, Column]:
    """All behaviour features from a snapshot row with its windows; undefined values are null."""
    c = F.col
    n_out, n_in = orient("packets_a_to_b", "packets_b_to_a")
    b_out, b_in = orient("bytes_a_to_b", "bytes_b_to_a")
    p_out, p_in = orient("payload_bytes_a_to_b", "payload_bytes_b_to_a")
    width = c("width_us") / SECOND_US
    at_least_one = lambda x: F.greatest(x, F.lit(1))
    host_packets = c("w_packet_count")
    values = {
        "packet_size_mean": c("packet_size_mean"),
        "packet_size_variance": c("packet_size_variance"),
        "bytes_outbound": b_out,
        "bytes_inbound": b_in,
        "protocol_id": protocol_number(c("protocol")),
        "tcp_syn_count": F.when(c("protocol") == "TCP", c("syn_count")),
        "directional_byte_ratio": b_out / (b_in + 1),
        "flows_per_second": c("flow_count") / width,
        "packets_per_second": host_packets / width,
        "bytes_per_second": c("byte_count") / width,
        "unique_destinations": c("unique_destinations"),
        "unique_destination_ports": c("unique_destination_ports"),
        "unique_sources_for_destination": c("unique_sources"),
        "destination_entropy": entropy_from_sums(c("flow_count"), c("destination_nlogn")),
        "source_entropy_for_destination": entropy_from_sums(c("target_packet_count"), c("source_nlogn")),
        "target_concentration": c("target_packet_count") / at_least_one(c("total_window_packets")),
        "destination_recurrence": c("connection_count") / at_least_one(c("flow_count")),
        "connection_count": c("connection_count"),
        **periodicity_from_sums(c("connection_count"), c("connection_gaps"), c("connection_gaps2")),
        "ports_per_host": c("unique_destination_ports") / at_least_one(c("unique_destinations")),
        "outbound_volume_window": c("byte_count"),
        "outbound_inbound_ratio_window": c("byte_count") / (c("inbound_bytes") + 1),
        "history_seconds": F.when(host_packets > 0, (c("ts_us") - c("first_us")) / SECOND_US).otherwise(F.lit(0.0)),
        "history_complete": history_complete(c("total_window_packets")),
        "short_flow_ratio": safe_ratio(c("short_flows"), c("window_flows")),
        "udp_share": c("udp_packets") / at_least_one(c("target_packet_count")),
        "burstiness": burstiness(c("target_packet_count"), c("bins"), c("bin_squares")),
        "target_packets_per_second": c("target_packet_count") / width,
        "source_window_packets": host_packets,
        "source_window_flow_count": c("flow_count"),
        "target_window_packets": c("target_packet_count"),
    }
    known = c("payload_count") == c("packet_count")
    shared = flow_model_values(
        duration=_duration(),
        packets_out=n_out,
        packets_in=n_in,
        payload_out=F.when(known, p_out),
        payload_in=F.when(known, p_in),
        payload_variance=F.when(known, c("payload_size_variance")),
        iat_variance=c("inter_arrival_variance"),
    )
    return values | {name: finite(value) for name, value in shared.items()}


def _vector(rows: DataFrame, family: str, entity: Column, host: Column, values: dict[str, Column]) -> DataFrame:
    booleans = {"history_complete"}
    kept = [c for c in rows.columns if c in ("capture_id", "flow_start", "flow_id", "trigger_frame", "snapshot_reason", "contexts")]
    vectors = rows.select(
        *kept,
        F.lit(family).alias("family"),
        F.lit(SCHEMA_VERSIONS[family]).alias("schema_version"),
        entity.alias("entity_id"),
        window_id(host, F.col("ts_us"), (F.col("width_us") / SECOND_US).cast("int")).alias("window_id"),
        *[
            (v if n in booleans else v.cast("double")).alias(f"feature__{n}")
            for n, v in values.items()
        ],
    )
    return availability(vectors)


def availability(vectors: DataFrame) -> DataFrame:
    """Add ``available__x`` for every ``feature__x``."""
    names = [c for c in vectors.columns if c.startswith("feature__")]
    return vectors.select("*", *[F.col(c).isNotNull().alias(c.replace("feature__", "available__", 1)) for c in names])


def behaviour_features(rows: DataFrame) -> DataFrame:
    return _vector(rows, "behaviour", F.col("flow_id"), F.col("src_ip"), behaviour_values())


def dns_features(rows: DataFrame, hash_fn: str = "blake2b") -> DataFrame:
    """Query-name features of flows with DNS metadata.

    ``rows`` carries ``query_frequency`` beside the source's window. A value hidden by the capability
    flags, or undefined, is null and marked unavailable.
    """
    c = F.col
    query = F.try_element_at(c("dns.queries"), F.lit(1))
    rows = rows.where(c("dns").isNotNull()).withColumn("_domain", F.lower(query["name"])).withColumn(
        "_bigrams", bigram_counts(c("_domain"), hash_fn)
    )
    flags = flow_capabilities()
    lexical = dns_lexical(c("_domain"))
    named = lexical | {
        "query_frequency": F.when(F.length("_domain") > 0, c("query_frequency")),
        "unique_domain_ratio": safe_ratio(c("unique_domains"), c("domain_count")),
        **{name: F.get(c("_bigrams"), F.lit(i)) for i, name in enumerate(BIGRAM_COLUMNS)},
    }
    values = {n: F.when(flags["has_dns_query_name"], v) for n, v in named.items()}
    values["query_type"] = F.when(flags["has_dns_query_type"], query["type"])
    assert len(values) == 11 + BIGRAM_BUCKETS
    return _vector(rows, "dns", F.concat(F.lit("dns:"), c("last_src_ip")), c("last_src_ip"), values)


def tls_quic_features(rows: DataFrame, hash_fn: str = "blake2b") -> DataFrame:
    """Encrypted-session features of flows with TLS or QUIC metadata."""
    c = F.col
    rows = rows.where(c("tls").isNotNull() | c("quic").isNotNull())
    packets = c("packets_a_to_b") + c("packets_b_to_a")
    values = {
        "flow_duration_seconds": _duration(),
        "packet_count": packets,
        "total_bytes": c("bytes_a_to_b") + c("bytes_b_to_a"),
        "packet_size_mean": c("packet_size_mean"),
        "packet_size_variance": c("packet_size_variance"),
        "inter_arrival_mean": c("inter_arrival_mean"),
        "inter_arrival_variance": c("inter_arrival_variance"),
        "packets_a_to_b": c("packets_a_to_b"),
        "packets_b_to_a": c("packets_b_to_a"),
        "bytes_a_to_b": c("bytes_a_to_b"),
        "bytes_b_to_a": c("bytes_b_to_a"),
        "directional_byte_ratio": c("bytes_a_to_b") / (c("bytes_b_to_a") + 1),
        "tls_record_version": c("tls.record_version"),
        "tls_cipher_suite_count": c("tls.cipher_suite_count"),
        "tls_extension_count": c("tls.extension_count"),
        "tls_fingerprint_bucket": F.when(
            F.length("tls.ja3") > 0, stable_bucket(c("tls.ja3"), FINGERPRINT_BUCKETS, hash_fn)
        ),
        # The version is read from TLS metadata when a flow has both kinds, and TLS has none.
        "quic_version": F.when(c("tls").isNull(), c("quic.version")),
        "quic_long_header": F.when(
            c("quic").isNotNull(), F.when(c("tls").isNull(), c("quic.long_header").cast("int")).otherwise(F.lit(0))
        ),
        "destination_recurrence": c("connection_count") / F.greatest(c("w_packet_count"), F.lit(1)),
        "connection_frequency": c("flow_count") / (c("width_us") / SECOND_US),
    }
    return _vector(rows, "tls_quic", c("flow_id"), c("src_ip"), values)


def feature_table(vectors: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Training table: label, group and source beside the vector. Broken tables fail on one aggregate."""
    from flowloom.session import checkpoint

    table = checkpoint(vectors.join(labels, on))  # checked and returned: joined once
    checks = table.agg(
        F.count("*").alias("n"),
        F.count_distinct("family", "schema_version").alias("kinds"),
        F.count_if(F.col("label").isNull() | F.col("group_id").isNull()).alias("unlabelled"),
    ).first()
    if checks["n"] == 0:
        raise ValueError("a training table needs at least one feature vector")
    if checks["kinds"] != 1:
        raise ValueError("a training table must hold one family and schema version")
    if checks["unlabelled"]:
        raise ValueError("every training row needs a label and a group")
    values = [x for x in table.columns if x.startswith(("feature__", "available__"))]
    return table.select(
        "label", "group_id", "source_name", "family", "schema_version", "entity_id", "window_id", *values
    )
