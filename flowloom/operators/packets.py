"""Packet order, canonical endpoints, direction and capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.fixed import PROTOCOL_NUMBERS
from flowloom.functions.ids import source_is_first
from flowloom.operators.scan import FRAMES_PER_CHUNK, chunk_scan


def frame_chunk(size: int = FRAMES_PER_CHUNK, column: str = "frame_no") -> Column:
    return F.expr(f"{column} div {size}")


def mark_out_of_order(packets: DataFrame, chunk_frames: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Add ``late``: the time lies strictly before the latest time seen earlier in the capture."""
    seen = chunk_scan(
        packets,
        ["capture_id"],
        frame_chunk(chunk_frames),
        [F.col("frame_no")],
        {"_seen_us": ("max", F.col("ts_us"), False)},
    )
    return seen.withColumn("late", F.coalesce(F.col("ts_us") < F.col("_seen_us"), F.lit(False))).drop("_seen_us")


def known_protocols(packets: DataFrame) -> DataFrame:
    """Packets that may belong to a flow. The others move no clock and form no flow."""
    return packets.where(F.col("protocol") != "OTHER")


def drop_out_of_order(packets: DataFrame, chunk_frames: int = FRAMES_PER_CHUNK) -> DataFrame:
    return mark_out_of_order(packets, chunk_frames).where(~F.col("late")).drop("late")


def canonical_endpoints(packets: DataFrame) -> DataFrame:
    """Add the ordered endpoint pair, the direction and one text key per conversation."""
    c = F.col
    keyed = packets.withColumn("_src_first", source_is_first(c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port")))
    first = lambda a, b: F.when(c("_src_first"), c(a)).otherwise(c(b))
    return (
        keyed.withColumn("a_ip", first("src_ip", "dst_ip"))
        .withColumn("a_port", first("src_port", "dst_port"))
        .withColumn("b_ip", first("dst_ip", "src_ip"))
        .withColumn("b_port", first("dst_port", "src_port"))
        .withColumn("direction", F.when(c("_src_first"), "A_TO_B").otherwise("B_TO_A"))
        .withColumn(
            "flow_key",
            F.concat_ws(
                "|", "a_ip", F.coalesce(c("a_port"), F.lit(-1)), "b_ip", F.coalesce(c("b_port"), F.lit(-1)), "protocol"
            ),
        )
        .drop("_src_first")
    )


def protocol_number(protocol: Column) -> Column:
    chain = F.lit(0)
    for name, value in PROTOCOL_NUMBERS.items():
        chain = F.when(protocol == name, F.lit(value)).otherwise(chain)
    return chain


def _capabilities(protocol: Column, dns: Column, tls: Column, quic: Column, both_ways: Column) -> dict[str, Column]:
    queries = dns["queries"]
    yes = F.lit(True)
    no = F.lit(False)
    return {
        "has_packet_timestamps": yes,
        "has_packet_sizes": yes,
        "has_directionality": yes,
        "has_tcp_flags": protocol == "TCP",
        "has_dns_query_name": F.coalesce(F.exists(queries, lambda q: F.coalesce(q["name"], F.lit("")) != ""), no),
        "has_dns_query_type": F.coalesce(F.exists(queries, lambda q: q["type"].isNotNull()), no),
        "has_tls_metadata": tls.isNotNull(),
        "has_tls_fingerprint": F.coalesce(tls["ja3"] != "", no),
        "has_quic_metadata": quic.isNotNull(),
        "has_bidirectional_stats": both_ways,
    }


def flow_capabilities() -> Column:
    """Struct of the ten capability flags of a flow row."""
    c = F.col
    flags = _capabilities(
        c("protocol"), c("dns"), c("tls"), c("quic"), (c("packets_a_to_b") > 0) & (c("packets_b_to_a") > 0)
    )
    return F.struct(*[flag.alias(name) for name, flag in flags.items()])


def packet_capabilities(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Capabilities at one packet: DNS from the packet, TLS and QUIC from the packet or its flow."""
    side = flows.select(
        "capture_id",
        "flow_start",
        F.col("tls").alias("_tls"),
        F.col("quic").alias("_quic"),
        ((F.col("packets_a_to_b") > 0) & (F.col("packets_b_to_a") > 0)).alias("_both"),
    )
    c = F.col
    joined = packets.join(side, ["capture_id", "flow_start"])
    flags = _capabilities(
        c("protocol"), c("dns"), F.coalesce(c("tls"), c("_tls")), F.coalesce(c("quic"), c("_quic")), c("_both")
    )
    return joined.select("capture_id", "frame_no", *[flag.alias(name) for name, flag in flags.items()])


def scorable() -> Column:
    """Families a flow can be scored by, as an array of names."""
    c = F.col
    return F.filter(
        F.array(
            F.when(c("protocol").isin("TCP", "UDP"), F.lit("behaviour")),
            F.when(c("dns").isNotNull(), F.lit("dns")),
            F.when(c("tls").isNotNull() | c("quic").isNotNull(), F.lit("tls_quic")),
        ),
        lambda name: name.isNotNull(),
    )
