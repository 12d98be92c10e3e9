"""Endpoint order and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.fixed import ID_BUCKET_S, SECOND_US

# --- fixed values: identifier layout --------------------------------------------------------------
UNIT_SEPARATOR = "\x1f"
MISSING_PORT = "None"
DIGEST_LENGTH = 24
FLOW_PREFIX = "flow"
WINDOW_PREFIX = "window"
ALERT_PREFIX = "sx"


def floor_div(value: Column, size: Column | int) -> Column:
    """Whole-number division rounding down, without going through an inexact quotient."""
    size = F.lit(size) if isinstance(size, int) else size
    return ((value - F.pmod(value, size)) / size).cast("long")


def ip_sort_key(ip: Column) -> Column:
    """Version digit plus packed address in hex: text order equals (version, packed bytes) order."""
    octets = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    packed = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    v4 = F.concat(F.lit("4"), F.lpad(F.hex(packed), 8, "0"))
    halves = F.split(F.lower(ip), "::")

    def groups(text: Column) -> Column:
        return F.transform(
            F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.lpad(F.upper(g), 4, "0")
        )

    left = groups(F.get(halves, F.lit(0)))
    right = F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0000"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    v6 = F.concat(F.lit("6"), F.array_join(F.concat(left, zeros, right), ""))
    return F.when(ip.contains(":"), v6).otherwise(v4)


def source_is_first(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """True when the source endpoint is endpoint a of the canonical pair."""
    source, target = ip_sort_key(src_ip), ip_sort_key(dst_ip)
    port_order = F.coalesce(src_port, F.lit(-1)) <= F.coalesce(dst_port, F.lit(-1))
    return (source < target) | ((source == target) & port_order)


def digest(prefix: str, *parts: Column) -> Column:
    text = F.concat_ws(UNIT_SEPARATOR, *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, DIGEST_LENGTH))


def flow_id(
    a_ip: Column, a_port: Column, b_ip: Column, b_port: Column, protocol: Column, start_us: Column,
    discriminator: Column, bucket_s: int = ID_BUCKET_S,
) -> Column:
    if bucket_s <= 0:
        raise ValueError("bucket_s must be positive")

    def port(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(MISSING_PORT))

    bucket = floor_div(start_us, bucket_s * SECOND_US)
    return digest(FLOW_PREFIX, a_ip, port(a_port), b_ip, port(b_port), protocol, bucket, discriminator)


def window_id(entity: Column, ts_us: Column, width_s: Column | int) -> Column:
    width = F.lit(width_s) if isinstance(width_s, int) else width_s
    bucket = floor_div(ts_us, width * SECOND_US)
    return digest(WINDOW_PREFIX, entity, width, bucket)


def iso_timestamp(ts_us: Column) -> Column:
    """ISO text in UTC; the fraction is left out when the microseconds are zero."""
    moment = F.timestamp_micros(ts_us)
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(ts_us, F.lit(SECOND_US))
    fraction = F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(fraction), F.lit("+00:00"))


def alert_id(detector: Column, threat_class: Column, ts_us: Column, flow: Column, window: Column) -> Column:
    empty = F.lit("")
    return digest(
        ALERT_PREFIX, detector, threat_class, F.coalesce(flow, empty), F.coalesce(window, empty), iso_timestamp(ts_us)
    )
