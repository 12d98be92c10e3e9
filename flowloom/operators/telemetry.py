"""Counters, percentiles, rates and timelines over the processing log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.fixed import LATENCY_SAMPLES, RATE_INTERVAL_MS, RATE_SAMPLES
from flowloom.functions.ids import floor_div
from flowloom.operators.scan import chunk_scan

SAMPLE_STRETCH = 200_000
INTERVALS_PER_TASK = 4096


def ingest_counters(frame_log: DataFrame) -> DataFrame:
    """Per capture: frames, parsed, skipped, late, bytes and flows from the log of all frames.

    ``frame_log``: capture_id, status (parsed / skipped / late), frame_length, is_new.
    """
    status = F.col("status")
    return frame_log.groupBy("capture_id").agg(
        F.count("*").alias("packets"),
        F.count_if(status == "parsed").alias("parsed_packets"),
        F.count_if(status == "skipped").alias("skipped_frames"),
        F.count_if(status == "late").alias("out_of_order_packets"),
        F.sum("frame_length").alias("bytes"),
        F.count_if(status == "parsed").alias("flow_updates"),
        F.count_if(F.col("is_new")).alias("flows"),
    )


def protocol_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id", "protocol").agg(F.count("*").alias("packets"))


def stage_percentiles(samples: DataFrame, last: int = LATENCY_SAMPLES) -> DataFrame:
    """p50 and p95 (linear interpolation) of the newest ``last`` samples per stage.

    ``samples``: stage, seq, milliseconds. The newest rows are first picked per stage and stretch of
    ``seq``, so a busy stage never meets in one task before it is down to ``last`` rows per stretch.
    """
    def newest(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
        return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= last)

    stretches = samples.withColumn("_stretch", floor_div(F.col("seq"), SAMPLE_STRETCH))
    kept = newest(newest(stretches, "stage", "_stretch"), "stage")
    return kept.groupBy("stage").agg(
        F.percentile("milliseconds", F.array(F.lit(0.5), F.lit(0.95))).alias("_p"), F.count("*").alias("samples")
    ).select("stage", F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"), "samples")


def rate_samples(
    frame_log: DataFrame, every_ms: int = RATE_INTERVAL_MS, keep: int | None = RATE_SAMPLES
) -> DataFrame:
    """Rates per event-time interval beside the counters so far; the newest ``keep`` intervals.

    Frames are summed per interval before the running sums, which are scanned in stretches of intervals.
    """
    size = every_ms * 1000
    per_interval = frame_log.groupBy("capture_id", (floor_div(F.col("ts_us"), size) * size).alias("interval_us")).agg(
        F.count("*").alias("_packets"),
        F.sum("frame_length").alias("_bytes"),
        F.count_if(F.col("is_new")).alias("_flows"),
        F.count_if(F.col("status") == "parsed").alias("_updates"),
    )
    stretch = _stretch(size)
    counters = {n: ("sum", F.col(f"_{n}"), True) for n in ("packets", "bytes", "flows", "updates")}
    running = chunk_scan(per_interval, ["capture_id"], stretch, [F.col("interval_us")], counters)
    seconds = every_ms / 1000
    if keep is not None:
        later = {"_later": ("sum", F.lit(1).cast("long"), False)}
        running = chunk_scan(running, ["capture_id"], stretch, [F.col("interval_us").desc()], later, reverse=True).where(F.col("_later") < keep)
    return running.select(
        "capture_id", "interval_us", "packets", "bytes", "flows", F.col("updates").alias("flow_updates"),
        (F.col("_packets") / seconds).alias("packets_per_second"),
        (F.col("_flows") / seconds).alias("flows_per_second"),
        (F.col("_bytes") * 8 / 1_000_000 / seconds).alias("mbps"),
    )


def _stretch(interval_us: int) -> Column:
    """Intervals that one task scans."""
    return F.floor(F.col("interval_us") / F.lit(interval_us * INTERVALS_PER_TASK)).cast("long")


def capture_summary(frame_log: DataFrame) -> DataFrame:
    """Span from the first frame to the latest time, and the average rate (null for an empty span)."""
    first = F.min_by("ts_us", "frame_no")
    span = F.greatest(F.max("ts_us") - first, F.lit(0)) / 1_000_000
    sums = frame_log.groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.sum("frame_length").alias("bytes"), span.alias("capture_duration_seconds")
    )
    seconds = F.col("capture_duration_seconds")
    return sums.withColumn(
        "observed_average_mbps", F.when(seconds > 0, F.col("bytes") * 8 / 1_000_000 / seconds)
    )


def timeline_points(samples: DataFrame) -> DataFrame:
    """Rates between consecutive samples of cumulative counters; never negative, the first point is 0."""
    c = F.col
    latest = F.struct("interval_us", "packets", "bytes", "flows")
    rows = chunk_scan(samples, ["capture_id"], _stretch(RATE_INTERVAL_MS * 1000), [c("interval_us")], {"_before": ("max", latest, False)})

    def delta(name: str):
        return F.greatest(F.coalesce(c(name) - c(f"_before.{name}"), F.lit(0)), F.lit(0))

    elapsed = F.coalesce(
        F.greatest((c("interval_us") - c("_before.interval_us")) / 1_000_000, F.lit(0.001)), F.lit(1.0)
    )
    return rows.select(
        "capture_id", "interval_us", "packets", "bytes", "flows",
        (delta("bytes") * 8 / elapsed / 1_000_000).alias("mbps"),
        (delta("packets") / elapsed).alias("packets_per_second"),
        (delta("flows") / elapsed).alias("flows_per_second"),
    )
