"""Alert records, suppression and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.fixed import ALERT_COOLDOWN_US, CAPABILITIES, LATEST_ALERTS
from flowloom.functions.ids import alert_id
from flowloom.operators.evidence import severity
from flowloom.operators.scan import greedy_chain

ALERT_KEY = ["threat_class", "source_ip", "destination_ip", "detector_id", "decision"]


def build_alerts(gated: DataFrame) -> DataFrame:
    """One alert per row with a decision; its time is the flow's last packet."""
    c = F.col
    return gated.where(c("decision").isNotNull()).select(
        "capture_id",
        "flow_start",
        "trigger_frame",
        alert_id(c("detector_id"), c("threat_class"), c("last_seen_us"), c("flow_id"), c("window_id")).alias("alert_id"),
        c("last_seen_us").alias("ts_us"),
        "flow_id",
        "window_id",
        "threat_class",
        severity(c("threat_class")).alias("severity"),
        "decision",
        "calibrated_confidence",
        "raw_score",
        "class_threshold",
        c("emitted_us") if "emitted_us" in gated.columns else c("observed_us").alias("emitted_us"),
        "evidence_quality",
        "source_ip",
        "source_port",
        "destination_ip",
        "destination_port",
        "evidence",
        "evidence_flags",
        c("gate_missing").alias("missing_evidence"),
        "capabilities",
        "detector_id",
        "model_version",
        c("schema_version").alias("feature_schema_version"),
    )


def dedupe_alerts(alerts: DataFrame, cooldown_us: int = ALERT_COOLDOWN_US) -> DataFrame:
    """Per key keep an alert at least ``cooldown_us`` after the last *kept* one, in (time, flow) order.

    The chain needs times only; which alert of a key comes first at a kept time is seen among the alerts of that time.
    """
    kept = greedy_chain(alerts.select(*ALERT_KEY, "ts_us", F.lit(0).alias("pos")), ALERT_KEY, cooldown_us)
    at = [*ALERT_KEY, "ts_us"]
    ordered = alerts.join(kept, at, "left_semi").withColumn("_pos", F.struct("flow_id", "window_id", "alert_id"))
    first = F.min("_pos").over(Window.partitionBy(*at))
    return ordered.withColumn("_first", first).where(F.col("_pos") == F.col("_first")).select(*alerts.columns)


def decision_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("decision", F.lit("NO_ALERT")).alias("decision")).agg(
        F.count("*").alias("verdicts")
    )


def latest_alerts(alerts: DataFrame, n: int = LATEST_ALERTS) -> DataFrame:
    return alerts.orderBy(F.col("ts_us").desc(), F.col("alert_id")).limit(n)


def alert_by_id(alerts: DataFrame, wanted: str | Column) -> DataFrame:
    return alerts.where(F.col("alert_id") == wanted)


def explain_alerts(alerts: DataFrame) -> DataFrame:
    """One row per evidence value, evidence flag and capability of each alert."""
    c = F.col
    text = F.concat(
        F.transform(
            F.map_entries("evidence"),
            lambda e: F.struct(F.lit("evidence").alias("kind"), e["key"].alias("name"), e["value"].alias("number"),
                               F.lit(None).cast("boolean").alias("flag")),
        ),
        F.transform(
            F.map_entries("evidence_flags"),
            lambda e: F.struct(F.lit("evidence").alias("kind"), e["key"].alias("name"),
                               F.lit(None).cast("double").alias("number"), e["value"].alias("flag")),
        ),
        F.array(
            *[
                F.struct(F.lit("capability").alias("kind"), F.lit(n).alias("name"),
                         F.lit(None).cast("double").alias("number"), c(f"capabilities.{n}").alias("flag"))
                for n in CAPABILITIES
            ]
        ),
    )
    return alerts.select("alert_id", F.explode(text).alias("_r")).select("alert_id", "_r.*")


def alert_markers(alerts: DataFrame, spans: DataFrame) -> DataFrame:
    """Alerts inside a plotted span, with their position from 0 to 100.

    ``spans`` has one row per capture: capture_id, first_us, last_us.
    """
    at = F.col("emitted_us")
    width = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(1000))
    return (
        alerts.join(spans, "capture_id")
        .where(at.between(F.col("first_us"), F.col("last_us")))
        .select("alert_id", ((at - F.col("first_us")) / width * 100).alias("left_percent"))
    )
